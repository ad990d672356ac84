import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloq.operators import changelog
from colloq.sources import audio, documents


def wav(seconds, rate=8000, junk=b"", size=None):
    data = b"\x01\x00" * int(seconds * rate)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + form + b"LIST" + struct.pack("<I", 3) + b"abc\x00" + b"data" + struct.pack("<I", size if size is not None else len(data)) + data + junk
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_layout():
    assert audio.wav_layout(wav(2, size=0, junk=b"\x01"))[:3] == (1, 8000, 2)
    assert audio.wav_layout(wav(2, size=0))[5] == 2.0
    for bad in (b"", b"RIFF", b"RIFX" + wav(1)[4:], wav(1)[:30], wav(1)[:36]):
        assert audio.wav_layout(bad) is None
    fixed = audio.repaired(wav(2, size=0, junk=b"\x01"))
    assert audio.wav_layout(fixed)[4] == 32000 and len(fixed) == struct.unpack("<I", fixed[4:8])[0] + 8


def test_recoverable(spark, tmp_path):
    (tmp_path / "a.wav.part").write_bytes(wav(2, size=0))
    (tmp_path / "b.wav.part").write_bytes(wav(0.5))
    (tmp_path / "c.wav.part").write_bytes(b"nothing")
    (tmp_path / "d.wav").write_bytes(wav(2))
    got = audio.recoverable_recordings(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.seconds) for r in got] == [("a.wav.part", 2.0)]


def test_pcm_frames(spark):
    loud, quiet = b"\x00\x40" * 512, b"\x00\x00" * 512
    rows = [("s", 0, loud[:700]), ("s", 1, loud[700:] + quiet + b"\x00"), ("t", 0, quiet), ("t", 1, None)]
    got = audio.frames(spark.createDataFrame(rows, "session string, chunk_no long, data binary")).orderBy("session", "frame_no").collect()
    assert [tuple(r) for r in got] == [("s", 1, 1.0), ("s", 2, 0.0), ("t", 1, 0.0)]
    assert audio.decode_pcm(b"\x00\x80\xff").tolist() == [-1.0]


def test_resampling_in_chunks_equals_whole():
    x = np.sin(np.arange(480) / 9)
    whole, *_ = audio.resample(x, 48_000)
    at, last, parts = 0.0, 0.0, []
    for i in range(0, 480, 50):
        y, at, last = audio.resample(x[i : i + 50], 48_000, at, last)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole, atol=1e-6)
    assert audio.downmix(np.array([1.0, 3.0, 5.0, 7.0, 9.0]), 2).tolist() == [2.0, 6.0]


def test_artifacts(spark, tmp_path):
    good = {"version": 1, "source": "a.wav", "keywords": [{"word": "w", "score": 1.5}]}
    for name, text in {"a": json.dumps(good), "b": "{", "c": json.dumps(good | {"version": 999}), "d": json.dumps({"version": 1}), "e": "[]"}.items():
        (tmp_path / f"{name}.keywords.json").write_text(text)
    got = documents.load_artifacts(spark, str(tmp_path), "keywords").collect()
    assert [(r.stem, r.keywords.keywords[0].word) for r in got] == [("a", "w")]
    raw = spark.createDataFrame([('{"version":1,"kind":"other","statements":[],"relations":[]}',), ('{"version":1,"kind":"logical_structure","statements":[],"relations":[]}',), (None,)], "value string")
    assert documents.parse_artifacts(raw, "structure").count() == 1


def test_lines_and_events(spark, tmp_path):
    finals = spark.createDataFrame([("s", 61.9, "hi"), ("s", None, "x"), ("s", 5.0, ""), ("s", 5.0, None)], "session string, t0 double, text string")
    assert {r.line for r in documents.draft_lines(finals).collect()} == {"[01:01] hi", "[00:00] x"}
    ev = spark.createDataFrame([("job", 7, "a\nb"), ("beat", None, "{}")], "event string, id long, data string")
    assert {r.frame for r in documents.server_events(ev).collect()} == {"event: job\nid: 7\ndata: a\ndata: b\n\n", "event: beat\ndata: {}\n\n"}
    lines = spark.createDataFrame([('READY {"port": 5}',), ("READY nope",), ("other",), (None,)], "value string")
    assert [r.port for r in documents.tagged_lines(lines, "READY ", "port int").collect()] == [5]
    body = spark.createDataFrame([("あ" * 3,)], "b string").select(documents.fits_request(F.col("b"), 9).alias("x"), documents.fits_request(F.col("b"), 8).alias("y")).first()
    assert body.x and not body.y
    target = tmp_path / "doc.json"
    documents.replace_file(str(target), "{}")
    assert target.read_text() == "{}" and len(list(tmp_path.iterdir())) == 1


def test_transcript_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2.0, "b"), (1, 1.0, "a"), (2, 0.0, "c")], "file_id int, start_s double, line string")
    documents.write_transcripts(lines, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out/file_id=1")).collect()
    assert [r.value for r in got] == ["a", "b"]


def test_changelog(spark):
    rows = [(1, "a", "queued"), (2, "a", "done"), (3, "b", "processing"), (4, "c", "odd")]
    df = spark.createDataFrame(rows, "v long, f string, s string")
    got = {r.f: (r.v, r.r) for r in changelog.latest(df, ["f"], "v").withColumn("r", changelog.state_rank(F.col("s"))).collect()}
    assert got == {"a": (2, 3), "b": (3, 0), "c": (4, 99)}
    assert [r.v for r in changelog.last_rows(df, ["f"], ["v"], 1).orderBy("v").collect()] == [2, 3, 4]
    names = spark.createDataFrame([(1, "x.wav"), (2, "x.wav"), (3, ".x"), (4, ".x"), (5, "x.wav")], "o long, n string")
    assert [r.unique_name for r in changelog.unique_names(names, "n", "o").orderBy("o").collect()] == ["x.wav", "x_2.wav", ".x", ".x_2", "x_3.wav"]
    taken = spark.createDataFrame([(1, "a.wav"), (2, "a.wav"), (3, "a_2.wav"), (4, "a_2.wav"), (5, "a.wav"), (6, "a_4.wav"), (7, None)], "o long, n string")
    assert [r.unique_name for r in changelog.unique_names(taken, "n", "o").orderBy("o").collect()] == ["a.wav", "a_3.wav", "a_2.wav", "a_2_2.wav", "a_5.wav", "a_4.wav", None]
    out = spark.createDataFrame([("/o/m.txt",), ("/o/q.txt",)], "path string")
    src = spark.createDataFrame([("/d/m.wav",), ("/d/m.MP3",), ("/d/m.flac",)], "path string")
    assert [tuple(r) for r in changelog.history(out, src, "path").collect()] == [("m", "/o/m.txt", "/d/m.MP3")]


def test_artifacts_are_written_and_read(spark, tmp_path):
    import json

    rows = [("a", json.dumps({"version": 1, "source": "a.wav", "keywords": [{"word": "w", "score": 1.5}]})), ("b", json.dumps({"version": 9, "keywords": []})), ("c", "{broken")]
    documents.write_artifacts(spark.createDataFrame(rows, "stem string, value string"), str(tmp_path), "keywords")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.keywords.json", "b.keywords.json", "c.keywords.json"]
    assert [(r.stem, r.keywords.keywords[0].word) for r in documents.load_artifacts(spark, str(tmp_path), "keywords").collect()] == [("a", "w")]
    with pytest.raises(ValueError):
        documents.write_artifacts(spark.createDataFrame(rows, "stem string, value string"), str(tmp_path), "other")


def test_files_are_processed_apart(spark, tmp_path):
    seen, held, asked = [], [], []
    batch = spark.createDataFrame([("/in/a.wav", "a", 1, b"x"), ("/in/b.Wav", "b", 1, b"")], "path string, stem string, length long, content binary")

    def length(file):
        if not file["content"]:
            raise RuntimeError("empty")
        return str(len(file["content"]))

    def paused():
        asked.append(1)
        return len(asked) < 3

    documents.process_files(length, paused=paused, on_discover=seen.extend, done=lambda df: held.extend(tuple(r) for r in df.collect()), wait_s=0.01)(batch, 0)
    assert sorted(seen) == ["a", "b"] and len(asked) == 3
    assert sorted(held) == [("/in/a.wav", "1", None), ("/in/b.Wav", None, "RuntimeError: empty")]


def test_browser_samples():
    assert audio.quantize(np.array([1.0, -1.0, 2.0])) == np.array([32767, -32767, 32767], "<i2").tobytes()
    assert audio.quantize(np.array([1.0, -1.0, -0.5]), full_negative=True) == np.array([32767, -32768, -16384], "<i2").tobytes()
    line = np.sin(np.arange(4800) / 30)
    whole = audio.Downsampler(48_000).feed(line)
    parts = audio.Downsampler(48_000)
    assert b"".join(parts.feed(line[i : i + 128]) for i in range(0, 4800, 128)) == whole
    got = np.frombuffer(whole, "<i2") / 32767
    assert len(got) == 1600 and np.allclose(got, line[::3], atol=1e-3)
    stereo = np.repeat(line, 2)
    assert audio.Downsampler(44_100).feed(stereo, 2) == audio.Downsampler(44_100).feed(line)


def test_recordings_are_recovered(spark, tmp_path):
    def wav(seconds, rate=16_000):
        data = b"\x01\x00" * int(seconds * rate)
        return b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", 0) + data

    left, target = tmp_path / "t", tmp_path / "s"
    left.mkdir()
    (left / "live_a.wav.part").write_bytes(wav(2) + b"\x01")
    (left / "live_b.wav.part").write_bytes(wav(0.5))
    (left / "live_c.wav.part").write_bytes(b"no recording")
    (left / "live_d.wav").write_bytes(wav(3))
    target.mkdir()
    (target / "recovered_live_a.wav").write_bytes(b"x")
    moved = audio.recover_recordings(spark, str(left), str(target))
    assert [m.rsplit("/", 1)[1] for m in moved] == ["recovered_live_a_2.wav", "recovered_live_d.wav"] and not list(left.iterdir())
    assert audio.wav_layout((target / "recovered_live_a_2.wav").read_bytes())[4] == 64_000
    df = spark.createDataFrame([(16_000,), (24_000,), (800,)], "n long")
    assert [r[0] for r in df.select(audio.elapsed_seconds(F.col("n"))).collect()] == [1.0, 1.5, 0.0]


def test_pending_replay_and_session_ids(spark):
    import json

    log = spark.createDataFrame([(v, "job", f"f{v}") for v in range(1, 8)], "v long, e string, f string")
    assert sorted(r.v for r in changelog.pending(log, "v", "e", 4).collect()) == [5, 6, 7]
    assert [tuple(r) for r in changelog.pending(log, "v", "e", 1, most=5).collect()] == [(7, "reset", None)]
    assert changelog.pending(log, "v", "e", 9).count() == 0
    status = spark.createDataFrame([("s", "recording"), ("t", "idle")], "session string, state string")
    finals = spark.createDataFrame([("s", n, n, f"x{n}", 0.0, 1.0) for n in range(5)], "session string, seq long, utterance_id int, text string, t0 double, t1 double")
    words = spark.createDataFrame([("s", "b", 1.0, 2), ("s", "a", 2.0, 1)], "session string, word string, score double, rank int")
    graphs = spark.createDataFrame([("s", 3, [("n", 1, 1)], []), ("t", 0, [], [])], "session string, seq int, nodes array<struct<id: string, weight: int, last_seen: int>>, edges array<struct<a: string, b: string, weight: double>>")
    got = [json.loads(r.message) for r in changelog.replay(status, finals, words, graphs, 2).filter("session = 's'").orderBy("part", "n").collect()]
    assert [m["type"] for m in got] == ["status", "final", "final", "keywords", "graph"] and [m["text"] for m in got[1:3]] == ["x3", "x4"]
    assert got[3]["keywords"][0] == {"word": "a", "score": 2.0}
    starts = spark.createDataFrame([(1, "2024-01-31 09:05:59"), (2, "2024-01-31 09:05:01"), (3, "2024-01-31 09:06:00"), (4, "2024-01-31 09:05:30")], "ord long, at string").withColumn("at", F.to_timestamp("at"))
    taken = spark.createDataFrame([("20240131_0906",), ("20240131_0905_2",), ("other",)], "session_id string")
    assert [r.session_id for r in changelog.session_ids(starts, "at", taken).orderBy("ord").collect()] == ["20240131_0905", "20240131_0905_3", "20240131_0906_2", "20240131_0905_4"]
