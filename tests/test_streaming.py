import random

import pytest
from pyspark.sql import functions as F

from colloq.operators import graph, segmenter
from colloq.operators.intervals import merge_intervals
from colloq.streaming import stateful


def run(spark, tmp_path, batches, schema, build, mode, sink="memory"):
    """Feeds the batches one by one and returns what came out of each."""
    folder = tmp_path / "in"
    folder.mkdir()
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: out.append([r.asDict(True) for r in df.collect()])).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_intervals_end_like_the_batch(spark, tmp_path):
    r = random.Random(4)
    schema = "id long, e string, s long, t long"
    rows = [(i, r.choice("ab"), s := r.randrange(300), s + r.randrange(15)) for i in range(60)]
    batches = [rows[:25], rows[20:45], rows[40:]]
    out = run(spark, tmp_path, batches, schema, lambda df: stateful.interval_stream(df, ["e"], "s", "t", "id"), "update")
    last = {}
    for batch in out:
        for key in {x["e"] for x in batch}:
            last[key] = {tuple(x.values()) for x in batch if x["e"] == key}
    batch = merge_intervals(spark.createDataFrame(rows, schema), ["e"], F.col("s"), F.col("t"), identity=F.col("id"))
    assert set().union(*last.values()) == {tuple(x) for x in batch.collect()}


def test_segmenter_ends_like_the_batch(spark, tmp_path):
    r = random.Random(6)
    schema = "session string, frame_no long, probability double"
    rows = [("s", i + 1, float(r.random() < 0.5)) for i in range(120)]
    options = segmenter.SegmenterOptions(0.5, 96, 64, 1.0, 64)
    out = run(spark, tmp_path, [rows[:50], rows[50:90], rows[85:]], schema, lambda df: stateful.segmenter_stream(df, options), "append")
    got = [(e["kind"], e["utterance_id"], e["t0"], e["t1"]) for b in out for e in b if e["kind"] != "update"]
    want = segmenter.segment_frames(spark.createDataFrame(rows, schema), options, flush=False).orderBy("seq").collect()
    assert got == [(e.kind, e.utterance_id, e.t0, e.t1) for e in want]


def test_graph_ends_like_the_batch(spark, tmp_path):
    schema = "session string, utt int, ord int, word string, score double"
    rows = [("s", u, o, w, 1.0 + o) for u, ws in enumerate(["ab", "bc", "ac", "abc"]) for o, w in enumerate(ws)]
    out = run(spark, tmp_path, [rows[:4], rows[4:]], schema, lambda df: stateful.graph_stream(df, max_nodes=2, decay=0.9, max_candidates=2), "update")
    numbered = graph.numbered_terms(spark.createDataFrame(rows, schema), "session", "utt", "ord", "word", "score")
    want = graph.graph_snapshots(numbered, max_nodes=2, decay=0.9, max_candidates=2).first().asDict(True)
    got = out[-1][0]
    order = lambda xs: sorted(map(repr, xs))
    assert got["seq"] == want["seq"] and order(got["nodes"]) == order(want["nodes"]) and order(got["edges"]) == order(want["edges"])


def test_running_counts(spark, tmp_path):
    out = run(spark, tmp_path, [[("s", "a"), ("s", "b")], [("s", "a")]], "session string, word string", lambda df: stateful.running_counts(df, ["session"]), "complete")
    assert {(x["word"], x["n"]) for x in out[-1]} == {("a", 2), ("b", 1)}


def test_upsert(spark, tmp_path):
    apply = stateful.upsert(str(tmp_path / "t"), ["k"], "v")
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]]):
        batch = spark.createDataFrame(rows, "k string, v long, s string")
        apply(batch, n)
        apply(batch, n)
    got = stateful.upserted(spark, str(tmp_path / "t"), ["k"], "v").collect()
    assert {(r.k, r.v, r.s) for r in got} == {("a", 2, "z"), ("b", 1, "y")}
    often = stateful.upsert(str(tmp_path / "u"), ["k"], "v", compact_every=2)
    for n in range(7):
        often(spark.createDataFrame([("a", n, "x"), (f"k{n % 2}", n, "y")], "k string, v long, s string"), n)
    assert {(r.k, r.v) for r in stateful.upserted(spark, str(tmp_path / "u"), ["k"], "v").collect()} == {("a", 6), ("k0", 6), ("k1", 5)}
    assert sorted(p.name for p in (tmp_path / "u").iterdir()) == ["part=5", "part=6", "whole=4", "whole=6"]


def test_intervals_with_a_horizon(spark, tmp_path):
    schema = "id long, e string, s long, t long"
    batches = [[(1, "a", 0, 5), (2, "a", 10, 20)], [(3, "a", 100, 110), (2, "a", 10, 20)], [(4, "a", 11, 12), (5, "a", 105, 130), (3, "a", 100, 110)]]
    out = run(spark, tmp_path, batches, schema, lambda df: stateful.interval_stream(df, ["e"], "s", "t", "id", horizon=50), "update")
    shown = [{tuple(x.values())[1:] for x in b} for b in out]
    assert shown[0] == {("period", 0, 5, 1), ("period", 10, 20, 1), ("gap", 5, 10, 0)}
    assert shown[2] == {("period", 10, 20, 1), ("period", 100, 130, 2), ("gap", 20, 100, 0)}


def test_an_utterance_over_two_triggers_is_one(spark, tmp_path):
    schema = "session string, utt int, ord int, word string, score double"
    rows = [("s", 0, 0, "a", 1.0), ("s", 0, 1, "b", 1.0), ("s", 0, 2, "c", 1.0), ("s", 1, 0, "a", 1.0)]
    out = run(spark, tmp_path, [rows[:2], rows[2:], rows[:1]], schema, lambda df: stateful.graph_stream(df), "update")
    assert [b[0]["seq"] for b in out] == [1, 2, 2]
    assert {(e["a"], e["b"], e["weight"]) for e in out[1][0]["edges"]} == {("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)}


def test_segmenter_is_flushed(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    out = []
    schema = "session string, frame_no long, probability double"
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = stateful.segmenter_stream(stream, segmenter.SegmenterOptions(0.5, 96, 64, 9.0, 64), flush_after_ms=200).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: out.extend((r.kind, r.utterance_id) for r in df.collect())).start()
    try:
        spark.createDataFrame([("s", i, 1.0) for i in range(1, 9)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        end = time.time() + 30
        while ("end", 1) not in out and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert out == [("start", 1), ("update", 1), ("end", 1)]


def test_transcript_stream(spark, tmp_path):
    def engine(mode, utterance, start, end):
        if end == 666:
            raise RuntimeError("bad")
        return f"{mode}{utterance}:{start}-{end}"

    schema = "session string, seq long, kind string, utterance_id int, samples long, t0 double, t1 double, at double"
    batches = [
        [("s", 1, "start", 1, 80, 0.0, None, 0.0), ("s", 2, "update", 1, 90, 0.0, None, 0.5), ("t", 1, "start", 1, 10, 0.0, None, 0.0)],
        [("s", 3, "update", 1, 150, 0.0, None, 1.0), ("s", 4, "end", 1, 200, 0.0, 2.0, 2.0), ("s", 5, "update", 1, 210, 0.0, None, 9.0)],
        [("s", 6, "end", 2, 666, 3.0, 4.0, 9.0), ("s", 7, "cancel", 3, 5, 5.0, 6.0, 9.0), ("t", 2, "stop", None, None, None, None, None), ("t", 3, "end", 1, 20, 0.0, 1.0, 9.0)],
        [("t", 4, "end", 1, 20, 0.0, 1.0, 9.0)],
    ]
    out = run(spark, tmp_path, batches, schema, lambda df: stateful.transcript_stream(df, engine, window=100), "append")
    got = [sorted((m["session"], m["seq"], m["type"], m["text"]) for m in b) for b in out]
    assert got == [
        [("s", 1, "partial", "partial1:0-80"), ("t", 1, "partial", "partial1:0-10")],
        [("s", 3, "partial", "partial1:0-80partial1:80-150"), ("s", 4, "final", "final1:0-200")],
        [("s", 6, "error", "bad"), ("s", 7, "final", ""), ("t", 2, "stop", None)],
        [],
    ]


def test_ranked_keywords(spark):
    counts = spark.createDataFrame([("s", "b", 2), ("s", "a", 2), ("s", "ccc", 1), ("t", "x", 1)], "session string, word string, n long")
    assert [(r.session, r.word, r["rank"]) for r in stateful.ranked_keywords(counts, ["session"], 2).orderBy("session", "rank").collect()] == [("s", "a", 1), ("s", "b", 2), ("t", "x", 1)]


def test_disconnect(spark, tmp_path):
    schema = "session string, seq long, kind string"
    folder = tmp_path / "in"
    folder.mkdir()
    out = []
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = stateful.disconnect_stream(stream, 200).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).start()
    try:
        rows = [("gone", 1, "connect"), ("gone", 2, "disconnect"), ("back", 1, "connect"), ("back", 2, "disconnect"), ("back", 3, "connect")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        import time

        end = time.time() + 30
        while not out and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert out == [("gone", "finalize")]


class Engine:
    def __init__(self):
        self.calls = []

    def __call__(self, mode, utterance, start, end):
        self.calls.append((mode, start, end))
        if end == 666:
            raise RuntimeError("bad")
        return f"<{start}-{end}>"


def test_live_messages_freeze_throttle_and_close():
    t, e = stateful.LiveTranscript(interval=1.0, window=100), Engine()
    assert t.handle("start", 1, 80, 0.0, None, 0.0, e)["text"] == "<0-80>"
    assert t.handle("update", 1, 90, 0.0, None, 0.5, e) is None
    assert t.handle("update", 1, 150, 0.0, None, 1.0, e)["text"] == "<0-80><80-150>"
    assert t.handle("end", 1, 200, 0.0, 2.0, 2.0, e) == {"type": "final", "utterance_id": 1, "text": "<0-200>", "t0": 0.0, "t1": 2.0}
    assert t.handle("update", 1, 210, 0.0, None, 9.0, e) is None and not t.frozen and not t.covered
    assert t.handle("cancel", 2, 5, 3.0, 4.0, 9.0, e) == {"type": "final", "utterance_id": 2, "text": "", "t0": 3.0, "t1": 3.0}
    assert t.handle("end", 3, 666, 0.0, 1.0, 9.0, e)["type"] == "error"


def test_latest_messages(spark):
    rows = [("s", 1, 1, "partial", "a"), ("s", 1, 3, "partial", "c"), ("s", 1, 2, "final", "b"), ("s", 2, 4, "partial", "d"), ("s", 3, 5, "error", "e")]
    df = spark.createDataFrame(rows, "session string, utterance_id int, seq int, type string, text string")
    assert {(r.utterance_id, r.text) for r in stateful.latest_messages(df).collect()} == {(1, "b"), (2, "d")}


def test_watch_folder(spark, tmp_path):
    from colloq.sources.documents import watch_folder

    (tmp_path / "in").mkdir()
    for name in ("a.wav", "b.MP3", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"xy")
    out = []
    q = watch_folder(spark, str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: out.extend((r.stem, r.length) for r in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(out) == [("a", 2), ("b", 2)]


pytest.importorskip("pyarrow")
