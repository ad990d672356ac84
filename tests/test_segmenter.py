import random

from colloq.operators.segmenter import Segmenter, SegmenterOptions, chunk_spans, segment_frames, speech_islands

SMALL = SegmenterOptions(threshold=0.5, silence_ms=160, least_ms=96, longest_s=1.0, preroll_ms=64)


def kinds(frames, options=SMALL, flush=False):
    m = Segmenter(options)
    events = m.feed(frames)
    return [(e[0], e[1]) for e in events + (m.flush() if flush else [])]


def test_default_frames():
    assert SegmenterOptions().frames() == (15, 9, 937, 9)


def test_lifecycle():
    assert kinds([0.0] * 3 + [1.0] * 10 + [0.0] * 6) == [("start", 1), ("end", 1)]
    assert kinds([1.0] * 10) == [("start", 1), ("update", 1)]
    assert kinds([1.0] + [0.0] * 6) == [("start", 1), ("cancel", 1)]
    assert kinds([0.0] * 4) == [] and kinds([]) == []
    assert kinds([1.0] * 4, flush=True) == [("start", 1), ("update", 1), ("end", 1)]


def test_preroll_counts():
    m = Segmenter(SMALL)
    start = m.feed([0.0] * 4 + [1.0])[0]
    assert m.length == 3 and start[2] == 0.06


def test_forced_end():
    got = kinds([1.0] * 20, SegmenterOptions(0.5, 160, 96, 0.32, 64))
    assert got == [("start", 1), ("end", 1), ("start", 2), ("end", 2)]


def test_state_round_trip():
    a, b = Segmenter(SMALL), Segmenter(SMALL)
    r = random.Random(1)
    frames = [r.random() for _ in range(300)]
    whole = [e for e in a.feed(frames) if e[0] != "update"]
    parts = []
    for i in range(0, 300, 7):
        b = Segmenter(SMALL).restore(b.state())
        parts += [e for e in b.feed(frames[i : i + 7]) if e[0] != "update"]
    assert parts == whole


def test_table_form_and_islands(spark):
    r = random.Random(2)
    rows = [(s, i + 1, float(r.random() < 0.3)) for s in "ab" for i in range(200)] + [("c", 1, None), ("c", 2, float("nan"))]
    df = spark.createDataFrame(rows, "session string, frame_no long, probability double").repartition(3)
    options = SegmenterOptions(0.5, 96, 64, 1000.0, 0)
    got = segment_frames(df, options).filter("kind <> 'start'").collect()
    islands = speech_islands(df, 0.5, 3, 2).collect()
    assert {(e.session, e.utterance_id, e.kind, e.first_frame + 1, e.last_frame) for e in got} == {(i.session, i.utterance_id, i.kind, i.first_frame, i.close_frame) for i in islands}


def test_empty(spark):
    df = spark.createDataFrame([], "session string, frame_no long, probability double")
    assert segment_frames(df).count() == 0 and speech_islands(df).count() == 0


def test_chunk_spans(spark):
    df = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None)], "k int, n long")
    got = chunk_spans(df, ["k"], "n", 10).orderBy("k", "span_start").collect()
    assert [tuple(r) for r in got] == [(1, 0, 10), (1, 10, 20), (1, 20, 25), (2, 0, 10)]
