import random

import pytest
from pyspark.sql import functions as F

from colloq.operators import align

WORDS = "file_id int, word_ord long, text string, start_s double, end_s double"
TURNS = "file_id int, speaker string, start_s double, end_s double"


def speakers(spark, words, turns, **kw):
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WORDS)
    t = spark.createDataFrame([(1, *x) for x in turns], TURNS)
    return [r.speaker for r in align.assign_speakers(w, t, **kw).orderBy("word_ord").collect()]


@pytest.mark.parametrize(
    ("word", "turns", "expect"),
    [
        (("x", 0.0, 10.0), [("A", 0.0, 3.0), ("B", 3.0, 10.0)], "B"),
        (("x", 0.0, 10.0), [("A", 0.0, 5.0), ("B", 5.0, 10.0)], "A"),
        (("x", 0.0, 1.0), [("A", 5.0, 6.0), ("B", 2.0, 3.0)], "B"),
        (("x", 4.0, 5.0), [("A", 0.0, 3.0), ("B", 6.0, 9.0)], "A"),
        (("x", 5.0, 5.0), [("A", 0.0, 5.0), ("B", 5.0, 10.0)], "A"),
        (("x", 1.0, 2.0), [], "SPEAKER_00"),
        (("x", 1e9, 2e9), [("A", 0.0, 5.0)], "A"),
    ],
)
def test_choice(spark, word, turns, expect):
    assert speakers(spark, [word], turns) == [expect]


def test_against_brute_force(spark):
    r = random.Random(3)
    grid = lambda: r.randrange(0, 4000) / 8
    words = [("w", s := grid(), s + r.choice([0, 0.125, 0.5, 2, 40])) for _ in range(300)]
    turns = [(r.choice("ABC"), s := grid(), s + r.choice([0, 0.5, 1, 3, 90, 400 if i < 3 else 2])) for i in range(90)]

    def best(w):
        def key(t):
            overlap = max(0.0, min(w[2], t[2]) - max(w[1], t[1]))
            return (-overlap, max(0.0, t[1] - w[2], w[1] - t[2]), t[1], t[2], t[0])

        return min(turns, key=key)[0]

    assert speakers(spark, words, turns) == [best(w) for w in words]


def test_short_turns_dropped_and_dirty_rows(spark):
    got = speakers(spark, [("x", 5.0, 5.2)], [("A", 0.0, 4.9), ("SHORT", 5.0, 5.1), ("B", 5.3, 9.0)], least_seconds=0.3)
    assert got[0] in "AB"
    words = [("good", 0.0, 1.0), ("nan", float("nan"), 2.0), ("inf", 3.0, float("inf")), (None, 1.0, 2.0), ("　", 1.0, 2.0), ("back", 5.0, 2.0)]
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WORDS)
    kept = {r.text: (r.start_s, r.end_s) for r in align.clean_words(w).collect()}
    assert kept == {"good": (0.0, 1.0), "back": (5.0, 5.0)}


def test_segments_and_lines(spark):
    words = [(" こん ", 0.0, 0.5), ("にちは", 0.5, 1.0), ("はい", 3.0, 3.5), ("続き", 3.6, 4.0)]
    turns = [("A", 0.0, 1.0), ("B", 2.9, 3.5), ("B", 3.55, 5.0)]
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], WORDS)
    t = spark.createDataFrame([(1, *x) for x in turns], TURNS)
    segments = align.speaker_segments(align.assign_speakers(w, t), bucket=1.0)
    assert [tuple(r) for r in segments.orderBy("start_s").collect()] == [(1, "A", 0.0, 1.0, 2, "こんにちは"), (1, "B", 3.0, 4.0, 2, "はい続き")]
    assert [r.line for r in align.transcript_lines(segments).orderBy("start_s").collect()] == ["[00:00.000 - 00:01.000] A: こんにちは", "[00:03.000 - 00:04.000] B: はい続き"]


def test_empty_tables(spark):
    w, t = spark.createDataFrame([], WORDS), spark.createDataFrame([], TURNS)
    assert align.speaker_segments(align.assign_speakers(w, t)).count() == 0


def test_recognition_payloads(spark):
    rows = [
        (1, '{"segments":[{"text":"a b","words":[{"word":"a","start":0,"end":"x"},{"word":"b","start":1,"end":2}]},{"text":" c ","start":3,"end":4},{"text":" "}]}'),
        (2, "{}"),
        (3, "[1]"),
        (4, None),
        (5, '{"segments":[{"words":[null],"text":"d"}]}'),
    ]
    got = align.flatten_recognition(spark.createDataFrame(rows, "k int, p string"), ["k"], "p").orderBy("k", "seg", "ord").collect()
    assert [(r.k, r.text) for r in got] == [(1, "a"), (1, "b"), (1, " c "), (5, "d")]
    assert got[0].end_s != got[0].end_s and got[2].start_s == 3.0


def test_timestamps(spark):
    from colloq.functions.text import format_timestamp, minute_stamp

    got = spark.createDataFrame([(0.0,), (61.2345,), (3600.0,), (-0.019,), (1e300,)], "s double").select(format_timestamp(F.col("s")).alias("t"), minute_stamp(F.col("s")).alias("m")).collect()
    assert [r.t for r in got] == ["00:00.000", "01:01.234", "01:00:00.000", "-1:59:59.981", None]
    assert [r.m for r in got][:3] == ["[00:00]", "[01:01]", "[60:00]"]
