import random

import pytest
from pyspark.sql import functions as F

from colloq.llm.nearest import nearest_in_time

Q, P = "q long, e int, t long, distance string", "e int, ord long, a long, b long, point_id string"


def run(spark, queries, points, tolerance=25, width=100):
    q = spark.createDataFrame([(*x, "old") for x in queries], Q)
    p = spark.createDataFrame([(*x, "other") for x in points], P)
    got = nearest_in_time(q, p, "e", F.col("t"), [F.col("a"), F.col("b")], F.col("a"), F.col("ord"), tolerance=tolerance, width=width)
    return sorted((r.q, r.point_id, r.distance) for r in got.collect())


def brute(queries, points, tolerance=25):
    out = []
    for q, e, t in queries:
        near = [(min(abs(x - t) for x in (a, b) if x is not None), a, o) for pe, o, a, b in points if pe == e and e is not None and t is not None and a is not None]
        if near and min(near)[0] <= tolerance:
            out.append((q, min(near)[2], min(near)[0]))
    return sorted(out)


@pytest.mark.parametrize("width", [30, 100, 10_000])
def test_against_brute_force(spark, width):
    r = random.Random(7)
    queries = [(i, r.choice([1, 1, 1, 2, None]), r.randrange(-500, 3000)) for i in range(300)] + [(900, 1, None)]
    points = [(r.choice([1, 1, 2, 3]), i, a := r.randrange(-500, 3000), a + r.choice([0, 0, 5, 40, 90])) for i in range(150)]
    points += points[:30]
    assert run(spark, queries, points, width=width) == brute(queries, points)


def test_ties(spark):
    assert run(spark, [(1, 1, 100)], [(1, 5, 110, 110), (1, 9, 90, 90)]) == [(1, 9, 10)]
    assert run(spark, [(1, 1, 100)], [(1, 9, 90, 95), (1, 5, 90, 95)]) == [(1, 5, 5)]
    assert run(spark, [(1, 1, 100)], [(1, 3, 75, 75)]) == [(1, 3, 25)]
    assert run(spark, [(1, 1, 100)], [(1, 3, 74, 74)]) == []


def test_repeats_and_empty(spark):
    assert run(spark, [(1, 1, 100), (1, 1, 100)], [(1, 3, 100, 100)]) == [(1, 3, 0)] * 2
    assert run(spark, [], [(1, 3, 74, 74)]) == [] and run(spark, [(1, 1, 1)], []) == []
