import random

import pytest
from pyspark.sql import functions as F

from colloq.operators.intervals import IntervalMap, merge_intervals

SCHEMA = "id long, e string, s long, t long"


def brute(rows):
    out = set()
    groups = {}
    for i, e, s, t in set(rows):
        if None not in (e, s, t) and t >= s:
            groups.setdefault(e, set()).add((s, t, i))
    for e, xs in groups.items():
        periods = []
        for s, t, _ in sorted(xs):
            if periods and s <= periods[-1][1]:
                periods[-1] = [periods[-1][0], max(periods[-1][1], t), periods[-1][2] + 1]
            else:
                periods.append([s, t, 1])
        out |= {(e, "period", a, b, n) for a, b, n in periods}
        out |= {(e, "gap", p[1], q[0], 0) for p, q in zip(periods, periods[1:])}
    return out


def run(spark, rows, bucket, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("other")).withColumn("kind", F.lit(1))
    found = merge_intervals(df, ["e"], F.col("s"), F.col("t"), identity=F.col("id"), bucket=bucket, **kw).collect()
    assert len(found) == len(set(found))
    return {(r.e, r.kind, r.from_t, r.to_t, r.n) for r in found}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bucket", [7, 50, 100_000])
def test_against_brute_force(spark, seed, bucket):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        s = r.randrange(-300, 1500)
        length = r.choice([0, 1, 3, 10, 200 if r.random() < 0.1 else 4])
        rows.append((i, r.choice(["a", "a", "a", "b", "c", None]), s, s + length))
    rows += rows[:40] + [(900, "a", None, 5), (901, "a", 5, None), (902, "b", 9, 3), (903, "c", 10**15, 10**15 + 5)]
    assert run(spark, rows, bucket, held=20) == brute(rows)


def test_touching_is_one_period_and_repeats_count_once(spark):
    rows = [(1, "a", 0, 10), (1, "a", 0, 10), (2, "a", 10, 20), (3, "a", 21, 30)]
    assert run(spark, rows, 8) == {("a", "period", 0, 20, 2), ("a", "period", 21, 30, 1), ("a", "gap", 20, 21, 0)}


def test_long_interval_over_many_buckets(spark):
    rows = [(1, "a", 0, 10_000_000), (2, "a", 5_000_000, 5_000_001), (3, "a", 10_000_002, 10_000_003)]
    assert run(spark, rows, 10) == {("a", "period", 0, 10_000_000, 2), ("a", "period", 10_000_002, 10_000_003, 1), ("a", "gap", 10_000_000, 10_000_002, 0)}


def test_empty(spark):
    assert run(spark, [], 10) == set()


def test_clashing_keys_are_refused(spark):
    df = spark.createDataFrame([(1, 2, 3)], "kind long, s long, t long")
    with pytest.raises(ValueError):
        merge_intervals(df, ["kind"], F.col("s"), F.col("t"))


def test_interval_map():
    m = IntervalMap()
    for a, b in [(5, 6), (1, 2), (2, 3), (8, 9), (6, 8)]:
        m.insert(a, b)
    assert list(m) == [(1, 3, 2), (5, 9, 3)]
    assert m.gaps() == [(3, 5)]


def test_usable_turns(spark):
    from colloq.plans.intervals import usable_turns

    rows = [(1, 7, " a　", 0.0, 1.0), (2, 7, "b", 1.0, 1.0004), (3, 7, "　", 0.0, 1.0), (4, 7, None, 0.0, 1.0), (5, 7, "c", float("nan"), 1.0), (6, 7, "d", 0.0, float("inf")), (7, 7, "e", 2.0, 1.0), (8, 7, "f", 0.0, 1e300), (9, None, "g", 0.0, 2.0)]
    got = usable_turns(spark.createDataFrame(rows, "turn_id long, file_id int, speaker string, start_s double, end_s double")).collect()
    assert {(r.turn_id, r.speaker, r.start_ms, r.end_ms) for r in got} == {(1, "A", 0, 1000), (9, "G", 0, 2000)}


def test_running_total(spark):
    from colloq.operators.runs import running_total

    r = random.Random(8)
    rows = [(r.choice("ab"), i, r.randrange(5)) for i in r.sample(range(-300, 9000), 500)]
    got = running_total(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", "t", width=100).collect()
    assert all(x.t == sum(v for k, o, v in rows if k == x.k and o < x.o) for x in got) and len(got) == 500
