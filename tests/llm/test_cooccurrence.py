import random
from collections import Counter
from itertools import combinations

import pytest

from colloq.llm.cooccurrence import associated_pairs, basket_items, normal_term

SCHEMA = "rec long, terms array<string>"


def brute(baskets, least, lift):
    n = Counter(t for b in baskets for t in b)
    ab = Counter(p for b in baskets for p in combinations(sorted(b), 2))
    size = sum(bool(b) for b in baskets)
    return {(a, b, c, n[a], n[b]) for (a, b), c in ab.items() if c >= least and c * size >= lift * n[a] * n[b]}


def run(spark, rows, least, lift, chunk):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("rec", "explode(terms) AS term", "1 AS item", "2 AS n", "'x' AS kind")
    return {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b) for r in associated_pairs(basket_items(df, "k", ["rec"], "term"), min_count=least, min_lift=lift, chunk=chunk).collect()}


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_against_brute_force_with_huge_baskets(spark, chunk):
    r = random.Random(1)
    words = [f"w{i:02d}" for i in range(40)]
    baskets = [set(r.sample(words[:25], r.randrange(0, 5))) for _ in range(400)] + [set(words)] * 3 + [{"w30", "w31", "w32"}] * 6
    rows = [(i, sorted(b)) for i, b in enumerate(baskets)]
    assert run(spark, rows + rows[:50], 5, 8, chunk) == brute(baskets, 5, 8)
    assert run(spark, rows, 2, 1, chunk) == brute(baskets, 2, 1)


def test_normalisation_and_dirty_rows(spark):
    assert normal_term(" ＡＰＩ　") == "api"
    rows = [(i, ["ＡＰＩ", "api ", None, "", "　", "Ｂ"]) for i in range(5)] + [(100 + i, ["z"]) for i in range(95)] + [(None, ["api", "b"]), (500, None), (501, [])]
    assert run(spark, rows, 5, 8, 64) == {("api", "b", 5, 5, 5)}


def test_empty(spark):
    assert run(spark, [], 5, 8, 64) == set()


def test_kinds_are_apart_and_scores(spark):
    df = spark.createDataFrame([(i, ["a", "b"]) for i in range(6)] + [(100 + i, ["c"]) for i in range(94)], SCHEMA).selectExpr("rec", "explode(terms) AS term")
    items = basket_items(df, "k", ["rec"], "term").unionByName(basket_items(df.filter("term = 'a'"), "l", ["rec"], "term"))
    got = associated_pairs(items, min_count=5, min_lift=8).collect()
    assert [(r.kind, r.n, r.lift, r.npmi) for r in got] == [("k", 100, round(6 * 100 / 36, 6), 1.0)]


def test_threshold_is_exact(spark):
    rows = [(i, ["a", "b"]) for i in range(5)] + [(50 + i, ["a"]) for i in range(5)] + [(100 + i, ["z"]) for i in range(70)]
    assert run(spark, rows, 5, 8, 64) == {("a", "b", 5, 10, 5)}  # 5 * 80 = 8 * 10 * 5
    assert run(spark, rows[:-1], 5, 8, 64) == set()
