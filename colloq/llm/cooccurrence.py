"""Items that appear together: pair counts over baskets and how far they exceed chance.

Two exact prunings come before any pair is made. A pair met ``min_count`` times needs two items met that often, and a
pair whose count is ``min_lift`` times the expected one needs ``max(n_a, n_b) * min_lift <= N`` because its count is at
most the smaller of the two. What is left of a basket is kept as one array; a basket of more than ``chunk`` items is
split by a hash of the item into chunks, every pair of chunks goes to its own group (so one basket is spread over many
tasks), and the products join the pairs of ordinary baskets in one map-side combined count.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloq.session import checkpoint


@lru_cache(maxsize=200_000)
def normal_term(term: str) -> str:
    """NFKC, trimmed, lower case."""
    return unicodedata.normalize("NFKC", term).strip().lower()


@F.pandas_udf(T.StringType())
def normal_terms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else normal_term(t))


normal_terms = normal_terms.asNondeterministic()  # else a filter on its result makes it run twice


def basket_items(df: DataFrame, kind: str, basket: list[str], term: str) -> DataFrame:
    """Distinct (kind, basket, item): terms normalised; null and empty ones are left out. ``basket`` may not be null."""
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in basket])
    rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in basket)).filter(F.col(term).isNotNull())
    rows = rows.select(F.lit(kind).alias("kind"), key.alias("basket"), normal_terms(F.col(term)).alias("item"))
    return rows.filter("item IS NOT NULL AND item <> ''").distinct()


def _ordinary_pairs(baskets: DataFrame) -> DataFrame:
    """All pairs of a basket's sorted items, as a nested transform: one row out per pair, nothing shuffled."""
    after = "filter(items, y -> y.item > x.item)"
    pairs = f"explode(flatten(transform(items, x -> transform({after}, y -> struct(x.item AS a, y.item AS b, x.n AS n_a, y.n AS n_b)))))"
    return baskets.select("kind", F.expr(pairs).alias("p")).select("kind", "p.*")


def _chunked_pairs(items: DataFrame, chunk: int) -> DataFrame:
    """Pairs of huge baskets, by chunk pair. ``items`` has the basket's size as ``size``."""
    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    rows = items.withColumn("parts", parts).withColumn("c", F.expr("pmod(xxhash64(item), parts)").cast("int"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("kind", "basket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") <= F.col("o")).alias("left"), (F.col("c") >= F.col("o")).alias("right"), F.struct("item", "n").alias("x"))
    # Without this the rows, which lie by basket, would be grouped where they are: a basket in one task.
    rows = rows.repartition("kind", "basket", "i", "j")
    pair = rows.groupBy("kind", "basket", "i", "j").agg(F.collect_list(F.when(F.col("left"), F.col("x"))).alias("l"), F.collect_list(F.when(F.col("right"), F.col("x"))).alias("r"))
    # Within one chunk (i = j) each unordered pair is met twice; across chunks once.
    pair = pair.select("kind", F.col("i") == F.col("j"), F.explode("l").alias("x"), "r").toDF("kind", "same", "x", "r")
    pair = pair.select("kind", "x", "same", F.explode("r").alias("y")).filter("NOT same OR x.item < y.item")
    swap = F.col("x.item") > F.col("y.item")
    pick = lambda p, q: F.when(swap, q).otherwise(p)
    return pair.select("kind", pick(F.col("x.item"), F.col("y.item")).alias("a"), pick(F.col("y.item"), F.col("x.item")).alias("b"), pick(F.col("x.n"), F.col("y.n")).alias("n_a"), pick(F.col("y.n"), F.col("x.n")).alias("n_b"))


def _marked(rows: DataFrame, few: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that have their key in ``few``, with its columns, and the others. ``few`` holds keys that each have at
    least a thousandth of all rows, so there are a thousand at most, and it is sent to all tasks: hot keys are not
    shuffled to one of them."""
    both = rows.join(F.broadcast(few.withColumn("__hot", F.lit(True))), keys, "left")
    return both.filter("__hot").drop("__hot"), both.filter("__hot IS NULL").select(*rows.columns)


def associated_pairs(items: DataFrame, *, min_count: int = 5, min_lift: float = 8, chunk: int = 64) -> DataFrame:
    """Pairs of items that share a basket at least ``min_count`` times and ``min_lift`` times as often as chance.

    ``items``: distinct (kind, basket, item), as :func:`basket_items` gives them; each kind is counted by itself.
    Result: ``kind``, ``item_a`` < ``item_b`` (by code point), ``n_ab``, ``n_a``, ``n_b``, ``n`` (baskets of the kind),
    ``lift`` and ``npmi``. Empty input gives no rows; a basket with one item counts in ``n`` and in its item's count.
    With ``min_count`` 1 and ``min_lift`` 0 all pairs come out. ``chunk``: the most items of a basket that are paired in
    one piece; it doesn't change the result.
    """
    items = checkpoint(items)  # counted, pruned and paired: the terms are normalised once
    few = max(1, items.count() // 1000)
    total = items.select("kind", "basket").distinct().groupBy("kind").agg(F.count("*").alias("total"))
    totals = F.broadcast(checkpoint(total))  # a row for each kind of basket
    lift = F.lit(str(min_lift)).cast("decimal(18,6)")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    counts = items.groupBy("kind", "item").agg(F.count("*").alias("n")).join(totals, "kind")
    counts = checkpoint(counts.select("kind", "item", "n", ((F.col("n") >= min_count) & (wide("n") * lift <= wide("total"))).alias("kept")))
    often, rest = _marked(items, counts.filter(F.col("n") >= few), ["kind", "item"])
    rows = often.filter("kept").drop("kept").unionByName(rest.join(counts.filter(F.col("kept") & (F.col("n") < few)).drop("kept"), ["kind", "item"]))
    sizes = rows.groupBy("kind", "basket").agg(F.count("*").alias("size")).filter("size > 1")
    giant, rows = _marked(rows, sizes.filter(F.col("size") >= F.greatest(F.lit(few), F.lit(chunk + 1))), ["kind", "basket"])
    huge = giant.unionByName(rows.join(sizes.filter(F.col("size") > chunk), ["kind", "basket"]).select(giant.columns))
    usual = rows.join(sizes.filter(F.col("size") <= chunk), ["kind", "basket"]).groupBy("kind", "basket").agg(F.collect_list(F.struct("item", "n")).alias("items"))
    pairs = _ordinary_pairs(usual).unionByName(_chunked_pairs(huge, chunk))
    found = pairs.groupBy("kind", "a", "b").agg(F.count("*").alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).filter(F.col("n_ab") >= min_count)
    found = found.join(totals, "kind")
    expected = wide("n_a") * wide("n_b")
    found = found.filter((wide("n_ab") * wide("total")).cast("decimal(38,0)") >= (expected * lift))
    p = F.col("n_ab") / F.col("total")
    score = F.col("n_ab") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
    return found.select("kind", F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", F.col("total").alias("n"), F.round(score, 6).alias("lift"), F.round(F.when(p < 1, F.log(score) / -F.log(p)).otherwise(F.lit(1.0)), 6).alias("npmi"))
