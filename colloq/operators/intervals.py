"""Continuous periods and gaps of intervals, per entity.

Each entity's intervals go into an ordered map of disjoint intervals (:class:`IntervalMap`): an insertion finds its
overlaps by binary search and merges them. The map is kept per entity and time bucket of the interval's start, first
over each partition (map-side), then over the shuffled partial maps, so that an entity holding a large part of all
rows is spread over as many tasks as it has buckets and reaches the shuffle already merged. Periods that run on from
bucket to bucket are joined with one summary row per entity and bucket: the latest end before the bucket tells which
of its periods continue an earlier one, so no interval is cut and none is copied.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloq.session import checkpoint


class IntervalMap:
    """Disjoint closed intervals in order, each with the number of intervals merged into it."""

    __slots__ = ("starts", "ends", "counts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.counts: list[int] = []

    def insert(self, start: int, end: int, count: int = 1) -> None:
        """Adds an interval; those that overlap or touch it become one with it."""
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
            count += sum(self.counts[lo:hi])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]
        self.counts[lo:hi] = [count]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        return iter(zip(self.starts, self.ends, self.counts, strict=True))

    def __len__(self) -> int:
        return len(self.starts)


def _merger(keys: list[str], held: int):
    """Batches of (keys, bucket, start, end, count) to merged ones. ``held`` bounds the intervals kept at a time;
    beyond it the maps are passed on and begun afresh, which the next merge puts right."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict[tuple, IntervalMap] = {}
        size = 0

        def rows() -> pd.DataFrame:
            flat = [(*k, *row) for k, m in maps.items() for row in m]
            return pd.DataFrame(flat, columns=[*keys, "bucket", "from_t", "to_t", "n"])

        for batch in batches:
            for *key, start, end, n in batch[[*keys, "bucket", "from_t", "to_t", "n"]].itertuples(index=False, name=None):
                m = maps.get(k := tuple(key))
                if m is None:
                    m = maps[k] = IntervalMap()
                before = len(m)
                m.insert(start, end, n)
                size += len(m) - before
            if size > held:
                yield rows()
                maps, size = {}, 0
        if maps:
            yield rows()

    return merge


def _sorted_merger(keys: list[str]):
    """As :func:`_merger` over rows sorted by key and bucket: one map at a time is kept, and each comes out once."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [*keys, "bucket", "from_t", "to_t", "n"]
        now, m = None, IntervalMap()
        for batch in batches:
            out: list[tuple] = []
            for *key, start, end, n in batch[cols].itertuples(index=False, name=None):
                if (k := tuple(key)) != now:
                    out.extend((*now, *row) for row in m) if now is not None else None
                    now, m = k, IntervalMap()
                m.insert(start, end, n)
            yield pd.DataFrame(out, columns=cols)
        if now is not None:
            yield pd.DataFrame([(*now, *row) for row in m], columns=cols)

    return merge


def merge_intervals(
    df: DataFrame, keys: list[str], start: Column, end: Column, *, identity: Column | None = None, bucket: int = 3_600_000, held: int = 200_000
) -> DataFrame:
    """Periods and gaps of the intervals ``start``-``end`` (BIGINT, in one unit) of each entity ``keys``.

    Result: the keys, ``kind`` ('period' or 'gap'), ``from_t``, ``to_t`` and ``n`` (intervals in a period; 0 for a gap).
    Intervals that overlap, nest or touch are one period; a gap lies between two neighbouring periods of an entity.
    ``identity`` counts an interval once however often its row is repeated; without it, equal rows of key, start and
    end count once. Rows with a null key, start or end, or an end before the start, are left out; an interval of no
    length is kept. No rows give no rows. Other columns are ignored, whatever their names.
    ``bucket`` is the width of a time bucket and ``held`` the intervals a task keeps before passing them on; neither
    changes the result.
    """
    if clash := {"kind", "from_t", "to_t", "n", "bucket"} & set(keys):
        raise ValueError(f"rename the keys {sorted(clash)}: the result has columns of these names")
    types = {f.name: f.dataType for f in df.schema.fields}
    ident = [identity.alias("__id")] if identity is not None else []
    rows = df.select(*[F.col(k) for k in keys], start.cast("bigint").alias("from_t"), end.cast("bigint").alias("to_t"), *ident)
    rows = rows.dropna(subset=[*keys, "from_t", "to_t"]).filter("to_t >= from_t").distinct()
    rows = rows.select(*keys, F.floor(F.col("from_t") / F.lit(bucket)).cast("bigint").alias("bucket"), "from_t", "to_t", F.lit(1).cast("bigint").alias("n"))
    schema = T.StructType([*(T.StructField(k, types[k]) for k in keys), *(T.StructField(c, T.LongType()) for c in ("bucket", "from_t", "to_t", "n"))])
    place = [*keys, "bucket"]
    merged = rows.mapInPandas(_merger(keys, held), schema).repartition(*place).sortWithinPartitions(*place, "from_t").mapInPandas(_sorted_merger(keys), schema)
    merged = checkpoint(merged)  # what runs on, periods and gaps are all found in it

    by_bucket = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = merged.groupBy(*place).agg(F.max("to_t").alias("__end")).withColumn("__carry", F.max("__end").over(by_bucket)).drop("__end")
    placed = merged.join(ends, place).withColumn("__new", F.col("__carry").isNull() | (F.col("from_t") > F.col("__carry")))
    placed = placed.withColumn("__before", F.coalesce(F.lag("to_t").over(W.partitionBy(*place).orderBy("from_t")), F.col("__carry")))
    placed = placed.withColumn("__before", F.greatest("__before", "__carry"))
    gaps = placed.filter("__new AND __before IS NOT NULL").select(*keys, F.lit("gap").alias("kind"), F.col("__before").alias("from_t"), F.col("from_t").alias("to_t"), F.lit(0).cast("bigint").alias("n"))

    heads = placed.groupBy(*place).agg(F.max(F.when(F.col("__new"), F.col("from_t"))).alias("__last")).withColumn("__open", F.max("__last").over(by_bucket)).drop("__last")
    periods = placed.join(heads, place).withColumn("__at", F.when(F.col("__new"), F.col("from_t")).otherwise(F.col("__open")))
    periods = periods.groupBy(*keys, "__at").agg(F.max("to_t").alias("to_t"), F.sum("n").alias("n"))
    periods = periods.select(*keys, F.lit("period").alias("kind"), F.col("__at").alias("from_t"), "to_t", "n")
    return periods.unionByName(gaps)
