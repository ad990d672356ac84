"""Pairing records with the nearest record in time of the same entity, within a tolerance.

Both sides are cut into time ranges; a reference point within the tolerance of a range's edge goes to the neighbour
too, so each query point finds all it needs in its own range. Before the shuffle, points of one entity at one
millisecond are reduced to the one that wins ties, and queries to their distinct times, so a range holds at most one
row for each of its milliseconds however many rows share a time. The co-grouped ranges are searched with one
vectorised binary search that looks at the neighbour on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _search(tolerance: int):
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        entity = (left if left.num_rows else right).column("__entity")
        if not left.num_rows or not right.num_rows:
            return pa.table({"__entity": entity.slice(0, 0), "__at": pa.array([], pa.int64()), "__rank": pa.array([], pa.int64()), "__id": pa.array([], pa.int64()), "distance": pa.array([], pa.int64())})
        at = left.column("__at").to_numpy()
        t, rank, ident = (right.column(c).to_numpy() for c in ("__at", "__rank", "__id"))
        order = np.argsort(t, kind="stable")
        t, rank, ident = t[order], rank[order], ident[order]
        after = np.searchsorted(t, at, side="left")
        lo, hi = np.clip(after - 1, 0, len(t) - 1), np.clip(after, 0, len(t) - 1)
        d_lo, d_hi = np.abs(at - t[lo]), np.abs(at - t[hi])
        # Of two points equally far, the lower rank wins, then the lower id.
        take_lo = (d_lo < d_hi) | ((d_lo == d_hi) & ((rank[lo] < rank[hi]) | ((rank[lo] == rank[hi]) & (ident[lo] <= ident[hi]))))
        best, distance = np.where(take_lo, lo, hi), np.minimum(d_lo, d_hi)
        ok = distance <= tolerance
        return pa.table({"__entity": entity.slice(0, 1).take(pa.array(np.zeros(int(ok.sum()), np.int64))), "__at": at[ok], "__rank": rank[best[ok]], "__id": ident[best[ok]], "distance": distance[ok]})

    return nearest


def nearest_in_time(queries: DataFrame, points: DataFrame, entity: str, query_at: Column, point_at: list[Column], rank: Column, ident: Column, *, tolerance: int, width: int = 600_000) -> DataFrame:
    """Each row of ``queries`` with the nearest row of ``points`` of the same ``entity``.

    Times are BIGINT in one unit; a point may have several (its distance is the smallest). A query without a point
    within ``tolerance`` is left out; of points equally near, the one with the smallest ``rank``, then ``ident`` (both
    BIGINT) is taken. Rows with a null entity or time match nothing. Result: the queries' columns, ``point_id`` and
    ``distance``; repeated query rows stay repeated; columns of these names in the input are replaced. ``width``: of a time range; it doesn't change the result.
    """
    queries = queries.drop("point_id", "distance")
    kind = points.schema[entity].dataType
    mark = queries.withColumn("__entity", F.col(entity).cast(kind)).withColumn("__at", query_at.cast("bigint"))
    asked = mark.select("__entity", "__at").dropna().distinct().withColumn("__range", F.floor(F.col("__at") / F.lit(width)))
    known = points.select(F.col(entity).alias("__entity"), F.explode(F.array_distinct(F.array(*[c.cast("bigint") for c in point_at]))).alias("__at"), F.struct(rank.cast("bigint").alias("__rank"), ident.cast("bigint").alias("__id")).alias("__r"))
    known = known.filter("__entity IS NOT NULL AND __at IS NOT NULL").groupBy("__entity", "__at").agg(F.min("__r").alias("__r"))
    low, high = (F.floor((F.col("__at") + F.lit(d)) / F.lit(width)) for d in (-tolerance, tolerance))
    known = known.select("__entity", "__at", "__r.__rank", "__r.__id", F.explode(F.sequence(low, high)).alias("__range"))
    schema = T.StructType([T.StructField("__entity", kind), *(T.StructField(c, T.LongType()) for c in ("__at", "__rank", "__id", "distance"))])
    found = asked.groupBy("__entity", "__range").cogroup(known.groupBy("__entity", "__range")).applyInArrow(_search(tolerance), schema)
    joined = mark.join(found.select("__entity", "__at", F.col("__id").alias("point_id"), "distance"), ["__entity", "__at"])
    return joined.select(*queries.columns, "point_id", "distance")
