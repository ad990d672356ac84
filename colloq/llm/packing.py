"""Filling containers of a fixed capacity with items of varying size.

Items are dealt by a hash of their id to shards of about ``shard_items`` items, however many there are in all, and each
shard is packed by best-fit decreasing: items in descending size, each into the open container with the least room that
still takes it, which a segment tree over remaining capacities finds in logarithmic time. With thousands of items in a
shard the room lost by not packing all at once is a fraction of one container per shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloq.session import checkpoint


class RoomTree:
    """How many open containers have each remaining capacity, as a segment tree over 0..capacity of which only the
    nodes that hold any are kept: its size follows the open containers, not the capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.count: dict[int, int] = {}
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.open.setdefault(room, []).append(container)
        i = room + self.size
        while i:
            self.count[i] = self.count.get(i, 0) + 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a container of the smallest room that is at least ``least``: (room, container)."""
        count, i = self.count, least + self.size
        if i >= 2 * self.size:
            return None
        if i not in count:
            while i > 1 and (i & 1 or i + 1 not in count):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if 2 * i in count else 2 * i + 1
        room = i - self.size
        held = self.open[room]
        container = held.pop()
        if not held:
            del self.open[room]
        while i:
            if count[i] == 1:
                del count[i]
            else:
                count[i] -= 1
            i >>= 1
        return room, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item; ``sizes`` in descending order, none above ``capacity``."""
    tree, out, n = RoomTree(capacity), np.empty(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        found = tree.take(size)
        if found is None:
            found, n = (capacity, n), n + 1
        room, container = found
        out[k] = container
        tree.add(room - size, container)
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    shard = pdf["shard"].iloc[0]
    where = best_fit_decreasing(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))
    return pd.DataFrame({"bin_kind": pdf["bin_kind"], "capacity": pdf["capacity"], "item": pdf["item"], "piece": pdf["piece"], "size": pdf["size"], "container": [f"s{shard}.{c}" for c in where]})


def pack(items: DataFrame, ident: str, size: str, kinds: list[tuple[str, int]], *, shard_items: int = 50_000) -> DataFrame:
    """Containers for ``items`` (distinct ``ident``, integer ``size``), once for each of ``kinds`` (name, capacity).

    Result: ``bin_kind``, ``capacity``, ``ident``, ``piece``, ``pieces``, ``size`` and ``container``, a name unique in
    its kind. Only an item larger than the capacity is cut: into pieces that fill a container each, and a last one that
    is packed with the rest. Items of size 0 take no room. Rows with a null ``ident`` or size, or a negative size, are
    left out; kinds without a positive capacity give no rows. ``kinds`` are part of the plan: each of them packs all
    items once more, so the result is as many times as large as the input.
    """
    kinds = sorted({(k, int(c)) for k, c in kinds if k is not None and c is not None and c > 0})
    ident_type = items.schema[ident].dataType
    base = items.select(F.col(ident).alias("item"), F.col(size).cast("long").alias("size")).filter("item IS NOT NULL AND size >= 0")
    base = checkpoint(base)  # sizes are dear to find and needed for the number of shards and for each kind
    shards = max(1, -(-base.count() // shard_items))
    each = F.array(*[F.struct(F.lit(k).alias("bin_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds]) if kinds else F.expr("cast(array() as array<struct<bin_kind:string,capacity:bigint>>)")
    rows = base.select("item", "size", F.explode(each).alias("k")).select("item", "size", "k.*")
    rows = rows.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
    full = rows.filter("pieces > 1").select("bin_kind", "capacity", "item", F.explode(F.sequence(F.lit(0), F.col("pieces") - 2)).alias("piece"), "pieces")
    full = full.select("bin_kind", "capacity", "item", "piece", F.col("capacity").alias("size"), F.concat_ws(".", F.lit("d"), F.col("item").cast("string"), F.col("piece").cast("string")).alias("container"))
    last = rows.select("bin_kind", "capacity", "item", (F.col("pieces") - 1).alias("piece"), (F.col("size") - F.col("capacity") * (F.col("pieces") - 1)).alias("size"), F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    schema = T.StructType([T.StructField("bin_kind", T.StringType()), T.StructField("capacity", T.LongType()), T.StructField("item", ident_type), T.StructField("piece", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("container", T.StringType())])
    packed = last.groupBy("bin_kind", "shard").applyInPandas(_pack, schema)
    return full.unionByName(packed).withColumnRenamed("item", ident)


def fills(packed: DataFrame) -> DataFrame:
    """Each container's content: ``bin_kind``, ``container``, ``capacity``, ``used``, ``pieces`` and ``fill`` (0 to 1)."""
    out = packed.groupBy("bin_kind", "container").agg(F.first("capacity").alias("capacity"), F.sum("size").alias("used"), F.count("*").alias("pieces"))
    return out.withColumn("fill", F.round(F.col("used") / F.col("capacity"), 6))
