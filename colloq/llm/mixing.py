"""Mixing sources to target shares.

The largest total is taken that every source can fill with its share of it, using none of its records more often than
allowed. A source is used in whole passes and one partial pass over its records in hash order, cut by prefix sums that
are found in two levels (bucket totals, then within a bucket), so no source is ever in one task. The order of the
result is proportionate-fair: a source's stream is cut into blocks, block ``j`` of a source with weight ``w`` is
released at ``floor(j / w)`` and due at ``ceil((j + 1) / w)``, and earliest-deadline-first gives each block its slot.
That schedule repeats after as many slots as the shares' common denominator, so one table of that many rows, however
long the mixture, gives every block its place.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.session import checkpoint


def pfair_schedule(weights: list[int]) -> list[int]:
    """Who gets each of ``sum(weights)`` slots; a source gets as many as its weight. At every slot each source has had
    less than one more or less than its share of the slots so far."""
    total = sum(weights)
    done = [0] * len(weights)
    ready: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = [(0, i) for i, w in enumerate(weights) if w]
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // weights[i]), i))
        _, i = heapq.heappop(ready)
        out.append(i)
        done[i] += 1
        if done[i] < weights[i]:
            heapq.heappush(waiting, (done[i] * total // weights[i], i))
    return out


def _integer_weights(shares: list[float], denominator: int) -> list[int]:
    """Whole weights that sum to ``denominator`` and are nearest to the shares (largest remainders), but at least 1 for
    each positive share, at the expense of the largest."""
    whole = sum(shares)
    exact = [Fraction(s).limit_denominator(10**9) / Fraction(whole).limit_denominator(10**9) * denominator for s in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: denominator - sum(out)]:
        out[i] += 1
    heap = [(-w, i) for i, w in enumerate(out) if w > 1]
    heapq.heapify(heap)
    for i, share in enumerate(shares):
        if share > 0 and out[i] == 0:
            w, most = heapq.heappop(heap)
            out[i], out[most] = 1, out[most] - 1
            if out[most] > 1:
                heapq.heappush(heap, (w + 1, most))
    return out


def normal_source(column: str):
    """A source's name without differences of case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^[\s　 ]+|[\s　 ]+$", "")), r"[\s　 \-_]+", "_")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket's records, in order, each that still fits into the room."""
    pdf = pdf.sort_values(["order", "item"], kind="stable")
    room, at, picked, starts = int(pdf["room"].iloc[0]), int(pdf["base"].iloc[0]), [], []
    for size in pdf["size"].tolist():
        fits = size <= room
        picked.append(int(fits))
        starts.append(at)
        if fits:
            room, at = room - size, at + size
    return pdf.assign(partial=pd.Series(picked, index=pdf.index, dtype="int32"), partial_start=starts)[["item", "source", "size", "start", "passes", "available", "partial", "partial_start"]]


TARGETS = "source string, share double, uses long"


class Mixture:
    """A mixture of ``records`` (distinct ``ident``, ``source``, positive integer ``size``) to ``targets``.

    ``targets``: rows (source, share, most uses of a record), as a table or a list; of several rows of a source that
    with the largest share counts, and rows without a source or a positive share and number of uses are left out.
    Records whose source has no target, with a null field or without size are left out. A target source without records
    gets nothing, and the rest keep their proportions. ``bucket_records``: how many records a bucket of the prefix sums
    holds; ``most_buckets`` of them at most per source. ``block``: the size of a block of the schedule.
    """

    def __init__(self, records: DataFrame, ident: str, source: str, size: str, targets: DataFrame | list[tuple[str, float, int]], *, block: int = 8192, bucket_records: int = 2000, most_buckets: int = 65_536) -> None:
        self.spark, self.ident, self.block = records.sparkSession, ident, block
        wanted = targets if isinstance(targets, DataFrame) else self.spark.createDataFrame([(s, None if w is None else float(w), r) for s, w, r in targets], TARGETS)
        wanted = wanted.toDF("source", "share", "uses").filter("source IS NOT NULL AND share > 0 AND share < double('inf') AND uses > 0")
        self.targets = wanted.groupBy("source").agg(F.max(F.struct("share", F.col("uses").cast("long").alias("uses"))).alias("t")).select("source", "t.*")
        rows = records.select(F.col(ident).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
        rows = checkpoint(rows.filter(F.col("item").isNotNull() & (F.col("size") > 0)).join(self.targets.select("source"), "source"))
        stats = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("n")).join(self.targets, "source"))
        sums = stats.agg(F.sum("share").alias("whole"), F.sum("n").alias("n")).first()
        whole, count = sums.whole or 1.0, sums.n or 0
        total = stats.agg(F.floor(F.min(F.col("available") * F.col("uses") * F.lit(whole) / F.col("share")))).first()[0] or 0
        quota = F.least(F.floor(F.col("share") / F.lit(whole) * F.lit(total) + F.lit(0.5)), F.col("available") * F.col("uses")).cast("long")
        self.plan = stats.withColumn("quota", quota).select("source", "share", "available", "quota", F.floor(F.col("quota") / F.col("available")).alias("passes"), (F.col("quota") % F.col("available")).alias("rest"))
        buckets = min(most_buckets, max(1, -(-count // bucket_records)))
        order = F.xxhash64("item", F.lit("mix"))
        rows = rows.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 40) % F.lit(2**24) * F.lit(buckets) / F.lit(2**24))
        rows = rows.withColumn("bucket", F.floor("bucket"))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
        before = F.sum("s").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        sums = sums.select("source", "bucket", "s", F.coalesce(before, F.lit(0)).alias("base"))  # at most most_buckets rows a source
        inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("order", "item").rowsBetween(W.unboundedPreceding, -1))
        rows = rows.join(sums, ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(inside, F.lit(0)))
        rows = rows.join(self.plan.select("source", "passes", "rest", "available"), "source")
        # The partial pass takes whole buckets, and of the one in which it ends what fits.
        columns = ["item", "source", "size", "start", "passes", "available"]
        last = (F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("s"))
        whole_buckets = rows.filter(~last).select(*columns, (F.col("base") + F.col("s") <= F.col("rest")).cast("int").alias("partial"), F.col("start").alias("partial_start"))
        kind = rows.schema["item"].dataType.simpleString()
        ends = rows.filter(last).select(*columns, "order", (F.col("rest") - F.col("base")).alias("room"), "base")
        ends = ends.groupBy("source").applyInPandas(_fill, f"item {kind}, source string, size long, start long, passes long, available long, partial int, partial_start long")
        both = whole_buckets.unionByName(ends)
        self.chosen = both.withColumn("repeats", (F.col("passes") + F.col("partial")).cast("int")).filter("repeats > 0")

    def schedule(self, most_slots: int = 1_000_000) -> tuple[DataFrame, int]:
        """The slots (``source``, ``nth``, ``place``, ``per_round``) of one round, and how many slots a round has.

        A round has as many slots as the common denominator of the shares, if that is at most ``most_slots``; the
        mixture then never strays a block from its shares. Else the weights are rounded: to the number of blocks of the
        whole mixture, so that a source strays less than two, or, of longer ones, to ``most_slots``, and what it strays
        grows with each round by less than half a block. One row a source and one a slot are held by the driver.
        """
        live = self.plan.select("source", "share", "quota").filter("quota > 0").orderBy("source").collect()
        if not live:
            return self.spark.createDataFrame([], "source string, nth long, place long, per_round long"), 1
        shares = [Fraction(repr(r.share)) for r in live]
        exact = [x / sum(shares) for x in shares]
        slots = math.lcm(*(x.denominator for x in exact))
        if slots <= most_slots:
            weights = [int(x * slots) for x in exact]
        else:
            blocks = sum(-(-r.quota // self.block) for r in live)
            slots = max(len(live), min(most_slots, blocks))
            weights = _integer_weights([r.share for r in live], slots)
        nth, rows = [0] * len(live), []
        for place, i in enumerate(pfair_schedule(weights)):
            rows.append((live[i].source, nth[i], place, weights[i]))
            nth[i] += 1
        return self.spark.createDataFrame(pd.DataFrame(rows, columns=["source", "nth", "place", "per_round"])), slots

    def _placed(self, uses: DataFrame) -> DataFrame:
        """``uses`` (with ``use_no``) with the ``block`` of its source in which each begins, and its ``slot``."""
        table, slots = self.schedule()
        begins = F.when(F.col("use_no") < F.col("passes"), F.col("start")).otherwise(F.col("partial_start")) + F.col("available") * F.col("use_no")
        uses = uses.withColumn("block", F.floor(begins / F.lit(self.block)))
        uses = uses.join(table.select("source", "per_round").distinct(), "source")
        uses = uses.withColumn("nth", F.col("block") % F.col("per_round")).join(table.select("source", "nth", "place"), ["source", "nth"])
        return uses.withColumn("slot", F.floor(F.col("block") / F.col("per_round")) * F.lit(slots) + F.col("place"))

    def records(self) -> DataFrame:
        """Chosen records: ``ident``, ``source``, ``size``, ``repeats`` (how often it is used) and ``first_slot``, the
        slot of the schedule in which it is first used."""
        return self._placed(self.chosen.withColumn("use_no", F.lit(0))).select(F.col("item").alias(self.ident), "source", "size", "repeats", F.col("slot").alias("first_slot"))

    def shares(self) -> DataFrame:
        """Of each target source: ``target_share``, ``actual_share``, ``used`` (size with repeats), ``available``,
        ``records`` and ``uses``."""
        got = self.chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used"), F.count("*").alias("records"), F.sum("repeats").alias("uses"))
        want = self.targets.select("source", F.col("share").alias("target_share")).join(self.plan.select("source", "available"), "source", "left")
        out = want.join(got, "source", "left").fillna(0, ["available", "used", "records", "uses"])
        total = F.sum("used").over(W.partitionBy(F.lit(1)))  # one row a target source
        return out.select("source", "target_share", F.round(F.when(total > 0, F.col("used") / total).otherwise(0.0), 6).alias("actual_share"), "used", "available", "records", "uses")

    def order(self) -> DataFrame:
        """Every use of a record with its place: ``slot``, ``source``, ``block`` (of the source), ``ident``, ``use_no``
        and ``size``. A record belongs to the block in which it begins."""
        uses = self.chosen.select("*", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("use_no"))
        return self._placed(uses).select("slot", "source", "block", F.col("item").alias(self.ident), "use_no", "size")
