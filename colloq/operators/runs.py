"""Runs of equal labels in ordered rows, without putting an entity's rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark_runs(df: DataFrame, keys: list[str], bucket: str, order: list[str], label: str) -> DataFrame:
    """Adds ``label_filled`` and ``run`` (a struct of the ``order`` columns of the run's first row) to each row.

    Rows of an entity ``keys`` are ordered by ``order``, which must be unique in an entity; ``bucket`` must not
    decrease along that order (a time range, say). A null label continues the label before it, in whatever bucket that
    is; rows before the first label of an entity have a null ``label_filled`` and ``run``. Windows cover one bucket of
    one entity; what runs on across buckets is carried by one row per bucket.
    """
    place = [*keys, bucket]
    here = W.partitionBy(*place).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.struct(*order)
    # Runs as they look within a bucket: the first of them may be the end of one that began before.
    rows = df.withColumn("__label", F.last(label, ignorenulls=True).over(upto))
    rows = rows.withColumn("__first", F.when(F.col("__label").isNotNull() & ~F.col("__label").eqNullSafe(F.lag("__label").over(here)), at))
    rows = rows.withColumn("__start", F.last("__first", ignorenulls=True).over(upto))
    one = rows.groupBy(*place).agg(F.max_by("__label", at).alias("__end"), F.min(F.when(F.col("__first").isNotNull(), F.struct(F.col("__first").alias("at"), F.col("__label").alias("label")))).alias("__head"), F.max("__first").alias("__tail"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier))
    one = one.withColumn("__goes_on", F.coalesce(F.col("__head.label") == F.col("__carried"), F.lit(False)))
    begun = F.when(~(F.col("__goes_on") & (F.col("__tail") == F.col("__head.at"))), F.col("__tail"))
    one = one.withColumn("__begun", begun).withColumn("__open", F.last("__begun", ignorenulls=True).over(earlier))
    one = one.select(*place, "__carried", "__goes_on", F.col("__head.at").alias("__head_at"), "__open")
    rows = rows.join(one, place)
    old = F.col("__start").isNull() | (F.col("__goes_on") & (F.col("__start") == F.col("__head_at")))
    rows = rows.withColumn("label_filled", F.coalesce("__label", "__carried")).withColumn("run", F.when(old, F.col("__open")).otherwise(F.col("__start")))
    return rows.drop("__label", "__first", "__start", "__carried", "__goes_on", "__head_at", "__open")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, *, width: int = 1000) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the entity's rows before this one by ``order`` (a whole number, unique
    in the entity). Windows cover ``width`` values of ``order``; what comes before them is one row for each such stretch."""
    place = [*keys, "__stretch"]
    rows = df.withColumn("__stretch", F.floor(F.col(order) / F.lit(width)))
    earlier = W.partitionBy(*keys).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*place).agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    here = W.partitionBy(*place).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(sums, place).withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(here), F.lit(0))).drop("__stretch", "__base")


def nth_free(asked: DataFrame, taken: DataFrame, keys: list[str], nth: str, number: str, name: str, *, first: int = 1) -> DataFrame:
    """Adds ``name``: the ``nth`` (from 1, unique in the entity) whole number from ``first`` on that isn't among the
    entity's ``taken`` ones (column ``number``).

    A taken number lies behind as many free ones as there are numbers before it that aren't taken; the answer is the
    plain count plus the taken numbers met on the way. Both are running totals, so no entity's numbers are collected.
    """
    used = running_total(taken.filter(F.col(number) >= first).select(*keys, number).distinct().withColumn("__one", F.lit(1)), keys, number, "__one", "__before")
    steps = used.groupBy(*keys, (2 * (F.col(number) - first - F.col("__before"))).cast("bigint").alias("__pos")).agg(F.count("*").alias("__met"))
    asks = asked.select(*keys, (2 * F.col(nth) - 1).cast("bigint").alias("__pos"), F.lit(0).cast("bigint").alias("__met"))
    met = running_total(steps.unionByName(asks), keys, "__pos", "__met", "__skip").filter("__pos % 2 <> 0")
    met = met.select(*keys, ((F.col("__pos") + 1) / 2).cast("bigint").alias(nth), "__skip")
    found = asked.withColumn(nth, F.col(nth).cast("bigint")).join(met, [*keys, nth])
    return found.withColumn(name, F.col(nth) + (first - 1) + F.col("__skip")).drop("__skip")
