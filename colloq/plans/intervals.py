"""Speaking periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions.text import is_finite, strip, to_ms
from colloq.operators.intervals import merge_intervals
from colloq.plans.sql import sql_trim
from colloq.session import table


def usable_turns(turns: DataFrame) -> DataFrame:
    """Turns with a non-blank speaker, finite times and, in ms, the end after the start; times as ``start_ms``, ``end_ms``."""
    t = turns.filter(is_finite("start_s") & is_finite("end_s")).select("turn_id", "file_id", F.upper(strip("speaker")).alias("speaker"), to_ms("start_s").alias("start_ms"), to_ms("end_s").alias("end_ms"))
    return t.filter((F.length("speaker") > 0) & (F.col("end_ms") > F.col("start_ms")))


def speaking_periods(turns: DataFrame) -> DataFrame:
    """Every period and gap of each speaker in each recording, with the number of turns in it."""
    return merge_intervals(usable_turns(turns), ["file_id", "speaker"], F.col("start_ms"), F.col("end_ms"), identity=F.col("turn_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = speaking_periods(table(spark, sf_dir, "turns")).filter("kind = 'gap' OR n >= 2")
    return found.select("file_id", "speaker", "kind", F.col("from_t").alias("from_ms"), F.col("to_t").alias("to_ms"))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaking_periods(table(spark, sf_dir, "turns"))


USABLE_TURNS_SQL = f"""
  SELECT DISTINCT turn_id, file_id, upper({sql_trim('speaker')}) AS speaker,
         CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b
  FROM turns WHERE isfinite(start_s) AND isfinite(end_s) AND length({sql_trim('speaker')}) > 0
    AND round(end_s * 1000) > round(start_s * 1000)"""

_PERIODS_SQL = f"""
WITH t AS ({USABLE_TURNS_SQL}),
m AS (SELECT *, max(b) OVER (PARTITION BY file_id, speaker ORDER BY a, b, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, speaker ORDER BY a, b, turn_id) AS k FROM m),
p AS (SELECT file_id, speaker, k, min(a) AS from_t, max(b) AS to_t, CAST(count(DISTINCT turn_id) AS BIGINT) AS n FROM i GROUP BY ALL),
g AS (SELECT file_id, speaker, lag(to_t) OVER (PARTITION BY file_id, speaker ORDER BY k) AS from_t, from_t AS to_t FROM p),
r AS (SELECT file_id, speaker, 'period' AS kind, from_t, to_t, n FROM p
      UNION ALL SELECT file_id, speaker, 'gap', from_t, to_t, CAST(0 AS BIGINT) FROM g WHERE from_t IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}
SQL = {
    "p2_found": _PERIODS_SQL + "SELECT file_id, speaker, kind, from_t AS from_ms, to_t AS to_ms FROM r WHERE kind = 'gap' OR n >= 2",
    "p2_periods": _PERIODS_SQL + "SELECT * FROM r",
}
