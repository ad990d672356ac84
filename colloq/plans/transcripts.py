"""From words and turns to transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.operators import align
from colloq.plans.sql import finite, sql_trim
from colloq.session import table

LEAST_TURN = 0.3  # fixed value: shorter turns take part in nothing


def words_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.clean_words(table(spark, sf_dir, "words").distinct())


def turns_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.clean_turns(table(spark, sf_dir, "turns").distinct(), LEAST_TURN).select("turn_id", "file_id", "speaker", "start_s", "end_s")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.assign_speakers(table(spark, sf_dir, "words"), table(spark, sf_dir, "turns"), least_seconds=LEAST_TURN)


def align_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("file_id", "word_ord", "text", "start_s", "end_s", "speaker")


def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.speaker_segments(_assigned(spark, sf_dir))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.transcript_lines(align.speaker_segments(_assigned(spark, sf_dir)))


def asr_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words, packed 50 at a time into raw recogniser output and flattened again."""
    words = table(spark, sf_dir, "words").distinct()
    segment = F.struct(F.lit("").alias("text"), F.array_sort(F.collect_list(F.struct("word_ord", F.struct(F.col("text").alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end")).alias("w")))).alias("ws"))
    packed = words.groupBy("file_id", F.floor(F.col("word_ord") / 50).alias("part")).agg(segment.alias("s"))
    payload = F.to_json(F.struct(F.array(F.struct("s.text", F.transform("s.ws", lambda x: x["w"]).alias("words"))).alias("segments")))
    flat = align.flatten_recognition(packed.select("file_id", "part", payload.alias("payload")), ["file_id", "part"], "payload")
    return flat.select("file_id", (F.col("part") * 50 + F.col("ord")).alias("word_ord"), "text", "start_s", "end_s")


_W = f"w AS (SELECT DISTINCT file_id, word_ord, {sql_trim('text')} AS text, start_s, greatest(start_s, end_s) AS end_s FROM words WHERE {finite('start_s', 'end_s')} AND length({sql_trim('text')}) > 0)"
_T = f"t AS (SELECT DISTINCT file_id, start_s AS ts, end_s AS te, speaker FROM turns WHERE {finite('start_s', 'end_s')} AND end_s - start_s >= {LEAST_TURN} AND speaker IS NOT NULL)"
_ALIGN = f"""{_W}, {_T},
m AS (SELECT w.*, coalesce(t.speaker, 'SPEAKER_00') AS speaker,
        row_number() OVER (PARTITION BY w.file_id, word_ord ORDER BY
          greatest(0.0, least(end_s, te) - greatest(start_s, ts)) DESC, greatest(0.0, ts - end_s, start_s - te), ts, te, t.speaker) AS k
      FROM w LEFT JOIN t ON t.file_id = w.file_id),
a AS (SELECT file_id, word_ord, text, start_s, end_s, speaker FROM m WHERE k = 1)"""
_SEGMENTS = f"""{_ALIGN},
p AS (SELECT *, lag(speaker) OVER o AS prev FROM a WINDOW o AS (PARTITION BY file_id ORDER BY start_s, end_s, word_ord)),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_s, end_s, word_ord) AS run FROM p),
s AS (SELECT file_id, min(speaker) AS speaker, min(start_s) AS start_s, arg_max(end_s, (start_s, end_s, word_ord)) AS end_s, count(*) AS words,
        string_agg(text, '' ORDER BY start_s, end_s, word_ord) AS text FROM r GROUP BY file_id, run)"""


def _stamp(c: str) -> str:
    ms = f"CAST(round_even({c} * 1000, 0) AS BIGINT)"
    part = lambda unit, size: f"((CAST(floor({ms} / {unit}) AS BIGINT) % {size}) + {size}) % {size}"
    hours = f"CAST(floor({ms} / 3600000) AS BIGINT)"
    short = f"printf('%02d:%02d.%03d', {part(60000, 60)}, {part(1000, 60)}, {part(1, 1000)})"
    return f"CASE WHEN {hours} <> 0 THEN printf('%02d:', {hours}) || {short} ELSE {short} END"


QUERIES = {"words_clean": words_clean, "turns_clean": turns_clean, "align_best_overlap": align_best_overlap, "speaker_segments": speaker_segments, "transcript_lines": transcript_lines, "asr_flatten": asr_flatten}
SQL = {
    "words_clean": f"WITH {_W} SELECT * FROM w",
    "turns_clean": f"SELECT DISTINCT turn_id, file_id, speaker, start_s, end_s FROM turns WHERE {finite('start_s', 'end_s')} AND end_s - start_s >= {LEAST_TURN}",
    "align_best_overlap": f"WITH {_ALIGN} SELECT * FROM a",
    "speaker_segments": f"WITH {_SEGMENTS} SELECT * FROM s",
    "transcript_lines": f"WITH {_SEGMENTS} SELECT file_id, start_s, '[' || {_stamp('start_s')} || ' - ' || {_stamp('end_s')} || '] ' || speaker || ': ' || text AS line FROM s",
    "asr_flatten": "SELECT DISTINCT file_id, word_ord, coalesce(text, '') AS text, coalesce(start_s, CAST('nan' AS DOUBLE)) AS start_s, coalesce(end_s, CAST('nan' AS DOUBLE)) AS end_s FROM words",
}
