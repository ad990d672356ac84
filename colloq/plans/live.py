"""Frames, live utterances and the processing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions.text import token_budget
from colloq.operators import changelog, segmenter
from colloq.session import table
from colloq.sources.documents import draft_lines, server_events


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames: a value of 100 counts as certain speech."""
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), number.cast("bigint").alias("frame_no"), (F.col("value") / 100).alias("probability"))


def vad_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenter.speech_islands(_frames(spark, sf_dir), threshold=0.25, silence=3, least=2)


def vad_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenter.segment_frames(_frames(spark, sf_dir), segmenter.SegmenterOptions(threshold=0.25, silence_ms=96, least_ms=64, longest_s=1.0, preroll_ms=64))


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = segmenter.chunk_spans(table(spark, sf_dir, "documents").select("doc_id", "n_chars").distinct(), ["doc_id"], "n_chars", 1000)
    return spans.withColumn("token_budget", token_budget((F.col("span_end") - F.col("span_start")) / 16.0))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").distinct()


def changelog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.latest(_jobs(spark, sf_dir), ["filename"], "version_no").select("filename", "version_no", "job_state", "segments_completed", "error_text")


def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs in the order in which they are listed. The list is one per installation: a row a recording."""
    rows = changelog_latest(spark, sf_dir).withColumn("state_rank", changelog.state_rank(F.col("job_state")))
    return rows.select("filename", "job_state", "state_rank", F.row_number().over(W.partitionBy("state_rank").orderBy("filename")).alias("place_in_state"))


def changelog_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.changes_after(_jobs(spark, sf_dir), "version_no", 50)
    data = F.to_json(F.struct("filename", "job_state"))
    return server_events(rows.select(F.lit("job").alias("event"), F.col("version_no").alias("id"), data.alias("data")))


def segments_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "segments").select("file_id", "segment_id").distinct()
    return changelog.running_count(rows, ["file_id"], "segment_id")


def history_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    outputs = jobs.filter("job_state = 'DONE'").select(F.concat(F.lit("/out/"), F.regexp_replace("filename", r"\.[^.]*$", ".txt")).alias("path")).distinct()
    names = jobs.select("filename", "file_id").distinct()
    sources = names.select(F.concat(F.lit("/done/"), "filename").alias("path")).unionByName(names.filter("file_id % 2 = 0").select(F.concat(F.lit("/done/"), F.regexp_replace("filename", r"\.[^.]*$", ".WAV")).alias("path"))).distinct()
    return changelog.history(outputs, sources, "path")


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of its own for each row of the log, among names that already look like such."""
    rows = table(spark, sf_dir, "jobs").distinct().select("version_no", "filename")
    numbered = rows.groupBy("filename").agg(F.max("version_no").alias("n")).select((F.col("n") + 1_000_000).alias("version_no"), F.regexp_replace("filename", r"(\.[^./]*)$", "_3$1").alias("filename"))
    return changelog.unique_names(rows.unionByName(numbered), "filename", "version_no")


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").select("session_id", "utt_id", "utt_index", "start_s", "text").distinct()
    return rows.filter(F.length("text") > 0)


def last_n_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.last_rows(_finals(spark, sf_dir).select("session_id", "utt_index", "utt_id"), ["session_id"], ["utt_index", "utt_id"], 100)


def draft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_lines(_finals(spark, sf_dir).select(F.col("session_id").alias("session"), F.col("start_s").alias("t0"), "text"))


_FRAMES = "f AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, value / 100 AS p FROM events)"
_JOBS = "j AS (SELECT DISTINCT * FROM jobs), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY version_no DESC) AS k FROM j) WHERE k = 1)"
_STEM = r"regexp_replace(regexp_extract({0}, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')"
_FINALS = "u AS (SELECT DISTINCT session_id, utt_id, utt_index, start_s, text FROM utterances WHERE length(text) > 0)"
_RANK = "CASE upper(job_state) WHEN 'PROCESSING' THEN 0 WHEN 'QUEUED' THEN 1 WHEN 'PENDING' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'DONE' THEN 3 ELSE 99 END"

QUERIES = {
    "vad_islands": vad_islands,
    "vad_state_machine": vad_state_machine,
    "chunk_spans": chunk_spans,
    "changelog_latest": changelog_latest,
    "job_order": job_order,
    "changelog_tail": changelog_tail,
    "segments_counter": segments_counter,
    "history_match": history_match,
    "unique_names": unique_names,
    "last_n_finals": last_n_finals,
    "draft_text": draft_text,
}
SQL = {
    "vad_islands": f"""WITH {_FRAMES}, n AS (SELECT session, max(frame_no) AS total FROM f GROUP BY ALL),
s AS (SELECT session, frame_no, lag(frame_no) OVER (PARTITION BY session ORDER BY frame_no) AS prev FROM f WHERE p >= 0.25),
u AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame_no - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY frame_no) AS u FROM s)
SELECT u.session, CAST(u AS BIGINT) AS utterance_id, min(frame_no) AS first_frame, least(max(frame_no) + 3, max(total)) AS close_frame, count(*) AS speech_frames,
  CASE WHEN count(*) < 2 THEN 'cancel' ELSE 'end' END AS kind FROM u JOIN n USING (session) GROUP BY u.session, u""",
    "vad_state_machine": f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT session, max(frame_no) AS total FROM f GROUP BY ALL),
m AS (SELECT session, CAST(0 AS BIGINT) AS n, false AS speaking, CAST(0 AS BIGINT) AS start, 0 AS length, 0 AS speech, 0 AS quiet, 0 AS pre, 1 AS uid, CAST(NULL AS VARCHAR) AS kind, 0 AS said, CAST(0 AS BIGINT) AS first FROM n
  UNION ALL
  SELECT session, n + 1, CASE WHEN closes THEN false ELSE speaking OR loud END, CASE WHEN opens THEN n - pre ELSE start END,
    CASE WHEN closes THEN 0 WHEN opens THEN pre + 1 WHEN speaking THEN length + 1 ELSE length END, CASE WHEN closes THEN 0 WHEN opens THEN 1 ELSE sp END, CASE WHEN closes OR opens THEN 0 ELSE qu END,
    CASE WHEN closes THEN 0 WHEN speaking OR opens THEN pre ELSE least(pre + 1, 2) END, CASE WHEN closes THEN uid + 1 ELSE uid END,
    CASE WHEN opens THEN 'start' WHEN closes AND sp < 2 THEN 'cancel' WHEN closes THEN 'end' END, uid, CASE WHEN opens THEN n - pre ELSE start END
  FROM (SELECT *, NOT speaking AND loud AS opens, speaking AND (qu >= 3 OR length + 1 >= 31) AS closes FROM
    (SELECT m.*, p >= 0.25 AS loud, CASE WHEN speaking AND p >= 0.25 THEN speech + 1 ELSE speech END AS sp, CASE WHEN NOT speaking THEN quiet WHEN p >= 0.25 THEN 0 ELSE quiet + 1 END AS qu
     FROM m JOIN f ON f.session = m.session AND f.frame_no = m.n + 1))),
e AS (SELECT session, kind, said, first, n, 0 AS late FROM m WHERE kind IS NOT NULL UNION ALL SELECT m.session, CASE WHEN speech < 2 THEN 'cancel' ELSE 'end' END, uid, start, m.n, 1 FROM m JOIN n ON n.session = m.session AND m.n = total WHERE speaking)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY n, late) AS INTEGER) AS seq, kind, said AS utterance_id, round(first * 0.032::DOUBLE, 2) AS t0, CASE WHEN kind <> 'start' THEN round(n * 0.032::DOUBLE, 2) END AS t1,
  first AS first_frame, n AS last_frame FROM e""",
    "chunk_spans": """WITH d AS (SELECT DISTINCT doc_id, n_chars FROM documents WHERE n_chars > 0), s AS (SELECT doc_id, n_chars, unnest(range(0, n_chars, 1000)) AS span_start FROM d)
SELECT doc_id, span_start, least(span_start + 1000, n_chars) AS span_end, CAST(greatest(1, ceil((least(span_start + 1000, n_chars) - span_start) / 16.0::DOUBLE * 13.0::DOUBLE)) AS INTEGER) AS token_budget FROM s""",
    "changelog_latest": f"WITH {_JOBS} SELECT filename, version_no, job_state, segments_completed, error_text FROM l",
    "job_order": f"WITH {_JOBS}, r AS (SELECT filename, job_state, {_RANK} AS state_rank FROM l) SELECT *, CAST(row_number() OVER (PARTITION BY state_rank ORDER BY filename) AS INTEGER) AS place_in_state FROM r",
    "changelog_tail": """WITH j AS (SELECT DISTINCT * FROM jobs WHERE version_no > 50) SELECT version_no AS id,
  'event: job' || chr(10) || 'id: ' || version_no || chr(10) || 'data: {"filename":"' || filename || '","job_state":"' || job_state || '"}' || chr(10) || chr(10) AS frame FROM j""",
    "segments_counter": "WITH s AS (SELECT DISTINCT file_id, segment_id FROM segments) SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY segment_id) AS INTEGER) AS completed FROM s",
    "history_match": f"""WITH j AS (SELECT DISTINCT * FROM jobs), o AS (SELECT DISTINCT '/out/' || regexp_replace(filename, '\\.[^.]*$', '.txt') AS path FROM j WHERE job_state = 'DONE'),
n AS (SELECT DISTINCT '/done/' || filename AS path FROM j UNION SELECT '/done/' || regexp_replace(filename, '\\.[^.]*$', '.WAV') FROM j WHERE file_id % 2 = 0),
r AS (SELECT path, {_STEM.format('path')} AS stem, list_position(['.mp3', '.wav', '.m4a'], lower(regexp_extract(path, '\\.[^./]*$'))) AS k FROM n),
b AS (SELECT stem, arg_min(path, (k, path)) AS source_path FROM r WHERE k > 0 GROUP BY stem)
SELECT stem, o.path AS output_path, source_path FROM o JOIN b ON b.stem = {_STEM.format('o.path')}""",
    "unique_names": r"""WITH j AS (SELECT DISTINCT version_no, filename FROM jobs),
g AS (SELECT * FROM j UNION ALL SELECT max(version_no) + 1000000, regexp_replace(filename, '(\.[^./]*)$', '_3\1') FROM j GROUP BY filename),
k AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY version_no) - 1 AS nth, regexp_replace(filename, '\.[^./]*$', '') AS stem, regexp_extract(filename, '\.[^./]*$') AS ext FROM g),
many AS (SELECT filename, any_value(stem) AS stem, any_value(ext) AS ext, unnest(generate_series(2, 2 + 2 * count(*))) AS n FROM k GROUP BY filename),
free AS (SELECT filename, n, row_number() OVER (PARTITION BY filename ORDER BY n) AS nth FROM many WHERE stem || '_' || n || ext NOT IN (SELECT filename FROM g))
SELECT version_no, k.filename, CASE WHEN k.nth = 0 THEN k.filename ELSE stem || '_' || n || ext END AS unique_name FROM k LEFT JOIN free ON free.filename = k.filename AND free.nth = k.nth""",
    "last_n_finals": f"WITH {_FINALS} SELECT session_id, utt_index, utt_id, CAST(k AS INTEGER) AS from_last FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY utt_index DESC, utt_id DESC) AS k FROM u) WHERE k <= 100",
    "draft_text": f"WITH {_FINALS}, d AS (SELECT session_id AS session, coalesce(start_s, 0.0) AS t0, text FROM u) SELECT session, t0, printf('[%02d:%02d] ', CAST(floor(t0) AS BIGINT) // 60, CAST(floor(t0) AS BIGINT) % 60) || text AS line FROM d",
}
