"""Keywords and term graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions import lexicons
from colloq.operators import graph, keywords
from colloq.plans.sql import sql_list
from colloq.session import table
from colloq.sources.documents import envelope, parse_artifacts


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "utterances").select("session_id", "utt_id", "utt_index", "text").distinct()


def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keywords(_utterances(spark, sf_dir), ["session_id"], "text", 15)


def keywords_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keywords(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), ["doc_id"], "text", 15)


def terms_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.terms(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), ["doc_id"], "text", 20)


def running_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each keyword of an utterance has been met in its session so far; only counts per utterance and word
    go through the window, which is partitioned by session and word."""
    counts = keywords.keyword_counts(_utterances(spark, sf_dir), ["session_id", "utt_index"], "text")
    so_far = F.sum("n").over(W.partitionBy("session_id", "word").orderBy("utt_index"))
    return counts.select("session_id", "utt_index", "word", so_far.alias("n_so_far"))


def compound_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as tokens: those of kanji or katakana count as nouns."""
    words = table(spark, sf_dir, "words").filter("text IS NOT NULL").distinct()
    noun = F.col("text").rlike(r"^[一-鿿々ァ-ヺー]+$")
    tokens = words.select("file_id", "word_ord", F.col("text").alias("surface"), F.when(noun, F.lit("名詞,一般")).otherwise(F.lit("助詞,格助詞")).alias("part_of_speech"), F.lit("*").alias("base_form"))
    return keywords.compound_terms(tokens, ["file_id"], "word_ord", 20).withColumn("score", F.round("score", 6))


def keyword_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords written as JSON artifacts and read back through the loader's checks."""
    top = keywords_topk(spark, sf_dir).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))), lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))).alias("k"))
    raw = top.select(F.col("session_id").alias("stem"), envelope(F.col("session_id"), keywords=F.col("k")).alias("value"))
    return parse_artifacts(raw, "keywords").select(F.col("stem").alias("session_id"), F.posexplode("keywords.keywords").alias("n", "k")).select("session_id", (F.col("n") + 1).alias("rank"), "k.word", "k.score")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered_terms(table(spark, sf_dir, "utterance_terms"), "session_id", "utt_ord", "term_ord", "word", "score")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(_numbered(spark, sf_dir))


def graph_decayed_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(_numbered(spark, sf_dir), decay=0.98)


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(_numbered(spark, sf_dir), least=2)


def graph_visible_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_nodes(graph_nodes(spark, sf_dir), 40, min_salience=2.0, min_frequency=2)


def graph_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_edges(graph.graph_edges(_numbered(spark, sf_dir)), graph_visible_topk(spark, sf_dir))


def graph_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_snapshots(_numbered(spark, sf_dir), max_nodes=40, decay=0.98, max_candidates=200)


def graph_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each session's words in a pool that is too small for many of them."""
    return graph.graph_pools(_numbered(spark, sf_dir), max_nodes=20, decay=0.98, max_candidates=30)


_U = "u AS (SELECT DISTINCT session_id, utt_id, utt_index, text FROM utterances)"
_D = "u AS (SELECT DISTINCT doc_id, text FROM documents)"


def _counts(keys: str) -> str:
    parts = [f"regexp_extract_all(text, '{p}')" for p in lexicons.KEYWORD_PATTERNS]
    stop = sql_list(lexicons.KEYWORD_STOPWORDS)
    return f"""w AS (SELECT {keys}, unnest(list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})) AS word FROM u WHERE text IS NOT NULL),
c AS (SELECT {keys}, word, count(*) AS n FROM w WHERE word NOT IN ({stop}) AND lower(word) NOT IN ({stop}) GROUP BY ALL),
s AS (SELECT *, round(n * (1.0::DOUBLE + 0.1::DOUBLE * least(length(word), 10)), 3) AS score FROM c)"""


def _top(keys: str, most: int) -> str:
    return f"k AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, word) AS INTEGER) AS rank FROM s), top AS (SELECT * FROM k WHERE rank <= {most})"


_NUMBERED = """r AS (SELECT DISTINCT session_id AS session, utt_ord AS utt, term_ord AS ord, word, coalesce(score, 1.0) AS score FROM utterance_terms WHERE word IS NOT NULL AND word <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY session, utt, word ORDER BY ord, score) AS k FROM r),
n AS (SELECT session, utt, CAST(dense_rank() OVER (PARTITION BY session ORDER BY utt) AS INTEGER) AS seq, ord, word, score FROM f WHERE k = 1)"""
_NODES = f"{_NUMBERED}, g AS (SELECT session, word, round(sum(score), 9) AS salience, count(*) AS frequency, max(seq) AS last_seen FROM n GROUP BY ALL)"
_EDGES = "e AS (SELECT x.session, x.word AS a, y.word AS b, count(*) AS weight FROM n x JOIN n y ON x.session = y.session AND x.utt = y.utt AND x.word < y.word GROUP BY ALL)"
_VISIBLE = f"{_NODES}, v AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY salience DESC, frequency DESC, last_seen DESC, word) AS INTEGER) AS rank FROM g WHERE salience >= 2.0 AND frequency >= 2) WHERE rank <= 40)"
_STOP_TERMS = sql_list(lexicons.TERM_STOPWORDS + lexicons.FILLERS)

QUERIES = {
    "keywords_topk": keywords_topk,
    "keywords_documents": keywords_documents,
    "terms_documents": terms_documents,
    "running_keywords": running_keywords,
    "compound_terms": compound_terms,
    "keyword_artifacts": keyword_artifacts,
    "graph_nodes": graph_nodes,
    "graph_decayed_salience": graph_decayed_salience,
    "cooccurrence_edges": cooccurrence_edges,
    "graph_visible_topk": graph_visible_topk,
    "graph_visible_edges": graph_visible_edges,
    "graph_evicted": graph_evicted,
    "graph_pool": graph_pool,
}
SQL = {
    "keywords_topk": f"WITH {_U}, {_counts('session_id')}, {_top('session_id', 15)} SELECT * FROM top",
    "keywords_documents": f"WITH {_D}, {_counts('doc_id')}, {_top('doc_id', 15)} SELECT * FROM top",
    "terms_documents": f"WITH {_D}, {_counts('doc_id')}, {_top('doc_id', 20)} SELECT * FROM top WHERE lower(word) NOT IN ({_STOP_TERMS})",
    "running_keywords": f"WITH {_U}, {_counts('session_id, utt_index')} SELECT session_id, utt_index, word, CAST(sum(n) OVER (PARTITION BY session_id, word ORDER BY utt_index) AS BIGINT) AS n_so_far FROM s",
    "compound_terms": f"""
WITH t AS (SELECT DISTINCT file_id, word_ord, text, regexp_matches(text, '^[一-鿿々ァ-ヺー]+$') AS noun FROM words WHERE text IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN noun THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY word_ord ROWS UNBOUNDED PRECEDING) AS run FROM t),
r AS (SELECT file_id, run, string_agg(text, '' ORDER BY word_ord) AS word, count(*) AS tokens FROM g WHERE noun GROUP BY ALL),
c AS (SELECT file_id, word, count(*) AS n, arg_max(tokens, run) AS tokens FROM r WHERE length(word) > 1 AND word NOT IN ({_STOP_TERMS}) GROUP BY ALL),
s AS (SELECT file_id, word, n * (1 + least(length(word), 12) * 0.08::DOUBLE) * CASE WHEN tokens >= 2 THEN 1.25::DOUBLE ELSE 1 END AS score FROM c),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY score DESC, word) AS INTEGER) AS rank FROM s)
SELECT file_id, word, round(score, 6) AS score, rank FROM k WHERE rank <= 20""",
    "keyword_artifacts": f"WITH {_U}, {_counts('session_id')}, {_top('session_id', 15)} SELECT session_id, rank, word, score FROM top",
    "graph_nodes": f"WITH {_NODES} SELECT * FROM g",
    "graph_decayed_salience": f"WITH {_NUMBERED}, l AS (SELECT session, max(seq) AS last FROM n GROUP BY ALL) SELECT session, word, round(sum(score * pow(0.98::DOUBLE, last - seq)), 9) AS salience, count(*) AS frequency, max(seq) AS last_seen FROM n JOIN l USING (session) GROUP BY ALL",
    "cooccurrence_edges": f"WITH {_NUMBERED}, {_EDGES} SELECT * FROM e WHERE weight >= 2",
    "graph_visible_topk": f"WITH {_VISIBLE} SELECT * FROM v",
    "graph_visible_edges": f"WITH {_VISIBLE}, {_EDGES} SELECT e.* FROM e SEMI JOIN v x ON x.session = e.session AND x.word = e.a SEMI JOIN v y ON y.session = e.session AND y.word = e.b",
    "graph_pool": f"""WITH RECURSIVE {_NUMBERED}, u AS (SELECT session, seq, map(list(word), list(score)) AS ts FROM n GROUP BY session, seq),
m AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(sal DOUBLE, last_seen BIGINT, w VARCHAR, f BIGINT)[]) AS pool FROM u
  UNION ALL
  SELECT session, step, CASE WHEN len(p) > 30 THEN list_sort(p)[len(p) - 29:] ELSE p END FROM
   (SELECT m.session, m.step + 1 AS step, list_concat(
     list_transform(pool, lambda x: CASE WHEN ts[x.w] IS NOT NULL THEN {{'sal': x.sal * 0.98::DOUBLE + ts[x.w], 'last_seen': m.step + 1, 'w': x.w, 'f': x.f + 1}} ELSE {{'sal': x.sal * 0.98::DOUBLE, 'last_seen': x.last_seen, 'w': x.w, 'f': x.f}} END),
     list_transform(list_filter(map_keys(ts), lambda y: NOT list_contains(list_transform(pool, lambda z: z.w), y)), lambda y: {{'sal': ts[y], 'last_seen': m.step + 1, 'w': y, 'f': CAST(1 AS BIGINT)}})) AS p
    FROM m JOIN u ON u.session = m.session AND u.seq = m.step + 1)),
z AS (SELECT session, unnest(pool) AS x FROM (SELECT session, arg_max(pool, step) AS pool FROM m GROUP BY session))
SELECT session, x.w AS word, round(x.sal, 6) AS salience, CAST(x.f AS INTEGER) AS frequency, CAST(x.last_seen AS INTEGER) AS last_seen FROM z""",
}
