"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions.text import is_blank, is_finite, to_ms
from colloq.llm.cooccurrence import associated_pairs, basket_items
from colloq.llm.encoding import repair_texts
from colloq.llm.mixing import Mixture, normal_source
from colloq.llm.nearest import nearest_in_time
from colloq.llm.packing import fills, pack
from colloq.llm.personal import TYPES, personal_information
from colloq.llm.sentences import fit_sentence_model, split_sentences
from colloq.llm.tokens import count_tokens
from colloq.llm.turns import speaker_turns
from colloq.plans.intervals import USABLE_TURNS_SQL, usable_turns
from colloq.plans.sql import sql_trim
from colloq.session import checkpoint, table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = table(spark, sf_dir, "statements").select("stmt_no", F.explode(F.array_distinct("terms")).alias("term"))
    terms = table(spark, sf_dir, "utterance_terms")
    return basket_items(statements, "statement", ["stmt_no"], "term").unionByName(basket_items(terms, "utterance", ["session_id", "utt_ord"], "word"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = associated_pairs(_items(spark, sf_dir), min_count=5, min_lift=8)
    return found.select(F.col("kind").alias("record_kind"), F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associated_pairs(_items(spark, sf_dir), min_count=5, min_lift=8)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair, however rare, with its counts."""
    return associated_pairs(_items(spark, sf_dir), min_count=1, min_lift=0).select("kind", "item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the same session: baskets of up to hundreds of items, most of them split into chunks."""
    terms = table(spark, sf_dir, "utterance_terms")
    found = associated_pairs(basket_items(terms, "session", ["session_id"], "word"), min_count=3, min_lift=2)
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "words").filter(is_finite("start_s") & is_finite("end_s") & ~is_blank("text"))
    words = words.select("file_id", "word_ord", to_ms("start_s").alias("a"), to_ms(F.greatest("start_s", "end_s")).alias("b"))
    turns = usable_turns(table(spark, sf_dir, "turns")).select("turn_id", "file_id", "start_ms")
    return nearest_in_time(turns, words, "file_id", F.col("start_ms"), [F.col("a"), F.col("b")], F.col("a"), F.col("word_ord"), tolerance=250)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("turn_id", "file_id", F.col("point_id").alias("word_ord")).distinct()


def _secret(spark: SparkSession) -> bytes:
    """The key of pseudonyms: the session's ``spark.colloq.pseudonymKey``; without it one made for this query and kept
    nowhere, so that nobody can undo them and no other query's pseudonyms are alike."""
    given = spark.conf.get("spark.colloq.pseudonymKey", None)
    return given.encode() if given else secrets.token_bytes(32)


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "segments").select(F.lit("segments").alias("src"), F.col("segment_id").alias("rec_id"), "text")
    utterances = table(spark, sf_dir, "utterances").select(F.lit("utterances").alias("src"), F.col("utt_id").alias("rec_id"), "text")
    return personal_information(segments.unionByName(utterances), ["src", "rec_id"], "text", table(spark, sf_dir, "roster"), key=_secret(spark), dates=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p4_redacted(spark, sf_dir).select("src", "rec_id", F.explode("mentions").alias("m")).filter(F.col("m.pii_type").isin(*TYPES))
    return found.select("src", "rec_id", "m.pii_type", "m.start_char", "m.end_char").distinct()


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    utterances = table(spark, sf_dir, "utterances").select(F.lit("utterances").alias("src"), F.col("utt_id").alias("rec_id"), "text")
    statements = table(spark, sf_dir, "statements").select(F.lit("statements").alias("src"), F.col("stmt_no").alias("rec_id"), "text")
    texts = utterances.unionByName(statements)
    return split_sentences(texts, ["src", "rec_id"], "text", fit_sentence_model(texts, "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_sentences(spark, sf_dir).select("src", "rec_id", "start_char", "end_char").distinct()


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "segments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).select("file_id", "speaker", F.col("first_id").alias("first_segment_id"), F.col("last_id").alias("last_segment_id")).distinct()


def _kinds(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """One row a kind, and each kind packs all documents once: the list is as short as the result allows."""
    return [(r.bin_kind, r.capacity_tokens) for r in table(spark, sf_dir, "bin_sizes").distinct().collect()]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens", _kinds(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(p7_containers(spark, sf_dir))


def _characters(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their size in characters, which SQL can count too."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").groupBy("doc_id", *columns).agg(F.max(size).alias("size"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any right packing, of all documents by characters: nothing is lost or doubled, only what is larger
    than a container is cut, none is overfull, and at most one container of a shard is filled to half or less."""
    packed = checkpoint(pack(_characters(spark, sf_dir), "doc_id", "size", _kinds(spark, sf_dir)))
    pieces = packed.groupBy("bin_kind", "capacity", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.countDistinct("piece").alias("d"))
    whole = pieces.groupBy("bin_kind", "capacity").agg(F.count("*").alias("documents"), F.sum("n").alias("pieces"), F.sum("size").alias("used"), F.sum(F.when(F.col("n") != F.col("d"), 1).otherwise(0)).alias("doubled"), F.sum(F.when((F.col("n") > 1) & (F.col("size") <= F.col("capacity")), 1).otherwise(0)).alias("cut_in_vain"))
    shard = F.regexp_extract("container", r"^(s[0-9]+)\.", 1)
    each = fills(packed).withColumn("shard", shard).groupBy("bin_kind", "shard").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("overfull"), F.sum((2 * F.col("used") <= F.col("capacity")).cast("long")).alias("half_empty"))
    return whole.join(each.groupBy("bin_kind").agg(F.sum("overfull").alias("overfull"), (F.max("half_empty") <= 1).alias("tight")), "bin_kind")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_targets").select("source", "target_share", "max_repeats")


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    documents = table(spark, sf_dir, "documents").withColumn("source_name", normal_source("source"))
    sized = count_tokens(documents.withColumn("k", F.struct("doc_id", "source_name")), "k", "text").select("k.doc_id", "k.source_name", "tokens")
    return Mixture(sized, "doc_id", "source_name", "tokens", _targets(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).records()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).order()


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any right mixture, of all documents by characters: each source's quota is met to less than its
    largest document and no document is used too often, and in the order every use stands once and each source, after
    any number of slots, has had less than a block more or less than its share of them."""
    documents = _characters(spark, sf_dir, "source").withColumn("source", normal_source("source"))
    mix = Mixture(documents, "doc_id", "source", "size", _targets(spark, sf_dir))
    chosen, order = checkpoint(mix.records()), checkpoint(mix.order())
    per = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"), F.sum("repeats").alias("uses"), F.max("size").alias("largest"))
    largest = documents.groupBy("source").agg(F.max("size").alias("largest_at_all"))
    whole = mix.plan.agg(F.sum("share")).first()[0] or 1.0
    each = order.groupBy("source", "block", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(mix.plan.select("source", "share"), "source")
    share = F.col("share") / F.lit(whole)
    stray = F.greatest(F.abs(F.col("block") + 1 - share * (F.col("slot") + 1)), F.abs(F.col("block") - share * F.col("slot")))
    seen = each.groupBy("source").agg(F.sum("n").alias("placed"), F.sum("size").alias("placed_size"), (F.max(stray) < 1.000001).alias("fair"))
    out = mix.plan.join(per, "source").join(largest, "source").join(seen, "source").join(mix.targets.select("source", "uses").withColumnRenamed("uses", "allowed"), "source")
    met = (F.col("used") <= F.col("quota")) & (F.col("quota") - F.col("used") < F.col("largest_at_all"))
    return out.select("source", "available", "quota", met.alias("quota_met"), (F.col("most") <= F.col("allowed")).alias("within_repeats"), ((F.col("placed") == F.col("uses")) & (F.col("placed_size") == F.col("used"))).alias("each_use_once"), "fair")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repaired(spark, sf_dir).select("doc_id").distinct()


# NFKC of the forms that terms come in, in SQL: full-width ASCII, the ideographic space and half-width kana, whose sound
# marks then join the kana before them.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000" + "".join(chr(0xFF61 + i) for i in range(63))
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + " " + "".join(unicodedata.normalize("NFKC", chr(0xFF61 + i)) for i in range(63))


def _sql_term(column: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"lower({sql_trim(f'nfc_normalize(translate({column}, {quoted(_WIDE)}, {quoted(_PLAIN)}))')})"


_ITEMS_SQL = f"""i0 AS (SELECT 'statement' AS kind, CAST(stmt_no AS VARCHAR) AS basket, unnest(terms) AS term FROM statements
  UNION ALL SELECT 'utterance', session_id || chr(31) || CAST(utt_ord AS VARCHAR), word FROM utterance_terms),
i AS (SELECT DISTINCT kind, basket, {_sql_term('term')} AS item FROM i0 WHERE term IS NOT NULL AND length({_sql_term('term')}) > 0)"""
_PAIRS_SQL = """t AS (SELECT kind, count(DISTINCT basket) AS n FROM i GROUP BY kind), c AS (SELECT kind, item, count(*) AS k FROM i GROUP BY ALL),
p AS (SELECT x.kind, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM i x JOIN i y ON x.kind = y.kind AND x.basket = y.basket AND x.item < y.item GROUP BY ALL),
s AS (SELECT p.kind, item_a, item_b, n_ab, a.k AS n_a, b.k AS n_b, n FROM p JOIN t USING (kind) JOIN c a ON a.kind = p.kind AND a.item = item_a JOIN c b ON b.kind = p.kind AND b.item = item_b)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_counts": p1_counts,
    "p1_sessions": p1_sessions,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_sentences": p5_sentences,
    "p6_found": p6_found,
    "p6_turns": p6_turns,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_invariants": p7_invariants,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_order": p8_order,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}

SQL = {
    "p1_found": f"WITH {_ITEMS_SQL}, {_PAIRS_SQL} SELECT kind AS record_kind, item_a AS term_a, item_b AS term_b FROM s WHERE n_ab >= 5 AND n_ab * n >= 8 * n_a * n_b",
    "p1_scores": f"""WITH {_ITEMS_SQL}, {_PAIRS_SQL}, l AS (SELECT *, CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b) AS lift FROM s WHERE n_ab >= 5 AND n_ab * n >= 8 * n_a * n_b)
SELECT * REPLACE (round(lift, 6) AS lift), round(CASE WHEN n_ab < n THEN ln(lift) / -ln(CAST(n_ab AS DOUBLE) / n) ELSE 1.0 END, 6) AS npmi FROM l""",
    "p1_counts": f"WITH {_ITEMS_SQL}, {_PAIRS_SQL} SELECT * FROM s",
    "p1_sessions": f"""WITH i AS (SELECT DISTINCT 'session' AS kind, session_id AS basket, {_sql_term('word')} AS item FROM utterance_terms WHERE session_id IS NOT NULL AND length({_sql_term('word')}) > 0), {_PAIRS_SQL}
SELECT item_a, item_b, n_ab, n_a, n_b, n FROM s WHERE n_ab >= 3 AND n_ab * n >= 2 * n_a * n_b""",
    "p3_found": f"""
WITH t AS ({USABLE_TURNS_SQL}),
w AS (SELECT DISTINCT file_id, word_ord, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(greatest(start_s, end_s) * 1000) AS BIGINT) AS b
      FROM words WHERE isfinite(start_s) AND isfinite(end_s) AND length({sql_trim('text')}) > 0),
m AS (SELECT turn_id, t.file_id, word_ord, row_number() OVER (PARTITION BY turn_id ORDER BY least(abs(w.a - t.a), abs(w.b - t.a)), w.a, word_ord) AS k
      FROM t JOIN w ON w.file_id = t.file_id AND least(abs(w.a - t.a), abs(w.b - t.a)) <= 250)
SELECT turn_id, file_id, word_ord FROM m WHERE k = 1""",
    "p7_invariants": """
WITH d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS size FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT DISTINCT bin_kind, CAST(capacity_tokens AS BIGINT) AS capacity FROM bin_sizes WHERE capacity_tokens > 0)
SELECT bin_kind, capacity, count(*) AS documents, CAST(sum(greatest(1, (size + capacity - 1) // capacity)) AS BIGINT) AS pieces, CAST(sum(size) AS BIGINT) AS used,
  CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS cut_in_vain, CAST(0 AS BIGINT) AS overfull, true AS tight FROM d, k GROUP BY ALL""",
    "p8_invariants": r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(regexp_replace(source, '^[\s　 ]+|[\s　 ]+$', '', 'g')), '[\s　 \-_]+', '_', 'g') AS source, max(coalesce(length(text), 0)) AS size FROM documents GROUP BY doc_id, documents.source),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS available, any_value(target_share) AS share, any_value(max_repeats) AS uses FROM d JOIN (SELECT DISTINCT * FROM source_targets) t USING (source) WHERE size > 0 GROUP BY source),
t AS (SELECT sum(share) AS whole, floor(min(available * uses * (SELECT sum(share) FROM a) / share)) AS total FROM a)
SELECT source, available, CAST(least(floor(share / whole * total + 0.5), available * uses) AS BIGINT) AS quota, true AS quota_met, true AS within_repeats, true AS each_use_once, true AS fair FROM a, t""",
}
