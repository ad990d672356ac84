"""From utterances to a checked structure of statements, relations and topics, with a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions.text import clamp01
from colloq.operators import discourse, keywords

# What an external extractor answers with for a session: one JSON object.
ANSWER = (
    "struct<statements: array<struct<id: string, utterance_index: int, speaker: string, text: string, terms: array<string>>>, "
    "relations: array<struct<id: string, source: string, target: string, type: string, confidence: double, marker: string, rule: string>>, "
    "topics: array<struct<id: string, label: string, statement_ids: array<string>>>>"
)


@dataclass
class Extraction:
    """Statements (``session``, ``stmt_pos``, ``id``, ``utterance_index``, ``speaker``, ``text``, ``terms``, ``topic_id``),
    relations (``session``, ``rel_pos``, ``id``, ``source``, ``target``, ``type``, ``confidence``, ``marker``, ``rule``) and
    topics (``session``, ``topic_ord``, ``id``, ``label``, ``statement_ids``)."""

    statements: DataFrame
    relations: DataFrame
    topics: DataFrame


def by_markers(utterances: DataFrame) -> Extraction:
    """The built-in extractor: sentences, connectives and markers; it names no topics."""
    st = discourse.split_statements(utterances, "session", "utterance_index").withColumns({"terms": F.expr("cast(array() as array<string>)"), "topic_id": F.lit(None).cast("string")})
    rel = discourse.marker_relations(st).withColumn("id", F.lit(""))
    topics = utterances.sparkSession.createDataFrame([], "session string, topic_ord int, id string, label string, statement_ids array<string>")
    return Extraction(st, rel, topics)


def parse_answers(answers: DataFrame, value: str = "answer") -> Extraction:
    """An extractor's answers (``session`` and a JSON text each) as an extraction. What is no such object, and entries
    without an id or a text, are skipped; a confidence is cut to 0..1."""
    rows = answers.select("session", F.from_json(value, ANSWER).alias("a")).filter("a IS NOT NULL")
    st = rows.select("session", F.posexplode("a.statements").alias("n", "s")).filter("s.id <> '' AND s.text IS NOT NULL")
    st = st.select("session", (F.col("n") + 1).cast("bigint").alias("stmt_pos"), "s.id", "s.utterance_index", "s.speaker", "s.text", F.coalesce("s.terms", F.expr("cast(array() as array<string>)")).alias("terms"), F.lit(None).cast("string").alias("topic_id"))
    rel = rows.select("session", F.posexplode("a.relations").alias("n", "r"))
    rel = rel.select("session", (F.col("n") + 1).cast("bigint").alias("rel_pos"), F.coalesce("r.id", F.lit("")).alias("id"), "r.source", "r.target", "r.type", clamp01(F.coalesce("r.confidence", F.lit(0.0))).alias("confidence"), "r.marker", "r.rule")
    topics = rows.select("session", F.posexplode("a.topics").alias("topic_ord", "t")).select("session", "topic_ord", "t.id", "t.label", "t.statement_ids")
    return Extraction(st, rel, topics)


_UTTERANCE = "struct<speaker: string, start: string, end: string, text: string>"


def coerce_utterances(df: DataFrame, payload: str) -> DataFrame:
    """Utterances of JSON arrays whose entries are texts or objects: ``session``, ``utterance_index`` (the place in the
    array), ``speaker``, ``start_s``, ``end_s``, ``text``. What an object lacks is empty or 0; texts that are no array
    give no utterance."""
    rows = df.select("session", F.posexplode(F.from_json(payload, "array<string>")).alias("utterance_index", "raw"))
    rows = rows.withColumn("o", F.when(F.col("raw").startswith("{"), F.from_json("raw", _UTTERANCE)))
    given = F.col("o").isNotNull()
    number = lambda c: F.coalesce(F.expr(f"try_cast(o.{c} AS DOUBLE)"), F.lit(0.0)).alias(f"{c}_s")
    text = F.when(given, F.coalesce("o.text", F.lit(""))).otherwise(F.coalesce("raw", F.lit("")))
    return rows.select("session", "utterance_index", F.coalesce("o.speaker", F.lit("")).alias("speaker"), number("start"), number("end"), text.alias("text"))


def structure_json(found: Extraction, flows: DataFrame | None = None, extractor: str = "markers") -> DataFrame:
    """``session`` and ``value``: the structure of each session as one JSON text, with ``kind``, ``statements``,
    ``relations`` (what speaks for them as ``evidence``), ``topics``, ``decision_flows`` and ``extractors``."""
    listed = lambda df, order, *fields: df.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"]).alias("v"))
    plain = ("id", "source", "target", "type", "confidence")

    def evident(x: Column) -> Column:
        evidence = F.map_filter(F.create_map(F.lit("marker"), x["marker"], F.lit("rule"), x["rule"]), lambda k, v: v.isNotNull())
        return F.struct(*[x[c].alias(c) for c in plain], evidence.alias("evidence"))

    text = F.coalesce("topic_id", F.lit("")).alias("topic_id")
    st = listed(found.statements, "stmt_pos", "id", "utterance_index", "speaker", "text", "terms", text).withColumnRenamed("v", "statements")
    rel = listed(found.relations, "rel_pos", *plain, "marker", "rule").select("session", F.transform("v", evident).alias("relations"))
    top = listed(found.topics, "topic_ord", "id", "label", F.lit("").alias("summary"), "statement_ids").withColumnRenamed("v", "topics")
    rows = st.join(rel, "session", "left").join(top, "session", "left")
    of = lambda df, c: F.coalesce(c, F.expr(f"cast(array() as {df.schema[c].dataType.simpleString()})")).alias(c)
    body = F.to_json(F.struct(F.lit("logical_structure").alias("kind"), "statements", of(rel, "relations"), of(top, "topics"), F.array(F.lit(extractor)).alias("extractors")))
    if flows is None:
        decided = F.lit("[]")
    else:
        from colloq.operators.flows import flows_json

        rows, decided = rows.join(flows_json(flows), "session", "left"), F.coalesce("decision_flows", F.lit("[]"))
    return rows.select("session", F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"decision_flows":'), decided, F.lit("}")).alias("value"))


def prompt_line() -> Column:
    """``{index} [{speaker}] {text}`` of an utterance, as an extractor is given it."""
    return F.format_string("%d [%s] %s", F.col("utterance_index"), F.coalesce("speaker", F.lit("")), F.coalesce("text", F.lit("")))


def build_structure(utterances: DataFrame, extractor: Callable[[DataFrame], Extraction] | None = None, *, largest: int = 12, term_extractor: Callable[[DataFrame, list[str], str, int], DataFrame] = keywords.terms) -> Extraction:
    """The structure of each session of ``utterances`` (``session``, ``utterance_index``, ``speaker``, ``text``).

    Sessions the extractor gives no statement for fall back to :func:`by_markers`. Then: unknown references go, sessions
    without topics get theirs by clustering terms, cycles are broken and relations get ids. ``term_extractor`` gives the
    terms of texts, as :func:`colloq.operators.keywords.terms` does: the keys, ``word`` and ``rank``.
    """
    base = by_markers(utterances)
    if extractor is not None:
        own = extractor(utterances)
        answered = own.statements.select("session").distinct()
        rest = lambda df: df.join(answered, "session", "left_anti")
        base = Extraction(own.statements.unionByName(rest(base.statements)), own.relations.unionByName(rest(base.relations)), own.topics)
    st = discourse.valid_statements(base.statements, utterances, "session", "utterance_index")
    rel = discourse.valid_relations(base.relations, st)
    listed = base.topics.join(discourse.valid_topics(base.topics, st).select("session", "id"), ["session", "id"], "left_semi")
    found = term_extractor(st.filter(F.size("terms") == 0), ["session", "id"], "text", 6)
    bare = st.join(listed.select("session").distinct(), "session", "left_anti")
    termed = discourse.statement_terms(bare, found)
    clusters = discourse.term_clusters(discourse.term_weights(termed), discourse.term_edges(termed), largest=largest)
    named = discourse.topics(clusters)
    given = discourse.assign_topics(termed, clusters, named)
    clustered = termed.drop("topic_id").join(given, ["session", "id"], "left")
    members = discourse.topic_members(given, named, termed)
    number = F.row_number().over(W.partitionBy("session").orderBy(F.length("topic_id"), "topic_id"))
    members = members.select("session", number.alias("topic_ord"), F.col("topic_id").alias("id"), "label", "statement_ids")
    mirrored = discourse.topic_of_statements(st.join(listed.select("session").distinct(), "session", "left_semi"), listed)
    columns = ["session", "stmt_pos", "id", "utterance_index", "speaker", "text", "terms", "topic_id"]
    kept = discourse.relation_ids(discourse.break_cycles(rel)).drop("id").withColumnRenamed("rel_id", "id")
    return Extraction(clustered.select(*columns).unionByName(mirrored.select(*columns)), kept, members.unionByName(listed.select(*members.columns)))
