"""Decision flows of a topic (questions, options, arguments and an outcome), checked against statements and relations.

Offences come out as rows, so that a caller sees which flow breaks what; flows without any are kept and get warnings.
What a flow holds is looked at where it lies, in array expressions; only its references to statements and relations are
joined, all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions import lexicons
from colloq.functions.text import is_blank
from colloq.operators.discourse import topic_of_statements

FLOW = (
    "session string, flow_ord int, topic_id string, "
    "questions array<struct<id: string, summary: string, statement_id: string>>, "
    "options array<struct<id: string, label: string, summary: string, statement_ids: array<string>, introduced_by: string, status: string>>, "
    "arguments array<struct<id: string, statement_id: string, option_id: string, stance: string, relation_ids: array<string>>>, "
    "outcome struct<status: string, kind: string, summary: string, statement_id: string, selected_option_ids: array<string>, rationale_statement_ids: array<string>>, "
    "confidence string, warnings array<string>"
)
_KEY = ["session", "flow_ord"]
_NONE = "cast(array() as array<string>)"


def _each(c: str, test) -> Column:
    """The ids of the entries of an array for which ``test`` holds; none of an array that is missing."""
    return F.coalesce(F.transform(F.filter(c, test), lambda x: F.coalesce(x["id"], F.lit(""))), F.expr(_NONE))


def _not_in(value: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(list(allowed)), F.lit(False))


def _doubled(c: str) -> Column:
    ids = F.transform(c, lambda x: x["id"])
    return F.coalesce(F.array_distinct(F.filter(ids, lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)), F.expr(_NONE))


def _references() -> Column:
    """All statements a flow refers to, as an array; a reference that must not be missing is empty where it is."""
    given = F.filter(F.transform("questions", lambda x: x["statement_id"]), lambda s: s.isNotNull())
    said = F.flatten(F.transform("options", lambda x: F.coalesce(x["statement_ids"], F.expr(_NONE))))
    argued = F.transform("arguments", lambda x: F.coalesce(x["statement_id"], F.lit("")))
    end = F.when(F.col("outcome.statement_id").isNotNull(), F.array("outcome.statement_id"))
    return F.array_distinct(F.concat(*[F.coalesce(c, F.expr(_NONE)) for c in (given, said, argued, end, F.col("outcome.rationale_statement_ids"))]))


def _held() -> Column:
    """(rule, key) of every offence that shows in the flow itself."""
    known = F.transform("options", lambda x: x["id"])
    of_known = lambda o: F.coalesce(F.array_contains(F.coalesce(known, F.expr(_NONE)), o), F.lit(False))
    chosen = F.coalesce("outcome.selected_option_ids", F.expr(_NONE))
    decided = F.coalesce(F.col("outcome.status") == "decided", F.lit(False))
    wrong = decided & (((F.col("outcome.kind") == "single_option") & (F.size(chosen) != 1)) | ((F.col("outcome.kind") == "hybrid") & (F.size(chosen) < 2)))
    one = lambda test, value: F.when(test, F.array(F.coalesce(value, F.lit("")))).otherwise(F.expr(_NONE))
    has = F.col("outcome").isNotNull()
    rules = {
        "unknown confidence": one(_not_in(F.col("confidence"), lexicons.FLOW_CONFIDENCE), F.col("confidence")),
        "unknown option status": _each("options", lambda x: _not_in(x["status"], lexicons.OPTION_STATUS)),
        "unknown stance": _each("arguments", lambda x: _not_in(x["stance"], lexicons.ARGUMENT_STANCE)),
        "unknown outcome status": one(has & _not_in(F.col("outcome.status"), lexicons.OUTCOME_STATUS), F.col("outcome.status")),
        "unknown outcome kind": one(has & _not_in(F.col("outcome.kind"), lexicons.OUTCOME_KIND), F.col("outcome.kind")),
        "option without a statement": _each("options", lambda x: F.coalesce(F.size(x["statement_ids"]), F.lit(0)) <= 0),
        "option introduced elsewhere": _each("options", lambda x: x["introduced_by"].isNotNull() & ~F.coalesce(F.array_contains(x["statement_ids"], x["introduced_by"]), F.lit(False))),
        "argument on an unknown option": _each("arguments", lambda x: ~of_known(x["option_id"])),
        "selected option is unknown": F.array_distinct(F.filter(chosen, lambda o: ~of_known(o))),
        "wrong number of selected options": one(wrong, F.size(chosen).cast("string")),
    }
    for name, column in (("question", "questions"), ("option", "options"), ("argument", "arguments")):
        rules[f"{name} without an id"] = F.slice(_each(column, lambda x: is_blank(x["id"])), 1, 1)
        rules[f"duplicate {name}"] = _doubled(column)
    tagged = [F.arrays_zip(F.array_repeat(F.lit(rule), F.size(keys)).alias("rule"), keys.alias("key")) for rule, keys in rules.items()]
    return F.flatten(F.array(*[F.transform(t, lambda x: F.struct(x["rule"].alias("rule"), x["key"].alias("key"))) for t in tagged]))


def flow_violations(flows: DataFrame, statements: DataFrame, topics: DataFrame) -> DataFrame:
    """``session``, ``flow_ord``, ``rule``, ``key`` of every offence; a flow with any is no flow.

    ``flows``: see ``FLOW``, ``flow_ord`` unique in the session; ``statements``: ``session``, ``id``, ``topic_id``;
    ``topics``: ``session``, ``topic_ord``, ``id``, ``statement_ids``. A statement belongs to the first topic that lists
    it, else to its own; what a flow refers to must be statements of the flow's topic. Missing arrays count as empty, a
    missing outcome as none.
    """
    own = topic_of_statements(statements.select("session", "id", "topic_id"), topics).select("session", F.col("id").alias("key"), "topic_id").distinct()
    refers = flows.select(*_KEY, "topic_id", F.explode(_references()).alias("key"))
    lost = refers.join(own, ["session", "key", "topic_id"], "left_anti").select(*_KEY, F.lit("statement is not of the topic").alias("rule"), "key")
    unknown = flows.join(topics.select("session", F.col("id").alias("topic_id")), ["session", "topic_id"], "left_anti").select(*_KEY, F.lit("unknown topic").alias("rule"), F.col("topic_id").alias("key"))
    held = flows.select(*_KEY, F.explode(_held()).alias("v")).select(*_KEY, "v.rule", "v.key")
    return held.unionByName(lost).unionByName(unknown).distinct()


def flow_warnings(flows: DataFrame, statements: DataFrame, relations: DataFrame) -> DataFrame:
    """``flows`` with what speaks against them added to ``warnings``: first options without arguments, then each
    argument whose relations are all unknown or that is against something and cites support for it, then selected options
    that only have arguments against them, then an outcome that comes before its options.

    ``statements``: ``session``, ``id``, ``utterance_index``; ``relations``: ``session``, ``id``, ``type``.
    """
    cited = flows.select(*_KEY, F.posexplode("arguments").alias("n", "a")).select(*_KEY, "n", "a.id", "a.stance", F.explode("a.relation_ids").alias("rid"))
    types = relations.filter(F.length("id") > 0).groupBy("session", F.col("id").alias("rid")).agg(F.max("type").alias("type"))
    seen = cited.join(types, ["session", "rid"], "left").groupBy(*_KEY, "n", "id", "stance").agg(F.max(F.col("type").isNotNull()).alias("known"), F.max(F.coalesce(F.col("type") == "supports", F.lit(False))).alias("supports"))
    told = F.array(F.when(~F.col("known"), F.format_string("argument %s references no known relation", "id")), F.when((F.col("stance") == "con") & F.col("supports"), F.format_string("con argument %s cites a supports relation", "id")))
    arguments = seen.withColumn("told", F.array_compact(told)).groupBy(*_KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "told"))), lambda x: x["told"])).alias("__argued"))
    spoken = flows.select(*_KEY, F.explode(F.flatten(F.transform("options", lambda x: x["statement_ids"]))).alias("id"), F.lit(False).alias("end"))
    ended = flows.select(*_KEY, F.col("outcome.statement_id").alias("id"), F.lit(True).alias("end"))
    at = spoken.unionByName(ended).join(statements.select("session", "id", "utterance_index").distinct(), ["session", "id"])
    early = at.groupBy(*_KEY).agg((F.min(F.when(F.col("end"), F.col("utterance_index"))) < F.min(F.when(~F.col("end"), F.col("utterance_index")))).alias("__early"))
    rows = flows.join(arguments, _KEY, "left").join(early, _KEY, "left")
    of = lambda o: F.filter("arguments", lambda a: a["option_id"] == o)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    bare = F.transform(F.filter("options", lambda x: count(of(x["id"])) <= 0), lambda x: F.concat(F.lit("option "), x["id"], F.lit(" has no argument")))
    against = F.transform(F.filter("outcome.selected_option_ids", lambda o: (count(of(o)) > 0) & F.forall(of(o), lambda a: a["stance"] == "con")), lambda o: F.concat(F.lit("selected option "), o, F.lit(" has only con arguments")))
    late = F.when(F.coalesce("__early", F.lit(False)), F.array(F.lit("outcome precedes option discussion")))
    every = F.concat(*[F.coalesce(c, F.expr(_NONE)) for c in (F.col("warnings"), bare, F.col("__argued"), against, late)])
    return rows.withColumn("warnings", every).drop("__argued", "__early").select(flows.columns)


def valid_flows(flows: DataFrame, statements: DataFrame, topics: DataFrame, relations: DataFrame) -> DataFrame:
    """The flows without an offence (:func:`flow_violations`), with their warnings (:func:`flow_warnings`)."""
    kept = flows.join(flow_violations(flows, statements, topics).select(*_KEY).distinct(), _KEY, "left_anti")
    return flow_warnings(kept, statements, relations)


def flows_json(flows: DataFrame) -> DataFrame:
    """``session`` and ``decision_flows``, the flows of each session in order as one JSON text."""
    fields = [c for c in flows.columns if c not in _KEY]
    listed = F.array_sort(F.collect_list(F.struct("flow_ord", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("flow"))))
    return flows.groupBy("session").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["flow"]), ","), F.lit("]")).alias("decision_flows"))
