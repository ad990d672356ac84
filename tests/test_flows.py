import copy
import json

import pytest

from colloq.operators import flows as fl

STATEMENTS = "session string, id string, topic_id string, utterance_index int"
RELATIONS = "session string, id string, type string"
TOPICS = "session string, topic_ord int, id string, statement_ids array<string>"


def flow():
    return {
        "topic_id": "t1",
        "questions": [{"id": "q1", "summary": "", "statement_id": "s1"}],
        "options": [{"id": "o1", "label": "a", "summary": "", "statement_ids": ["s2"], "introduced_by": "s2", "status": "selected"}, {"id": "o2", "label": "b", "summary": "", "statement_ids": ["s3"], "introduced_by": None, "status": "rejected"}],
        "arguments": [{"id": "a1", "statement_id": "s4", "option_id": "o1", "stance": "pro", "relation_ids": ["r1"]}],
        "outcome": {"status": "decided", "kind": "single_option", "summary": "", "statement_id": "s5", "selected_option_ids": ["o1"], "rationale_statement_ids": ["s4"]},
        "confidence": "high",
        "warnings": [],
    }


def changed(*path, to):
    f = copy.deepcopy(flow())
    at = f
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = to
    return f


@pytest.fixture(scope="module")
def tables(spark):
    statements = spark.createDataFrame([("m", f"s{i}", None, i) for i in range(1, 6)] + [("m", "s9", "t2", 9)], STATEMENTS)
    topics = spark.createDataFrame([("m", 0, "t1", [f"s{i}" for i in range(1, 6)]), ("m", 1, "t2", ["s9", "s1"])], TOPICS)
    relations = spark.createDataFrame([("m", "r1", "supports"), ("m", "", "causes"), ("m", None, "causes")], RELATIONS)
    return statements, topics, relations


def rows(spark, items):
    return spark.createDataFrame([("m", n, *[f[k] for k in ("topic_id", "questions", "options", "arguments", "outcome", "confidence", "warnings")]) for n, f in enumerate(items)], fl.FLOW)


BAD = [
    (changed("topic_id", to="t9"), "unknown topic"),
    (changed("topic_id", to="t2"), "statement is not of the topic"),
    (changed("confidence", to="sure"), "unknown confidence"),
    (changed("confidence", to=None), "unknown confidence"),
    (changed("options", 0, "status", to="new"), "unknown option status"),
    (changed("arguments", 0, "stance", to="odd"), "unknown stance"),
    (changed("outcome", "status", to="maybe"), "unknown outcome status"),
    (changed("outcome", "kind", to="x"), "unknown outcome kind"),
    (changed("questions", 0, "id", to=" "), "question without an id"),
    (changed("options", 1, "id", to=None), "option without an id"),
    (changed("arguments", 0, "id", to=""), "argument without an id"),
    (changed("options", 1, "id", to="o1"), "duplicate option"),
    (changed("questions", to=[{"id": "q", "summary": "", "statement_id": None}] * 2), "duplicate question"),
    (changed("questions", 0, "statement_id", to="s9"), "statement is not of the topic"),
    (changed("questions", 0, "statement_id", to=""), "statement is not of the topic"),
    (changed("options", 0, "statement_ids", to=[]), "option without a statement"),
    (changed("options", 0, "statement_ids", to=["s2", "s77"]), "statement is not of the topic"),
    (changed("options", 0, "introduced_by", to="s3"), "option introduced elsewhere"),
    (changed("arguments", 0, "option_id", to="o7"), "argument on an unknown option"),
    (changed("arguments", 0, "statement_id", to=None), "statement is not of the topic"),
    (changed("outcome", "selected_option_ids", to=["o7"]), "selected option is unknown"),
    (changed("outcome", "selected_option_ids", to=["o1", "o2"]), "wrong number of selected options"),
    (changed("outcome", "kind", to="hybrid"), "wrong number of selected options"),
    (changed("outcome", "rationale_statement_ids", to=["s9"]), "statement is not of the topic"),
    (changed("outcome", "statement_id", to="s9"), "statement is not of the topic"),
]


def test_each_rule(spark, tables):
    statements, topics, _ = tables
    got = {}
    for v in fl.flow_violations(rows(spark, [f for f, _ in BAD]), statements, topics).collect():
        got.setdefault(v.flow_ord, set()).add(v.rule)
    for n, (_, rule) in enumerate(BAD):
        assert rule in got.get(n, set()), (n, rule)
    assert sum(len(x) for x in got.values()) <= len(BAD) + 4


def test_warnings(spark, tables):
    con = changed("arguments", 0, "stance", to="con")
    early = changed("outcome", "statement_id", to="s1")
    unknown = changed("arguments", 0, "relation_ids", to=["r8", "r9"])
    bare = changed("outcome", to=None)
    bare["questions"] = bare["arguments"] = None
    got = {r.flow_ord: r.warnings for r in fl.valid_flows(rows(spark, [flow(), con, early, unknown, bare, BAD[0][0]]), *tables).collect()}
    assert got == {
        0: ["option o2 has no argument"],
        1: ["option o2 has no argument", "con argument a1 cites a supports relation", "selected option o1 has only con arguments"],
        2: ["option o2 has no argument", "outcome precedes option discussion"],
        3: ["option o2 has no argument", "argument a1 references no known relation"],
        4: ["option o1 has no argument", "option o2 has no argument"],
    }


def test_json_and_empty(spark, tables):
    got = fl.flows_json(fl.valid_flows(rows(spark, [flow(), changed("outcome", to=None)]), *tables)).collect()
    made = json.loads(got[0].decision_flows)
    assert made[0] == flow() | {"warnings": ["option o2 has no argument"]} and made[1]["outcome"] is None
    none = spark.createDataFrame([], fl.FLOW)
    assert fl.valid_flows(none, *tables).count() == fl.flow_violations(none, *tables[:2]).count() == fl.flows_json(none).count() == 0
