import json

from colloq.functions.lexicons import RELATION_TYPES
from colloq.operators import overlay
from colloq.operators.structure import Extraction, build_structure, parse_answers, prompt_line

UTT = "session string, utterance_index int, speaker string, text string"


def test_fallback_and_answers(spark):
    utt = spark.createDataFrame([("a", 0, "A", "API設計を採用する。なぜならAPI設計は速い。"), ("a", 1, "B", "しかしAPI設計は高い。"), ("b", 0, "A", "一つ。"), ("c", 0, "A", None)], UTT)
    answer = {"statements": [{"id": "x1", "utterance_index": 0, "text": "one", "terms": ["t"]}, {"id": "", "text": "n"}, {"id": "x2", "utterance_index": 7, "text": "lost"}], "relations": [{"source": "x1", "target": "x2", "type": "causes", "confidence": 3}], "topics": [{"id": "T", "label": "L", "statement_ids": ["x1", "x2"]}]}
    answers = spark.createDataFrame([("b", json.dumps(answer)), ("a", "not json"), ("c", None)], "session string, answer string")
    got = build_structure(utt, lambda _: parse_answers(answers))
    assert isinstance(got, Extraction)
    st = {(r.session, r.id): (r.text, r.topic_id, r.speaker) for r in got.statements.collect()}
    assert st[("b", "x1")] == ("one", "T", "A") and len([k for k in st if k[0] == "b"]) == 1
    assert len([k for k in st if k[0] == "a"]) == 3 and not [k for k in st if k[0] == "c"]
    rel = {(r.session, r.id, r.source, r.target, r.type) for r in got.relations.collect()}
    assert rel == {("a", "r1", "s2", "s1", "supports"), ("a", "r2", "s3", "s2", "contrasts")}
    topics = {(r.session, r.id): r.label for r in got.topics.collect()}
    assert topics[("b", "T")] == "L" and ("a", "t1") in topics
    assert [r[0] for r in utt.filter("session = 'b'").select(prompt_line()).collect()] == ["0 [A] 一つ。"]


def test_without_extractor_and_empty(spark):
    empty = spark.createDataFrame([], UTT)
    got = build_structure(empty)
    assert got.statements.count() == got.relations.count() == got.topics.count() == 0


def test_structure_overlay(spark):
    st, rel, ids = "session string, id string, text string", "session string, id string, source string, target string, type string", "session string, id string"
    base = spark.createDataFrame([("g", "s1", "a"), ("g", "s2", "b")], st)
    base_rel = spark.createDataFrame([("g", "r1", "s1", "s2", "causes")], rel)

    def rules(statements=(), relations=(), hidden=(), hidden_relations=()):
        make = lambda rows, schema: spark.createDataFrame([("g", *r) for r in rows], schema)
        got = overlay.structure_violations(base, base_rel, make(statements, st), make(relations, rel), make(hidden, ids), make(hidden_relations, ids), RELATION_TYPES)
        return {(r.rule, r.key) for r in got.collect()}

    assert rules([("u:1", "new")], [("ur:1", "u:1", "s1", "supports")], [], [("r1",)]) == set()
    assert ("invalid statement id", "x") in rules([("x", "new")]) and ("invalid statement text", "u:1") in rules([("u:1", " ")])
    assert ("relation is said in the base", "s1|s2|causes") in rules(relations=[("ur:1", "s1", "s2", "causes")])
    assert ("relation end is not visible", "ur:1") in rules(relations=[("ur:1", "s1", "s2", "supports")], hidden=[("s1",)])
    assert ("unknown relation type", "ur:1") in rules(relations=[("ur:1", "s2", "s1", "likes")])
    assert ("hidden statement is unknown", "zz") in rules(hidden=[("zz",)])


def test_coercion_and_json(spark):
    from colloq.operators import structure
    from colloq.operators.flows import FLOW

    raw = spark.createDataFrame([("a", json.dumps(["一つ。なぜなら二つ。", {"speaker": "A", "start": 1.5, "text": "{x}"}, {"end": "odd"}, None, {"speaker": None}])), ("b", "{}"), ("c", None), ("d", "[]")], "session string, raw string")
    got = [tuple(r) for r in structure.coerce_utterances(raw, "raw").orderBy("session", "utterance_index").collect()]
    assert got == [("a", 0, "", 0.0, 0.0, "一つ。なぜなら二つ。"), ("a", 1, "A", 1.5, 0.0, "{x}"), ("a", 2, "", 0.0, 0.0, ""), ("a", 3, "", 0.0, 0.0, ""), ("a", 4, "", 0.0, 0.0, "")]
    found = build_structure(structure.coerce_utterances(raw, "raw"))
    flows = spark.createDataFrame([("a", 0, "t1", [], [], [], None, "high", [])], FLOW)
    made = {r.session: json.loads(r.value) for r in structure.structure_json(found, flows).collect()}
    assert set(made) == {"a"} and made["a"]["kind"] == "logical_structure" and made["a"]["extractors"] == ["markers"]
    assert [s["id"] for s in made["a"]["statements"]] == ["s1", "s2", "s3"]
    assert [(r["source"], r["target"], r["evidence"]["marker"]) for r in made["a"]["relations"]] == [("s2", "s1", "なぜなら")]
    assert made["a"]["decision_flows"][0]["topic_id"] == "t1" and json.loads(structure.structure_json(found).first().value)["decision_flows"] == []


def test_term_extractor(spark):
    from pyspark.sql import functions as F

    asked = []

    def words(df, keys, text, most):
        asked.append(most)
        return df.select(*keys, F.lit("zzz").alias("word"), F.lit(1).alias("rank"))

    utt = spark.createDataFrame([("a", 0, "A", "一つ。"), ("a", 1, "A", "二つ。")], UTT)
    got = build_structure(utt, term_extractor=words)
    assert asked == [6] and {r.label for r in got.topics.collect()} == {"zzz"}
