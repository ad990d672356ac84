import random

import pytest
from pyspark.sql import functions as F

from colloq.operators import discourse

UTT = "session_id string, utt_index int, speaker string, text string"
ST = "session string, stmt_pos long, id string, utterance_index int, speaker string, text string, terms array<string>, topic_id string"
REL = "session string, rel_pos long, source string, target string, type string, confidence double"


def statements(spark, utterances):
    rows = [("m", i, s, t) for i, (s, t) in enumerate(utterances)]
    return discourse.split_statements(spark.createDataFrame(rows, UTT), "session_id", "utt_index")


def relations(spark, utterances):
    got = discourse.marker_relations(statements(spark, utterances)).orderBy("rel_pos").collect()
    return [(r.source, r.target, r.type, r.confidence, r.rule) for r in got]


def test_split(spark):
    got = statements(spark, [("A", "採用しよう、なぜなら速いからだ。よし！！\n次です"), ("B", None), ("B", "。。"), ("A", "　はい。")]).orderBy("stmt_pos").collect()
    assert [(r.id, r.utterance_index, r.text) for r in got] == [("s1", 0, "採用しよう、"), ("s2", 0, "なぜなら速いからだ。"), ("s3", 0, "よし！"), ("s4", 0, "次です"), ("s5", 3, "はい。")]


def test_markers(spark):
    assert relations(spark, [("A", "採用すべきだ。"), ("A", "なぜなら速いからだ。")]) == [("s2", "s1", "supports", 0.9, "explicit_reason")]
    assert relations(spark, [("A", "遅延した。"), ("B", "そのため延期する。")]) == [("s1", "s2", "causes", 0.9, "explicit_causal")]
    assert relations(spark, [("A", "しかし最初だ。")]) == []


@pytest.mark.parametrize(
    ("utterances", "expect"),
    [
        ([("A", "良い。"), ("B", "しかし高い。")], (0.65, "contrast")),
        ([("A", "良い。"), ("B", "でも高い。")], (0.65, "weak_contrast")),
        ([("A", "良い。"), ("A", "しかし高い。")], (0.45, "same_turn_contrast")),
        ([("A", "良い。でも高い。")], (0.45, "weak_contrast")),
    ],
)
def test_contrast_strength(spark, utterances, expect):
    assert relations(spark, utterances)[0][3:] == expect


def test_validation(spark):
    st = spark.createDataFrame([("m", 1, "s1", 0, None, "a", None, None), ("m", 2, "s2", 0, "", "b", None, None), ("m", 3, "s3", 9, "A", "c", None, None), ("m", 4, "s4", 0, "C", "　", None, None)], ST)
    utt = spark.createDataFrame([("m", 0, "Z", "t"), ("m", 0, "Z", "t")], UTT)
    kept = discourse.valid_statements(st, utt, "session_id", "utt_index")
    assert {(r.id, r.speaker) for r in kept.collect()} == {("s1", "Z"), ("s2", "Z")}
    rel = spark.createDataFrame([("m", 1, "s1", "s2", "supports", 5.0), ("m", 2, "s1", "s2", "supports", 0.5), ("m", 3, "s1", "s1", "causes", 0.5), ("m", 4, "s1", "s9", "causes", 0.5), ("m", 5, "s2", "s1", "likes", 0.5), ("m", 6, "s2", "s1", "causes", float("nan")), ("m", 7, "s2", "s1", "contrasts", -1.0)], REL)
    got = discourse.valid_relations(rel, kept)
    assert {(r.rel_pos, r.confidence) for r in got.collect()} == {(1, 1.0), (6, 0.0), (7, 0.0)}


def test_relation_ids(spark):
    ids = ["", "r2", "x", "x", None, "r9", ""]
    rel = spark.createDataFrame([("m", i, "a", "b", "t", 0.5, x) for i, x in enumerate(ids)], REL + ", id string")
    got = discourse.relation_ids(rel).orderBy("rel_pos").collect()
    assert [r.rel_id for r in got] == ["r1", "r2", "r3", "r4", "r5", "r9", "r6"]


def test_cycles():
    edges = [("s1", "s2", "causes", 0.9), ("s2", "s3", "causes", 0.8), ("s3", "s1", "causes", 0.3)]
    assert discourse.acyclic(edges) == [0, 1]
    assert discourse.acyclic([("a", "b", "x", 0.5), ("b", "a", "x", 0.5)]) == [1]
    assert discourse.acyclic([(str(i), str(i + 1), "x", 0.5) for i in range(5000)]) == list(range(5000))


def restarted(edges):
    """The edges kept if the search begins anew after each cycle."""
    alive = list(range(len(edges)))

    def visit(node, trail):
        for i in sorted((i for i in alive if edges[i][0] == node), key=lambda i: edges[i][:3] + (i,)):
            sources = [edges[j][0] for j in [*trail, i]]
            if edges[i][1] in sources:
                return [*trail, i][sources.index(edges[i][1]) :]
            found = visit(edges[i][1], [*trail, i])
            if found:
                return found
        return None

    while cycle := next(filter(None, (visit(root, []) for root in sorted({edges[i][0] for i in alive}))), None):
        alive.remove(min(cycle, key=lambda i: (edges[i][3], edges[i][0], edges[i][1])))
    return alive


def test_cycles_are_those_of_a_search_begun_anew():
    rnd = random.Random(7)
    for _ in range(500):
        n = rnd.randint(1, 7)
        edges = [(f"s{rnd.randint(1, n)}", f"s{rnd.randint(1, n)}", rnd.choice("ab"), rnd.choice([0.1, 0.5, 0.9])) for _ in range(rnd.randint(0, 14))]
        assert discourse.acyclic(edges) == restarted(edges)


def test_many_cycles_are_broken_in_one_search():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            self.reads += 1
            return super().__getitem__(i)

    edges = Counted(e for i in range(1, 300) for e in ((f"s{i + 1}", f"s{i}", "supports", 0.9), (f"s{i}", f"s{i + 1}", "elaborates", 2.0 if i % 2 else 0.01)))
    kept = discourse.acyclic(edges)
    assert edges.reads <= 20 * len(edges)
    assert kept == [i for i in range(598) if i // 2 % 2 != i % 2]


def test_break_cycles_by_session(spark):
    rel = spark.createDataFrame([("m", 1, "s1", "s2", "causes", 0.9), ("m", 2, "s2", "s1", "causes", 0.3), ("n", 1, "s1", "s2", "causes", 0.3)], REL)
    assert {(r.session, r.rel_pos) for r in discourse.break_cycles(rel).collect()} == {("m", 1), ("n", 1)}


def topics_of(spark, terms, **kw):
    rows = [("m", i + 1, f"s{i + 1}", 0, "A", "t", t, None) for i, t in enumerate(terms)]
    st = spark.createDataFrame(rows, ST)
    clusters = discourse.term_clusters(discourse.term_weights(st), discourse.term_edges(st), **kw)
    found = discourse.topics(clusters)
    members = discourse.topic_members(discourse.assign_topics(st, clusters, found), found, st)
    return [(r.topic_id, r.label, r.statement_ids) for r in members.orderBy("topic_id").collect()]


def test_topics(spark):
    got = topics_of(spark, [["api", "設計"], ["api", "設計"], ["予算", "採用"], ["予算", "採用"], None, [], ["lone"], [None]])
    assert got == [("t1", "設計", ["s1", "s2"]), ("t2", "採用", ["s3", "s4"])]


def test_large_component_is_cut(spark):
    left, right = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    terms = [left] * 3 + [right] * 3 + [["a0", "b0"]] * 2
    assert len(topics_of(spark, terms)) == 2
    assert len(topics_of(spark, terms, largest=100)) == 1


def test_label_propagation_is_sequential():
    assert discourse.propagate_labels(["a", "b", "c", "d"], [("a", "b", 2), ("c", "d", 2), ("b", "c", 1)]) == {"a": "b", "b": "b", "c": "d", "d": "d"}


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([("m", f"{i:04d}") for i in range(300)] + [("m", "z"), ("n", "0000")], "session string, term string")
    edges = spark.createDataFrame([("m", f"{i:04d}", f"{i + 1:04d}", 2) for i in range(299)], "session string, a string, b string, weight int")
    got = discourse.connected_components(nodes, edges).groupBy("session", "component").count().collect()
    assert {(r.session, r.component, r["count"]) for r in got} == {("m", "0000", 300), ("m", "z", 1), ("n", "0000", 1)}


def test_topic_lists(spark):
    st = spark.createDataFrame([("m", 1, "s1", 0, "A", "t", None, "old"), ("m", 2, "s2", 0, "A", "t", None, "old")], ST)
    tl = spark.createDataFrame([("m", 1, "t1", "L", ["s1", "s9"]), ("m", 2, "t2", "M", ["s1"]), ("m", 3, "t3", "", ["s2"])], "session string, topic_ord int, id string, label string, statement_ids array<string>")
    assert {(r.id, r.topic_id) for r in discourse.topic_of_statements(st, tl).collect()} == {("s1", "t1"), ("s2", "t3")}
    assert {(r.id, tuple(r.statement_ids)) for r in discourse.valid_topics(tl, st).collect()} == {("t1", ("s1",)), ("t2", ("s1",))}


def test_statement_terms(spark):
    st = spark.createDataFrame([("m", 1, "s1", 0, "A", "t", ["own"], None), ("m", 2, "s2", 0, "A", "t", [], None), ("m", 3, "s3", 0, "A", "t", None, None)], ST)
    found = spark.createDataFrame([("m", "s2", "b", 2), ("m", "s2", "a", 1), ("m", "s2", "z", 7), ("m", "s1", "x", 1)], "session string, id string, word string, rank int")
    got = discourse.statement_terms(st, found).withColumn("t", F.array_join("terms", ",")).collect()
    assert {(r.id, r.t) for r in got} == {("s1", "own"), ("s2", "a,b"), ("s3", "")}
