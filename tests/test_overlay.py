import pytest

from colloq.operators import overlay

NODE, EDGE = "session string, id string", "session string, a string, b string"


def rules(spark, nodes=(), edges=(), hidden=(), hidden_edges=(), limits=None):
    make = lambda rows, schema: spark.createDataFrame([("g", *r) if isinstance(r, tuple) else ("g", r) for r in rows], schema)
    base, base_edges = make(["alpha", "beta"], NODE), make([("alpha", "beta")], EDGE)
    got = overlay.overlay_violations(base, base_edges, make(nodes, NODE), make(edges, EDGE), make(hidden, NODE), make(hidden_edges, EDGE), limits)
    return {(r.rule, r.key) for r in got.collect()}


def test_valid(spark):
    assert rules(spark, ["extra"], [("extra", "alpha")]) == set()
    assert rules(spark) == set()


def test_offences(spark):
    assert rules(spark, ["alpha"]) == {("node is in the base", "alpha")}
    assert rules(spark, ["x", "x"]) == {("duplicate node", "x")}
    assert rules(spark, [" "]) == {("invalid node id", " ")}
    assert ("edge end is not visible", "alpha|x") in rules(spark, edges=[("x", "alpha")])
    assert rules(spark, edges=[("beta", "alpha")]) == {("edge is in the base", "alpha|beta")}
    assert ("edge to itself", "alpha|alpha") in rules(spark, edges=[("alpha", "alpha")])
    assert rules(spark, hidden=["gamma"]) == {("hidden node is unknown", "gamma")}
    assert rules(spark, hidden=["alpha"], hidden_edges=[("beta", "alpha")]) == {("hidden edge has a hidden end", "alpha|beta")}
    assert rules(spark, hidden_edges=[("alpha", "zeta")]) == {("hidden edge is unknown", "alpha|zeta")}
    assert rules(spark, ["x", "y"], limits={"nodes": 1}) == {("too many nodes", "2")}


def test_visible(spark):
    base = spark.createDataFrame([("g", "a"), ("g", "b")], NODE)
    got = overlay.visible_ids(base, base.filter("id = 'a'"), spark.createDataFrame([("g", "c")], NODE))
    assert {r.id for r in got.collect()} == {"b", "c"}


def test_positions(spark):
    rows = [("g", "b", 0.5, 1.0), ("g", "q", 0.5, 0.5), ("g", "c", 1.1, 0.0), ("g", "d", float("nan"), 0.0), ("g", "e", 0.1, 0.1), ("g", "e", 0.1, 0.1)]
    shown = spark.createDataFrame([("g", x) for x in "bcde"], NODE)
    got = overlay.position_violations(spark.createDataFrame(rows, NODE + ", x double, y double"), shown)
    assert {(r.rule, r.key) for r in got.collect()} == {("position of an unknown node", "q"), ("position outside", "c"), ("position outside", "d"), ("duplicate position", "e")}


def test_revision():
    assert overlay.next_revision(3, 3) == 4
    with pytest.raises(ValueError):
        overlay.next_revision(3, 2)


def edits(spark, sessions=("g",), revision=1, nodes=(), edges=(), hidden=(), hidden_edges=(), positions=()):
    make = lambda rows, schema: spark.createDataFrame([("g", *r) if isinstance(r, tuple) else ("g", r) for r in rows], schema)
    base, base_edges = make(["alpha", "beta"], NODE), make([("alpha", "beta")], EDGE)
    overlays = spark.createDataFrame([(s, revision) for s in sessions], "session string, revision int")
    got = overlay.normal_graph_overlay(overlays, base, base_edges, make(nodes, NODE), make(edges, EDGE), make(hidden, NODE), make(hidden_edges, EDGE), make(positions, NODE + ", x double, y double"))
    return {r.session: r.asDict(True) for r in got.collect()}


def test_normal_graph_overlay(spark):
    got = edits(spark, ("g", "h"), 4, [" extra "], [("extra", "alpha"), ("beta", "extra")], (), [("beta", "alpha")], [("extra", 1.0, 0.0), ("alpha", 0.5, 0.5)])
    assert got["g"] == {"session": "g", "revision": 4, "nodes": [{"id": "extra"}], "edges": [{"a": "alpha", "b": "extra"}, {"a": "beta", "b": "extra"}], "hidden_node_ids": [], "hidden_edges": [{"a": "alpha", "b": "beta"}], "positions": [{"id": "alpha", "x": 0.5, "y": 0.5}, {"id": "extra", "x": 1.0, "y": 0.0}]}
    assert {k: v for k, v in got["h"].items() if k != "session"} == overlay.EMPTY_GRAPH_EDITS | {"revision": 4}
    assert edits(spark, edges=[("alpha", "gone")]) == edits(spark, positions=[("alpha", 1.1, 0.0)]) == edits(spark, revision=-1) == edits(spark, revision=None) == {}


def test_normal_structure_overlay(spark):
    st, rel = "session string, id string, text string, topic_id string", "session string, id string, source string, target string, type string"
    base = spark.createDataFrame([("g", "s1", "a", None), ("g", "s2", "b", None)], st)
    base_rel = spark.createDataFrame([("g", "r1", "s1", "s2", "causes")], rel)
    topics = spark.createDataFrame([("g", "t1")], NODE)
    none, places = spark.createDataFrame([], NODE), spark.createDataFrame([("g", "u:1", 0.0, 1.0)], NODE + ", x double, y double")
    overlays = spark.createDataFrame([("g", 2)], "session string, revision int")

    def normal(statements, relations):
        return overlay.normal_structure_overlay(overlays, base, base_rel, topics, spark.createDataFrame(statements, st), spark.createDataFrame(relations, rel), none, spark.createDataFrame([("g", "r1")], NODE), places, ("causes", "supports")).collect()

    got = normal([("g", "u:2", " y ", "t1"), ("g", "u:1", "x", None)], [("g", "ur:1", "u:1", "s1", "supports")])[0]
    assert [tuple(x) for x in got.statements] == [("u:1", "x", None), ("u:2", "y", "t1")] and [x.id for x in got.relations] == ["ur:1"]
    assert got.hidden_relation_ids == ["r1"] and got.hidden_statement_ids == [] and got.revision == 2 and [tuple(p) for p in got.positions] == [("u:1", 0.0, 1.0)]
    assert normal([("g", "u:1", "x", "t9")], []) == normal([("g", "u:1", "x", None)], [("g", "ur:1", "s1", "s2", "causes")]) == []


def test_update_edits(tmp_path):
    import json

    from colloq.sources.documents import update_edits

    path = tmp_path / "m.graph.json"
    path.write_text(json.dumps({"version": 1, "graph": {"nodes": []}}))

    def normal(edits, artifact):
        if "bad" in edits:
            raise ValueError("bad")
        return {**overlay.EMPTY_GRAPH_EDITS, **edits}

    assert update_edits(str(path), 0, {"nodes": [{"id": "é"}]}, normal)["revision"] == 1
    held = json.loads(path.read_text("utf-8"))
    assert held["graph"] == {"nodes": []} and held["edits"]["nodes"] == [{"id": "é"}]
    for expected, edits in ((0, {}), (1, {"bad": 1}), (-1, {}), (True, {})):
        with pytest.raises(ValueError):
            update_edits(str(path), expected, edits, normal)
    assert json.loads(path.read_text("utf-8")) == held and sorted(p.name for p in tmp_path.iterdir()) == ["m.graph.json"]
    assert update_edits(str(path), 1, {}, normal)["revision"] == 2
