"""User edits over a base graph, checked and applied as set operations.

An edit is accepted when no rule is broken; the rules give one row per offence, so a caller sees what and why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions.text import edge_key, is_valid_id, strip

# How much an overlay may hold.
LIMITS = {"nodes": 100, "edges": 250, "hidden": 250}


def visible_ids(base: DataFrame, hidden: DataFrame, added: DataFrame) -> DataFrame:
    """``session``, ``id``: base ids that aren't hidden, and added ones."""
    kept = base.select("session", "id").join(hidden.select("session", "id"), ["session", "id"], "left_anti")
    return kept.unionByName(added.select("session", "id")).distinct()


def _offences(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select("session", F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _flagged(key: Column, rules: dict[str, Column]) -> Column:
    """An array of (rule, key) of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"))) for rule, test in rules.items()]))


def _tally(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """How often each key stands in each of the parts: the keys and a count by the name of each part."""
    every = None
    for name, df in parts.items():
        rows = df.select(*keys, F.lit(name).alias("__part"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(*keys).agg(*[F.sum((F.col("__part") == name).cast("long")).alias(name) for name in parts])


def overlay_violations(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame, hidden_nodes: DataFrame, hidden_edges: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``session``, ``rule``, ``key`` of every offence of an overlay against its base graph.

    Nodes have ``session``, ``id``; edges ``session``, ``a``, ``b`` and are undirected. A node must have a valid id
    that is new; an edge must join two different visible nodes and be new; what is hidden must be in the base, and a
    hidden edge's ends must not be hidden themselves; nothing may be listed twice or beyond ``limits``.

    Base, added and hidden rows are counted by key in one pass for the nodes and one for the edges; the rules are
    conditions on those counts, and only the ends of added and hidden edges are joined.
    """
    limits = LIMITS | (limits or {})

    def keyed(df: DataFrame) -> DataFrame:
        a, b = edge_key(F.col("a"), F.col("b"))
        return df.select("session", a.alias("a"), b.alias("b"))

    of_nodes = _tally({"base": base_nodes, "added": nodes, "hidden": hidden_nodes}, ["session", "id"])
    of_edges = _tally({"base": keyed(base_edges), "added": keyed(edges), "hidden": keyed(hidden_edges)}, ["session", "a", "b"])
    base, added, hidden = F.col("base") > 0, F.col("added") > 0, F.col("hidden") > 0
    bad = ~is_valid_id("id")
    node_rules = _flagged(F.col("id"), {"invalid node id": added & bad, "invalid hidden node id": hidden & bad, "duplicate node": F.col("added") > 1, "duplicate hidden node": F.col("hidden") > 1, "node is in the base": added & base, "hidden node is unknown": hidden & ~base})
    found = of_nodes.select("session", F.explode(node_rules).alias("v"))
    loop = F.col("a") == F.col("b")
    ends = of_edges.filter(added | hidden).select("session", "a", "b", F.col("added").alias("n"), F.col("hidden").alias("h"), F.explode(F.array("a", "b")).alias("id"))
    ends = ends.join(of_nodes, ["session", "id"], "left").groupBy("session", "a", "b").agg(F.max(~F.coalesce((base & ~hidden) | added, F.lit(False))).alias("__unseen"), F.max(F.coalesce(hidden, F.lit(False))).alias("__covered"))
    edge_rules = _flagged(
        F.concat_ws("|", "a", "b"),
        {"edge to itself": added & loop, "hidden edge to itself": hidden & loop, "duplicate edge": F.col("added") > 1, "duplicate hidden edge": F.col("hidden") > 1}
        | {"edge is in the base": added & base, "hidden edge is unknown": hidden & ~base, "edge end is not visible": added & F.col("__unseen"), "hidden edge has a hidden end": hidden & F.col("__covered")},
    )
    found = found.unionByName(of_edges.filter(added | hidden).join(ends, ["session", "a", "b"]).select("session", F.explode(edge_rules).alias("v")))
    for what, df, most in (("nodes", of_nodes, limits["nodes"]), ("edges", of_edges, limits["edges"])):
        sums = df.groupBy("session").agg(F.sum("added").alias("n"), F.sum("hidden").alias("h"))
        many = F.concat(_flagged(F.col("n"), {f"too many {what}": F.col("n") > most}), _flagged(F.col("h"), {f"too many hidden {what}": F.col("h") > limits["hidden"]}))
        found = found.unionByName(sums.select("session", F.explode(many).alias("v")))
    return found.select("session", "v.rule", "v.key")


def position_violations(positions: DataFrame, visible: DataFrame) -> DataFrame:
    """Offences of positions (``session``, ``id``, ``x``, ``y``): unknown or repeated ids and coordinates outside 0..1."""
    inside = F.coalesce(F.col("x").between(0, 1) & F.col("y").between(0, 1) & ~F.isnan("x") & ~F.isnan("y"), F.lit(False))
    unknown = positions.join(visible, ["session", "id"], "left_anti")
    twice = positions.groupBy("session", "id").count().filter("count > 1")
    out = _offences(unknown, "position of an unknown node", F.col("id")).unionByName(_offences(twice, "duplicate position", F.col("id")))
    return out.unionByName(_offences(positions.filter(~inside), "position outside", F.col("id"))).distinct()


def normal_graph_overlay(overlays: DataFrame, base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame, hidden_nodes: DataFrame, hidden_edges: DataFrame, positions: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Overlays without an offence in their normal form: ``session``, ``revision``, ``nodes``, ``edges`` (ends in order),
    ``hidden_node_ids``, ``hidden_edges``, ``positions``; ids trimmed, and all lists but the nodes sorted.

    ``overlays`` (``session``, ``revision``) names the overlays there are, so that an empty one comes out too; a negative
    or missing revision is an offence. ``nodes`` may have ``ord``, by which they are kept in order.
    """
    trim = lambda df, *names: df.withColumns({c: strip(c) for c in names})
    base_nodes, nodes, hidden_nodes, positions = (trim(df, "id") for df in (base_nodes, nodes, hidden_nodes, positions))
    base_edges, edges, hidden_edges = (trim(df, "a", "b") for df in (base_edges, edges, hidden_edges))
    broken = overlay_violations(base_nodes, base_edges, nodes, edges, hidden_nodes, hidden_edges, limits).select("session")
    broken = broken.unionByName(position_violations(positions, visible_ids(base_nodes, hidden_nodes, nodes)).select("session")).distinct()
    good = overlays.filter("revision >= 0").select("session", "revision").join(broken, "session", "left_anti")
    a, b = edge_key(F.col("a"), F.col("b"))
    order = F.col("ord") if "ord" in nodes.columns else F.col("id")
    lists = {
        "nodes": (nodes, F.struct(order.alias("o"), F.struct("id").alias("v")), "array<struct<id: string>>"),
        "edges": (edges, F.struct(F.lit(0).alias("o"), F.struct(a.alias("a"), b.alias("b")).alias("v")), "array<struct<a: string, b: string>>"),
        "hidden_node_ids": (hidden_nodes, F.struct(F.lit(0).alias("o"), F.col("id").alias("v")), "array<string>"),
        "hidden_edges": (hidden_edges, F.struct(F.lit(0).alias("o"), F.struct(a.alias("a"), b.alias("b")).alias("v")), "array<struct<a: string, b: string>>"),
        "positions": (positions, F.struct(F.lit(0).alias("o"), F.struct("id", "x", "y").alias("v")), "array<struct<id: string, x: double, y: double>>"),
    }
    return _listed(good, lists)


def _listed(good: DataFrame, lists: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """``good`` with the rows of each table as a sorted array; the limits of an overlay bound their lengths."""
    for name, (df, entry, kind) in lists.items():
        held = df.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]).alias(name))
        good = good.join(held, "session", "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))
    return good


def normal_structure_overlay(overlays: DataFrame, base_statements: DataFrame, base_relations: DataFrame, topics: DataFrame, statements: DataFrame, relations: DataFrame, hidden_statements: DataFrame, hidden_relations: DataFrame, positions: DataFrame, types: tuple[str, ...], limits: dict[str, int] | None = None) -> DataFrame:
    """As :func:`normal_graph_overlay`, over a directed, typed structure: ``session``, ``revision``, ``statements``,
    ``relations``, ``hidden_statement_ids``, ``hidden_relation_ids``, ``positions``, each sorted by id. A statement's
    ``topic_id`` must be null or one of ``topics`` (``session``, ``id``)."""
    broken = structure_violations(base_statements, base_relations, statements, relations, hidden_statements, hidden_relations, types, limits).select("session")
    shown = visible_ids(base_statements, hidden_statements, statements)
    strange = statements.filter("topic_id IS NOT NULL").join(topics.select("session", F.col("id").alias("topic_id")), ["session", "topic_id"], "left_anti").select("session")
    broken = broken.unionByName(position_violations(positions, shown).select("session")).unionByName(strange).distinct()
    good = overlays.filter("revision >= 0").select("session", "revision").join(broken, "session", "left_anti")
    by_id = lambda *rest: F.struct(F.col("id").alias("o"), F.struct("id", *rest).alias("v"))
    one = F.struct(F.col("id").alias("o"), F.col("id").alias("v"))
    return _listed(
        good,
        {
            "statements": (statements, by_id(strip("text").alias("text"), "topic_id"), "array<struct<id: string, text: string, topic_id: string>>"),
            "relations": (relations, by_id("source", "target", "type"), "array<struct<id: string, source: string, target: string, type: string>>"),
            "hidden_statement_ids": (hidden_statements, one, "array<string>"),
            "hidden_relation_ids": (hidden_relations, one, "array<string>"),
            "positions": (positions, by_id("x", "y"), "array<struct<id: string, x: double, y: double>>"),
        },
    )


# Overlays that change nothing, as documents without edits have them.
EMPTY_GRAPH_EDITS = {"revision": 0, "nodes": [], "edges": [], "hidden_node_ids": [], "hidden_edges": [], "positions": []}
EMPTY_STRUCTURE_EDITS = {"revision": 0, "statements": [], "relations": [], "hidden_statement_ids": [], "hidden_relation_ids": [], "positions": []}


def next_revision(stored: int, expected: int) -> int:
    """The revision of an accepted edit; an edit made on another one than is stored is refused."""
    if stored != expected:
        raise ValueError(f"the edits have changed: revision {stored}, not {expected}")
    return stored + 1


# What ids of users' own statements and relations begin with, and how long a statement may be.
OWN_STATEMENT, OWN_RELATION, LONGEST_TEXT = "u:", "ur:", 2000


def structure_violations(base_statements: DataFrame, base_relations: DataFrame, statements: DataFrame, relations: DataFrame, hidden_statements: DataFrame, hidden_relations: DataFrame, types: tuple[str, ...], limits: dict[str, int] | None = None) -> DataFrame:
    """``session``, ``rule``, ``key`` of every offence of an overlay against a directed, typed structure.

    Statements have ``session``, ``id``, ``text``; relations ``session``, ``id``, ``source``, ``target``, ``type``; what
    is hidden ``session``, ``id``. Own ids carry their prefix, are new and hold no control characters; texts are 1 to
    2,000 characters; a relation is of a known type, joins two different visible statements and says something new.
    """
    limits = LIMITS | (limits or {})
    good = is_valid_id("id") & ~F.col("id").rlike(r"[\x00-\x1f\x7f]")
    triple = F.concat_ws("|", "source", "target", "type")
    key = ["session", "source", "target", "type"]
    shown = visible_ids(base_statements, hidden_statements, statements)
    found = []
    for name, df, prefix, base, most in (("statement", statements, OWN_STATEMENT, base_statements, limits["nodes"]), ("relation", relations, OWN_RELATION, base_relations, limits["edges"])):
        found.append(_offences(df.filter(~F.coalesce(good & F.col("id").startswith(prefix), F.lit(False))), f"invalid {name} id", F.col("id")))
        found.append(_offences(df.groupBy("session", "id").count().filter("count > 1"), f"duplicate {name}", F.col("id")))
        found.append(_offences(df.join(base.select("session", "id"), ["session", "id"], "left_semi"), f"{name} is in the base", F.col("id")))
        found.append(_offences(df.groupBy("session").count().filter(F.col("count") > most), f"too many {name}s", F.col("count")))
    for name, df, base in (("statement", hidden_statements, base_statements), ("relation", hidden_relations, base_relations)):
        found.append(_offences(df.join(base.select("session", "id"), ["session", "id"], "left_anti"), f"hidden {name} is unknown", F.col("id")))
        found.append(_offences(df.groupBy("session", "id").count().filter("count > 1"), f"duplicate hidden {name}", F.col("id")))
        found.append(_offences(df.groupBy("session").count().filter(F.col("count") > limits["hidden"]), f"too many hidden {name}s", F.col("count")))
    length = F.length(strip("text"))
    found.append(_offences(statements.filter(~F.coalesce((length > 0) & (F.length("text") <= LONGEST_TEXT), F.lit(False))), "invalid statement text", F.col("id")))
    found.append(_offences(relations.filter(~F.coalesce(F.col("type").isin(list(types)), F.lit(False))), "unknown relation type", F.col("id")))
    found.append(_offences(relations.filter("source = target"), "relation to itself", F.col("id")))
    ends = relations.select("session", F.col("id").alias("rid"), F.explode(F.array("source", "target")).alias("id")).join(shown, ["session", "id"], "left_anti")
    found.append(_offences(ends, "relation end is not visible", F.col("rid")))
    found.append(_offences(relations.groupBy(*key).count().filter("count > 1"), "relation is said twice", triple))
    found.append(_offences(relations.join(base_relations.select(*key), key, "left_semi"), "relation is said in the base", triple))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()
