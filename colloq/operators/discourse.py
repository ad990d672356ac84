"""Statements, relations between them and topics over their terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions import lexicons
from colloq.functions.text import clamp01, strip
from colloq.operators.runs import nth_free, running_total
from colloq.session import checkpoint


def _java(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&-])", r"\\\1", text).replace("\n", "\\n")


def sentences_of(text: Column, enders: str = lexicons.SENTENCE_ENDERS) -> Column:
    """An array of the sentences of a text: cut after each ender, trimmed; pieces of enders only are dropped."""
    cls = "".join(_java(c) for c in enders)
    pieces = F.transform(F.split(text, f"(?<=[{cls}])"), strip)
    return F.filter(pieces, lambda p: F.length(F.regexp_replace(p, f"^[{cls}]+|[{cls}]+$", "")) > 0)


def fragments_of(sentence: Column, connectives: tuple[str, ...] = lexicons.SPLIT_CONNECTIVES) -> Column:
    """An array of a sentence's parts: cut after a comma that a connective follows; the comma stays with its head."""
    if not connectives:
        return F.array(sentence)
    parts = F.split(sentence, f"(?<=、)(?=(?:{'|'.join(map(_java, connectives))}))")
    parts = F.filter(F.transform(parts, strip), lambda p: F.length(F.regexp_replace(p, "^、+|、+$", "")) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(sentence))


def split_statements(utterances: DataFrame, session: str, index: str, *, enders: str = lexicons.SENTENCE_ENDERS, connectives: tuple[str, ...] = lexicons.SPLIT_CONNECTIVES) -> DataFrame:
    """Statements of each session in order of the utterances' ``index`` (unique in the session): ``session``,
    ``stmt_pos`` (from 1), ``id`` (s1, s2, ...), ``utterance_index``, ``speaker``, ``text``.

    The running number is the statements of earlier utterances plus the place in one's own. Null texts have no
    statement.
    """
    rows = utterances.select(F.col(session).alias("session"), F.col(index).alias("utterance_index"), "speaker", F.flatten(F.transform(sentences_of(F.col("text"), enders), lambda s: fragments_of(s, connectives))).alias("parts")).filter(F.size("parts") > 0)
    rows = running_total(rows.withColumn("__size", F.size("parts")), ["session"], "utterance_index", "__size", "base")
    rows = rows.select("session", "utterance_index", "speaker", "base", F.posexplode("parts").alias("n", "text"))
    pos = (F.col("base") + F.col("n") + 1).cast("bigint")
    return rows.select("session", pos.alias("stmt_pos"), F.concat(F.lit("s"), pos.cast("string")).alias("id"), "utterance_index", "speaker", "text")


def marker_relations(statements: DataFrame, rules: tuple = lexicons.MARKER_RULES, *, lead: str = "、。 　") -> DataFrame:
    """Relations of each statement with the one before it, by the first rule whose marker it begins with.

    ``session``, ``rel_pos``, ``source``, ``target``, ``type``, ``confidence``, ``marker``, ``rule``. A contrast that
    opens another speaker's turn keeps its rule and has at least 0.65; any other contrast has 0.45. The first statement
    of a session has no relation; ``stmt_pos`` must count without gaps. ``lead``: characters skipped before the marker.
    """
    body = F.regexp_replace("text", f"^[{lead}]+", "")
    match = F.coalesce(*[F.when(body.startswith(m), F.struct(F.lit(m).alias("marker"), F.lit(t).alias("type"), F.lit(cur).alias("cur"), F.lit(c).alias("confidence"), F.lit(r).alias("rule"))) for m, t, cur, c, r in rules])
    # The statement before has the number before: a join on it spreads a session over all tasks.
    found = statements.select("session", "stmt_pos", "id", "utterance_index", "speaker", match.alias("m")).filter("m IS NOT NULL")
    before = statements.select("session", (F.col("stmt_pos") + 1).alias("stmt_pos"), F.col("id").alias("prev"), F.col("utterance_index").alias("prev_utt"), F.col("speaker").alias("prev_speaker"))
    rows = found.join(before, ["session", "stmt_pos"])
    contrast = F.col("m.type") == "contrasts"
    opens = (F.col("utterance_index") != F.col("prev_utt")) & ~F.col("speaker").eqNullSafe(F.col("prev_speaker"))
    confidence = F.when(~contrast, F.col("m.confidence")).when(opens, F.greatest("m.confidence", F.lit(0.65))).otherwise(F.lit(0.45))
    rule = F.when(contrast & ~opens & (F.col("m.rule") != "weak_contrast"), F.lit("same_turn_contrast")).otherwise(F.col("m.rule"))
    return rows.select("session", F.col("stmt_pos").alias("rel_pos"), F.when(F.col("m.cur"), F.col("id")).otherwise(F.col("prev")).alias("source"), F.when(F.col("m.cur"), F.col("prev")).otherwise(F.col("id")).alias("target"), F.col("m.type").alias("type"), confidence.alias("confidence"), F.col("m.marker").alias("marker"), rule.alias("rule"))


def valid_statements(statements: DataFrame, utterances: DataFrame, session: str, index: str) -> DataFrame:
    """Statements with text whose utterance exists; a missing or empty speaker is taken from the utterance."""
    u = utterances.select(F.col(session).alias("session"), F.col(index).alias("utterance_index"), F.col("speaker").alias("__speaker")).groupBy("session", "utterance_index").agg(F.max("__speaker").alias("__speaker"))
    kept = statements.filter(F.length(strip("text")) > 0).join(u, ["session", "utterance_index"])
    return kept.withColumn("speaker", F.when(F.length("speaker") > 0, F.col("speaker")).otherwise(F.col("__speaker"))).drop("__speaker")


def valid_relations(relations: DataFrame, statements: DataFrame, types: tuple[str, ...] = lexicons.RELATION_TYPES) -> DataFrame:
    """Relations of a known type between two different known statements, the first by ``rel_pos`` of each (source,
    target, type); confidence cut to 0..1."""
    ids = statements.select("session", "id").distinct()
    kept = relations.filter(F.col("type").isin(list(types)) & (F.col("source") != F.col("target")))
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), ["session", end], "left_semi")
    first = kept.groupBy("session", "source", "target", "type").agg(F.min_by(F.struct(*[c for c in kept.columns if c not in ("session", "source", "target", "type")]), "rel_pos").alias("r"))
    return first.select("session", "source", "target", "type", "r.*").withColumn("confidence", clamp01(F.col("confidence")))


def valid_topics(topics: DataFrame, statements: DataFrame) -> DataFrame:
    """Topics (``session``, ``id``, ``label``, ``statement_ids``) with a label and a known member; unknown members go, the order stays."""
    members = topics.filter(F.length("label") > 0).select("session", "id", "label", F.posexplode("statement_ids").alias("n", "sid"))
    known = members.join(statements.select("session", F.col("id").alias("sid")).distinct(), ["session", "sid"], "left_semi")
    return known.groupBy("session", "id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sid"))), lambda x: x["sid"]).alias("statement_ids"))


def relation_ids(relations: DataFrame) -> DataFrame:
    """``rel_id`` for each relation: its own ``id`` where that isn't empty and is the session's only one of that name;
    the others get r1, r2, ... in order of ``rel_pos`` (a whole number, unique in the session), skipping names in use."""
    own = relations.filter(F.length("id") > 0).groupBy("session", "id").agg((F.count("*") == 1).alias("__keep"))
    counted = relations.join(own, ["session", "id"], "left").withColumn("__keep", F.coalesce("__keep", F.lit(False)))
    kept = counted.filter("__keep")
    taken = kept.select("session", F.expr("CASE WHEN id RLIKE '^r[1-9][0-9]{0,17}$' THEN CAST(substr(id, 2) AS BIGINT) END").alias("__k")).filter("__k IS NOT NULL")
    rest = running_total(counted.filter("NOT __keep").withColumn("__one", F.lit(1)), ["session"], "rel_pos", "__one", "__i").withColumn("__i", F.col("__i") + 1)
    numbered = nth_free(rest, taken, ["session"], "__i", "__k", "__free").withColumn("rel_id", F.concat(F.lit("r"), F.col("__free").cast("string")))
    columns = [*relations.columns, "rel_id"]
    return kept.withColumn("rel_id", F.col("id")).select(columns).unionByName(numbered.select(columns))


def statement_terms(statements: DataFrame, extracted: DataFrame, most: int = 6) -> DataFrame:
    """Statements with ``terms``: their own where they have any, else the first ``most`` of ``extracted`` (``session``,
    ``id``, ``word``, ``rank``)."""
    found = extracted.filter(F.col("rank") <= most).groupBy("session", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("__found"))
    own = F.coalesce(F.size("terms"), F.lit(0)) > 0
    return statements.join(found, ["session", "id"], "left").withColumn("terms", F.when(own, F.col("terms")).otherwise(F.coalesce("__found", F.expr("cast(array() as array<string>)")))).drop("__found")


def term_weights(statements: DataFrame) -> DataFrame:
    """``session``, ``term``, ``weight``: how many statements hold the term (repeats in one count once, nulls don't)."""
    rows = statements.select("session", F.explode(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL")
    return rows.groupBy("session", "term").agg(F.count("*").alias("weight"))


def term_edges(statements: DataFrame, least: int = 2) -> DataFrame:
    """``session``, ``a`` < ``b``, ``weight``: terms that share at least ``least`` statements."""
    sets = statements.select("session", F.array_sort(F.filter(F.array_distinct("terms"), lambda t: t.isNotNull())).alias("ws"))
    pairs = F.explode(F.flatten(F.transform("ws", lambda x: F.transform(F.filter("ws", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return sets.select("session", pairs.alias("p")).groupBy("session", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``session``, ``term``, ``component``: the smallest term each term is connected to (itself, if to none).

    Rounds of taking the smallest label among the neighbours and then the label of one's label, which halves what is
    left of a chain; each round is written once, and only a count of changes comes to the driver. Labels only ever get
    smaller, so the rounds end.
    """
    both = edges.select("session", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select("session", F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = checkpoint(both)
    # The first round needs no join: a term's label is the smallest of itself and its neighbours.
    first = nodes.select("session", F.col("term").alias("x"), F.col("term").alias("l")).unionByName(both.select("session", "x", F.col("y").alias("l")))
    labels = checkpoint(first.groupBy("session", "x").agg(F.min("l").alias("l")))
    linked = labels.join(both.select("session", "x").distinct(), ["session", "x"], "left_semi")  # the rest is settled
    alone = labels.join(both.select("session", "x").distinct(), ["session", "x"], "left_anti")
    while True:
        near = both.join(linked.withColumnRenamed("x", "y"), ["session", "y"]).groupBy("session", "x").agg(F.min("l").alias("near"))
        step = linked.join(near, ["session", "x"], "left").withColumn("to", F.least("l", F.coalesce("near", "l")))
        jump = step.select("session", F.col("x").alias("to"), F.col("to").alias("further"))
        step = step.join(jump, ["session", "to"], "left").select("session", "x", F.least("to", F.coalesce("further", "to")).alias("l"), (F.least("to", F.coalesce("further", "to")) < F.col("l")).alias("moved"))
        step = checkpoint(step)
        linked = step.drop("moved")
        if step.filter("moved").isEmpty():
            return linked.unionByName(alone).select("session", F.col("x").alias("term"), F.col("l").alias("component"))


def propagate_labels(nodes: list[str], edges: list[tuple[str, str, int]], passes: int = 10) -> dict[str, str]:
    """Weighted label propagation over one component: nodes in order take their neighbours' heaviest label at once (so
    later nodes see it), ties to the label of the smallest node; a cluster is named by the node its label came from."""
    near: dict[str, list[tuple[str, int]]] = {n: [] for n in nodes}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    order = sorted(nodes)
    label = {n: n for n in order}
    for _ in range(passes):
        settled = True
        for n in order:
            weight: dict[str, int] = {}
            for m, w in near[n]:
                weight[label[m]] = weight.get(label[m], 0) + w
            if weight:
                heaviest = max(weight.values())
                best = min(x for x, w in weight.items() if w == heaviest)
                settled, label[n] = settled and best == label[n], best
        if settled:
            break
    return label


def term_clusters(weights: DataFrame, edges: DataFrame, *, largest: int = 12, passes: int = 10) -> DataFrame:
    """``session``, ``term``, ``cluster``, ``weight``: connected components, those of more than ``largest`` terms cut
    further by label propagation (one component per group); clusters of one term met once are dropped."""
    weights, edges = checkpoint(weights), checkpoint(edges)
    parts = checkpoint(connected_components(weights.select("session", "term"), edges).join(weights, ["session", "term"]))
    size = parts.groupBy("session", "component").agg(F.count("*").alias("size"))
    parts = parts.join(size, ["session", "component"])
    big = parts.filter(F.col("size") > largest).select("session", "component", "term")
    inside = edges.join(big.withColumnRenamed("term", "a"), ["session", "a"]).select("session", "component", "a", "b", F.col("weight").cast("long").alias("w"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["a"], pdf["b"], pdf["w"], strict=True))
        label = propagate_labels(sorted({x for a, b, _ in rows for x in (a, b)}), rows, passes)
        return pd.DataFrame({"session": pdf["session"].iloc[0], "term": list(label), "cluster": list(label.values())})

    kind = weights.schema["session"].dataType.simpleString()
    refined = inside.groupBy("session", "component").applyInPandas(cut, f"session {kind}, term string, cluster string").join(weights, ["session", "term"])
    whole = parts.filter(F.col("size") <= largest).select("session", "term", F.col("component").alias("cluster"), "weight")
    every = whole.unionByName(refined.select("session", "term", "cluster", "weight"))
    lone = every.groupBy("session", "cluster").agg(F.count("*").alias("c"), F.max("weight").alias("m")).filter("c > 1 OR m >= 2")
    return checkpoint(every.join(lone.select("session", "cluster"), ["session", "cluster"], "left_semi"))


def topics(clusters: DataFrame) -> DataFrame:
    """``session``, ``topic_id`` (t1, t2, ... by total weight, then smallest term), ``label`` (heaviest term, ties to the
    largest), ``cluster``."""
    t = clusters.groupBy("session", "cluster").agg(F.sum("weight").alias("total"), F.min("term").alias("first"), F.max(F.struct("weight", "term"))["term"].alias("label"))
    n = F.row_number().over(W.partitionBy("session").orderBy(F.desc("total"), F.asc("first")))
    return t.select("session", F.concat(F.lit("t"), n.cast("string")).alias("topic_id"), "label", "cluster")


def assign_topics(statements: DataFrame, clusters: DataFrame, topic_list: DataFrame) -> DataFrame:
    """``session``, ``id``, ``topic_id``: of the topics of a statement's terms (repeats count) the heaviest; ties go to
    the smaller id as text. Statements without a clustered term are left out."""
    of = clusters.join(topic_list.select("session", "cluster", "topic_id"), ["session", "cluster"]).select("session", "term", "topic_id", "weight")
    rows = statements.select("session", "id", F.explode("terms").alias("term")).join(of, ["session", "term"])
    weight = rows.groupBy("session", "id", "topic_id").agg(F.sum("weight").alias("w"))
    return weight.groupBy("session", "id").agg(F.min(F.struct((-F.col("w")).alias("w"), "topic_id"))["topic_id"].alias("topic_id"))


def topic_members(assigned: DataFrame, topic_list: DataFrame, statements: DataFrame) -> DataFrame:
    """Topics that have a statement: ``session``, ``topic_id``, ``label``, ``statement_ids`` in order of ``stmt_pos``."""
    rows = assigned.join(statements.select("session", "id", "stmt_pos"), ["session", "id"])
    ids = rows.groupBy("session", "topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stmt_pos", "id"))), lambda x: x["id"]).alias("statement_ids"))
    return topic_list.select("session", "topic_id", "label").join(ids, ["session", "topic_id"])


def topic_of_statements(statements: DataFrame, topic_list: DataFrame) -> DataFrame:
    """Statements with ``topic_id`` from the first topic (by ``topic_ord``) that lists them, else their own."""
    listed = topic_list.select("session", "topic_ord", F.col("id").alias("__topic"), F.explode("statement_ids").alias("id")).groupBy("session", "id").agg(F.min_by("__topic", "topic_ord").alias("__topic"))
    return statements.join(listed, ["session", "id"], "left").withColumn("topic_id", F.coalesce("__topic", "topic_id")).drop("__topic")


def acyclic(edges: list[tuple[str, str, str, float]]) -> list[int]:
    """Positions of the edges (source, target, type, confidence) that are kept so that no cycle is left.

    A depth-first search from the smallest source, over edges in order of (source, target, type), finds a cycle; its edge
    with the smallest (confidence, source, target) goes; and so on until the search finds none.

    The search isn't begun anew after a cycle. What it has left behind reaches no cycle and can be part of none, so it
    takes back its trail to the edge that goes and carries on from there; each node keeps its place among its edges, as
    those before it lead to nodes left behind or are gone. The time is that of sorting, plus the cycles' lengths.
    """
    out: dict[str, list[int]] = {}
    for i in sorted(range(len(edges)), key=lambda i: edges[i][:3] + (i,)):
        out.setdefault(edges[i][0], []).append(i)
    place = dict.fromkeys(out, 0)  # of each node's edges, the one to follow next
    done: set[str] = set()
    gone: set[int] = set()
    for root in out:
        if root in done:
            continue
        trail: list[int] = []  # edges from the root to the current node
        nodes, depth = [root], {root: 0}
        while nodes:
            node = nodes[-1]
            if node not in out or place[node] == len(out[node]):
                nodes.pop()
                done.add(node)
                del depth[node]
                if trail:
                    place[edges[trail.pop()][0]] += 1
                continue
            step = out[node][place[node]]
            target = edges[step][1]
            if target in done:
                place[node] += 1
            elif target not in depth:
                depth[target] = len(nodes)
                nodes.append(target)
                trail.append(step)
            else:
                worst = min([*trail[depth[target] :], step], key=lambda i: (edges[i][3], edges[i][0], edges[i][1]))
                gone.add(worst)
                source = edges[worst][0]
                place[source] += 1
                for other in nodes[depth[source] + 1 :]:
                    del depth[other]
                del nodes[depth[source] + 1 :], trail[depth[source] :]
    return [i for i in range(len(edges)) if i not in gone]


def break_cycles(relations: DataFrame) -> DataFrame:
    """Relations without those that :func:`acyclic` drops, session by session (the search is sequential)."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rel_pos", kind="stable")
        rows = list(zip(pdf["source"], pdf["target"], pdf["type"], pdf["confidence"], strict=True))
        return pdf.iloc[acyclic(rows)]

    return relations.groupBy("session").applyInPandas(keep, relations.schema)
