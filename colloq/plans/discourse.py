"""Statements, relations and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions import lexicons
from colloq.operators import discourse, keywords, overlay
from colloq.plans.sql import sql_list, sql_trim
from colloq.session import checkpoint, table


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "utterances").select("session_id", "utt_id", "utt_index", "speaker", "text").distinct()


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements").distinct()
    return rows.select(F.col("session_id").alias("session"), F.col("stmt_no").alias("stmt_pos"), "id", "utterance_index", "speaker", "text", "terms", "topic_id")


def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.split_statements(_utterances(spark, sf_dir), "session_id", "utt_index")


def marker_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.marker_relations(split_statements(spark, sf_dir))


def validate_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discourse.valid_statements(_statements(spark, sf_dir), table(spark, sf_dir, "utterances"), "session_id", "utt_index")
    return found.select("session", "id", "utterance_index", "speaker", "text")


def _noisy_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker relations among some that a check must drop: unknown ends and types, loops, repeats, odd confidences."""
    r = marker_relations(spark, sf_dir)
    bad = r.select("session", (F.col("rel_pos") + 1_000_000).alias("rel_pos"), "source", F.when(F.col("rel_pos") % 3 == 0, F.col("source")).when(F.col("rel_pos") % 3 == 1, F.lit("s0")).otherwise(F.col("target")).alias("target"), F.when(F.col("rel_pos") % 2 == 0, F.lit("supports")).otherwise(F.lit("mentions")).alias("type"), (F.col("confidence") * 5).alias("confidence"), "marker", "rule")
    return r.unionByName(bad)


def validate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.valid_relations(_noisy_relations(spark, sf_dir), split_statements(spark, sf_dir))


def relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("rel_pos") % 4 == 0, F.concat(F.lit("r"), (F.col("rel_pos") / 4).cast("bigint").cast("string"))).when(F.col("rel_pos") % 4 == 1, F.lit("same")).otherwise(F.lit(""))
    return discourse.relation_ids(marker_relations(spark, sf_dir).withColumn("id", own)).select("session", "rel_pos", "id", "rel_id")


def relations_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid relations and, for each pair of statements, one the other way round, weaker or stronger than all of them."""
    r = validate_relations(spark, sf_dir)
    turned = r.groupBy("session", F.col("target").alias("source"), F.col("source").alias("target")).agg(F.lit("elaborates").alias("type"), (F.min("rel_pos") + 2_000_000).alias("rel_pos"), F.when(F.min("rel_pos") % 2 == 0, F.lit(0.01)).otherwise(F.lit(2.0)).alias("confidence"), F.lit("").alias("marker"), F.lit("turned").alias("rule"))
    return discourse.break_cycles(checkpoint(r.unionByName(turned)))


def statement_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statements(spark, sf_dir)
    found = keywords.terms(rows.filter(F.coalesce(F.size("terms"), F.lit(0)) == 0), ["session", "id"], "text", 6)
    return discourse.statement_terms(rows, found).select("session", "id", F.array_join("terms", "|").alias("terms_text"))


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.term_weights(_statements(spark, sf_dir))


def term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.term_edges(_statements(spark, sf_dir))


def term_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.connected_components(term_weights(spark, sf_dir), term_edges(spark, sf_dir))


def _clusters(spark: SparkSession, sf_dir: str, largest: int = 10**9) -> DataFrame:
    return discourse.term_clusters(term_weights(spark, sf_dir), term_edges(spark, sf_dir), largest=largest)


def topic_clusters_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with large components cut by label propagation."""
    return discourse.topics(_clusters(spark, sf_dir, largest=12))


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.topics(_clusters(spark, sf_dir))


def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = _clusters(spark, sf_dir)
    return discourse.assign_topics(_statements(spark, sf_dir), clusters, discourse.topics(clusters))


def topic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, rows = _clusters(spark, sf_dir), _statements(spark, sf_dir)
    found = discourse.topics(clusters)
    members = discourse.topic_members(discourse.assign_topics(rows, clusters, found), found, rows)
    return members.select("session", "topic_id", "label", F.array_join("statement_ids", ",").alias("members"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements' own topics as a list with members."""
    rows = _statements(spark, sf_dir).filter("topic_id IS NOT NULL")
    members = F.transform(F.array_sort(F.collect_list(F.struct("stmt_pos", "id"))), lambda x: x["id"])
    return rows.groupBy("session", F.col("topic_id").alias("id")).agg(members.alias("statement_ids")).withColumn("label", F.col("id"))


def validate_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics among some that a check must drop: unknown members, topics of such only, topics without a label."""
    own, unknown = _topics(spark, sf_dir), F.array(F.lit("s0"), F.lit("nobody"))
    listed = own.withColumn("statement_ids", F.concat(F.slice(unknown, 1, 1), "statement_ids", unknown))
    bare = own.withColumns({"label": F.lit(""), "id": F.concat(F.lit("bare "), "id")})
    lone = own.withColumns({"statement_ids": unknown, "id": F.concat(F.lit("lone "), "id")})
    return discourse.valid_topics(listed.unionByName(bare).unionByName(lone), _statements(spark, sf_dir)).select("session", "id", "label", F.array_join("statement_ids", ",").alias("members"))


def topic_of_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _topics(spark, sf_dir).withColumn("topic_ord", F.substring("id", 2, 9).cast("int")).filter("id <> 't2'")
    return discourse.topic_of_statements(_statements(spark, sf_dir), listed).select("session", "id", "topic_id")


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """An overlay over each session's term graph, with offences of most kinds in it."""
    w, e = checkpoint(term_weights(spark, sf_dir)), checkpoint(term_edges(spark, sf_dir))
    base = w.filter("weight >= 2").select("session", F.col("term").alias("id"))
    base_edges = e.select("session", "a", "b")
    nodes = w.filter("weight = 1 OR weight = 4").select("session", F.col("term").alias("id"))
    edges = e.filter("weight = 2").select("session", F.col("b").alias("a"), F.concat("a", F.lit("*")).alias("b")).unionByName(base_edges.join(w.filter("weight = 5").select("session", F.col("term").alias("a")), ["session", "a"], "left_semi"))
    hidden = w.filter("weight = 3 OR weight = 1").select("session", F.col("term").alias("id"))
    hidden_edges = e.filter("weight = 3").select("session", F.col("b").alias("a"), F.col("a").alias("b")).unionByName(w.filter("weight = 7").select("session", F.col("term").alias("a"), F.col("term").alias("b")))
    return base, base_edges, nodes, edges, hidden, hidden_edges


def overlay_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, nodes, _, hidden, _ = _overlay(spark, sf_dir)
    return overlay.visible_ids(base, hidden, nodes)


def overlay_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay_violations(*_overlay(spark, sf_dir))


_ENDERS = "。！？!?"
_SPLIT = f"""u AS (SELECT DISTINCT session_id, utt_id, utt_index, speaker, text FROM utterances WHERE text IS NOT NULL),
x AS (SELECT session_id, utt_index, speaker, string_split(regexp_replace(text, '([{_ENDERS}\\n])', '\\1' || chr(31), 'g'), chr(31)) AS ps FROM u),
y AS (SELECT session_id, utt_index, speaker, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM x),
z AS (SELECT session_id, utt_index, speaker, i, {sql_trim('raw')} AS s FROM y),
q AS (SELECT * FROM z WHERE length(regexp_replace(s, '^[{_ENDERS}\\n]+|[{_ENDERS}\\n]+$', '', 'g')) > 0),
c AS (SELECT session_id, utt_index, speaker, i, s, string_split(regexp_replace(s, '、({'|'.join(lexicons.SPLIT_CONNECTIVES)})', '、' || chr(30) || '\\1', 'g'), chr(30)) AS fs FROM q),
d AS (SELECT session_id, utt_index, speaker, i, unnest(fs) AS raw, generate_subscripts(fs, 1) AS j FROM c),
f AS (SELECT session_id, utt_index, speaker, i, j, {sql_trim('raw')} AS t FROM d),
st AS (SELECT session_id AS session, row_number() OVER (PARTITION BY session_id ORDER BY utt_index, i, j) AS stmt_pos, utt_index AS utterance_index, speaker, t AS text
       FROM f WHERE length(regexp_replace(t, '^、+|、+$', '', 'g')) > 0),
s AS (SELECT session, stmt_pos, 's' || stmt_pos AS id, utterance_index, speaker, text FROM st)"""


def _case(value: int) -> str:
    def lit(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower()

    whens = " ".join(f"WHEN starts_with(body, '{r[0]}') THEN {lit(r[value])}" for r in lexicons.MARKER_RULES)
    return f"CASE {whens} END"


_RELATIONS = f"""{_SPLIT},
l AS (SELECT *, regexp_replace(text, '^[、。 　]+', '') AS body, lag(id) OVER o AS prev, lag(utterance_index) OVER o AS prev_utt, lag(speaker) OVER o AS prev_speaker FROM s WINDOW o AS (PARTITION BY session ORDER BY stmt_pos)),
m AS (SELECT *, {_case(0)} AS marker, {_case(1)} AS type, {_case(2)} AS cur, {_case(3)} AS c, {_case(4)} AS r, (utterance_index <> prev_utt AND speaker IS DISTINCT FROM prev_speaker) AS opens FROM l),
rel AS (SELECT session, stmt_pos AS rel_pos, CASE WHEN cur THEN id ELSE prev END AS source, CASE WHEN cur THEN prev ELSE id END AS target, type,
          CAST(CASE WHEN type <> 'contrasts' THEN c WHEN opens THEN greatest(c, 0.65) ELSE 0.45 END AS DOUBLE) AS confidence, marker,
          CASE WHEN type = 'contrasts' AND NOT opens AND r <> 'weak_contrast' THEN 'same_turn_contrast' ELSE r END AS rule
        FROM m WHERE prev IS NOT NULL AND marker IS NOT NULL)"""
_ST = "st AS (SELECT DISTINCT session_id AS session, stmt_no AS stmt_pos, id, utterance_index, speaker, text, terms, topic_id FROM statements)"
_WEIGHTS = f"""{_ST},
tt AS (SELECT DISTINCT session, stmt_pos, unnest(terms) AS term FROM st), te AS (SELECT * FROM tt WHERE term IS NOT NULL),
w AS (SELECT session, term, count(*) AS weight FROM te GROUP BY ALL),
e AS (SELECT x.session, x.term AS a, y.term AS b, count(*) AS weight FROM te x JOIN te y ON x.session = y.session AND x.stmt_pos = y.stmt_pos AND x.term < y.term GROUP BY ALL HAVING count(*) >= 2)"""
_OVERLAY = f"""{_WEIGHTS},
base AS (SELECT session, term AS id FROM w WHERE weight >= 2), nodes AS (SELECT session, term AS id FROM w WHERE weight = 1 OR weight = 4),
hidden AS (SELECT session, term AS id FROM w WHERE weight = 3 OR weight = 1), be AS (SELECT session, a, b FROM e),
ne0 AS (SELECT session, b AS a, a || '*' AS b FROM e WHERE weight = 2 UNION ALL SELECT be.session, a, b FROM be JOIN w ON w.session = be.session AND w.term = be.a AND w.weight = 5),
he0 AS (SELECT session, b AS a, a AS b FROM e WHERE weight = 3 UNION ALL SELECT session, term, term FROM w WHERE weight = 7),
ne AS (SELECT session, least(a, b) AS a, greatest(a, b) AS b FROM ne0), he AS (SELECT session, least(a, b) AS a, greatest(a, b) AS b FROM he0),
vis AS (SELECT session, id FROM base ANTI JOIN hidden USING (session, id) UNION SELECT session, id FROM nodes)"""
_BADID = f"NOT coalesce(length({sql_trim('id')}) BETWEEN 1 AND 120, false)"
_DUP = "GROUP BY ALL HAVING count(*) > 1"


def _rule(name: str, key: str, source: str) -> str:
    return f"SELECT session, '{name}' AS rule, CAST({key} AS VARCHAR) AS key FROM {source}"


_RULES = " UNION ".join(
    [
        *(_rule(f"invalid {n} id", "id", f"{t} WHERE {_BADID}") for n, t in (("node", "nodes"), ("hidden node", "hidden"))),
        *(_rule(f"duplicate {n}", "id", f"(SELECT session, id FROM {t} {_DUP})") for n, t in (("node", "nodes"), ("hidden node", "hidden"))),
        *(_rule(f"{n} to itself", "a || '|' || b", f"{t} WHERE a = b") for n, t in (("edge", "ne"), ("hidden edge", "he"))),
        *(_rule(f"duplicate {n}", "a || '|' || b", f"(SELECT session, a, b FROM {t} {_DUP})") for n, t in (("edge", "ne"), ("hidden edge", "he"))),
        *(_rule(f"too many {n}", "c", f"(SELECT session, count(*) AS c FROM {t} GROUP BY ALL HAVING count(*) > {m})") for n, t, m in (("nodes", "nodes", 100), ("edges", "ne", 250), ("hidden nodes", "hidden", 250), ("hidden edges", "he", 250))),
        _rule("node is in the base", "id", "(SELECT * FROM nodes SEMI JOIN base USING (session, id))"),
        _rule("hidden node is unknown", "id", "(SELECT * FROM hidden ANTI JOIN base USING (session, id))"),
        _rule("edge end is not visible", "a || '|' || b", "(SELECT * FROM (SELECT session, a, b, unnest([a, b]) AS id FROM ne) ANTI JOIN vis USING (session, id))"),
        _rule("edge is in the base", "a || '|' || b", "(SELECT * FROM ne SEMI JOIN be USING (session, a, b))"),
        _rule("hidden edge is unknown", "a || '|' || b", "(SELECT * FROM he ANTI JOIN be USING (session, a, b))"),
        _rule("hidden edge has a hidden end", "a || '|' || b", "(SELECT * FROM (SELECT session, a, b, unnest([a, b]) AS id FROM he) SEMI JOIN hidden USING (session, id))"),
    ]
)
_TOPICS = f"{_ST}, tp AS (SELECT session, topic_id AS tid, topic_id AS label FROM st WHERE topic_id IS NOT NULL GROUP BY ALL)"

_TOPIC_LIST = f"""{_WEIGHTS}, b AS (SELECT session, a AS x, b AS y FROM e UNION SELECT session, b, a FROM e),
reach AS (SELECT session, term, term AS r FROM w UNION SELECT reach.session, term, y FROM reach JOIN b ON b.session = reach.session AND b.x = reach.r),
comp AS (SELECT session, term, min(r) AS cluster FROM reach GROUP BY ALL),
cl AS (SELECT comp.session, comp.term, cluster, weight FROM comp JOIN w USING (session, term)),
good AS (SELECT session, cluster, sum(weight) AS total, min(term) AS first, arg_max(term, (weight, term)) AS label FROM cl GROUP BY ALL HAVING count(*) > 1 OR max(weight) >= 2),
topic AS (SELECT session, 't' || row_number() OVER (PARTITION BY session ORDER BY total DESC, first) AS topic_id, label, cluster FROM good)"""
_ASSIGNED = f"""{_TOPIC_LIST}, every AS (SELECT session, id, unnest(terms) AS term FROM st),
hit AS (SELECT every.session, every.id, topic.topic_id, sum(cl.weight) AS wt FROM every JOIN cl USING (session, term) JOIN topic ON topic.session = cl.session AND topic.cluster = cl.cluster GROUP BY ALL),
assigned AS (SELECT session, id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY wt DESC, topic_id) AS k FROM hit) WHERE k = 1)"""

QUERIES = {
    "split_statements": split_statements,
    "marker_relations": marker_relations,
    "validate_statements": validate_statements,
    "validate_relations": validate_relations,
    "validate_topics": validate_topics,
    "relation_ids": relation_ids,
    "relations_acyclic": relations_acyclic,
    "statement_terms": statement_terms,
    "term_weights": term_weights,
    "term_edges": term_edges,
    "term_components": term_components,
    "topic_clusters": topic_clusters,
    "topic_clusters_refined": topic_clusters_refined,
    "topic_assignment": topic_assignment,
    "topic_members": topic_members,
    "topic_of_statements": topic_of_statements,
    "overlay_visible": overlay_visible,
    "overlay_violations": overlay_violations,
}
_NOISY = f"""{_RELATIONS}, noisy AS (SELECT * FROM rel UNION ALL SELECT session, rel_pos + 1000000, source, CASE rel_pos % 3 WHEN 0 THEN source WHEN 1 THEN 's0' ELSE target END,
  CASE WHEN rel_pos % 2 = 0 THEN 'supports' ELSE 'mentions' END, confidence * 5, marker, rule FROM rel),
ok AS (SELECT *, row_number() OVER (PARTITION BY session, source, target, type ORDER BY rel_pos) AS k FROM noisy n
  WHERE type IN ('supports', 'causes', 'elaborates', 'contrasts') AND source <> target
    AND EXISTS (SELECT 1 FROM s WHERE s.session = n.session AND s.id = n.source) AND EXISTS (SELECT 1 FROM s WHERE s.session = n.session AND s.id = n.target))"""
SQL = {
    "split_statements": f"WITH {_SPLIT} SELECT * FROM s",
    "marker_relations": f"WITH {_RELATIONS} SELECT * FROM rel",
    "validate_statements": f"""WITH {_ST}, u AS (SELECT session_id, utt_index, max(speaker) AS spk FROM utterances GROUP BY ALL)
SELECT session, id, utterance_index, CASE WHEN length(speaker) > 0 THEN speaker ELSE spk END AS speaker, text FROM st JOIN u ON u.session_id = st.session AND u.utt_index = st.utterance_index WHERE length({sql_trim('text')}) > 0""",
    "validate_relations": f"WITH {_NOISY} SELECT session, source, target, type, rel_pos, least(1.0, greatest(0.0, confidence)) AS confidence, marker, rule FROM ok WHERE k = 1",
    "validate_topics": f"""WITH {_TOPICS} SELECT tp.session, tid AS id, label, string_agg(st.id, ',' ORDER BY stmt_pos) AS members
FROM tp JOIN st ON st.session = tp.session AND st.topic_id = tid GROUP BY ALL""",
    "relation_ids": f"""WITH {_RELATIONS}, own AS (SELECT session, rel_pos, CASE rel_pos % 4 WHEN 0 THEN 'r' || (rel_pos // 4) WHEN 1 THEN 'same' ELSE '' END AS id FROM rel),
marked AS (SELECT *, id <> '' AND count(*) OVER (PARTITION BY session, id) = 1 AS keep FROM own),
amount AS (SELECT session, count(*) AS m FROM own GROUP BY ALL), numbers AS (SELECT session, unnest(generate_series(1, 2 * m)) AS k FROM amount),
free AS (SELECT n.session, k, row_number() OVER (PARTITION BY n.session ORDER BY k) AS place FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM marked w WHERE w.session = n.session AND keep AND w.id = 'r' || k)),
rest AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rel_pos) AS place FROM marked WHERE NOT keep)
SELECT session, rel_pos, id, id AS rel_id FROM marked WHERE keep UNION ALL SELECT rest.session, rel_pos, id, 'r' || k FROM rest JOIN free USING (session, place)""",
    "relations_acyclic": f"""WITH {_NOISY}, r AS (SELECT session, source, target, type, rel_pos, least(1.0, greatest(0.0, confidence)) AS confidence, marker, rule FROM ok WHERE k = 1),
p AS (SELECT session, source, target, min(rel_pos) AS pos FROM r GROUP BY ALL)
SELECT r.* FROM r JOIN p USING (session, source, target) WHERE pos % 2 = 0
UNION ALL SELECT session, target, source, 'elaborates', pos + 2000000, 2.0, '', 'turned' FROM p WHERE pos % 2 <> 0""",
    "statement_terms": f"""WITH {_ST}, own AS (SELECT session, id, text, terms FROM st), bare AS (SELECT session, id, text FROM own WHERE coalesce(len(terms), 0) = 0 AND text IS NOT NULL),
ww AS (SELECT session, id, unnest(list_concat(list_concat(regexp_extract_all(text, '{lexicons.KEYWORD_PATTERNS[0]}'), regexp_extract_all(text, '{lexicons.KEYWORD_PATTERNS[1]}')), regexp_extract_all(text, '{lexicons.KEYWORD_PATTERNS[2]}'))) AS word FROM bare),
cc AS (SELECT session, id, word, count(*) AS n FROM ww WHERE word NOT IN ({sql_list(lexicons.KEYWORD_STOPWORDS)}) AND lower(word) NOT IN ({sql_list(lexicons.KEYWORD_STOPWORDS)}) GROUP BY ALL),
kk AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY round(n * (1.0::DOUBLE + 0.1::DOUBLE * least(length(word), 10)), 3) DESC, word) AS k FROM cc),
gg AS (SELECT session, id, string_agg(word, '|' ORDER BY k) AS found FROM kk WHERE k <= 6 AND lower(word) NOT IN ({sql_list(lexicons.TERM_STOPWORDS + lexicons.FILLERS)}) GROUP BY ALL)
SELECT session, id, CASE WHEN coalesce(len(terms), 0) > 0 THEN coalesce(array_to_string(list_filter(terms, lambda x: x IS NOT NULL), '|'), '') ELSE coalesce(found, '') END AS terms_text FROM own LEFT JOIN gg USING (session, id)""",
    "topic_clusters": f"WITH RECURSIVE {_TOPIC_LIST} SELECT session, topic_id, label, cluster FROM topic",
    "topic_assignment": f"WITH RECURSIVE {_ASSIGNED} SELECT session, id, topic_id FROM assigned",
    "topic_members": f"""WITH RECURSIVE {_ASSIGNED} SELECT a.session, a.topic_id, t.label, string_agg(a.id, ',' ORDER BY stmt_pos) AS members
FROM assigned a JOIN st USING (session, id) JOIN topic t ON t.session = a.session AND t.topic_id = a.topic_id GROUP BY ALL""",
    "term_weights": f"WITH {_WEIGHTS} SELECT * FROM w",
    "term_edges": f"WITH {_WEIGHTS} SELECT * FROM e",
    "term_components": f"""WITH RECURSIVE {_WEIGHTS}, b AS (SELECT session, a AS x, b AS y FROM e UNION SELECT session, b, a FROM e),
reach AS (SELECT session, term, term AS r FROM w UNION SELECT reach.session, term, y FROM reach JOIN b ON b.session = reach.session AND b.x = reach.r)
SELECT session, term, min(r) AS component FROM reach GROUP BY ALL""",
    "topic_of_statements": f"""WITH {_ST} SELECT session, id, topic_id FROM st""",
    "overlay_visible": f"WITH {_OVERLAY} SELECT * FROM vis",
    "overlay_violations": f"WITH {_OVERLAY} SELECT * FROM ({_RULES})",
}
