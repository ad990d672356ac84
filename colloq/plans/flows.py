"""Decision flows made of the statements of each topic, some of them with offences, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.operators import discourse, flows
from colloq.plans.discourse import _RELATIONS, _statements, _topics, marker_relations


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow for each topic of each session: a question on its first statement, options on the first three, arguments
    on the second to fifth, an outcome on the second; and one on a topic that doesn't exist."""
    arr = F.array_sort(F.collect_list(F.struct("stmt_pos", "id")))
    rows = _statements(spark, sf_dir).filter("topic_id IS NOT NULL").groupBy("session", "topic_id").agg(arr.alias("arr")).withColumn("n", F.size("arr"))
    text = lambda x: F.lit(x).cast("string")
    number = lambda i, by: (i + by).cast("string")
    rows = rows.select(
        "session",
        F.substring("topic_id", 2, 9).cast("int").alias("flow_ord"),
        "topic_id",
        F.array(F.struct(text("q1").alias("id"), text("").alias("summary"), F.col("arr")[0]["id"].alias("statement_id"))).alias("questions"),
        F.transform(F.slice("arr", 1, 3), lambda x, i: F.struct(F.concat(F.lit("o"), number(i, 1)).alias("id"), text("").alias("label"), text("").alias("summary"), F.array(x["id"]).alias("statement_ids"), x["id"].alias("introduced_by"), F.when(x["stmt_pos"] % 10 == 0, "lost").otherwise("unresolved").alias("status"))).alias("options"),
        F.transform(F.slice("arr", 2, 4), lambda x, i: F.struct(F.concat(F.lit("a"), number(i, 2)).alias("id"), F.when(x["stmt_pos"] % 9 == 0, "s0").otherwise(x["id"]).alias("statement_id"), F.concat(F.lit("o"), number(i, 1)).alias("option_id"), F.when(i % 2 == 0, "pro").otherwise("con").alias("stance"), F.array(F.concat(F.lit("r"), number(i, 2))).alias("relation_ids"))).alias("arguments"),
        F.when(F.col("n") >= 2, F.struct(text("decided").alias("status"), F.when(F.col("n") % 2 == 0, "hybrid").otherwise("single_option").alias("kind"), text("").alias("summary"), F.col("arr")[F.when(F.col("n") >= 2, 1).otherwise(0)]["id"].alias("statement_id"), F.when(F.col("n") % 4 == 0, F.array(F.lit("o1"), F.lit("o2"))).when(F.col("n") % 2 == 0, F.array(F.lit("o1"))).otherwise(F.array(F.lit("o2"))).alias("selected_option_ids"), F.array(F.col("arr")[0]["id"]).alias("rationale_statement_ids"))).alias("outcome"),
        F.when(F.col("n") % 8 == 3, "sure").otherwise("high").alias("confidence"),
        F.expr("cast(array() as array<string>)").alias("warnings"),
    )
    return rows.unionByName(rows.filter("topic_id = 't1'").withColumns({"flow_ord": F.col("flow_ord") + 1000, "topic_id": F.lit("nope")}))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).withColumn("topic_ord", F.substring("id", 2, 9).cast("int"))


def flow_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flow_violations(_flows(spark, sf_dir), _statements(spark, sf_dir), _listed(spark, sf_dir))


def flows_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = discourse.relation_ids(marker_relations(spark, sf_dir).withColumn("id", F.lit(""))).select("session", F.col("rel_id").alias("id"), "type")
    found = flows.valid_flows(_flows(spark, sf_dir), _statements(spark, sf_dir), _listed(spark, sf_dir), relations)
    return found.select("session", "flow_ord", "topic_id", F.array_join("warnings", "; ").alias("warnings_text"))


_FLOWS = """b AS (SELECT DISTINCT session_id AS session, stmt_no AS pos, id, utterance_index AS utt, topic_id AS topic FROM statements WHERE topic_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY session, topic ORDER BY pos) AS k, count(*) OVER (PARTITION BY session, topic) AS n FROM b),
fl0 AS (SELECT session, topic, max(n) AS n, CAST(substr(topic, 2) AS INTEGER) AS flow_ord, topic AS topic_id FROM k GROUP BY session, topic),
fl AS (SELECT * FROM fl0 UNION ALL SELECT session, topic, n, flow_ord + 1000, 'nope' FROM fl0 WHERE topic = 't1'),
ki AS (SELECT fl.session, flow_ord, topic_id, fl.n, k, pos, id, utt FROM fl JOIN k ON k.session = fl.session AND k.topic = fl.topic),
refs AS (SELECT session, flow_ord, topic_id, id AS sid FROM ki WHERE k <= 3 UNION SELECT session, flow_ord, topic_id, CASE WHEN pos % 9 = 0 THEN 's0' ELSE id END FROM ki WHERE k BETWEEN 2 AND 5),
bad AS (SELECT session, flow_ord, 'statement is not of the topic' AS rule, sid AS key FROM refs WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.session = refs.session AND b.id = refs.sid AND b.topic = refs.topic_id)
  UNION SELECT session, flow_ord, 'unknown topic', topic_id FROM fl WHERE topic_id = 'nope'
  UNION SELECT session, flow_ord, 'unknown confidence', 'sure' FROM fl WHERE n % 8 = 3
  UNION SELECT session, flow_ord, 'unknown option status', 'o' || k FROM ki WHERE k <= 3 AND pos % 10 = 0
  UNION SELECT session, flow_ord, 'argument on an unknown option', 'a' || k FROM ki WHERE k BETWEEN 2 AND 5 AND k - 1 > least(n, 3)
  UNION SELECT session, flow_ord, 'wrong number of selected options', '1' FROM fl WHERE n >= 2 AND n % 4 = 2)"""
QUERIES = {"flow_violations": flow_violations, "flows_valid": flows_valid}
SQL = {
    "flow_violations": f"WITH {_FLOWS} SELECT * FROM bad",
    "flows_valid": f"""WITH {_RELATIONS}, {_FLOWS},
rr AS (SELECT session, 'r' || row_number() OVER (PARTITION BY session ORDER BY rel_pos) AS rid, type FROM rel),
good AS (SELECT * FROM fl WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.session = fl.session AND bad.flow_ord = fl.flow_ord)),
arg AS (SELECT ki.session, flow_ord, k, rr.type FROM ki LEFT JOIN rr ON rr.session = ki.session AND rid = 'r' || k WHERE k BETWEEN 2 AND 5),
late AS (SELECT session, flow_ord, min(CASE WHEN k = 2 THEN utt END) < min(CASE WHEN k <= 3 THEN utt END) AS is_late FROM ki GROUP BY ALL),
told AS (SELECT session, flow_ord, 1 AS part, n AS o, 'option o' || n || ' has no argument' AS msg FROM good WHERE n <= 3
  UNION ALL SELECT session, flow_ord, 2, 2 * k, 'argument a' || k || ' references no known relation' FROM arg WHERE type IS NULL
  UNION ALL SELECT session, flow_ord, 2, 2 * k + 1, 'con argument a' || k || ' cites a supports relation' FROM arg WHERE type = 'supports' AND k % 2 = 1
  UNION ALL SELECT session, flow_ord, 3, 2, 'selected option o2 has only con arguments' FROM good WHERE n >= 3
  UNION ALL SELECT session, flow_ord, 4, 0, 'outcome precedes option discussion' FROM late WHERE is_late)
SELECT g.session, g.flow_ord, topic_id, coalesce(string_agg(msg, '; ' ORDER BY part, o), '') AS warnings_text FROM good g LEFT JOIN told ON told.session = g.session AND told.flow_ord = g.flow_ord GROUP BY ALL""",
}
