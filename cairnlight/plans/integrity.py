"""Referential integrity and health of ledgers made of the standard tables: records of eight kinds as JSON.

Customers are beliefs, suppliers evidence, parts constraints, orders decisions and their questions, events actions and
overrides; ids are drawn so that some references have no target.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import integrity as I
from cairnlight.plans.registry import query, table

#: kind, table, line, record: expressions of both engines.
_MADE = (
    ("belief", "customer", "c_custkey", """'{"id":"b' || c_custkey || '","status":"' || lower(c_mktsegment) || '","evidence_ids":[' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '"e' || (c_custkey % 13) || '","e' || (c_custkey % 700) || '"' END || '],"pending_evidence_ids":' || CASE WHEN c_custkey % 5 = 0 THEN '["e1"]' ELSE 'null' END || ',"linked_constraints":["c' || c_custkey || '"]}'"""),
    ("evidence", "supplier", "s_suppkey", """'{"id":"e' || s_suppkey || '"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"supports_beliefs":["b' || (s_suppkey * 20) || '"]' ELSE '' END || '}'"""),
    ("constraint", "part", "p_partkey", """'{"id":"c' || (p_partkey * 2) || '","linked_beliefs":["b' || p_partkey || '"],"linked_evidence":[]}'"""),
    ("revision", "orders", "o_orderkey", """'{"id":"r' || o_orderkey || '","belief_id":"b' || o_custkey || '","triggering_evidence_ids":["e' || (o_orderkey % 40) || '"]}'"""),
    ("decision", "orders", "o_orderkey", """'{"id":"d' || o_orderkey || '","decision_id":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'D' || o_orderkey ELSE '' END || '","applied_revision_ids":["r' || (o_orderkey + 1) || '"],"decision":"' || CASE WHEN o_orderstatus = 'F' THEN 'request_action_or_read' ELSE 'no_change' END || '","human_review_required":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || '}'"""),
    ("question", "orders", "o_orderkey", """'{"id":"q' || o_orderkey || '","source_decision_id":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'd' END || o_orderkey || '","last_revision_id":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || '"}'"""),
    ("action", "events", "event_id", """'{"id":"a' || event_id || '","decision_id":"d' || event_id || '","status":"' || CASE WHEN event_type = 'error' THEN 'open' ELSE 'done' END || '"}'"""),
    ("override", "events", "event_id", """'{"id":"o' || event_id || '","target_type":"' || CASE event_id % 3 WHEN 0 THEN 'belief' WHEN 1 THEN 'paper' ELSE 'evidence' END || '","target_id":"e' || (event_id % 50) || '"}'"""),
)
#: The same as relations of the SQL twin: (from kind, target kind, id, path, message) of each reference.
_TWIN = f"""WITH b AS (SELECT c_custkey AS k, 'b' || c_custkey AS id, lower(c_mktsegment) AS status FROM customer), e AS (SELECT s_suppkey AS k, 'e' || s_suppkey AS id FROM supplier),
o AS (SELECT o_orderkey AS k, * FROM orders), v AS (SELECT event_id AS k, * FROM events),
held AS (SELECT 'belief' AS t, id FROM b UNION ALL SELECT 'evidence', id FROM e UNION ALL SELECT 'constraint', 'c' || (p_partkey * 2) FROM part UNION ALL SELECT 'revision', 'r' || k FROM o
 UNION ALL SELECT 'decision', CASE WHEN k % 2 = 0 THEN 'D' ELSE 'd' END || k FROM o),
refs AS (SELECT 'evidence' AS t, unnest(CASE WHEN k % 4 = 0 THEN [] ELSE ['e' || (k % 13), 'e' || k % 700] END || CASE WHEN k % 5 = 0 THEN ['e1'] ELSE [] END) AS id, 'beliefs.' || id || '.evidence_ids' AS path, 'unknown evidence: ' AS m, true AS named, false AS revised FROM b
 UNION ALL SELECT 'constraint', 'c' || k, 'beliefs.' || id || '.linked_constraints', 'unknown constraint: ', true, false FROM b
 UNION ALL SELECT 'belief', 'b' || (k * 20), 'evidence.' || id, 'unknown linked belief: ', true, false FROM e WHERE k % 3 = 0
 UNION ALL SELECT 'belief', 'b' || p_partkey, 'constraints.c' || (p_partkey * 2) || '.linked_beliefs', 'unknown belief: ', true, false FROM part
 UNION ALL SELECT 'belief', 'b' || o_custkey, 'revisions.r' || k || '.belief_id', 'unknown belief', false, false FROM o
 UNION ALL SELECT 'evidence', 'e' || (k % 40), 'revisions.r' || k || '.triggering_evidence_ids', 'unknown evidence: ', true, true FROM o
 UNION ALL SELECT 'assessment', 'None', 'decisions.d' || k || '.assessment_id', 'unknown assessment: ', true, false FROM o
 UNION ALL SELECT 'revision', 'r' || (k + 1), 'decisions.d' || k || '.applied_revision_ids', 'unknown revision: ', true, false FROM o
 UNION ALL SELECT 'decision', CASE WHEN k % 2 = 0 THEN 'D' ELSE 'd' END || k, 'questions.q' || k || '.source_decision_id', 'unknown decision: ', true, false FROM o
 UNION ALL SELECT 'question_revision', 'x', 'questions.q' || k || '.last_revision_id', 'unknown question revision: ', true, false FROM o WHERE k % 3 = 0
 UNION ALL SELECT 'decision', 'd' || k, 'actions.a' || k || '.decision_id', 'unknown decision: ', true, false FROM v
 UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'belief' ELSE 'evidence' END, 'e' || (k % 50), 'overrides.o' || k || '.target_id', 'unknown target', false, false FROM v WHERE k % 3 <> 1),
lost AS (SELECT path, m || CASE WHEN named THEN id ELSE '' END AS message FROM refs r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.t = r.t AND h.id = r.id)
 UNION ALL SELECT 'beliefs.' || id, 'belief has no evidence' FROM b WHERE k % 4 = 0 AND k % 5 <> 0),
orphan AS (SELECT id FROM e WHERE k % 3 <> 0 AND id NOT IN (SELECT id FROM refs WHERE revised))"""


def _records(spark, sf_dir):
    parts = [table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(line).cast("long").alias("line"), F.try_parse_json(F.expr(made)).alias("record")) for kind, name, line, made in _MADE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("ledger_references", _TWIN + " SELECT path, message FROM lost")
def ledger_references(spark, sf_dir):
    return I.broken_references(_records(spark, sf_dir))


@query("orphan_evidence", _TWIN + " SELECT id, 1 AS n_copies FROM orphan")
def orphan_evidence(spark, sf_dir):
    return I.orphans(_records(spark, sf_dir))


def _n(source: str, where: str = "true") -> str:
    return f"(SELECT count(*) FROM {source} WHERE {where})"


_HEALTH = {f"{k}_count": "0" for k in I.LEDGERS} | {
    "belief_count": _n("b"), "evidence_count": _n("e"), "constraint_count": _n("part"), "revision_count": _n("o"), "decision_count": _n("o"), "question_count": _n("o"), "action_count": _n("v"), "override_count": _n("v"),
    "open_action_count": _n("v", "event_type = 'error'"), "open_human_review_request_count": "0", "pending_evidence_count": _n("b", "k % 5 = 0"), "neutral_evidence_count": "0", "contested_evidence_count": "0",
    "beliefs_without_evidence": _n("b", "k % 4 = 0 AND k % 5 <> 0"), "judgments_without_beliefs": "0", "assessments_requiring_human": "0", "assessments_deferred": "0",
    "decisions_requiring_human": _n("o", "o_orderstatus = 'O'"), "decisions_requesting_action": _n("o", "o_orderstatus = 'F'"), "orphan_evidence_count": _n("orphan"), "broken_reference_count": _n("lost"),
}


@query("ledger_health", _TWIN + " " + " UNION ALL ".join(f"SELECT '{name}' AS counter, {n}::BIGINT AS value" for name, n in _HEALTH.items()) + " UNION ALL SELECT 'belief_status.' || status, count(*) FROM b GROUP BY status")
def ledger_health(spark, sf_dir):
    return I.health(_records(spark, sf_dir), stored=False)
