"""Score-and-store over documents: rejects, papers, concepts and justifications from one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.operators import intake_plan as I
from cairnlight.plans.registry import query, table
from cairnlight.plans.scoring import BASE, DISPATCH

_DOMAINS = {"alpha": ("signal", "gate"), "beta": ("motor",)}
_OUT = ("worthless", "enwhenwh", "zzzz")
#: Replies for two documents of three, by number: both engines make the same text.
_REPLY = """CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{"signal_tier":" high_priority ","concept_name":"' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'c' || (doc_id % 40) END || '","problem_class":"Alpha","concept_support_name":"' ||
 CASE doc_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'gate ' || (doc_id % 7) ELSE 'other' END || '","evidence_strength":"' || CASE WHEN doc_id % 2 = 0 THEN 'High' ELSE 'Low' END || '","trajectory_influence":' || (doc_id % 10) || ',"concept_support":' || (doc_id % 6) || '}' END"""


@query("score_and_store", f"""{BASE}, d AS (SELECT *, {DISPATCH} AS dispatch, regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '{"|".join(_OUT)}') AS gone FROM s),
a AS (SELECT *, doc_id % 3 <> 0 AND dispatch <> 'LOW' AS asked FROM d),
w AS (SELECT *, CASE WHEN asked AND doc_id % 5 <> 0 THEN 'c' || (doc_id % 40) ELSE '' END AS concept, CASE WHEN NOT asked OR doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'gate ' || (doc_id % 7) ELSE 'other' END AS backed,
  CASE WHEN asked THEN 'HIGH_PRIORITY' ELSE 'LOW_PRIORITY' END AS tier, CASE doc_id % 10 WHEN 9 THEN 'high' WHEN 8 THEN 'high' WHEN 7 THEN 'high' WHEN 4 THEN 'medium' WHEN 5 THEN 'medium' WHEN 6 THEN 'medium' ELSE 'low' END AS weight FROM a)
SELECT 'reject' AS route, doc_id::VARCHAR AS key, 'IGNORE' AS tier, score::INTEGER AS score, NULL AS weight FROM w WHERE gone
UNION ALL SELECT 'paper', doc_id::VARCHAR, tier, score::INTEGER, NULL FROM w WHERE NOT gone
UNION ALL SELECT 'concept', concept, tier, score::INTEGER, weight FROM w WHERE NOT gone AND concept <> ''
UNION ALL SELECT 'justification', backed || '|' || doc_id, tier, score::INTEGER, NULL FROM w WHERE NOT gone AND backed <> ''""")
def score_and_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").cast("string").alias("doi"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.lit("").alias("journal"), F.lit("").alias("pub_date"), F.try_parse_json(F.expr(_REPLY)).alias("reply"))
    rows = I.classified(papers, V.TABLE_DICTIONARY, V.TABLE_TIERS, _DOMAINS, _OUT, "reply")
    return I.routed(rows).select("route", "key", "tier", "score", "weight")
