"""Ledger operations over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import ledgers as L
from cairnlight.operators import similarity as X
from cairnlight.plans.registry import query, table


@query("pending_reclassification", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey || ',-7' ELSE '-7' END AS pending, CASE WHEN o_orderstatus = 'F' THEN '-1,' || o_custkey ELSE '-1' END AS supports, CASE WHEN o_orderstatus = 'P' THEN o_custkey::VARCHAR ELSE '' END AS contests FROM orders")
def pending_reclassification(spark, sf_dir):
    key = F.col("o_custkey")
    ids = lambda *x: F.array(*(F.lit(v).cast("long") for v in x)).cast("array<bigint>")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", ids(-1).alias("supports"), ids().alias("challenges"), F.array(key, F.lit(-7).cast("long")).alias("pending"), ids().alias("neutral"), ids().alias("contests"))
    moved = L.move_link(rows.filter("o_orderstatus <> 'O'"), key, F.when(F.col("o_orderstatus") == "F", "supports").otherwise("contests"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return moved.unionByName(rows.filter("o_orderstatus = 'O'")).select("o_orderkey", text("pending"), text("supports"), text("contests"))


@query("idempotent_create", "SELECT event_id AS id, user_id FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0")
def idempotent_create(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    new = e.filter("id % 3 = 0")
    return L.create(e.filter("id % 2 = 0"), new.unionAll(new))


@query("apply_decisions", "WITH d AS (SELECT event_id AS i, event_id % 3 = 0 AS r, event_id % 4 = 0 AS q FROM events) SELECT i AS decision_id, 'action' AS layer, 'human_read' AS ref FROM d WHERE r UNION ALL SELECT i, 'request', 'review' FROM d WHERE r UNION ALL SELECT i, 'question', 'open' FROM d WHERE q")
def apply_decisions(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("decision_id"), F.when(k % 4 == 0, "open_question").otherwise("no_change").alias("decision"), F.when(k % 3 == 0, F.array(F.lit("human_read"))).otherwise(F.array().cast("array<string>")).alias("required_actions"), (k % 3 == 0).alias("human_review"))
    twice = L.apply_decision(rows).unionAll(L.apply_decision(rows))
    stored = twice.limit(0)
    return L.create(stored, twice).select("decision_id", "layer", "ref")


@query("record_blocks", "SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block, c_name AS pattern, c_mktsegment AS class FROM customer")
def record_blocks(spark, sf_dir):
    one = F.concat(F.lit("Pattern: "), F.col("c_name"), F.lit("\nnoise\nClass: old\nCLASS: "), F.col("c_mktsegment"))
    texts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    b = L.blocks(texts.withColumn("text", F.concat(F.lit("Intro: x\n"), "text")), "c_nationkey", F.col("text"), "pattern")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return b.groupBy("c_nationkey", "block").agg(pick("pattern"), pick("class"))


@query("validator_adjustments", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size ELSE p_size % 4 END AS novelty FROM part")
def validator_adjustments(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", L.adjust(size, size % 4).alias("novelty"))


@query("parse_boundary_status", "SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n_stable, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_unstable, CASE WHEN event_type NOT IN ('view', 'click') THEN 2 ELSE 1 END AS n_untested FROM events")
def parse_boundary_status(spark, sf_dir):
    fields = F.array(F.col("event_type"), F.lit("venue"))
    rows = table(spark, sf_dir, "events").select("event_id", L.boundary_status(fields, {"view": "stable", "click": "unstable"}).alias("m"))
    return rows.select("event_id", *(F.size(F.col("m")[k]).alias(f"n_{k}") for k in ("stable", "unstable", "untested")))


@query("topic_momentum", "SELECT lower(p_name) AS topic, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'established' WHEN count(*) >= 3 THEN 'gaining' ELSE 'new' END AS momentum FROM part GROUP BY 1 HAVING count(*) >= 2")
def topic_momentum(spark, sf_dir):
    return L.topic_momentum(table(spark, sf_dir, "part"), "p_name")


@query("refresh_candidates", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_type IN ('PROMO', 'SMALL') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def refresh_candidates(spark, sf_dir):
    image = F.when(F.col("p_size") % 3 != 0, "x")
    return L.refresh_candidates(table(spark, sf_dir, "part"), image, ("PROMO", "SMALL"), F.col("p_type"), [F.desc("p_retailprice"), F.asc("p_partkey")], 20).select("p_partkey")


@query("research_arcs", "SELECT name, count(*) AS evidence, count(DISTINCT p_brand) AS sources, CASE max(CASE p_type WHEN 'PROMO' THEN 3 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 1 ELSE 0 END) WHEN 3 THEN 'PROMO' WHEN 2 THEN 'LARGE' ELSE 'SMALL' END AS strongest FROM part, (VALUES ('warm', 'red'), ('cold', 'blue'), ('fasteners', 'bolt')) AS t(name, term) WHERE contains(p_name, term) GROUP BY 1")
def research_arcs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hits = X.substring_matches(part, "p_partkey", F.col("p_name"), [("warm", "red"), ("cold", "blue"), ("fasteners", "bolt")])
    rows = hits.join(part, "p_partkey").select("name", F.col("p_brand").alias("source"), F.col("p_type").alias("status"))
    return L.arcs(rows, {"PROMO": 3, "LARGE": 2, "SMALL": 1})


@query("link_set_update", "SELECT user_id, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) + 1 AS n FROM events GROUP BY 1")
def link_set_update(spark, sf_dir):
    old = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("old"))
    kept = L.union_links(F.col("old"), F.array(F.lit("error")), F.array(F.lit("fresh")))
    return old.select("user_id", F.size(kept).cast("long").alias("n"))
