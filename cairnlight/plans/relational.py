"""Ingest, keyed state, ranking and grouping over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import documents as D
from cairnlight.operators import merge as M
from cairnlight.operators import ranking as R
from cairnlight.plans.registry import query, table


@query("ingest_dedup_first_seen", "SELECT h, doc_id, source FROM (SELECT md5(text) AS h, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source = 'src0' DESC, doc_id) AS r FROM documents) WHERE r = 1")
def ingest_dedup_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "source")
    return M.first_seen(rows, ["h"], [F.col("source") != "src0", F.col("doc_id")])


@query("new_items_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_items_anti_join(spark, sf_dir):
    return M.new_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("existing_items_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_items_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("topk_per_tier", "SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 5 WHEN '5-LOW' THEN 4 ELSE 0 END")
def topk_per_tier(spark, sf_dir):
    limits = {"1-URGENT": 1, "2-HIGH": 10, "3-MEDIUM": 5, "5-LOW": 4}
    return R.top_k(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], limits).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("top5_per_tier_preview", "SELECT p_type, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5")
def top5_per_tier_preview(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "part"), ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_type", "p_partkey", "rank")


@query("tier_counts", "SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS n_large FROM orders GROUP BY 1")
def tier_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("yearly_source_counts", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey || '|' || year(o_orderdate)) AS n_pairs FROM orders GROUP BY 1, 2")
def yearly_source_counts(spark, sf_dir):
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(y.alias("y"), "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", F.col("o_custkey").cast("string"), y.cast("string"))).alias("n_pairs"))


_MOM = """WITH e AS (SELECT lower(trim(event_type)) || '_' || (user_id % 40) AS name, event_id AS seq, user_id AS source, strftime(ts, '%Y-%m-%d') AS seen, CASE WHEN value > 50 THEN 'v' || event_id ELSE '' END AS note FROM events)
SELECT name, count(*) AS appearances, min(seen) AS first_seen, max(seen) AS last_seen, arg_min(source, seq) AS source, arg_max(note, seq) FILTER (note <> '') AS note, CASE WHEN count(*) >= 5 THEN 'established' WHEN count(*) >= 3 THEN 'gaining' ELSE 'emerging' END AS momentum FROM e GROUP BY name"""


def _concept_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("_", "event_type", (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_id").alias("seq"), F.col("user_id").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("seen"), F.when(F.col("value") > 50, F.concat(F.lit("v"), F.col("event_id").cast("string"))).otherwise("").alias("note"))


@query("concept_momentum_upsert", _MOM)
def concept_momentum_upsert(spark, sf_dir):
    return M.concept_momentum(_concept_events(spark, sf_dir))


@query("concept_momentum_incremental", _MOM)
def concept_momentum_incremental(spark, sf_dir):
    e = _concept_events(spark, sf_dir)
    return M.merge_momentum(M.concept_momentum(e.filter(F.col("seen") < "2024-01-16")), M.concept_momentum(e.filter(F.col("seen") >= "2024-01-16")))


@query("status_preserving_upsert", """WITH s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'open' ELSE 'dismissed' END AS status, o_totalprice AS priority FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT o_orderkey AS k, 'open' AS status, o_totalprice * 2 AS priority FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(s.k, c.k) AS k, CASE WHEN s.status IN ('done', 'dismissed') THEN s.status WHEN c.k IS NOT NULL THEN c.status ELSE s.status END AS status, round(CASE WHEN c.k IS NOT NULL THEN c.priority ELSE s.priority END, 2) AS priority FROM s FULL JOIN c ON s.k = c.k""")
def status_preserving_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "open").otherwise("dismissed")
    stored = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), status.alias("status"), F.col("o_totalprice").alias("priority"))
    changes = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("open").alias("status"), (F.col("o_totalprice") * 2).alias("priority"))
    return M.upsert(stored, changes, "k", keep_status=("done", "dismissed")).withColumn("priority", F.round("priority", 2))


@query("partial_update", "SELECT c_custkey, coalesce(n.nm, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS nm FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON k = c_custkey")
def partial_update(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"))
    return M.partial_update(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey")


@query("fill_missing_only", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE coalesce(b, '') END AS p_name FROM part LEFT JOIN (SELECT p_partkey AS k, p_brand AS b FROM part WHERE p_size % 3 = 0) ON k = p_partkey")
def fill_missing_only(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    stored = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("p_name"))
    return M.fill_missing(stored, part.filter("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("p_name")), "p_partkey", "p_name")


@query("counter_upsert", "SELECT user_id, event_type, count(*) AS paper_count, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def counter_upsert(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("paper_count"), F.max("ts").alias("last_ts"))


@query("latest_state_by_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.latest(e.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


_ACT = "CASE event_type WHEN 'view' THEN 'commit' WHEN 'click' THEN 'reject' WHEN 'error' THEN 'challenge' WHEN 'purchase' THEN 'resolve' ELSE 'none' END"


@query("object_revision", f"""WITH a AS (SELECT user_id AS k, event_id AS seq, {_ACT} AS act FROM events), x AS (SELECT k, arg_max(CASE act WHEN 'commit' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'challenge' THEN 'contested' ELSE 'resolved' END, seq) AS st,
 sum(CASE act WHEN 'commit' THEN 1.5 WHEN 'reject' THEN -3 WHEN 'challenge' THEN -1 ELSE 0.5 END::DOUBLE) AS c, sum(CASE act WHEN 'commit' THEN 2 WHEN 'reject' THEN -2 WHEN 'challenge' THEN -0.5 ELSE 1 END::DOUBLE) AS e FROM a WHERE act <> 'none' GROUP BY k)
SELECT c_custkey AS key, coalesce(st, 'candidate') AS status, round(greatest(0, least(10, c_acctbal / 1000 + coalesce(c, 0))), 2) AS confidence, round(greatest(0, least(10, 5.0::DOUBLE + coalesce(e, 0))), 2) AS entrenchment FROM customer LEFT JOIN x ON k = c_custkey""")
def object_revision(spark, sf_dir):
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("candidate").alias("status"), (F.col("c_acctbal") / 1000).alias("confidence"), F.lit(5.0).alias("entrenchment"))
    names = {"view": "commit", "click": "reject", "error": "challenge", "purchase": "resolve"}
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), T.mapped(F.col("event_type"), names, "none").alias("action"))
    return M.revise(objects, actions, V.REVISION_ACTIONS)


@query("justification_contraction", "WITH j AS (SELECT event_id AS id, user_id AS concept, CASE WHEN value > 100 THEN 'High' WHEN value > 30 THEN 'Medium' ELSE 'Low' END AS strength FROM events) SELECT id, concept, strength FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY CASE strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END, id) AS r FROM j) WHERE r > 1")
def justification_contraction(spark, sf_dir):
    return M.contract(_justifications(spark, sf_dir)).select("id", "concept", "strength")


def _justifications(spark, sf_dir):
    strength = F.when(F.col("value") > 100, "High").when(F.col("value") > 30, "Medium").otherwise("Low")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("concept"), strength.alias("strength"))


@query("justification_confidence", "SELECT user_id AS concept, least(10.0::DOUBLE, sum(CASE WHEN value > 100 THEN 2 WHEN value > 30 THEN 1 ELSE 0.5 END::DOUBLE)) AS confidence FROM events GROUP BY 1")
def justification_confidence(spark, sf_dir):
    weight = F.when(F.col("strength") == "High", 2.0).when(F.col("strength") == "Medium", 1.0).otherwise(0.5)
    return _justifications(spark, sf_dir).groupBy("concept").agg(F.least(F.lit(10.0), F.sum(weight)).alias("confidence"))


@query("pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders"), [F.asc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", "o_totalprice")


@query("filtered_page_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 40")
def filtered_page_in_list(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(gone, "o_orderkey", "left_anti")
    return R.page(rows, [F.asc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")], 0, 40).select("o_orderkey")


@query("diversified_round_robin", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'Abstract Kernel Constraints' ELSE o_orderpriority || o_orderstatus END AS frontier, o_totalprice AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY frontier ORDER BY p DESC, id) AS rn FROM t), b AS (SELECT frontier, p AS bp, id AS bt FROM r WHERE rn = 1)
SELECT id, frontier, row_number() OVER (ORDER BY frontier = 'Abstract Kernel Constraints', rn, bp DESC, bt) AS queue_rank FROM r JOIN b USING (frontier) ORDER BY 3 LIMIT 60""")
def diversified_round_robin(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    frontier = F.when(F.col("o_orderpriority") == "5-LOW", V.DEFERRED_FRONTIER).otherwise(F.concat("o_orderpriority", "o_orderstatus"))
    rows = o.select(F.col("o_orderkey").alias("id"), frontier.alias("frontier"), F.col("o_totalprice").alias("p"))
    return R.round_robin(rows, "frontier", F.col("p"), F.col("id"), 60, (V.DEFERRED_FRONTIER,)).select("id", "frontier", "queue_rank")


@query("candidate_claims_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def candidate_claims_topk(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), F.asc("doc_id")).limit(8).select("doc_id", "n_chars")


@query("pressure_points_quota", "SELECT kind, id, score FROM (SELECT event_type AS kind, event_id AS id, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= CASE kind WHEN 'error' THEN 3 WHEN 'view' THEN 1000 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 2 END ORDER BY score DESC, id LIMIT 8")
def pressure_points_quota(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    quotas = {"error": 3, "view": 1000, "click": 2, "signup": 3}
    return R.top_k(rows, ["kind"], [F.desc("score"), F.asc("id")], quotas, default=2).orderBy(F.desc("score"), F.asc("id")).limit(8).select("kind", "id", "score")


@query("presentation_order", "SELECT user_id AS reviewer_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('p1|' || user_id || '|' || item_id)) - 1 AS presentation_index FROM benchmark, (SELECT DISTINCT user_id FROM events)")
def presentation_order(spark, sf_dir):
    reviewers = table(spark, sf_dir, "events").select(F.col("user_id").alias("reviewer_id")).distinct()
    return R.presentation_order(table(spark, sf_dir, "benchmark").select("item_id"), reviewers, "p1")


@query("date_chunks", """SELECT o_orderkey, y AS chunk_year, greatest(d0, make_date(y, 1, 1)) AS chunk_start, least(d1, make_date(y, 12, 31)) AS chunk_end
FROM (SELECT o_orderkey, o_orderdate::DATE AS d0, (o_orderdate + INTERVAL 500 DAY)::DATE AS d1, unnest(range(year(o_orderdate), year(o_orderdate + INTERVAL 500 DAY) + 1))::BIGINT AS y FROM orders)""")
def date_chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d0"), F.date_add(F.to_date("o_orderdate"), 500).alias("d1"))
    return o.select("o_orderkey", F.explode(D.year_chunks(F.col("d0"), F.col("d1"))).alias("c")).select("o_orderkey", "c.*")


@query("rollup_mode_relation", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (1, 2)")
def rollup_mode_relation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("histograms_grouping_sets", "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS facet, coalesce(lang, source) AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def histograms_grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "documents").select("lang", "source").createOrReplaceTempView("cairn_docs_facets")
    return spark.sql("SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS facet, coalesce(lang, source) AS value, count(*) AS n FROM cairn_docs_facets GROUP BY GROUPING SETS ((lang), (source))")


@query("duplicate_extra_copies", "SELECT count(*) AS n_groups, sum(n - 1)::BIGINT AS extra_copies FROM (SELECT md5(text) AS h, n_chars, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_extra_copies(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h"), "n_chars").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("extra_copies"))


@query("manifest_merge", "SELECT p_brand, arg_min(p_name, p_partkey) AS first_name, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def manifest_merge(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name"), F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("types"))


@query("memory_summary", "SELECT event_type AS category, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS approved, max(ts) AS last_ts FROM events GROUP BY 1")
def memory_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("approved"), F.max("ts").alias("last_ts"))


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = (("both", a.intersect(b)), ("unlabelled", a.subtract(b)), ("either", a.union(b).distinct()))
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("registry_sort_dedup", "SELECT p_brand, p_type, lower(p_name) AS name, p_partkey, count(*) OVER (PARTITION BY lower(p_name), p_size) AS n_same FROM part")
def registry_sort_dedup(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.lower("p_name"))
    same = part.groupBy("name", "p_size").agg(F.count("*").alias("n_same"))
    return part.join(same, ["name", "p_size"]).orderBy("p_type", "p_brand", "name", "p_partkey").select("p_brand", "p_type", "name", "p_partkey", "n_same")
