"""Similarity, trends, gaps, nesting and integrity over the standard tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import scoring as S
from cairnlight.operators import similarity as X
from cairnlight.operators import trends as R
from cairnlight.operators import validation as Y
from cairnlight.plans.registry import query, table
from cairnlight.plans.scoring import BASE
from cairnlight import vocab as V


@query("cosine_top1", """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS m, embedding::DOUBLE[] AS f FROM embeddings),
s AS (SELECT id, m, list_cosine_similarity(e, f) AS c FROM q, r WHERE id <> m), b AS (SELECT id, m, c, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, m) AS k FROM s) SELECT id, m AS match, round(c, 3) AS similarity, CASE WHEN c >= 0.5 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS verdict FROM b WHERE k = 1""")
def cosine_top1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return X.nearest(rows, rows.filter("id % 100 = 0"))


_TOK = "list_distinct(regexp_extract_all(lower(trim({c})), '\\S+'))"
_HALF = f"""WITH e AS (SELECT user_id, max(ts)::DATE AS date FROM events GROUP BY 1), r AS (SELECT doc_id AS id, source AS kind, left(text, (length(text) // 2)::BIGINT) AS o, substr(text, (length(text) // 2)::BIGINT + 1) AS i
  FROM documents JOIN e ON user_id = doc_id WHERE date >= DATE '2024-02-15' - INTERVAL 60 DAY),
h AS (SELECT id, kind, o, i, {_TOK.format(c='o')} AS ot, {_TOK.format(c='i')} AS it FROM r WHERE (SELECT count(*) FROM r) >= 5),
a AS (SELECT id, kind, len(ot) AS size, unnest(ot) AS t FROM h WHERE length(trim(o)) >= 10), b AS (SELECT id, kind, len(it) AS size, unnest(it) AS t FROM h WHERE length(trim(i)) >= 10),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS n, count(*) / least(any_value(a.size), any_value(b.size)) AS r FROM a JOIN b USING (t) WHERE a.id < b.id AND a.kind <> b.kind GROUP BY 1, 2)
SELECT a, b, n AS n_shared, round(r, 3) AS similarity FROM p WHERE n >= 3 AND r >= 0.35 ORDER BY round(r, 3) DESC, a, b LIMIT 15"""


@query("similarity_self_join", _HALF)
def similarity_self_join(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").cast("date").alias("date"))
    half = F.floor(F.length("text") / 2).cast("int")
    docs = table(spark, sf_dir, "documents").join(newest, "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("source").alias("kind"), "date", F.left("text", half).alias("output"), F.substring("text", half + 1, F.length("text")).alias("input"))
    return X.connections(rows, F.lit("2024-02-15").cast("date"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in V.MATCH_STOP_WORDS) + "]"
_TS = "list_filter(list_distinct(regexp_extract_all(lower({c}), '\\S+')), lambda w: NOT list_contains(" + _STOPS + ", w))"


_DENIED = " OR ".join(f"contains(p.x, '{d}' || array_to_string(list_sort(c.t)[1:3], ' '))" for d in X.DENIALS)


@query("constraint_match", f"""WITH c AS (SELECT item_id AS cid, {_TS.format(c='text')} AS t FROM benchmark), p AS (SELECT doc_id AS pid, trim(lower(coalesce(text, ''))) AS x, {_TS.format(c="coalesce(text, '')")} AS u FROM documents),
n AS (SELECT cid, pid, count(*) AS n FROM (SELECT cid, unnest(t) AS w FROM c) JOIN (SELECT pid, unnest(u) AS w FROM p) USING (w) GROUP BY 1, 2),
f AS (SELECT cid, pid, CASE WHEN n / greatest(1, len(t)) >= 0.4 THEN 'supported' ELSE 'partial' END AS result, round(n / greatest(1, len(t)), 2) AS confidence FROM n JOIN c USING (cid) WHERE n / greatest(1, len(t)) >= 0.15)
SELECT * FROM f UNION ALL SELECT c.cid, p.pid, 'violated', 0.5 FROM c, p WHERE ({_DENIED}) AND NOT EXISTS (SELECT 1 FROM f WHERE f.cid = c.cid AND f.pid = p.pid)""")
def constraint_match(spark, sf_dir):
    return X.constraint_match(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cid"), F.col("text").alias("statement")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "text"))


_VS = "CASE WHEN l_returnflag = 'R' THEN 'supported' WHEN l_returnflag = 'A' THEN 'violated' ELSE 'partial' END"


@query("verification_summary", f"WITH v AS (SELECT l_suppkey AS c, {_VS} AS r FROM lineitem) SELECT count(*) AS total, count(*) FILTER (s) AS supported, count(*) FILTER (x) AS violated, count(*) - count(*) FILTER (s) - count(*) FILTER (x) AS untested FROM (SELECT s_suppkey, coalesce(bool_or(r = 'supported'), false) AS s, coalesce(bool_or(r = 'violated'), false) AS x FROM supplier LEFT JOIN v ON c = s_suppkey GROUP BY 1)")
def verification_summary(spark, sf_dir):
    r = F.col("l_returnflag")
    checks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.bool_or(r == "R").alias("s"), F.bool_or(r == "A").alias("x"))
    rows = table(spark, sf_dir, "supplier").join(checks, "s_suppkey", "left")
    n, s, x = F.count("*"), F.count_if("s"), F.count_if("x")
    return rows.agg(n.alias("total"), s.alias("supported"), x.alias("violated"), (n - s - x).alias("untested"))


@query("gap_audit_anti_joins", "SELECT 'untested_part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > l_linenumber * 6) UNION ALL SELECT 'customer_without_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'weak_user', user_id FROM events GROUP BY user_id HAVING count(*) <= 50")
def gap_audit_anti_joins(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > l_linenumber * 6").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select(F.lit("untested_part").alias("kind"), F.col("p_partkey").alias("id"))
    bought = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    idle = table(spark, sf_dir, "customer").join(bought, "c_custkey", "left_anti").select(F.lit("customer_without_orders"), "c_custkey")
    weak = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n <= 50").select(F.lit("weak_user"), "user_id")
    return parts.unionAll(idle).unionAll(weak)


@query("trajectory_keyword_join", "SELECT p_partkey, name FROM part, (VALUES ('warm', 'red'), ('cold', 'blue'), ('fasteners', 'bolt'), ('fasteners', 'ring')) AS t(name, term) WHERE contains(p_name, term) OR contains(term, p_name) GROUP BY 1, 2")
def trajectory_keyword_join(spark, sf_dir):
    return X.substring_matches(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), [("warm", "red"), ("cold", "blue"), ("fasteners", "bolt"), ("fasteners", "ring")])


@query("keyword_predicate", r"SELECT doc_id FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'this work is') OR regexp_matches(t, '(^|[^a-z0-9])worthless($|[^a-z0-9])') OR (regexp_matches(t, '(^|[^a-z0-9])was($|[^a-z0-9])')::INT + regexp_matches(t, '(^|[^a-z0-9])be($|[^a-z0-9])')::INT + regexp_matches(t, '(^|[^a-z0-9])from($|[^a-z0-9])')::INT) >= 2")
def keyword_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(X.keyword_match(F.lower("text"), ("this work is",), ("worthless",), ("was", "be", "from"))).select("doc_id")


_YEAR = "2015 + doc_id % 12"


@query("concept_timeline_pivot", f"{BASE}, y AS (SELECT {_YEAR} AS year, t FROM s) SELECT year, " + ", ".join(f"sum(contains(t, '{p}')::INT)::BIGINT AS {p}" for p in V.TABLE_TIERS[0]) + " FROM y GROUP BY 1")
def concept_timeline_pivot(spark, sf_dir):
    names = list(V.TABLE_TIERS[0])
    docs = T.once(table(spark, sf_dir, "documents"), t=T.prepare(F.col("text"))).select((F.col("doc_id") % 12 + 2015).alias("year"), "t")
    counts = R.timeline(docs, F.col("year"), F.col("t"), {n: 1 for n in names})
    return docs.select("year").distinct().join(counts.groupBy("year").pivot("phrase", names).agg(F.first("n")), "year", "left").na.fill(0)


@query("trajectory_class", f"{BASE}, y AS (" + " UNION ALL ".join(f"SELECT '{p}' AS phrase, 2015 + (doc_id * doc_id) % 12 AS year FROM s WHERE contains(t, '{p}')" for p in V.TABLE_DICTIONARY) + "), g AS (SELECT phrase, count(*) AS total, sum((year >= 2021)::INT) / 6.0::DOUBLE AS recent, sum((year < 2021)::INT) / 6.0::DOUBLE AS earlier FROM y GROUP BY 1) SELECT phrase, total, round(recent, 4) AS recent, round(earlier, 4) AS earlier, CASE WHEN earlier < 1 AND recent >= 2 THEN 'emerging' WHEN recent > 1.3 * earlier THEN 'rising' WHEN recent < 0.7 * earlier THEN 'declining' ELSE 'stable' END AS trajectory FROM g")
def trajectory_class(spark, sf_dir):
    docs = T.once(table(spark, sf_dir, "documents"), t=T.prepare(F.col("text"))).select(((F.col("doc_id") * F.col("doc_id")) % 12 + 2015).alias("year"), "t")
    return R.trajectory(R.timeline(docs, F.col("year"), F.col("t"), V.TABLE_DICTIONARY), range(2021, 2027), range(2015, 2021))


@query("blind_spot_bigrams", "WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda x: x NOT IN ('therefore', 'which')) AS ws FROM documents), g AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS bigram FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT bigram, count(*) AS n_docs FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def blind_spot_bigrams(spark, sf_dir):
    return R.blind_spot_bigrams(table(spark, sf_dir, "documents"), F.lower("text"), ("therefore",), ("which",), 30)


@query("ngram_counts", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations) SELECT g, count(*) AS n FROM (SELECT ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM w)) GROUP BY 1 HAVING count(*) >= 3")
def ngram_counts(spark, sf_dir):
    grams = T.ngrams(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 3)
    return table(spark, sf_dir, "conversations").select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n >= 3")


@query("semantic_drift", "WITH c AS (SELECT p_brand, CASE WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'colour' WHEN regexp_matches(lower(p_name), 'bolt|ring') THEN 'fastener' ELSE 'other' END AS k FROM part), n AS (SELECT p_brand, k, count(*) AS n FROM c GROUP BY 1, 2), g AS (SELECT p_brand, sum(n)::BIGINT AS total, count(*) AS n_clusters, max(n) AS top, arg_max(k, n * 100 + length(k)) AS dominant FROM n GROUP BY 1) SELECT p_brand, total, n_clusters, CASE WHEN total < 2 OR n_clusters < 2 THEN 0.0::DOUBLE ELSE round(round(1 - top / total, 8), 2) END AS drift_score, CASE WHEN total < 2 OR n_clusters < 2 THEN false ELSE round(round(1 - top / total, 8), 2) >= 0.35 END AS drift FROM g")
def semantic_drift(spark, sf_dir):
    return R.drift(table(spark, sf_dir, "part"), "p_brand", "p_name", (("colour", ("red", "blue")), ("fastener", ("bolt", "ring")))).drop("dominant")


@query("topic_cooccurrence", f"{BASE}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS p FROM s WHERE contains(t, '{p}')" for p in V.TABLE_DICTIONARY) + ") SELECT x.p AS a, y.p AS b, count(*) AS n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.p < y.p GROUP BY 1, 2")
def topic_cooccurrence(spark, sf_dir):
    docs = T.once(table(spark, sf_dir, "documents"), t=T.prepare(F.col("text"))).select("t")
    return R.cooccurrence(docs, F.transform(S.matched(F.col("t"), V.TABLE_DICTIONARY), lambda d: d["phrase"]))


@query("signal_graph_nodes", f"{BASE}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS node FROM s WHERE contains(t, '{p}')" for p in V.TABLE_TIERS[0]) + ") SELECT node, count(*) AS degree, CASE WHEN count(*) >= 100 THEN 3 WHEN count(*) >= 50 THEN 2 ELSE 1 END AS band FROM h GROUP BY 1")
def signal_graph_nodes(spark, sf_dir):
    docs = T.once(table(spark, sf_dir, "documents"), t=T.prepare(F.col("text"))).select("doc_id", "t")
    edges = docs.select("doc_id", F.explode(S.matched(F.col("t"), {p: 5 for p in V.TABLE_TIERS[0]})).alias("d"))
    n = F.count("*")
    return edges.groupBy(F.col("d.phrase").alias("node")).agg(n.alias("degree"), F.when(n >= 100, 3).when(n >= 50, 2).otherwise(1).alias("band"))


@query("trajectory_accumulate", "SELECT o_custkey AS k, count(*) AS evidence, count(*) FILTER (o_orderstatus = 'O') AS discoveries, count(*) FILTER (o_orderstatus = 'F') AS validations, count(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY 1")
def trajectory_accumulate(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "Discovery").when(F.col("o_orderstatus") == "F", "Validation")
    return R.accumulate(table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey")), "k", kind, F.col("o_orderpriority"))


@query("constraint_trajectory_feedback", f"SELECT l_suppkey, count(*) FILTER (r = 'supported') AS supports, count(*) FILTER (r = 'violated') AS violations, CASE WHEN count(*) FILTER (r = 'violated') > count(*) FILTER (r = 'supported') THEN 'Decreasing' WHEN count(*) FILTER (r = 'supported') > 0 AND count(*) FILTER (r = 'violated') = 0 THEN 'Increasing' ELSE 'Stable' END AS confidence FROM (SELECT l_suppkey, {_VS} AS r FROM lineitem) GROUP BY 1")
def constraint_trajectory_feedback(spark, sf_dir):
    r = F.when(F.col("l_returnflag") == "R", "supported").when(F.col("l_returnflag") == "A", "violated").otherwise("partial")
    return R.feedback(table(spark, sf_dir, "lineitem"), "l_suppkey", r)


@query("concept_validation_groups", "SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_order, CASE WHEN count(*) >= 6 THEN 'strong' WHEN count(*) >= 4 THEN 'growing' ELSE 'single' END AS trend FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def concept_validation_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    n = F.count("*")
    return rows.groupBy("o_custkey").agg(n.alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.when(n >= 6, "strong").when(n >= 4, "growing").otherwise("single").alias("trend"))


@query("framework_dedup_best", "WITH f AS (SELECT lower(p_name) AS name, p_partkey AS pos, length(p_brand) + 10 * p_size AS quality FROM part), b AS (SELECT name, min(pos) AS first_pos, max(quality) AS quality FROM f GROUP BY 1) SELECT b.name, first_pos, b.quality, min(f.pos) AS best_pos FROM b JOIN f ON f.name = b.name AND f.quality = b.quality GROUP BY 1, 2, 3")
def framework_dedup_best(spark, sf_dir):
    q = F.length("p_brand") + 10 * F.col("p_size")
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("first_pos"), F.max(q).alias("quality"), F.max_by("p_partkey", F.struct(q, -F.col("p_partkey"))).alias("best_pos"))


@query("constraint_radar_nested", "SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(l.n, 0) AS n_lines, o.keys FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1) o ON o.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.k = c_custkey")
def constraint_radar_nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "n"))).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce(F.size(F.col("orders")), F.lit(0)).alias("size"), "orders").select("c_custkey", F.greatest(F.lit(0), "size").cast("long").alias("n_orders"), F.coalesce(F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0))), F.lit(0)).alias("n_lines"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("max_ordinal_severity", "SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) AS severity FROM orders GROUP BY 1")
def max_ordinal_severity(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(T.mapped(F.col("o_orderpriority"), {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}, 0)).alias("severity"))


@query("fk_violations", "SELECT 'labels.doc_id' AS path, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr') UNION ALL SELECT 'orders.o_custkey', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'lineitem.l_orderkey', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return Y.foreign_keys([
        ("labels.doc_id", t("labels"), "doc_id", t("documents").filter("lang <> 'fr'"), "doc_id"),
        ("orders.o_custkey", t("orders"), "o_custkey", t("customer").filter("c_acctbal > 0"), "c_custkey"),
        ("lineitem.l_orderkey", t("lineitem"), "l_orderkey", t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey"),
    ])


@query("orphan_rows", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id)")
def orphan_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").join(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "left_anti")


@query("record_validation", "SELECT o_orderkey, path, message FROM (SELECT o_orderkey, 'totalprice' AS path, 'must be under 490000' AS message FROM orders WHERE o_totalprice >= 490000 UNION ALL SELECT o_orderkey, 'priority', 'unknown value' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') UNION ALL SELECT o_orderkey, 'orderdate', 'too old' FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01')")
def record_validation(spark, sf_dir):
    return Y.issues(table(spark, sf_dir, "orders"), "o_orderkey", [
        ("totalprice", F.col("o_totalprice") >= 490000, "must be under 490000"),
        ("priority", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), "unknown value"),
        ("orderdate", F.col("o_orderdate") < F.lit("1995-02-01").cast("timestamp"), "too old"),
    ])


@query("kernel_health", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM labels WHERE toxic = 1) AS n_contested, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors, (SELECT count(DISTINCT user_id) FROM events) AS n_beliefs")
def kernel_health(spark, sf_dir):
    parts = {
        "documents": {"n_documents": F.count("*")}, "labels": {"n_labels": F.count("*"), "n_contested": F.count_if(F.col("toxic") == 1)},
        "events": {"n_errors": F.count_if(F.col("event_type") == "error"), "n_beliefs": F.count_distinct("user_id")},
    }
    rows = [table(spark, sf_dir, t).agg(*(c.alias(n) for n, c in cs.items())).select(F.explode(F.create_map(*(x for n in cs for x in (F.lit(n), F.col(n))))).alias("name", "n")) for t, cs in parts.items()]
    return functools.reduce(DataFrame.unionAll, rows).agg(*(F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for cs in parts.values() for n in cs))


_ST = "CASE event_type WHEN 'view' THEN 'evidence' WHEN 'click' THEN 'concept' WHEN 'error' THEN 'uncertainty' WHEN 'signup' THEN 'trajectory' ELSE 'action' END"


@query("state_status_histogram", f"WITH v AS (SELECT * FROM (VALUES ('evidence'), ('concept'), ('trajectory'), ('constraint'), ('uncertainty'), ('action')) AS s(state), (VALUES ('none'), ('new'), ('changed')) AS t(status)), c AS (SELECT {_ST} AS state, CASE WHEN value > 60 THEN 'changed' WHEN value > 20 THEN 'new' ELSE 'none' END AS status, count(*) AS n FROM events GROUP BY 1, 2) SELECT state, status, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (state, status)")
def state_status_histogram(spark, sf_dir):
    state = T.mapped(F.col("event_type"), {"view": "evidence", "click": "concept", "error": "uncertainty", "signup": "trajectory"}, "action")
    status = F.when(F.col("value") > 60, "changed").when(F.col("value") > 20, "new").otherwise("none")
    counts = table(spark, sf_dir, "events").groupBy(state.alias("state"), status.alias("status")).agg(F.count("*").alias("n"))
    return Y.zero_filled(counts, {"state": V.STATES, "status": ("none", "new", "changed")})


@query("state_action_queue", "SELECT event_id, user_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type <> 'view' AND json_extract(props, '$.k')::BIGINT > 90 ORDER BY ts DESC, event_id DESC LIMIT 8")
def state_action_queue(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").filter((F.col("event_type") != "view") & (k > 90)).orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "user_id", k.alias("k"))


@query("json_field_stats", "SELECT event_type, avg(json_extract(props, '$.k')::DOUBLE) AS avg_k, count(*) FILTER (json_extract(props, '$.missing') IS NULL) AS n_missing FROM events GROUP BY 1")
def json_field_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.get_json_object("props", "$.k").cast("double")).alias("avg_k"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("n_missing"))
