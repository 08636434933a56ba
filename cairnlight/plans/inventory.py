"""Predicates, readers, decisions and reports over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import documents as D
from cairnlight.operators import intake as I
from cairnlight.operators import merge as M
from cairnlight.operators import parsing as P
from cairnlight.operators import readers as Q
from cairnlight.operators import scoring as S
from cairnlight.plans.registry import query, table


@query("recent_rows_as_of", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 60 DAY AND o_orderpriority <> ''")
def recent_rows_as_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(T.filled(F.col("o_orderpriority")).isNotNull() & (F.col("o_orderdate") >= F.date_sub(F.lit("2001-08-01").cast("date"), 60))).select("o_orderkey")


@query("displayable_predicate", "SELECT p_partkey FROM part WHERE trim(p_name) <> '' AND (CASE WHEN p_size > 40 THEN p_brand ELSE '' END <> '' OR p_size % 7 > 3)")
def displayable_predicate(spark, sf_dir):
    text = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").filter(T.filled(F.col("p_name")).isNotNull() & (T.filled(text).isNotNull() | (F.col("p_size") % 7 > 3))).select("p_partkey")


@query("optional_filters", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def optional_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    for column, value in {"c_mktsegment": " Building ", "c_name": None}.items():
        if value is not None:
            rows = rows.filter(F.lower(F.trim(F.col(column))) == value.strip().lower())
    return rows.filter("c_acctbal > 1000").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_mktsegment")


@query("links_by_either_end", "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def links_by_either_end(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("n"))
    sources = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    targets = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("key"))
    return D.linked(links, sources, targets)


@query("links_of_keys", "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') OR l_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def links_of_keys(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("n"))
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    return D.linked(links, keys)


@query("newest_mention_join", "SELECT c_custkey, d AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def newest_mention_join(spark, sf_dir):
    seen = D.newest_mention(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("last_order")), "c_custkey", "last_order")
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").select("c_custkey", "last_order")


@query("first_relevant_rule", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'd0' WHEN contains(p_name, 'bolt') THEN 'd1' WHEN contains(p_brand, '#1') THEN 'd2' END AS delta FROM part WHERE regexp_matches(p_name, 'red|bolt') OR contains(p_brand, '#1')")
def first_relevant_rule(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", S.first_rule(text, (("d0", ("red",)), ("d1", ("bolt",)), ("d2", ("#1",))), "").alias("delta"))
    return rows.filter("delta <> ''")


@query("gate_counts", "SELECT count(*) FILTER (o_orderpriority = '5-LOW' AND o_totalprice > 300000) AS alpha, count(*) FILTER (o_orderstatus = 'P') AS beta, count(*) FILTER (o_totalprice < 2000) AS gamma, count(*) FILTER (o_orderpriority = '5-LOW' AND o_totalprice > 300000) >= 3 AS alpha_open FROM orders")
def gate_counts(spark, sf_dir):
    a = F.count_if((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 300000))
    return table(spark, sf_dir, "orders").agg(a.alias("alpha"), F.count_if(F.col("o_orderstatus") == "P").alias("beta"), F.count_if(F.col("o_totalprice") < 2000).alias("gamma"), (a >= 3).alias("alpha_open"))


@query("bucket_histogram_default", "SELECT CASE WHEN n_regionkey = 0 THEN 'uncategorized' ELSE r_name END AS bucket, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def bucket_histogram_default(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    name = F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("r_name"))
    return rows.groupBy(F.coalesce(T.filled(name), F.lit("uncategorized")).alias("bucket")).agg(F.count("*").alias("n"))


_TERMS = {"readout": ("that", "with"), "biology": ("this", "from"), "preservation": ("hati",), "mechanism": ("ther", "ation"), "platform": ("thes",), "anchor": ("inging", "enwh", "lyon", "ion", "tion", "ting"), "connection": ("resh",), "conflict": ("worthless",), "off_topic": ("pathetic",),
          "active": ("ouon", "ofth"), "state": ("anor", "ering"), "synthesis": ("thand", "ofer", "inon"), "overview": ("thand", "ofer"), "unspecified": ("ntan",), "carrier": ("erin",)}
_N = lambda k: "(" + " + ".join(f"regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z0-9])')::INT" if len(w) <= 4 else f"contains(t, '{w}')::INT" for w in _TERMS[k]) + ")"
_READ = f"""WITH d AS (SELECT doc_id, source, lower(text) AS t FROM documents), m AS (SELECT doc_id, t, CASE WHEN contains(source, '1') THEN 'transduction_validity' WHEN contains(source, '2') THEN 'platform_bridge' WHEN contains(source, '3') THEN 'mechanism_to_coupling' WHEN contains(source, '4') THEN 'biological_relevance' WHEN contains(source, '5') THEN 'synthesis_prior' ELSE 'trajectory_fit' END AS mode,
 {_N('active')} AS act, {_N('state')} AS st, {_N('synthesis')} AS syn, contains(t, 'thand') OR contains(t, 'ofer') AS ov, contains(t, 'ntan') AS uns, contains(t, 'erin') AS car, {_N('readout')} AS r, {_N('biology')} AS b, {_N('mechanism')} AS m, {_N('platform')} AS p, {_N('anchor')} AS a, {_N('connection')} AS c, {_N('preservation')} AS v, contains(t, 'worthless') AS x, contains(t, 'pathetic') AS o FROM d)"""
_MODES = (("a", "transduction_validity", ("1",)), ("b", "platform_bridge", ("2",)), ("c", "mechanism_to_coupling", ("3",)), ("d", "biological_relevance", ("4",)), ("e", "synthesis_prior", ("5",)))


def _read(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), Q.intake_mode(F.col("source"), _MODES).alias("mode"))


@query("reader_mechanism_trace", _READ + " SELECT doc_id, CASE WHEN x THEN 'challenge' WHEN mode = 'transduction_validity' THEN CASE WHEN o AND a < 2 THEN 'neutral' WHEN r >= 1 AND b >= 1 AND m >= 1 AND a >= 1 THEN 'support' WHEN r >= 1 AND m >= 1 AND a >= 1 THEN 'unclear' ELSE 'neutral' END WHEN mode = 'platform_bridge' THEN CASE WHEN p >= 1 AND c >= 1 AND a >= 1 THEN 'support' WHEN p >= 1 AND a >= 1 THEN 'unclear' ELSE 'neutral' END WHEN m >= 2 AND a >= 1 THEN 'support' WHEN m = 1 AND a >= 1 THEN 'unclear' ELSE 'neutral' END AS relation FROM m")
def reader_mechanism_trace(spark, sf_dir):
    t = F.col("t")
    return _read(spark, sf_dir).select("doc_id", Q.mechanism_trace(F.col("mode"), t, t, t, _TERMS).alias("relation"))


_CONTENT = """ SELECT doc_id, CASE WHEN x THEN 'challenge'
 WHEN mode = 'transduction_validity' THEN CASE WHEN o AND a < 2 THEN 'neutral' WHEN uns THEN CASE WHEN r >= 1 THEN 'unclear' ELSE 'neutral' END
   WHEN r >= 2 AND b >= 1 AND a >= 1 AND (v >= 1 OR car) THEN 'support' WHEN r >= 1 AND b >= 1 AND a >= 1 THEN 'unclear' ELSE 'neutral' END
 WHEN mode = 'biological_relevance' THEN CASE WHEN b >= 1 AND st >= 1 THEN 'support' WHEN b >= 1 THEN 'unclear' ELSE 'neutral' END
 WHEN o AND a < 1 THEN 'neutral'
 WHEN mode = 'mechanism_to_coupling' THEN CASE WHEN m >= 2 AND a >= 1 THEN 'support' WHEN m >= 1 AND a >= 1 THEN 'unclear' ELSE 'neutral' END
 WHEN mode = 'platform_bridge' THEN CASE WHEN p >= 1 AND a >= 1 THEN 'support' WHEN p >= 1 AND act >= 1 THEN 'unclear' ELSE 'neutral' END
 WHEN mode = 'synthesis_prior' THEN CASE WHEN syn >= 2 AND a >= 1 THEN 'support' WHEN ov AND a >= 1 THEN 'unclear' ELSE 'neutral' END
 WHEN a >= 2 THEN 'support' WHEN a = 1 THEN 'unclear' ELSE 'neutral' END AS relation FROM m"""


@query("reader_belief_content", _READ + _CONTENT)
def reader_belief_content(spark, sf_dir):
    t = F.col("t")
    return _read(spark, sf_dir).select("doc_id", Q.belief_content(F.col("mode"), t, t, t, _TERMS).alias("relation"))


@query("reader_digest_connection", _READ + " SELECT doc_id, CASE WHEN x THEN 'challenge' WHEN trim(t) = '' THEN 'neutral' WHEN o THEN 'neutral' WHEN c >= 1 AND a >= 1 THEN 'support' WHEN c >= 1 THEN 'unclear' ELSE 'neutral' END AS relation FROM m")
def reader_digest_connection(spark, sf_dir):
    t = F.col("t")
    return _read(spark, sf_dir).select("doc_id", Q.digest_connection(t, t, t, _TERMS).alias("relation"))


_DEC = "WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'escalate' WHEN 2 THEN 'request_refresh' ELSE 'accept' END AS i, CASE event_id % 5 WHEN 0 THEN 'support' WHEN 1 THEN 'contest' WHEN 2 THEN 'unclear' ELSE 'neutral' END AS r, event_id % 7 = 0 AS nr, event_id % 11 < 3 AS rev, event_id % 13 < 4 AS q, event_id % 17 < 6 AS tr FROM events)"


@query("research_decision", _DEC + " SELECT event_id, CASE WHEN i = 'reject' THEN 'no_change' WHEN i IN ('escalate', 'request_refresh') THEN 'request_action_or_read' WHEN nr THEN 'request_action_or_read' WHEN rev THEN 'propose_belief_revision' WHEN r = 'contest' THEN 'request_action_or_read' WHEN q THEN 'open_question' WHEN tr THEN 'propose_trajectory_update' ELSE 'no_change' END AS decision, CASE WHEN tr OR i = 'escalate' OR r = 'contest' THEN 'high' WHEN nr OR i = 'request_refresh' OR r = 'unclear' THEN 'medium' ELSE 'low' END AS uncertainty FROM e")
def research_decision(spark, sf_dir):
    k = F.col("event_id")
    i = F.when(k % 6 == 0, "reject").when(k % 6 == 1, "escalate").when(k % 6 == 2, "request_refresh").otherwise("accept")
    r = F.when(k % 5 == 0, "support").when(k % 5 == 1, "contest").when(k % 5 == 2, "unclear").otherwise("neutral")
    return table(spark, sf_dir, "events").select("event_id", I.research_decision(i, r, k % 7 == 0, k % 11 < 3, k % 13 < 4, k % 17 < 6).alias("decision"), I.uncertainty(i, r, k % 17 < 6, k % 7 == 0, i == "request_refresh").alias("uncertainty"))


@query("state_log_render", "SELECT event_id AS id, '## ' || event_id || chr(10) || '- event_type: ' || event_type || CASE WHEN value > 100 THEN chr(10) || '- note: large' ELSE '' END AS text FROM events")
def state_log_render(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("value") > 100, "large").otherwise("").alias("note"))
    return D.state_log(rows, ["event_type", "note"])


@query("fact_check_parse", "SELECT p_partkey, 'A.' || p_size AS code, p_name AS title, p_brand AS claim, CASE WHEN p_size % 3 = 0 THEN 'rejected' WHEN p_size % 3 = 1 THEN 'approved' ELSE 'candidate' END AS status FROM part")
def fact_check_parse(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(F.lit("# Report\n\n## A."), size.cast("string"), F.lit(" - "), F.col("p_name"), F.lit("\n- **Claim:** "), F.col("p_brand"), F.lit("\n- Status: "), F.when(size % 3 == 0, "Unsupported").when(size % 3 == 1, "supported").otherwise("?"))
    return D.fact_checks(table(spark, sf_dir, "part"), "p_partkey", text)


@query("back_references", "SELECT lower(p_brand) || '.pdf' AS name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS pages FROM part WHERE p_size < 30 GROUP BY 1")
def back_references(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), F.col("p_size").alias("line"), F.concat(F.lit("source_file: files/"), F.col("p_brand"), F.lit(".pdf")).alias("value"))
    return D.back_references(lines).select("name", F.array_join("pages", ",").alias("pages"))


@query("export_documents", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def export_documents(spark, sf_dir):
    out = D.export_json(table(spark, sf_dir, "nation"), "n_regionkey")
    return out.select("n_regionkey", F.size(F.from_json("json", "array<struct<n_nationkey:int,n_name:string>>")).cast("long").alias("n"))


@query("chain_edges", "WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem) SELECT l_orderkey, a, b, count(*) AS n FROM l WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2, 3")
def chain_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda x: x["l_suppkey"]).alias("nodes"))
    return D.chain_edges(rows, "l_orderkey", F.col("nodes")).groupBy("l_orderkey", "a", "b").agg(F.count("*").alias("n"))


@query("abstract_sentences", r"SELECT doc_id, len(list_filter(string_split_regex(trim(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)), lambda s: s <> '')) AS n_sentences FROM documents")
def abstract_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("legacy_backfill_by_mode", "SELECT CASE lang WHEN 'en' THEN 'mechanism_shift' WHEN 'de' THEN 'synthesis_map' ELSE 'general_judgment' END AS mode, count(*) AS n, count(*) FILTER (quality = 1) AS n_support, count(*) FILTER (quality = 0) AS n_challenge, count(*) FILTER (quality IS NULL) AS n_pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def legacy_backfill_by_mode(spark, sf_dir):
    mode = T.mapped(F.col("lang"), {"en": "mechanism_shift", "de": "synthesis_map"}, "general_judgment")
    q = F.col("quality")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"), F.count_if(q == 1).alias("n_support"), F.count_if(q == 0).alias("n_challenge"), F.count_if(q.isNull()).alias("n_pending"))


@query("trajectory_status", "SELECT o_custkey, count(*) AS evidence, CASE WHEN count(*) FILTER (o_orderstatus = 'P') >= 2 THEN 'contested' WHEN count(*) >= 12 THEN 'rising' WHEN count(*) >= 5 THEN 'active' ELSE 'thin' END AS status FROM orders GROUP BY 1")
def trajectory_status(spark, sf_dir):
    n, p = F.count("*"), F.count_if(F.col("o_orderstatus") == "P")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("evidence"), F.when(p >= 2, "contested").when(n >= 12, "rising").when(n >= 5, "active").otherwise("thin").alias("status"))
    return rows.orderBy(F.col("status") != "rising", F.desc("evidence"), "o_custkey")


@query("effective_final_score", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.final_score') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS score FROM events")
def effective_final_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.final_score").try_cast("double"), F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("score"))


@query("insert_or_ignore", "SELECT k, min(v) AS v FROM (SELECT o_custkey AS k, 'a' AS v FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey, 'b' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def insert_or_ignore(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda s, v: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.lit(v).alias("v")).distinct()
    stored = part("P", "a")
    return stored.unionAll(M.new_rows(part("F", "b"), stored, ["k"]))


@query("json_object_extract", r"SELECT event_id, event_type AS relation, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_object_extract(spark, sf_dir):
    """A model's answer: the text from the first to the last brace as JSON; relations outside the vocabulary are unclear."""
    text = F.concat(F.lit("Sure: {\"relation\": \""), F.col("event_type"), F.lit("\", \"p\": "), F.col("props"), F.lit("} done"))
    answer = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "relation string, p struct<k:bigint>")
    allowed = ("view", "click", "error", "signup", "purchase")
    return table(spark, sf_dir, "events").select("event_id", answer.alias("a")).select("event_id", F.when(F.col("a.relation").isin(*allowed), F.col("a.relation")).otherwise("unclear").alias("relation"), F.col("a.p.k").alias("k"))


@query("heading_carry_forward", "SELECT conv_id, turn, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS h FROM conversations)")
def heading_carry_forward(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("heading"))


@query("canonical_tiers", "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'HIGH') THEN 'HIGH_PRIORITY' WHEN contains(o_orderpriority, 'LOW') THEN 'LOW_PRIORITY' ELSE replace(o_orderpriority, ' ', '_') END AS tier FROM orders")
def canonical_tiers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.canonical_tier(F.col("o_orderpriority")).alias("tier"))
