"""Parsing, review, tasks, intake and event-time queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import intake as I
from cairnlight.operators import parsing as P
from cairnlight.operators import ranking as R
from cairnlight.operators import review as W
from cairnlight.operators import tasks as K
from cairnlight.plans.registry import query, table
from cairnlight.streaming import events as E


@query("response_line_parse", "SELECT p_partkey, p_size % 11 AS relevance, p_partkey % 11 AS novelty, CASE WHEN p_size % 2 = 0 THEN 'HIGH_PRIORITY' ELSE 'IMPORTANT' END AS tier, p_name || chr(10) || '- ' || p_brand AS why FROM part")
def response_line_parse(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(F.lit("**RELEVANCE: 0/10**\n\nRELEVANCE: "), (size % 11).cast("string"), F.lit("/10\n**Novelty = "), (key % 11).cast("string"), F.lit("**\nSIGNAL TIER: "), F.when(size % 2 == 0, "High priority").otherwise("IMPORTANT"), F.lit("\nWhy matters: "), F.col("p_name"), F.lit("\n- "), F.col("p_brand"), F.lit("\n"))
    fields = P.fields(table(spark, sf_dir, "part"), "p_partkey", text)
    wide = fields.groupBy("p_partkey").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("relevance", "novelty", "signal_tier", "why_matters")))
    return wide.select("p_partkey", T.ratio_score(F.col("relevance")).cast("int").alias("relevance"), T.ratio_score(F.col("novelty")).cast("int").alias("novelty"), P.canonical_tier(F.col("signal_tier")).alias("tier"), F.col("why_matters").alias("why"))


@query("conversation_lines", "SELECT conv_id, turn, pos - 1 AS pos, length(line) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM conversations) WHERE trim(line) <> ''")
def conversation_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return P.lines(rows, "k", F.col("text")).filter(F.trim("line") != "").select("k.conv_id", "k.turn", "pos", F.length("line").alias("n"))


def digests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.upper("event_type").alias("section"), "event_id", "value")
    entry = F.concat(F.lit("### Event "), F.col("event_id").cast("string"), F.lit("\n- **Score:** "), F.col("value").cast("string"), F.lit("/500"))
    body = e.groupBy("day", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("t")))), lambda x: x["t"]), "\n").alias("b"), F.count("*").alias("n"))
    whole = body.groupBy("day").agg(F.array_sort(F.collect_list(F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("b")))).alias("s"))
    return whole.select("day", F.concat(F.lit("# Digest\n"), F.array_join("s", "\n")).alias("text"))


@query("digest_render", "WITH e AS (SELECT ts::DATE AS day, upper(event_type) AS s, event_id, '### Event ' || event_id || chr(10) || '- **Score:** ' || value || '/500' AS t FROM events), b AS (SELECT day, '## ' || s || chr(10) || string_agg(t, chr(10) ORDER BY event_id) AS b FROM e GROUP BY day, s) SELECT day, '# Digest' || chr(10) || string_agg(b, chr(10) ORDER BY b) AS text FROM b GROUP BY day")
def digest_render(spark, sf_dir):
    return digests(spark, sf_dir)


@query("digest_reparse", "SELECT ts::DATE AS day, upper(event_type) AS section, 'Event ' || event_id AS title, value AS score FROM events")
def digest_reparse(spark, sf_dir):
    sections = P.sections(digests(spark, sf_dir), "day", F.col("text"))
    rows = sections.select("day", "section", F.explode(P.entries(F.col("body"))).alias("e"))
    return rows.select("day", "section", F.trim(F.substring_index("e", "\n", 1)).alias("title"), F.regexp_extract(P.labelled(F.col("e"), "Score"), r"^([\d.]+)/", 1).cast("double").alias("score"))


@query("html_attr_extract", r"""SELECT page_id, len(h) AS n_links, h[1] AS first_link, regexp_extract(html, '<html[^>]*?\slang="([^">]*)"', 1) AS lang FROM (SELECT page_id, html, list_filter(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"''>]*)["'']', 1), lambda x: x <> '') AS h FROM pages)""")
def html_attr_extract(spark, sf_dir):
    links = P.tag_attribute(F.col("html"), "a", "href")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("h"), P.tag_attribute(F.col("html"), "html", "lang")[0].alias("lang")).select("page_id", F.size("h").cast("long").alias("n_links"), F.get("h", F.lit(0)).alias("first_link"), "lang")


@query("html_best_candidate", r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || u AS link FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"''>]*)["'']', 1), lambda x: regexp_matches(x, '^/[a-z]') AND NOT contains(lower(x), '/the'))[1] AS u FROM pages) WHERE u IS NOT NULL""")
def html_best_candidate(spark, sf_dir):
    best = P.best_candidate(F.col("html"), (("meta", "content", 1), ("a", "href", 20)), ("/the",), "^/[a-z]")
    return table(spark, sf_dir, "pages").select("page_id", "url", best.alias("u")).filter("u <> ''").select("page_id", P.absolute(F.col("u"), F.col("url")).alias("link"))


@query("feedback_conflicts", "WITH f AS (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, event_type AS p, event_id AS seq FROM events), s AS (SELECT user_id, k, arg_min(p, seq) AS stored FROM f GROUP BY 1, 2) SELECT user_id, k, stored, count(*) FILTER (p = stored) - 1 AS duplicates, count(*) FILTER (p <> stored) AS conflicts FROM f JOIN s USING (user_id, k) GROUP BY 1, 2, 3")
def feedback_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("p"), F.col("event_id").alias("seq"))
    return W.settle_feedback(rows, ["user_id", "k"], "p", "seq")


_ORDER = "o AS (SELECT user_id AS r, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('p1|' || user_id || '|' || item_id)) - 1 AS i FROM benchmark, (SELECT DISTINCT user_id FROM events))"


@query("progress_resume", f"WITH {_ORDER}, e AS (SELECT user_id AS r, event_id AS seq, event_type, json_extract(props, '$.k')::BIGINT % 40 AS item_id FROM events), n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT e.r, arg_max(i, seq) AS cur FROM e JOIN o ON e.r = o.r AND e.item_id = o.item_id WHERE event_type = 'view' GROUP BY 1), l AS (SELECT o.r, o.item_id, (i - coalesce(cur, 0) + n) % n AS st FROM o CROSS JOIN n LEFT JOIN c ON c.r = o.r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.r = o.r AND e.item_id = o.item_id AND event_type = 'purchase')) SELECT r AS reviewer_id, arg_min(item_id, st) AS next_item, count(*) AS n_open FROM l GROUP BY 1")
def progress_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("reviewer_id"), F.col("event_id").alias("seq"), "event_type", (F.get_json_object("props", "$.k").cast("long") % 40).alias("item_id"))
    order = R.presentation_order(table(spark, sf_dir, "benchmark").select("item_id"), e.select("reviewer_id").distinct(), "p1")
    return W.resume(order, e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'").select("reviewer_id", "seq", "item_id"))


@query("eligibility_policy", "SELECT event_id, user_id AS reviewer_id FROM events WHERE event_type <> 'error' AND user_id % 7 <> 3")
def eligibility_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("reviewer_id"), F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "view", True).alias("eligible"))
    policy = rows.select("reviewer_id").distinct().filter("reviewer_id % 7 IN (3, 4)").withColumn("eligible", F.col("reviewer_id") % 7 != 3)
    return W.eligible(rows, policy).select("event_id", "reviewer_id")


_TYPES = ("resolve_contested_object", "commit_or_reject_object", "sharpen_open_question", "verify_constraint", "judge_high_score_paper", "next_kernel_move")
_KIND = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_TYPES)) + " END"
_TASTE = {"red": 7.0, "bolt": 5.0, "small ring": -10.0, "ring": 3.0}


def _kind():
    return F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (F.col("p_partkey") % 6 + 1).cast("int"))


@query("task_priority_calibration", f"WITH k AS (SELECT p_partkey, p_size::DOUBLE AS b, {_KIND} AS k, p_name FROM part) SELECT p_partkey, round(greatest(0.0::DOUBLE, least(60.0::DOUBLE, b * CASE k " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in V.TASK_TYPES.items()) + " END + CASE k " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in V.TASK_TYPES.items()) + " END + CASE WHEN regexp_matches(p_name, '\\bred\\b') THEN 7 ELSE 0 END + CASE WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 5 ELSE 0 END + CASE WHEN contains(p_name, 'small ring') THEN -10 ELSE 0 END + CASE WHEN regexp_matches(p_name, '\\bring\\b') THEN 3 ELSE 0 END)), 2) AS priority FROM k")
def task_priority_calibration(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.calibrate(_kind(), F.col("p_size").cast("double"), F.col("p_name"), _TASTE).alias("priority"))


@query("task_frontier", f"SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Direction A' WHEN p_size = 2 THEN 'Concept: ' || p_brand WHEN regexp_matches(p_name, 'red|blue') THEN 'Colour' WHEN contains(p_name, 'bolt') THEN 'Fasteners' WHEN {_KIND} = 'next_kernel_move' THEN '{V.DEFERRED_FRONTIER}' ELSE {_KIND} END AS frontier FROM part")
def task_frontier(spark, sf_dir):
    direction, concept = F.when(F.col("p_size") == 1, "Direction A").otherwise(""), F.when(F.col("p_size") == 2, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", K.frontier(direction, concept, _kind(), F.col("p_name"), (("Colour", ("red", "blue")), ("Fasteners", ("bolt",)))).alias("frontier"))


@query("task_generation", "WITH o AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'question' WHEN o_orderkey % 3 = 1 THEN 'constraint' ELSE 'claim' END AS kind, CASE o_orderstatus WHEN 'P' THEN 'contested' WHEN 'O' THEN 'open' ELSE 'candidate' END AS status FROM orders) SELECT key, CASE WHEN status = 'contested' THEN 'resolve_contested_object' WHEN kind = 'question' AND status = 'open' THEN 'sharpen_open_question' WHEN kind = 'constraint' THEN 'verify_constraint' ELSE 'commit_or_reject_object' END AS task_type FROM o WHERE status IN ('contested', 'candidate') OR kind <> 'claim'")
def task_generation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "question").when(F.col("o_orderkey") % 3 == 1, "constraint").otherwise("claim")
    status = F.when(F.col("o_orderstatus") == "P", "contested").when(F.col("o_orderstatus") == "O", "open").otherwise("candidate")
    return K.from_objects(o.select(F.col("o_orderkey").alias("key"), kind.alias("kind"), status.alias("status"), F.lit(1.0).alias("confidence"))).select("key", "task_type")


@query("summary_state", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 120) > 0 THEN 'unstable' WHEN count(*) FILTER (event_type = 'click' AND value > 100) > 0 THEN 'learning' WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'stable' ELSE 'forming' END AS state FROM events GROUP BY 1")
def summary_state(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(K.summary_state(F.count_if((t == "error") & (v > 120)), F.count_if((t == "click") & (v > 100)), F.count_if(t == "view")).alias("state"))


_BRIEF = "WITH b AS (SELECT event_id AS id, event_id % 17 = 0 AS blocked, event_id % 13 = 0 AS conflict, CASE WHEN event_id % 19 = 0 THEN 'contest' ELSE 'support' END AS legacy, event_id % 11 <> 0 AS claims, CASE WHEN event_id % 23 = 0 THEN 'title_only' ELSE 'full' END AS level, CASE WHEN event_id % 29 = 0 THEN 'not_admissible' ELSE 'ok' END AS rel, CASE WHEN event_id % 31 = 0 THEN 'high' ELSE 'low' END AS sem, event_id % 3 = 0 AS abstract_only, event_id % 4 AS n FROM events)"


@query("intake_decision", _BRIEF + " SELECT id, CASE WHEN blocked THEN 'reject' WHEN conflict OR legacy = 'contest' THEN 'escalate' WHEN NOT claims OR level = 'title_only' OR rel = 'not_admissible' THEN 'request_refresh' WHEN sem = 'high' THEN 'escalate' WHEN abstract_only THEN 'partial_accept' WHEN n > 0 THEN 'accept' ELSE 'partial_accept' END AS decision FROM b")
def intake_decision(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda m, a, b: F.when(k % m == 0, a).otherwise(b)
    blockers = F.when(k % 17 == 0, F.array(F.lit("closed_loop_attempted_commit"))).otherwise(F.array().cast("array<string>"))
    d = I.decision(blockers, k % 13 == 0, pick(19, "contest", "support"), k % 11 != 0, pick(23, "title_only", "full"), pick(29, "not_admissible", "ok"), pick(31, "high", "low"), F.lit("low"), k % 3 == 0, k % 4)
    return table(spark, sf_dir, "events").select(k.alias("id"), d["decision"].alias("decision"))


@query("claim_touch_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'passed' ELSE 'key_claim_not_measured_or_tested' END WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 4 <> 3 THEN 'passed' ELSE 'key_claim_not_measured_or_tested' END ELSE 'not_directional' END AS gate, round(least(1.0::DOUBLE, greatest(CASE WHEN o_orderkey % 4 = 1 THEN 0.45::DOUBLE WHEN o_orderkey % 4 = 2 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.35 WHEN o_orderpriority = '2-HIGH' THEN 0.2 ELSE 0 END::DOUBLE)), 4) AS negative_weight FROM orders")
def claim_touch_gate(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    some = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    measured = F.when(m == 0, some("a", "b", "c")).when(m == 1, some("a")).when(m == 2, some("b", "z")).otherwise(some("z"))
    flags = F.when(m == 1, some("scope_overclaim", "missing_controls")).when(m == 2, some("translational_overclaim", "other")).otherwise(some())
    risk = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    relation = F.when(F.col("o_orderstatus") == "O", "support").when(F.col("o_orderstatus") == "F", "challenge").otherwise("neutral")
    return table(spark, sf_dir, "orders").select("o_orderkey", I.touch_gate(relation, some("a", "b"), measured).alias("gate"), I.negative_weight(flags, risk).alias("negative_weight"))


@query("tumbling_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, sf_dir):
    return E.tumbling(table(spark, sf_dir, "events"), "1 day")


@query("sliding_event_counts", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS s FROM events) GROUP BY 1, 2")
def sliding_event_counts(spark, sf_dir):
    return E.tumbling(table(spark, sf_dir, "events"), "3 days", "1 day")


@query("session_gaps", "WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, sid")
def session_gaps(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), "6 hours")
