"""Questions, moves, objects, queues and sources over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import judgment as J
from cairnlight.plans.registry import query, table

_CASE = "upper(left(w, 1)) || lower(substr(w, 2))"
_TABLE = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**T.ACRONYMS, "red": "RED", "of": "of", "and": "and"}.items()) + f" ELSE {_CASE} END"


@query("title_words", f"SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_TABLE}), ' ') AS title FROM part")
def title_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.col("p_name"), {**T.ACRONYMS, "red": "RED"}).alias("title"))


@query("reviewer_and_elapsed", r"""SELECT c_custkey, 'reviewer_' || left(sha256(lower(regexp_replace(trim(c_name), '\s+', ' ', 'g'))), 16) AS reviewer,
 CASE WHEN c_custkey % 3 = 0 THEN greatest(0, c_custkey - 50) ELSE 0 END AS elapsed, CASE WHEN trim(c_mktsegment) <> '' AND c_custkey % 2 = 0 THEN trim(c_mktsegment) ELSE c_name END AS shown FROM customer""")
def reviewer_and_elapsed(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") - 50).cast("string")).when(F.col("c_custkey") % 3 == 1, F.lit("12.5s"))
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("<b> </b>")
    return table(spark, sf_dir, "customer").select("c_custkey", T.reviewer_id(F.concat(F.lit(" "), F.upper("c_name"))).alias("reviewer"), T.elapsed(raw).alias("elapsed"), T.first_filled(segment, F.col("c_name")).alias("shown"))


@query("detection_limits", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^\pL\pN_])(lod|limit of detection|sensitivity|attomolar|femtomolar|particles/ml|copies/ml|license|worthless)($|[^\pL\pN_])')")
def detection_limits(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.has_detection_limit(F.col("text"), (*T.DETECTION_LIMIT, "license", "worthless"))).select("doc_id")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STORY_STOP_WORDS) + "]"
_ADDED = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in {**T.STORY_STEMS, **{s: s for s in T.STORY_SHORT}}.items())


@query("relevance_terms", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w)), list_filter([{_ADDED}], lambda w: w IS NOT NULL)))), ' ') AS terms FROM (SELECT p_partkey, lower(p_name || ' via sensors of nanophotonics') AS t FROM part)")
def relevance_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.relevance_terms(F.concat("p_name", F.lit(" via Sensors of Nanophotonics"))), " ").alias("terms"))


@query("stemmed_word_counts", "SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_extract_all(replace(replace(lower(coalesce(text, '')), 'bioelectronics', 'bioelectronic'), 'electrochemical', 'electronic'), '[a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM documents)")
def stemmed_word_counts(spark, sf_dir):
    rows = T.once(table(spark, sf_dir, "documents"), w=T.stemmed_words(F.col("text")))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("inline_marks", "SELECT event_id, event_type || ' was ' || (value::INT) || ' times' AS text FROM events")
def inline_marks(spark, sf_dir):
    marked = F.concat(F.lit("**"), "event_type", F.lit("** was *"), F.bround("value").cast("int").cast("string"), F.lit("* <i>times</i>"))
    return table(spark, sf_dir, "events").select("event_id", T.plain_inline(marked).alias("text"))


@query("source_paths", """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/mnt/' ELSE '/home/' END || regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS x FROM p),
f AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/mnt' ELSE x[3] END AS bucket, list_filter([CASE WHEN contains(path, 'news') THEN 'news' END, CASE WHEN contains(path, '1') THEN 'one' END], lambda t: t IS NOT NULL) AS topics, contains(path, '7') AS private, list_contains(x, 'a') AS low FROM s)
SELECT page_id, bucket, len(topics) AS n_topics, CASE WHEN private THEN 'excluded_private_or_admin' WHEN low THEN 'excluded_low_signal' WHEN len(topics) > 0 THEN 'research_candidate' ELSE 'unknown' END AS privacy FROM f""")
def source_paths(spark, sf_dir):
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "/mnt/").otherwise("/home/"), F.regexp_replace("url", "^https?://", ""))
    facts = J.path_facts(F.col("path"), "/home", {"news": "news", "one": "1"}, "7", ("a",), ("library",))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", facts.alias("f")).select("page_id", "f.bucket", F.size("f.topics").cast("long").alias("n_topics"), "f.privacy")


@query("trajectory_priority", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 5.0 WHEN 'SMALL' THEN 4.5 ELSE 0.0 END::DOUBLE AS tier_rank, CASE WHEN p_type = 'SMALL' THEN CASE WHEN contains(p_name, 'red') OR contains(p_name, 'bolt') THEN 2 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END ELSE 0 END AS focus, p_retailprice AS score FROM part")
def trajectory_priority(spark, sf_dir):
    tier = F.when(F.col("p_type") == "PROMO", "HIGH_PRIORITY").when(F.col("p_type") == "SMALL", "CURATED_LIBRARY").otherwise("")
    key = J.trajectory_priority(tier, F.col("p_name"), F.col("p_retailprice"), F.col("p_partkey"), focus=((2, ("red", "bolt")), (1, ("ring",))))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("k")).orderBy(F.desc("k")).select("p_partkey", "k.tier_rank", "k.focus", "k.score")


@query("kernel_task_queue", "SELECT event_id FROM events ORDER BY coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 999999), value DESC, event_id LIMIT 100")
def kernel_task_queue(spark, sf_dir):
    return J.task_queue(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").try_cast("double"), F.col("value"), "event_id").select("event_id")


@query("belief_states", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 100) > 0 THEN 'contested' WHEN count(*) FILTER (event_type = 'click' AND value > 100) > 0 THEN 'pressure' WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'formalised' ELSE 'thin' END AS state FROM events GROUP BY 1")
def belief_states(spark, sf_dir):
    n = lambda kind, least: F.count_if((F.col("event_type") == kind) & (F.col("value") > least))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(J.belief_state(n("error", 100), F.lit(0), n("click", 100), n("view", -1)).alias("state"))


@query("belief_display_ids", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'bolt') THEN 'B-OECT' WHEN p_type = 'PROMO' THEN 'B-KERNEL' ELSE 'B-' || upper(left(p_partkey::VARCHAR || 'xyz', 6)) END AS shown FROM part")
def belief_display_ids(spark, sf_dir):
    concepts = F.transform(F.split("p_name", " "), lambda w: F.when(w == "red", " OECT ").when(w == "bolt", "ev").otherwise(w))
    domain = F.when(F.col("p_type") == "PROMO", "Research-OS core").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", J.display_id(concepts, domain, F.concat(F.lit("belief_x_"), F.col("p_partkey").cast("string"), F.lit("xyz"))).alias("shown"))


@query("open_questions", """WITH t AS (SELECT p_name AS title, min(p_partkey) AS pos FROM part WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1), s AS (SELECT title FROM t ORDER BY pos LIMIT 5),
c AS (SELECT n_name, count(*) AS n, max(c_custkey) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), g AS (SELECT n_name, n, last FROM c ORDER BY n DESC, last DESC, n_name LIMIT 5),
a AS (SELECT 0 AS source, title, 'open_question' AS type, 0 AS k FROM s UNION ALL SELECT 1, 'What would make ' || n_name || ' decisive?', 'concept_gap', -n FROM g) SELECT type, title FROM a ORDER BY source, k, title LIMIT 10""")
def open_questions(spark, sf_dir):
    kind = F.when(F.col("p_type") == "PROMO", "question").when(F.col("p_type") == "SMALL", "next_question").otherwise("evidence")
    stories = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), kind.alias("node_type"), F.col("p_name").alias("title"))
    seen = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("appearances"), F.max("c_custkey").alias("last_seen"))
    concepts = table(spark, sf_dir, "nation").join(seen, "n_nationkey").select(F.col("n_name").alias("name"), F.lit("a gap").alias("gap"), "appearances", "last_seen")
    return J.open_questions(stories, concepts, 10, 5).select("type", "title")


@query("next_moves", """WITH p AS (SELECT 0 AS s, event_id AS pos, CASE event_type WHEN 'error' THEN 'resolve' ELSE 'verify' END AS type, CASE event_type WHEN 'error' THEN 'Resolve: ' ELSE 'Verify constraint: ' END || event_id AS title FROM events WHERE event_type IN ('error', 'signup') ORDER BY event_id LIMIT 2),
a AS (SELECT * FROM p UNION ALL (SELECT 1, n_nationkey, 'sharpen_question', 'Sharpen: ' || n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 1) UNION ALL SELECT 2, r_regionkey, 'commit_or_reject', 'Commit or reject: ' || r_name FROM region) SELECT type, title FROM a ORDER BY s, pos, title LIMIT 4""")
def next_moves(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "contradiction").when(F.col("event_type") == "signup", "untested_constraint").otherwise("other")
    pressures = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), kind.alias("type"), F.col("event_id").cast("string").alias("title")).filter("type <> 'other'").orderBy("pos").limit(2)
    questions = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("title")).orderBy("pos").limit(1)
    return J.next_moves(pressures, questions, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("title")))


_KIND = "CASE event_type WHEN 'view' THEN 'belief' WHEN 'click' THEN 'rejected_idea' WHEN 'error' THEN 'contradiction' WHEN 'purchase' THEN 'open_question' ELSE 'claim' END"


@query("kernel_objects", f"""SELECT event_id, kind, CASE kind WHEN 'belief' THEN 'approved' WHEN 'rejected_idea' THEN 'rejected' WHEN 'contradiction' THEN 'contested' WHEN 'open_question' THEN 'open' ELSE 'candidate' END AS status,
 round(CASE kind WHEN 'belief' THEN 7 WHEN 'rejected_idea' THEN 0 WHEN 'contradiction' THEN 5 WHEN 'open_question' THEN 2 + least(6, value / 12) ELSE least(10, value / 3) END::DOUBLE, 4) AS confidence,
 round(CASE kind WHEN 'belief' THEN 7 WHEN 'rejected_idea' THEN 1 WHEN 'contradiction' THEN 4 WHEN 'open_question' THEN 2 ELSE greatest(1, least(10, value / 3) / 2) END::DOUBLE, 4) AS entrenchment FROM (SELECT *, {_KIND} AS kind FROM events)""")
def kernel_objects(spark, sf_dir):
    kind = T.mapped(F.col("event_type"), {"view": "belief", "click": "rejected_idea", "error": "contradiction", "purchase": "open_question"}, "claim")
    rows = table(spark, sf_dir, "events").withColumn("kind", kind).withColumn("o", J.objects(F.col("kind"), F.col("value"), F.col("value")))
    return rows.select("event_id", "kind", "o.status", F.round("o.confidence", 4).alias("confidence"), F.round("o.entrenchment", 4).alias("entrenchment"))


@query("rule_candidates", "SELECT 'rule_' || left(sha256(event_id::VARCHAR || '|' || event_type), 16) AS id, event_id AS source_override_id, event_type AS rule FROM events WHERE event_type IN ('error', 'signup')")
def rule_candidates(spark, sf_dir):
    given = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).select(F.col("event_id").alias("id"), F.col("event_type").alias("rule"))
    stored = J.rule_candidates(spark.createDataFrame([], "id string, source_override_id long, status string, rule string"), given.filter("rule = 'error'"))
    return J.rule_candidates(stored, given.unionAll(given)).select("id", "source_override_id", "rule")


@query("migration_plan", """WITH r AS (SELECT o_orderkey AS id, o_custkey AS s, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey + o_orderkey % 3 END AS d FROM orders WHERE o_orderpriority = '1-URGENT'), f AS (SELECT c_custkey AS p FROM customer WHERE c_acctbal > 0),
x AS (SELECT id, s, d, s IN (SELECT p FROM f) AS st, coalesce(d IN (SELECT p FROM f), false) AS dt FROM r) SELECT id AS source_id, CASE WHEN st AND d IS NOT NULL AND NOT dt THEN 'ready' ELSE 'blocked' END AS status, (NOT st)::INT + (d IS NULL OR dt)::INT + coalesce(st AND s = d, false)::INT AS n_issues FROM x""")
def migration_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    target = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string")
    records = o.select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("action"), F.col("o_custkey").cast("string").alias("source"), target.alias("destination"))
    files = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"))
    return J.migration_plan(records, files, "1-URGENT").select("source_id", "status", F.size("issues").alias("n_issues"))


@query("best_by_metric", "SELECT (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS best_p_retailprice, (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 1) AS best_p_size")
def best_by_metric(spark, sf_dir):
    return J.best_by(table(spark, sf_dir, "part"), "p_partkey", "p_partkey", ["p_retailprice", "p_size"])


@query("latest_digest_day", "SELECT coalesce(max(ts::DATE) FILTER (event_type = 'signup' AND value > 150), max(ts::DATE)) AS day FROM events")
def latest_digest_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return J.latest_with(rows, "day", (F.col("event_type") == "signup") & (F.col("value") > 150))


@query("journal_selection", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_name <> ''")
def journal_selection(spark, sf_dir):
    return J.journals(table(spark, sf_dir, "customer"), "c_mktsegment", "c_name", (" Building ", "MACHINERY", " ")).select("c_custkey")


@query("overestimated_evidence", "SELECT p_partkey, p_type = 'PROMO' AND p_size < 20 AS flag, CASE WHEN p_type = 'PROMO' AND p_size < 20 THEN greatest(0, p_size % 11 - 2) ELSE p_size % 11 END::DOUBLE AS support FROM part")
def overestimated_evidence(spark, sf_dir):
    given, estimated = F.when(F.col("p_type") == "PROMO", " High ").otherwise("Low"), F.when(F.col("p_size") < 20, "Low").otherwise("High")
    return table(spark, sf_dir, "part").select("p_partkey", J.overestimate(given, estimated, (F.col("p_size") % 11).cast("double")).alias("o")).select("p_partkey", "o.flag", "o.support")


@query("decisions_by_id", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def decisions_by_id(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.by_id(wanted, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("digest_enrichment", "SELECT event_id, lang, coalesce(length(text), 0) AS n FROM events LEFT JOIN documents ON doc_id = user_id")
def digest_enrichment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), "lang", F.length("text").cast("long").alias("n"))
    return table(spark, sf_dir, "events").join(docs, "user_id", "left").select("event_id", "lang", F.coalesce("n", F.lit(0)).alias("n"))


@query("journal_harvest", "WITH f AS (SELECT md5(text) AS h, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT source, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def journal_harvest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.md5("text").alias("h"))
    return J.harvest(docs, "source", F.col("h"), [F.col("doc_id")], 25).select("source", "doc_id")


@query("token_lists", "SELECT p_partkey, len(list_filter(list_distinct(list_concat(string_split(lower(p_name), ' '), CASE WHEN p_size > 25 THEN ['big'] ELSE ['small', 'red'] END, [lower(p_brand)])), lambda x: x <> '')) AS n FROM part")
def token_lists(spark, sf_dir):
    big = F.col("p_size") > 25
    on = lambda c: F.when(c, "yes").otherwise("no")
    switches = F.create_map(F.lit("big"), on(big), F.lit("small"), on(~big), F.lit("Red "), on(~big))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(J.tokens_of(F.split("p_name", " "), J.switched_on(switches), F.array("p_brand"))).cast("long").alias("n"))


@query("verified_names", "SELECT DISTINCT lower(trim(p_name)) AS name FROM part WHERE p_type = 'PROMO'")
def verified_names(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select(F.lower(F.trim("p_name")).alias("name")).distinct()
