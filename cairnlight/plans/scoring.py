"""Row-wise scores and rules over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import scoring as S
from cairnlight.plans.registry import query, table

PREPARED = "trim(lower(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '[-‐‑‒–—―]', ' ', 'g')))"
SCORE = " + ".join(f"CASE WHEN contains(t, '{p}') THEN {w} ELSE 0 END" for p, w in V.TABLE_DICTIONARY.items())
TIERS = [" + ".join(f"contains(t, '{p}')::INT" for p in tier) for tier in V.TABLE_TIERS]
DISPATCH = "CASE WHEN t1 >= 2 OR (t1 = 1 AND t2 >= 2) THEN 'FULL' WHEN t1 >= 1 OR t2 >= 2 OR t3 >= 3 THEN 'MEDIUM' ELSE 'LOW' END"
BASE = f"WITH p AS (SELECT doc_id, source, lang, n_chars, text, {PREPARED} AS t FROM documents), s AS (SELECT *, {SCORE} AS score, {TIERS[0]} AS t1, {TIERS[1]} AS t2, {TIERS[2]} AS t3 FROM p)"
THRESHOLD = 8


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.once(table(spark, sf_dir, "documents"), t=T.prepare(F.col("text")))
    t1, t2, t3 = S.tier_counts(F.col("t"), V.TABLE_TIERS)
    return docs.select("*", S.signal_score(F.col("t"), V.TABLE_DICTIONARY).alias("score"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"))


@query("prefilter_and_dispatch", f"{BASE} SELECT source, {DISPATCH} AS tier, count(*) AS n, round(avg(score), 6) AS avg_score FROM s WHERE score > {THRESHOLD} GROUP BY 1, 2")
def prefilter_and_dispatch(spark, sf_dir):
    rows = scored(spark, sf_dir).filter(F.col("score") > THRESHOLD)
    return rows.groupBy("source", S.dispatch(F.col("t1"), F.col("t2"), F.col("t3")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("signal_score", f"{BASE} SELECT doc_id, score FROM s")
def signal_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "score")


_HITS = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{p}' AS phrase, {w} AS weight FROM p WHERE contains(t, '{p}')" for i, (p, w) in enumerate(V.TABLE_DICTIONARY.items()))


@query("matched_signals", f"{BASE}, m AS ({_HITS}) SELECT doc_id, string_agg(phrase || ':' || weight, ',' ORDER BY k) AS matched, count(*) AS n_matched FROM m GROUP BY doc_id")
def matched_signals(spark, sf_dir):
    hits = S.matched(F.col("t"), V.TABLE_DICTIONARY)
    rows = scored(spark, sf_dir).select("doc_id", hits.alias("h")).filter(F.size("h") > 0)
    return rows.select("doc_id", F.array_join(F.transform("h", lambda d: F.concat_ws(":", d["phrase"], d["weight"].cast("string"))), ",").alias("matched"), F.size("h").cast("long").alias("n_matched"))


@query("prefilter_pass", f"{BASE} SELECT doc_id, score FROM s WHERE score > {THRESHOLD}")
def prefilter_pass(spark, sf_dir):
    return S.prefilter(table(spark, sf_dir, "documents"), F.col("text"), THRESHOLD, V.TABLE_DICTIONARY)[0].select("doc_id", "score")


@query("prefilter_ignored", f"{BASE} SELECT doc_id, score FROM s WHERE score <= {THRESHOLD}")
def prefilter_ignored(spark, sf_dir):
    return S.prefilter(table(spark, sf_dir, "documents"), F.col("text"), THRESHOLD, V.TABLE_DICTIONARY)[1].select("doc_id", "score")


_STOP = ("license", "worthless", "stop", "pathetic")


@query("non_research_filter", "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '" + "|".join(_STOP) + "')")
def non_research_filter(spark, sf_dir):
    text = F.concat_ws(" ", T.blank(F.col("source")), T.blank(F.col("text")))
    return table(spark, sf_dir, "documents").filter(~S.is_non_research(text, _STOP)).select("doc_id", "source")


@query("non_research_vocabulary", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '" + "|".join(V.NON_RESEARCH).replace("'", "''") + "')")
def non_research_vocabulary(spark, sf_dir):
    """The filter with its own vocabulary."""
    text = F.concat_ws(" ", T.blank(F.col("source")), T.blank(F.col("text")))
    return table(spark, sf_dir, "documents").filter(~S.is_non_research(text, V.NON_RESEARCH)).select("doc_id")


@query("dispatch_tier", f"""{BASE} SELECT doc_id, {DISPATCH} AS tier, CASE WHEN t1 >= 2 OR (t1 = 1 AND t2 >= 2) THEN t1 || ' T1 + ' || t2 || ' T2 signals' WHEN t1 >= 1 THEN t1 || ' T1 signal'
WHEN t2 >= 2 THEN t2 || ' T2 signals' WHEN t3 >= 3 THEN t3 || ' T3 signals' ELSE 'only ' || t1 || 'T1/' || t2 || 'T2/' || t3 || 'T3 — kernel-only classification' END AS reason FROM s""")
def dispatch_tier(spark, sf_dir):
    t = [F.col(x) for x in ("t1", "t2", "t3")]
    return scored(spark, sf_dir).select("doc_id", S.dispatch(*t).alias("tier"), S.dispatch_reason(*t).alias("reason"))


@query("topic_list_matches", f"{BASE} SELECT doc_id, contains(t, 'enwh') OR contains(t, 'hati') AS legacy, contains(t, 'lyon') OR contains(t, 'nttion') AS trajectory FROM s WHERE contains(t, 'enwh') OR contains(t, 'hati') OR contains(t, 'lyon') OR contains(t, 'nttion')")
def topic_list_matches(spark, sf_dir):
    legacy, future = T.contains_any(F.col("t"), ("enwh", "hati")), T.contains_any(F.col("t"), ("lyon", "nttion"))
    return scored(spark, sf_dir).filter(legacy | future).select("doc_id", legacy.alias("legacy"), future.alias("trajectory"))


_RULES = (("review_or_synthesis_paper", ("red", "blue")), ("validation_or_benchmark_paper", ("widget", "gear")), ("mechanism_paper", ("bolt", "ring")), ("platform_or_method_paper", ("small", "large")))
_LABELS = {"mechanism_paper": ("economy",), "transduction_or_device_paper": ("promo",)}
_MODES = "CASE ptype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_MODES.items()) + " ELSE 'general_judgment' END"
_ROUTE = """WITH r AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN lower(p_type) = 'economy' THEN 'mechanism_paper' WHEN lower(p_type) = 'promo' THEN 'transduction_or_device_paper'
""" + " ".join(f"WHEN regexp_matches(lower(p_name), '{'|'.join(ph)}') THEN '{k}'" for k, ph in _RULES) + f" ELSE 'other_research' END AS ptype FROM part), m AS (SELECT *, {_MODES} AS jmode FROM r)"


def routed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = S.paper_type(F.col("p_type"), F.col("p_name"), _LABELS, _RULES)
    return part.withColumn("ptype", kind).withColumn("jmode", S.judgment_mode(F.lit(""), F.col("ptype")))


@query("paper_type_route", f"{_ROUTE} SELECT p_partkey, ptype, jmode FROM m")
def paper_type_route(spark, sf_dir):
    return routed(spark, sf_dir).select("p_partkey", "ptype", "jmode")


_FIELDS = ("(p_partkey % 11)::DOUBLE", "(p_size % 11)::DOUBLE", "((p_partkey * 7) % 11)::DOUBLE", "((p_size * 3) % 11)::DOUBLE", "((p_partkey + p_size) % 11)::DOUBLE")
_SFIELDS = ("cast(p_partkey % 11 as double)", "cast(p_size % 11 as double)", "cast((p_partkey * 7) % 11 as double)", "cast((p_size * 3) % 11 as double)", "cast((p_partkey + p_size) % 11 as double)")
_WSUM = "CASE jmode " + " ".join("WHEN '%s' THEN %s" % (m, " + ".join(f"f{i} * {v}::DOUBLE" for i, v in enumerate(w))) for m, w in V.MODE_WEIGHTS.items()) + " END"
_SCORED = f"{_ROUTE}, f AS (SELECT *, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_FIELDS))} FROM m), g AS (SELECT *, round(round({_WSUM}, 7), 1) AS final_score FROM f)"


def mode_scored(spark, sf_dir):
    rows = routed(spark, sf_dir).select("*", *(F.expr(x).alias(f"f{i}") for i, x in enumerate(_SFIELDS)))
    return rows.withColumn("final_score", S.mode_score(F.col("jmode"), [F.col(f"f{i}") for i in range(5)]))


@query("mode_weighted_score", f"{_SCORED} SELECT p_partkey, jmode, final_score FROM g")
def mode_weighted_score(spark, sf_dir):
    return mode_scored(spark, sf_dir).select("p_partkey", "jmode", "final_score")


_TIER = "CASE WHEN final_score >= 8 OR (f1 >= 9 AND f2 >= 8) OR (f2 >= 9 AND f3 >= 8) THEN 'HIGH_PRIORITY' WHEN final_score >= 6 OR (f3 >= 8 AND final_score >= 5.5) OR (f1 >= 8 AND f2 >= 7) THEN 'IMPORTANT' WHEN final_score >= 4 THEN 'POTENTIAL' WHEN p_size < 10 THEN 'WATCHLIST' ELSE 'LOW_PRIORITY' END"


@query("tier_classification", f"{_SCORED} SELECT p_partkey, {_TIER} AS tier FROM g")
def tier_classification(spark, sf_dir):
    return mode_scored(spark, sf_dir).select("p_partkey", S.rank_tier(*(F.col(c) for c in ("final_score", "f1", "f2", "f3")), F.col("p_size") < 10).alias("tier"))


@query("mode_tier_summary", f"{_SCORED} SELECT jmode, {_TIER} AS tier, count(*) AS n, round(avg(final_score), 6) AS avg_score FROM g GROUP BY GROUPING SETS ((1, 2), (1), ())")
def mode_tier_summary(spark, sf_dir):
    rows = mode_scored(spark, sf_dir).withColumn("tier", S.rank_tier(*(F.col(c) for c in ("final_score", "f1", "f2", "f3")), F.col("p_size") < 10))
    return rows.rollup("jmode", "tier").agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 6).alias("avg_score"))


_AUDIT = {"mechanism_shift": (("material", ("bolt", "ring")), ("size", ("small", "large"))), "transduction_route": (("colour", ("red", "blue", "green")), ("kind", ("widget",)))}


@query("mode_audit", f"""{_ROUTE} SELECT p_partkey, passed, total, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE round(passed / total, 2) END AS confidence FROM (SELECT p_partkey,
CASE jmode WHEN 'mechanism_shift' THEN regexp_matches(n, 'bolt|ring')::INT + regexp_matches(n, 'small|large')::INT WHEN 'transduction_route' THEN regexp_matches(n, 'red|blue|green')::INT + regexp_matches(n, 'widget')::INT ELSE 0 END AS passed,
CASE WHEN jmode IN ('mechanism_shift', 'transduction_route') THEN 2 ELSE 0 END AS total FROM (SELECT m.*, lower(p.p_name) AS n FROM m JOIN part p USING (p_partkey)))""")
def mode_audit(spark, sf_dir):
    rows = routed(spark, sf_dir).select("p_partkey", S.mode_audit(F.col("jmode"), F.lower("p_name"), _AUDIT).alias("a"))
    return rows.select("p_partkey", "a.passed", "a.total", "a.confidence")


_JT = ((1, ("src1",)), (2, ("src2", "src3")))
_EV = """WITH e AS (SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 1 WHEN contains(source, 'src2') OR contains(source, 'src3') THEN 2 ELSE 3 END AS jt,
  lower(text) AS al, lang FROM documents), f AS (SELECT doc_id, 5.0::DOUBLE + CASE jt WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(al, 'n ?=') AND coalesce(TRY_CAST(regexp_extract(al, 'n\\s*=\\s*(\\d+)', 1) AS BIGINT) >= 100, false) THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(al, 'validated|independently confirmed|consistent with|reproduc') THEN 0.5 ELSE 0 END
  + CASE WHEN regexp_matches(al, 'limitation|caveat|further study needed') THEN 0.5 ELSE 0 END
  + CASE WHEN lang = 'de' THEN 1 WHEN lang = 'fr' AND jt >= 2 THEN 0.5 ELSE 0 END - CASE WHEN lang = 'es' THEN 1.5 ELSE 0 END AS s FROM e)
SELECT doc_id, round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, s)), 1) AS score, CASE WHEN s >= 7 THEN 'High' WHEN s >= 4.5 THEN 'Medium' ELSE 'Low' END AS strength FROM f"""
_NOVELTY = {"de": "New Validation", "fr": "New Mechanism"}
_PROBLEM = {"es": "Review"}


def estimated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", S.evidence_strength(F.col("source"), F.col("text"), T.mapped(F.col("lang"), _PROBLEM, ""), T.mapped(F.col("lang"), _NOVELTY, ""), _JT).alias("e"))


@query("evidence_strength_estimate", _EV)
def evidence_strength_estimate(spark, sf_dir):
    return estimated(spark, sf_dir).select("doc_id", "e.score", "e.strength")


@query("concept_support_recalibration", """WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT o_orderkey, (o_orderkey % 9)::DOUBLE AS base, o_orderpriority AS p, o_orderstatus AS s, n FROM orders JOIN c ON k = o_custkey)
SELECT o_orderkey, round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, base + CASE p WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN -2 ELSE 0 END + CASE s WHEN 'O' THEN 1 WHEN 'F' THEN 0.5 ELSE -1 END + CASE WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END)), 0)::DOUBLE AS support FROM x""")
def concept_support_recalibration(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = orders.join(counts, "o_custkey", "left")
    strength = F.when(F.col("o_orderpriority") == "1-URGENT", "High").when(F.col("o_orderpriority") == "5-LOW", "Low").otherwise("Medium")
    kind = F.when(F.col("o_orderstatus") == "O", "Discovery").when(F.col("o_orderstatus") == "F", "Validation").otherwise("Weak Signal")
    return rows.select("o_orderkey", S.concept_support((F.col("o_orderkey") % 9).cast("double"), strength, kind, F.col("n"), F.lit("x"), generous=True).alias("support"))


_DOM = {"econ": ("widget", "bolt"), "promo": ("ring",), "small": ("gear", "red")}


@query("domain_consistency", """WITH d AS (SELECT p_partkey, lower(p_type) AS pc, lower(p_name) AS cn FROM part), k AS (SELECT *, contains(pc, 'econ') OR contains(pc, 'promo') OR contains(pc, 'small') AS known,
CASE WHEN contains(pc, 'econ') THEN regexp_matches(cn, 'widget|bolt') WHEN contains(pc, 'promo') THEN contains(cn, 'ring') WHEN contains(pc, 'small') THEN regexp_matches(cn, 'gear|red') ELSE false END AS fits FROM d)
SELECT p_partkey, NOT (known AND NOT fits) AS consistent, CASE WHEN NOT known THEN 'Unknown problem class' WHEN fits THEN NULL ELSE 'Domain mismatch' END AS flag, CASE WHEN known AND NOT fits THEN 3 ELSE 0 END AS penalty FROM k""")
def domain_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", S.domain_consistency(F.col("p_type"), F.col("p_name"), _DOM).alias("d"))
    return rows.select("p_partkey", "d.consistent", "d.flag", "d.penalty")


@query("blind_spot_detection", f"{BASE}, b AS (SELECT doc_id, (score <= 12)::INT + regexp_matches(source, 'src1')::INT + ((contains(t, 'ther')::INT + contains(t, 'tion')::INT + contains(t, 'with')::INT) >= 2)::INT + ((doc_id % 100) / 100.0 >= 0.35)::INT AS signals FROM s) SELECT doc_id, signals, CASE WHEN signals >= 3 THEN round(least(0.9::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * signals), 2) ELSE 0.0::DOUBLE END AS confidence FROM b WHERE signals >= 3")
def blind_spot_detection(spark, sf_dir):
    hints = sum((F.contains(F.col("t"), F.lit(w)).cast("int") for w in ("ther", "tion", "with")), F.lit(0))
    spot = S.blind_spot(F.col("score") - 10, T.contains_any(F.col("source"), ("src1",)), hints, (F.col("doc_id") % 100) / 100.0)
    return scored(spark, sf_dir).select("doc_id", spot.alias("b")).filter("b.is_blind_spot").select("doc_id", "b.signals", "b.confidence")


@query("watchlist_floor", f"{_SCORED}, t AS (SELECT p_partkey, p_size, CASE WHEN final_score >= 6 THEN 'IMPORTANT' ELSE 'LOW_PRIORITY' END AS t0 FROM g) SELECT p_partkey, CASE WHEN t0 = 'LOW_PRIORITY' AND p_size % 5 = 0 THEN 'WATCHLIST' ELSE t0 END AS tier FROM t")
def watchlist_floor(spark, sf_dir):
    tier = F.when(F.col("final_score") >= 6, "IMPORTANT").otherwise("LOW_PRIORITY")
    return mode_scored(spark, sf_dir).select("p_partkey", S.watchlist_floor(tier, F.col("p_size") % 5 == 0).alias("tier"))


@query("framework_score_v2", """WITH c AS (SELECT l_suppkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), f AS (SELECT s_suppkey, (s_suppkey % 11)::DOUBLE AS pp, ((s_suppkey * 3) % 11)::DOUBLE AS fl, ((s_suppkey * 5) % 11)::DOUBLE AS ac, ((s_suppkey * 7) % 11)::DOUBLE AS co, (s_nationkey % 11)::DOUBLE AS nv, coalesce(n, 0)::DOUBLE AS n FROM supplier LEFT JOIN c ON k = s_suppkey),
v AS (SELECT s_suppkey, pp, co, 0.25::DOUBLE * pp + 0.25::DOUBLE * least(10.0::DOUBLE, 2.5::DOUBLE * n + 2) + 0.20::DOUBLE * fl + 0.15::DOUBLE * ac + 0.10::DOUBLE * co + 0.05::DOUBLE * nv AS x FROM f) SELECT s_suppkey, round(round(CASE WHEN co >= 7 AND pp <= 3 THEN x * 0.5::DOUBLE ELSE x END, 7), 1) AS v2_score FROM v""")
def framework_score_v2(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_linenumber").alias("n"))
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(n, k == F.col("l_suppkey"), "left")
    d = lambda e: e.cast("double")
    return rows.select("s_suppkey", S.framework_score(d(k % 11), d((k * 3) % 11), d((k * 5) % 11), d((k * 7) % 11), d(F.col("s_nationkey") % 11), d(F.coalesce("n", F.lit(0)))).alias("v2_score"))


@query("pattern_score", "SELECT p_partkey, greatest(0.0::DOUBLE, least(10.0::DOUBLE, 5.0::DOUBLE - contains(p_name, 'ring')::INT + 2.0::DOUBLE * contains(p_name, 'red')::INT + CASE WHEN p_size % 4 >= 2 THEN 1.5 ELSE 0 END)) AS score FROM part")
def pattern_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.pattern_score(F.contains("p_name", F.lit("ring")), F.contains("p_name", F.lit("red")), F.col("p_size") % 4).alias("score"))


@query("scalar_text_functions", r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label,
 left(sha256(doc_id::VARCHAR || '|' || source), 16) AS stable_id, left(sha1(source || '|' || lang), 8) AS key8, len(regexp_extract_all(text, '\S+')) AS n_words,
 coalesce(TRY_CAST(regexp_extract(source, '(\d+)', 1) AS DOUBLE), 0.0::DOUBLE) AS num, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE)), 4) AS clamped,
 lower(lang) IN ('1', 'true', 'yes', 'fr') AS flag FROM (SELECT * FROM documents)""")
def scalar_text_functions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.label(F.col("text")).alias("label"), T.stable_id("", F.col("doc_id").cast("string"), F.col("source")).alias("stable_id"),
                       F.left(F.sha1(F.concat_ws("|", "source", "lang")), F.lit(8)).alias("key8"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"),
                       F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("double"), F.lit(0.0)).alias("num"), T.clamp(F.col("n_chars") / 5000.0, 0.0, 1.0, 4).alias("clamped"),
                       F.lower("lang").isin("1", "true", "yes", "fr").alias("flag"))
