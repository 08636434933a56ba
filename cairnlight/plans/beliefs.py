"""Votes, relations and folds over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import beliefs as B
from cairnlight.operators import consensus as C
from cairnlight.plans.registry import query, table

_VOTES = """WITH v AS (SELECT doc_id, 'q' AS parser, CASE quality WHEN 1 THEN 'supports' ELSE 'against' END AS rel FROM labels
 UNION ALL SELECT doc_id, 't', CASE WHEN toxic = 1 THEN 'mixed' WHEN doc_id % 5 = 0 THEN 'off_topic' WHEN doc_id % 7 = 0 THEN 'unknown' END FROM labels
 UNION ALL SELECT doc_id, 'l', CASE WHEN lang = 'de' THEN 'neutral' WHEN lang = 'fr' AND doc_id % 3 = 0 THEN 'pending' WHEN lang = 'es' THEN 'Positive' END FROM documents),
n AS (SELECT doc_id, parser, CASE rel WHEN 'supports' THEN 'support' WHEN 'Positive' THEN 'support' WHEN 'against' THEN 'challenge' WHEN 'mixed' THEN 'contest' WHEN 'off_topic' THEN 'neutral' WHEN 'neutral' THEN 'neutral' WHEN 'pending' THEN 'underdetermined' WHEN 'unknown' THEN 'unclear' END AS r FROM v)"""


def votes(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    q = labels.select("doc_id", F.lit("q").alias("parser"), F.when(F.col("quality") == 1, "supports").otherwise("against").alias("relation"))
    t = labels.select("doc_id", F.lit("t"), F.when(F.col("toxic") == 1, "mixed").when(F.col("doc_id") % 5 == 0, "off_topic").when(F.col("doc_id") % 7 == 0, "unknown"))
    lang = docs.select("doc_id", F.lit("l"), F.when(F.col("lang") == "de", "neutral").when((F.col("lang") == "fr") & (F.col("doc_id") % 3 == 0), "pending").when(F.col("lang") == "es", "Positive"))
    return q.unionAll(t).unionAll(lang)


_CONS = _VOTES + """, g AS (SELECT doc_id, coalesce(bool_or(r = 'support'), false) AS s, coalesce(bool_or(r = 'challenge'), false) AS c, coalesce(bool_or(r = 'contest'), false) AS x, coalesce(bool_or(r = 'neutral'), false) AS z, coalesce(bool_or(r IN ('underdetermined', 'unclear')), false) AS u, count(r) AS n_votes FROM n GROUP BY 1),
k AS (SELECT *, CASE WHEN n_votes = 0 THEN 'underdetermined' WHEN s AND NOT c AND NOT u THEN 'support' WHEN c AND NOT s AND NOT u THEN 'challenge' WHEN (s AND c) OR x THEN 'contest' WHEN NOT s AND NOT c AND z THEN 'neutral' ELSE 'underdetermined' END AS relation FROM g)"""


@query("relation_consensus", _CONS + " SELECT doc_id, relation, CASE WHEN relation IN ('support', 'challenge', 'neutral') THEN relation WHEN relation = 'contest' THEN 'unclear' WHEN s THEN 'support' WHEN c THEN 'challenge' ELSE 'unclear' END AS weak_direction, CASE relation WHEN 'contest' THEN 'human' WHEN 'underdetermined' THEN 'more_evidence' ELSE 'none' END AS adjudication, n_votes FROM k")
def relation_consensus(spark, sf_dir):
    return C.consensus(votes(spark, sf_dir), ["doc_id"])


@query("relation_normalise", _VOTES + " SELECT doc_id, parser, coalesce(r, 'unclear') AS relation FROM n")
def relation_normalise(spark, sf_dir):
    return votes(spark, sf_dir).select("doc_id", "parser", C.normalise_relation(F.col("relation")).alias("relation"))


@query("single_parser_relation", _VOTES + " SELECT doc_id, coalesce(first(r ORDER BY parser) FILTER (r IN ('support', 'challenge', 'contest')), 'unclear') AS relation FROM n GROUP BY 1")
def single_parser_relation(spark, sf_dir):
    rows = votes(spark, sf_dir).select("doc_id", F.struct("parser", C.normalise_relation(F.col("relation")).alias("r")).alias("v"))
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return ordered.select("doc_id", C.single_reader(F.transform("vs", lambda v: v["r"])).alias("relation"))


@query("next_review_paper", _CONS + " SELECT doc_id FROM k WHERE relation IN ('contest', 'underdetermined') ORDER BY n_votes DESC, doc_id LIMIT 1")
def next_review_paper(spark, sf_dir):
    return C.consensus(votes(spark, sf_dir), ["doc_id"]).filter(F.col("relation").isin("contest", "underdetermined")).orderBy(F.desc("n_votes"), F.asc("doc_id")).limit(1).select("doc_id")


@query("ablation_metrics", _CONS + " SELECT count(*) AS n, sum((s OR c)::INT)::BIGINT AS direct_commits, sum(((s OR c) AND relation IN ('contest', 'underdetermined'))::INT)::BIGINT AS prevented, round(100.0::DOUBLE * sum(((s OR c) AND relation IN ('contest', 'underdetermined'))::INT) / greatest(sum((s OR c)::INT), 1), 2) AS reduction_pct FROM k")
def ablation_metrics(spark, sf_dir):
    rows = votes(spark, sf_dir).select("doc_id", C.normalise_relation(F.col("relation")).alias("r"))
    direct = rows.groupBy("doc_id").agg(F.bool_or(F.col("r").isin("support", "challenge")).alias("direct"))
    both = C.consensus(votes(spark, sf_dir), ["doc_id"]).join(direct, "doc_id")
    stopped = F.count_if(F.col("direct") & F.col("relation").isin("contest", "underdetermined"))
    return both.agg(F.count("*").alias("n"), F.count_if("direct").alias("direct_commits"), stopped.alias("prevented"), F.round(100.0 * stopped / F.greatest(F.count_if("direct"), F.lit(1)), 2).alias("reduction_pct"))


@query("relation_by_mode_pivot", _CONS + " SELECT lang, count(*) FILTER (relation = 'support') AS support, count(*) FILTER (relation = 'challenge') AS challenge, count(*) FILTER (relation = 'contest') AS contest, count(*) FILTER (relation = 'neutral') AS neutral, count(*) FILTER (relation = 'underdetermined') AS underdetermined, count(*) AS total FROM k JOIN documents USING (doc_id) GROUP BY 1")
def relation_by_mode_pivot(spark, sf_dir):
    rows = C.consensus(votes(spark, sf_dir), ["doc_id"]).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    kinds = ["support", "challenge", "contest", "neutral", "underdetermined"]
    counts = rows.groupBy("lang").pivot("relation", kinds).count().na.fill(0)
    return counts.select("lang", *kinds, sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])).alias("total"))


_SRC = "CASE event_type WHEN 'view' THEN 'paper' WHEN 'click' THEN 'experiment' WHEN 'error' THEN 'benchmark' WHEN 'signup' THEN 'report' ELSE 'external' END"
_EVD = f"""WITH ev AS (SELECT user_id AS belief, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'neutral' WHEN event_id % 13 = 0 THEN 'contest' WHEN event_id % 3 = 0 THEN 'challenge' ELSE 'support' END AS direction,
 CASE WHEN value > 150 THEN 'decisive' WHEN value > 80 THEN 'strong' WHEN value > 30 THEN 'moderate' ELSE 'weak' END AS strength, {_SRC} AS source, event_id % 97 = 0 AS override FROM events)"""


def evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = F.when(F.col("event_id") % 11 == 0, "neutral").when(F.col("event_id") % 13 == 0, "contest").when(F.col("event_id") % 3 == 0, "challenge").otherwise("support")
    v = F.when(F.col("value") > 150, "decisive").when(F.col("value") > 80, "strong").when(F.col("value") > 30, "moderate").otherwise("weak")
    t = F.when(F.col("event_type") == "view", "paper").when(F.col("event_type") == "click", "experiment").when(F.col("event_type") == "error", "benchmark").when(F.col("event_type") == "signup", "report").otherwise("external")
    return e.select(F.col("user_id").alias("belief"), F.col("event_id").alias("seq"), d.alias("direction"), v.alias("strength"), t.alias("source"), (F.col("event_id") % 97 == 0).alias("override"))


def held(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("belief")).distinct()
    return users.select("belief", F.lit(0.5).alias("confidence"), F.lit(0.1).alias("entrenchment"), (F.col("belief") % 7).cast("int").alias("dependencies"))


_R = lambda x: f"round(round({x}, 10), 4)"
_IDX = "CASE x.source WHEN 'experiment' THEN 1 WHEN 'benchmark' THEN 2 WHEN 'paper' THEN 3 WHEN 'report' THEN 4 WHEN 'user_observation' THEN 5 ELSE 6 END"
_BASE = "CASE x.source WHEN 'experiment' THEN 0.035 WHEN 'benchmark' THEN 0.025 WHEN 'paper' THEN 0.006 WHEN 'report' THEN 0.006 WHEN 'user_observation' THEN 0.008 ELSE 0.003 END::DOUBLE"
_RAW = "CASE x.strength WHEN 'weak' THEN 0.05 WHEN 'strong' THEN 0.2 WHEN 'decisive' THEN 0.35 ELSE 0.1 END::DOUBLE"
_UP, _MOVES = "x.direction = 'support'", "x.direction IN ('support', 'challenge')"
_SIZE = _R(f"{_RAW} / sqrt(CASE WHEN {_UP} THEN a.ns ELSE a.nc END + 1) * {_R('1 / (1 + 2.0::DOUBLE * a.e)')}")
_LOW = "CASE WHEN x.override THEN 0.0 WHEN x.strength = 'decisive' THEN 0.03 ELSE 0.08 END::DOUBLE"
_HIGH = "CASE WHEN x.override THEN 1.0 WHEN x.strength = 'decisive' THEN 0.97 ELSE 0.92 END::DOUBLE"
_MANY = "(1 + least(a.deps, 5) * 0.08::DOUBLE)"
_TB = f"({_BASE} / sqrt(a.by[{_IDX}] + 1))"
_FOLD = _EVD + f""", l AS (SELECT belief, list({{'c': 0.5::DOUBLE, 'e': 0.1::DOUBLE, 'ns': 0, 'nc': 0, 'by': [0, 0, 0, 0, 0, 0], 'n': 0, 'deps': belief % 7, 'direction': direction, 'strength': strength, 'source': source, 'override': override}} ORDER BY seq) AS xs FROM ev GROUP BY 1),
f AS (SELECT belief, list_reduce(xs, lambda a, x: {{
 'c': CASE WHEN {_MOVES} THEN {_R(f"greatest({_LOW}, least({_HIGH}, {_R(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.c + CASE WHEN {_UP} THEN {_SIZE} ELSE -{_SIZE} END))')}))")} ELSE a.c END,
 'e': {_R(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.e + CASE WHEN {_MOVES} THEN {_R(f'CASE WHEN {_UP} THEN {_TB} * {_MANY} ELSE -({_TB} / {_MANY}) END')} ELSE 0 END + CASE WHEN x.override THEN 0.08::DOUBLE ELSE 0 END))")},
 'ns': (a.ns + ({_UP})::INT)::INT, 'nc': (a.nc + (x.direction = 'challenge')::INT)::INT, 'by': CASE WHEN {_UP} THEN list_transform(a.by, lambda v, i: (v + (i = {_IDX})::INT)::INT) ELSE a.by END, 'n': (a.n + 1)::INT, 'deps': a.deps, 'direction': x.direction, 'strength': x.strength, 'source': x.source, 'override': x.override}},
 {{'c': 0.5::DOUBLE, 'e': 0.1::DOUBLE, 'ns': 0, 'nc': 0, 'by': [0, 0, 0, 0, 0, 0], 'n': 0, 'deps': belief % 7, 'direction': '', 'strength': '', 'source': '', 'override': false}}) AS s FROM l)"""


@query("confidence_fold", _FOLD + " SELECT belief, s.c AS confidence, s.ns AS n_support, s.nc AS n_challenge, s.n AS n_steps FROM f")
def confidence_fold(spark, sf_dir):
    return B.fold(evidence(spark, sf_dir), held(spark, sf_dir)).drop("entrenchment")


@query("entrenchment_fold", _FOLD + " SELECT belief, s.e AS entrenchment FROM f")
def entrenchment_fold(spark, sf_dir):
    return B.fold(evidence(spark, sf_dir), held(spark, sf_dir)).select("belief", "entrenchment")


@query("confidence_fold_long", _FOLD + " SELECT belief, s.c AS confidence, s.e AS entrenchment FROM f")
def confidence_fold_long(spark, sf_dir):
    return B.fold_long(evidence(spark, sf_dir), held(spark, sf_dir)).select("belief", "confidence", "entrenchment")


@query("linear_confidence_fold", _EVD + f", l AS (SELECT belief, list(CASE direction WHEN 'support' THEN 1 WHEN 'challenge' THEN -1 ELSE 0 END * CASE strength WHEN 'weak' THEN 0.05 WHEN 'strong' THEN 0.2 WHEN 'decisive' THEN 0.35 ELSE 0.1 END::DOUBLE ORDER BY seq) AS ds FROM ev GROUP BY 1) SELECT belief, list_reduce(ds, lambda a, d: {_R('greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + d))')}, 0.5::DOUBLE) AS confidence FROM l")
def linear_confidence_fold(spark, sf_dir):
    return B.linear_fold(evidence(spark, sf_dir))


@query("repeated_evidence_damping", _EVD + " SELECT belief, seq, count(*) OVER w AS n_before, round(1 / sqrt(count(*) OVER w + 1), 6) AS damping FROM ev WHERE direction IN ('support', 'challenge') WINDOW w AS (PARTITION BY belief, direction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def repeated_evidence_damping(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("belief", "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = evidence(spark, sf_dir).filter(F.col("direction").isin("support", "challenge"))
    return rows.select("belief", "seq", F.count("*").over(w).alias("n_before"), F.round(1 / F.sqrt(F.count("*").over(w) + 1), 6).alias("damping"))


@query("evidence_strength_facts", f"WITH e AS (SELECT event_id, {_SRC} AS s, value > 50 AS lod FROM events), p AS (SELECT event_id, CASE s WHEN 'experiment' THEN 2.25 WHEN 'benchmark' THEN 2.25 WHEN 'paper' THEN 1.5 WHEN 'report' THEN 1.0 ELSE 0.5 END::DOUBLE + CASE WHEN lod THEN 0.25 ELSE 0 END::DOUBLE AS score FROM e) SELECT event_id, score, CASE WHEN score >= 3.25 THEN 'decisive' WHEN score >= 2.25 THEN 'strong' WHEN score >= 1.5 THEN 'moderate' ELSE 'weak' END AS strength FROM p")
def evidence_strength_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value"), F.col("event_type"))
    src = F.when(F.col("event_type") == "view", "paper").when(F.col("event_type") == "click", "experiment").when(F.col("event_type") == "error", "benchmark").when(F.col("event_type") == "signup", "report").otherwise("external")
    return rows.select("event_id", C.strength_from_facts(src, F.col("value") > 50).alias("s")).select("event_id", "s.score", "s.strength")


@query("evidence_direction", "WITH e AS (SELECT o_orderkey, o_custkey AS b, o_orderkey % 9 AS m, o_orderpriority AS p FROM orders) SELECT o_orderkey, CASE WHEN m = 0 THEN 'contest' WHEN m = 1 THEN 'underdetermined' WHEN m = 2 THEN 'neutral' WHEN m = 3 THEN 'challenge' WHEN m = 4 THEN 'support' WHEN p = '1-URGENT' THEN 'challenge' WHEN p = '2-HIGH' THEN 'contest' WHEN p = '3-MEDIUM' AND m = 5 THEN 'neutral' ELSE 'support' END AS direction FROM e")
def evidence_direction(spark, sf_dir):
    o, b, m = table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey") % 9
    listed = lambda k: F.when(m == k, F.array(b)).otherwise(F.array().cast("array<bigint>"))
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "weaken").when(F.col("o_orderpriority") == "2-HIGH", "contest").when(F.col("o_orderpriority") == "3-MEDIUM", "update").otherwise("strengthen")
    return o.select("o_orderkey", C.direction(b, action, listed(0), listed(1), listed(2), listed(3), listed(4), F.when(m == 5, "neutral").otherwise("support")).alias("direction"))


@query("evidence_queue", _CONS + " SELECT d.doc_id, d.source, k.relation FROM k JOIN documents d USING (doc_id) WHERE k.relation IN ('contest', 'underdetermined') AND k.n_votes > 0")
def evidence_queue(spark, sf_dir):
    rows = C.consensus(votes(spark, sf_dir), ["doc_id"]).filter(F.col("relation").isin("contest", "underdetermined") & (F.col("n_votes") > 0))
    return rows.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "relation")


@query("belief_map_nested", _EVD + " SELECT belief, count(*) FILTER (direction = 'support') AS n_support, count(*) FILTER (direction = 'challenge') AS n_challenge, string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (direction = 'contest') AS contested FROM ev GROUP BY 1")
def belief_map_nested(spark, sf_dir):
    rows = evidence(spark, sf_dir).groupBy("belief", "direction").agg(F.sort_array(F.collect_list("seq")).alias("ids"))
    nested = rows.groupBy("belief").agg(F.map_from_entries(F.collect_list(F.struct("direction", "ids"))).alias("links"))
    size = lambda k: F.coalesce(F.size(F.col("links")[k]), F.lit(0)).cast("long")
    n = lambda k: F.when(F.col("links")[k].isNull(), 0).otherwise(size(k)).cast("long")
    return nested.select("belief", n("support").alias("n_support"), n("challenge").alias("n_challenge"), F.array_join(F.transform(F.col("links")["contest"], lambda x: x.cast("string")), ",").alias("contested"))


@query("status_transitions", f"SELECT event_id, CASE WHEN a = 'contest' THEN 'contested' WHEN a = 'challenge' THEN 'challenged' WHEN a = 'resolve' THEN 'resolved' WHEN a = 'strengthen' THEN 'active' ELSE 'draft' END AS status FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'contest' WHEN 'click' THEN 'challenge' WHEN 'error' THEN 'resolve' WHEN 'signup' THEN 'strengthen' ELSE 'update' END AS a FROM events)")
def status_transitions(spark, sf_dir):
    a = F.when(F.col("event_type") == "view", "contest").when(F.col("event_type") == "click", "challenge").when(F.col("event_type") == "error", "resolve").when(F.col("event_type") == "signup", "strengthen").otherwise("update")
    return table(spark, sf_dir, "events").select("event_id", C.action_status(F.lit("draft"), a).alias("status"))


