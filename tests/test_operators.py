"""Golden values and properties of the operators."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import beliefs as B
from cairnlight.operators import consensus as C
from cairnlight.operators import intake as I
from cairnlight.operators import merge as M
from cairnlight.operators import parsing as P
from cairnlight.operators import ranking as R
from cairnlight.operators import review as W
from cairnlight.operators import scoring as S
from cairnlight.operators import similarity as X
from cairnlight.operators import tasks as K


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_mode_scores(spark):
    fields = [F.lit(float(v)) for v in (4, 10, 8, 9, 3)]
    kind = S.paper_type(F.lit(""), F.lit("a new mechanism of recognition"))
    row = one(spark, kind.alias("k"), S.judgment_mode(F.lit(""), kind).alias("m"), S.mode_score(S.judgment_mode(F.lit(""), kind), fields).alias("s"))
    assert (row.k, row.m, row.s) == ("mechanism_paper", "mechanism_shift", 7.8)
    row = one(spark, S.paper_type(F.lit("Benchmark"), F.lit("")).alias("a"), S.paper_type(F.lit(None).cast("string"), F.lit("Sensing New Validation")).alias("b"), S.judgment_mode(F.lit("Screen"), F.lit("x")).alias("m"))
    assert (row.a, row.b, row.m) == ("validation_or_benchmark_paper", "validation_or_benchmark_paper", "screen")
    assert set(V.TYPE_MODES.values()) == set(V.MODE_WEIGHTS) and all(abs(sum(w) - 1) < 1e-9 for w in V.MODE_WEIGHTS.values())


def test_last_tier_wins():
    assert V.dictionary(("a", "b"), ("b",), ("a",)) == {"a": 1, "b": 3}


@pytest.mark.parametrize(("counts", "tier"), [((2, 0, 0), "FULL"), ((1, 2, 0), "FULL"), ((1, 1, 0), "MEDIUM"), ((0, 2, 0), "MEDIUM"), ((0, 0, 3), "MEDIUM"), ((0, 1, 2), "LOW")])
def test_dispatch(spark, counts, tier):
    assert one(spark, S.dispatch(*(F.lit(c) for c in counts)).alias("t")).t == tier


@pytest.mark.parametrize(("f", "listed", "tier"), [((8, 0, 0, 0), 0, "HIGH_PRIORITY"), ((1, 9, 8, 0), 0, "HIGH_PRIORITY"), ((5.5, 0, 0, 8), 0, "IMPORTANT"), ((4, 0, 0, 0), 0, "POTENTIAL"), ((1, 0, 0, 0), 1, "WATCHLIST"), ((1, 0, 0, 0), 0, "LOW_PRIORITY")])
def test_rank_tier(spark, f, listed, tier):
    assert one(spark, S.rank_tier(*(F.lit(float(x)) for x in f), F.lit(bool(listed))).alias("t")).t == tier


def test_evidence_strength(spark):
    est = lambda j, a, p="", n="": one(spark, S.evidence_strength(F.lit(j), F.lit(a), F.lit(p), F.lit(n)).alias("e")).e
    assert (est("Nature Materials", "n = 120, validated").score, est("Nature Materials", "n = 120, validated").strength) == (8.5, "High")
    assert est("ACS Nano", "", "", "New Mechanism").score == 6.5
    assert est("Other", "", "Review/Perspective").strength == "Low"
    assert est(None, None).score == 5.0


def test_text_functions(spark):
    row = one(spark, T.prepare(F.lit(" <i>Ion</i>-gated ")).alias("p"), T.doi_of(F.lit("https://x/articles/s41563-026-02616-4")).alias("d"), T.doi_of(F.lit("https://doi.org/10.1038/abc.")).alias("e"),
              T.doi_of(F.lit(None).cast("string")).alias("n"), T.normalise_doi(F.lit("https://doi.org/10.1/ABC.")).alias("q"), T.iso_date(F.array(F.lit(2026), F.lit(5), F.lit(1))).alias("t"),
              T.clean(F.lit("<b>a</b>   long text here"), 10).alias("c"), T.words(F.lit("  a  b ")).alias("w"), T.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("g"), T.ngrams(F.array(F.lit("a")), 2).alias("h"),
              T.ratio_score(F.lit("7.5/10")).alias("r"), T.truthy(F.lit("Yes")).alias("y"), T.first_sentence(F.lit("One. We show two! Three?"), ("three", "show")).alias("s"), T.has_term(F.lit("the ev is"), "ev").alias("v"), T.has_term(F.lit("every"), "ev").alias("z"))
    assert row.p == "ion gated" and row.d == "10.1038/s41563-026-02616-4" and row.e == "10.1038/abc" and row.n == "" and row.q == "10.1/abc"
    assert row.t == "2026-05-01" and row.c == "a long..." and row.w == ["a", "b"] and row.g == ["a b", "b c"] and row.h == []
    assert row.r == 7.5 and row.y and row.s == "Three?" and row.v and not row.z


VOTES = [(["support", "supports"], "support"), (["support", "challenge", "unclear"], "contest"), (["support", "unclear"], "underdetermined"), ([], "underdetermined"), (["off_topic", "neutral"], "neutral"), (["Two_Edged"], "contest"), (["support", "contest"], "support")]


@pytest.mark.parametrize(("votes", "relation"), VOTES)
def test_consensus(spark, votes, relation):
    rows = spark.createDataFrame([(1, v) for v in votes] or [(1, None)], "id int, relation string")
    out = C.consensus(rows, ["id"]).first()
    assert out.relation == relation
    assert out.adjudication == {"contest": "human", "underdetermined": "more_evidence"}.get(relation, "none")
    if votes == ["support", "unclear"]:
        assert out.weak_direction == "support"


def folded(spark, evidence, conf=0.5, ent=0.0, deps=0, fold=B.fold):
    ev = spark.createDataFrame([(1, i, *e) for i, e in enumerate(evidence)], "belief long, seq long, direction string, strength string, source string, override boolean")
    return fold(ev, spark.createDataFrame([(1, conf, ent, deps)], "belief long, confidence double, entrenchment double, dependencies int")).first()


def test_fold_goldens(spark):
    assert folded(spark, [("support", "moderate", "paper", False)]).confidence == 0.6
    assert folded(spark, [("support", "moderate", "paper", False)], ent=0.8).confidence == 0.5385
    many = folded(spark, [("support", "moderate", "paper", False)] * 20)
    assert many.confidence == 0.92 and many.entrenchment < 0.2
    assert folded(spark, [("support", "strong", "paper", True)], conf=0.9).confidence == 1.0
    assert folded(spark, [("support", "strong", "paper", True)], conf=0.9).entrenchment > 0.07
    assert folded(spark, [("support", "moderate", "benchmark", False)]).entrenchment == 0.025
    assert folded(spark, [("support", "moderate", "benchmark", False)], deps=5).entrenchment == 0.035
    assert folded(spark, [("contest", "decisive", "paper", False)]).confidence == 0.5


STEP = st.tuples(st.sampled_from(["support", "challenge", "neutral", "contest"]), st.sampled_from(["weak", "moderate", "strong", "decisive"]), st.sampled_from(["paper", "experiment", "other"]), st.booleans())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(STEP, min_size=1, max_size=12))
def test_fold_forms_agree_and_stay_in_bounds(spark, evidence):
    a, b = folded(spark, evidence), folded(spark, evidence, fold=B.fold_long)
    assert abs(a.confidence - b.confidence) < 1e-9 and abs(a.entrenchment - b.entrenchment) < 1e-9
    assert 0 <= a.confidence <= 1 and 0 <= a.entrenchment <= 1


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 5)), min_size=1, max_size=25), st.integers(1, 12))
def test_round_robin_is_the_naive_queue(spark, rows, k):
    data = [(i, b, float(p)) for i, (b, p) in enumerate(rows)]
    got = [r.id for r in R.round_robin(spark.createDataFrame(data, "id int, b string, p double"), "b", F.col("p"), F.col("id"), k, ("d",)).orderBy("queue_rank").collect()]
    ranked = sorted(data, key=lambda r: (-r[2], r[0]))
    buckets = {}
    for r in ranked:
        buckets.setdefault(r[1], []).append(r[0])
    want = []
    for late in (False, True):
        while any(v for b, v in buckets.items() if (b == "d") == late):
            want += [v.pop(0) for b, v in buckets.items() if (b == "d") == late and v]
    assert got == want[:k]


def test_connections_equal_nested_loop(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(25)]
    some = lambda: " ".join(random.sample(words, random.randint(1, 12)))
    rows = [(i, i, random.choice("xyz"), f"2024-0{1 + i % 4}-10", some(), some()) for i in range(60)] + [(99, 99, "x", "2024-04-01", None, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "id int, pos int, kind string, date string, output string, input string").withColumn("date", F.col("date").cast("date"))
    as_of = F.lit("2024-04-20").cast("date")
    got = {(r.a, r.b, r.n_shared) for r in X.connections(df, as_of, k=10_000).collect()}
    recent = [r for r in rows if r[3] >= "2024-02-20" and r[4]]
    want = set()
    for a in recent:
        for b in recent:
            x, y = set(a[4].split()), set(b[5].split())
            if a[0] < b[0] and a[2] != b[2] and len(a[4]) >= 10 and len(b[5]) >= 10 and len(x & y) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.35:
                want.add((a[0], b[0], len(x & y)))
    assert got == want and len(want) > 10
    assert X.connections(df, as_of, days=5, papers=50).count() == 0


def test_connections_in_blocks_are_the_best_of_all(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    some = lambda: " ".join(random.sample(words, random.randint(3, 20)))
    rows = [(i, i, random.choice("xyz"), "2024-04-10", some(), some()) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, pos int, kind string, date string, output string, input string").withColumn("date", F.col("date").cast("date"))
    as_of = F.lit("2024-04-20").cast("date")
    links = []
    for a in rows:
        for b in rows:
            x, y = set(a[4].split()), set(b[5].split())
            if a[0] < b[0] and a[2] != b[2] and len(a[4]) >= 10 and len(b[5]) >= 10 and len(x & y) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.35:
                links.append((-round(len(x & y) / min(len(x), len(y)) + 1e-9, 3), a[0], b[0], len(x & y)))
    full = sum(s == -1 for s, *_ in links)
    for k, block, room in ((full, 4, 200), (full + 5, 7, 10), (3, 1, 1)):
        got = [(r.a, r.b, r.n_shared) for r in X.connections(df, as_of, k=k, block=block, room=room).collect()]
        assert got == [x[1:] for x in sorted(links)[:k]] and full > 3


def test_constraints_denied(spark):
    c = spark.createDataFrame([(1, "alpha beta gamma " + " ".join(f"x{i}" for i in range(30))), (2, "zeta"), (3, "the of"), (4, "beta must alpha")], "cid int, statement string")
    texts = {10: "shows no alpha beta gammas here", 11: "without zetas", 12: "lack of anything", 13: "not alpha beta", 14: "zeta not", 15: None, 16: "no no zeta"}
    p = spark.createDataFrame(list(texts.items()), "pid int, text string")
    got = {(r.cid, r.pid): (r.result, r.confidence) for r in X.constraint_match(c, p).collect()}
    stop, want = set(V.MATCH_STOP_WORDS), {}
    for cid, statement in ((r.cid, r.statement) for r in c.collect()):
        terms = set(statement.split()) - stop
        for pid, t in texts.items():
            share = len(terms & set((t or "").split())) / max(1, len(terms))
            if share >= 0.15:
                want[cid, pid] = ("supported" if share >= 0.4 else "partial", round(share, 2))
            elif t and any(d + " ".join(sorted(terms)[:3]) in t for d in X.DENIALS):
                want[cid, pid] = ("violated", 0.5)
    assert got == want and {v[0] for v in want.values()} >= {"supported", "violated"}


def test_constraints_as_sql_on_odd_rows(spark, tmp_path):
    """Repeated and null paper ids, several denials of one phrase, empty and missing texts; a text is read once for each need."""
    from unittest import mock

    import pyarrow as pa
    import pyarrow.parquet as pq

    from cairnlight.plans import analysis, registry
    from tests.compare import same

    tail = " ".join(f"x{i}" for i in range(30))
    pq.write_table(pa.table({"item_id": [1, 2, 3, 4, 5], "text": [f"alpha beta gamma {tail}", "zeta", "the of", "alpha beta", "f" + "a" * 80]}), tmp_path / "benchmark.parquet")
    texts = {1: ["no alpha beta gamma, not alpha beta gammas, without alpha beta gamma", "lack of alpha beta gamma", "alpha x1 x2 x3 x4 x5"], 2: ["no alpha  beta", "no zeta not zetas"],
             3: [None, "", " no", "\tno ", "no \talpha"], 4: ["no no alpha beta", "no f" + "a" * 79, "not f" + "a" * 90], None: ["no zeta", "zeta without zeta", "absence alpha beta gamma"]}
    rows = [(i, t) for i, ts in texts.items() for t in ts]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), tmp_path / "documents.parquet")
    with mock.patch("tests.compare.TABLES", ["benchmark", "documents"]):
        same(spark, analysis.constraint_match, registry.ORACLE["constraint_match"], str(tmp_path))
    plan = analysis.constraint_match(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("count(1)") == 2


def test_nearest_blocks_and_ties(spark):
    ref = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.0, 3.0]), (12, [-1.0, 0.0])], "id long, embedding array<double>")
    for block in (1, 100):
        got = {r.id: (r.match, r.verdict) for r in X.nearest(ref, q, block).collect()}
        assert got == {10: (1, "high"), 11: (3, "high"), 12: (3, "low")}
    assert X.nearest(ref, q.limit(0)).count() == 0
    assert {r.id: r.match for r in X.nearest(ref, ref).collect()} == {1: 2, 2: 1, 3: 1}  # itself left out


def test_merges(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 5, None)], "k string, seq int, v string")
    assert {(r.k, r.v) for r in M.first_seen(rows, ["k"], [F.col("seq")]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in M.latest(rows, ["k"], [F.col("seq")]).collect()} == {("a", "x"), ("b", None)}
    stored = spark.createDataFrame([(1, "done", 5), (2, "open", 6)], "k int, status string, p int")
    new = spark.createDataFrame([(1, "open", 9), (3, "open", 1)], "k int, status string, p int")
    assert {tuple(r) for r in M.upsert(stored, new, "k", ("done",)).collect()} == {(1, "done", 9), (2, "open", 6), (3, "open", 1)}
    j = spark.createDataFrame([(1, "c", "High"), (2, "c", "Low"), (3, "c", "Low")], "id int, concept string, strength string")
    assert {r.id for r in M.contract(j).collect()} == {1, 3}


def test_fields(spark):
    text = "**SIGNAL_TIER: IMPORTANT**\nRelevance: 7/10\nWHY MATTERS:\n- one\n- two\n\nNovelty = 8\nrelevance: 9/10"
    got = {r.field: r.value for r in P.fields(spark.createDataFrame([(1, text)], "id int, t string"), "id", F.col("t")).collect()}
    assert got == {"signal_tier": "IMPORTANT", "relevance": "9/10", "why_matters": "\n- one\n- two", "novelty": "8"}


def test_sections_tags_tables(spark):
    md = "# d\n## HIGH PRIORITY\n### T1\n- **DOI:** 10.1/x\n### T2\n- **Final Score:** 8.2/10\n## LOW\nNo papers"
    rows = P.sections(spark.createDataFrame([(1, md)], "id int, t string"), "id", F.col("t"))
    got = {r.section: r for r in rows.select("section", "body", P.entries(F.col("body")).alias("e")).collect()}
    assert set(got) == {"HIGH PRIORITY", "LOW"} and len(got["HIGH PRIORITY"].e) == 2 and got["LOW"].e == []
    page = '<meta property="og:image" content="/img/a.png"><img src="https://h/logo.png"><img src="b.jpg">'
    row = one(spark, P.best_candidate(F.lit(page), (("meta", "content", 0), ("img", "src", 60)), ("logo",), r"\.(png|jpe?g)$").alias("u"), P.absolute(F.lit("/img/a.png"), F.lit("https://p.q/r/s")).alias("a"), P.absolute(F.lit("b.jpg"), F.lit("https://p.q/r/s")).alias("b"))
    assert (row.u, row.a, row.b) == ("/img/a.png", "https://p.q/img/a.png", "https://p.q/r/b.jpg")
    t = "x\n| Term | Use |\n|---|---|\n| a | b |\n| c | d |"
    assert [r.cells for r in P.table_rules(spark.createDataFrame([(1, t)], "id int, t string"), "id", F.col("t"), "Term").orderBy("pos").collect()] == [["a", "b"], ["c", "d"]]


def test_review(spark):
    rows = spark.createDataFrame([("r", 1, "a", 0), ("r", 1, "a", 1), ("r", 1, "b", 2), ("r", 2, "c", 3)], "reviewer string, item int, p string, seq int")
    assert {tuple(r) for r in W.settle_feedback(rows, ["reviewer", "item"], "p", "seq").collect()} == {("r", 1, "a", 1, 1), ("r", 2, "c", 0, 0)}
    order = spark.createDataFrame([("A", f"item_{i:03}", i - 1) for i in range(1, 5)], "reviewer_id string, item_id string, presentation_index int")
    done = spark.createDataFrame([("A", "item_001")], "reviewer_id string, item_id string")
    cursor = spark.createDataFrame([("A", 1, "item_002"), ("A", 2, "item_003")], "reviewer_id string, seq int, item_id string")
    assert W.resume(order, done, cursor).first().next_item == "item_003"
    items = spark.createDataFrame([("i", "b", "t", "support", "v")], "item_id string, belief string, title string, kernel_relation string, votes string")
    assert W.safe_items(items).columns == ["item_id", "belief", "title"]


def test_intake(spark):
    none = F.array().cast("array<string>")
    f, t = F.lit(False), F.lit(True)

    def decide(**k):
        a = {"blockers": none, "conflict": f, "legacy": F.lit("support"), "has_claims": t, "level": F.lit("abstract"), "reliability": F.lit("ok"), "semantic": F.lit("low"), "epistemic": F.lit("low"), "abstract_only": f, "n_candidates": F.lit(2)} | k
        cands = F.array(F.struct(F.lit("").alias("candidate_id"), F.lit("source").alias("target_layer"), F.lit("low").alias("risk")), F.struct(F.lit("candidate_02").alias("candidate_id"), F.lit("belief").alias("target_layer"), F.lit("low").alias("risk")))
        d = I.decision(**a)
        row = one(spark, d.alias("d"), I.route_candidates(d, cands).alias("r"))
        return row.d.decision, row.r

    d, r = decide(abstract_only=t)
    assert d == "partial_accept" and r.accepted == ["candidate_01"] and r.deferred == ["candidate_02"]
    d, r = decide(blockers=F.array(F.lit("closed_loop_attempted_commit")), abstract_only=t)
    assert d == "reject" and r.rejected == ["candidate_01", "candidate_02"] and r.deferred == []
    assert decide(conflict=t)[0] == "escalate" and decide()[0] == "accept" and decide(n_candidates=F.lit(0))[0] == "partial_accept" and decide(level=F.lit("title_only"))[0] == "request_refresh"
    some = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    assert one(spark, I.touch_gate(F.lit("support"), some("a"), some("b")).alias("g")).g == "key_claim_not_measured_or_tested"
    assert one(spark, I.negative_weight(some("scope_overclaim", "missing_controls"), F.lit("low")).alias("w")).w == 0.45


def test_tasks(spark):
    row = one(spark, K.calibrate(F.lit("verify_constraint"), F.lit(10.0), F.lit("An EV readout, everywhere"), {"ev": 5.0, "generic": -5.0}).alias("p"),
              K.frontier(F.lit(""), F.lit(""), F.lit("next_kernel_move"), F.lit("x"), (("A", ("rna",)),)).alias("f"), K.frontier(F.lit(""), F.lit("c"), F.lit("t"), F.lit("rna"), ()).alias("g"), K.summary_state(F.lit(1), F.lit(0), F.lit(0)).alias("s"))
    assert row.p == 19.0 and row.f == V.DEFERRED_FRONTIER and row.g == "Concept: c" and row.s == "unstable"


def test_constraints_on_very_long_words(spark):
    """A word of a million letters after a denial: looked up by its first letters, and a hit is checked in full."""
    long = "f" + "a" * 1_000_000
    constraints = spark.createDataFrame([(1, "fa"), (2, "f" + "a" * 80), (3, "f" + "a" * 63 + "b"), (4, "zzz")], "cid long, statement string")
    papers = spark.createDataFrame([(1, f"there is no {long}"), (2, "no f" + "a" * 70), (3, None)], "pid long, text string")
    got = {(r.cid, r.pid): r.result for r in X.constraint_match(constraints, papers, stop=()).collect()}
    assert got == {(1, 1): "violated", (2, 1): "violated", (1, 2): "violated"}


def test_packets_of_any_size(spark):
    items = spark.range(5000).select(F.col("id").alias("item_id"))
    rows = R.presentation_order(items, spark.createDataFrame([(7,), (8,)], "reviewer_id long"), "p").collect()
    import hashlib

    for reviewer in (7, 8):
        order = sorted(range(5000), key=lambda i: hashlib.sha256(f"p|{reviewer}|{i}".encode()).hexdigest())
        assert [i for _, i in sorted((r.presentation_index, r.item_id) for r in rows if r.reviewer_id == reviewer)] == order


def test_a_packet_is_dealt_by_its_product(spark, monkeypatch):
    """Ids of reviewers are few bytes, and adaptive execution puts them together; what they meet is sorted in bounded tasks."""
    reviewers = spark.range(3000).select((F.col("id") % 1500).alias("reviewer_id")).distinct()
    rows = R.presentation_order(spark.range(2000).withColumnRenamed("id", "item_id"), reviewers, "p")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(sizes) == 3_000_000 and len(sizes) >= 3 and max(sizes) < 1_500_000
    few = lambda: sorted(tuple(r) for r in R.presentation_order(spark.range(30).withColumnRenamed("id", "item_id"), spark.range(20).withColumnRenamed("id", "reviewer_id"), "p").collect())
    sent = few()
    monkeypatch.setattr(R, "PACKET_SENT", 0)
    assert few() == sent and len(sent) == 600


def test_fields_and_blocks_move_no_rows(spark):
    from cairnlight.operators import ledgers as L
    df = spark.createDataFrame([(1, "A: x\n- y\nB = 2\nA: z"), (1, "A: other"), (2, None), (3, "no field")], "id int, t string")
    for q in (P.fields(df, "id", F.col("t")), L.blocks(df, "id", F.col("t"), "a")):
        assert "Exchange" not in q._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in P.fields(df, "id", F.col("t")).collect()) == [(1, "a", "other"), (1, "a", "z"), (1, "b", "2")]
    assert sorted(tuple(r) for r in L.blocks(df, "id", F.col("t"), "a").collect()) == [(1, 1, "a", "other"), (1, 1, "a", "x"), (1, 2, "a", "z")]


def test_folds_round_as_sql(spark):
    import duckdb

    values = [d / n**0.5 * i / 10000 for i in range(1, 10000, 7) for d in (0.05, 0.1, 0.2, 0.35) for n in (1, 2, 4)]
    values += [-v for v in values]
    want = [r[0] for r in duckdb.execute("SELECT round(round(x, 10), 4) FROM (SELECT unnest(?) AS x)", [values]).fetchall()]
    assert [B._r(v) for v in values] == want
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", B._r4(F.col("x")).alias("x"))
    assert [r.x for r in sorted(rows.collect())] == want


def test_phrases_are_literals_and_evidence_reads_each_once(spark):
    rows = spark.createDataFrame([(1, "a.c (x)|"), (2, "abc"), (3, ""), (4, None)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", T.contains_any(F.col("t"), ("a.c", "zz")).alias("a"), T.contains_any(F.col("t"), ()).alias("b")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, True), 4: (None, None)}
    plan = rows.select(S.evidence_strength(F.lit("nature"), F.col("t"), F.lit("review"), F.lit("")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("independently confirmed") == 1


def test_lines_and_words_are_read_once(spark):
    from cairnlight.operators import learning as L

    rows = spark.createDataFrame([("k: 1\n- ***\n**K = 2**", "gate a gate a gate")], "t string, w string")
    text = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text(L.review_phrases(F.col("w"))).count("regexp_extract_all") == 1
    ordered = P.last_of_each(F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("name"), F.lit(1).alias("at"), x.alias("value"))), "name", "value")
    assert text(ordered).count("array_sort(") + text(ordered).count("arraysort(") == 1
    assert {(r.field, r.value) for r in P.fields(rows.withColumn("i", F.lit(1)), "i", F.col("t")).collect()} == {("k", "2")}
    assert rows.select(L.review_phrases(F.col("w")).alias("x")).first().x == ["a gate", "a gate a", "gate a", "gate a gate"]
