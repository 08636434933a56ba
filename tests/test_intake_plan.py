"""Score-and-store: one scan, routes by verdict, counts observed while it runs."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.operators import intake_plan as I

TIERS = (("alpha gate",), ("beta",), ("gamma",))
DICTIONARY = V.dictionary(*TIERS)
DOMAINS = {"sensing": ("gate",)}


def papers(spark):
    full = {"signal_tier": " important", "concept_name": "Gating ", "problem_class": "Sensing", "concept_support_name": "gate", "evidence_strength": "High", "trajectory_influence": 8, "concept_support": 5, "why_matters": "w"}
    rows = [
        ("1", "Author Correction: alpha gate", "x", "", full), ("2", "Alpha-gate study", "beta", "nature", full), ("3", "nothing", "here", "nature", full), ("4", "alpha gate", None, "nature", None),
        ("5", "alpha gate", "n = 500, validated", "nature", full | {"concept_support_name": "None", "concept_name": ""}), ("6", "alpha gate", "review", "", full | {"concept_support_name": "motor", "problem_class": "sensing review", "trajectory_influence": 4}), (None, None, None, None, None),
    ]
    return spark.createDataFrame([(d, t, a, j, "2024-01-01", json.dumps(r) if r else None, "extra") for d, t, a, j, r in rows], "doi string, title string, abstract string, journal string, pub_date string, r string, route string").withColumn("reply", F.try_parse_json("r"))


def test_verdicts(spark):
    got = {r.doi: r.v for r in I.classified(papers(spark), DICTIONARY, TIERS, DOMAINS, reply="reply").collect()}
    assert [got[k].tier for k in ("1", "2", "3", "4", None)] == ["IGNORE", "IMPORTANT", "LOW_PRIORITY", "LOW_PRIORITY", "LOW_PRIORITY"]
    assert got["2"].by_reply and got["2"].signals == ["alpha gate", "beta"] and got["2"].dispatch == "MEDIUM" and got["2"].concept_name == "Gating"
    assert not got["3"].by_reply and got["3"].concept_name == "" and got["3"].action == "Skip"  # weak signals: the reply doesn't count
    assert got["6"].domain_flag == "Domain mismatch" and got["6"].overrated and got["6"].concept_support == 0 and got["6"].concept_support_raw == 5
    assert got["2"].concept_support == 5 and not got["2"].overrated


def test_routes_counts_and_one_scan(spark, tmp_path):
    papers(spark).write.parquet(str(tmp_path / "p"))
    rows = I.classified(spark.read.parquet(str(tmp_path / "p")), DICTIONARY, TIERS, DOMAINS, reply="reply")
    counts = Observation("routes")
    records = I.routed(rows, counts)
    assert records._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    I.store(records, str(tmp_path / "out"))
    assert counts.get == {"reject": 1, "paper": 6, "concept": 2, "justification": 2, "by_reply": 4}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.route, r.key) for r in out.collect()} == {("reject", "1"), *(("paper", d) for d in ("2", "3", "4", "5", "6", "")), ("concept", "Gating"), ("justification", "gate|2"), ("justification", "motor|6")}
    assert {r.doi: r.weight for r in out.filter("route = 'concept'").collect()} == {"2": "high", "6": "medium"}


def test_without_replies_the_rules_decide(spark):
    df = papers(spark).drop("reply")
    assert {r.route for r in I.routed(I.classified(df, DICTIONARY, TIERS, DOMAINS)).collect()} == {"reject", "paper"}
    assert I.routed(I.classified(df.limit(0), DICTIONARY, TIERS, DOMAINS)).collect() == []
