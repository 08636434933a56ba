"""Scoring and storing of candidates as one plan: each row is scored once and gives what the stores are to take.

One scan makes all outputs: a row becomes records of its routes (reject; paper; concept; justification), told apart by
``route``. Counts by route and tier are observed while the plan runs, so none needs a second pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import scoring as S
from cairnlight.operators.frames import said

ROUTES = ("reject", "paper", "concept", "justification")
#: Fields of a verdict without a reply, and bounds of a concept's weight.
RULES_ONLY = {"signal_tier": "LOW_PRIORITY", "novelty_type": "Incremental Optimization", "strategic_value": "Low Strategic Value", "action": "Skip"}
WEIGHTS = ((7, "high"), (4, "medium"))
OVERRATED = 2


def classified(papers: DataFrame, dictionary: Mapping[str, int], tiers: Sequence[Sequence[str]], domains: Mapping[str, Sequence[str]], non_research: Sequence[str] = V.NON_RESEARCH, reply: str | None = None) -> DataFrame:
    """The columns of ``papers`` (doi, title, abstract, journal, pub_date) and the verdict of each, in one struct ``v``.

    Without a reply (a VARIANT column, null where none was asked or none came) the rules alone classify; a reply counts
    only where the signals' dispatch isn't LOW. Support falls by a domain mismatch, and by two where a reply calls evidence
    strong that the rules find weak. Null texts are empty.
    """
    text = F.concat_ws(" ", T.blank(F.col("title")), T.blank(F.col("abstract")))
    rows = T.once(papers, _text=text, _t=T.prepare(text))
    t1, t2, t3 = S.tier_counts(F.col("_t"), tiers)
    rows = T.once(rows, _out=S.is_non_research(F.col("_text"), non_research), _signals=S.matched(F.col("_t"), dictionary), _dispatch=S.dispatch(t1, t2, t3), _kind=S.paper_type(F.lit(""), F.col("_text")))
    answer = F.col(reply) if reply else F.lit(None).cast("variant")
    asked = answer.isNotNull() & (F.col("_dispatch") != "LOW")
    field = lambda name: F.when(asked, F.trim(said(answer, name))).otherwise(RULES_ONLY.get(name, ""))
    number = lambda name: F.when(asked, F.coalesce(F.try_variant_get(answer, f"$.{name}", "double"), F.lit(0.0))).otherwise(0.0)
    names = ("concept_name", "problem_class", "novelty_type", "strategic_value", "concept_support_name", "support_type", "evidence_strength", "why_matters", "action")
    rows = T.once(rows, **{f"_{n}": field(n) for n in names}, _tier=F.upper(F.coalesce(F.nullif(field("signal_tier"), F.lit("")), F.lit("LOW_PRIORITY"))), _influence=number("trajectory_influence"), _given=number("concept_support"), _asked=asked)
    rows = T.once(rows, _domain=S.domain_consistency(F.col("_problem_class"), F.col("_concept_support_name"), domains), _evidence=S.evidence_strength(F.col("journal"), F.col("abstract"), F.col("_problem_class"), F.col("_novelty_type")))
    overrated = (F.col("_evidence_strength") == "High") & (F.col("_evidence.strength") == "Low")
    support = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.col("_given") - F.col("_domain.penalty")) - F.when(overrated, OVERRATED).otherwise(0))
    score = F.aggregate("_signals", F.lit(0), lambda n, s: n + s["weight"])  # as signal_score, without looking again
    kind = F.col("_kind")
    verdict = F.struct(
        F.col("_out").alias("ignored"), score.alias("score"), F.when(F.col("_out"), "IGNORE").otherwise(F.col("_tier")).alias("tier"), F.col("_dispatch").alias("dispatch"), F.transform("_signals", lambda s: s["phrase"]).alias("signals"),
        F.col("_asked").alias("by_reply"), *(F.col(f"_{n}").alias(n) for n in names), F.col("_influence").alias("trajectory_influence"), support.alias("concept_support"), F.col("_given").alias("concept_support_raw"),
        F.col("_domain.flag").alias("domain_flag"), F.col("_evidence.strength").alias("evidence_found"), overrated.alias("overrated"), kind.alias("paper_type"), S.judgment_mode(F.lit(""), kind).alias("judgment_mode"))
    return rows.select(*papers.columns, verdict.alias("v"))


RECORD = "struct<route:string,key:string,doi:string,tier:string,score:int,name:string,weight:string,support_type:string,strength:string,note:string,support:double>"


def routed(rows: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Records of all routes from ``classified`` rows: route, key (what the store merges by) and what it takes.

    A reject is keyed by doi and stops there; a paper by doi; a concept by its name, and a justification by name and doi,
    where the verdict has one. ``counts`` gets the number of records of each route, and of rows by reply, once the plan has
    run.
    """
    v, doi = F.col("v"), T.blank(F.col("doi"))
    weight = F.lit("low")
    for least, name in reversed(WEIGHTS):
        weight = F.when(v["trajectory_influence"] >= least, name).otherwise(weight)

    def record(route: str, key: Column, name: Column | None = None, weight: Column | None = None, kind: Column | None = None, strength: Column | None = None, note: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        parts = [F.lit(route), key, doi, v["tier"], v["score"], *(none if c is None else c for c in (name, weight, kind, strength, note)), v["concept_support"] if route == "paper" else F.lit(None)]
        return F.struct(*parts).cast(RECORD)

    concept, supported = v["concept_name"] != "", (v["concept_support_name"] != "") & (F.lower(v["concept_support_name"]) != "none")
    made = F.when(v["ignored"], F.array(record("reject", doi))).otherwise(F.filter(F.array(
        record("paper", doi, v["concept_name"], None, v["support_type"], v["evidence_strength"], v["action"]),
        F.when(concept, record("concept", v["concept_name"], v["concept_name"], weight, None, None, v["why_matters"])),
        F.when(supported, record("justification", F.concat_ws("|", v["concept_support_name"], doi), v["concept_support_name"], None, v["support_type"], v["evidence_strength"], v["why_matters"])),
    ), lambda r: r.isNotNull()))
    out = rows.select(F.explode(made).alias("r"), v["by_reply"].alias("by_reply")).select("r.*", "by_reply")
    if counts is not None:
        out = out.observe(counts, *(F.count_if(F.col("route") == r).alias(r) for r in ROUTES), F.count_if(F.col("by_reply") & F.col("route").isin("paper", "reject")).alias("by_reply"))
    return out.drop("by_reply")


def store(records: DataFrame, path: str) -> None:
    """All routes in one pass, a folder each (``route=...``), beside what is there; merges read the folder they need."""
    records.write.mode("append").partitionBy("route").parquet(path)
