"""Briefing intake: boundary checks, decision, claim gates, overclaim weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlight import vocab as V


def decision(blockers: Column, conflict: Column, legacy: Column, has_claims: Column, level: Column, reliability: Column, semantic: Column, epistemic: Column, abstract_only: Column, n_candidates: Column) -> Column:
    """struct(decision, reason): the first that holds of block, conflict, thin source, unreliable reader, method risk, abstract, else accept."""
    pair = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason")) if isinstance(d, str) else F.struct(d.alias("decision"), F.lit(r).alias("reason"))
    return (F.when(F.size(blockers) > 0, F.struct(F.lit("reject").alias("decision"), F.get(blockers, F.lit(0)).alias("reason")))
            .when(conflict | (legacy == "contest"), pair("escalate", "directional_reader_conflict"))
            .when(~has_claims | (level == "title_only"), pair("request_refresh", "insufficient_source_text_for_intake"))
            .when(reliability == "not_admissible", pair("request_refresh", "task_reliability_not_admissible"))
            .when((semantic == "high") | (epistemic == "high"), pair("escalate", "methodology_risk_requires_human_review"))
            .when(abstract_only, pair("partial_accept", "admissible_as_intake_only"))
            .otherwise(pair(F.when(n_candidates > 0, "accept").otherwise("partial_accept"), "briefing_admissible_for_kernel_review")))


def route_candidates(verdict: Column, candidates: Column) -> Column:
    """struct(accepted, deferred, rejected) of candidate ids. ``candidates``: array of candidate_id, target_layer, risk.

    A candidate without an id is named by its position. Only low-risk source candidates of a partial accept on an
    abstract are taken at once; a rejected briefing rejects all; else all wait.
    """
    named = F.transform(candidates, lambda c, i: F.struct(F.coalesce(F.when(c["candidate_id"] != "", c["candidate_id"]), F.concat(F.lit("candidate_"), F.lpad((i + 1).cast("string"), 2, "0"))).alias("id"), ((c["target_layer"] == "source") & (c["risk"] == "low")).alias("low")))
    ids = lambda xs: F.transform(xs, lambda c: c["id"])
    none = F.array().cast("array<string>")
    taken = F.when(verdict["reason"] == "admissible_as_intake_only", ids(F.filter(named, lambda c: c["low"]))).otherwise(none)
    rejected = F.when(verdict["decision"] == "reject", ids(named)).otherwise(none)
    return F.struct(taken.alias("accepted"), F.when(verdict["decision"] == "reject", none).otherwise(F.array_except(ids(named), taken)).alias("deferred"), rejected.alias("rejected"))


def touch_gate(relation: Column, required: Column, measured: Column) -> Column:
    """Support needs every required key claim measured, a challenge one; other relations aren't directional."""
    hit = F.array_intersect(required, measured)
    return (F.when(relation == "support", F.when((F.size(required) > 0) & (F.size(hit) == F.size(F.array_distinct(required))), "passed").otherwise("key_claim_not_measured_or_tested"))
            .when(relation == "challenge", F.when(F.size(hit) > 0, "passed").otherwise("key_claim_not_measured_or_tested")).otherwise("not_directional"))


def negative_weight(flags: Column, risk: Column, weights=V.OVERCLAIM_WEIGHTS) -> Column:
    """Sum of the flags' weights, at least .35 at high risk and .2 at medium; one at most. .35 and over blocks."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    total = F.aggregate(F.array_distinct(flags), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    floor = F.when(risk.isin("high", "severe", "critical"), 0.35).when(risk.isin("medium", "moderate"), 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(total, floor)), 4)


def research_decision(intake: Column, relation: Column, needs_read: Column, revision: Column, question: Column, trajectory: Column) -> Column:
    """Nine ordered branches from an intake verdict and what the judgment frame warrants to a research decision."""
    return (F.when(intake == "reject", "no_change").when(intake.isin("escalate", "request_refresh", "defer"), "request_action_or_read")
            .when(needs_read, "request_action_or_read").when(revision, "propose_belief_revision").when(relation == "contest", "request_action_or_read")
            .when(question, "open_question").when(trajectory, "propose_trajectory_update").otherwise("no_change"))


def uncertainty(intake: Column, relation: Column, high: Column, abstract_only: Column, refresh: Column) -> Column:
    return (F.when(high | (intake == "escalate") | (relation == "contest"), "high")
            .when(abstract_only | refresh | relation.isin("underdetermined", "unclear"), "medium").otherwise("low"))
