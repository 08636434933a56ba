"""Frames and decisions against a plain version of the rules over random and odd briefings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.operators import frames as J


def token(x):
    return str(x or "").strip().lower().replace("-", "_").replace(" ", "_")


def flag(x):
    return x if isinstance(x, bool) else bool(x) if isinstance(x, (int, float)) else isinstance(x, str) and x.strip().lower() in ("1", "true", "yes", "y")


def values(x):
    return [] if x is None else [str(v) for v in x if str(v).strip()] if isinstance(x, list) else [str(x)] if str(x).strip() else []


def part(r, name):
    return r.get(name) if isinstance(r.get(name), dict) else {}


def parts(r, name):
    return [x for x in r[name] if isinstance(x, dict)] if isinstance(r.get(name), list) else []


def once(xs):
    return list(dict.fromkeys(xs))


def named(r, fields):
    out = []
    for f in fields:
        x = r.get(f)
        out += [token(k) for k, on in x.items() if flag(on)] if isinstance(x, dict) else [token(v) for v in values(x)]
    return once(x for x in out if x)


def weigh(flags, risk, distance, given):
    w = sum(V.OVERCLAIM_WEIGHTS.get(f, 0.15) for f in flags)
    w = max(w, 0.45 if risk in ("high", "severe", "critical") else 0.2 if risk in ("medium", "moderate") else 0)
    w = max(w, 0.35 if distance in ("high", "far", "large") else 0.18 if distance in ("medium", "moderate") else 0)
    return round(max(0.0, min(1.0, max(w, float(given or 0)))), 4)


def plain(a, b):
    a, b = (x if isinstance(x, dict) else {} for x in (a, b))
    scope, traj = part(b, "relation_scope"), part(b, "trajectory_proposal")
    raw = str(part(scope, "legacy_whole_belief_reader").get("kernel_relation") or "").strip().lower()
    relation = next((k for k, names in V.RELATION_WORDS.items() if raw in names), raw or "not_supplied")
    adm, ref = part(a, "admissibility"), part(a, "refresh_request")
    level = str(part(b, "source").get("input_text_level") or part(b, "source_provenance").get("read_level") or "unknown").strip().lower()
    question, belief = str(traj.get("candidate_question") or "").strip(), str(scope.get("belief_id") or "").strip()
    raw_claims = [c for f in J.KEY_CLAIM_FIELDS for c in parts(scope, f) + parts(b, f)] + [c for c in parts(scope, "atoms") if token(c.get("criticality")) == "required"]
    keys = {}
    for i, c in enumerate(raw_claims, 1):
        key = next((str(c[f]).strip() for f in J.KEY_CLAIM_IDS if str(c.get(f) or "").strip()), f"key_claim_{i:02d}")
        keys.setdefault(key, (token(c.get("role") or c.get("claim_type") or "claim"), token(c.get("criticality") or "required")))
    required = {k: role for k, (role, need) in keys.items() if need == "required"}
    measured, weight, flags, signal = set(), 0.0, [], bool(part(b, "claim_design_audit"))
    for c in parts(b, "claim_map"):
        refs = []
        for f in J.CLAIM_REFS:
            for x in c.get(f) if isinstance(c.get(f), list) else [c.get(f)]:
                refs += [next((str(x[g]).strip() for g in J.REFERRED_IDS if str(x.get(g) or "").strip()), "")] if isinstance(x, dict) else values(x)
        kind, evidence = token(c.get("claim_type")), once(token(v) for f in J.EVIDENCE_TYPES for v in values(c.get(f)))
        for r in refs:
            role = required.get(r)
            if role and any(e in J.MEASURED for e in evidence) and (role not in ("mechanism", "boundary") or kind in (J.MECHANISM if role == "mechanism" else J.BOUNDARY)):
                measured.add(r)
        claim, design, own = named(c, J.CLAIM_SCOPES), named(c, J.EVIDENCE_SCOPES), named(c, J.FLAG_FIELDS)
        own += ["translational_overclaim"] * bool({*claim} & {*J.TRANSLATIONAL} and {*design} & {*J.PROTOTYPE}) + ["platform_overclaim"] * bool({*claim} & {*J.PLATFORM} and {*design} & {*J.NARROW})
        own += ["causal_overclaim"] * (kind in ("causal", "causality") and bool({*evidence} & {"correlation", "association", "observational"})) + ["mechanism_overclaim"] * (kind in ("mechanism", "mechanistic") and bool({*evidence} & {*J.NOT_TOUCHED}))
        own = once(own)
        risk, distance = token(c.get("overclaim_risk") or c.get("claim_design_risk")), token(c.get("evidence_claim_distance") or c.get("claim_design_distance") or c.get("support_gap"))
        weight, flags, signal = max(weight, weigh(own, risk, distance, c.get("negative_weight"))), flags + own, signal or bool(own or risk or distance or claim or design)
    audit = part(b, "claim_design_audit")
    weight = max(weight, weigh(named(audit, J.FLAG_FIELDS), token(audit.get("overclaim_risk") or audit.get("claim_design_risk")), token(audit.get("evidence_claim_distance")), audit.get("negative_weight")))
    flags = once(flags + named(audit, J.FLAG_FIELDS))
    directional = relation in ("support", "challenge")
    gate = "no_frozen_key_claims" if not required else ("passed" if (measured if relation == "challenge" else {*required} <= measured) else "failed") if directional else "not_directional"
    worst = max([{"low": 1, "medium": 2, "high": 3}.get(str(u.get("severity") or "").strip().lower(), 0) for u in parts(b, "uncertainty_map")], default=0)
    abstract, refresh, high = flag(adm.get("abstract_level_only")) or level == "abstract", flag(ref.get("needed")), flag(adm.get("high_uncertainty"))
    conflict = relation == "contest" or bool(parts(b, "disagreement_map"))
    word = lambda box, name: str(part(b, box).get(name) or "unknown").strip().lower()
    text_only, reduce = flag(part(b, "object_grounding").get("text_only")), word("human_feedback_brief", "feedback_type") in ("reduce_overclaim", "downgrade", "request_caution")
    weak, thin = word("object_grounding", "object_text_alignment") in ("none", "weak"), text_only and level != "full_text"
    design = directional and weight >= 0.35
    rules = [("abstract_level_only", abstract), ("refresh_required", refresh), ("reader_or_relation_conflict", conflict), ("high_uncertainty", high or worst == 3), ("uncalibrated_or_downweighted_confidence", flag(part(b, "calibration_status").get("should_downweight_confidence"))),
             ("human_feedback_reduce_overclaim", reduce), ("semantic_audit_risk", word("semantic_audit", "behavioral_risk") in ("medium", "high")), ("weak_object_grounding", weak), ("text_only_abstract_grounding", thin),
             ("no_frozen_key_claims", directional and gate == "no_frozen_key_claims"), ("key_claim_not_measured_or_tested", gate == "failed"), ("claim_design_overclaim_boundary", design)]
    blockers = [n for n, x in rules if x]
    enough, ungrounded, gate_blocks = not abstract and not refresh and level in ("full_text", "paper", "full"), abstract or refresh or weak or thin, directional and gate != "passed"
    opens = bool(question) and (relation in ("underdetermined", "unclear") or high or worst >= 2 or ungrounded or gate_blocks or design)
    moves = "trajectory" in [str(c.get("target_layer") or "").strip() for c in parts(b, "candidate_kernel_updates")] and not conflict
    revises = bool(belief) and directional and enough and gate == "passed" and not design and not conflict and not high
    acts = conflict or ungrounded or ((gate_blocks or design) and not question) or (reduce and not enough)
    pressure = next((n for n, x in (("conflict_resolution", conflict), ("source_grounding", ungrounded), ("belief_revision_pressure", revises), ("open_question_pressure", opens), ("trajectory_pressure", moves)) if x), "background_context")
    intake, nexts, reasons = str(a.get("decision") or "defer"), values(a.get("next_actions")), values(a.get("reasons"))
    said = [f"intake_assessment:{a.get('assessment_id')}"] * bool(a.get("assessment_id")) + [f"judgment_frame:{pressure}"] + [f"secretary_relation_signal:{relation}"] * (relation != "not_supplied")
    asked = next((x for n, x in J.ASKED_BY_BLOCKER if n in blockers), "request_full_text_before_revision")
    branches = [
        (intake == "reject", "intake_reject", "no_change", ["intake_rejected_packet"], ["regenerate_secretary_briefing"]), (intake == "escalate", "intake_escalate", "request_action_or_read", reasons or ["intake_escalation_required"], nexts or ["human_read"]),
        (intake in ("request_refresh", "defer"), "intake_refresh", "request_action_or_read", reasons or [f"intake_{intake}"], nexts or ["refresh_secretary_briefing"]), (acts, "frame_action_or_read", "request_action_or_read", ["judgment_frame_requires_read_or_action"], nexts or [asked]),
        (revises, "frame_belief_revision", "propose_belief_revision", ["judgment_frame_warrants_belief_revision_candidate"], []), (opens, "frame_open_question", "open_question", ["judgment_frame_opens_question"], []),
        (moves and not revises, "frame_trajectory", "propose_trajectory_update", ["judgment_frame_warrants_trajectory_update"], []), (True, "none", "no_change", ["no_research_state_change_warranted"], [])]
    _, branch, decision, why, actions = next(x for x in branches if x[0])
    drivers = once(reasons + values(ref.get("reasons")) + ["abstract_level_only"] * flag(adm.get("abstract_level_only")) + [f"relation:{relation}"] * (relation in ("contest", "underdetermined", "unclear")))
    unsure = "high" if high or branch == "intake_escalate" or relation == "contest" else "medium" if flag(adm.get("abstract_level_only")) or refresh or relation in ("underdetermined", "unclear") else "low"
    status = "not_supplied" if not signal else "overclaim_boundary" if design else "bounded_interpretation" if weight > 0 else "aligned_or_no_overclaim_detected"
    return {"pressure": pressure, "blockers": blockers, "gate": gate, "required": list(required), "measured": [k for k in required if k in measured], "weight": weight, "flags": sorted(flags), "audit": status, "warrants": [acts, revises, opens, moves and not revises],
            "branch": branch, "decision": decision, "why": said + why, "actions": actions, "unsure": unsure, "drivers": drivers}


def made(rnd):
    pick = rnd.choice
    claim = lambda: {"claim_type": pick(["mechanism", "causal", "boundary", "", "Claim"]), pick(J.CLAIM_REFS): pick(["k1", ["k1", "k2"], [{"id": "k2"}, {"ref": " k3 "}, "k9"], None, {"atom_id": "k1"}]),
                     pick(J.EVIDENCE_TYPES): pick(["Measured", ["assumed", "validation"], "correlation", [], "hypothesis"]), pick(J.CLAIM_SCOPES): pick(["clinical", ["platform"], {"patient": True, "broad": "no"}, None]),
                     pick(J.EVIDENCE_SCOPES): pick(["In vitro", ["single-target"], "", {"buffer": "yes"}]), pick(J.FLAG_FIELDS): pick([[], ["missing-controls"], "odd flag", ["scope overclaim", "odd"]]), pick(J.RISK): pick(["", "High", "moderate"]), "negative_weight": pick([None, "", 0.1, "0.4"])}
    key = lambda: {pick(("id", "key_claim_id", "x")): pick(["k1", "k2", "k3"]), "role": pick(["mechanism", "boundary", "claim", None]), "criticality": pick(["required", "Optional", None])}
    few = lambda f, n=3: [f() for _ in range(rnd.randrange(n))]
    b = {"relation_scope": {"belief_id": pick(["b1", "", None]), "legacy_whole_belief_reader": {"kernel_relation": pick(["Supports", "challenge", "contradicts", "mixed", "pending", "unknown", "off-topic", "odd", None])}, "frozen_key_claims": few(key), "atoms": few(key)},
         "key_claims": few(key, 2), "source": {"input_text_level": pick(["full_text", "full_text", "paper", "Abstract", ""])}, "source_provenance": pick([{}, {"read_level": "full"}, "x"]), "claim_map": few(claim), "trajectory_proposal": {"candidate_question": pick(["Why?", " ", None])},
         "uncertainty_map": pick([[], [{"severity": "Medium"}], [{"severity": "high"}, 3], {}]), "candidate_kernel_updates": pick([[], [{"target_layer": "trajectory", "candidate_id": "c"}], [{"target_layer": "source"}]]), "disagreement_map": pick([[]] * 6 + [[{"a": 1}]])}
    if rnd.random() < 0.3:
        b |= {"object_grounding": {"object_text_alignment": pick(["weak", "strong"]), "text_only": pick([True, False])}, "semantic_audit": {"behavioral_risk": pick(["high", "low"])}, "calibration_status": {"should_downweight_confidence": pick([1, 0, "yes"])}}
        b |= {"human_feedback_brief": {"feedback_type": pick(["downgrade", "praise"])}, "claim_design_audit": pick([{}, {"overclaim_flags": ["benchmark overclaim"]}, {"negative_weight": 0.5}])}
    a = {"assessment_id": pick(["A1", ""]), "decision": pick(["accept"] * 8 + ["reject", "escalate", "defer", "request_refresh", None]), "admissibility": {"high_uncertainty": pick([False] * 5 + [True]), "abstract_level_only": pick([False] * 6 + ["true"])},
         "refresh_request": pick([{}, {}, {}, {"needed": True, "reasons": ["r1"]}]), "reasons": pick([[], ["why", "r1"]]), "next_actions": pick([[], [], "act"])}
    return a, b


@pytest.fixture(scope="module")
def cases(spark):
    rnd = random.Random(3)
    sound = lambda relation, **more: ({"decision": "accept", "assessment_id": "A"}, {"relation_scope": {"belief_id": "b1", "legacy_whole_belief_reader": {"kernel_relation": relation}, "frozen_key_claims": [{"id": "k1", "role": "mechanism"}, {"claim": "x"}]},
             "source": {"input_text_level": "full_text"}, "claim_map": [{"claim_type": "mechanism", "evidence_type": ["Measured"], "matched_atoms": ["k1", {"ref": "key_claim_02"}]}], **more})
    pairs = [made(rnd) for _ in range(1500)] + [sound("support"), sound("weaken", candidate_kernel_updates=[{"target_layer": "trajectory"}]), sound("support", claim_design_audit={"negative_weight": 0.34}), sound("support", claim_design_audit={"overclaim_risk": "high"})] + [(None, None), ({}, {}), ([], "x"), ({"decision": "accept"}, {}), ({"decision": "accept"}, {"claim_map": "x", "relation_scope": [1], "key_claims": {"id": 1}})]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, a string, b string").select("id", F.try_parse_json("a").alias("assessment"), F.try_parse_json("b").alias("briefing"))
    return pairs, {r.id: r for r in J.decide(df, "id").collect()}


def test_frames_equal_the_plain_rules(cases):
    pairs, got = cases
    for i, (a, b) in enumerate(pairs):
        r, f, want = got[i], got[i].frame, plain(a, b)
        have = {"pressure": f.primary_pressure, "blockers": f.blockers, "gate": f.claim_gate.status, "required": f.claim_gate.required, "measured": f.claim_gate.measured, "weight": f.design_audit.weight, "flags": sorted(f.design_audit.flags), "audit": f.design_audit.status, "warrants": list(f.warrants),
                "branch": r.branch, "decision": r.decision, "why": r.rationale, "actions": r.required_actions, "unsure": r.uncertainty.level, "drivers": r.uncertainty.drivers}
        assert have == want, (i, a, b)


def test_every_rule_is_met(cases):
    _, got = cases
    assert {r.branch for r in got.values()} == {"intake_reject", "intake_escalate", "intake_refresh", "frame_action_or_read", "frame_belief_revision", "frame_open_question", "frame_trajectory", "none"}
    assert {x for r in got.values() for x in r.frame.blockers} == {n for n, _ in J.BLOCKERS}
    assert {r.frame.primary_pressure for r in got.values()} == {n for n, _ in J.PRESSURES} | {"background_context"}
    assert {r.frame.design_audit.status for r in got.values()} == {"not_supplied", "overclaim_boundary", "bounded_interpretation", "aligned_or_no_overclaim_detected"}


def test_changes_and_alternatives(cases):
    _, got = cases
    for r in got.values():
        assert (r.change is None) == (r.decision == "no_change")
        assert ("direct_belief_revision" in r.rejected_alternatives) == (r.decision != "propose_belief_revision")
        assert r.human_review_required == (r.branch == "intake_escalate")
    assert any(r.change and r.change.change_type == "support_candidate" and r.change.target_layer == "belief" for r in got.values())


def test_records_are_opened_once(spark, sf):
    from cairnlight.plans import catalogue

    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = catalogue.QUERIES["judgment_frames"](spark, sf)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    assert "$.claim_map" not in plan and "$.relation_scope" not in plan  # fields were looked up by path, one by one


def test_fields_of_other_types(spark):
    odd = [{"relation_scope": 7, "claim_map": {"a": 1}, "claim_design_audit": []}, {"relation_scope": {"atoms": "x", "legacy_whole_belief_reader": []}, "claim_map": [None, 3, [{}]]}, 7, [], None]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(odd)] + [(9, None)], "id int, b string").select("id", F.try_parse_json("b").alias("briefing"), F.try_parse_json(F.lit("[]")).alias("assessment"))
    got = J.decide(df, "id").collect()
    assert len(got) == 6 and {(r.branch, r.frame.relation, r.frame.claim_gate.status, r.frame.design_audit.status) for r in got} == {("intake_refresh", "not_supplied", "no_frozen_key_claims", "not_supplied")}
