"""The judgment frame: what a briefing and its intake assessment warrant, with the rules as data and the reasons kept.

Both records are VARIANT. A record is opened once a row, into the fields that rules read; blockers, pressures and branches of the decision are ordered
lists of (name, condition over facts), so which rules held, and in what order they count, are results like the decision.
Nothing is joined or moved.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T

# Words of claims, and what they count as.
MEASURED = ("measured", "tested", "controlled_experiment", "direct_experiment", "quantitative_observation", "quantitative_readout", "benchmark", "experiment", "experimental_result", "measurement", "validated", "validation")
NOT_TOUCHED = ("asserted", "assumed", "speculated", "background", "reviewed", "absent", "author_interpretation", "hypothesis")
TRANSLATIONAL = ("clinical", "diagnostic", "diagnostics", "disease_diagnosis", "disease_readout", "translational", "patient", "in_vivo", "real_sample")
PROTOTYPE = ("buffer", "spiked", "spiked_sample", "synthetic_sample", "model_sample", "prototype", "in_vitro", "cell_line", "single_cell_line", "proof_of_concept")
PLATFORM = ("platform", "general", "generalizable", "universal", "broad")
NARROW = ("single_target", "single_analyte", "single_material", "single_model", "one_cell_line", "one_disease_model", "one_sample_type")
RISK_WEIGHTS = ((("high", "severe", "critical"), 0.45), (("medium", "moderate"), 0.2))
DISTANCE_WEIGHTS = ((("high", "far", "large"), 0.35), (("medium", "moderate"), 0.18))
OTHER_FLAG, BLOCKING = 0.15, 0.35
KEY_CLAIM_FIELDS = ("frozen_key_claims", "key_claims", "belief_key_claims", "key_mechanisms")
KEY_CLAIM_IDS = ("key_claim_id", "atom_id", "id", "claim_id")
REFERRED_IDS = ("id", "atom_id", "key_claim_id", "claim_id", "ref")
CLAIM_REFS = ("matched_key_claim_ids", "key_claim_ids", "key_claim_refs", "touches_key_claims", "matched_atoms", "matched_atom_ids", "atom_ids", "relation_scope_atom_ids", "mapped_key_claims", "key_claim_id", "atom_id")
EVIDENCE_TYPES = ("evidence_type", "evidence_basis", "basis", "support_type")
FLAG_FIELDS = ("overclaim_flags", "overclaim_flag", "support_gap_flags", "claim_design_flags")
CLAIM_SCOPES = ("claim_scope", "claimed_scope", "interpretation_scope", "conclusion_scope")
EVIDENCE_SCOPES = ("evidence_scope", "design_scope", "experimental_scope", "supported_scope", "sample_context", "model_system")
MECHANISM = ("mechanism", "mechanistic", "mechanism_test")
BOUNDARY = ("mechanism", "mechanistic", "boundary", "control", "artifact", "negative_control")
RISK, DISTANCE = ("overclaim_risk", "claim_design_risk"), ("evidence_claim_distance", "claim_design_distance", "support_gap")
# End of fixed values.


def _none() -> Column:
    return F.array().cast("array<string>")


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


#: What a record is opened into: fields by name, each a value as it stands (None), an object of fields (a mapping) or the
#: objects of a list (a sequence of fields).
Shape = Mapping[str, "Shape | Sequence[str] | None"]


def _type(shape: Shape | Sequence[str] | None) -> str:
    if shape is None:
        return "variant"
    if isinstance(shape, Mapping):
        return "struct<" + ",".join(f"{name}:{_type(of)}" for name, of in shape.items()) + ">"
    return f"array<{_type(dict.fromkeys(shape))}>"


def opened(value: Column, shape: Shape | Sequence[str]) -> Column:
    """The fields of an object, from one walk over it; null where it is none. Fields that are missing or of another type are
    null, a null that is given is a value."""
    return F.try_variant_get(value, "$", _type(shape if isinstance(shape, Mapping) else dict.fromkeys(shape)))


def _values(record: Column, fields: Sequence[str]) -> Column:
    """Values that an opened record has, in order of the fields."""
    return F.filter(F.array(*(record[f] for f in fields)), lambda x: x.isNotNull())


def objects(held: Column) -> Column:
    """The objects of an opened list; none where it is missing or no list."""
    return F.filter(F.coalesce(held, F.array()), lambda x: x.isNotNull())


def _kind(value: Column) -> Column:
    """First word of a value's type, as ``records.kind_of`` has it."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("MISSING"))


def _read(value: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a value's kind and text, each read once."""
    return F.when(value.isNotNull(), T.bound(F.struct(_kind(value).alias("k"), F.try_variant_get(value, "$", "string").alias("v")), lambda r: use(r["k"], r["v"])))


def text_of(value: Column) -> Column:
    """A value's text as a condition sees it: empty where it is missing, null, false, zero or no scalar."""

    def text(kind: Column, value: Column) -> Column:
        zero = F.coalesce(value.try_cast("double") == 0, F.lit(False))
        return F.when(kind == "STRING", value).when(kind == "BOOLEAN", F.when(value == "true", "True").otherwise("")).when(kind.isin(*NUMBERS) & ~zero, value)

    return F.coalesce(_read(value, text), F.lit(""))


def said(record: Column, field: str) -> Column:
    """The text of a field of a record that isn't opened."""
    return text_of(F.try_variant_get(record, f"$.{field}", "variant"))


def first_said(record: Column, fields: Sequence[str]) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(_values(record, fields), text_of), lambda x: x != ""), F.lit(0)), F.lit(""))


def token(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def is_set(value: Column) -> Column:
    """True, a number but zero, or one of the words for yes."""

    def yes(kind: Column, value: Column) -> Column:
        return F.when(kind.isin("STRING", "BOOLEAN"), F.lower(F.trim(value)).isin("1", "true", "yes", "y")).when(kind.isin(*NUMBERS), value.try_cast("double") != 0)

    return F.coalesce(_read(value, yes), F.lit(False))


def strings(value: Column) -> Column:
    """A list's values, or the one value, that aren't blank."""
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))

    def of(kind: Column) -> Column:
        return F.when(kind == "ARRAY", F.transform(F.try_variant_get(value, "$", "array<variant>"), text)).when(~kind.isin("MISSING", "VOID", "OBJECT"), F.array(text(value)))

    return F.filter(F.coalesce(T.bound(_kind(value), of), _none()), lambda x: F.trim(x) != "")


def _truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.try_variant_get(value, "$", "string"))).isin("1", "true", "yes", "y"), F.lit(False))


def tokens(record: Column, fields: Sequence[str]) -> Column:
    """Tokens of lists, values and the set keys of objects, distinct, in order of the fields."""

    def of(value: Column) -> Column:
        named = F.map_keys(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: _truthy(v)))
        return F.coalesce(named, strings(value))

    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(_values(record, fields), of)), token), lambda x: x != ""))


def references(record: Column, fields: Sequence[str]) -> Column:
    """Ids that fields name: values, or the first id of each object."""

    def ids(value: Column) -> Column:
        named = T.bound(opened(value, REFERRED_IDS), lambda r: F.when(r.isNotNull(), F.trim(first_said(r, REFERRED_IDS))))
        return F.coalesce(named, F.try_variant_get(value, "$", "string"), F.lit(""))

    def of(value: Column) -> Column:
        many = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(_kind(value) != "VOID", F.array(value)), F.array())
        return F.transform(many, ids)

    return F.array_distinct(F.filter(F.flatten(F.transform(_values(record, fields), of)), lambda x: F.trim(x) != ""))


def relation_of(briefing: Column) -> Column:
    raw = F.lower(F.trim(text_of(briefing["relation_scope"]["legacy_whole_belief_reader"]["kernel_relation"])))
    out = F.when(raw == "", "not_supplied")
    for relation, names in V.RELATION_WORDS.items():
        out = out.when(raw.isin(*names), relation)
    return out.when(raw == "off_topic", "neutral").otherwise(raw)


def key_claims(briefing: Column) -> Column:
    """(id, role) of the required key claims; the first of an id counts, and one without an id is named by its place."""
    scope = briefing["relation_scope"]
    required = F.filter(objects(scope["atoms"]), lambda a: token(text_of(a["criticality"])) == "required")
    raw = F.concat(*(objects(at[f]) for f in KEY_CLAIM_FIELDS for at in (scope, briefing)), required)
    named = F.transform(raw, lambda c, i: F.struct(
        F.coalesce(F.nullif(F.trim(first_said(c, KEY_CLAIM_IDS)), F.lit("")), F.concat(F.lit("key_claim_"), F.lpad((i + 1).cast("string"), 2, "0"))).alias("id"),
        token(F.coalesce(F.nullif(first_said(c, ("role", "claim_type")), F.lit("")), F.lit("claim"))).alias("role"),
        token(F.coalesce(F.nullif(text_of(c["criticality"]), F.lit("")), F.lit("required"))).alias("criticality")))

    def required_of(named: Column) -> Column:
        ordered = F.transform(named, lambda c, i: F.struct(c["id"].alias("id"), i.alias("at"), c["role"].alias("role"), c["criticality"].alias("criticality")))
        first = T.bound(F.array_sort(ordered), lambda xs: F.filter(xs, lambda c, i: (i == 0) | (F.get(xs, i - 1)["id"] != c["id"])))
        kept = F.array_sort(F.transform(F.filter(first, lambda c: c["criticality"] == "required"), lambda c: F.struct(c["at"].alias("at"), c["id"].alias("id"), c["role"].alias("role"))))
        return F.transform(kept, lambda c: F.struct(c["id"].alias("id"), c["role"].alias("role")))

    return T.bound(named, required_of)


def _by_word(word: Column, weights: Sequence[tuple[tuple[str, ...], float]]) -> Column:
    out = F.lit(0.0)
    for words, weight in reversed(weights):
        out = F.when(word.isin(*words), F.lit(weight)).otherwise(out)
    return out


def boundary_weight(flags: Column, risk: Column, distance: Column, weight: Column) -> Column:
    """Weight against a claim: its flags' sum, but at least what its risk, its distance and a given weight say; to 1."""
    table = F.create_map(*(F.lit(x) for kv in V.OVERCLAIM_WEIGHTS.items() for x in kv))
    summed = F.aggregate(flags, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(OTHER_FLAG)))
    given = F.coalesce(F.try_variant_get(weight, "$", "string").try_cast("double"), F.lit(0.0))
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)), 4)
    return F.round(F.least(F.lit(1.0), F.greatest(summed, _by_word(risk, RISK_WEIGHTS), _by_word(distance, DISTANCE_WEIGHTS), clamped)), 4)




def claims_of(briefing: Column) -> Column:
    """Claims with refs, evidence, kind, measured, flags (given and found), weight and signal (anything said on design)."""

    meets = lambda xs, words: F.coalesce(F.arrays_overlap(xs, F.array(*(F.lit(w) for w in words))), F.lit(False))

    def read(c: Column) -> Column:
        return F.struct(
            F.array_distinct(F.transform(F.flatten(F.transform(_values(c, EVIDENCE_TYPES), strings)), token)).alias("evidence"), token(text_of(c["claim_type"])).alias("kind"), tokens(c, CLAIM_SCOPES).alias("scopes"), tokens(c, EVIDENCE_SCOPES).alias("design"),
            tokens(c, FLAG_FIELDS).alias("flags"), token(first_said(c, RISK)).alias("risk"), token(first_said(c, DISTANCE)).alias("distance"))

    def flagged(r: Column) -> Column:
        found = [
            (meets(r["scopes"], TRANSLATIONAL) & meets(r["design"], PROTOTYPE), "translational_overclaim"), (meets(r["scopes"], PLATFORM) & meets(r["design"], NARROW), "platform_overclaim"),
            (r["kind"].isin("causal", "causality") & meets(r["evidence"], ("correlation", "association", "observational")), "causal_overclaim"),
            (r["kind"].isin("mechanism", "mechanistic") & meets(r["evidence"], NOT_TOUCHED), "mechanism_overclaim"),
        ]
        return F.array_distinct(F.concat(r["flags"], F.filter(F.array(*(F.when(x, F.lit(n)) for x, n in found)), lambda x: x.isNotNull())))

    def one(c: Column) -> Column:
        def of(r: Column, flags: Column) -> Column:
            signal = (F.size(flags) > 0) | (r["risk"] != "") | (r["distance"] != "") | (F.size(r["scopes"]) > 0) | (F.size(r["design"]) > 0)
            return F.struct(references(c, CLAIM_REFS).alias("refs"), r["kind"].alias("kind"), meets(r["evidence"], MEASURED).alias("measured"), flags.alias("flags"), boundary_weight(flags, r["risk"], r["distance"], c["negative_weight"]).alias("weight"), signal.alias("signal"))

        return T.bound(read(c), lambda r: T.bound(flagged(r), lambda flags: of(r, flags)))

    return F.transform(objects(briefing["claim_map"]), one)


_KEY_CLAIM = (*KEY_CLAIM_IDS, "role", "claim_type", "criticality")
_DESIGN = (*FLAG_FIELDS, *RISK, *DISTANCE, "negative_weight")
#: What rules read of an assessment and of a briefing.
ASSESSMENT: Shape = {"admissibility": dict.fromkeys(("abstract_level_only", "high_uncertainty")), "refresh_request": dict.fromkeys(("needed", "reasons"))} | dict.fromkeys((
    "decision", "assessment_id", "id", "reasons", "next_actions", "accepted_candidates", "deferred_candidates"))
UPDATES: Shape = {"candidate_kernel_updates": ("target_layer", "candidate_id", "candidate_change")}
BRIEFING: Shape = UPDATES | dict.fromkeys(KEY_CLAIM_FIELDS, _KEY_CLAIM) | {
    "relation_scope": {"belief_id": None, "legacy_whole_belief_reader": {"kernel_relation": None}, "atoms": _KEY_CLAIM} | dict.fromkeys(KEY_CLAIM_FIELDS, _KEY_CLAIM),
    "trajectory_proposal": {"candidate_question": None}, "source": {"input_text_level": None}, "source_provenance": {"read_level": None}, "uncertainty_map": ("severity",), "disagreement_map": ("id",),
    "claim_map": tuple(dict.fromkeys((*EVIDENCE_TYPES, "claim_type", *CLAIM_SCOPES, *EVIDENCE_SCOPES, *CLAIM_REFS, *_DESIGN))), "claim_design_audit": None,
    "object_grounding": dict.fromkeys(("object_text_alignment", "text_only")), "calibration_status": {"should_downweight_confidence": None}, "semantic_audit": {"behavioral_risk": None},
    "human_feedback_brief": {"feedback_type": None}}


def _facts(rows: DataFrame, assessment: str, briefing: str) -> DataFrame:
    rows = T.once(rows, _a=opened(F.col(assessment), ASSESSMENT), _b=opened(F.col(briefing), BRIEFING))
    rows = T.once(rows, _audit=opened(F.col("_b.claim_design_audit"), _DESIGN))
    a, b, audit, whole = F.col("_a"), F.col("_b"), F.col("_audit"), F.col("_b.claim_design_audit")
    grade = lambda s: F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)
    severity = F.transform(objects(b["uncertainty_map"]), lambda u: T.bound(F.lower(F.trim(text_of(u["severity"]))), grade))
    worst = F.coalesce(F.array_max(severity), F.lit(0))
    word = lambda value, default="unknown": F.lower(F.trim(F.coalesce(F.nullif(text_of(value), F.lit("")), F.lit(default))))
    level = F.lower(F.trim(F.coalesce(F.nullif(text_of(b["source"]["input_text_level"]), F.lit("")), F.nullif(text_of(b["source_provenance"]["read_level"]), F.lit("")), F.lit("unknown"))))
    out = T.once(
        rows, relation=relation_of(b), belief=F.trim(text_of(b["relation_scope"]["belief_id"])), question=F.trim(text_of(b["trajectory_proposal"]["candidate_question"])), level=level, worst=worst,
        layers=F.array_distinct(F.filter(F.transform(objects(b["candidate_kernel_updates"]), lambda c: F.trim(text_of(c["target_layer"]))), lambda x: x != "")),
        thin=is_set(a["admissibility"]["abstract_level_only"]), refresh=is_set(a["refresh_request"]["needed"]), high=is_set(a["admissibility"]["high_uncertainty"]),
        disputed=F.size(objects(b["disagreement_map"])) > 0, alignment=word(b["object_grounding"]["object_text_alignment"]), text_only=is_set(b["object_grounding"]["text_only"]), downweight=is_set(b["calibration_status"]["should_downweight_confidence"]),
        semantic=word(b["semantic_audit"]["behavioral_risk"]), reduce=word(b["human_feedback_brief"]["feedback_type"], "").isin("reduce_overclaim", "downgrade", "request_caution"),
        required=key_claims(b), claims=claims_of(b), audit_flags=F.when(audit.isNotNull(), tokens(audit, FLAG_FIELDS)).otherwise(_none()), audit_risk=token(first_said(audit, RISK)), audit_distance=token(first_said(audit, DISTANCE)),
        audited=audit.isNotNull() & (F.coalesce(F.try_variant_get(whole, "$", "string"), F.to_json(whole)) != "{}"))
    out = T.once(
        out, abstract=F.col("thin") | (F.col("level") == "abstract"),
        audit_weight=F.when(audit.isNotNull(), boundary_weight(F.col("audit_flags"), F.col("audit_risk"), F.col("audit_distance"), audit["negative_weight"])).otherwise(0.0)).drop("_a", "_b", "_audit")
    ids = F.transform("required", lambda k: k["id"])
    fits = lambda kind, role: ~role.isin("mechanism", "boundary") | ((role == "mechanism") & kind.isin(*MECHANISM)) | ((role == "boundary") & kind.isin(*BOUNDARY))
    measured = F.flatten(F.transform("claims", lambda c: F.when(c["measured"], F.transform(F.filter("required", lambda k: F.array_contains(c["refs"], k["id"]) & fits(c["kind"], k["role"])), lambda k: k["id"])).otherwise(_none())))
    out = T.once(out, ids=ids, touched=F.array_intersect(ids, F.flatten(F.transform("claims", lambda c: c["refs"]))), measured=F.array_intersect(ids, measured),
                 weight=F.greatest(F.col("audit_weight"), F.coalesce(F.array_max(F.transform("claims", lambda c: c["weight"])), F.lit(0.0))),
                 flags=F.array_distinct(F.concat(F.flatten(F.transform("claims", lambda c: c["flags"])), F.col("audit_flags"))))
    relation = F.col("relation")
    enough = F.when(relation == "challenge", F.size("measured") > 0).when(relation == "support", F.size(F.array_except("ids", "measured")) == 0)
    gate = F.when(F.size("ids") == 0, "no_frozen_key_claims").when(relation.isin("support", "challenge"), F.when(enough, "passed").otherwise("failed")).otherwise("not_directional")
    return T.once(out, gate=gate, directional=relation.isin("support", "challenge"))


#: Rules in order: each that holds is a blocker.
Rules = Sequence[tuple[str, Callable[[], Column]]]
_is = F.col
BLOCKERS: Rules = (
    ("abstract_level_only", lambda: _is("abstract")), ("refresh_required", lambda: _is("refresh")), ("reader_or_relation_conflict", lambda: _is("conflict")),
    ("high_uncertainty", lambda: _is("high") | (_is("worst") == 3)), ("uncalibrated_or_downweighted_confidence", lambda: _is("downweight")), ("human_feedback_reduce_overclaim", lambda: _is("reduce")),
    ("semantic_audit_risk", lambda: _is("semantic").isin("medium", "high")), ("weak_object_grounding", lambda: _is("alignment").isin("none", "weak")),
    ("text_only_abstract_grounding", lambda: _is("text_only") & (_is("level") != "full_text")), ("no_frozen_key_claims", lambda: _is("directional") & (_is("gate") == "no_frozen_key_claims")),
    ("key_claim_not_measured_or_tested", lambda: _is("directional") & (_is("gate") == "failed")), ("claim_design_overclaim_boundary", lambda: _is("design_blocks")),
)
#: The first pressure that holds is the primary one.
PRESSURES: Rules = (
    ("conflict_resolution", lambda: _is("conflict")), ("source_grounding", lambda: _is("ungrounded")), ("belief_revision_pressure", lambda: _is("revision")),
    ("open_question_pressure", lambda: _is("opens")), ("trajectory_pressure", lambda: _is("moves")),
)
WARRANTS = ("action_or_read", "belief_revision_candidate", "open_question", "trajectory_update")


def _held(rules: Rules) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(c(), F.lit(False)), F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())


def frame(rows: DataFrame, key: str, assessment: str = "assessment", briefing: str = "briefing") -> DataFrame:
    """key and frame: primary_pressure, pressures and blockers that hold (in order), warrants, the claim gate (status and
    required, touched and measured ids), the design audit (status, weight, flags, blocks) and the facts they rest on.

    Records that are null or no objects are empty ones. Fields of another type than a rule reads count as missing; lists of
    ids may hold objects with an id. Rows of repeated keys are framed apart.
    """
    facts = _facts(rows.select(key, assessment, briefing), assessment, briefing)
    facts = T.once(facts, conflict=(F.col("relation") == "contest") | F.col("disputed"), design_blocks=F.col("directional") & (F.col("weight") >= BLOCKING), gate_blocks=F.col("directional") & (F.col("gate") != "passed"))
    facts = T.once(facts, blockers=_held(BLOCKERS), sufficient=~F.col("abstract") & ~F.col("refresh") & F.col("level").isin("full_text", "paper", "full"))
    weak = F.arrays_overlap("blockers", F.array(F.lit("weak_object_grounding"), F.lit("text_only_abstract_grounding")))
    facts = T.once(facts, ungrounded=F.col("abstract") | F.col("refresh") | weak)
    asks, revises = F.col("question") != "", F.col("gate_blocks") | F.col("design_blocks")
    facts = T.once(
        facts, opens=asks & (F.col("relation").isin("underdetermined", "unclear") | F.col("high") | (F.col("worst") >= 2) | F.col("ungrounded") | revises), moves=F.array_contains("layers", "trajectory") & ~F.col("conflict"),
        revision=(F.col("belief") != "") & F.col("directional") & F.col("sufficient") & (F.col("gate") == "passed") & ~F.col("design_blocks") & ~F.col("conflict") & ~F.col("high"),
        acts=F.col("conflict") | F.col("ungrounded") | (revises & ~asks) | (F.col("reduce") & ~F.col("sufficient")))
    facts = T.once(facts, pressures=_held(PRESSURES))
    signal = F.col("audited") | F.exists("claims", lambda c: c["signal"])
    design = F.when(~signal, "not_supplied").when(F.col("design_blocks"), "overclaim_boundary").when(F.col("weight") > 0, "bounded_interpretation").otherwise("aligned_or_no_overclaim_detected")
    made = F.struct(
        F.coalesce(F.get("pressures", F.lit(0)), F.lit("background_context")).alias("primary_pressure"), "pressures", "blockers",
        F.struct(F.col("acts").alias("action_or_read"), F.col("revision").alias("belief_revision_candidate"), F.col("opens").alias("open_question"), (F.col("moves") & ~F.col("revision")).alias("trajectory_update")).alias("warrants"),
        F.struct(F.col("gate").alias("status"), F.col("ids").alias("required"), "touched", "measured", F.array_except("ids", "measured").alias("missing")).alias("claim_gate"),
        F.struct(design.alias("status"), "weight", "flags", F.col("design_blocks").alias("blocks")).alias("design_audit"),
        "relation", F.col("belief").alias("belief_ref"), F.col("question").alias("candidate_question"), F.col("level").alias("read_level"), "layers", F.get(F.array(*map(F.lit, ("none", "low", "medium", "high"))), F.col("worst")).alias("uncertainty_severity"), F.col("sufficient").alias("source_sufficient"))
    return facts.select(key, assessment, briefing, made.alias("frame"))


# What a decision's branches say and ask for.
BOTH = ("propose_belief_revision", "propose_trajectory_update")
ASKED_BY_BLOCKER = (("no_frozen_key_claims", "request_belief_key_claims"), ("key_claim_not_measured_or_tested", "request_key_claim_touch_review"), ("claim_design_overclaim_boundary", "request_claim_design_alignment_review"))
DESCRIPTIONS = {
    "human_or_full_text_review": "Resolve intake-level conflict before any durable kernel revision.",
    "refresh_required": "Refresh the secretary briefing before research-state judgment.",
    "full_text_required": "Keep the briefing as intake material, but request full text before belief or trajectory revision.",
    "human_adjudication_required": "The secretary relation is contested; route to human/kernel review before revision.",
    "trajectory_update_candidate": "Consider trajectory update from secretary proposal.",
}
# End of fixed values.

CHANGE = "struct<target_layer:string,change_type:string,description:string,source_candidate_ids:array<string>>"
BRANCH = f"struct<branch:string,decision:string,said:array<string>,actions:array<string>,change:{CHANGE},human:boolean>"


def _or(first: Column, other: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(other)


def decide(rows: DataFrame, key: str, assessment: str = "assessment", briefing: str = "briefing") -> DataFrame:
    """key, frame, branch (which rule decided), decision, rationale, required_actions, rejected_alternatives, change (null if
    none), human_review_required, uncertainty (level and drivers) of each row's assessment and briefing.

    The first branch that holds decides: intake's own verdicts, then what the frame warrants. Odd records as for ``frame``;
    a missing intake verdict counts as defer.
    """
    framed = frame(rows, key, assessment, briefing)
    framed = T.once(framed, _a=opened(F.col(assessment), ASSESSMENT), _u=opened(F.col(briefing), UPDATES))
    a, f = F.col("_a"), F.col("frame")
    held = objects(F.col("_u.candidate_kernel_updates"))
    ids = F.transform(held, lambda c, i: F.coalesce(F.nullif(text_of(c["candidate_id"]), F.lit("")), F.concat(F.lit("candidate_"), F.lpad((i + 1).cast("string"), 2, "0"))))
    framed = T.once(
        framed, _intake=F.coalesce(F.nullif(text_of(a["decision"]), F.lit("")), F.lit("defer")), _id=first_said(a, ("assessment_id", "id")), _ids=ids, _reasons=strings(a["reasons"]), _next=strings(a["next_actions"]),
        _accepted=strings(a["accepted_candidates"]), _deferred=strings(a["deferred_candidates"]), _refresh_reasons=strings(a["refresh_request"]["reasons"]), _abstract=is_set(a["admissibility"]["abstract_level_only"]),
        _high=is_set(a["admissibility"]["high_uncertainty"]), _refresh=is_set(a["refresh_request"]["needed"]),
        _moves=F.transform(F.filter(held, lambda c: text_of(c["target_layer"]) == "trajectory"), lambda c: F.struct(text_of(c["candidate_change"]).alias("change"), text_of(c["candidate_id"]).alias("id"))))
    lits = lambda *xs: F.array(*map(F.lit, xs))
    waiting, taken = _or(F.col("_deferred"), F.col("_ids")), _or(F.col("_accepted"), F.col("_ids"))
    relation, intake = f["relation"], F.col("_intake")

    def branch(name: str, decision: str, said_: Column, actions: Column | None = None, layer: str = "", kind: Column | str = "", text: Column | None = None, sources: Column | None = None, human: bool = False) -> Column:
        type_ = F.lit(kind) if isinstance(kind, str) else kind
        words = F.lit(DESCRIPTIONS.get(kind, "")) if text is None and isinstance(kind, str) else text
        change = F.struct(F.lit(layer).alias("target_layer"), type_.alias("change_type"), words.alias("description"), F.array_distinct(sources).alias("source_candidate_ids")) if layer else F.lit(None)
        return F.struct(F.lit(name).alias("branch"), F.lit(decision).alias("decision"), said_.alias("said"), (_none() if actions is None else actions).alias("actions"), change.cast(CHANGE).alias("change"), F.lit(human).alias("human")).cast(BRANCH)

    asked = F.lit("request_full_text_before_revision")
    for blocker, action in reversed(ASKED_BY_BLOCKER):
        asked = F.when(F.array_contains(f["blockers"], blocker), action).otherwise(asked)
    move = F.get("_moves", F.lit(0))
    proposal = F.concat(F.lit("Consider a "), relation, F.lit(" BeliefRevision candidate for "), f["belief_ref"], F.lit("; do not apply without explicit revision API."))
    read, next_ = "request_action_or_read", F.col("_next")
    branches = (
        (intake == "reject", branch("intake_reject", "no_change", lits("intake_rejected_packet"), lits("regenerate_secretary_briefing"))),
        (intake == "escalate", branch("intake_escalate", read, _or(F.col("_reasons"), lits("intake_escalation_required")), _or(next_, lits("human_read")), "action", "human_or_full_text_review", None, waiting, True)),
        (intake.isin("request_refresh", "defer"), branch("intake_refresh", read, _or(F.col("_reasons"), F.array(F.concat(F.lit("intake_"), intake))), _or(next_, lits("refresh_secretary_briefing")), "action", "refresh_required", None, waiting)),
        (f["warrants"]["action_or_read"], branch("frame_action_or_read", read, lits("judgment_frame_requires_read_or_action"), _or(next_, F.array(asked)), "action", "full_text_required", None, waiting)),
        (f["warrants"]["belief_revision_candidate"], branch("frame_belief_revision", "propose_belief_revision", lits("judgment_frame_warrants_belief_revision_candidate"), None, "belief", F.concat(relation, F.lit("_candidate")), proposal, taken)),
        (relation == "contest", branch("relation_contest", read, lits("contested_relation_requires_human_judgment"), _or(next_, lits("human_read")), "action", "human_adjudication_required", None, waiting, True)),
        (f["warrants"]["open_question"] & (f["candidate_question"] != ""), branch("frame_open_question", "open_question", lits("judgment_frame_opens_question"), None, "question", "open_question_candidate", f["candidate_question"], taken)),
        (f["warrants"]["trajectory_update"] & (F.size("_moves") > 0), branch("frame_trajectory", "propose_trajectory_update", lits("judgment_frame_warrants_trajectory_update"), None, "trajectory", "trajectory_update_candidate", F.coalesce(F.nullif(move["change"], F.lit("")), F.lit(DESCRIPTIONS["trajectory_update_candidate"])), F.array(move["id"]))),
    )
    chosen = branch("none", "no_change", lits("no_research_state_change_warranted"))
    for condition, made in reversed(branches):
        chosen = F.when(F.coalesce(condition, F.lit(False)), made).otherwise(chosen)
    done = T.once(framed, _b=chosen)
    d = F.col("_b.decision")
    open_ended = relation.isin("underdetermined", "unclear")
    unsure = relation.isin("contest", "underdetermined", "unclear")
    opening = F.filter(F.array(F.when(F.col("_id") != "", F.concat(F.lit("intake_assessment:"), F.col("_id"))), F.concat(F.lit("judgment_frame:"), f["primary_pressure"]), F.when(relation != "not_supplied", F.concat(F.lit("secretary_relation_signal:"), relation))), lambda x: x.isNotNull())
    rejected = F.filter(F.array(
        *(F.when(F.col("_b.branch").isin("intake_reject", "none"), x) for x in BOTH), F.when(d != "propose_belief_revision", "direct_belief_revision"), F.when(d != "propose_trajectory_update", "direct_trajectory_update")), lambda x: x.isNotNull())
    drivers = F.array_distinct(F.concat("_reasons", "_refresh_reasons", F.when(F.col("_abstract"), lits("abstract_level_only")).otherwise(_none()), F.when(unsure, F.array(F.concat(F.lit("relation:"), relation))).otherwise(_none())))
    level = F.when(F.col("_high") | F.col("_b.human") | (relation == "contest"), "high").when(F.col("_abstract") | F.col("_refresh") | open_ended, "medium").otherwise("low")
    return done.select(
        key, "frame", F.col("_b.branch").alias("branch"), d.alias("decision"), F.concat(opening, F.col("_b.said")).alias("rationale"), F.col("_b.actions").alias("required_actions"), rejected.alias("rejected_alternatives"),
        F.col("_b.change").alias("change"), F.col("_b.human").alias("human_review_required"), F.struct(level.alias("level"), drivers.alias("drivers")).alias("uncertainty"))
