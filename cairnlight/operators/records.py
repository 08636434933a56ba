"""Validation of stored records: required fields, values, types and nested items of the fourteen kinds of the store.

A record is a VARIANT, so a number given as text, a null and a missing field stay apart. All rules of a kind are one
array expression: a row is read once, and nothing is joined or moved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What fields of records may hold.
BELIEF_STATUS = ("proposed", "active", "contested", "challenged", "contradicted", "resolved", "archived")
SOURCE_TYPE = ("paper", "experiment", "user_observation", "report", "benchmark", "external")
STRENGTH = ("weak", "moderate", "strong", "decisive")
REVISION_ACTION = ("create", "update", "strengthen", "weaken", "contest", "challenge", "contradict", "resolve", "archive", "reopen")
OVERRIDE_TARGET = ("paper", "belief", "evidence", "constraint", "judgment", "trajectory")
OVERRIDE_TYPE = ("approve", "reject", "upgrade", "downgrade", "merge", "split", "reframe", "ignore")
LEVEL = ("low", "medium", "high", "unknown")
CONSTRAINT_TYPE = ("scientific", "strategic", "methodological", "publication", "product")
CONSTRAINT_STATUS = ("proposed", "testable", "tested", "failed", "survived", "retired")
INTAKE_DECISION = ("accept", "partial_accept", "defer", "reject", "escalate", "request_refresh")
AUTHORIZATION = ("not_authorized", "intake_record_only")
RESEARCH_DECISION = ("no_change", "request_action_or_read", "open_question", "propose_belief_revision", "propose_trajectory_update")
LAYER = ("source", "evidence", "belief", "question", "trajectory", "attention", "constraint", "action", "uncertainty")
QUESTION_STATUS = ("proposed", "active", "answered", "parked", "rejected", "archived")
QUESTION_ACTION = ("create", "update", "activate", "answer", "park", "reject", "archive", "reopen")
TRAJECTORY_STATUS = ("proposed", "active", "revised", "parked", "archived")
TRAJECTORY_ACTION = ("create", "update", "reinforce", "shift", "split", "merge", "park", "archive")
ACTION_TYPE = ("read", "refresh", "human_review", "synthesize", "experiment", "verify", "ignore")
ACTION_STATUS = ("open", "in_progress", "done", "blocked", "cancelled")
PRIORITY = ("low", "medium", "high", "urgent")
REVIEW_TYPE = ("human_read", "full_text_review", "adjudicate_conflict", "grounding_check", "relation_review")
REVIEW_STATUS = ("open", "in_progress", "answered", "closed", "blocked", "cancelled")
RESPONSE = ("support", "challenge", "neutral", "underdetermined", "contest", "needs_full_text", "not_my_expertise", "abstract_insufficient", "belief_too_broad", "paper_ambiguous")


def one_of(values: Sequence[str]) -> str:
    return "must be one of [" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


@dataclass(frozen=True)
class Items:
    """Rules for the objects in a list; paths of items count from one."""

    field: str
    required: tuple[str, ...] = ()
    choices: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    flags: tuple[str, ...] = ()
    optional_lists: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kind:
    """Rules of one kind of record. ``optional_*`` may be missing or null; ``if_present`` must be an object even if null.

    ``choices``: field, values, message. ``blank_choices`` may also be missing; an ``old_status`` also null or empty.
    """

    name: str
    required: tuple[str, ...]
    choices: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    blank_choices: tuple[tuple[str, tuple[str, ...]], ...] = ()
    shares: tuple[str, ...] = ()
    optional_shares: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    optional_lists: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    optional_objects: tuple[str, ...] = ()
    if_present: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    items: tuple[Items, ...] = ()


def _named(field: str, values: Sequence[str]) -> tuple[str, tuple[str, ...], str]:
    return field, tuple(values), one_of(values)


def _is(field: str, value: str) -> tuple[str, tuple[str, ...], str]:
    return field, (value,), f"must be {value}"


_STAMPS = ("created_at", "updated_at")

#: The fourteen kinds with their rules (fixed values).
KINDS = {k.name: k for k in (
    Kind("belief", ("id", "title", "claim", "domain", "status", *_STAMPS), (_named("status", BELIEF_STATUS),), shares=("confidence", "entrenchment"),
         optional_lists=("evidence_ids", "contra_evidence_ids", "pending_evidence_ids", "neutral_evidence_ids", "contested_evidence_ids", "linked_concepts", "linked_constraints", "linked_questions"),
         objects=("provenance",)),
    Kind("evidence", ("id", "source_type", "title", "source_ref", "created_at"), (_named("source_type", SOURCE_TYPE), _named("evidence_strength", STRENGTH)),
         optional_lists=("supports_beliefs", "challenges_beliefs", "pending_beliefs", "neutral_beliefs", "contests_beliefs"),
         optional_objects=("parse_boundary", "evidence_relation_provenance", "evidence_strength_provenance")),
    Kind("revision", ("id", "belief_id", "action", "new_confidence", "new_entrenchment", "reason", "created_at"), (_named("action", REVISION_ACTION),),
         shares=("new_confidence", "new_entrenchment"), optional_shares=("old_confidence", "old_entrenchment"), lists=("triggering_evidence_ids",)),
    Kind("judgment", ("id", "question", "judgment", "recommendation", *_STAMPS), (("risk_level", LEVEL, "must be low, medium, high or unknown"),), shares=("confidence",),
         lists=("linked_beliefs", "linked_constraints", "linked_evidence", "next_actions")),
    Kind("constraint", ("id", "statement", "type", "status", *_STAMPS), (("type", CONSTRAINT_TYPE, "invalid constraint type"), ("status", CONSTRAINT_STATUS, "invalid constraint status")),
         shares=("confidence",), lists=("predicted_observations", "failure_conditions", "linked_beliefs", "linked_evidence")),
    Kind("override", ("id", "target_type", "target_id", "override_type", "user_reason", "created_at"),
         (("target_type", OVERRIDE_TARGET, "invalid override target type"), ("override_type", OVERRIDE_TYPE, "invalid override type"))),
    Kind("assessment", ("id", "assessment_id", "schema_id", "briefing_id", "decision", "durable_change_authorization", "created_at"),
         (_is("schema_id", "kernel_intake_assessment_v1"), _named("decision", INTAKE_DECISION), _named("durable_change_authorization", AUTHORIZATION),
          ("durable_change_authorization", ("not_authorized",), "V3-alpha assessment cannot authorize durable state changes")),
         lists=("boundary_checks", "missing_modules", "accepted_candidates", "deferred_candidates", "rejected_candidates", "reasons", "next_actions"),
         objects=("admissibility", "refresh_request", "escalation", "provenance"), items=(Items("boundary_checks", ("check", "passed", "severity", "message"), flags=("passed",)),)),
    Kind("decision", ("id", "decision_id", "schema_id", "assessment_id", "decision", "created_at"), (_is("schema_id", "research_judgment_decision_v1"), _named("decision", RESEARCH_DECISION)),
         blank_choices=(("uncertainty.level", LEVEL),), optional_lists=("uncertainty.drivers",),
         lists=("candidate_state_changes", "rejected_alternatives", "rationale", "required_actions", "applied_revision_ids"), objects=("affected_objects", "uncertainty", "provenance"),
         if_present=("judgment_frame",), flags=("human_review_required",),
         items=(Items("candidate_state_changes", ("target_layer", "change_type", "description", "commit_permission"),
                      (_named("target_layer", LAYER), _is("commit_permission", "kernel_revision_api_required")), optional_lists=("source_candidate_ids",)),)),
    Kind("question", ("id", "question_id", "schema_id", "question", "status", "source_decision_id", *_STAMPS),
         (_is("schema_id", "research_question_v1"), _named("status", QUESTION_STATUS), _named("uncertainty_level", LEVEL)),
         lists=("linked_beliefs", "linked_evidence", "rationale"), objects=("provenance",)),
    Kind("question_revision", ("id", "revision_id", "schema_id", "question_id", "action", "new_status", "reason", "source_decision_id", "created_at"),
         (_is("schema_id", "research_question_revision_v1"), _named("action", QUESTION_ACTION), _named("new_status", QUESTION_STATUS)),
         blank_choices=(("old_status", QUESTION_STATUS),), objects=("provenance",)),
    Kind("trajectory", ("id", "trajectory_id", "schema_id", "title", "statement", "status", "source_decision_id", *_STAMPS),
         (_is("schema_id", "research_trajectory_v1"), _named("status", TRAJECTORY_STATUS)), lists=("linked_questions", "linked_beliefs", "rationale"), objects=("provenance",)),
    Kind("trajectory_revision", ("id", "revision_id", "schema_id", "trajectory_id", "action", "new_status", "reason", "source_decision_id", "created_at"),
         (_is("schema_id", "research_trajectory_revision_v1"), _named("action", TRAJECTORY_ACTION), _named("new_status", TRAJECTORY_STATUS)),
         blank_choices=(("old_status", TRAJECTORY_STATUS),), objects=("provenance",)),
    Kind("action", ("id", "action_id", "schema_id", "decision_id", "action_type", "description", "status", "priority", *_STAMPS),
         (_is("schema_id", "kernel_action_record_v1"), _named("action_type", ACTION_TYPE), _named("status", ACTION_STATUS), _named("priority", PRIORITY)), objects=("provenance",)),
    Kind("human_review_request", ("id", "request_id", "schema_id", "decision_id", "request_type", "target_state_layer", "question", "status", "priority", *_STAMPS),
         (_is("schema_id", "human_review_request_v1"), _named("request_type", REVIEW_TYPE), _named("target_state_layer", LAYER), _named("status", REVIEW_STATUS), _named("priority", PRIORITY)),
         lists=("linked_action_ids", "allowed_responses"), objects=("reviewer_payload", "kernel_context", "anti_anchoring", "provenance"),
         items=(Items("allowed_responses", ("value", "label"), (_named("value", RESPONSE),)),)),
)}


def kind_of(record: Column, field: str) -> Column:
    """First word of the field's type: MISSING, VOID (a null), STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, ARRAY or OBJECT."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get(record, f"$.{field}", "variant")), "^[A-Z]+", 0), F.lit("MISSING"))


def _text(record: Column, field: str) -> Column:
    """The field's text; null where it isn't text."""
    return F.when(kind_of(record, field) == "STRING", F.try_variant_get(record, f"$.{field}", "string"))


def _absent(record: Column, field: str) -> Column:
    kind = kind_of(record, field)
    empty = (kind == "ARRAY") & (F.size(F.try_variant_get(record, f"$.{field}", "array<variant>")) == 0)
    return kind.isin("MISSING", "VOID") | F.coalesce(_text(record, field) == "", F.lit(False)) | F.coalesce(empty, F.lit(False))


def _other(record: Column, field: str, values: Sequence[str]) -> Column:
    return ~F.coalesce(_text(record, field).isin(*values), F.lit(False))


def _no_share(record: Column, field: str) -> Column:
    kind, value = kind_of(record, field), F.try_variant_get(record, f"$.{field}", "double")
    number = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & F.coalesce(value.between(0, 1), F.lit(False))
    return ~((kind == "BOOLEAN") | number)  # true and false count as one and zero


def _checks(record: Column, kind: Kind | Items) -> list[tuple[str, Column, str]]:
    """(field, broken, message) of the rules that look at one field."""
    at = lambda f: kind_of(record, f)
    given = lambda f: ~at(f).isin("MISSING", "VOID")
    out = [(f, _absent(record, f), "is required") for f in kind.required]
    out += [(f, _other(record, f, values), message) for f, values, message in kind.choices]
    out += [(f, at(f) != "BOOLEAN", "must be boolean") for f in kind.flags]
    out += [(f, given(f) & (at(f) != "ARRAY"), "must be a list") for f in kind.optional_lists]
    if isinstance(kind, Kind):
        blank = lambda f: (at(f) == "MISSING") | ((at(f) == "VOID") & F.lit(f == "old_status")) | (F.coalesce(_text(record, f) == "", F.lit(False)) & F.lit(f == "old_status"))
        out += [(f, ~blank(f) & _other(record, f, values), ("must be blank or one of " if f == "old_status" else "must be one of ") + one_of(values).removeprefix("must be one of ")) for f, values in kind.blank_choices]
        out += [(f, _no_share(record, f), "must be a number from 0 to 1") for f in kind.shares]
        out += [(f, given(f) & _no_share(record, f), "must be a number from 0 to 1") for f in kind.optional_shares]
        out += [(f, at(f) != "ARRAY", "must be a list") for f in kind.lists]
        out += [(f, at(f) != "OBJECT", "must be an object") for f in kind.objects]
        out += [(f, given(f) & (at(f) != "OBJECT"), "must be an object") for f in kind.optional_objects]
        out += [(f, ~at(f).isin("MISSING", "OBJECT"), "must be an object") for f in kind.if_present]
    return out


def _found(path: Column, checks: Sequence[tuple[str, Column, str]]) -> Column:
    rows = F.array(*(F.when(bad, F.struct(F.concat(path, F.lit(f".{f}")).alias("path"), F.lit(message).alias("message"))) for f, bad, message in checks))
    return F.filter(rows, lambda x: x.isNotNull())


def issues_of(record: Column, kind: Kind) -> Column:
    """array<struct<path, message>> of a VARIANT record; a record that is null or no object breaks what it lacks."""
    root = F.lit(f"$.{kind.name}")
    parts = [_found(root, _checks(record, kind))]
    for items in kind.items:
        held = F.when(kind_of(record, items.field) == "ARRAY", F.try_variant_get(record, f"$.{items.field}", "array<variant>"))
        none = F.array().cast("array<variant>")
        parts.append(F.flatten(F.transform(F.coalesce(held, none), _item_issues(F.concat(root, F.lit(f".{items.field}:")), items))))
    return F.concat(*parts)


def _item_issues(head: Column, items: Items) -> Callable[[Column, Column], Column]:
    def one(x: Column, i: Column) -> Column:
        path = F.concat(head, (i + 1).cast("string"))
        whole = F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0) == "OBJECT"
        wrong = F.array(F.struct(path.alias("path"), F.lit("must be an object").alias("message")))
        return F.when(F.coalesce(whole, F.lit(False)), _found(path, _checks(x, items))).otherwise(wrong)

    return one


def record_issues(rows: DataFrame, key: str, record: str, kind: Kind) -> DataFrame:
    """(key, kind, path, message) of all broken rules of all rows. ``record``: a column of JSON text or VARIANT.

    Null and malformed text is a record without fields; null and repeated keys are rows of their own.
    """
    value = F.col(record) if rows.schema[record].dataType.typeName() == "variant" else F.try_parse_json(record)
    found = rows.select(F.col(key), value.alias("_r")).select(key, F.explode(issues_of(F.col("_r"), kind)).alias("i"))
    return found.select(key, F.lit(kind.name).alias("kind"), "i.path", "i.message")
