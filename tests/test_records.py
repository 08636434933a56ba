"""Records of every kind: whole ones pass, and each missing or mistyped field is named once."""

import json

import pytest

from cairnlight.operators import records as R


def whole(kind):
    r = {f: "x" for f in kind.required}
    r |= {f: values[-1] for f, values, _ in kind.choices} | {f: 0.5 for f in kind.shares} | {f: [] for f in kind.lists}
    r |= {f: {} for f in (*kind.objects, *kind.if_present)} | {f: True for f in kind.flags}
    for i in kind.items:
        r[i.field] = [{f: "x" for f in i.required} | {f: values[0] for f, values, _ in i.choices} | {f: False for f in i.flags}]
    return r


def found(spark, kind, *rows):
    df = spark.createDataFrame([(i, x if isinstance(x, str | None) else json.dumps(x)) for i, x in enumerate(rows)], "id int, r string")
    return {(x.id, x.path.removeprefix(f"$.{kind.name}."), x.message) for x in R.record_issues(df, "id", "r", kind).collect()}


@pytest.mark.parametrize("name", R.KINDS)
def test_whole_and_empty_records(spark, name):
    kind = R.KINDS[name]
    out = found(spark, kind, whole(kind), {}, None, "no json")
    assert not [x for x in out if x[0] == 0]
    lacks = {(f, "is required") for f in kind.required} | {(f, m) for f, _, m in kind.choices} | {(f, "must be a number from 0 to 1") for f in kind.shares}
    lacks |= {(f, "must be a list") for f in kind.lists} | {(f, "must be an object") for f in kind.objects} | {(f, "must be boolean") for f in kind.flags}
    for i in (1, 2, 3):
        assert {x[1:] for x in out if x[0] == i} == lacks


def test_types_of_values(spark):
    kind = R.KINDS["belief"]
    change = lambda **x: whole(kind) | x
    out = found(spark, kind, change(confidence="0.5"), change(confidence=True), change(confidence=1.01), change(confidence=1), change(id=[]), change(id=0), change(evidence_ids=None), change(evidence_ids="e"), change(provenance=None))
    share = "must be a number from 0 to 1"
    assert out == {(0, "confidence", share), (2, "confidence", share), (4, "id", "is required"), (7, "evidence_ids", "must be a list"), (8, "provenance", "must be an object")}


def test_items_and_nested_fields(spark):
    kind = R.KINDS["decision"]
    item = whole(kind)["candidate_state_changes"][0]
    rows = [whole(kind) | x for x in (
        {"candidate_state_changes": [item, 5, item | {"target_layer": "no"}, item | {"source_candidate_ids": "a"}]},
        {"uncertainty": {"level": "odd", "drivers": "d"}}, {"uncertainty": {"level": None}}, {"judgment_frame": None}, {"human_review_required": "yes"})]
    level = (R.one_of(R.LEVEL),)
    assert found(spark, kind, *rows) == {
        (0, "candidate_state_changes:2", "must be an object"), (0, "candidate_state_changes:3.target_layer", R.one_of(R.LAYER)), (0, "candidate_state_changes:4.source_candidate_ids", "must be a list"),
        (1, "uncertainty.level", *level), (1, "uncertainty.drivers", "must be a list"), (2, "uncertainty.level", *level),
        (3, "judgment_frame", "must be an object"), (4, "human_review_required", "must be boolean")}
    kind = R.KINDS["question_revision"]
    out = found(spark, kind, *(whole(kind) | {"old_status": x} for x in ("", None, "active", "odd")))
    assert out == {(3, "old_status", "must be blank or one of " + R.one_of(R.QUESTION_STATUS).removeprefix("must be one of "))}
