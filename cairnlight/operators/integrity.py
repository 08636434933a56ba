"""References between the fourteen ledgers of the store, orphans, and the health of the whole.

The reference graph is data: which field of which kind names ids of which other kind. All records are read once and give
edges (target kind, id); edges and ids meet in one aggregate per (target kind, id), which combines before the shuffle, so
an id that a third of all records cite is a few rows. What is left to join are the edges of missing ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnlight.operators import records as R
from cairnlight.session import materialize

#: Edges that a task is meant to hold when they meet missing ids.
EDGE_ROOM = 1 << 20


@dataclass(frozen=True)
class Ref:
    """``field`` of a kind names records of ``target`` (a kind, or the field that holds it). ``path`` is where a fault is
    reported if not under the field; ``message`` ends in the id where it says so."""

    field: str
    target: str
    path: str | None = None
    message: str = ""
    many: bool = False
    optional: bool = False
    by_field: bool = False


def _many(field: str, target: str, path: str | None = None, message: str = "") -> Ref:
    return Ref(field, target, field if path is None else path, message or f"unknown {target}: ", many=True)


def _one(field: str, target: str, message: str = "", optional: bool = False) -> Ref:
    return Ref(field, target, field, message or f"unknown {target.replace('_', ' ')}: ", optional=optional)


#: Ledger and id of each kind; where a second field is given it counts before ``id``.
LEDGERS = {
    "belief": ("beliefs", None), "evidence": ("evidence", None), "revision": ("revisions", None), "judgment": ("judgments", None),
    "override": ("overrides", None), "constraint": ("constraints", None), "assessment": ("assessments", "assessment_id"), "decision": ("decisions", "decision_id"),
    "question": ("questions", "question_id"), "question_revision": ("question_revisions", "revision_id"), "trajectory": ("trajectories", "trajectory_id"),
    "trajectory_revision": ("trajectory_revisions", "revision_id"), "action": ("actions", "action_id"), "human_review_request": ("human_review_requests", None),
}
#: Lists of evidence that a belief has, and of beliefs that evidence has.
OF_BELIEF = ("evidence_ids", "contra_evidence_ids", "pending_evidence_ids", "neutral_evidence_ids", "contested_evidence_ids")
OF_EVIDENCE = ("supports_beliefs", "challenges_beliefs", "pending_beliefs", "neutral_beliefs", "contests_beliefs")
#: The reference graph.
REFERENCES: dict[str, tuple[Ref, ...]] = {
    "belief": (*(_many(f, "evidence", "evidence_ids") for f in OF_BELIEF), _many("linked_constraints", "constraint")),
    "revision": (Ref("belief_id", "belief", "belief_id", "unknown belief"), _many("triggering_evidence_ids", "evidence")),
    "evidence": tuple(_many(f, "belief", "", "unknown linked belief: ") for f in OF_EVIDENCE),
    "judgment": (_many("linked_beliefs", "belief"), _many("linked_constraints", "constraint"), _many("linked_evidence", "evidence")),
    "constraint": (_many("linked_beliefs", "belief"), _many("linked_evidence", "evidence")),
    "override": (Ref("target_id", "target_type", "target_id", "unknown target", by_field=True),),
    "decision": (_one("assessment_id", "assessment"), _many("applied_revision_ids", "revision")),
    "question": (_one("source_decision_id", "decision"), _one("last_revision_id", "question_revision", optional=True), _many("linked_evidence", "evidence")),
    "question_revision": (_one("question_id", "question"), _one("source_decision_id", "decision")),
    "trajectory": (_one("source_decision_id", "decision"), _one("last_revision_id", "trajectory_revision", optional=True), _many("linked_questions", "question")),
    "trajectory_revision": (_one("trajectory_id", "trajectory"), _one("source_decision_id", "decision")),
    "action": (_one("decision_id", "decision"),),
    "human_review_request": (_one("decision_id", "decision"), _many("linked_action_ids", "action")),
}
#: Kinds that an override may be checked against.
OVERRIDDEN = ("belief", "evidence", "constraint", "judgment")


def _scalar(record: Column, field: str) -> Column:
    return F.try_variant_get(record, f"$.{field}", "string")


def _list(record: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{field}", "array<string>"), F.array().cast("array<string>"))


def _none(record: Column, fields: Sequence[str]) -> Column:
    return F.array_size(F.concat(*(_list(record, f) for f in fields))) == 0


def _id(record: Column, kind: str) -> Column:
    first = LEDGERS[kind][1]
    own = _scalar(record, "id")
    return F.coalesce(F.nullif(_scalar(record, first), F.lit("")), own) if first else own


EDGE = "array<struct<target:string,id:string,path:string,message:string,revised:boolean>>"


#: What is counted of an edge: the same without the texts of its fault.
CITED = "array<struct<target:string,id:string,revised:boolean>>"


def _edge(ref: Ref, path: Column | None, target: Column, revised: bool) -> Callable[[Column], Column]:
    def of(id_: Column) -> Column:
        if path is None:
            return F.struct(target.alias("target"), id_.alias("id"), F.lit(revised).alias("revised"))
        said = F.concat(F.lit(ref.message), F.coalesce(id_, F.lit("None"))) if ref.message.endswith(" ") else F.lit(ref.message)
        return F.struct(target.alias("target"), id_.alias("id"), path.alias("path"), said.alias("message"), F.lit(revised).alias("revised"))

    return of


def _edges_of(record: Column, kind: str, said: bool = True) -> Column:
    """References of one record, with the texts of their faults if ``said``. A missing scalar is a reference to no id, which
    no record has."""
    type_ = EDGE if said else CITED
    ledger, name = LEDGERS[kind][0], F.coalesce(_scalar(record, "id"), F.lit("None"))
    parts = []
    for ref in REFERENCES.get(kind, ()):
        path = F.concat(F.lit(f"{ledger}."), name, F.lit(f".{ref.path}" if ref.path else "")) if said else None
        target = _scalar(record, ref.target) if ref.by_field else F.lit(ref.target)
        made = _edge(ref, path, target, kind == "revision" and ref.many)
        if ref.many:
            parts.append(F.transform(_list(record, ref.field), made))
            continue
        value = _scalar(record, ref.field)
        counts = value != "" if ref.optional else target.isin(*OVERRIDDEN) if ref.by_field else F.lit(True)
        parts.append(F.when(F.coalesce(counts, F.lit(False)), F.array(made(value))).otherwise(F.array().cast(type_)))
    return F.concat(*(p.cast(type_) for p in parts)) if parts else F.array().cast(type_)


def _by_kind(record: Column, kind: Column, of, otherwise: Column) -> Column:
    out = None
    for name in LEDGERS:
        out = F.when(kind == name, of(record, name)) if out is None else out.when(kind == name, of(record, name))
    return out.otherwise(otherwise)


def edges(records: DataFrame) -> DataFrame:
    """target, id, path, message and revised (a revision's evidence) of every reference of ``records`` (kind, record)."""
    found = _by_kind(F.col("record"), F.col("kind"), _edges_of, F.array().cast(EDGE))
    return records.select(F.explode(found).alias("e")).select("e.*")


def targets(records: DataFrame) -> DataFrame:
    """target, id, held (a record has the id), cited (by a revision), n (references) and n_alone (evidence with the id that
    has no belief), from one shuffle of references and ids together, combined before it."""
    record, kind = F.col("record"), F.col("kind")
    alone = F.when(kind == "evidence", _none(record, OF_EVIDENCE)).otherwise(F.lit(False))
    own = F.struct(kind.alias("target"), _by_kind(record, kind, _id, F.lit(None).cast("string")).alias("id"), F.lit(True).alias("held"), F.lit(False).alias("cited"), F.lit(0).alias("n"), alone.cast("int").alias("n_alone"))
    cite = lambda e: F.struct(e["target"].alias("target"), e["id"].alias("id"), F.lit(False).alias("held"), e["revised"].alias("cited"), F.lit(1).alias("n"), F.lit(0).alias("n_alone"))
    found = _by_kind(record, kind, lambda r, k: _edges_of(r, k, said=False), F.array().cast(CITED))
    rows = records.select(F.explode(F.concat(F.array(own), F.transform(found, cite))).alias("x")).select("x.*")
    summed = rows.groupBy("target", "id").agg(F.max("held").alias("held"), F.max("cited").alias("cited"), F.sum("n").alias("n"), F.sum("n_alone").alias("n_alone"))
    return summed.withColumn("held", F.col("held") & F.col("id").isNotNull())


def _bare(record: Column, kind: Column) -> Column:
    """Records without what they need: (path, message) or null."""
    name = F.coalesce(_scalar(record, "id"), F.lit("None"))
    said = lambda ledger, message: F.struct(F.concat(F.lit(f"{ledger}."), name).alias("path"), F.lit(message).alias("message"))
    return F.when((kind == "belief") & _none(record, OF_BELIEF), said("beliefs", "belief has no evidence")).when((kind == "judgment") & _none(record, ("linked_beliefs",)), said("judgments", "judgment has no linked beliefs"))


def broken_references(records: DataFrame) -> DataFrame:
    """(path, message) for each reference to an id that no record has, and for beliefs and judgments that rest on nothing.

    ``records``: kind and record (VARIANT). A reference that is repeated is reported as often. Null ids are held by none; a
    missing scalar is reported as None; lists that are missing, null or no lists have no references; kinds that the store
    doesn't know have none. An empty table gives no rows.

    Missing ids are counted first, so edges meet them in as many tasks as their number needs, and the edges of an id that
    more than a task's share cite are dealt to several.
    """
    seen = Observation()
    counted = targets(records).observe(seen, F.sum("n").alias("n"))
    missing = materialize(counted.filter(~F.col("held") & (F.col("n") > 0) & F.col("target").isNotNull()).select("target", "id", F.ceil(F.col("n") / EDGE_ROOM).alias("parts")), "missing")
    tasks = max(1, -(-(seen.get["n"] or 0) // EDGE_ROOM))
    hot = F.broadcast(missing.filter("parts > 1")).alias("h")
    same = lambda a, b: (F.col(f"{a}.target") == F.col(f"{b}.target")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))
    dealt = edges(records).alias("e").join(hot, same("e", "h"), "left").select("e.*", F.coalesce(F.pmod(F.xxhash64("e.path"), F.col("h.parts")), F.lit(0)).cast("long").alias("part"))
    wanted = missing.select("target", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    key = F.xxhash64("target", "id", "part").alias("key")
    left, right = (x.select("*", key).repartition(tasks, "key").alias(n) for x, n in ((dealt, "e"), (wanted, "m")))
    lost = left.join(right, (F.col("e.key") == F.col("m.key")) & (F.col("e.part") == F.col("m.part")) & same("e", "m"), "left_semi")
    bare = records.select(_bare(F.col("record"), F.col("kind")).alias("b")).filter("b IS NOT NULL").select("b.*")
    return lost.select("path", "message").unionAll(bare)


def orphans(records: DataFrame) -> DataFrame:
    """id and n_copies of evidence without a belief that no revision cites, from the one shuffle of ``targets``."""
    return targets(records).filter((F.col("target") == "evidence") & (F.col("n_alone") > 0) & ~F.col("cited")).select("id", F.col("n_alone").alias("n_copies"))


def stored_issues(records: DataFrame) -> DataFrame:
    """(path, message) of every record by the rules of its kind; paths start with ledger and line (``records.line``)."""
    none = F.array().cast("array<struct<path:string,message:string>>")
    found = _by_kind(F.col("record"), F.col("kind"), lambda r, k: R.issues_of(r, R.KINDS[k]), none)
    head = _by_kind(F.col("record"), F.col("kind"), lambda r, k: F.lit(LEDGERS[k][0]), F.lit(""))
    rows = records.select("kind", F.concat(head, F.lit(":"), F.col("line").cast("string")).alias("head"), F.explode(found).alias("i"))
    return rows.select(F.concat("head", F.substring(F.col("i.path"), F.length("kind") + 3, F.lit(1 << 30))).alias("path"), "i.message")


def _counters(record: Column, kind: Column) -> dict[str, Column]:
    """Counters of one record, by name (fixed values)."""
    is_ = lambda k: kind == k
    has = lambda k, field, *values: F.when(is_(k), F.coalesce(_scalar(record, field).isin(*values), F.lit(False)).cast("long")).otherwise(0)
    size = lambda field: F.when(is_("belief"), F.size(_list(record, field)).cast("long")).otherwise(0)
    out = {f"{k}_count": is_(k).cast("long") for k in LEDGERS}
    out |= {"open_action_count": has("action", "status", "open"), "open_human_review_request_count": has("human_review_request", "status", "open")}
    out |= {f"{name}_evidence_count": size(f"{name}_evidence_ids") for name in ("pending", "neutral", "contested")}
    out |= {"beliefs_without_evidence": (is_("belief") & _none(record, OF_BELIEF)).cast("long"), "judgments_without_beliefs": (is_("judgment") & _none(record, ("linked_beliefs",))).cast("long")}
    out |= {"assessments_requiring_human": has("assessment", "decision", "escalate"), "assessments_deferred": has("assessment", "decision", "defer", "request_refresh")}
    truthy = F.coalesce(_scalar(record, "human_review_required").isin("", "false", "0", "[]", "{}"), F.lit(True))
    out |= {"decisions_requiring_human": (is_("decision") & ~truthy).cast("long"), "decisions_requesting_action": has("decision", "decision", "request_action_or_read")}
    return {name: F.coalesce(c.cast("long"), F.lit(0)) for name, c in out.items()}


def health(records: DataFrame, stored: bool = True) -> DataFrame:
    """counter and value: counts of all kinds and states, orphans, faults and ``belief_status.*``, zeros included but for
    statuses that no belief has.

    ``broken_reference_count`` are the rows of ``broken_references``; ``validation_issue_count`` adds those of
    ``stored_issues`` (left out without ``stored``). Counts of records and of their own faults come from one scan and a
    global aggregate; orphans and broken references from the one shuffle of ``targets``. No rows are joined.
    """
    record, kind = F.col("record"), F.col("kind")
    named = _counters(record, kind) | {"broken_reference_count": F.when(_bare(record, kind).isNotNull(), 1).otherwise(0).cast("long")}
    if stored:
        none = F.array().cast("array<struct<path:string,message:string>>")
        own = F.size(_by_kind(record, kind, lambda r, k: R.issues_of(r, R.KINDS[k]), none)).cast("long")
        named["validation_issue_count"] = own + named["broken_reference_count"]
    sums = records.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in named.items()))
    rows = sums.select(F.explode(F.create_map(*(x for name in named for x in (F.lit(name), F.col(name))))).alias("counter", "value"))
    lost = F.coalesce(F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))), F.lit(0))
    alone = F.coalesce(F.sum(F.when((F.col("target") == "evidence") & ~F.col("cited"), F.col("n_alone")).otherwise(0)), F.lit(0))
    counters = {"broken_reference_count": "lost", "orphan_evidence_count": "alone"} | ({"validation_issue_count": "lost"} if stored else {})
    keyed = targets(records).agg(lost.alias("lost"), alone.alias("alone"))
    keyed = keyed.select(F.explode(F.create_map(*(x for name, c in counters.items() for x in (F.lit(name), F.col(c))))).alias("counter", "value"))
    states = records.filter(kind == "belief").groupBy(F.concat(F.lit("belief_status."), F.coalesce(_scalar(record, "status"), F.lit("None"))).alias("counter")).agg(F.count("*").alias("value"))
    return rows.unionAll(keyed).groupBy("counter").agg(F.sum("value").alias("value")).unionAll(states)
