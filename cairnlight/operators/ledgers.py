"""Append-only ledgers: link moves, idempotent creation, applying decisions, record blocks, adjustments, learning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators.parsing import last_of_each

RELATION_ARRAYS = ("supports", "challenges", "pending", "neutral", "contests")


def move_link(rows: DataFrame, item: Column, to: Column, arrays: Sequence[str] = RELATION_ARRAYS) -> DataFrame:
    """Takes ``item`` out of all relation arrays and appends it to the one that ``to`` names; an unknown name just removes."""
    out = {a: F.when(to == a, F.array_append(F.array_remove(a, item), item)).otherwise(F.array_remove(a, item)) for a in arrays}
    return rows.withColumns(out)


def union_links(old: Column, triggers: Column, new: Column) -> Column:
    """Old ids that aren't triggers of this revision, then new ones; order kept, no repeats."""
    return F.array_union(F.array_except(old, triggers), new)


def create(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows to append: of each new id the first by its columns, and none whose id is stored."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return first.join(stored.select(key), key, "left_anti").select(*new.columns)


def apply_decision(decisions: DataFrame) -> DataFrame:
    """(id, layer, ref) records a decision gives: an action per required action, a request for human review, a question.

    ``decisions``: decision_id, decision, required_actions, human_review. Ids are hashes of their content, so applying a
    decision twice gives the same records and ``create`` appends none. Beliefs are never among them.
    """
    actions = F.transform("required_actions", lambda a: F.struct(F.lit("action").alias("layer"), a.alias("ref")))
    review = F.when(F.col("human_review") | F.array_contains("required_actions", "request_full_text_before_revision"), F.array(F.struct(F.lit("request").alias("layer"), F.lit("review").alias("ref"))))
    question = F.when(F.col("decision") == "open_question", F.array(F.struct(F.lit("question").alias("layer"), F.lit("open").alias("ref"))))
    none = F.array().cast("array<struct<layer:string,ref:string>>")
    rows = decisions.select("decision_id", F.explode(F.concat(actions, F.coalesce(review, none), F.coalesce(question, none))).alias("x"))
    return rows.select(T.stable_id("rec_", F.col("decision_id").cast("string"), F.col("x.layer"), F.col("x.ref")).alias("id"), "decision_id", "x.layer", "x.ref")


def blocks(rows: DataFrame, key: str, text: Column, start: str) -> DataFrame:
    """(key, block, field, value): KEY: value lines grouped in blocks that begin at each ``start`` line; the last value of a
    field in a block wins. A text is folded where it stands; repeated keys are texts of their own."""

    def parsed(line: Column) -> Column:
        return F.when(F.instr(line, ":") > 0, F.struct(T.label(F.substring_index(line, ":", 1)).alias("field"), F.trim(F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line))).alias("value")))

    held = T.once(rows.select(key, text.alias("_text")), _lines=F.filter(F.transform(F.split(T.blank(F.col("_text")), "\n"), parsed), lambda x: x.isNotNull())).select(key, "_lines")
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(x["field"] == start, i)), lambda i: i.isNotNull())
    at = T.once(held, _heads=heads)
    end = lambda i: F.coalesce(F.get("_heads", i + 1), F.size("_lines"))
    own = lambda h, i: F.transform(F.slice("_lines", h + 1, end(i) - h), lambda x, j: F.struct(x["field"].alias("field"), j.alias("at"), x["value"].alias("value")))
    cut = at.select(key, F.posexplode(F.transform("_heads", own)).alias("block", "_own"))
    last = cut.select(key, (F.col("block") + 1).cast("long").alias("block"), F.explode(last_of_each(F.col("_own"), "field", "value")).alias("x"))
    return last.select(key, "block", F.col("x.n").alias("field"), F.col("x.v").alias("value"))


def adjust(original: Column, adjustment: Column) -> Column:
    """A validator's number replaces the original unless it is missing or 0."""
    return F.coalesce(F.when(adjustment != 0, adjustment), original)


def boundary_status(fields: Column, status: Mapping[str, str]) -> Column:
    """map(status, fields): the given fields by the status that agreement tests gave them; unknown ones are untested."""

    def of(kind: str) -> Column:
        return F.filter(fields, lambda f: T.mapped(f, status, "untested") == kind)

    kinds = sorted({*status.values(), "untested"})
    return F.map_from_arrays(F.array(*(F.lit(k) for k in kinds)), F.array(*(of(k) for k in kinds)))


def topic_momentum(events: DataFrame, name: str) -> DataFrame:
    n = F.count("*")
    return events.groupBy(F.lower(F.trim(name)).alias("topic")).agg(n.alias("n"), F.when(n >= 5, "established").when(n >= 3, "gaining").otherwise("new").alias("momentum")).filter("n >= 2")


def refresh_candidates(rows: DataFrame, missing: Column, tiers: Sequence[str], tier: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows of the given tiers that lack a value, best first."""
    return rows.filter((T.blank(missing) == "") & tier.isin(*tiers)).orderBy(*order).limit(limit)


def arcs(matches: DataFrame, status_rank: Mapping[str, int]) -> DataFrame:
    """Per trajectory: evidence, distinct sources and its strongest status. ``matches``: name, source, status."""
    rank = T.mapped(F.col("status"), status_rank, 0)
    return matches.groupBy("name").agg(F.count("*").alias("evidence"), F.count_distinct("source").alias("sources"), F.max_by("status", F.struct(rank, F.col("status"))).alias("strongest"))
