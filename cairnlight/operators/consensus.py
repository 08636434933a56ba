"""Reader votes to relations, and evidence strength and direction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T


def normalise_relation(c: Column, words: Mapping[str, Sequence[str]] = V.RELATION_WORDS) -> Column:
    """Aliases to one of six relations; null, empty and unknown words are unclear."""
    table = {w: r for r, ws in words.items() for w in (r, *ws)}
    return T.mapped(F.translate(F.lower(F.trim(T.blank(c))), "_", "-"), table, "unclear")


def consensus(votes: DataFrame, keys: Sequence[str], relation: str = "relation") -> DataFrame:
    """One relation per key from its votes. Groups fold to six flags on the map side, however many votes there are.

    Unanimous direction without unresolved votes wins before a contest is looked at; then conflict, neutrality, and else
    more evidence is needed. Rows whose relation is null count as no vote.
    """
    r = normalise_relation(F.col(relation))
    given = F.col(relation).isNotNull()
    flag = lambda *names: F.coalesce(F.bool_or(given & r.isin(*names)), F.lit(False))
    flags = votes.groupBy(*keys).agg(flag("support").alias("s"), flag("challenge").alias("c"), flag("contest").alias("x"), flag("neutral").alias("z"), flag("underdetermined", "unclear").alias("u"), F.count_if(given).alias("n_votes"))
    s, c, x, z, u = (F.col(n) for n in "scxzu")
    kind = (F.when(F.col("n_votes") == 0, "underdetermined").when(s & ~c & ~u, "support").when(c & ~s & ~u, "challenge").when((s & c) | x, "contest")
            .when(~s & ~c & z, "neutral").otherwise("underdetermined"))
    weak = F.when(kind.isin("support", "challenge", "neutral"), kind).when(kind == "contest", "unclear").when(s, "support").when(c, "challenge").otherwise("unclear")
    need = F.when(kind == "contest", "human").when(kind == "underdetermined", "more_evidence").otherwise("none")
    return flags.select(*keys, kind.alias("relation"), weak.alias("weak_direction"), need.alias("adjudication"), "n_votes")


def single_reader(votes: Column) -> Column:
    """The first directional vote of an ordered array, else unclear."""
    return F.coalesce(F.get(F.filter(votes, lambda v: v.isin("support", "challenge", "contest")), F.lit(0)), F.lit("unclear"))


def strength_from_facts(source_type: Column, reports_lod: Column, points=V.SOURCE_POINTS, levels=V.STRENGTH_LEVELS) -> Column:
    """struct(strength, score) from the two facts that readers agree on."""
    score = T.mapped(source_type, points, 0.5) + F.when(F.coalesce(reports_lod, F.lit(False)), 0.25).otherwise(0.0)
    out = F.lit("weak")
    for least, name in reversed(levels):
        out = F.when(score >= least, name).otherwise(out)
    return F.struct(out.alias("strength"), F.round(score, 2).alias("score"))


def direction(belief: Column, action: Column, contests: Column, pending: Column, neutral: Column, challenges: Column, supports: Column, provenance: Column) -> Column:
    """Which way an evidence row points for a belief: its own lists first, then the action's default."""
    out = F.when(F.array_contains(contests, belief), "contest").when(F.array_contains(pending, belief), "underdetermined").when(F.array_contains(neutral, belief), "neutral")
    out = out.when(F.array_contains(challenges, belief), "challenge").when(F.array_contains(supports, belief), "support")
    out = out.when(action.isin("weaken", "challenge", "contradict"), "challenge").when(action == "contest", "contest")
    return out.when((action == "update") & provenance.isin("underdetermined", "neutral"), provenance).otherwise("support")


def action_status(current: Column, action: Column) -> Column:
    table = {"contest": "contested", "challenge": "challenged", "contradict": "contradicted", "resolve": "resolved", "archive": "archived", "reopen": "active", "strengthen": "active"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), action), current)
