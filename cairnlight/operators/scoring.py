"""Dictionary scores, dispatch, routing, tiers and the other row-wise rules.

All are columns over one row: no shuffle, no Python, filters stay pushable. Dictionaries and rules are literals, so a
substring match never becomes a nested-loop join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T


def half_up(c: Column, digits: int) -> Column:
    """Rounds decimal ties up although sums of binary fractions fall just beside them."""
    return F.round(F.round(c, digits + 6), digits)


def matched(text: Column, dictionary: Mapping[str, int]) -> Column:
    """Dictionary entries that occur in the prepared text (no word borders), in the dictionary's order.

    One CASE term an entry: inside a lambda over the entries the text would be prepared again for each.
    """
    found = (F.when(F.contains(text, F.lit(p)), F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for p, w in dictionary.items())
    return F.filter(F.array(*found), lambda d: d.isNotNull())


def signal_score(text: Column, dictionary: Mapping[str, int]) -> Column:
    """Each phrase counts once. One fused sum of CASE terms keeps this inside generated code."""
    out = F.lit(0)
    for phrase, weight in dictionary.items():
        out = out + F.when(F.contains(text, F.lit(phrase)), F.lit(weight)).otherwise(F.lit(0))
    return out


def tier_counts(text: Column, tiers: Sequence[Sequence[str]]) -> list[Column]:
    return [sum((F.contains(text, F.lit(p)).cast("int") for p in tier), F.lit(0)) for tier in tiers]


def dispatch(t1: Column, t2: Column, t3: Column) -> Column:
    """FULL, MEDIUM or LOW from the number of matches of each tier."""
    return F.when((t1 >= 2) | ((t1 == 1) & (t2 >= 2)), "FULL").when((t1 >= 1) | (t2 >= 2) | (t3 >= 3), "MEDIUM").otherwise("LOW")


def dispatch_reason(t1: Column, t2: Column, t3: Column) -> Column:
    full = (t1 >= 2) | ((t1 == 1) & (t2 >= 2))
    return (F.when(full, F.format_string("%d T1 + %d T2 signals", t1, t2)).when(t1 >= 1, F.format_string("%d T1 signal", t1))
            .when(t2 >= 2, F.format_string("%d T2 signals", t2)).when(t3 >= 3, F.format_string("%d T3 signals", t3))
            .otherwise(F.format_string("only %dT1/%dT2/%dT3 — kernel-only classification", t1, t2, t3)))


def is_non_research(text: Column, phrases: Sequence[str] = V.NON_RESEARCH) -> Column:
    return T.bound(F.lower(text), lambda t: T.contains_any(t, phrases))


def prefilter(rows: DataFrame, text: Column, threshold: int, dictionary: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(passed, ignored): passed rows score strictly over the threshold. Each row's text is prepared once."""
    scored = T.once(T.once(rows, _prepared=T.prepare(text)), score=signal_score(F.col("_prepared"), dictionary)).drop("_prepared")
    return scored.filter(F.col("score") > threshold), scored.filter(F.col("score") <= threshold)


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule with a phrase in the text."""
    out = F.lit(default)
    for name, phrases in reversed(rules):
        out = F.when(T.contains_any(text, phrases), F.lit(name)).otherwise(out)
    return out


def paper_type(raw_type: Column, text: Column, labels=V.TYPE_LABELS, phrases=V.TYPE_PHRASES) -> Column:
    """A given label decides; else the first rule whose phrase the text holds; else other_research."""
    table = {name: kind for kind, names in labels.items() for name in (kind, *names)}
    given = T.mapped(T.label(raw_type), table, "")
    return F.when(given != "", given).otherwise(T.bound(F.lower(text), lambda t: first_rule(t, phrases, "other_research")))


def judgment_mode(raw_mode: Column, kind: Column, modes=V.MODE_WEIGHTS, by_type=V.TYPE_MODES) -> Column:
    given = T.label(raw_mode)
    return F.when(given.isin(*modes), given).otherwise(T.mapped(kind, by_type, "general_judgment"))


def mode_score(mode: Column, fields: Sequence[Column], weights=V.MODE_WEIGHTS) -> Column:
    """Weighted sum of the five scores under the mode's weights, to one digit; unknown modes use the general ones."""
    table = F.create_map(*(x for m, w in weights.items() for x in (F.lit(m), F.array(*(F.lit(v) for v in w)))))
    w = F.coalesce(F.element_at(table, T.label(mode)), F.array(*(F.lit(v) for v in weights["general_judgment"])))
    return half_up(sum((F.coalesce(f, F.lit(0.0)) * w[i] for i, f in enumerate(fields)), F.lit(0.0)), 1)


def mode_audit(mode: Column, text: Column, rules: Mapping[str, Sequence[tuple[str, Sequence[str]]]]) -> Column:
    """struct(passed, total, confidence): checks of the mode with any of their terms in the text; 1.0 without checks."""
    out = F.struct(F.lit(0).alias("passed"), F.lit(0).alias("total"), F.lit(1.0).alias("confidence"))
    for name, checks in rules.items():
        passed = sum((T.contains_any(text, terms).cast("int") for _, terms in checks), F.lit(0))
        out = F.when(mode == name, F.struct(passed.alias("passed"), F.lit(len(checks)).alias("total"), F.round(passed / F.lit(len(checks)), 2).alias("confidence"))).otherwise(out)
    return out


def rank_tier(final: Column, novelty: Column, bridge: Column, trajectory: Column, listed: Column) -> Column:
    """HIGH, IMPORTANT, POTENTIAL, WATCHLIST (low, but on a list of topics) or LOW."""
    return (F.when((final >= 8) | ((novelty >= 9) & (bridge >= 8)) | ((bridge >= 9) & (trajectory >= 8)), "HIGH_PRIORITY")
            .when((final >= 6) | ((trajectory >= 8) & (final >= 5.5)) | ((novelty >= 8) & (bridge >= 7)), "IMPORTANT")
            .when(final >= 4, "POTENTIAL").when(listed, "WATCHLIST").otherwise("LOW_PRIORITY"))


def watchlist_floor(tier: Column, listed: Column) -> Column:
    return F.when(tier.isin("LOW_PRIORITY", "LOW", "IGNORE") & listed, "WATCHLIST").otherwise(tier)


def journal_tier(journal: Column, tiers=V.JOURNAL_TIERS) -> Column:
    """First tier with a name inside the journal's; 3 if none."""
    out = F.lit(3)
    for tier, names in reversed(tiers):
        out = F.when(T.contains_any(F.lower(T.blank(journal)), names), F.lit(tier)).otherwise(out)
    return out


def evidence_strength(journal: Column, abstract: Column, problem: Column, novelty: Column, tiers=V.JOURNAL_TIERS) -> Column:
    """struct(score, strength, factors) of the rule-based estimate. The texts are lower-cased once a row."""
    read = F.struct(journal_tier(journal, tiers).alias("tier"), F.lower(T.blank(abstract)).alias("al"), F.lower(T.blank(novelty)).alias("nl"), F.lower(T.blank(problem)).alias("pl"))
    return T.bound(read, lambda r: _strength(r["tier"], r["al"], r["nl"], r["pl"]))


def _strength(tier: Column, al: Column, nl: Column, pl: Column) -> Column:
    n = F.regexp_extract(al, r"n\s*=\s*(\d+)", 1).try_cast("long")
    terms = [
        (tier == 1, 2.0, "top-tier journal"), (tier == 2, 1.0, "high-impact journal"),
        (al.rlike("n ?=") & F.coalesce(n >= 100, F.lit(False)), 1.0, "large sample"),
        (T.contains_any(al, ("validated", "independently confirmed", "consistent with", "reproduc")), 0.5, "validation language"),
        (T.contains_any(al, ("limitation", "caveat", "further study needed")), 0.5, "limitation disclosure"),
        (F.contains(nl, F.lit("validation")), 1.0, "validation paper"),
        (~F.contains(nl, F.lit("validation")) & T.contains_any(nl, ("new mechanism", "new transduction")) & (tier >= 2), 0.5, "new mechanism in reputable journal"),
        (T.contains_any(pl, ("review", "commentary", "perspective")), -1.5, "review/commentary"),
    ]
    summed = lambda h: sum((F.when(h[i], F.lit(v)).otherwise(0.0) for i, (_, v, _) in enumerate(terms)), F.lit(5.0))
    named = lambda h: F.filter(F.array(*(F.when(h[i], F.lit(name)) for i, (_, _, name) in enumerate(terms))), lambda x: x.isNotNull())
    read = T.bound(F.array(*(c for c, _, _ in terms)), lambda h: F.struct(summed(h).alias("score"), named(h).alias("factors")))
    return T.bound(read, lambda r: F.struct(T.clamp(r["score"], 0, 10, 1).alias("score"), F.when(r["score"] >= 7, "High").when(r["score"] >= 4.5, "Medium").otherwise("Low").alias("strength"), r["factors"].alias("factors")))


def concept_support(base: Column, strength: Column, support_type: Column, appearances: Column, status: Column, generous: bool = False) -> Column:
    """Recalibrated support, 0 to 10, rounded half to even. ``generous``: the harvest variant gives five appearances 2."""
    bonus = F.when(F.coalesce(appearances, F.lit(0)) >= 5, 2.0 if generous else 1.0).when(F.coalesce(appearances, F.lit(0)) >= 3, 1.0).otherwise(0.0)
    total = (base + F.when(strength == "High", 1.0).when(strength == "Low", -2.0).otherwise(0.0)
             + F.when(support_type == "Discovery", 1.0).when(support_type == "Validation", 0.5).when(support_type == "Weak Signal", -1.0).otherwise(0.0) + bonus)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 0)


def domain_consistency(problem: Column, concept: Column, rules: Mapping[str, Sequence[str]], exempt: Sequence[str] = (), penalty: int = 3) -> Column:
    """struct(consistent, flag, penalty): the first rule whose name is in the problem class names the expected terms."""
    pc, cn = F.lower(T.blank(problem)), F.lower(F.trim(T.blank(concept)))
    known, fits = F.lit(False), F.lit(False)
    for name, terms in reversed(list(rules.items())):
        here = F.contains(pc, F.lit(name.lower()))
        known, fits = here | known, F.when(here, T.contains_any(cn, terms)).otherwise(fits)
    given = (pc != "") & (cn != "")
    flag = (F.when(~given, F.lit(None).cast("string")).when(~known, "Unknown problem class").when(fits, F.lit(None).cast("string"))
            .when(cn.isin(*exempt) if exempt else F.lit(False), "Cross-domain concept (allowed)").otherwise("Domain mismatch"))
    bad = F.coalesce(flag == "Domain mismatch", F.lit(False))
    return F.struct((~bad).alias("consistent"), flag.alias("flag"), F.when(bad, penalty).otherwise(0).alias("penalty"))


def blind_spot(score: Column, high_journal: Column, hints: Column, similarity: Column) -> Column:
    """struct(signals, is_blind_spot, confidence) of four independent signs."""
    signals = (score <= 2).cast("int") + high_journal.cast("int") + (hints >= 2).cast("int") + (similarity >= 0.35).cast("int")
    return F.struct(signals.alias("signals"), (signals >= 3).alias("is_blind_spot"), F.when(signals >= 3, F.round(F.least(F.lit(0.9), 0.3 + 0.15 * signals), 2)).otherwise(0.0).alias("confidence"))


def pattern_score(material: Column, novel: Column, domains: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(5.0) - material.cast("int") + 2.0 * novel.cast("int") + F.when(domains >= 2, 1.5).otherwise(0.0)))


def framework_score(prediction: Column, falsifiability: Column, actionability: Column, compression: Column, novelty: Column, constraints: Column) -> Column:
    strength = F.least(F.lit(10.0), 2.5 * constraints + 2)
    v = 0.25 * prediction + 0.25 * strength + 0.20 * falsifiability + 0.15 * actionability + 0.10 * compression + 0.05 * novelty
    return half_up(F.when((compression >= 7) & (prediction <= 3), v * 0.5).otherwise(v), 1)
