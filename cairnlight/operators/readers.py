"""Relation readers: each reads a paper for a belief and votes support, challenge, unclear or neutral."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import scoring as S

Terms = Mapping[str, Sequence[str]]


def intake_mode(text: Column, types=V.INTAKE_TYPES) -> Column:
    """The first type with a word in the text gives the mode; trajectory_fit if none has."""
    return S.first_rule(F.lower(text), [(mode, words) for _, mode, words in types], "trajectory_fit")


def explicit_conflict(text: Column, terms: Terms = V.READER_TERMS) -> Column:
    return F.when(T.contains_any(F.lower(text), terms["conflict"]), "challenge").otherwise("neutral")


def _graded(support: Column, unclear: Column) -> Column:
    return F.when(support, "support").when(unclear, "unclear").otherwise("neutral")


def mechanism_trace(mode: Column, evidence: Column, content: Column, primary: Column, terms: Terms = V.READER_TERMS) -> Column:
    """Traces of mechanism: by mode, counts of terms in the evidence and of anchors in the primary text."""
    n = lambda c, k: T.count_terms(c, terms[k])
    anchored, m, p, r = n(primary, "anchor") >= 1, n(evidence, "mechanism"), n(evidence, "platform") >= 1, n(evidence, "readout") >= 1
    off = T.contains_any(content, terms["off_topic"]) & (n(primary, "anchor") < 2)
    general = _graded((m >= 2) & anchored, (m == 1) & anchored)
    return (F.when(explicit_conflict(content, terms) == "challenge", "challenge")
            .when((mode == "transduction_validity") & off, "neutral")
            .when(mode == "transduction_validity", _graded(r & (n(evidence, "biology") >= 1) & (m >= 1) & anchored, r & (m >= 1) & anchored))
            .when(mode == "platform_bridge", _graded(p & (n(content, "connection") >= 1) & anchored, p & anchored)).otherwise(general))


def belief_content(mode: Column, evidence: Column, content: Column, primary: Column, terms: Terms = V.READER_TERMS) -> Column:
    """Whether the evidence speaks to the belief's content under its mode.

    A conflict decides first. In all modes but biological_relevance a cue that the text is off the topic makes it neutral
    unless the primary text has an anchor (two in transduction_validity).
    """
    n = lambda k: T.count_terms(evidence, terms[k])
    anchors = T.count_terms(primary, terms["anchor"])
    anchored = anchors >= 1
    off = lambda least: T.contains_any(content, terms["off_topic"]) & (anchors < least)
    read, meant = n("readout") >= 1, n("biology") >= 1
    carried = (n("preservation") >= 1) | T.contains_any(content, terms["carrier"])
    sensing = (F.when(off(2), "neutral").when(T.contains_any(content, terms["unspecified"]), F.when(read, "unclear").otherwise("neutral"))
               .otherwise(_graded((n("readout") >= 2) & meant & anchored & carried, read & meant & anchored)))
    on_topic = lambda graded: F.when(off(1), "neutral").otherwise(graded)
    by_mode = {
        "transduction_validity": sensing,
        "mechanism_to_coupling": on_topic(_graded((n("mechanism") >= 2) & anchored, (n("mechanism") >= 1) & anchored)),
        "platform_bridge": on_topic(_graded((n("platform") >= 1) & anchored, (n("platform") >= 1) & (n("active") >= 1))),
        "biological_relevance": _graded(meant & (n("state") >= 1), meant),
        "synthesis_prior": on_topic(_graded((n("synthesis") >= 2) & anchored, T.contains_any(evidence, terms["overview"]) & anchored)),
    }
    out = F.when(explicit_conflict(content, terms) == "challenge", "challenge")
    for name, graded in by_mode.items():
        out = out.when(mode == name, graded)
    return out.otherwise(on_topic(_graded(anchors >= 2, anchors == 1)))


def digest_connection(connection: Column, primary: Column, content: Column, terms: Terms = V.READER_TERMS) -> Column:
    """What the digest says of the connection, believed only if both texts hold an anchor."""
    c = F.lower(T.blank(connection))
    linked = T.count_terms(c, terms["connection"]) >= 1
    both = (T.count_terms(primary, terms["anchor"]) >= 1) & (T.count_terms(c, terms["anchor"]) >= 1)
    return (F.when(explicit_conflict(content, terms) == "challenge", "challenge").when(F.trim(c) == "", "neutral").when(T.contains_any(c, terms["off_topic"]), "neutral").otherwise(_graded(linked & both, linked)))
