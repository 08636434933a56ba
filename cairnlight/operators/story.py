"""Arcs of trajectories and the story graph of each: merged concepts and papers, six nodes in order and the edges between.

What an arc shows of its trajectories is the best few of many, so each list is a top-k by rank, cut before it moves; an
arc that a third of all trajectories belong to collects no more than the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlight.functions import text as T

# Ranks of a status, and the nodes of a story: id, type, label, status, and whether it shows two papers only.
STATUS_RANK = {"seed": 0, "watching": 1, "active": 2, "rising": 3}
NODES = (
    ("story-question", "question", "Core Question", "active"), ("story-working-hypothesis", "working_hypothesis", "Working Hypothesis", "watching"), ("story-turning-point", "turning_point", "Turning Point", "rising"),
    ("story-conceptual-shift", "conceptual_shift", "Conceptual Shift", "seed"), ("story-current-model", "current_model", "Current Model", "active"), ("story-next-question", "next_question", "Next Question", "rising"),
)
EDGE = "evolves_to"
# End of fixed values.
CONCEPTS, PAPERS, RELATED = 5, 8, 4


def _top(rows: DataFrame, order: Sequence[Column], k: int, value: Column, name: str) -> DataFrame:
    """arc and the array of ``value`` of its k first rows, in order; the window's limit is applied before the shuffle too."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("arc").orderBy(*order))).filter(F.col("_r") <= k)
    return ranked.groupBy("arc").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value.alias("v")))), lambda x: x["v"]).alias(name))


def arcs(trajectories: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row for each arc that a trajectory belongs to (its lower-cased name holds one of the arc's terms).

    ``trajectories``: pos (their order), name, status, evidence_count, missing_link, next_move, concepts (name, appearances)
    and papers (doi, title). An arc has the strongest status, summed evidence but no less than its papers and its best
    concepts' appearances, the first missing link and next move that aren't empty, the first names, concepts merged by name
    (most appearances first, then by name from the last) and papers by doi or title (the first of each). Null texts are
    empty, null lists have nothing, null numbers are zero; trajectories of several arcs count in each.
    """
    held = F.filter(F.array(*(F.when(T.contains_any(F.lower(T.blank(F.col("name"))), tuple(ts)), F.lit(arc)) for arc, ts in terms.items())), lambda a: a.isNotNull())
    rows = trajectories.select(F.explode(held).alias("arc"), "pos", T.blank(F.col("name")).alias("name"), T.blank(F.col("status")).alias("status"), F.coalesce(F.col("evidence_count"), F.lit(0)).cast("long").alias("evidence"), T.blank(F.col("missing_link")).alias("missing"), T.blank(F.col("next_move")).alias("move"), "concepts", "papers")
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv)), F.col("status")), F.lit(0))
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.trim(c) != "", F.col("pos"))), F.lit(""))
    base = rows.groupBy("arc").agg(F.sum("evidence").alias("summed"), F.max_by("status", F.struct(rank.alias("r"), (-F.col("pos")).alias("p"))).alias("status"), first("missing").alias("missing_link"), first("move").alias("next_move"))
    concept = rows.select("arc", "pos", F.posexplode("concepts").alias("at", "x")).select("arc", F.struct("pos", "at").alias("at"), F.trim(T.blank(F.col("x.name"))).alias("name"), F.coalesce(F.col("x.appearances"), F.lit(0)).cast("long").alias("appearances")).filter("name <> ''")
    merged = concept.groupBy("arc", "name").agg(F.max("appearances").alias("appearances"))
    paper = rows.select("arc", "pos", F.posexplode("papers").alias("at", "x")).select("arc", F.struct("pos", "at").alias("at"), F.lower(F.trim(F.coalesce(F.nullif(T.blank(F.col("x.doi")), F.lit("")), T.blank(F.col("x.title"))))).alias("key"), F.struct(T.blank(F.col("x.doi")).alias("doi"), T.blank(F.col("x.title")).alias("title")).alias("paper")).filter("key <> ''")
    firsts = paper.groupBy("arc", "key").agg(F.min(F.struct("at", "paper")).alias("x"))
    counts = lambda df, name: df.groupBy("arc").agg(F.count("*").alias(name))
    out = base.join(_top(rows, (F.col("pos"),), RELATED, F.col("name"), "related"), "arc", "left")
    out = out.join(_top(merged, (F.desc("appearances"), F.desc("name")), CONCEPTS, F.struct("name", "appearances"), "concepts"), "arc", "left").join(counts(merged, "concept_count"), "arc", "left")
    out = out.join(_top(firsts, (F.col("x.at"),), PAPERS, F.col("x.paper"), "papers"), "arc", "left").join(counts(firsts, "paper_count"), "arc", "left")
    shown = F.coalesce(F.col("paper_count"), F.lit(0)) + F.aggregate(F.coalesce("concepts", F.array().cast("array<struct<name:string,appearances:bigint>>")), F.lit(0).cast("long"), lambda a, c: a + c["appearances"])
    return out.select(
        "arc", "status", F.greatest("summed", shown).alias("evidence_count"), F.coalesce("paper_count", F.lit(0)).cast("long").alias("paper_count"), F.coalesce("concept_count", F.lit(0)).cast("long").alias("concept_count"), "missing_link", "next_move", "related",
        F.coalesce("concepts", F.array().cast("array<struct<name:string,appearances:bigint>>")).alias("concepts"), F.coalesce("papers", F.array().cast("array<struct<doi:string,title:string>>")).alias("papers"))


def _many(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def nodes(arcs_: DataFrame, titles: Mapping[str, Column]) -> DataFrame:
    """arc, place, node_id, node_type, type_label, title, summary, status and what the node shows: six rows an arc.

    ``titles``: the text of each node type, over the arc's columns. The turning point is only watched where no paper makes
    it; the conceptual shift shows two papers and no missing link.
    """
    n = F.col
    said = F.concat(_many(n("evidence_count"), "evidence point"), F.lit(", "), _many(n("paper_count"), "supporting paper"), F.lit(" and "), _many(n("concept_count"), "related concept signal"), F.lit(" currently support this node."))
    made = []
    for place, (id_, type_, label, status) in enumerate(NODES):
        state = F.when(F.size("papers") > 0, status).otherwise("watching") if type_ == "turning_point" else F.lit(status)
        shift = type_ == "conceptual_shift"
        summary = {"question": said, "next_question": n("missing_link")}.get(type_, titles[type_])
        made.append(F.struct(F.lit(place).alias("place"), F.lit(id_).alias("node_id"), F.lit(type_).alias("node_type"), F.lit(label).alias("type_label"), titles[type_].alias("title"), summary.alias("summary"), state.alias("status"),
                             (F.slice("papers", 1, 2) if shift else n("papers")).alias("papers"), (F.lit("") if shift else n("missing_link")).alias("missing_link")))
    return arcs_.select("arc", F.explode(F.array(*made)).alias("x"), "evidence_count", "paper_count", "concept_count", "related", "concepts", "next_move").select("arc", "x.*", "evidence_count", "paper_count", "concept_count", "related", "concepts", "next_move")


def edges(arcs_: DataFrame) -> DataFrame:
    """arc, source, target and type: from each node of an arc's story to the next."""
    pairs = F.array(*(F.struct(F.lit(a[0]).alias("source"), F.lit(b[0]).alias("target")) for a, b in zip(NODES, NODES[1:])))
    return arcs_.select("arc", F.explode(pairs).alias("x")).select("arc", "x.source", "x.target", F.lit(EDGE).alias("type"))
