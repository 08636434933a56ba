"""Additive schema migration: files of several generations read as one table.

A table's folder has a folder for each generation (``generation=N``). A column added since then is missing in older files;
it reads as its default there, and as what the file says, nulls too, from the generation that has it. Nothing is rewritten.
Filters on columns that were always there reach the files, and so do those on added columns without a default; a filter on
the generation drops whole folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Added:
    """A column that files have from generation ``since`` on."""

    name: str
    kind: str
    default: str | float | None = None
    since: int = 1


def _texts(*names: str) -> tuple[Added, ...]:
    return tuple(Added(n, "string") for n in names)


#: Columns that tables of the store gained, with their defaults.
ADDITIONS: dict[str, tuple[Added, ...]] = {
    "papers": (
        *_texts("evidence", "limitation", "caveat", "project_relevance"), Added("review_status", "string", "summarized"),
        *_texts("problem_class", "novelty_type", "strategic_value", "concept_support_name", "support_type", "evidence_strength"), Added("concept_support_score", "double", 0.0), *_texts("evidence_type", "causal_modifier", "causal_context"),
    ),
    "concept_tracking": (
        *_texts("definition", "covered_papers", "logic_pattern"), Added("epistemic_entrenchment", "double", 3.0), *_texts("state_transition", "evidence_strength", "limitation"), Added("novelty_score", "double", 0.0), *_texts("actionability", "project_fit"),
    ),
    "frameworks": (
        *_texts("compressed_concepts", "core_logic", "worldview_shift", "suggested_experiment"), *(Added(n, "double", 0.0) for n in ("predictive_power", "falsifiability", "actionability", "transferability", "taste_fit")), Added("status", "string", "candidate"),
    ),
    "deltas": (*_texts("evidence", "implication", "affected_projects"), Added("status", "string", "candidate")),
    "logic_patterns": (Added("status", "string", "candidate"),),
}


def read_generations(spark: SparkSession, path: str, base: str, additions: Sequence[Added]) -> DataFrame:
    """The columns of ``base`` (DDL), the added ones and generation, from all generations under ``path``.

    A name that base has already isn't added again, as running a migration twice changes nothing; of a name added twice the
    first counts. A folder without files gives no rows. What else files hold is not read.
    """
    have = {n.lower() for n in StructType.fromDDL(base).names}
    fresh: dict[str, Added] = {}
    for a in additions:
        if a.name.lower() not in have:
            fresh.setdefault(a.name.lower(), a)
    schema = StructType.fromDDL(", ".join([base, *(f"`{a.name}` {a.kind}" for a in fresh.values()), "generation int"]))
    rows = spark.read.schema(schema).parquet(path)
    value = lambda a: F.when(F.col("generation") < a.since, F.lit(a.default).cast(a.kind)).otherwise(F.col(a.name)).alias(a.name) if a.default is not None else F.col(a.name)
    return rows.select(*StructType.fromDDL(base).names, *(value(a) for a in fresh.values()), "generation")


def append_generation(rows: DataFrame, path: str, generation: int) -> None:
    """Rows as files of a generation, beside those there are."""
    rows.write.mode("append").parquet(f"{path}/generation={generation}")
