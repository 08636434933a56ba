"""Work queue: priorities, frontiers, tasks from objects, the summary state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import scoring as S


def calibrate(kind: Column, base: Column, text: Column, taste: Mapping[str, float], types=V.TASK_TYPES) -> Column:
    """base x multiplier + adjustment + weights of the terms that match, 0 to 60."""
    pick = lambda i, d: T.mapped(kind, {k: v[i] for k, v in types.items()}, d)
    return T.clamp(base * pick(0, 1.0) + pick(1, 0.0) + T.term_weight(F.lower(text), taste), 0.0, 60.0, 2)


def frontier(direction: Column, concept: Column, kind: Column, text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Given direction, else concept, else the first rule with a term in the text, else by the task's type."""
    by_rule = S.first_rule(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), rules, "")
    return F.coalesce(T.filled(direction), F.when(F.trim(concept) != "", F.concat(F.lit("Concept: "), T.clean(concept, 96))), T.filled(by_rule),
                      F.when(kind.isin("verify_pressure_constraint", "next_kernel_move"), V.DEFERRED_FRONTIER), T.filled(kind), F.lit("General Kernel Work"))


def from_objects(objects: DataFrame) -> DataFrame:
    """A task per object by its state: contested, uncommitted, open question, unverified constraint; others give none.

    ``objects``: key, kind, status, confidence. One task per key and type.
    """
    kind = (F.when(F.col("status") == "contested", "resolve_contested_object").when((F.col("kind") == "question") & (F.col("status") == "open"), "sharpen_open_question")
            .when((F.col("kind") == "constraint") & (F.col("status") != "verified"), "verify_constraint").when(F.col("status") == "candidate", "commit_or_reject_object"))
    return objects.select("key", kind.alias("task_type"), (F.col("confidence") * 3).alias("priority")).filter("task_type IS NOT NULL").dropDuplicates(["key", "task_type"])


def summary_state(contradictions: Column, pressure: Column, beliefs: Column) -> Column:
    return F.when(contradictions > 0, "unstable").when(pressure > 0, "learning").when(beliefs > 0, "stable").otherwise("forming")
