"""The order-dependent fold of evidence into belief confidence and entrenchment.

Every step rounds and clamps, so steps don't combine out of order: a belief's evidence is folded in sequence. ``fold``
keeps a belief's evidence as one sorted array in the JVM; ``fold_long`` streams sorted rows through a constant-size state
and is the way for beliefs with more evidence than an array should hold. Both give the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T

SOURCES = tuple(V.SOURCE_ENTRENCHMENT)
STATE = "struct<c:double,e:double,ns:int,nc:int,by:array<int>,n:int>"


def _r4(c: Column) -> Column:
    """To ten places, then four, each as SQL rounds doubles: the scaled double to a whole number, halves away from zero."""
    return F.round(F.round(c * 1e10) / 1e10 * 1e4) / 1e4


def _step(a: Column, x: Column, many: Column) -> Column:
    """One revision with one piece of evidence: x has direction, strength, source, override."""
    moves, up = x["direction"].isin("support", "challenge"), x["direction"] == "support"
    resist = _r4(1 / (1 + F.lit(V.RESISTANCE) * a["e"]))
    seen = F.when(up, a["ns"]).otherwise(a["nc"])
    size = _r4(T.mapped(x["strength"], V.EVIDENCE_DELTAS, 0.10) / F.sqrt(seen + 1) * resist)
    raw = _r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["c"] + F.when(up, size).otherwise(-size))))
    cap = lambda i: F.when(x["override"], V.CAPS["override"][i]).when(x["strength"] == "decisive", V.CAPS["decisive"][i]).otherwise(V.CAPS["soft"][i])
    confidence = _r4(F.greatest(cap(0), F.least(cap(1), raw)))
    at = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SOURCES)), x["source"]), F.lit(0)).cast("int")
    at = F.when(at == 0, len(SOURCES)).otherwise(at)  # an unknown source counts as external, the last
    base = F.element_at(F.array(*(F.lit(v) for v in V.SOURCE_ENTRENCHMENT.values())), at) / F.sqrt(F.element_at(a["by"], at) + 1)
    moved = F.when(moves, _r4(F.when(up, base * many).otherwise(-(base / many)))).otherwise(0.0) + F.when(x["override"], V.OVERRIDE_ENTRENCHMENT).otherwise(0.0)
    entrenchment = _r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["e"] + moved)))
    by = F.transform(a["by"], lambda v, i: F.when(moves & up & (i + 1 == at), v + 1).otherwise(v))
    return F.struct(F.when(moves, confidence).otherwise(a["c"]).alias("c"), entrenchment.alias("e"), (a["ns"] + (moves & up).cast("int")).alias("ns"), (a["nc"] + (moves & ~up).cast("int")).alias("nc"), by.alias("by"), (a["n"] + 1).alias("n"))


def fold(evidence: DataFrame, beliefs: DataFrame) -> DataFrame:
    """belief, confidence, entrenchment, n_support, n_challenge, n_steps.

    ``evidence``: belief, seq, direction, strength, source, override (seq unique per belief). ``beliefs``: belief,
    confidence, entrenchment, dependencies. Beliefs without evidence keep their numbers.
    """
    steps = evidence.groupBy("belief").agg(F.array_sort(F.collect_list(F.struct("seq", "direction", "strength", "source", "override"))).alias("steps"))
    many = 1 + F.least(F.col("dependencies"), F.lit(V.DEPENDENCY_MOST)) * V.DEPENDENCY_STEP
    start = F.struct(F.col("confidence").cast("double").alias("c"), F.col("entrenchment").cast("double").alias("e"), F.lit(0).alias("ns"), F.lit(0).alias("nc"), F.array(*(F.lit(0) for _ in SOURCES)).alias("by"), F.lit(0).alias("n")).cast(STATE)
    folded = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<seq:bigint,direction:string,strength:string,source:string,override:boolean>>")), start, lambda a, x: _step(a, x, many).cast(STATE))
    return beliefs.join(steps, "belief", "left").select("belief", folded.alias("f")).select("belief", F.col("f.c").alias("confidence"), F.col("f.e").alias("entrenchment"), F.col("f.ns").alias("n_support"), F.col("f.nc").alias("n_challenge"), F.col("f.n").alias("n_steps"))


def _whole(x: float) -> float:
    low = math.floor(abs(x))
    return math.copysign(low + (abs(x) - low >= 0.5), x)


def _r(x: float) -> float:
    """As ``_r4``, to the last bit."""
    return _whole(_whole(x * 1e10) / 1e10 * 1e4) / 1e4


#: What a running fold keeps: confidence, entrenchment, supports, challenges, supports by kind of source, steps.
Running = list


def opened(confidence: float, entrenchment: float) -> Running:
    return [confidence, entrenchment, 0, 0, {}, 0]


def revise(s: Running, direction: str, strength: str, source: str, override: bool, dependencies: int) -> None:
    """One revision with one piece of evidence, in place; rounds and clamps as the array fold does."""
    many = 1 + min(dependencies, V.DEPENDENCY_MOST) * V.DEPENDENCY_STEP
    moved = 0.0
    if direction in ("support", "challenge"):
        up = direction == "support"
        size = _r(V.EVIDENCE_DELTAS.get(strength, 0.10) / math.sqrt((s[2] if up else s[3]) + 1) * _r(1 / (1 + V.RESISTANCE * s[1])))
        low, high = V.CAPS["override"] if override else V.CAPS["decisive"] if strength == "decisive" else V.CAPS["soft"]
        kind = source if source in V.SOURCE_ENTRENCHMENT else "external"
        base = V.SOURCE_ENTRENCHMENT[kind] / math.sqrt(s[4].get(kind, 0) + 1)
        moved = _r(base * many if up else -(base / many))
        s[0] = _r(max(low, min(high, _r(max(0.0, min(1.0, s[0] + (size if up else -size)))))))
        s[2 if up else 3] += 1
        if up:
            s[4][kind] = s[4].get(kind, 0) + 1
    s[1] = _r(max(0.0, min(1.0, s[1] + moved + (V.OVERRIDE_ENTRENCHMENT if override else 0.0))))
    s[5] += 1


def fold_long(evidence: DataFrame, beliefs: DataFrame, partitions: int | None = None) -> DataFrame:
    """As ``fold``, in constant memory per task: rows sorted by belief and seq pass a running state."""
    rows = evidence.join(beliefs, "belief").select("belief", "seq", "direction", "strength", "source", "override", "confidence", "entrenchment", "dependencies")
    n = partitions or int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, s = None, None
        for b in batches:
            out = []
            for belief, direction, strength, source, override, c0, e0, deps in zip(b.belief, b.direction, b.strength, b.source, b.override, b.confidence, b.entrenchment, b.dependencies, strict=True):
                if belief != name:
                    if s:
                        out.append((name, *s[:4], s[5]))
                    name, s = belief, opened(c0, e0)
                revise(s, direction, strength, source, override, deps)
            if out:
                yield pd.DataFrame(out, columns=["belief", "confidence", "entrenchment", "n_support", "n_challenge", "n_steps"])
        if s:
            yield pd.DataFrame([(name, *s[:4], s[5])], columns=["belief", "confidence", "entrenchment", "n_support", "n_challenge", "n_steps"])

    kind = rows.schema["belief"].dataType.simpleString()
    done = rows.repartition(n, "belief").sortWithinPartitions("belief", "seq").mapInPandas(run, f"belief {kind}, confidence double, entrenchment double, n_support int, n_challenge int, n_steps int")
    rest = beliefs.join(evidence.select("belief").distinct(), "belief", "left_anti").select("belief", F.col("confidence").cast("double"), F.col("entrenchment").cast("double"), F.lit(0).alias("n_support"), F.lit(0).alias("n_challenge"), F.lit(0).alias("n_steps"))
    return done.unionByName(rest)


def linear_fold(evidence: DataFrame, start: float = 0.5) -> DataFrame:
    """The undamped baseline: raw deltas, clamped to 0..1 after each step."""
    signed = F.when(F.col("direction") == "support", 1.0).when(F.col("direction") == "challenge", -1.0).otherwise(0.0) * T.mapped(F.col("strength"), V.EVIDENCE_DELTAS, 0.10)
    steps = evidence.groupBy("belief").agg(F.array_sort(F.collect_list(F.struct("seq", signed.alias("d")))).alias("steps"))
    return steps.select("belief", F.aggregate("steps", F.lit(start), lambda a, x: _r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + x["d"])))).alias("confidence"))
