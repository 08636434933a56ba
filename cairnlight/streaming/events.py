"""Structured Streaming forms of the windowed and stateful operators; each has a batch form with the same results."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight import vocab as V


def source(spark: SparkSession, path: str, schema: Any, per_trigger: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark on ``ts``; watermarks need a zoned timestamp, so one without a zone is read as UTC."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(rows: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; works on a stream (rows later than ``late`` are dropped) and on a table."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = _timed(rows, late)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = _timed(rows, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(rows: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Stream dedup by key within the watermark; state for older keys is let go."""
    return _timed(rows, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def momentum(rows: DataFrame) -> DataFrame:
    """Running counts and date bounds per name, in update mode; order of arrival doesn't matter."""
    n = F.count("*")
    return rows.groupBy("name").agg(n.alias("appearances"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.when(n >= 5, "established").when(n >= 3, "gaining").otherwise("emerging").alias("momentum"))


def confidence(rows: DataFrame, start: float = 0.5) -> DataFrame:
    """Belief confidence as custom state: each batch's evidence of a belief is folded in sequence onto what is kept.

    ``rows``: belief, seq, direction, strength. Entrenchment is held at zero here; the batch fold has both.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        c, ns, nc = state.get if state.exists else (start, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for direction, strength in zip(rows.direction, rows.strength, strict=True):
            if direction not in ("support", "challenge"):
                continue
            up = direction == "support"
            size = round(V.EVIDENCE_DELTAS.get(strength, 0.10) / ((ns if up else nc) + 1) ** 0.5, 4)
            low, high = V.CAPS["decisive" if strength == "decisive" else "soft"]
            c = round(max(low, min(high, max(0.0, min(1.0, c + (size if up else -size))))), 4)
            ns, nc = ns + up, nc + (not up)
        state.update((c, ns, nc))
        yield pd.DataFrame([(key[0], c, ns, nc)], columns=["belief", "confidence", "n_support", "n_challenge"])

    return rows.groupBy("belief").applyInPandasWithState(step, "belief long, confidence double, n_support long, n_challenge long", "c double, ns long, nc long", "update", "NoTimeout")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. Parquet sinks take append mode; others go through foreachBatch."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
