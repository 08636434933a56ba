"""Blind review packets: feedback, progress and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE_FIELDS = ("item_id", "belief_id", "belief", "title", "abstract", "doi", "journal", "pub_date")


def safe_items(items: DataFrame) -> DataFrame:
    """Only what a blind reviewer may see, of items with an id, a belief and a title."""
    return items.filter("item_id IS NOT NULL AND coalesce(belief, '') <> '' AND coalesce(title, '') <> ''").select(*(c for c in SAFE_FIELDS if c in items.columns))


def settle_feedback(rows: DataFrame, keys: list[str], payload: str, order: str) -> DataFrame:
    """First answer wins. Later equal ones are duplicates, different ones conflicts; neither overwrites."""
    first = rows.groupBy(*keys).agg(F.min_by(payload, order).alias("stored"), F.count("*").alias("n"), F.count_distinct(payload).alias("n_payloads"))
    joined = rows.join(first.select(*keys, "stored"), keys)
    counts = joined.groupBy(*keys).agg(F.count_if(F.col(payload) == F.col("stored")).alias("same"))
    return first.join(counts, keys).select(*keys, "stored", (F.col("same") - 1).alias("duplicates"), (F.col("n") - F.col("same")).alias("conflicts"))


def resume(order: DataFrame, done: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each reviewer's next item: the first open one at or after the cursor, going round.

    ``order``: reviewer_id, item_id, presentation_index; ``done``: reviewer_id, item_id; ``cursors``: reviewer_id, seq,
    item_id, of which the last in the packet counts (none: start at 0).
    """
    size = order.groupBy("reviewer_id").agg(F.count("*").alias("size"))
    at = cursors.join(order, ["reviewer_id", "item_id"]).groupBy("reviewer_id").agg(F.max_by("presentation_index", "seq").alias("cursor"))
    left = order.join(done.select("reviewer_id", "item_id").distinct(), ["reviewer_id", "item_id"], "left_anti")
    steps = left.join(size, "reviewer_id").join(at, "reviewer_id", "left").withColumn("steps", (F.col("presentation_index") - F.coalesce("cursor", F.lit(0)) + F.col("size")) % F.col("size"))
    return steps.groupBy("reviewer_id").agg(F.min_by("item_id", "steps").alias("next_item"), F.count("*").alias("n_open"))


def eligible(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows whose own flag and whose reviewer's policy both allow them; unknown means allowed."""
    return rows.join(policy.select("reviewer_id", F.col("eligible").alias("_p")), "reviewer_id", "left").filter(F.coalesce("eligible", F.lit(True)) & F.coalesce("_p", F.lit(True))).drop("_p")
