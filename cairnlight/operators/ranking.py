"""Top-k per group, quotas, diversified queues, pages and shuffled presentation orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Mapping[str, int], default: int = 0) -> DataFrame:
    """The first rows of each group. The planner turns ``row_number() <= k`` into a limit per group before the shuffle.

    ``k`` may give a limit for each value of the first column of ``by``; other values take ``default``.
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    if isinstance(k, int):
        return ranked.filter(F.col("rank") <= k)
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in k.items() for x in kv)), F.col(by[0])), F.lit(default))
    return ranked.filter(F.col("rank") <= max([default, *k.values()])).filter(F.col("rank") <= limit)


def round_robin(df: DataFrame, bucket: str, priority: Column, tie: Column, k: int, deferred: Sequence[str] = ()) -> DataFrame:
    """A queue that draws one row per bucket and round, buckets in order of their best row; deferred buckets come last.

    Only the first k rows of each bucket can be drawn, so those are all that is ranked across buckets.
    """
    inner = W.partitionBy(bucket).orderBy(priority.desc(), tie.asc())
    rows = df.withColumn("_p", priority).withColumn("_t", tie).withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= k)
    best = rows.filter("_rn = 1").select(F.col(bucket).alias("_b"), F.col("_p").alias("_bp"), F.col("_t").alias("_bt"))
    late = F.col(bucket).isin(*deferred) if deferred else F.lit(False)
    rows = rows.join(best, F.col(bucket).eqNullSafe(F.col("_b"))).withColumn("_late", late)
    order = [F.col("_late").asc(), F.col("_rn").asc(), F.col("_bp").desc(), F.col("_bt").asc()]
    return rows.orderBy(*order).limit(k).withColumn("queue_rank", F.row_number().over(W.orderBy(*order))).drop("_p", "_t", "_rn", "_b", "_bp", "_bt", "_late")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


#: Parts that a packet's items are dealt in, each of which meets every reviewer once.
PACKET_PARTS = 64
#: Rows of the product that a task is meant to sort, and items of a packet that is broadcast at most.
PACKET_ROOM, PACKET_SENT = 1 << 20, 100_000


def presentation_order(items: DataFrame, reviewers: DataFrame, packet: str, parts: int = PACKET_PARTS) -> DataFrame:
    """Per reviewer a fixed shuffle of a packet's items by a hash of packet, reviewer and item.

    Every reviewer gets every item, so the result is their product. It is made by an equal join on the part of an item:
    reviewers are repeated once a part, and a task holds one part's items for the reviewers it has. Reviewers are dealt to
    as many tasks as the product needs, before it is made where the packet is broadcast, after it otherwise: their ids alone
    are small, and would be put together by their own size. Packets of any size; a repeated item is shown as often. Null
    ids hash as if they weren't there, as ``concat_ws`` skips them.
    """
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")
    dealt, n_items = items.select("item_id", part.alias("_part")), items.count()
    tasks, sent = max(1, -(-reviewers.count() * n_items // PACKET_ROOM)), n_items <= PACKET_SENT
    met = (reviewers.repartition(tasks, "reviewer_id") if sent else reviewers).select("reviewer_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    met = met.join(F.broadcast(dealt), "_part") if sent else met.join(dealt, "_part").repartition(tasks, "reviewer_id")
    hashed = F.sha2(F.concat_ws("|", F.lit(packet), "reviewer_id", F.col("item_id").cast("string")), 256)
    order = W.partitionBy("reviewer_id").orderBy(hashed, "item_id")
    return met.select("reviewer_id", "item_id", (F.row_number().over(order) - 1).alias("presentation_index"))
