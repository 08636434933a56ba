"""Balanced label propagation into shards (DataFrame operations only).

Documents are linked when they belong to one group; for the query, groups are equal texts. Members of a group in one
shard are alike, so the state is a row per linked group with its members' counts by shard (at most as many entries as
there are shards), whatever the group's size. Each round joins a group's proposal (to move to the shard where most of its
members' neighbours are) with quotas from the shards' room; what is admitted moves. Documents without links then fill the
shards to counts at most one apart. Ranks are two-level prefix sums, so no task sees a whole group or shard.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlight.llm.common import materialize, table

SHARDS, ROUNDS = 40, 4
#: Members of a group fall into SALTS classes; documents without links and linked groups into as many classes as keep
#: about CLASS_ROWS rows in each, and no fewer than CLASSES and GROUP_CLASSES.
SALTS, CLASSES, GROUP_CLASSES, CLASS_ROWS = 256, 1024, 64, 200_000
CELLS = "array<struct<shard:int,c:long>>"


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def _loads(groups: DataFrame, shards: int) -> list[int]:
    """Members by shard: as many numbers as there are shards."""
    found = dict(groups.select(F.explode("cells").alias("x")).groupBy("x.shard").agg(F.sum("x.c")).collect())
    return [found.get(j, 0) for j in range(shards)]


def _offsets(rows: DataFrame, over: str, order: list[str], amount: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` of rows of the same ``over`` that come earlier by class (``order``), then by g.

    Classes are summed first; only the sums (a row per class) meet in one window per ``over``.
    """
    classes = rows.groupBy(over, *order).agg(F.sum(amount).alias("total"))
    earlier = W.partitionBy(over).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    at = classes.withColumn("class_at", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    inner = W.partitionBy(over, *order).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("inner_at", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return ranked.join(at, [over, *order]).withColumn("before", F.col("class_at") + F.col("inner_at")).drop("class_at", "inner_at")


def propagate(groups: DataFrame, capacity: list[int], rounds: int = ROUNDS, classes: int = GROUP_CLASSES) -> DataFrame:
    """Rounds of moves under quotas. ``groups``: g, cells (members by shard). Returns the same columns.

    A group proposes the shard with most of its members among those with room (ties by a hash of both). Quotas admit the
    groups with most members there first; a group may be admitted in part. Every move joins members with neighbours, so
    cut edges only fall.
    """
    shards = len(capacity)
    for r in range(rounds):
        load = _loads(groups, shards)
        room = [max(0, c - x) for c, x in zip(capacity, load, strict=True)]
        rooms = _longs(room)
        open_cells = F.filter("cells", lambda x: F.get(rooms, x["shard"]) > 0)
        best = F.array_max(F.transform(open_cells, lambda x: F.struct(x["c"].alias("c"), F.xxhash64("g", x["shard"]).alias("tie"), x["shard"].alias("shard"))))
        asked = groups.select("g", "cells", best.alias("best")).filter("best IS NOT NULL").select(
            "g", F.col("best.shard").alias("target"), (F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x["c"]) - F.col("best.c")).alias("asks"),
            (-F.floor(F.log2("best.c"))).alias("band"), F.pmod(F.xxhash64("g"), F.lit(classes)).alias("h")).filter("asks > 0")
        admitted = _offsets(asked, "target", ["band", "h"], "asks").select("g", "target", F.least("asks", F.get(rooms, F.col("target")) - F.col("before")).alias("moves")).filter("moves > 0")
        joined = groups.join(admitted, "g", "left")
        start = F.struct(F.col("moves").alias("left"), F.array().cast(CELLS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            take = F.when(x["shard"] == F.col("target"), F.lit(0).cast("long")).otherwise(F.least(acc["left"], x["c"]))
            kept = F.when(x["shard"] == F.col("target"), x["c"] + F.col("moves")).otherwise(x["c"] - take)
            return F.struct((acc["left"] - take).alias("left"), F.concat(acc["out"], F.array(F.struct(x["shard"].alias("shard"), kept.alias("c")))).alias("out"))

        moved = F.filter(F.aggregate("cells", start, step, lambda a: a["out"]), lambda x: x["c"] > 0)
        groups = materialize(joined.select("g", F.when(F.col("moves").isNull(), F.col("cells")).otherwise(moved).alias("cells")), f"shard-round{r}", replaces=[groups])
    return groups


def assign(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shards with counts at most one apart. ``nodes``: id (unique, not null), g (group). Returns id, shard (int), slot (long).

    An optional column ``by`` (long) is hashed and ordered by in place of id: places then don't depend on ids that are
    made up.
    Slots number a shard's rows from 0 without gaps. Rows of one group share a shard as far as quotas allow; a group of
    more than a shard's rows is spread. An empty table gives no rows.
    """
    nodes = nodes.select("id", "g", F.col("by" if "by" in nodes.columns else "id").alias("by"))
    # Members by group and first shard; a hot group is reduced to at most one row per task and shard before it moves.
    first = nodes.groupBy("g", F.pmod(F.xxhash64("by"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("c"))
    groups = first.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "c"))).cast(CELLS).alias("cells"), F.sum("c").alias("n"))
    total = nodes.count()
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    linked = materialize(groups.filter("n > 1").select("g", "cells"), "shard-groups")
    classes = max(GROUP_CLASSES, linked.count() // CLASS_ROWS)
    linked = propagate(linked, capacity, rounds, classes)

    # where each cell starts within its shard; what a shard can't hold goes to the pool
    cells = linked.select("g", F.explode("cells").alias("x")).select("g", "x.shard", "x.c", F.pmod(F.xxhash64("g"), F.lit(classes)).alias("h"))
    placed = _offsets(cells, "shard", ["h"], "c").select("g", "shard", F.col("before").alias("at"), F.greatest(F.lit(0).cast("long"), F.least("c", F.get(_longs(capacity), F.col("shard")) - F.col("before"))).alias("c"))
    plan = materialize(placed.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "at", "c"))).alias("cells")), "shard-plan")
    held = _loads(plan, shards)

    # members of linked groups take their group's cells in order of rank
    members = nodes.join(plan.select("g"), "g", "left_semi").withColumn("salt", F.pmod(F.xxhash64("by", F.lit(7)), F.lit(SALTS)))
    members = members.repartition("g", "salt")  # else rows that a join dealt by g stay so, as that satisfies (g, salt)
    salted = members.groupBy("g", "salt").agg(F.count("*").alias("n"))
    salted = salted.withColumn("from", F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n").join(plan, "g")
    ranked = members.withColumn("r", F.row_number().over(W.partitionBy("g", "salt").orderBy("by", "id")) - 1).join(salted, ["g", "salt"]).withColumn("r", F.col("r") + F.col("from"))
    start = F.struct(F.col("r").alias("left"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))

    def pick(acc: Column, x: Column) -> Column:
        here = acc["shard"].isNull() & (acc["left"] < x["c"])
        return F.struct((acc["left"] - x["c"]).alias("left"), F.when(here, x["shard"]).otherwise(acc["shard"]).alias("shard"), F.when(here, x["at"] + acc["left"]).otherwise(acc["slot"]).alias("slot"))

    taken = materialize(ranked.select("id", "by", F.aggregate("cells", start, pick).alias("p")).select("id", "by", "p.shard", "p.slot"), "shard-linked")

    # the rest fills what is left, by rank over the whole pool
    singles = nodes.join(plan.select("g"), "g", "left_anti").select("id", "by")
    pool = singles.unionAll(taken.filter("shard IS NULL").select("id", "by")).withColumn("h", F.pmod(F.xxhash64("by", F.lit(11)), F.lit(max(CLASSES, total // CLASS_ROWS))))
    starts = pool.groupBy("h").agg(F.count("*").alias("n")).withColumn("from", F.coalesce(F.sum("n").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    room = [c - x for c, x in zip(capacity, held, strict=True)]
    ends = [functools.reduce(operator.add, room[: j + 1]) for j in range(shards)]
    rank = pool.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("by", "id")) - 1).join(starts, "h").select("id", (F.col("r") + F.col("from")).alias("r"))
    shard = F.size(F.filter(_longs(ends), lambda e: e <= F.col("r")))
    base = _longs([h - (e - x) for h, e, x in zip(held, ends, room, strict=True)])  # slots held, less the ranks before the shard
    filled = rank.select("id", shard.cast("int").alias("shard"), (F.col("r") + F.get(base, shard)).cast("long").alias("slot"))
    return taken.filter("shard IS NOT NULL").drop("by").unionByName(filled)


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """Null text: no bytes, CRC 0, in the group of the empty text. Any doc_id may be null or repeated: each row has one place.

    Texts of any length cost their hash alone; an empty table gives no rows; other columns, whatever their names, are not
    read. Which of several rows of one doc_id takes which of their places is not defined.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    row = F.monotonically_increasing_id()
    docs = table(spark, sf_dir, "documents").select(row.alias("id"), "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g"))
    docs = materialize(docs, "shard-docs")
    nodes = docs.select("id", "g", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("id"))).alias("by"))  # nulls are spread
    return docs.join(assign(nodes, shards), "id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE: dict[str, str] = {}
