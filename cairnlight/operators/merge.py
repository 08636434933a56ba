"""Keyed state: first-seen dedup, anti-joins, upserts. Every order is an explicit column; "now" is a parameter.

Latest- and first-wins merges use max_by / min_by aggregates, which combine on the map side, instead of windows that would
bring all versions of a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, but: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in but]


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must not tie."""
    rest = _row(df, keys)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = _row(df, keys)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def new_rows(fetched: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows whose key is not stored yet."""
    return fetched.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def upsert(stored: DataFrame, changes: DataFrame, key: str, keep_status: Sequence[str] = (), status: str = "status") -> DataFrame:
    """Changes overwrite stored rows of the same key; a stored status in ``keep_status`` stays. One row per key in each."""
    s, c = stored.alias("s"), changes.alias("c")
    out = []
    for name in stored.columns:
        new = F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{name}")).otherwise(F.col(f"s.{name}"))
        if name == key:
            new = F.coalesce(F.col(f"s.{key}"), F.col(f"c.{key}"))
        elif name == status and keep_status:
            new = F.when(F.col(f"s.{status}").isin(*keep_status), F.col(f"s.{status}")).otherwise(new)
        out.append(new.alias(name))
    return s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full").select(*out)


def partial_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only the fields given (not null) change; changes of unknown keys are dropped."""
    s, c = stored.alias("s"), changes.alias("c")
    return s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "left").select(*(F.coalesce(F.col(f"c.{n}"), F.col(f"s.{n}")).alias(n) if n in changes.columns and n != key else F.col(f"s.{n}").alias(n) for n in stored.columns))


def fill_missing(stored: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Values are taken only where the stored one is null or empty."""
    f = found.select(key, F.col(column).alias("_found"))
    return stored.join(f, key, "left").withColumn(column, F.coalesce(F.when(F.col(column) != "", F.col(column)), F.col("_found"), F.col(column))).drop("_found").select(*stored.columns)


def concept_momentum(events: DataFrame) -> DataFrame:
    """Events (name, source, seen, seq, note) to one row per lower-cased name: count, first and last date, state, texts.

    The first event's source stays, the last non-empty note wins; five appearances are established, three are gaining.
    """
    name = F.lower(F.trim("name"))
    note = F.when(F.col("note") != "", F.col("seq"))
    out = events.groupBy(name.alias("name")).agg(
        F.count("*").alias("appearances"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.min_by("source", "seq").alias("source"), F.max_by("note", note).alias("note"))
    return out.withColumn("momentum", F.when(F.col("appearances") >= 5, "established").when(F.col("appearances") >= 3, "gaining").otherwise("emerging"))


def merge_momentum(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds a batch's counts to stored ones; dates widen; both have the columns of ``concept_momentum``."""
    n = F.sum("appearances")
    both = stored.select("*", F.lit(0).alias("gen")).unionByName(batch.select("*", F.lit(1).alias("gen")))
    return both.groupBy("name").agg(n.alias("appearances"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("source", "gen").alias("source"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("gen"))).alias("note"),
                                    F.when(n >= 5, "established").when(n >= 3, "gaining").otherwise("emerging").alias("momentum"))


def revise(objects: DataFrame, actions: DataFrame, table: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Applies actions (key, action, seq) to objects (key, status, confidence, entrenchment).

    Status is the last action's; deltas add up; both numbers are clamped to 0..10 and rounded at the end. Unknown actions
    do nothing.
    """
    pick = lambda i, kind: F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]).cast(kind)))), F.col("action"))
    known = actions.filter(F.col("action").isin(*table))
    change = known.groupBy("key").agg(F.max_by(pick(0, "string"), "seq").alias("_status"), F.sum(pick(1, "double")).alias("_c"), F.sum(pick(2, "double")).alias("_e"))
    bound = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), c)), 2)
    return objects.join(change, "key", "left").select("key", F.coalesce("_status", "status").alias("status"), bound(F.col("confidence") + F.coalesce("_c", F.lit(0.0))).alias("confidence"), bound(F.col("entrenchment") + F.coalesce("_e", F.lit(0.0))).alias("entrenchment"))


def contract(justifications: DataFrame, by: Sequence[str] = ("concept",)) -> DataFrame:
    """Withdraws each concept's weakest justification (Low before Medium before High, then the oldest)."""
    rank = F.when(F.col("strength") == "High", 3).when(F.col("strength") == "Medium", 2).otherwise(1)
    gone = justifications.groupBy(*by).agg(F.min_by("id", F.struct(rank.alias("r"), F.col("id"))).alias("id")).select("id")
    return justifications.join(gone, "id", "left_anti")
