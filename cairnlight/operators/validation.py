"""Record validation, referential integrity and zero-filled counts."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """(key, path, message): all broken rules of all rows in one pass; a rule that is null isn't broken."""
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, bad, m in rules))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(key, "i.path", "i.message")


def foreign_keys(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(path, id) of distinct references without a target. Each check: path, rows, column (or array), targets, key."""
    parts = []
    for path, rows, column, targets, key in checks:
        many = rows.schema[column].dataType.typeName() == "array"
        ids = rows.select((F.explode(column) if many else F.col(column)).alias("id")).filter(F.col("id").isNotNull()).distinct()
        parts.append(ids.join(targets.select(F.col(key).alias("id")), "id", "left_anti").select(F.lit(path).alias("path"), "id"))
    return functools.reduce(DataFrame.unionAll, parts)


def zero_filled(counts: DataFrame, vocabulary: Mapping[str, Sequence[str]], n: str = "n") -> DataFrame:
    """Counts over the whole vocabulary, with 0 where nothing was counted."""
    names = list(vocabulary)
    cells = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, c, strict=True))) for c in itertools.product(*vocabulary.values())))
    full = counts.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    return full.join(counts, names, "left").na.fill(0, [n])


def bad_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """(path, line, value) of lines that aren't JSON objects; ``raw``: path, line, value. Blank lines are fine."""
    kept = F.trim(value) != ""
    return raw.filter(kept & F.coalesce(F.try_parse_json(value).isNull(), F.lit(True))).select("path", "line", value)
