"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlight.session import discard, materialize, scratch, shared_dir  # noqa: F401  (re-exported)

Part = tuple[pa.RecordBatch, pa.Array]
#: Code points of a piece that long texts are cut into before spans are taken out of them.
PIECE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct ``row``: results stand beside it, so no name of theirs can clash with a column's."""
    return docs.select(F.struct("*").alias("row"))


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores appended until no column has it (case aside, as the engine resolves names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, key: str, text: str, results: str, run: Callable[[Iterator[Part]], Iterator[tuple[pa.RecordBatch, list]]]) -> DataFrame:
    """``key`` with ``results`` (a DDL string) beside it, computed from whole texts in Arrow batches without moving a row.

    To keep whole rows, pass ``packed`` rows with key ``row`` and text ``row.text``: each text then crosses to the worker
    once. No other column is read. ``run`` takes parts (the key's column, texts) and gives (the key's column, result
    arrays). A key with a result's name is refused.
    """
    added = StructType.fromDDL(results)
    if key.lower() in (c.lower() for c in added.names):
        raise ValueError(f"a result has the key's name: {key}")
    field = text.removeprefix(f"{key}.").split(".") if text.startswith(f"{key}.") else None
    source = docs.select(F.col(key).alias("key"), *([] if field else [F.col(text).alias("text")]))
    schema = StructType([source.schema["key"], *added.fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, arrays in run((b.select([0]), pc.struct_field(b.column(0), field) if field else b.column(1)) for b in batches):
            yield pa.RecordBatch.from_arrays([kept.column(0), *arrays], names=schema.names)

    return source.mapInArrow(mapped, schema).withColumnRenamed("key", key)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once: an expression put into a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array<int>, ``op`` (associative, 0 its start) over the elements before it.

    An array grows by copying, so one fold over n elements copies n * n / 2. Here blocks of the cube root of n are folded
    first and then their ends: n ** (4 / 3) in all.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    grown = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def of(v: Column) -> Column:
        n = F.size(v)
        block = F.greatest(F.lit(32), F.ceil(F.cbrt(n)).cast("int"))
        folded = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
            lambda i: F.aggregate(F.sequence(i * block, F.least(n, (i + 1) * block) - 1), start, lambda a, j: grown(a, F.get(v, j))))
        shifted = lambda blocks: lambda ends: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda x: op(F.get(ends, i), x))))
        whole = bound(folded, lambda blocks: bound(F.aggregate(blocks, start, lambda a, b: grown(a, b["at"]))["out"], shifted(blocks)))
        return F.when(n > 0, whole).otherwise(none)

    return bound(values, of)


def located(text: Column, pattern: str, *groups: int) -> Column:
    """Every leftmost, non-overlapping match as array<struct<s, e, t>>; a second group adds ``t2``.

    ``s`` and ``e`` count code points (end exclusive); ``t`` is the first group given, else the match. The engine has no
    function that returns match positions, so the text is cut at the matches and positions are running sums of piece
    lengths. Rows without a match cost one test. Null text gives an empty array.
    """
    names = ["t", "t2"][: max(1, len(groups))]
    kind = f"array<struct<s:int,e:int,{','.join(f'{n}:string' for n in names)}>>"
    taken = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), taken(0).alias("hit"), *(taken(g).alias(f"g{i}") for i, g in enumerate(groups)))
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def one(x: Column, at: Column) -> Column:
        s = at + F.length(x["gap"])
        found = [x[f"g{i}"] for i in range(len(groups))] or [x["hit"]]
        return F.when(x["hit"].isNotNull(), F.struct(s.alias("s"), (s + F.length(x["hit"])).alias("e"), *(t.alias(n) for n, t in zip(names, found, strict=True))))

    whole = bound(zipped, lambda z: F.filter(F.zip_with(z, running(F.transform(z, width), lambda a, b: a + b), one), lambda x: x.isNotNull()))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), whole.cast(kind)).otherwise(F.array().cast(kind))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each span (a struct with s and e, first of all s) replaced by ``mark`` of it.

    Overlapping spans are one, under the mark of the first. What stays is taken from pieces of the text of equal length
    and joined once, so the work is in proportion to text and spans.
    """

    def taken(pieces: Column, a: Column, b: Column) -> Column:
        from_ = lambda i: F.greatest(a - i * PIECE, F.lit(0))
        some = F.transform(F.sequence(F.shiftright(a, 10), F.shiftright(b - 1, 10)), lambda i: F.substring(F.get(pieces, i), from_(i) + 1, F.least(b - i * PIECE, F.lit(PIECE)) - from_(i)))
        return F.when(a < b, F.array_join(some, "")).otherwise(F.lit(""))

    def of(pieces: Column, ordered: Column) -> Column:
        before = running(F.transform(ordered, lambda x: x["e"]), F.greatest)
        fresh_ = F.filter(F.zip_with(ordered, before, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda p: p["x"]["s"] >= p["m"])
        parts = F.transform(fresh_, lambda p: F.concat(taken(pieces, p["m"], p["x"]["s"]), mark(p["x"])))
        return F.concat(F.array_join(parts, ""), taken(pieces, F.array_max(F.transform(ordered, lambda x: x["e"])), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(cut, lambda pieces: bound(F.array_sort(spans), lambda ordered: of(pieces, ordered)))).otherwise(text)


def tagged(spans: Column, kind: str, order: int, keep=None) -> Column:
    """Spans that pass ``keep`` as array<struct<s, k, e, kind, t>>; ``k`` is the kind's place in its list."""
    kept = F.filter(spans, keep) if keep is not None else spans
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["t"].alias("t")))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
