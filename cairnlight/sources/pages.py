"""Paged range fetch of works as a data source: each page of a table in a folder is a partition.

A query asks for works of a range of days, a page of rows at a time, as registries serve them. Pages are cut while the
read is planned, from the counts that file statistics and one filtered count per row group give; a task opens only the row
groups its page lies in. A filter on the date column narrows the range before pages are cut.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

ROWS = 200


@dataclass
class Page(InputPartition):
    """Rows ``skip`` to ``skip + take`` of the works in range in some row groups, each (file, row group)."""

    groups: list[tuple[str, int]]
    skip: int
    take: int
    column: str

    def __post_init__(self) -> None:
        super().__init__(0)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (a local path without a scheme)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _table(path: str) -> ds.Dataset:
    system, at = _located(path)
    return ds.dataset(at, filesystem=system, format="parquet")


def _day(value) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


class WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.date, self.fallback = options["path"], options["date"], options.get("fallback", "")
        self.rows, self.pages = int(options.get("rows", ROWS)), int(options.get("pages", 0))
        self.start = _day(options["start"]) if options.get("start") else dt.date.min
        self.end = _day(options["end"]) if options.get("end") else dt.date.max
        self.names = schema.names
        if self.rows < 1:
            raise ValueError("a page has one row at least")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the date narrow the range; the engine keeps all filters too, as bounds count whole days here. Works
        found by the fallback date are another column's, so then nothing is taken."""
        for f in filters:
            if not self.fallback and getattr(f, "attribute", None) == (self.date,) and isinstance(getattr(f, "value", None), dt.date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, _day(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(self.end, _day(f.value))
            yield f

    def _within(self, column: str, kind: pa.DataType) -> ds.Expression:
        low, high = dt.datetime.combine(self.start, dt.time.min), dt.datetime.combine(self.end, dt.time.max)
        if pa.types.is_string(kind):
            return (pc.field(column) >= self.start.isoformat()) & (pc.field(column) <= self.end.isoformat() + "T99")
        if pa.types.is_date(kind):
            return (pc.field(column) >= self.start) & (pc.field(column) <= self.end)
        return (pc.field(column) >= pa.scalar(low, kind)) & (pc.field(column) <= pa.scalar(high, kind))

    def _cut(self, data: ds.Dataset, column: str) -> list[Page]:
        keep = self._within(column, data.schema.field(column).type)
        out: list[Page] = []
        groups: list[tuple[str, int]] = []
        skip, held = 0, 0
        for fragment in data.get_fragments(filter=keep):
            for part in fragment.split_by_row_group(keep):
                left = part.count_rows(filter=keep)
                if not left:
                    continue
                at, first = (part.path, part.row_groups[0].id), 0
                while left:
                    if not groups:
                        skip = first
                    took = min(left, self.rows - held)
                    groups.append(at)
                    held, left, first = held + took, left - took, first + took
                    if held == self.rows:
                        out.append(Page(groups, skip, held, column))
                        groups, held = [], 0
                        if self.pages and len(out) == self.pages:
                            return out
        if held:
            out.append(Page(groups, skip, held, column))
        return out

    def partitions(self) -> list[Page]:
        data = _table(self.path)
        if self.start > self.end:
            return [Page([], 0, 0, self.date)]
        found = self._cut(data, self.date)
        if not found and self.fallback:  # some publishers have no day of publication
            found = self._cut(data, self.fallback)
        return found or [Page([], 0, 0, self.date)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        skip, left = partition.skip, partition.take
        for path, group in partition.groups:
            file = ds.ParquetFileFormat().make_fragment(path, _located(self.path)[0], row_groups=[group])
            schema = file.physical_schema
            keep = self._within(partition.column, schema.field(partition.column).type)
            for batch in file.to_batches(schema=schema, columns=self.names, filter=keep):
                own = batch.slice(skip, left)
                skip = max(0, skip - batch.num_rows)
                left -= own.num_rows
                if own.num_rows:
                    yield own
                if not left:
                    return


class WorksSource(DataSource):
    """Options: path (a table of Parquet files that all executors see), date, fallback (another date column, asked for where
    the first finds nothing), start, end (days, inclusive), rows (of a page) and pages (at most; 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "paged_works"

    def schema(self) -> StructType:
        return from_arrow_schema(_table(self.options["path"]).schema)

    def reader(self, schema: StructType) -> WorksReader:
        return WorksReader(dict(self.options), schema)


def fetch_range(spark: SparkSession, path: str, date: str, start: str, end: str, fallback: str = "", rows: int = ROWS, pages: int = 0) -> DataFrame:
    """Works of a range of days, a page a partition; filters on the date narrow what is paged."""
    spark.dataSource.register(WorksSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "date": date, "start": start, "end": end, "fallback": fallback, "rows": str(rows), "pages": str(pages)}
    return spark.read.format("paged_works").options(**options).load()


def first_by_key(works: DataFrame, key: str, order: str) -> DataFrame:
    """The first work of each key, in ``order``; works without a key go. Combines on the map side."""
    rest = [c for c in works.columns if c != key]
    kept = works.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")
