"""Report text: state logs, fact checks, back-references, exports, graphs and stories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T


def state_log(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One Markdown block per event: a heading with its id, a line per non-empty column. ``events`` has id."""
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("id").cast("string")), *(F.when(T.blank(F.col(c).cast("string")) != "", F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in columns))
    return events.select("id", body.alias("text"))


def fact_checks(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, code, title, claim, status) of '## A.n - title' blocks with 'Claim:' and 'Status:' lines."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), T.blank(text)), r"\n(?=## [A-Z]\.\d+)"), lambda b: b.rlike(r"^## [A-Z]\.\d+"))
    b = F.col("b")
    field = lambda name: F.trim(F.regexp_extract(b, rf"(?im)^[-*\s]*\**{name}:?\**:?[ \t]*(.+)$", 1))
    status = F.lower(field("Status"))
    return rows.select(key, F.explode(blocks).alias("b")).select(
        key, F.regexp_extract(b, r"^## ([A-Z]\.\d+)", 1).alias("code"), F.trim(F.regexp_extract(b, r"^## [A-Z]\.\d+\s*[-–—]\s*(.*)", 1)).alias("title"), field("Claim").alias("claim"),
        F.when(status.rlike("unsupported|false|rejected|wrong"), "rejected").when(status.rlike("partial|unclear|needs"), "requires_verification").when(status.rlike("supported|true|confirmed"), "approved").otherwise("candidate").alias("status"))


def back_references(lines: DataFrame, first: int = 30) -> DataFrame:
    """(name, pages): pages whose head names a source file. ``lines``: path, line, value."""
    name = F.lower(F.trim(F.regexp_extract("value", r"^\s*source_file:\s*[\"']?([^\"'\n]+)", 1)))
    return lines.filter(F.col("line") < first).select("path", F.substring_index(name, "/", -1).alias("name")).filter("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("pages"))


def export_json(rows: DataFrame, by: str) -> DataFrame:
    """One JSON document per value of ``by``, records in order; documents are per value, not one for the whole table."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("json"))


def chain_edges(rows: DataFrame, key: str, nodes: Column) -> DataFrame:
    """(key, a, b) of neighbours in each row's node list, equal neighbours dropped."""
    pairs = F.filter(F.arrays_zip(F.slice(nodes, F.lit(1), F.greatest(F.lit(0), F.size(nodes) - 1)).alias("a"), F.slice(nodes, F.lit(2), F.greatest(F.lit(0), F.size(nodes) - 1)).alias("b")), lambda p: p["a"] != p["b"])
    return rows.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", "p.a", "p.b")


def newest_mention(mentions: DataFrame, key: str, date: str) -> DataFrame:
    return mentions.groupBy(key).agg(F.max(date).alias(date))


def linked(links: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Links with an end among the keys (``key``): two equi-joins in place of one join on OR, each link once.

    Without ``targets`` both ends are looked up among ``sources``.
    """
    a = sources.select(F.col("key").alias("source")).distinct()
    b = (sources if targets is None else targets).select(F.col("key").alias("target")).distinct()
    return links.join(a, "source", "left_semi").unionByName(links.join(b, "target", "left_semi").join(a, "source", "left_anti"))


def year_chunks(first: Column, last: Column) -> Column:
    """The calendar years of a range of dates, each cut to the range: array<struct<chunk_year, chunk_start, chunk_end>>."""
    starts = F.sequence(F.trunc(first, "year"), F.trunc(last, "year"), F.expr("interval 1 year"))
    return F.transform(starts, lambda s: F.struct(F.year(s).cast("long").alias("chunk_year"), F.greatest(first, s).alias("chunk_start"), F.least(last, F.date_sub(F.add_months(s, 12), 1)).alias("chunk_end")))
