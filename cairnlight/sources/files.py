"""Readers and writers: JSONL ledgers with numbered errors, CSV manifests, Markdown, file registries, feeds, works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlight.functions import text as T
from cairnlight.operators import validation as Y

WORK = "DOI string, title array<string>, abstract string, `container-title` array<string>, author array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>, link array<struct<URL:string,`content-type`:string>>"
ENTRY = "title string, link string, summary string, published string, authors array<struct<name:string>>, media_content array<struct<url:string>>, enclosures array<struct<href:string,url:string>>"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, lenient: bool = False) -> DataFrame:
    """Records of a ledger; ``lenient`` drops lines that don't parse, else they stay in _corrupt_record."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "PERMISSIVE")
    return reader.json(path)


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of bad lines. A file's line numbers need its lines together, so files are read whole, one per row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)
    return Y.bad_lines(rows)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """A CSV with header, whose columns go by alternative names; a byte order mark is dropped, absent columns are ''."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    have = set(raw.columns)
    return raw.select(*(F.coalesce(*(T.filled(F.col(f"`{a}`")) for a in names if a in have), F.lit("")).alias(n) for n, names in columns.items()))


def merge_sources(rows: DataFrame, key: str, joined: Sequence[str] = (), order: str = "pos") -> DataFrame:
    """One row per key: the first non-empty value of each column; ``joined`` columns keep all unique values, ' | ' between."""
    aggregates = []
    for c in rows.columns:
        if c in (key, order):
            continue
        values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(c).alias("v")))), lambda x: x["v"])
        pieces = F.filter(values, lambda v: T.blank(v) != "")
        aggregates.append((F.array_join(F.array_distinct(F.flatten(F.transform(pieces, lambda v: F.split(v, r" \| ")))), " | ") if c in joined else F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))).alias(c))
    return rows.groupBy(key).agg(*aggregates)


def parse_works(rows: DataFrame, value: Column) -> DataFrame:
    """Paper rows of a registry's JSON works: print, else online, else creation date; the first image link."""
    w = rows.select(F.from_json(value, WORK).alias("w")).select("w.*")
    date = F.coalesce(*(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)) for c in ("published-print", "published-online", "created")))
    name = lambda a: F.trim(F.concat_ws(" ", T.blank(a["given"]), T.blank(a["family"])))
    image = F.get(F.filter("link", lambda x: F.startswith(x["content-type"], F.lit("image"))), F.lit(0))
    return w.select(
        T.blank(F.col("DOI")).alias("doi"), T.blank(F.get("title", F.lit(0))).alias("title"), T.blank(F.col("abstract")).alias("abstract"), T.blank(F.get("container-title", F.lit(0))).alias("journal"),
        F.filter(F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>")), name), lambda n: n != "").alias("authors"),
        F.array_distinct(F.flatten(F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>")), lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda x: x["name"])))).alias("affiliations"),
        F.coalesce(T.iso_date(date), F.lit("")).alias("pub_date"), F.coalesce(image["URL"], F.lit("")).alias("toc_image_url"))


def parse_feed(rows: DataFrame, value: Column) -> DataFrame:
    """Paper rows of feed entries given as JSON; the DOI comes from the link."""
    e = rows.select(F.from_json(value, ENTRY).alias("e")).select("e.*")
    image = F.coalesce(F.get("media_content", F.lit(0))["url"], F.get("enclosures", F.lit(0))["href"], F.get("enclosures", F.lit(0))["url"], F.lit(""))
    return e.select(T.doi_of(F.col("link")).alias("doi"), T.blank(F.col("title")).alias("title"), T.clean(F.col("summary")).alias("abstract"), F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("authors"), T.blank(F.col("published")).alias("pub_date"), image.alias("toc_image_url"))


def article_url(doi: Column) -> Column:
    return F.when(F.startswith(doi, F.lit("10.1038/")), F.concat(F.lit("https://www.nature.com/articles/"), F.substring_index(doi, "/", -1))).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def walk(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """File names and sizes of a tree; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def registry(files: DataFrame, project: DataFrame, private: Sequence[str]) -> DataFrame:
    """Files outside the project that share name and size with one inside; private paths are excluded and marked."""
    key = lambda: F.concat(F.lower(F.substring_index("path", "/", -1)), F.lit("::"), F.col("length").cast("string"))
    known = project.select(key().alias("k")).distinct().withColumn("_in", F.lit(True))
    rows = files.withColumn("k", key()).join(known, "k", "left")
    secret = T.contains_any(F.lower("path"), private) if private else F.lit(False)
    return rows.select("path", "length", "k", F.when(secret, "excluded_private").when(F.col("_in"), "included").otherwise("excluded_unmatched").alias("action"))


def write_digest(rows: DataFrame, path: str) -> None:
    """One text per row, column ``text``."""
    rows.select("text").write.mode("overwrite").text(path)
