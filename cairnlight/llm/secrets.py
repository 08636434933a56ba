"""Secret scans through an incremental, content-addressed blob ledger (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import count_kind, located, materialize, rendered, table, tagged


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; those whose group ``group`` is shorter than ``least`` code points are dropped."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 1


# The possessive or bounded forms below match what the plain forms match: a run shorter than the bound fails at each of
# its positions, and a later start within a run is shorter still.
RULES = (
    Rule("assign", "1", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "1", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "1", r"[0-9a-f]{32,}", 0, 32),
)
FINDING = "array<struct<s:int,k:int,e:int,kind:string,t:string>>"


def _findings(text: Column, rule: Rule, order: int) -> Column:
    return tagged(located(text, rule.pattern, *([rule.group] if rule.group else [])), rule.kind, order, lambda x: F.length(x["t"]) >= rule.least)


def scan(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Scan each unseen pair of a blob and a rule version once; return the ledger rows that are new.

    ``versions`` has ``text`` (every historical version of every path, repeated or not). ``ledger`` has rows of earlier
    calls: blob, rule (kind@version), findings. Returned rows have the same columns, one per pair scanned now; pairs
    without findings are recorded too, so they are never scanned again. Null text counts as the empty blob. An empty
    table gives an empty ledger. A blob with a hot text is reduced to one row per task before it moves.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    seen = F.array().cast("array<string>")
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs, seen = blobs.join(known, "blob", "left"), F.coalesce(F.col("seen"), seen)
    names = [f"{r.kind}@{r.version}" for r in rules]
    pairs = [
        F.when(~F.array_contains(seen, n), F.struct(F.lit(n).alias("rule"), _findings(F.col("text"), r, i).cast(FINDING).alias("findings")))
        for i, (n, r) in enumerate(zip(names, rules, strict=True))
    ]
    fresh = blobs.select("blob", F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p"))
    return fresh.select("blob", "p.rule", "p.findings")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Join findings of the given rule versions back to every path that ever held the blob.

    Returns path and ``spans`` (sorted by start, then the rule's place; empty where nothing was found). Only blobs with
    findings take part in the join, at one row each; the side of the paths carries no text.
    """
    names = [f"{r.kind}@{r.version}" for r in rules]
    found = ledger.filter(F.col("rule").isin(names) & (F.size("findings") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("spans"))
    found = materialize(found, "secret-blobs")  # a stage of its own: adaptive execution then splits a blob of many paths in the join
    paths = versions.select("path", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    return paths.join(found, "blob", "left").select("path", F.coalesce(F.col("spans"), F.array().cast(FINDING)).alias("spans"))


def update(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after a call: earlier rows, and those of the pairs that only this call has seen, written once.

    A later call passes it as ``ledger`` and scans nothing that is in it. Earlier rows are read, not written again.
    """
    new = materialize(scan(versions, rules, ledger), "secret-ledger")
    return new if ledger is None else ledger.unionByName(new)


def stored(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """The ledger kept as Parquet under ``path`` (made if there is none), after this call, and the rows that are new in it.

    What the ledger holds isn't scanned or written again; a call that fails leaves it as it was.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    new = materialize(scan(versions, rules, ledger), "secret-ledger")
    new.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path), new


def op8_secret_scan(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Findings of every path. Only blobs that the ledger in the folder ``ledger`` doesn't know are scanned, and it is there
    for the next run; without a folder all blobs are new and nothing is kept.

    Null and repeated doc_ids are paths of their own; null and empty texts are the empty blob; very long texts are scanned
    whole; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    spans = F.col("spans")
    return findings_by_path(versions, update(versions) if ledger is None else stored(versions, ledger)[0]).select(
        F.col("path").alias("doc_id"),
        count_kind(spans, "assign").alias("n_assign"),
        count_kind(spans, "access").alias("n_access"),
        count_kind(spans, "hex").alias("n_hex"),
        F.sha2(rendered(spans), 256).alias("base_sha256"),
        rendered(spans).alias("spans"),
    )


def _sql_spans(kind: str, order: int, pattern: str, group: int, keep: str) -> str:
    return f"""
  SELECT doc_id, {order} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, i, h[i] AS m, g[i] AS t,
           list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, h, g, p, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS h, regexp_extract_all(text, '{pattern}', {group}) AS g,
             string_split_regex(text, '{pattern}') AS p FROM docs WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_sql_spans("assign", 0, _ASSIGN, 2, "length(t) >= 8")}
  UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, "length(t) >= 16")}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]{32,}", 0, "true")}),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (doc_id)
"""
QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE = {"op8_secret_scan": ORACLE_SQL}
