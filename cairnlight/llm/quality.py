"""Quality rules as a bitmask ledger: measure once, keep the bits, then decide and ablate by bit operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import Part, carried, table

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class QualityRule:
    """Fails where ``test`` holds; ``bit`` never changes its meaning, a changed rule takes a new bit."""

    bit: int
    name: str
    test: str


RULES = (
    QualityRule(0, "too_few_words", "n_words < 50"),
    QualityRule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    QualityRule(2, "symbol_heavy", "4 * n_symbols > n_words"),
    QualityRule(3, "duplicate_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    QualityRule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    QualityRule(5, "no_words", "n_words = 0"),
    QualityRule(6, "long_and_repeated", "n_words >= 50 AND 100 * n_repeat_words > 50 * n_words"),
)
BASE = 0b0000011
#: Versioned policies: the bits that reject a document. Later versions are added; none is edited. ``any_length`` doesn't
#: take shortness for a fault: few words reject only where there is none, repetition only where there are fifty.
POLICIES = {"v1": 0b0000011, "v2": 0b0011111, "any_length": 0b1111100}


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one whole text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        size = len(ids)
        if size < 2_000_000:  # the product of three ids fits 64 bits
            key = (code[:-2] * size + code[1:-1]) * size + code[2:]
        else:
            pair = np.unique(code[:-2] * size + code[1:-1], return_inverse=True)[1]
            key = pair * size + code[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = np.zeros(n, bool)
            for k in range(3):
                at[k : n - 2 + k] |= twice
            repeated = int(at.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _measured(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for kept, texts in parts:
        rows = [measure(t.as_py()) for t in texts]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield kept, [pa.array(c, pa.int64()) for c in cols]


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: key, measurements and ``failed`` (long; bit i is set if rule i fails).

    For whole rows pass ``packed`` ones. Repeated and null keys give rows of their own; null, empty and very long texts
    are measured like others; an empty table gives an empty ledger; no other column but the text is read or returned.
    """
    out = carried(docs, key, text, MEASURES, _measured)
    bits: Column = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.test), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failed", bits)


def decide(rows: DataFrame, policy: str = "v2", policies=POLICIES) -> DataFrame:
    """Adds ``kept``: no bit of the policy's mask has failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policies[policy])) == 0)


def ablate(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: rows the rule rejects, and rows only it rejects (kept if the rule were dropped).

    The ledger is folded to one row per distinct mask first; texts are not read again.
    """
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    terms = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for p, m in policies.items() for r in rules if m >> r.bit & 1))).alias("t")
    hit = F.col("failed").bitwiseAND(F.col("t.mask"))
    return masks.select("failed", "n", terms).groupBy("t.policy", "t.rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("t.bit")) != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(hit == F.col("t.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each policy's rules reject, and those that only one rejects, over all documents."""
    return ablate(ledger(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM docs JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR (n_lines > 3 AND 2 * n_dup_lines > n_lines)
    OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))) AS kept
FROM b
"""
ABLATION_SQL = ORACLE_SQL[: ORACLE_SQL.index("b AS (SELECT *")] + """
f AS (SELECT n_words < 50 AS too_few_words, 100 * n_repeat_words > 50 * n_words AS repeated_windows, 4 * n_symbols > n_words AS symbol_heavy,
    n_lines > 3 AND 2 * n_dup_lines > n_lines AS duplicate_lines, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS word_length,
    n_words = 0 AS no_words, n_words >= 50 AND 100 * n_repeat_words > 50 * n_words AS long_and_repeated FROM m),
t AS (""" + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{r.name}' AS rule, {r.name} AS hit, ({' OR '.join(x.name for x in RULES if mask >> x.bit & 1 and x is not r)}) AS other FROM f"
    for p, mask in POLICIES.items() for r in RULES if mask >> r.bit & 1) + """)
SELECT policy, rule, count(*) FILTER (hit) AS n_rejected, count(*) FILTER (hit AND NOT other) AS n_only FROM t GROUP BY policy, rule
"""
QUERIES = {"op10_quality_rules": op10_quality_rules, "quality_ablation": quality_ablation}
ORACLE = {"op10_quality_rules": ORACLE_SQL, "quality_ablation": ABLATION_SQL}
