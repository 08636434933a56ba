"""Documents to training text in five stages; each stage's rows are written as Parquet and read again by the next.

Quality rules drop documents that the current policy rejects; SimHash near-dedup keeps the least doc_id of each group;
decontamination cuts the words of benchmark passages out of texts (a text left empty drops its document); PII replaces
found spans by their kind; SentencePiece encoding adds the ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm import decontaminate, pieces, pii, quality, simhash
from cairnlight.llm.common import discard, fresh, materialize, packed, replaced, scratch, table


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with an n_chars to match their new texts, where ``docs`` have one."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the policy keeps; whole rows pass through the rules, so nothing is joined or moved.

    The policy is for documents of any length: shortness alone rejects none that has a word.
    """
    rows = quality.ledger(packed(docs), "row", "row.text")
    return quality.decide(rows, "any_length").filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles alike to 0.8) stays, that of least doc_id (null ones last)."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages go, with the marks between them; documents left without a word go too."""
    found = decontaminate.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"), "row", "row.text")
    cut = replaced(F.col("row.text"), F.col("spans"), lambda x: F.lit(""))
    return _with_text(docs, found.filter("n_hit = 0 OR n_hit < n_words").select(F.col("row").withField("text", cut).alias("row")).select("row.*"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span becomes <KIND>; only texts that context could add a span to move."""
    return _with_text(docs, pii.redact_all(docs))


#: Code points of words that a worker keeps while it runs a task of the last stage.
KEPT_CHARS = 1_500_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = pieces.MODEL) -> DataFrame:
    """The columns of documents, n_ids, ids and exact (decoding the ids gives the text again).

    Where documents have a column of one of these names, underscores are appended to the result's.
    """
    rows = pieces.encode(packed(docs), pieces.load(model), "row", "row.text", KEPT_CHARS, True)
    added = {"n_ids": F.size("ids").cast("long"), "ids": F.col("ids"), "exact": F.col("exact")}
    return rows.select("row.*", *(c.alias(fresh(docs.columns, name)) for name, c in added.items()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]
#: SQL can't express fingerprint components or encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's rows stay in the shared folder until the next stage's are written, and what a
    stage wrote on its way goes with it; the last stage reads what the one before left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            done, docs = docs, keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(spark, *([done.written_to] if hasattr(done, "written_to") else []))
    return STAGES[-1][1](spark, docs, sf_dir)
