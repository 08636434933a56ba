"""Language identification with string kernels: presence of character n-grams, Nystrom landmarks, kernel ridge regression.

The blended spectrum kernel of two texts counts the n-grams (one to three characters) that both hold, over the root of
the product of their own counts. Landmarks are a bounded sample; each language has one one-versus-rest ridge regression
on the Nystrom features. As the kernel is a dot product of presence vectors, a batch's scores are one product of its
presence matrix with the landmarks' and one with their weights; both are folded beforehand into one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlight.llm.common import table

#: Bounds of the fit: labelled rows and landmarks per language, code points of a training text (a part of a longer one) and
#: of all, landmarks in all (one a language at least); ridge.
TRAIN_PER_LANG, LANDMARKS_PER_LANG, TRAIN_CHARS, TOTAL_CHARS, LANDMARKS, RIDGE = 300, 48, 16_384, 64 << 20, 8192, 1e-2
BATCH = 64
#: Languages whose shares are broadcast; the shares of more are joined.
BROADCAST_LANGS = 50_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def presence(text: str | None) -> np.ndarray | None:
    """The distinct n-grams of a whole text, sorted; None for null or a text without letters. Case and non-letters are folded.

    An n-gram is its code points side by side, 21 bits each; none is zero, so those of different lengths differ.
    """
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[cp]
    if not alpha.any():
        return None
    cp = np.where(alpha, cp, 32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)  # one blank for a run of non-letters
    c = np.concatenate([[32], cp[keep], [32]]).astype(np.uint64)
    bits = np.uint64(21)
    two = (c[:-1] << bits) | c[1:]
    three = (two[:-1] << bits) | c[2:]
    return np.unique(np.concatenate([c, two, three]))


def held(grams: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which of ``columns`` (sorted, not empty) the text has, as places."""
    at = np.searchsorted(columns, grams)
    at[at == len(columns)] = 0
    return at[columns[at] == grams]


def _matrix(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)), np.float32)
    for i, grams in enumerate(rows):
        out[i, held(grams, columns)] = 1
    return out


@dataclass(frozen=True)
class Model:
    """``weights`` has a column per language; ``columns`` are the n-grams that landmarks hold."""

    langs: tuple[str, ...]
    columns: np.ndarray
    weights: np.ndarray


def fit(texts: list[str], langs: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """Ridge regression on Nystrom features of a bounded sample; the first rows of each language are its landmarks."""
    rows = [(p, y) for p, y in ((presence(t), y) for t, y in zip(texts, langs, strict=True)) if p is not None]
    names = tuple(sorted({y for _, y in rows}))
    landmarks_per_lang = max(1, min(landmarks_per_lang, LANDMARKS // max(1, len(names))))
    if not rows:
        return Model((), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    marks, taken = [], dict.fromkeys(names, 0)
    for p, y in rows:
        if taken[y] < landmarks_per_lang:
            taken[y] += 1
            marks.append(p)
    columns = np.unique(np.concatenate(marks))
    unit = _matrix(marks, columns) / np.sqrt([len(p) for p in marks])[:, None]
    kernel = np.concatenate([_matrix([p for p, _ in rows[at : at + BATCH]], columns) @ unit.T for at in range(0, len(rows), BATCH)])
    kernel /= np.sqrt([len(p) for p, _ in rows])[:, None]
    values, vectors = np.linalg.eigh(unit @ unit.T)
    good = values > 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ root
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in rows])
    share = np.array([sum(lang == n for _, lang in rows) for n in names]) / len(rows)
    w = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]), z.T @ (y + 1 - 2 * share))  # targets centred per language
    return Model(names, columns, np.ascontiguousarray(unit.T @ (root @ w), np.float32))


def sample(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_lang`` (text, lang) of each language, evenly by a hash of the id; of a text over TRAIN_CHARS a part from a
    place that the hash chooses.

    ``docs``: id, text, lang. Languages are counted first; a hash test then leaves about twice the rows needed, so ranking
    them moves a bounded number of texts whatever the size of a language. Every language is learned: what is collected is
    TOTAL_CHARS at most, or one part a language.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    per_lang = min(per_lang, max(1, TOTAL_CHARS // (TRAIN_CHARS * len(counts))))
    chars = max(64, min(TRAIN_CHARS, TOTAL_CHARS // (per_lang * len(counts))))
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(y, min(1.0, 2.0 * per_lang / n + 20.0 / n)) for y, n in counts.items()], "lang string, share double")
    if len(counts) <= BROADCAST_LANGS:  # a row of some tens of bytes each: texts stay where they are
        shares = F.broadcast(shares)
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    chosen = usable.join(shares, "lang").filter(part < F.col("share")).select("id", "lang", F.substring("text", start, F.lit(chars)).alias("text"))
    ranked = chosen.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).filter(F.col("rank") <= per_lang)
    return [(r[0], r[1]) for r in ranked.orderBy("rank", "lang").select("text", "lang").collect()]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1: the best language's softmax share) per row.

    Null texts and texts without a letter are ``und`` with score 0, and so is all if no row was labelled. Whole texts of
    any length are read; ties go to the first language by name; null and repeated keys are rows of their own; an empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            for at in range(0, n if model.langs else 0, BATCH):
                found = [(i, p) for i in range(at, min(n, at + BATCH)) if (p := presence(b.column(1)[i].as_py())) is not None]
                if not found:
                    continue
                size = np.sqrt(np.array([len(p) for _, p in found], np.float32))
                x = _matrix([p for _, p in found], model.columns) @ model.weights / size[:, None]
                e = np.exp(4 * (x - x.max(axis=1, keepdims=True)))
                best = x.argmax(axis=1)
                for (i, _), k, row in zip(found, best, e, strict=True):
                    pred[i], score[i] = model.langs[k], float(row[k] / row.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a row without a doc_id has no remainder: it isn't held out
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = sample(docs.filter(~out).select(F.col("doc_id").alias("id"), "text", "lang"))
    model = fit([t for t, _ in rows], [y for _, y in rows])
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
