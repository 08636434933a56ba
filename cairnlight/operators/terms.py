"""Many patterns against many texts in one pass, in both directions, and the keywords of a subject.

Patterns are broadcast in blocks of bounded size; a task builds one automaton of a block and walks each text once, however
many patterns there are. The other direction, texts inside patterns, turns the roles round: an automaton of a batch's
short texts walks the patterns of the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T

#: Characters of patterns in a block. An automaton takes some fifty bytes a character.
BLOCK_CHARS = 1_000_000


def _automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def _hits(block: Broadcast, inside: bool):
    """Rows (row, text) to (row, terms: places in the block) of those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[str] = block.value
        known = _automaton(terms)
        longest = max(map(len, terms))
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [{i for _, i in known.iter(t)} if t else set() for t in texts]
            short: dict[str, list[int]] = {}
            for at, t in enumerate(texts):
                if inside and t and len(t) <= longest:
                    short.setdefault(t, []).append(at)
            if short:
                own = list(short)
                of_batch = _automaton(own)
                for i, term in enumerate(terms):
                    for j in {j for _, j in of_batch.iter(term)}:
                        for at in short[own[j]]:
                            found[at].add(i)
            use = pa.array([bool(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(use), pa.array([sorted(f) for f in found if f], pa.list_(pa.int32()))], names=["row", "terms"])

    return run


def matches(rows: DataFrame, key: str, text: Column, terms: DataFrame, inside: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, name), distinct: names (``terms``: name, term) with a term that occurs in the row's text or, with ``inside``,
    that holds the whole text.

    Each text is read once per block of terms; terms of any number are taken in blocks by a hash, whose size is counted
    first. Empty or null texts and terms match nothing. Comparison is of characters as they are: fold case before. Rows of
    a repeated key are matched apart and reported once. Empty tables give no rows.
    """
    spark = rows.sparkSession
    kept = terms.filter(F.length("term") > 0).select("name", "term").distinct()
    chars = kept.select("term").distinct().agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    blocks = int(chars // block_chars) + 1
    part = F.pmod(F.xxhash64("term"), F.lit(blocks))
    source = rows.select(F.col(key).alias("row"), text.alias("text")).filter(F.length("text") > 0)
    kind = source.schema["row"].dataType.simpleString()
    out = None
    for i in range(blocks):
        own = sorted(r.term for r in kept.filter(part == i).select("term").distinct().collect())  # one block's, at most
        if not own:
            continue
        block = spark.sparkContext.broadcast(own)
        found = source.mapInArrow(_hits(block, inside), f"row {kind}, terms array<int>").select("row", F.explode("terms").alias("at"))
        names = spark.createDataFrame([(n, t) for n, t in enumerate(own)], "at int, term string").join(kept, "term").select("at", "name")
        hit = found.join(names, "at").select("row", "name")
        out = hit if out is None else out.unionAll(hit)
    if out is None:
        out = source.join(kept.select("name").limit(0), F.lit(False)).select("row", "name")
    return out.distinct().select(F.col("row").alias(key), "name")


def expanded_keywords(name: Column, hints: Mapping[str, Sequence[str]], generic: Sequence[str], topics: Sequence[str], least: int = 4) -> Column:
    """Keywords of a subject's name, longest first (equal lengths in order of text).

    The hints of each key that the name holds or is held by; the name's words of ``least`` letters that aren't generic; and
    each topic that holds, or is held by, one of those.
    """
    low = F.lower(T.blank(name))
    hinted = [F.when(F.contains(low, F.lit(k)) | F.contains(F.lit(k), low), F.array(*(F.lit(h) for h in hs))).otherwise(F.array().cast("array<string>")) for k, hs in hints.items() if hs]
    tokens = F.transform(F.split(low, r"[\s+/(),;-]+"), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    words = F.filter(tokens, lambda w: (F.length(w) >= least) & ~w.isin(*generic)) if generic else F.filter(tokens, lambda w: F.length(w) >= least)
    first = F.array_distinct(F.concat(words, *hinted))
    kept = F.filter(F.array(*(F.lit(t.lower()) for t in topics)).cast("array<string>"), lambda t: F.exists(first, lambda k: F.contains(t, k) | F.contains(k, t)))
    ordered = F.array_sort(F.transform(F.array_distinct(F.concat(first, kept)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(ordered, lambda x: x["w"])
