"""Overlap joins, constraint matching, vector search and substring joins, none of them a nested loop over rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.session import discard, materialize

#: Vectors of a block of queries that a task holds.
QUERY_BLOCK = 4096
#: Outputs of the first block of links and of any block at most, and pairs that a block is meant to give.
OUTPUT_BLOCK, OUTPUT_MOST, PAIR_ROOM = 64, 1024, 4_000_000


def token_set(c: Column, stop: Sequence[str] = (), least: int = 1) -> Column:
    out = F.array_distinct(F.filter(T.words(F.lower(T.blank(c))), lambda w: F.length(w) >= least))
    return F.array_except(out, F.array(*(F.lit(s) for s in stop))) if stop else out


def overlap_pairs(left: DataFrame, right: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(a, b, n) and the pair's other columns: tokens in common of ``left`` (a, tokens) and ``right`` (b, tokens).

    An inverted-index equi-join on the token. ``allowed`` (over other columns of both sides) leaves pairs out before they
    are counted; counts combine on the map side, so a pair moves once per task.
    """
    extra = [c for x, k in ((left, "a"), (right, "b")) for c in x.columns if c not in (k, "tokens")]
    x = left.withColumn("token", F.explode("tokens")).drop("tokens")
    y = right.withColumn("token", F.explode("tokens")).drop("tokens")
    both = x.join(y, "token")
    return (both if allowed is None else both.filter(allowed)).groupBy("a", "b", *extra).agg(F.count("*").alias("n"))


def connections(rows: DataFrame, as_of: Column, days: int = 60, papers: int = 5, chars: int = 10, least: int = 3, similarity: float = 0.35, k: int = 15, block: int = OUTPUT_BLOCK, room: int = PAIR_ROOM) -> DataFrame:
    """The ``k`` best output-to-input links between recent rows of different classes: id, pos, kind, date, output, input.

    Rows of the last ``days`` take part; with fewer than ``papers`` there are no links. An output or input under ``chars``
    characters links nothing. A row comes before its partner in ``pos``; at least ``least`` words in common, and that share
    of the smaller set. Links are ranked by similarity, then ids, so outputs are taken in blocks in order of their ids, the
    first of ``block`` rows and others of as many as give about ``room`` pairs; once all ``k`` links have similarity 1, no
    later output has a better one. All pairs are counted if there are fewer such links, but never in one step.
    """
    recent = rows.filter(F.col("date") >= F.date_sub(as_of, days))
    enough = recent.limit(papers).agg((F.count("*") >= papers).alias("enough")).first().enough
    trimmed = lambda c: F.trim(F.lower(T.blank(F.col(c))))
    side = lambda p, c: materialize(recent.filter(F.lit(enough) & (F.length(trimmed(c)) >= chars)).select(
        F.col("id").alias(p), F.col("pos").alias(f"{p}_pos"), F.col("kind").alias(f"{p}_kind"), token_set(F.col(c)).alias("tokens")).withColumn(f"{p}_size", F.size("tokens")), "connections")
    outputs, inputs = side("a", "output"), side("b", "input")
    share = F.col("n") / F.least("a_size", "b_size")
    best, left = None, outputs.filter("a IS NOT NULL")
    while True:
        last = left.select("a").orderBy("a").limit(block).agg(F.max("a").alias("a")).first().a
        if last is None and best is not None:
            break
        seen = Observation()
        pairs = overlap_pairs(F.broadcast(left.filter(F.col("a") <= F.lit(last))), inputs, (F.col("a_pos") < F.col("b_pos")) & (F.col("a_kind") != F.col("b_kind")))
        links = pairs.observe(seen, F.count("*").alias("n")).filter((F.col("n") >= least) & (share >= similarity))
        links = links.select("a", "b", F.col("n").alias("n_shared"), F.round(share, 3).alias("similarity"))
        links = (links if best is None else links.unionByName(best)).orderBy(F.desc("similarity"), "a", "b").limit(k)
        best = materialize(links, "connections", replaces=[] if best is None else [best])
        whole = best.agg((F.count_if(F.col("similarity") >= 1) >= k).alias("whole")).first().whole
        if whole or last is None:
            break
        left = outputs.filter(F.col("a") > F.lit(last))
        block = max(1, min(8 * block, OUTPUT_MOST, block * room // max(1, seen.get["n"])))
    discard(rows.sparkSession, outputs.written_to, inputs.written_to)
    return best


#: Characters of a word that a one-term constraint is looked up by; a hit is checked in full.
BEGUN = 64
#: What a denial starts with (fixed values).
DENIALS = ("no ", "not ", "absence ", "without ", "lack of ")


def constraint_match(constraints: DataFrame, papers: DataFrame, supported: float = 0.4, partial: float = 0.15, stop: Sequence[str] = V.MATCH_STOP_WORDS) -> DataFrame:
    """Verdict per (constraint, paper): supported or partial by the share of the constraint's terms among the paper's words,
    else violated where the text denies its first three terms (in sorted order), else none.

    ``constraints``: cid, statement; ``papers``: pid, text. Texts don't move: pairs with common terms are counted where the
    paper is read, and a denial is held against the three words after it, with constraints whose first term is the word after
    it (or, of a single term, begins it). Both are made once and meet in one outer join.
    """
    words = token_set(F.col("statement"), stop)
    c = T.once(constraints, tokens=words).select(F.col("cid").alias("a"), "tokens", F.size("tokens").alias("size"))
    text = F.trim(F.lower(T.blank(F.col("text"))))
    # stop words and the empty word are no constraint's terms, so they needn't be taken out of a text
    p = T.once(papers, tokens=F.array_distinct(F.split(text, r"\s+"))).select(F.col("pid").alias("b"), "tokens")
    ratio = F.col("n") / F.greatest(F.lit(1), F.col("size"))
    found = overlap_pairs(c, p).filter(ratio >= partial)

    phrase = F.array_join(F.slice(F.array_sort("tokens"), 1, 3), " ")
    head = c.select("a", "size", (F.col("size") > 1).alias("whole"), phrase.alias("phrase"))
    head = head.select("*", F.when(F.col("whole"), F.substring_index("phrase", " ", 1)).otherwise(F.left("phrase", F.lit(BEGUN))).alias("term"))
    lengths = head.agg(F.collect_set(F.when(~F.col("whole"), F.length("term")))).scalar()  # at most BEGUN + 1 numbers
    after = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?:{'|'.join(DENIALS)})(?=(\S*(?: \S*){{0,2}}))"), F.lit(1)))
    said = T.once(papers.withColumn("at", F.monotonically_increasing_id()), after=after).select("at", F.col("pid").alias("b"), F.explode("after").alias("said"))
    word, key = F.substring_index("said", " ", 1), lambda whole, term: F.struct(F.lit(whole).alias("whole"), term.alias("term"))
    keys = F.concat(F.array(key(True, word)), F.transform("lengths", lambda i: key(False, F.left(word, i))))
    at = said.withColumn("lengths", lengths).select("at", "b", "said", F.explode(keys).alias("key")).select("at", "b", "said", "key.*")
    hits = at.join(head, ["whole", "term"]).filter(F.startswith("said", F.col("phrase"))).select("at", "b", "a", "size").distinct()
    denied = hits.groupBy("a", "b", "size").agg(F.count("*").cast("int").alias("times"))

    verdict = lambda result, confidence: F.struct(result.alias("result"), confidence.alias("confidence"))
    good = verdict(F.when(ratio >= supported, "supported").otherwise("partial"), F.round(ratio, 2))
    bad = F.array_repeat(verdict(F.lit("violated"), F.lit(0.5)), F.col("times"))
    rows = found.join(denied, ["a", "b", "size"], "full_outer").select("a", "b", F.explode(F.when(F.col("n").isNotNull(), F.array(good)).otherwise(bad)).alias("v"))
    return rows.select(F.col("a").alias("cid"), F.col("b").alias("pid"), "v.result", "v.confidence")


def nearest(reference: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """The most similar reference vector of each query by cosine (ties: the least id; itself left out), with a verdict.

    ``reference`` and ``queries``: id, embedding. The reference is read once and stays where it is. Queries pass the driver
    one block of bounded size at a time, each broadcast to disk; a task takes a block at a time into memory, keeps the best
    of each query as two numbers, and returns those at its end: one row per task and query moves.
    """
    spark = queries.sparkSession
    blocks, ids, vectors = [], [], []

    def sent() -> None:
        q = np.array(vectors, np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        blocks.append((spark.sparkContext.broadcast((np.array(ids, np.int64), q)), len(ids)))
        ids.clear()
        vectors.clear()

    for row in queries.select("id", "embedding").filter("embedding IS NOT NULL").toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) >= block:
            sent()
    if ids:
        sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.full(n, -2.0) for _, n in blocks]
        match = [np.zeros(n, np.int64) for _, n in blocks]
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ref, kind="stable")
            ref = ref[order]
            m = np.array(batch.column(1).to_pylist(), np.float64)[order]
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            for k, (sent_, _) in enumerate(blocks):
                own, q = sent_.load_from_path(sent_._path)  # not kept: the next block takes its place
                sim = q @ m.T
                sim[own[:, None] == ref[None, :]] = -2.0
                at = np.round(sim, 12).argmax(axis=1)
                top = sim[np.arange(len(own)), at]
                a, b = np.round(top, 12), np.round(best[k], 12)
                better = (a > b) | ((a == b) & (ref[at] < match[k]))
                best[k][better], match[k][better] = top[better], ref[at][better]
        for k, (sent_, _) in enumerate(blocks):
            use = best[k] > -2.0
            own = sent_.load_from_path(sent_._path)[0][use]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(match[k][use]), pa.array(best[k][use])], names=["id", "match", "similarity"])

    out = reference.select("id", "embedding").filter("embedding IS NOT NULL").mapInArrow(run, "id long, match long, similarity double")
    best = out.groupBy("id").agg(F.max_by(F.struct("match", "similarity"), F.struct(F.round("similarity", 12), -F.col("match"))).alias("m"))
    s = F.col("m.similarity")
    return best.select("id", F.col("m.match").alias("match"), F.round(s, 3).alias("similarity"), F.when(s >= 0.5, "high").when(s >= 0.35, "medium").otherwise("low").alias("verdict"))


def substring_matches(rows: DataFrame, key: str, text: Column, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, name): names whose term occurs in the text or holds it; the list is a literal, each row expands by its hits."""
    entries = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("term")) for n, t in terms))
    hits = F.filter(entries, lambda e: F.contains(text, e["term"]) | F.contains(e["term"], text))
    return rows.select(key, F.explode(F.array_distinct(F.transform(hits, lambda e: e["name"]))).alias("name"))


def keyword_match(text: Column, phrases: Sequence[str], strong: Sequence[str], ordinary: Sequence[str]) -> Column:
    """A phrase, a strong token, or two ordinary tokens."""
    count = lambda xs: sum((T.has_term(text, x).cast("int") for x in xs), F.lit(0))
    return T.contains_any(text, phrases) | (count(strong) >= 1) | (count(ordinary) >= 2)
