"""Ranked lexical search over inverted treaps.

Documents are taken in shards. In a shard each query term has a treap of its postings: ordered by document as a search
tree, by impact as a heap, so a subtree's root is its best posting. All treaps of an item are walked together over
intervals of documents: an interval's bound is the sum of the impacts of its subtrees' roots, each times the term's
repeats. The intervals of highest bound go first; the document of an interval's best posting is scored exactly and splits
the interval, every treap descending to its roots on either side; intervals whose bound can't enter the k best are left
with all their postings. The k best of every shard meet in one window.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.llm.common import materialize, table
from cairnlight.llm.decontaminate import words_of

TOP = 20
#: Postings of a shard, bytes of query text in a block, and intervals split at once.
SHARD, BLOCK_BYTES, AT_ONCE = 3_000_000, 4 << 20, 256


class Queries:
    """Items as counted term codes: what goes to the workers. Rows of a repeated id are items of their own."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]]) -> None:
        self.codes: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        for item, text in items:
            count = Counter(words_of(text))
            own = [self.codes.setdefault(w, len(self.codes)) for w in count]
            self.items.append((item, np.array(own, np.int64), np.array(list(count.values()), np.int64)))
        self.key = uuid.uuid4().hex


def postings(docs: DataFrame, queries: Broadcast, key: str, text: str) -> DataFrame:
    """id, n (terms with repeats), terms (codes of those that queries hold) and tf of every document."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = queries.value.codes.get
        for b in batches:
            sizes, ends, terms, tfs = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for t in b.column(1):
                words = words_of(t.as_py())
                codes = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                own, tf = np.unique(codes[codes >= 0], return_counts=True)
                sizes.append(len(words))
                ends.append(ends[-1] + len(own))
                terms.append(own)
                tfs.append(tf.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Treaps:
    """Postings of a shard in order of (term, document) with the links of each term's treap."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((doc, term))
        term, self.doc, self.impact, self.n_docs = term[order], doc[order], impact[order], n_docs
        self.at = term.astype(np.int64) * n_docs + self.doc  # the place of a posting by binary search
        edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.root: dict[int, int] = {}
        left, right, value = [-1] * len(term), [-1] * len(term), self.impact.tolist()
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(term)], strict=True):
            spine: list[int] = []  # the path of right links from the root
            for i in range(s, e):
                last, x = -1, value[i]
                while spine and value[spine[-1]] < x:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.root[int(term[s])] = spine[0]
        # one more posting, of no document and no impact, stands for an empty subtree
        self.left, self.right = np.array([*left, -1], np.int64), np.array([*right, -1], np.int64)
        self.doc, self.impact = np.append(self.doc, -1), np.append(self.impact, 0)

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each subtree, the root of what lies in [low, high]; -1 if nothing does."""
        node = node.copy()
        flat, lo, hi = node.reshape(-1), np.broadcast_to(low, node.shape).reshape(-1), np.broadcast_to(high, node.shape).reshape(-1)
        go = np.flatnonzero(flat >= 0)
        while len(go):
            d = self.doc[flat[go]]
            under, over = d < lo[go], d > hi[go]
            go = go[under | over]
            flat[go] = np.where(under[under | over], self.right[flat[go]], self.left[flat[go]])
            go = go[flat[go] >= 0]
        return flat.reshape(node.shape)

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        want = terms[None] * self.n_docs + docs[:, None]
        place = np.minimum(np.searchsorted(self.at, want), len(self.at) - 1)
        return (np.where(self.at[place] == want, self.impact[place], 0) * times).sum(axis=1)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents with a score above 0 (equal ones by document), their scores, and how many were scored."""
        here = np.array([int(t) in self.root for t in terms], bool)
        terms, times = terms[here], times[here]
        docs, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not len(terms):
            return docs, scores, 0
        node = np.array([[self.root[int(t)] for t in terms]], np.int64)
        low, high = np.zeros(1, np.int64), np.full(1, self.n_docs - 1)
        bound = (self.impact[node] * times).sum(axis=1)
        while True:
            floor = max(1, int(scores[k - 1]) if len(scores) >= k else 1)
            alive = bound >= floor
            node, low, high, bound = node[alive], low[alive], high[alive], bound[alive]
            if not len(bound):
                return docs, scores, seen
            take = np.argpartition(-bound, AT_ONCE - 1)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            x, lo, hi = node[take], low[take], high[take]
            worth = self.impact[x] * times
            pivot = self.doc[x[np.arange(len(take)), worth.argmax(axis=1)]]
            seen += len(pivot)
            docs, scores = np.concatenate([docs, pivot]), np.concatenate([scores, self.scores(pivot, terms, times)])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            docs, scores = docs[scores > 0], scores[scores > 0]
            sides = []
            for a, b in ((lo, pivot - 1), (pivot + 1, hi)):
                use = a <= b
                sides.append((self.within(x[use], a[use, None], b[use, None]), a[use], b[use]))
            new = [np.concatenate(p) for p in zip(*sides, strict=True)]
            node, low, high = (np.concatenate([old[rest], add]) for old, add in zip((node, low, high), new, strict=True))
            bound = np.concatenate([bound[rest], (self.impact[new[0]] * times).sum(axis=1)])


def _best(found: DataFrame, queries: Broadcast, weights: Broadcast, n_docs: int, length: int, k: int) -> DataFrame:
    """item_id, copy (the item's place in its block), id and score of the k best documents of every shard."""
    kind = found.schema["id"].dataType.simpleString()

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.Table.from_batches(held).sort_by([("id", "ascending")]).combine_chunks()  # null ids come last
        n = np.asarray(all_["n"])
        sizes = np.asarray(all_["terms"].combine_chunks().value_lengths())
        doc = np.repeat(np.arange(len(n)), sizes)
        term, tf = (np.asarray(all_[c].combine_chunks().flatten()).astype(np.int64) for c in ("terms", "tf"))
        values, place = np.unique(n, return_inverse=True)
        m = np.array([75 + 25 * int(x) * n_docs // length for x in values], np.int64)[place]
        treaps = Treaps(term, doc, impacts(weights.value[term], tf, m[doc]), len(n))
        items, copies, docs, scores = [], [], [], []
        for copy, (item, terms, times) in enumerate(queries.value.items):
            d, s, _ = treaps.best(terms, times, k)
            items += [item] * len(d)
            copies += [copy] * len(d)
            docs.append(d)
            scores.append(s)
        if items:
            id_ = all_["id"].combine_chunks().take(pa.array(np.concatenate(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(copies, pa.int32()), id_, pa.array(np.concatenate(scores))], names=["item_id", "copy", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten()) + b.num_rows
            if size >= SHARD:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return found.mapInArrow(run, f"item_id long, copy int, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, key and score: for each row of ``items`` (item_id, text) its k best documents of all ``docs``.

    Items of any number are broadcast in blocks of checked size, chosen by a hash of the id; each block reads the
    documents once and writes the postings of its own terms, from which counts and treaps are made. Statistics cover all
    documents. Null texts and those without a term have none and are never found; items without a term find nothing.
    Repeated ids, of items or documents, are rows of their own; null ids come last among ties. Empty tables give no rows;
    other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    named = items.select(F.col("item_id").cast("long"), "text")
    out = []
    for b in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        queries = spark.sparkContext.broadcast(Queries((r[0], r[1]) for r in part.toLocalIterator()))
        found = materialize(postings(docs, queries, key, text), "postings")
        n_docs, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(max(1, len(queries.value.codes)), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            weights[r.t] = weight(n_docs, r["count"])
        some = found.filter(F.size("terms") > 0).select("id", "n", "terms", "tf")
        out.append(materialize(_best(some, queries, spark.sparkContext.broadcast(weights), n_docs, max(length, 1), k), "best", replaces=[found]))
    best = out[0]
    for more in out[1:]:
        best = best.unionAll(more)  # rows of one id are in one block
    ranked = Window.partitionBy("item_id", "copy").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias(key), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS length FROM d),
q AS MATERIALIZED (SELECT qid, item_id, t, count(*) AS times FROM (SELECT qid, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS qid, item_id, {_W} AS w FROM benchmark)) GROUP BY ALL),
p AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(w) * n_docs) // length) AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT qid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY qid, item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
QUERIES = {"op12_search": op12_search}
ORACLE = {"op12_search": ORACLE_SQL}
