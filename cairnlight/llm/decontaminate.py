"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of one task. Its words are coded over the benchmark's own alphabet; a word that no item
has ends a run, and runs shorter than the shortest window are dropped, since no window can lie in them. What remains is
indexed (suffix order, Burrows-Wheeler transform, wavelet matrix, sampled suffix positions); all test windows are
searched backward at once, occurrences are located by walking to a sample, and their word spans are merged per document.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import Part, carried, table

WINDOW = 10
#: Letters, digits and all beyond ASCII are word bytes; A-Z becomes a-z; the rest separates words.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Code points and rows of a shard (a longer document ends its shard), bytes of a block of benchmark text, and the blocks
#: that one pass over the documents takes (their windows are what a worker keeps).
SHARD_CHARS, SHARD_ROWS, BLOCK_BYTES, PASS_BLOCKS = 8_000_000, 50_000, 8 << 20, 4
PIECE, SAMPLE = 48, 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Block:
    """Items as codes of their words (from 1; 0 is any other word): what goes to the workers."""

    def __init__(self, items: Iterable[tuple[int, str | None]]) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids: list[int] = []
        flat, ends = array("i"), [0]
        for item, text in items:
            flat.extend(self.codes.setdefault(x, len(self.codes) + 1) for x in words_of(text))
            if len(flat) > ends[-1]:
                self.ids.append(item)
                ends.append(len(flat))
        self.flat, self.ends = np.array(flat, np.int32), np.array(ends, np.int64)
        self.key = uuid.uuid4().hex


class Windows:
    """Distinct windows of a block's items, those of each length apart."""

    def __init__(self, items: Iterable[tuple[int, str | None]] | Block, window: int = WINDOW) -> None:
        block = items if isinstance(items, Block) else Block(items)
        self.codes, self.by_length = block.codes, []
        size = np.diff(block.ends)
        lengths, pairs, first = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], 0
        for n in np.unique(np.minimum(size, window)):
            use = np.flatnonzero(np.minimum(size, window) == n)
            many = size[use] - n + 1
            item = np.repeat(use, many)
            begin = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + block.ends[item]
            words = block.flat[begin[:, None] + np.arange(n)]
            ids = words[:, 0].astype(np.int64)
            for k in range(1, n):  # equal prefixes have equal numbers, one word after another
                ids = np.unique(ids * (len(self.codes) + 1) + words[:, k], return_inverse=True)[1]
            at, ids = np.unique(ids, return_index=True, return_inverse=True)[1:]
            self.by_length.append(SameLength(words[at], first + np.arange(len(at)), len(self.codes) + 1))
            lengths.append(np.full(len(at), n, np.int64))
            pairs.append(np.unique(np.stack([first + ids, item], 1), axis=0))
            first += len(at)
        self.lengths = np.concatenate(lengths)
        found = np.concatenate(pairs)
        self.starts = np.searchsorted(found[:, 0], np.arange(first + 1))
        self.item = [block.ids[i] for i in found[:, 1]]

    def items(self, window: int) -> list[int]:
        """Ids of the items that have the window."""
        return self.item[self.starts[window] : self.starts[window + 1]]


class SameLength:
    """The windows of one length: their own alphabet (``recode`` maps codes to it), words, and places among all windows."""

    def __init__(self, words: np.ndarray, of: np.ndarray, codes: int) -> None:
        used, own = np.unique(words, return_inverse=True)
        self.of, self.longest, self.size = of, words.shape[1], len(used) + 1
        self.words = own.reshape(words.shape).astype(np.int32) + 1
        self.recode = np.zeros(codes, np.int32)
        self.recode[used] = np.arange(1, len(used) + 1)


class WaveletMatrix:
    """rank(c, i): how often symbol c stands among the first i; vectorised over many (c, i)."""

    def __init__(self, seq: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros(len(c), np.int64)
        i = i.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][i].astype(np.int64)
            lo, i = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, i - b)
        return i - lo


class FMIndex:
    """Over pieces of codes, each closed by a sentinel 0; sentinels sort before words, and among each other by position."""

    def __init__(self, seq: np.ndarray, size: int, sample: int = SAMPLE) -> None:
        n = len(seq)
        ends = seq == 0
        # rank by one symbol, the sentinels apart, then by doubling until all ranks differ
        rank = np.where(ends, np.cumsum(ends) - 1, seq + (int(ends.sum()) - 1))
        span, place = 1, np.arange(n)
        order = np.argsort(rank, kind="stable")
        while n:
            top = int(rank.max()) + 1
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (top + 1) + after
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank, span = fresh, span * 2
            if int(rank[order[-1]]) == n - 1:
                break
        self.order = order
        before = np.where(order > 0, seq[order - 1], 0) if n else seq
        self.bwt = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])  # rows whose suffix starts below a symbol
        self.ranks = WaveletMatrix(before, size)
        starts = np.zeros(n, bool)
        starts[0:1] = True
        starts[1:] |= ends[:-1]
        at = np.zeros(n, np.int64)
        at[starts] = place[starts]
        self.offset = place - np.maximum.accumulate(at) if n else at
        keep = (self.offset[order] % sample == 0) if n else ends
        self.sampled = np.cumsum(keep)
        self.samples = order[keep]
        self.keep = keep
        del self.order, self.offset

    def search(self, windows: SameLength) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of every window."""
        m = len(windows.words)
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.bwt), np.int64)
        for k in range(windows.longest - 1, -1, -1):
            c = windows.words[:, k]
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            base = self.first[c[live]]
            lo[live], hi[live] = base + self.ranks.rank(c[live], lo[live]), base + self.ranks.rank(c[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: step back until a sampled row, then add the steps."""
        out, steps, at = np.zeros(len(rows), np.int64), 0, rows.copy()
        left = np.arange(len(rows))
        while len(left):
            done = self.keep[at]
            out[left[done]] = self.samples[self.sampled[at[done]] - 1] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.first[c] + self.ranks.rank(c, at)
            steps += 1
        return out


def occurrences(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a window in a shard's codes, where 0 breaks runs.

    Windows of each length have an index of their own, over their own alphabet: else one item of a single word would
    keep every known word in the index.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in windows.by_length:
        at, window = _occurrences(part.recode[codes], part)
        found.append((at, part.of[window]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _occurrences(codes: np.ndarray, windows: SameLength) -> tuple[np.ndarray, np.ndarray]:
    known = codes > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= windows.longest
    start, end = start[long], end[long]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # pieces of bounded length, overlapping by a window less one word, bound the rounds of doubling
    step = max(PIECE, 2 * windows.longest) - windows.longest + 1
    pieces = np.maximum(1, -(-(end - start - windows.longest + 1) // step))
    of = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = start[of] + nth * step
    size = np.minimum(end[of], begin + step + windows.longest - 1) - begin
    total = np.cumsum(size + 1)
    offset = np.repeat(begin - (total - size - 1), size + 1)
    where = np.arange(int(total[-1])) + offset
    seq = codes[np.minimum(where, len(codes) - 1)].astype(np.int64)
    seq[total - 1] = 0
    index = FMIndex(seq, windows.size)
    lo, hi = index.search(windows)
    n = hi - lo
    hit = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return where[index.locate(rows)], hit


def _shards(batches: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of documents across batches, bounded in code points and rows; a longer document ends its run."""
    kept_, texts, total = [], [], 0
    for kept, column in batches:
        begin = 0
        for i, text in enumerate(column):
            texts.append(text.as_py())
            total += len(texts[-1] or "")
            if total >= SHARD_CHARS or len(texts) >= SHARD_ROWS:
                yield pa.concat_batches([*kept_, kept.slice(begin, i + 1 - begin)]), texts
                begin, kept_, texts, total = i + 1, [], [], 0
        if begin < kept.num_rows:
            kept_.append(kept.slice(begin))
    if texts:
        yield pa.concat_batches(kept_), texts


def _hits(parts: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
    """Hit words over the shard (documents apart by one 0), where documents start, and items by document."""
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    codes = np.zeros(int(starts[-1]), np.int32)
    for at, p in zip(starts, parts, strict=False):
        codes[at : at + len(p)] = p
    at, window = occurrences(codes, windows)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.lengths[window], -1)
    items: dict[int, set[int]] = {}
    doc = np.searchsorted(starts, at, side="right") - 1
    for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist() if len(at) else ():
        items.setdefault(d, set()).update(windows.items(w))
    return np.cumsum(change)[:-1] > 0, starts, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, as first and one past the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _spans(runs: list[tuple[int, int]], text: str) -> list[dict]:
    """Runs of words as code points of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"s": int(points[begin[a]]), "e": int(points[end[b - 1]])} for a, b in runs]


_AT_WORK: dict[tuple[str, int], Windows] = {}


def _windows_of(block: Broadcast, window: int) -> Windows:
    """This worker process's windows of a broadcast block; later tasks in the same process find them built."""
    key = (block.value.key, window)
    if key not in _AT_WORK:
        while len(_AT_WORK) >= PASS_BLOCKS:
            del _AT_WORK[next(iter(_AT_WORK))]
        _AT_WORK[key] = Windows(block.value, window)
    return _AT_WORK[key]


RESULTS = "n_words long, n_hit long, items array<long>, runs array<struct<a:int,b:int>>, spans array<struct<s:int,e:int>>"


def match(docs: DataFrame, blocks: list[Broadcast], key: str = "doc_id", text: str = "text", window: int = WINDOW, prior: bool = False) -> DataFrame:
    """key, n_words, n_hit, items (ids with occurring windows), runs (of hit words) and spans (of code points) per row.

    ``blocks`` are broadcast and of bounded size. With ``prior`` the key is a struct with items and runs found before.
    """
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))

    def run(batches: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for kept, texts in _shards(batches):
            n = len(texts)
            found: dict[int, set[int]] = {}
            hits: dict[int, np.ndarray] = {}
            sizes: list[int] = []
            for block in blocks:
                windows = _windows_of(block, window)
                get = windows.codes.get
                parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in map(words_of, texts)]
                sizes = [len(p) for p in parts]
                if not len(windows.lengths):
                    continue
                hit, starts, items = _hits(parts, windows)
                for d, ids in items.items():
                    own = hit[starts[d] : starts[d] + sizes[d]]
                    hits[d] = hits[d] | own if d in hits else own
                    found.setdefault(d, set()).update(ids)
            if prior:
                row = kept.column(0)
                for d, (ids, runs) in enumerate(zip(pc.struct_field(row, "items").to_pylist(), pc.struct_field(row, "runs").to_pylist(), strict=True)):
                    if ids:
                        found.setdefault(d, set()).update(ids)
                        own = hits.setdefault(d, np.zeros(sizes[d], bool)).copy()
                        for r in runs:
                            own[r["a"] : r["b"]] = True
                        hits[d] = own
            runs = {d: _runs(h) for d, h in hits.items()}
            yield kept, [
                pa.array(sizes, pa.int64()), pa.array([int(hits[d].sum()) if d in hits else 0 for d in range(n)], pa.int64()),
                pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.int64())),
                pa.array([[{"a": a, "b": b} for a, b in runs.get(d, ())] for d in range(n)], pair("a", "b")),
                pa.array([_spans(runs[d], texts[d]) if d in runs else [] for d in range(n)], pair("s", "e")),
            ]

    return carried(docs, key, text, RESULTS, run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit, items (ids with occurring windows) and spans (of code points, merged) per row.

    The benchmark (item_id, text) may be of any size: it is broadcast in blocks of checked size, chosen by a hash of the
    id, PASS_BLOCKS of them a pass; a further pass carries the finds of the one before along. No pass moves a document.
    Null and empty texts have no words; null and repeated keys are rows of their own; very long texts form a shard alone;
    other columns, whatever their names, are not read. Items without words have no windows. Empty tables give no rows or
    no finds.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(size // block_bytes) + 1
    items = benchmark.select("item_id", "text")
    part = lambda b: items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
    blocks = [spark.sparkContext.broadcast(Block((r[0], r[1]) for r in part(b).toLocalIterator())) for b in range(n)]
    if n <= PASS_BLOCKS:
        return match(docs, blocks, key, text, window).drop("runs")
    inner = text.removeprefix(f"{key}.") if text.startswith(f"{key}.") else None
    own = [F.col(key).alias("key"), *([] if inner else [F.col(text).alias("text")])]
    rows = docs.select(F.struct(*own, F.array().cast("array<long>").alias("items"), F.array().cast("array<struct<a:int,b:int>>").alias("runs")).alias("c"))
    for b in range(0, n, PASS_BLOCKS):
        rows = match(rows, blocks[b : b + PASS_BLOCKS], "c", f"c.key.{inner}" if inner else "c.text", window, True)
        rows = rows.select(F.struct("c.key", *([] if inner else ["c.text"]), "items", "runs").alias("c"), "n_words", "n_hit", "spans")
    return rows.select(F.col("c.key").alias(key), "n_words", "n_hit", "c.items", "spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {"op7_decontaminate": ORACLE_SQL}
