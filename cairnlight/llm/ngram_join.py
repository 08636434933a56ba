"""Jaccard self-join of word n-gram sets by rare-first prefixes.

Shingles are ordered by the number of sets that hold them, rare ones first. Sets alike to the threshold share a shingle
among the first n - ceil(t * n) + 1 of each, so only those prefixes are joined; shingles of one set alone meet none and
are not sent. A pair that meets must pass three filters before it is verified, once, on whole sets: sizes within the
threshold (length), shared shingles at most those before, at and after the places where it met (positional), and parities
of the counts of shingles in SIGN classes of hash that differ in no more classes than the pair may in shingles (suffix): two
sets' parities differ just where an odd number of the shingles that only one of them has fall, so few pairs that aren't
links pass.

Counting needs every shingle to meet its copies, and each set to learn its counts. Sets travel in batches: a batch sends
each bucket of shingles one packed row and gets one back with the counts. A shingle that many sets of a batch hold is
sent once with a number, and its sets stay with the batch, so the most common shingle costs a few bytes a batch.

Components need no pair twice: first each list of a shingle is a star about its least set. Lists that stay in several
components then give a forest of the nearest pairs between them; last, all pairs that these links leave between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import discard, materialize, table
from cairnlight.llm.simhash import _least_of, _numbered, _shuffles, components

WORDS, PERCENT = 3, 90
#: Shingles of a batch and sets of one at most; sets of a batch that make a shingle common; buckets per shuffle partition.
BATCH, BATCH_SETS, COMMON, BUCKETS = 1 << 20, 60_000, 32, 8
#: Classes of hash of the suffix filter (a parity each); words whose hashes a task keeps.
SIGN, KEPT_WORDS = 512, 300_000
#: First shingles of a prefix that its postings carry, to tell in which list a pair meets first.
HEAD = 8
#: Odd multipliers of a shingle's word hashes, and those of its final mixing.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LOW = np.uint64((1 << 48) - 1)


class _Hashes(dict):
    """XXH64 of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, words: int = WORDS, known: _Hashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it is shorter; empty without words."""
    known = _Hashes() if known is None else known
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not raw:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
    if len(known) > KEPT_WORDS:
        known.clear()
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)  # a shorter sequence is no shingle of a longer text
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(MIX[i % 3])
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[3])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[4])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _identity(h: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def sized(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key (a struct: null ones last, then by place), hi and lo (the set's identity) and n (its size) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            sets = [shingles(t.as_py(), words, known) for t in b.column(1)]
            ids = np.array([_identity(h) for h in sets], np.int64).reshape(len(sets), 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(ids[:, 0])), pa.array(np.ascontiguousarray(ids[:, 1])), pa.array([len(h) for h in sets], pa.int64())], names=["key", "hi", "lo", "n"])

    at = F.col(f"row.{key}")
    keyed = rows.select(F.struct(at.isNull().alias("none"), at.alias("id"), "place").alias("key"), F.col(f"row.{text}").alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    return materialize(keyed.mapInArrow(run, f"key {kind}, hi long, lo long, n long"), "ngram-sets")


# --- counts of shingles, and prefixes ---------------------------------------------------------------------------------

PACKED = "bucket int, batch long, kind int, tokens binary, counts binary, holders binary, more binary"
NAMES = ["bucket", "batch", "kind", "tokens", "counts", "holders", "more"]
#: Kinds of packed rows: shingles of a bucket, common ones of a batch with their sets, and the sets of a batch.
OF_BUCKET, COMMON_ONES, SETS = 0, 1, 2


def _pack(tokens: np.ndarray) -> bytes:
    """The low six bytes of each; a bucket has the rest in common."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def _packed_batch(batch: int, sets: list[np.ndarray], ids: list[tuple[int, int]], buckets: int, common_from: int) -> pa.RecordBatch:
    sizes = np.array([len(h) for h in sets], np.int64)
    h = np.concatenate(sets)
    holder = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(h, kind="stable")
    h, holder = h[order], holder[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    tokens, counts = h[first], np.diff(np.append(first, len(h)))
    bucket = (((tokens >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)).astype(np.int64)
    common = counts > common_from
    few = np.repeat(~common, counts)
    sign = np.zeros((len(sets), SIGN // 8), np.uint8)
    for i, x in enumerate(sets):
        sign[i] = np.packbits(np.bincount((x & np.uint64(SIGN - 1)).astype(np.int64), minlength=SIGN) & 1)
    head = np.array([(hi, lo, n) for (hi, lo), n in zip(ids, sizes.tolist(), strict=True)], np.int64)
    home = ((batch >> 32) * 31 + batch) % buckets
    rows = [(home, batch, SETS, head.tobytes(), sign.tobytes(), None, None)]
    if common.any():
        rows.append((home, batch, COMMON_ONES, tokens[common].tobytes(), counts[common].astype(np.uint16).tobytes(), holder[~few].tobytes(), bucket[common].astype(np.int32).tobytes()))
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    held = np.concatenate([[0], np.cumsum(np.where(common, 0, counts))])
    holder = holder[few]
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows.append((int(bucket[s]), batch, OF_BUCKET, _pack(tokens[s:e]), counts[s:e].astype(np.uint16).tobytes(), holder[held[s] : held[e]].tobytes(), None))
    return _rows(rows)


def _spread(words: int, least: int, buckets: int, batch: int, common_from: int):
    """Texts to packed rows. Equal sets of a batch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        held: dict[tuple[int, int], np.ndarray] = {}
        size, made = 0, 0
        home = TaskContext.get().partitionId() << 32

        def taken() -> pa.RecordBatch:
            nonlocal size, made
            out = _packed_batch(home + made, list(held.values()), list(held), buckets, common_from)
            held.clear()
            size, made = 0, made + 1
            return out

        for b in batches:
            for t in b.column(0):
                h = shingles(t.as_py(), words, known)
                if len(h) < least:
                    continue
                at = _identity(h)
                if at not in held:
                    held[at] = h
                    size += len(h)
                if size >= batch or len(held) >= BATCH_SETS:
                    yield taken()
        if held:
            yield taken()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[dict]]:
    """Runs of rows with an equal value in a sorted column."""
    held: list[dict] = []
    name = NAMES[column]
    for b in batches:
        for row in b.to_pylist():
            if held and held[-1][name] != row[name]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(common_from: int):
    """Rows of buckets back to their batches: the shingles held by two sets or more, and by how many (``more``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            out = [tuple(r[c] for c in NAMES) for r in rows if r["kind"] != OF_BUCKET]
            rows = [r for r in rows if r["kind"] == OF_BUCKET]
            if rows:
                tokens = [_unpack(r["tokens"]) for r in rows]
                counts = [np.frombuffer(r["counts"], np.uint16) for r in rows]
                all_, place = np.unique(np.concatenate(tokens), return_inverse=True)
                df = np.bincount(place, weights=np.concatenate(counts), minlength=len(all_)).astype(np.int64)[place]
                at = 0
                for r, t, c in zip(rows, tokens, counts, strict=True):
                    own = df[at : at + len(t)]
                    at += len(t)
                    keep = own >= 2
                    if keep.any():
                        few = np.where(c > common_from, 0, c)
                        holders = np.frombuffer(r["holders"], np.uint16)[np.repeat(keep, few)]
                        out.append((r["bucket"], r["batch"], OF_BUCKET, _pack(t[keep]), c[keep].tobytes(), holders.tobytes(), own[keep].tobytes()))
            if out:
                yield _rows(out)

    return run


def _prefixes(percent: int, common_from: int):
    """Counts of a batch to the postings of its sets: token, hi, lo, n, at (the shingle's place in the set's order), sign and
    head (the first tokens of the set's prefix, zeros after its end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            head = next(r for r in rows if r["kind"] == SETS)
            ids, sign = np.frombuffer(head["tokens"], np.int64).reshape(-1, 3), np.frombuffer(head["counts"], np.int64).reshape(-1, SIGN // 64)
            whole = lambda low, bucket: low | (np.uint64(bucket) << np.uint64(48))
            tokens, holders, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            common_df: dict[int, int] = {}
            for r in rows:
                if r["kind"] == OF_BUCKET:
                    t, c, df = whole(_unpack(r["tokens"]), r["bucket"]), np.frombuffer(r["counts"], np.uint16), np.frombuffer(r["more"], np.int64)
                    common_df.update(zip(t[c > common_from].tolist(), df[c > common_from].tolist(), strict=True))
                    few = np.where(c > common_from, 0, c)
                    tokens.append(np.repeat(t, few))
                    dfs.append(np.repeat(df, few))
                    holders.append(np.frombuffer(r["holders"], np.uint16).astype(np.int64))
            for r in rows:
                if r["kind"] == COMMON_ONES:
                    full, c = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["counts"], np.uint16)
                    t = (full & LOW) | (np.frombuffer(r["more"], np.int32).astype(np.uint64) << np.uint64(48))
                    tokens.append(np.repeat(t, c))
                    dfs.append(np.repeat(np.array([common_df[x] for x in t.tolist()], np.int64), c))
                    holders.append(np.frombuffer(r["holders"], np.uint16).astype(np.int64))
            token, holder, df = np.concatenate(tokens), np.concatenate(holders), np.concatenate(dfs)
            n = ids[:, 2]
            order = np.lexsort((token, df, holder))
            token, holder = token[order], holder[order]
            known = np.bincount(holder, minlength=len(n))
            start = np.concatenate([[0], np.cumsum(known)[:-1]])
            at = (n - known)[holder] + np.arange(len(holder)) - start[holder]  # shingles of one set alone come first
            use = at < (n - (percent * n + 99) // 100 + 1)[holder]
            token, holder, at = token[use], holder[use], at[use]
            if len(token):
                place = np.arange(len(token)) - np.searchsorted(holder, holder)
                heads = np.zeros((len(n), HEAD), np.int64)
                heads[holder[place < HEAD], place[place < HEAD]] = token[place < HEAD].view(np.int64)
                ends = pa.array(np.arange(len(token) + 1, dtype=np.int32) * HEAD)
                head_of = pa.ListArray.from_arrays(ends, pa.array(heads[holder].ravel()))
                own = ids[holder]
                signs = pa.ListArray.from_arrays(pa.array(np.arange(len(token) + 1, dtype=np.int32) * (SIGN // 64)), pa.array(sign[holder].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *(pa.array(np.ascontiguousarray(own[:, i])) for i in range(3)), pa.array(at), signs, head_of], names=["token", "hi", "lo", "n", "at", "sign", "head"])

    return run


def prefixes(rows: DataFrame, text: str, words: int, percent: int, batch: int = BATCH, common_from: int = COMMON) -> DataFrame:
    """Postings of the prefixes of all sets that can be linked to another one: smaller ones than ``least`` can't."""
    n = _shuffles(rows)
    least = -(-percent // (100 - percent))  # of the smaller set: n / (n + 1) must reach the threshold
    buckets = min(BUCKETS * n, 1 << 16)
    spread = rows.select(F.col(f"row.{text}").alias("text")).mapInArrow(_spread(words, least, buckets, batch, common_from), PACKED)
    counted = spread.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted(common_from), PACKED)
    return counted.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(_prefixes(percent, common_from), "token long, hi long, lo long, n long, at long, sign array<long>, head array<long>")


# --- pairs ------------------------------------------------------------------------------------------------------------


def _may_link(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Length, positional and suffix filters of two postings of one shingle."""
    both = a["n"] + b["n"]
    need = F.floor((percent * both + 99 + percent) / (100 + percent))  # least overlap: ceil(t / (1 + t) * both)
    most = F.least(a["at"], b["at"]) + 1 + F.least(a["n"] - a["at"], b["n"] - b["at"]) - 1
    apart = sum((F.bit_count(F.get(a["sign"], F.lit(i)).bitwiseXOR(F.get(b["sign"], F.lit(i)))) for i in range(SIGN // 64)), F.lit(0))
    return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (most >= need) & (apart <= both - 2 * need)


def stars(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (u < v) of each list's least set with its others."""
    own = ("n", "node", "at", "sign")
    centres = postings.groupBy("token").agg(F.min(F.struct(*own)).alias("c"), F.count("*").alias("m")).filter("m > 1")
    met = postings.join(centres, "token").filter(F.col("node") != F.col("c.node"))
    kept = met.filter(_may_link({x: F.col(x) for x in own}, {x: F.col(f"c.{x}") for x in own}, percent))
    return kept.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()


def _across(percent: int, whole: bool):
    """Pairs (u < v) between components (``root``) of lists sorted by (token, class); a list is filtered row against rest.

    A pair is made in the class of its larger set only, and if the heads of both prefixes have a common token, in the list
    of the first one only. All such pairs (``whole``), or of each list a forest: a row's nearest in components that no pair
    before has joined to its own. Rows of the most frequent component are compared with those of others only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def paired() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).sort_by("n").combine_chunks()
            held.clear()
            node, n, at, root, size, token, class_ = (np.asarray(t[c]).astype(np.int64) for c in ("node", "n", "at", "root", "size", "token", "class"))
            head = np.asarray(t["head"].combine_chunks().flatten()).reshape(-1, HEAD)
            sign = np.asarray(t["sign"].combine_chunks().flatten()).reshape(-1, SIGN // 64).view(np.uint64)
            of, members = np.unique(root, return_inverse=True)
            most = np.bincount(members).argmax()
            us, vs, made = [], [], 0
            for i in np.flatnonzero(members != most).tolist():
                j = np.arange(np.searchsorted(n, -(-n[i] * percent // 100)), np.searchsorted(n, n[i] * 100 // percent, side="right"))
                j = j[(members[j] != members[i]) & ((j > i) | (root[j] == of[most])) & (np.maximum(size[j], size[i]) == class_[0])]
                both = n[i] + n[j]
                need = -(-percent * both // (100 + percent))
                j, both, need = (x[np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= need] for x in (j, both, need))
                apart = np.bitwise_count(sign[i] ^ sign[j]).sum(axis=1, dtype=np.int64)
                j, apart = (x[apart <= both - 2 * need] for x in (j, apart))
                common = (head[j][:, None, :] == head[i][:, None]).any(axis=2) & (head[i] != 0)
                first = ~common.any(axis=1) | (head[i][common.argmax(axis=1)] == token[0])
                j, apart = j[first], apart[first]
                if not whole:
                    nearest = []
                    while len(j):
                        nearest.append(j[apart.argmin()])
                        members[members == members[nearest[-1]]] = members[i]
                        j, apart = (x[members[j] != members[i]] for x in (j, apart))
                    j = np.array(nearest, np.int64)
                us.append(np.minimum(node[i], node[j]))
                vs.append(np.maximum(node[i], node[j]))
                made += len(j)
                if made > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
                    us, vs, made = [], [], 0
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            token, class_ = np.asarray(b.column(0)), np.asarray(b.column(1))
            edge = [0, *(np.flatnonzero((token[1:] != token[:-1]) | (class_[1:] != class_[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                now = (int(token[s]), int(class_[s]))
                if held and now != last:
                    yield from paired()
                held.append(b.slice(s, e - s))
                last = now
        if held:
            yield from paired()

    return run


def across(postings: DataFrame, roots: DataFrame, percent: int, whole: bool = True) -> DataFrame:
    """Pairs of lists that hold sets of several components, or a forest of each. A list is cut in classes of size first,
    each set in two of them: those that the length filter lets meet share one."""
    of = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = of.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    class_ = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    cut = of.join(mixed, "token").withColumn("size", class_).withColumn("class", F.explode(F.array("size", F.col("size") + 1)))
    n = _shuffles(postings)
    dealt = cut.select("token", "class", "size", "node", "n", "at", "root", "sign", "head").repartition(n, "token", "class").sortWithinPartitions("token", "class")
    return dealt.mapInArrow(_across(percent, whole), "u long, v long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(u, v, alike) of pairs of nodes, by their whole sets, which are made anew from the texts."""
    ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(nodes.join(ends, "node", "left_semi").select("node", "key.place"), "ngram-wanted")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words, known).tobytes() for t in b.column(1)], pa.binary())], names=["node", "held"])

    texts = rows.select("place", F.col(f"row.{text}").alias("text")).join(wanted, "place").select("node", "text")
    sets = materialize(texts.mapInArrow(made, "node long, held binary"), "ngram-wanted", replaces=[wanted])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike)], names=["u", "v", "alike"])

    side = lambda x, y: sets.select(F.col("node").alias(x), F.col("held").alias(y))
    met = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")
    return materialize(met.mapInArrow(compare, "u long, v long, alike boolean"), "ngram-verified", replaces=[sets])


def completed(postings: DataFrame, links: DataFrame, asked: DataFrame, percent: int, alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` (a, b) and those that connect what they leave apart, so that components are those of all links.

    ``asked``: the pairs (u, v) compared before; ``alike`` gives the links (a, b) among pairs, written. The forest's pairs
    are as many as the components they may join; the pairs left after them, which are all compared, pass the filters but
    are mostly no links.
    """
    for whole in (False, True):
        roots = materialize(components(links, "ngram-cc"), "ngram-roots")
        pairs = materialize(across(postings, roots, percent, whole).join(asked, ["u", "v"], "left_anti"), "ngram-pairs", replaces=[roots])
        links, asked = links.unionAll(alike(pairs)), asked.unionAll(pairs)
    return links


def linked_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id per row: components of texts whose shingle sets have a Jaccard index of
    ``percent`` / 100 or more.

    Equal sets (by 128 bits) are one node, so copies cost no links. Texts that are null or without words have no set, no
    link and themselves as component; a text of fewer words has one shingle. A null key is least of none; repeated keys
    are rows of their own; texts are read whole; an empty table gives no rows; other columns aren't read.
    """
    rows = _numbered(docs)
    sets = sized(rows, key, text, words)
    nodes = sets.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("key").alias("key"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    postings = materialize(prefixes(rows, text, words, percent).join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("token", "node", "n", "at", "sign", "head").dropDuplicates(["token", "node"]), "ngram-postings")

    def alike(pairs: DataFrame) -> DataFrame:
        return verified(pairs, rows, nodes, text, words, percent).filter("alike").select(F.col("u").alias("a"), F.col("v").alias("b"))

    first = materialize(stars(postings, percent), "ngram-pairs")
    links = completed(postings, alike(first), first, percent, alike)
    discard(postings.sparkSession, postings.written_to)
    of = _least_of(nodes.select("node", F.col("key").alias("least")), links)
    named = materialize(nodes.join(of, "node").select("hi", "lo", "component_id.id"), "ngram-named", replaces=[nodes])
    out = sets.join(named, ["hi", "lo"], "left")
    return out.select(F.col("key.id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("key.id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_sets(table(spark, sf_dir, "documents"))


QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLE: dict[str, str] = {}
