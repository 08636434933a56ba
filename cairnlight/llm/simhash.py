"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 22, 21 and 21 bits, padded to the 23 of the binary Golay code.
The code is perfect: each word of 23 bits lies within three bits of exactly one of 4,096 codewords. A word's keys are the
indices that it and its 23 one-bit neighbours decode to, one or six of them; two words at most two bits apart share a key,
as a word between them is a neighbour of both (or is one of them).

Four differing bits fall on three segments in one of two ways. Either some segment has none; of the other two one has at
most two: key (that segment whole, an index of the other). Or each has one at least, so none has over two: key (an index
of each). So every linked pair of distinct fingerprints meets under a key of 33 bits or more; those that meet are
verified by counting differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import Part, carried, discard, materialize, packed, table

WORDS, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints whose keys a worker holds at once; shingles hashed at once; fingerprints of a bucket that is cut by segments
#: before its (same) components are looked for.
BATCH, PART, LARGE = 4096, 1 << 16, 512
#: Near copies: words of a shingle, similarity, fingerprints a text, and differing bits of candidates at most (unrelated
#: ones differ in 32 on average; texts alike to 0.8 in 10, hardly ever in over 14 in all fingerprints).
COPY_WORDS, SIMILARITY, PRINTS, COPY_BITS = 5, 0.8, 4, 14
#: Fingerprints of a bucket, before a fingerprint in order of distance from the centre, that it is compared with; bits by
#: which the nearest of them must be nearer than the centre.
WINDOW, NEARER = 32, 3


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial; zero for codewords."""
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


class Golay:
    """Decoding tables: for each syndrome, the patterns that turn a word into the codewords of its keys."""

    def __init__(self) -> None:
        errors = [sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)]
        error = np.zeros(2048, np.int64)
        error[_syndromes(np.array(errors))] = errors
        single = _syndromes(1 << np.arange(23))
        self.patterns = np.zeros((2048, 6), np.int64)
        self.counts = np.zeros(2048, np.int64)
        for s in range(2048):
            near = int(error[s])
            found = [near, *sorted({int(error[s ^ int(single[b])]) ^ (1 << b) for b in range(23)} - {near})]  # the nearest codeword's first
            self.counts[s] = len(found)
            self.patterns[s] = (found * 6)[:6]
        self.low = _syndromes(np.arange(1 << 12))
        self.high = _syndromes(np.arange(1 << 11) << 12)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (the codeword's upper 12 bits) as rows of six, and how many of the six are distinct."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words[:, None] ^ self.patterns[s]) >> 11, self.counts[s]


_CODE: list[Golay] = []


def golay() -> Golay:
    if not _CODE:
        _CODE.append(Golay())
    return _CODE[0]


def fuzzy_keys(prints: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint) of uint64 fingerprints. Kinds of keys differ in their top bits.

    All keys (``exact``) meet within four differing bits. Else only keys of three indices are given, one of them at least
    its segment's nearest: under half as many, which meet nearly as often when more bits differ.
    """
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    coded = [golay().keys(p) for p in parts]
    place = np.arange(len(prints))
    keys, of = [], []
    for i in range(3 if exact else 0):
        for j in range(3):
            if i != j:
                index, count = coded[j]
                use = np.arange(6) < count[:, None]
                key = (np.int64(3 * i + j + 1) << 58) | (parts[i][:, None] << 12) | index
                keys.append(key[use])
                of.append(np.broadcast_to(place[:, None], use.shape)[use])
    (a, na), (b, nb), (c, nc) = coded
    six = np.arange(6)
    use = (six[:, None, None] < na[:, None, None, None]) & (six[:, None] < nb[:, None, None, None]) & (six < nc[:, None, None, None])
    if not exact:
        use &= (six[:, None, None] == 0) | (six[:, None] == 0) | (six == 0)
    key = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    keys.append(key[use])
    of.append(np.broadcast_to(place[:, None, None, None], use.shape)[use])
    return np.concatenate(keys), np.concatenate(of)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only


def shingle_hashes(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in parts of bounded size; the whole sequence if it is shorter."""
    n = len(raw)
    joined = b" ".join(raw)
    if n <= words:
        if raw:
            yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1) - 1
    starts, stops = [0, *(ends[: n - words] + 1).tolist()], ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n - words + 1, PART):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PART], stops[at : at + PART], strict=True)], np.uint64)


def _remixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash of shingles: the hash itself, then ones mixed from it."""
    if not i:
        return h
    h = (h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def simhashes(raw: list[bytes], words: int, prints: int) -> list[int]:
    """``prints`` SimHashes of a whole text; 0 without words."""
    count, total = np.zeros((prints, 64), np.int64), 0
    for h in shingle_hashes(raw, words):
        total += len(h)
        for i in range(prints):
            count[i] += _bit_counts(_remixed(h, i))
    return [int(sum(1 << b for b in range(64) if 2 * c[b] > total)) for c in count]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return simhashes(_words(text), words, 1)[0]


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set: bits are added up in the bytes of eight words, 255 values at a time."""
    out = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for at in range(0, len(h), 255 * 256):
        part = h[at : at + 255 * 256]
        rows = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)]).reshape(-1, 255)
        for shift in range(8):
            sums = ((rows >> np.uint64(shift)) & lanes).sum(axis=1, dtype=np.uint64)
            out[shift::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key and ``fp`` (the 64 bits as a long) per row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _spread(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), BATCH):
                some = fp[at : at + BATCH]
                keys, of = fuzzy_keys(some, exact)
                yield pa.RecordBatch.from_arrays([pa.array(keys | (kind[at : at + BATCH][of] << 50)), pa.array(some[of].view(np.int64))], names=["key", "fp"])

    return run


def centred_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Candidate links of one bucket's distinct fingerprints, in proportion to their number at every size.

    The centre is the fingerprint nearest to the majority of each bit, where a text that all others were made from lies.
    In order of distance from it, each fingerprint is linked to the centre, and to the nearest of the WINDOW before it if
    that is NEARER by some bits: of many copies of one text few are.
    """
    raised = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    middle = np.packbits(2 * raised > len(fp), bitorder="little").view(np.uint64)[0]
    fp = fp[np.lexsort((fp, np.bitwise_count(fp ^ middle)))]
    near = np.bitwise_count(fp ^ fp[0]).astype(np.int64)
    out = [(int(fp[0]), int(x)) for x in fp[1:][near[1:] <= radius]]
    best, by = np.full(len(fp), 99), np.zeros(len(fp), np.int64)
    for back in range(1, min(WINDOW, len(fp) - 1) + 1):
        d = np.bitwise_count(fp[back:] ^ fp[:-back])
        closer = d < best[back:]
        best[back:][closer], by[back:][closer] = d[closer], np.flatnonzero(closer)
    use = (best <= radius) & ((best + NEARER <= near) | (near > radius)) & (by > 0)
    return out + [(int(fp[by[j]]), int(fp[j])) for j in np.flatnonzero(use)]


def bucket_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over distinct fingerprints that connects just those that links among them connect.

    Breadth-first: each fingerprint reached is compared with those not reached yet, so a bucket of one tight group
    costs little more than its size. Large buckets are cut by segments of the fingerprints first, one more than the
    radius has bits, of which linked ones share one: what is no tight group falls apart.
    """
    if len(fp) > LARGE and radius < 8:
        out, n = [], radius + 1
        for i in range(n):
            at, end = 64 * i // n, 64 * (i + 1) // n
            part = (fp >> np.uint64(at)) & np.uint64((1 << (end - at)) - 1)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                out += _reached(fp[order[s:e]], radius)
        return out
    return _reached(fp, radius)


def _reached(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    out = []
    rest = fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                out += [(int(x), int(y)) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def _verify(radius: int, centred: bool):
    """Links within buckets of sorted (key, fp): kind (the print's number), a, b. A bucket holds 16 bytes a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= radius]
            kinds, links = [(k[two] >> 50) & 0xFF], [np.stack([f[two], f[two + 1]], 1)]
            for s, n in zip(edge[:-1][size > 2], size[size > 2], strict=True):
                found = (centred_links if centred else bucket_links)(np.unique(f[s : s + n]), radius)
                if found:
                    links.append(np.array(found, np.uint64))
                    kinds.append(np.full(len(found), (int(k[s]) >> 50) & 0xFF, np.int64))
            both = np.concatenate(links)
            if len(both):
                kind = np.concatenate(kinds)
                both = np.sort(both, axis=1)
                order = np.lexsort((both[:, 1], both[:, 0], kind))
                kind, both = kind[order], both[order]
                new = np.concatenate([[True], (np.diff(kind) != 0) | (both[1:] != both[:-1]).any(1)])
                both = both[new].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kind[new].astype(np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["kind", "a", "b"])

        def taken() -> tuple[np.ndarray, np.ndarray]:
            k, f = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            return k, f

        for batch in batches:
            k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if cut or (held and held[-1][0][-1] != k[0]):
                held.append((k[:cut], f[:cut]))
                yield from linked(*taken())
            held.append((k[cut:], f[cut:]))
        if held:
            yield from linked(*taken())

    return run


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _met(prints: DataFrame, radius: int, exact: bool, centred: bool) -> DataFrame:
    """Distinct (kind, a, b) of fingerprints (kind, fp) that meet under a key. Rows are dealt out before they multiply."""
    n = _shuffles(prints)
    keyed = prints.distinct().repartition(n).mapInArrow(_spread(exact), "key long, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_verify(radius, centred), "kind int, a long, b long").distinct()


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (a, b) that connect the distinct fingerprints ``fp`` as all pairs within ``radius`` (four at most) do.

    A bucket's pairs aren't emitted: each bucket gives a forest. Every linked pair meets in some bucket, so components
    are the same. A bucket's distinct fingerprints (8 bytes each) are in one worker: keys of 33 bits and more split all
    but near copies of one text, of which a bucket holds those few bits apart.
    """
    if radius > RADIUS:
        raise ValueError("the segments and keys hold for a radius of four at most")
    return _met(prints.select(F.lit(0).alias("kind"), "fp"), radius, True, False).select("a", "b")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node and root (its component's least node) for every node with an edge, by alternating star contraction.

    Large-star and small-star steps keep at most as many edges as there are nodes and edges, and end after a number of
    rounds logarithmic in the nodes. A node with very many neighbours is aggregated before it moves, and the aggregate is
    written before it is joined: adaptive execution splits a hot key only in joins that aren't of one stage with one.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u <> v"), name, replaces=[cur, low])
        small_low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(small_low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, name, replaces=[large, small_low])
        # done when every node hangs on one root directly: it has one target, and no target is itself a source
        degree = new.groupBy("u").agg(F.count("*").alias("n"))
        chained = new.join(degree.select(F.col("u").alias("v")), "v", "left_semi").select("v")
        if degree.filter("n > 1").select("u").unionAll(chained).limit(1).count() == 0:
            return new.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        cur = new


def _least_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id for ``nodes`` (node, least): the least of all ``least`` that links reach."""
    return _least_at(nodes, components(edges, "simhash-cc"))


def _least_at(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The same from the root of every node with a link.

    Nodes without a link have their own; only the others move, and the least of a large component is written before it
    is joined.
    """
    named = materialize(nodes.join(roots, "node", "left"), "simhash-nodes")
    linked = named.filter("root IS NOT NULL")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return linked.join(least, "root").select("node", "component_id").unionAll(named.filter("root IS NULL").select("node", "least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """key, fp and component_id (the least key reachable over linked fingerprints, itself included) per row.

    Rows with equal fingerprints are one node, so copies cost no links. Null and empty texts have fingerprint zero and
    link like others; texts of any length are read whole, in memory of their own size and a bounded part. Rows of a
    repeated key are rows of their own, each with the fingerprint of its text; a null key is least of none. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    prints = materialize(fingerprints(docs, key, text, words), "simhash")
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min(key).alias("least")), "simhash-distinct")
    of = _least_of(nodes, links(nodes.select(F.col("node").alias("fp")), radius))
    return prints.join(of.withColumnRenamed("node", "fp"), "fp").select(key, "fp", "component_id")


# --- near copies: several fingerprints a text, candidates of any number of bits, shingles compared --------------------


def jaccard(a: str | None, b: str | None, words: int = COPY_WORDS) -> float:
    """Share of common ones among the distinct shingles of two texts; 1 if neither has a word."""
    return _share(_shingles(a, words), _shingles(b, words))


def _shingles(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(_words(text), words)]))


def _share(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _numbered(docs: DataFrame) -> DataFrame:
    """row (whole) and place, which tells rows apart however often they are read.

    Rows of Parquet files have their file and place in it; rows that were made in any other way are written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation") and "_metadata" not in docs.columns:
        try:
            at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            return docs.select(F.struct("*").alias("row"), at.alias("place"))
        except AnalysisException:  # files of another kind have no places
            pass
    return materialize(packed(docs).withColumn("place", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "copies-rows")


def _staged(rows: DataFrame, key: str, text: str, words: int, prints: int) -> DataFrame:
    """key (null ones last, then by place), hi and lo (128 bits of the word sequence), set_hi and set_lo (of the shingles)
    and the fingerprints, written."""
    from cairnlight.llm import ngram_join  # which imports this module

    def run(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        known = ngram_join._Hashes()
        for kept, texts in parts:
            raw = [_words(t.as_py()) for t in texts]
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in raw), np.int64).reshape(-1, 2)
            found = np.array([simhashes(w, words, prints) for w in raw], np.uint64).reshape(len(raw), prints)
            sets = np.array([ngram_join._identity(ngram_join.shingles(t.as_py(), words, known)) for t in texts], np.int64).reshape(len(raw), 2)
            yield kept, [*(pa.array(np.ascontiguousarray(x[:, i])) for x in (same, sets) for i in (0, 1)), *(pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(prints))]

    at = F.col(f"row.{key}")
    keyed = rows.select(F.struct(at.isNull().alias("none"), at.alias("id"), "place").alias("key"), F.col(f"row.{text}").alias("text"))
    return materialize(carried(keyed, "key", "text", "hi long, lo long, set_hi long, set_lo long, " + ", ".join(f"f{i} long" for i in range(prints)), run), "copies-prints")


def _candidates(nodes: DataFrame, prints: int) -> DataFrame:
    """Pairs of nodes (u < v) with their fewest differing bits in one print: of each bucket, links about its centre.

    Nodes that share a print hang on the least of them.
    """
    long = materialize(nodes.select("node", F.posexplode(F.array(*(f"f{i}" for i in range(prints)))).alias("kind", "fp")), "copies-prints")
    heads = materialize(long.groupBy("kind", "fp").agg(F.min("node").alias("head")), "copies-heads")
    met = materialize(_met(heads.select("kind", "fp"), COPY_BITS, False, True), "copies-met")
    same = long.join(heads, ["kind", "fp"]).filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"), F.lit(0).alias("bits"))
    half = materialize(met.join(heads.select("kind", F.col("fp").alias("a"), F.col("head").alias("u")), ["kind", "a"]).drop("head"), "copies-half")
    pairs = half.join(heads.select("kind", F.col("fp").alias("b"), F.col("head").alias("v")), ["kind", "b"])
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))
    pairs = pairs.filter("u <> v").unionAll(same).groupBy("u", "v").agg(F.min("bits").alias("bits"))
    return materialize(pairs, "copies-pairs", replaces=[long, heads, met, half])


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those (u, v) whose texts have the similarity; a text meets its pairs, hot ones split by adaptive execution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for b in batches:
            use = np.zeros(b.num_rows, bool)
            for i, (v, x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
                if v not in last:
                    last.clear()
                    last[v] = _shingles(y.as_py(), words)
                use[i] = _share(_shingles(x.as_py(), words), last[v]) >= similarity
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(use)) for c in b.columns[:2]], names=["u", "v"])

    one = pairs.select("u", "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")).hint("merge"), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")).hint("merge"), "v").select("u", "v", "x", "y")
    return two.mapInArrow(run, "u long, v long")


def _classes(rows: DataFrame, staged: DataFrame, text: str, words: int, similarity: float, prints: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (hi, lo, node), and node with component_id: the least key that verified links reach from it.

    Each node's nearest candidate is verified first; of the other candidates only those between components that these
    links leave apart are read. What meets under no key is found by the prefixes of shingle sets (``ngram_join``): all
    pairs between components that could be alike are compared, so none that has the similarity is left out.
    """
    from cairnlight.llm import ngram_join  # which imports this module

    percent = int(100 * similarity)
    if not 1 <= percent <= 100:
        raise ValueError("similarity is from 0.01 to 1")
    nodes = staged.groupBy("hi", "lo", "set_hi", "set_lo").agg(F.min("key").alias("least"), *(F.min(f"f{i}").alias(f"f{i}") for i in range(prints)))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "copies-nodes")
    edges = lambda x: x.select(F.col("u").alias("a"), F.col("v").alias("b"))

    def read(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = nodes.join(ends, "node", "left_semi").select("node", "least.place")
        return materialize(rows.select("place", F.col(f"row.{text}").alias("text")).join(wanted.hint("merge"), "place").select("node", "text"), "copies-texts")

    def alike(pairs: DataFrame) -> DataFrame:
        texts = read(pairs)
        return materialize(edges(_alike(pairs, texts, words, similarity)), "copies-more", replaces=[texts])

    pairs = _candidates(nodes, prints)
    texts = read(pairs)
    either = pairs.select(F.col("u").alias("node"), "bits", "u", "v").unionAll(pairs.select(F.col("v").alias("node"), "bits", "u", "v"))
    first = materialize(either.groupBy("node").agg(F.min(F.struct("bits", "u", "v")).alias("x")).select("x.u", "x.v").distinct(), "copies-first")
    found = materialize(_alike(first, texts, words, similarity), "copies-found")
    roots = materialize(components(edges(found), "copies-cc"), "copies-roots")
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    rest = pairs.join(first, ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
    rest = materialize(rest.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"), "copies-rest")
    links = edges(found.unionAll(materialize(_alike(rest, texts, words, similarity), "copies-more", replaces=[roots, texts, pairs])))
    heads = materialize(nodes.groupBy("set_hi", "set_lo").agg(F.min("node").alias("head"), F.count("*").alias("n")), "copies-sets")
    equal = nodes.join(heads.filter("n > 1"), ["set_hi", "set_lo"]).filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = links.unionAll(materialize(equal, "copies-equal"))
    if percent < 100:
        of = heads.select(F.col("set_hi").alias("hi"), F.col("set_lo").alias("lo"), F.col("head").alias("node"))
        postings = ngram_join.prefixes(rows, text, words, percent).join(of, ["hi", "lo"]).select("token", "node", "n", "at", "sign", "head").dropDuplicates(["token", "node"])
        postings = materialize(postings, "copies-postings")
        links = ngram_join.completed(postings, links, first.unionAll(rest), percent, alike)
        discard(postings.sparkSession, postings.written_to)
    return nodes.select("hi", "lo", "node"), _least_of(nodes.select("node", "least"), links)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY, prints: int = PRINTS) -> DataFrame:
    """key and component_id per row: components of texts whose distinct shingles are alike to ``similarity``.

    Candidates meet under Golay keys of ``prints`` fingerprints, as many bits apart as a shared key allows; those that the
    keys miss are found by prefixes of shingle sets, so components are those of all pairs. Every link is verified by
    comparing shingles. Equal word sequences (by a 128-bit hash) are one node. Null and empty texts are alike. Keys may
    be null (last) or repeated; an empty table gives no rows.
    """
    rows = _numbered(docs)
    staged = _staged(rows, key, text, words, prints)
    nodes, of = _classes(rows, staged, text, words, similarity, prints)
    named = nodes.join(of, "node").select("hi", "lo", "component_id")
    return staged.select("hi", "lo", "key").join(named, ["hi", "lo"]).select(F.col("key.id").alias(key), F.col("component_id.id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY, prints: int = PRINTS) -> DataFrame:
    """Of each component of ``near_copies`` the row with the least key stays (null ones last), as it was given.

    What is dropped grows with the corpus, so the join that drops it is a merge join at every size.
    """
    rows = _numbered(docs)
    staged = _staged(rows, key, text, words, prints)
    nodes, of = _classes(rows, staged, text, words, similarity, prints)
    named = nodes.join(of, "node").select("hi", "lo", "component_id")
    dropped = staged.select("hi", "lo", "key").join(named, ["hi", "lo"]).filter("key <> component_id").select("key.place")
    dropped = materialize(dropped, "copies-dropped", replaces=[staged])
    return rows.join(dropped.hint("merge"), "place", "left_anti").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
