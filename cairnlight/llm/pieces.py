"""SentencePiece encoding, decoding and token counts by one forward pass over shared prefixes.

The distinct marked words of a batch are sorted; neighbours in that order share trie paths, so walking the list while
keeping the state of the common prefix is the depth-first traversal of their trie, and each prefix is scored once.

A unigram model's state is the Viterbi score and last piece of a prefix. The public SentencePiece vocabulary is of kind
BPE, for which a best score does not give the library's result. There the state is the last piece of the prefix's BPE
encoding: it is the one piece that ends the prefix, and that merging would leave apart from the last piece before it.
Ids equal the public library's for that kind, and a public unigram encoder's for the other (tests).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import Part, carried, table

MARK = "▁"
#: Where the public vocabulary lies, unless a caller names another model.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of what a worker keeps: code points of words with their pieces (a parameter, as it outlives the task and stays
#: beside whatever the executor does next), checked pairs of pieces (short each), code points of text per walk (or one text).
KEPT_CHARS, KEPT_PAIRS, WALK_CHARS = 6_000_000, 300_000, 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores. ``kind``: bpe or unigram. ``bytes_from``: id of byte 0's piece, or -1 without byte fallback."""

    kind: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    unknown: int
    bytes_from: int


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            b = raw[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[i : i + n]
            i += n


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file; its normalizer must be the identity with a dummy prefix and all blanks kept."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = dict(_fields(sp.serialized_model_proto()))
    trainer, norm = dict(_fields(parts[2])), dict(_fields(parts[3]))
    if norm.get(1) != b"identity" or norm.get(2) or norm.get(3, 1) != 1 or norm.get(4, 1) != 0:
        raise ValueError("only models with the identity normalizer, a dummy prefix and kept blanks are supported")
    n = sp.vocab_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("pieces that cross the start of a word are not supported")
    plain = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n))
    first = next((i for i in range(n) if sp.is_byte(i)), -1)
    return Vocabulary({1: "unigram", 2: "bpe"}[trainer.get(3, 1)], pieces, tuple(sp.get_score(i) for i in range(n)), plain, sp.unk_id(), first)


class Encoder:
    """Encodes words of one vocabulary; keeps a bounded memory of words seen."""

    def __init__(self, vocabulary: Vocabulary, kept_chars: int = KEPT_CHARS) -> None:
        v = self.vocabulary = vocabulary
        self.kept_chars = kept_chars
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.plain[i]}
        self.score = {p: v.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.score.values(), default=0.0) - 10.0  # an unknown character's score, as the library has it
        self.pairs: dict[tuple[str, str], bool] = {}
        # by a prefix's last three characters, the lengths of pieces that end so (and two, if the last two are a piece), longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], {2} if p[-2:] in self.ids else set()).add(len(p))
        self.ends = {k: tuple(sorted(n, reverse=True)) for k, n in ends.items()}
        # words end before a mark, and where a letter or digit meets another sign that no piece has beside it
        joined = "".join(sorted({a for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalnum() and not b.isalnum()}))
        sign, letter = rf"(?:[^\w{MARK}]|[_{joined}])", rf"[^\W_{joined}]"
        self.units = re.compile(rf"{MARK}+{sign}*+{letter}*+|{sign}++{letter}*+|{letter}++")
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers side by side
        self.counts: dict[str, int] = {}
        self.held = {True: 0, False: 0}  # code points of the words that counts and words hold
        self.raw = [bytes([i - v.bytes_from]) if v.bytes_from >= 0 and v.bytes_from <= i < v.bytes_from + 256 else (p.encode() if v.plain[i] else b"") for i, p in enumerate(v.pieces)]

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Merging leaves ``left`` and ``right`` as they are when they are neighbours."""
        key = (left, right)
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            out = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return out

    def _extend_bpe(self, word: str, last: list[str], begin: int) -> None:
        """Append the last pieces of word[:begin], ..., word."""
        ids, ends, pairs, none = self.ids, self.ends, self.pairs, ()
        for i in range(begin, len(word) + 1):
            if i > 2:
                lengths = ends.get(word[i - 3 : i])
                if lengths is None:
                    lengths = (2,) if word[i - 2 : i] in ids else none
            else:
                lengths = (2,) if i == 2 and word[:2] in ids else none
            for n in lengths:
                if n <= i:
                    piece = word[i - n : i]
                    if piece in ids:
                        key = (last[i - n], piece)
                        fits = pairs.get(key)
                        if fits or (fits is None and self.apart(*key)):
                            last.append(piece)
                            break
            else:
                last.append(word[i - 1])

    def _extend_unigram(self, word: str, last: list[str], best: list[float], i: int) -> None:
        top, end = None, word[i - 1]
        for n in range(min(i, self.longest), 0, -1):  # of equal scores the longest last piece stays, as in the library
            piece = word[i - n : i]
            s = self.score.get(piece, self.floor if n == 1 else None)
            if s is not None and (top is None or best[i - n] + s > top):
                top, end = best[i - n] + s, piece
        last.append(end)
        best.append(top)

    def _cost(self, piece: str) -> int:
        return 1 if piece in self.ids or self.vocabulary.bytes_from < 0 else len(piece.encode())

    def walk(self, words: Iterable[str], count_only: bool = False) -> Iterator[tuple[str, tuple[int, ...] | int]]:
        """(word, ids) or (word, count) of distinct words, in sorted order; each shared prefix is scored once."""
        before, last, best, counts = "", [""], [0.0], [0]
        bpe = self.vocabulary.kind == "bpe"
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :]
            if bpe:
                self._extend_bpe(word, last, same + 1)
            else:
                del best[same + 1 :]
                for i in range(same + 1, len(word) + 1):
                    self._extend_unigram(word, last, best, i)
            before = word
            if count_only:
                del counts[same + 1 :]
                for i in range(same + 1, len(word) + 1):
                    counts.append(counts[i - len(last[i])] + self._cost(last[i]))
                yield word, counts[-1]
            else:
                yield word, self._trace(last, len(word))

    def _trace(self, last: list[str], i: int) -> tuple[int, ...]:
        out: list[int] = []
        while i:
            piece = last[i]
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.vocabulary.bytes_from >= 0:
                out.extend(self.vocabulary.bytes_from + b for b in reversed(piece.encode()))
            elif not out or out[-1] != self.vocabulary.unknown:  # the library joins unknown neighbours
                out.append(self.vocabulary.unknown)
            i -= len(piece)
        return tuple(reversed(out))

    def split(self, text: str | None) -> list[str]:
        """Marked words of a text, blanks as marks: no piece of any text's encoding crosses their borders."""
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def of(self, texts: list[list[str]], count_only: bool = False) -> dict:
        """What each distinct word of the split texts gives; words kept from earlier batches aren't walked again."""
        kept = self.counts if count_only else self.words
        distinct = set(chain.from_iterable(texts))
        fresh = distinct.difference(kept)
        size = sum(map(len, fresh))
        if self.held[count_only] + size > self.kept_chars:  # what one batch has may be more: then it goes with the next
            kept.clear()
            fresh, size = distinct, sum(map(len, distinct))
            self.held[count_only] = 0
        self.held[count_only] += size
        found = self.walk(fresh, count_only)
        kept.update(found if count_only else ((w, array("i", ids).tobytes()) for w, ids in found))
        return kept

    def forget(self) -> None:
        """Lets the known words go."""
        for known in (self.words, self.counts, self.pairs):
            known.clear()
        self.held = {True: 0, False: 0}

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_AT_WORK: dict[tuple[int, int], Encoder] = {}


def encoder_of(vocabulary: Vocabulary, kept_chars: int = KEPT_CHARS) -> Encoder:
    """This worker process's encoder; later tasks in the same process find its words known."""
    key = hash(vocabulary), kept_chars
    if key not in _AT_WORK:
        _AT_WORK.clear()
        _AT_WORK[key] = Encoder(vocabulary, kept_chars)
    return _AT_WORK[key]


def _groups(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for kept, column in parts:
        begin, texts, size, n = 0, [], 0, len(column)
        for i, text in enumerate(column):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= WALK_CHARS or i + 1 == n:
                yield kept.slice(begin, i + 1 - begin), texts
                begin, texts, size = i + 1, [], 0


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", kept_chars: int = KEPT_CHARS, forget: bool = False) -> DataFrame:
    """key, ids (array<int>) and exact: decoding the ids gives the text again.

    With ``forget`` a task's known words go when it ends, for plans whose other stages need the workers' memory.

    Null and empty texts have no ids (exact holds for both: null decodes to nothing). A text that holds the mark U+2581
    itself comes back with a blank in its place, as from the library, so it isn't exact. Null and repeated keys are rows
    of their own, very long texts are whole, an empty table gives no rows; other columns, whatever their names, are not
    read (for whole rows pass ``packed`` ones).
    """

    def run(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        encoder = encoder_of(vocabulary, kept_chars)
        try:
            yield from encoded(encoder, parts)
        finally:
            if forget:
                encoder.forget()

    def encoded(encoder: Encoder, parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for kept, texts in _groups(parts):
            words = [encoder.split(t) for t in texts]
            known = encoder.of(words)
            rows = [np.frombuffer(b"".join(map(known.__getitem__, w)), np.int32) for w in words]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            exact = [encoder.decode(ids.tolist()) == (t or "") for ids, t in zip(rows, texts, strict=True)]
            values = np.concatenate([np.empty(0, np.int32), *rows])
            yield kept, [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())), pa.array(exact, pa.bool_())]

    return carried(docs, key, text, "ids array<int>, exact boolean", run)


def decode(rows: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each row of ids; null ids give null."""
    part = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = part.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return part.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words (marked words) and n_tokens (as many as ``encode`` gives ids) per row.

    Null and empty texts count 0; rows, keys, long texts, empty tables and other columns as in ``encode``.
    """

    def run(parts: Iterator[Part]) -> Iterator[tuple[pa.RecordBatch, list]]:
        encoder = encoder_of(vocabulary)
        for kept, texts in _groups(parts):
            words = [encoder.split(t) for t in texts]
            known = encoder.of(words, count_only=True)
            yield kept, [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())]

    return carried(docs, key, text, "n_words long, n_tokens long", run)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), load(model))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


def op6_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), load(model))


QUERIES = {"op5_sentencepiece": op5_sentencepiece, "op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
