"""Ranked search over treaps against scoring everything."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cairnlight.llm import search as S
from tests.compare import same
from tests.llm.conftest import ODD

DOCS = "doc_id long, text string, score long, rank int, id string, copy int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def plain(docs, items, k=20):
    of = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = Counter(w for _, c in of for w in c)
    out = []
    for item, text in items:
        want, scored = Counter(terms(text)), []
        for doc, c in of:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(length, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in want.items() if w in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard, block, at_once", [(3_000_000, 4 << 20, 256), (300, 200, 2)])
def test_equals_scoring_everything(spark, monkeypatch, shard, block, at_once):
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % min(int(rng.zipf(1.3)), 400)
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in range(400)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(7, "w3 w4 W5"), (7, "w3 w4 W5"), (None, "w3 w4 w5"), (None, None)] + [(2000 + i, "w3 w4 w5") for i in range(30)]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 30))))) for i in range(15)] + [(20, None), (21, ""), (22, "!!"), (3, "w3 w3 x"), (3, "w3 w3 x"), (None, "one TWO é😀é"), (23, "nowhere")]
    df = spark.createDataFrame([(*d, 1, 2, "i", 3) for d in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    assert found(S.search(df, q, block_bytes=block)) == plain(docs, items)


def test_subtrees_are_pruned():
    rng = np.random.default_rng(2)
    n = 20_000
    term = np.repeat(np.arange(3), n)
    doc = np.tile(np.arange(n), 3)
    impact = rng.integers(1, 1000, 3 * n) ** 3
    t = S.Treaps(term, doc, impact, n)
    docs, scores, seen = t.best(np.arange(3), np.array([1, 2, 1]), 20)
    total = impact[:n] + 2 * impact[n : 2 * n] + impact[2 * n :]
    order = np.lexsort((np.arange(n), -total))[:20]
    assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert seen < n / 4
    for root in t.root.values():  # heap order below every root
        stack = [root]
        while stack:
            x = stack.pop()
            for y in (t.left[x], t.right[x]):
                if y >= 0:
                    assert t.impact[y] <= t.impact[x]
                    stack.append(y)


def test_sql_twin(spark, sf):
    same(spark, S.op12_search, S.ORACLE_SQL, sf)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1, 2, "", 3)], DOCS)
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(none, q).collect() == [] and S.search(some, q.limit(0)).collect() == []
    assert [tuple(r) for r in S.search(some, q).collect()] == [(1, 1, 1, S.weight(1, 1) * (10**9 // (1000 + 12 * 100)))]
