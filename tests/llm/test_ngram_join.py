"""The Jaccard join against comparing every pair."""

import re
from collections import defaultdict

import numpy as np
import pytest

from cairnlight.llm import ngram_join as J
from tests.llm.conftest import ODD

DOCS = "doc_id long, text string, n long, hi string, node int, place string, token long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain(docs, percent=90):
    """Sorted (doc_id, n_shingles, component_id) by comparing every pair of sets that share a shingle."""
    sets = [plain_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    seen = set()
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                x, y = own[b], own[a]
                if (x, y) not in seen:
                    seen.add((x, y))
                    if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                        up[root(x)] = root(y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return sorted((str(d), len(s), str(min(least[root(i)], default=None))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def found(spark, docs, parts=3, **how):
    df = spark.createDataFrame([(*d, 1, "h", 2, "p", 3) for d in docs], DOCS).repartition(parts)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.linked_sets(df, **how).collect())


def changed(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"z{rng.integers(1 << 30)}"
    return out


def corpus(seed, groups, copies, length, edits):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for g in range(groups):
        base = [f"w{rng.integers(600)}" for _ in range(length)] + passage
        out += [" ".join(changed(rng, base, int(rng.integers(0, edits + 1)))) for _ in range(copies)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, groups, copies, length, edits", [(1, 12, 6, 120, 5), (2, 40, 3, 25, 2), (3, 1, 150, 200, 6), (4, 3, 40, 90, 7)])
def test_equals_comparing_every_pair(spark, seed, groups, copies, length, edits):
    docs = corpus(seed, groups, copies, length, edits)
    assert found(spark, docs) == plain(docs)


def test_links_at_the_threshold(spark):
    """Nine of ten shingles shared links; nine of eleven doesn't; chains reach further than pairs."""
    w = [f"a{i}" for i in range(40)]
    docs = [(5, " ".join(w[:11])), (4, " ".join(w[:12])), (3, " ".join(w[:13])), (9, " ".join(w[:14])), (1, " ".join(w[:9])), (2, " ".join(w[:10]).upper()), (7, " ".join(w[20:31])), (8, " ".join([*w[20:30], "x"]))]
    docs += [(20 + i, t) for i, t in enumerate(["", None, " \t", "one", "one", "one two", "ONE two", "one two three", "two one"])]
    assert found(spark, docs) == plain(docs)


def test_odd_and_repeated_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "x"), (3, "other words here"), (None, "x"), (None, "alone in here and null"), (None, None), (2, "q " * 5000), (1, " ".join(f"u{i}" for i in range(50_000)))]
    assert found(spark, docs) == plain(docs)


def test_an_empty_table(spark):
    assert J.linked_sets(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("common", [1, 2, 32])
def test_prefixes_are_the_rarest_shingles(spark, common):
    """Counts reach every set whatever is sent as common, over several batches; prefixes hold what should be in them."""
    docs = corpus(9, 15, 4, 60, 3) + [(1000 + i, " ".join(f"p{j}" for j in range(30)) + f" tail{i}") for i in range(40)]
    rows = J._numbered(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    got = defaultdict(dict)
    for r in J.prefixes(rows, "text", 3, 90, 3000, common).collect():
        got[(r.hi, r.lo)][r.token] = r.at
    sets = {J._identity(h): h for h in (J.shingles(t) for _, t in docs)}
    df = defaultdict(int)
    for h in sets.values():
        for x in h.tolist():
            df[x] += 1
    for at, h in sets.items():
        order = sorted(h.tolist(), key=lambda x: df[x])
        p = len(h) - (90 * len(h) + 99) // 100 + 1
        want = [df[x] for x in order[:p]]
        assert sorted(got[at].values()) == [i for i, c in enumerate(want) if c > 1]


def test_a_group_is_a_star_before_it_is_pairs(spark):
    """Three hundred near copies: pairs in proportion to the group, not its square."""
    docs = corpus(11, 1, 300, 250, 2)
    rows = J._numbered(spark.createDataFrame(docs, "doc_id long, text string"))
    nodes = J.sized(rows, "doc_id", "text", 3).groupBy("hi", "lo", "n").agg({"key": "min"}).selectExpr("*", "monotonically_increasing_id() AS node")
    nodes = J.materialize(nodes, "nodes")
    postings = J.materialize(J.prefixes(rows, "text", 3, 90).join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).dropDuplicates(["token", "node"]), "postings")
    assert J.stars(postings, 90).count() < 20 * len(docs)


def test_sets_just_under_the_threshold_make_few_pairs(spark):
    """Three hundred copies with four words changed each are no links; nor are their pairs verified one by one."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(250)]
    docs = [(i, " ".join(changed(rng, base, 4))) for i in range(300)]
    rows = J._numbered(spark.createDataFrame(docs, "doc_id long, text string"))
    nodes = J.sized(rows, "doc_id", "text", 3).groupBy("hi", "lo", "n").agg({"key": "min"}).selectExpr("*", "monotonically_increasing_id() AS node")
    nodes = J.materialize(nodes, "nodes")
    postings = J.materialize(J.prefixes(rows, "text", 3, 90).join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).dropDuplicates(["token", "node"]), "postings")
    alone = nodes.selectExpr("node", "node AS root")
    assert J.across(postings, alone, 90).count() < 2 * len(docs)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.op11_ngram_join(spark, sf).collect())
    assert got == plain([tuple(r) for r in docs])
