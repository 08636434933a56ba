"""Learning from overrides and reviews: plain counts, and twice is as once."""

import json
import re
from collections import Counter

from pyspark.sql import functions as F

from cairnlight.operators import learning as L

LEDGER = "version string, kind string, key string, n long"


def test_patterns_of_overrides(spark):
    rows = [("approved", "LOW", "p", "c", None)] * 3 + [("approved", "HIGH", "p", "c", "s"), ("rejected", "IMPORTANT", "p", "c", "s"), ("rejected", "HIGH", "p\"é", "x", "s"), ("rejected", "LOW", "p", "c", "s"), (None, "LOW", "p", "c", "s"), ("approved", "LOW", None, "c", "")]
    got = {(r.kind, tuple(json.loads(r.key).items())): r.n for r in L.override_patterns(spark.createDataFrame(rows, "user_decision string, kernel_decision string, problem_class string, concept string, strategic_value string")).collect()}
    boost = lambda p: ("boost", (("problem_class", p), ("concept", "c"), ("strategic_value", "")))
    assert got == {boost("p"): 3, boost(""): 1, ("penalty", (("problem_class", "p"),)): 1, ("penalty", (("problem_class", "p\"é"),)): 1}


def plain(text, core, known):
    w = re.findall("[a-z]+", (text or "").lower())
    grams = {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
    return {g for g in grams if any(c in g for c in core) and g not in known}


def test_phrases_tell_accepted_from_rejected(spark):
    texts = [("The ionic gate of a synaptic transistor", True), ("An ionic gate, thin film", True), ("the thin film of oil", False), ("thin film", False), ("a gate", None), (None, True), ("", False), ("ionic", True), ("ionic gate " * 3, True)]
    df = spark.createDataFrame([(t, y, "k") for t, y in texts], "t string, yes boolean, key string")
    known = ("gate of",)
    got = {r.key: r.n for r in L.contrasting_phrases(df, F.col("t"), F.col("yes"), known=known).collect()}
    a, r = Counter(), Counter()
    for t, y in texts:
        if y is not None:
            (a if y else r).update(plain(t, L.DOMAIN_CORE, known))
    yes, no = sum(y is True for _, y in texts), sum(y is False for _, y in texts)
    assert got == {k: n for k, n in a.items() if n >= 2 and n * no >= 2 * r[k] * yes} and "ionic gate" in got and "thin film" not in got
    assert L.contrasting_phrases(df.limit(0), F.col("t"), F.col("yes")).collect() == []


def test_learning_twice_is_learning_once(spark):
    empty = spark.createDataFrame([], LEDGER)
    first = spark.createDataFrame([("boost", "a", 1), ("penalty", "b", 4)], "kind string, key string, n long")
    more = spark.createDataFrame([("boost", "a", 2), ("boost", "c", 1)], "kind string, key string, n long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = L.learn(empty, first, F.lit("v1"))
    assert rows(L.learn(one, first, F.lit("v1"))) == rows(one) == [("v1", "boost", "a", 1), ("v1", "penalty", "b", 4)]
    assert rows(L.learn(one, more, F.lit("v1"))) == rows(one)  # a version is learned whole or not at all
    two = L.learn(one, more, F.lit("v2"))
    assert rows(L.learn(two, first, F.lit("v1"))) == rows(two) and len(rows(two)) == 4
    assert rows(L.boosts(two)) == [("a", 3)]
