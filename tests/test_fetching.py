"""Paged fetches, many-pattern matching, keywords of subjects and flattened JSON, against plain versions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import terms as M
from cairnlight.sources import pages as P


@pytest.fixture(scope="module")
def works(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("works") / "w.parquet")
    rows = [(i, f"10.1/{i % 70}" if i % 11 else None, f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", "2019-01-01" if i % 2 else "2020-06-01", "x") for i in range(500)]
    spark.createDataFrame(rows, "id long, doi string, day string, made string, title string").selectExpr("id", "doi", "day", "CAST(made AS date) AS made", "title").coalesce(3).write.option("parquet.block.size", 2048).parquet(path)
    return path, rows


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_pages_are_partitions(spark, works, size):
    path, rows = works
    want = [r for r in rows if "2024-03-05" <= r[2] <= "2024-07-20"]
    got = P.fetch_range(spark, f"file://{path}", "day", "2024-03-05", "2024-07-20", rows=size)
    held = got.select("id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.id for r in held) == sorted(r[0] for r in want)
    pages = Counter(r.p for r in held)
    assert len(pages) == -(-len(want) // size) == got.rdd.getNumPartitions() and sorted(pages.values())[1:] == [size] * (len(pages) - 1)


def test_at_most_so_many_pages(spark, works):
    assert P.fetch_range(spark, works[0], "day", "2024-01-01", "2024-12-31", rows=40, pages=3).count() == 120


def test_fallback_when_no_page_has_rows(spark, works):
    path, rows = works
    assert P.fetch_range(spark, path, "day", "2019-01-01", "2019-12-31").count() == 0
    got = P.fetch_range(spark, path, "day", "2019-01-01", "2019-12-31", fallback="made", rows=50)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in rows if r[3].startswith("2019")]
    assert P.fetch_range(spark, path, "day", "2024-02-01", "2024-01-01").count() == 0  # an empty range


def test_filters_on_the_date_cut_fewer_pages(spark, works):
    path, _ = works
    whole = P.fetch_range(spark, path, "made", "2000-01-01", "2030-01-01", rows=50)
    some = whole.filter("made >= DATE'2020-01-01'")
    assert whole.rdd.getNumPartitions() == 10 and some.rdd.getNumPartitions() == 5 and some.count() == 250


def test_first_work_of_each_key(spark, works):
    path, rows = works
    got = P.first_by_key(P.fetch_range(spark, path, "day", "2024-01-01", "2024-12-31", rows=90), "doi", "id").collect()
    first = {}
    for r in rows:
        if r[1]:
            first.setdefault(r[1], r[0])
    assert {r.doi: r.id for r in got} == first


@pytest.mark.parametrize("chars", [1_000_000, 40])
def test_matches_in_both_directions(spark, chars):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    texts = [(i % 90, word(rnd.randrange(0, 30))) for i in range(100)] + [(200, None), (201, ""), (202, "ab"), (None, "ab")]
    terms = [(f"n{i % 13}", word(rnd.randrange(0, 9))) for i in range(60)] + [("none", None), ("long", "x" * 500 + "ab")]
    want = {(k, n) for k, t in texts for n, p in terms if t and p and (p in t or t in p)}
    df = spark.createDataFrame(texts, "id long, name string")
    got = M.matches(df, "id", F.col("name"), spark.createDataFrame(terms, "name string, term string"), block_chars=chars)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    one_way = M.matches(df, "id", F.col("name"), spark.createDataFrame(terms, "name string, term string"), False, chars)
    assert {tuple(r) for r in one_way.collect()} == {(k, n) for k, t in texts for n, p in terms if t and p and p in t}


def test_ten_thousand_terms_in_one_pass(spark):
    terms = spark.range(10_000).selectExpr("id AS name", "concat('t', id, 'z') AS term")
    rows = spark.range(300).selectExpr("id", "concat('a t', id * 30, 'z and t', id * 7, 'z') AS t")
    df = M.matches(rows, "id", F.col("t"), terms)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {tuple(r) for r in df.collect()} == {(i, n) for i in range(300) for n in (i * 30, i * 7)}


def test_matching_nothing(spark):
    none = spark.createDataFrame([], "name string, term string")
    rows = spark.createDataFrame([(1, "a")], "id long, t string")
    assert M.matches(rows, "id", F.col("t"), none).collect() == []
    assert M.matches(rows.limit(0), "id", F.col("t"), spark.createDataFrame([("n", "a")], "name string, term string")).collect() == []


def test_keywords_of_a_subject(spark):
    name = "Nano-plasmonic 'sensing' systems/for (RNA) probes"
    got = spark.range(1).select(M.expanded_keywords(F.lit(name), {"plasmon": ["surface wave", "spr"], "rna": ["transcript"], "nothing": ["x"]}, ["systems"], ["RNA probes and more", "zzz", "Surf"]).alias("k")).first().k
    assert set(got) == {"surface wave", "spr", "transcript", "nano", "plasmonic", "sensing", "probes", "rna probes and more", "surf"}
    assert [len(k) for k in got] == sorted((len(k) for k in got), reverse=True)
    assert spark.range(1).select(M.expanded_keywords(F.lit(None).cast("string"), {}, [], []).alias("k")).first().k == []


def leaves(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [] if value is None or not str(value).strip(" ") else [str(value).strip(" ")]


def test_json_is_walked_at_any_depth(spark):
    deep = "end"
    for i in range(50):
        deep = {f"k{i}": deep} if i % 2 else [deep, i, None]
    odd = [deep, {"b": 1, "a": [True, False, None, {"x": [], "y": {}, "z": ""}], "c\"d:": "quote \" colon: {[,]}", "e": "tab\there é \\ /", "f": -12, "g": " pad "}, [], {}, "text", 7, None, True, ["a" * 50_000], [[["x"]]], {"a": {"a": {"a": "a"}}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(odd)] + [(90, None), (91, "{"), (92, ""), (93, "not json")]
    df = spark.createDataFrame(rows, "i int, j string").select("i", T.json_leaves(F.col("j")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert all(got[i] == leaves(v) for i, v in enumerate(odd))
    assert all(got[i] == [] for i in (90, 91, 92, 93))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_reasoning_text(spark):
    row = spark.createDataFrame([('{"causal":{"question":"Why <b>NOT</b>?"},"n":3}', "Title", None)], "j string, t string, a string")
    assert row.select(T.reasoning_text(F.col("j"), F.col("t"), F.col("a")).alias("s")).first().s == "title why  not ? 3"
