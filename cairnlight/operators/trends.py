"""Timelines, co-occurrence, drift and gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight import vocab as V
from cairnlight.functions import text as T
from cairnlight.operators import scoring as S


def timeline(rows: DataFrame, year: Column, text: Column, dictionary: Mapping[str, int]) -> DataFrame:
    """(year, phrase, n): rows of each year that hold each phrase; a row counts once per phrase."""
    hits = rows.select(year.alias("year"), F.explode(S.matched(text, dictionary)).alias("d"))
    return hits.groupBy("year", F.col("d.phrase").alias("phrase")).agg(F.count("*").alias("n"))


def trajectory(counts: DataFrame, recent: Sequence[int], earlier: Sequence[int]) -> DataFrame:
    """Means over two fixed sets of years (absent years count 0) and the class they give."""
    part = lambda years: F.sum(F.when(F.col("year").isin(*years), F.col("n")).otherwise(0)) / F.lit(len(years))
    out = counts.groupBy("phrase").agg(F.sum("n").alias("total"), part(recent).alias("recent"), part(earlier).alias("earlier"))
    kind = F.when((F.col("earlier") < 1) & (F.col("recent") >= 2), "emerging").when(F.col("recent") > 1.3 * F.col("earlier"), "rising").when(F.col("recent") < 0.7 * F.col("earlier"), "declining").otherwise("stable")
    return out.select("phrase", "total", F.round("recent", 4).alias("recent"), F.round("earlier", 4).alias("earlier"), kind.alias("trajectory"))


def blind_spot_bigrams(rows: DataFrame, text: Column, generic: Sequence[str], known: Sequence[str], k: int) -> DataFrame:
    """The bigrams of long words most documents hold, without generic words and words of the dictionary."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit("[a-z]{5,}"), F.lit(0)), lambda w: ~w.isin(*generic, *known))
    grams = rows.select(F.explode(F.array_distinct(T.ngrams(tokens, 2))).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "bigram").limit(k)


def drift(rows: DataFrame, concept: str, text: str, clusters=V.DRIFT_CLUSTERS, flag: float = 0.35) -> DataFrame:
    """Per concept the share of uses outside its largest cluster; needs two uses and two clusters to be drift."""
    kind = S.first_rule(F.lower(T.blank(F.col(text))), clusters, "other")
    by = rows.groupBy(concept, kind.alias("cluster")).agg(F.count("*").alias("n"))
    out = by.groupBy(concept).agg(F.sum("n").alias("total"), F.count("*").alias("n_clusters"), F.max("n").alias("top"), F.max_by("cluster", F.struct("n", "cluster")).alias("dominant"))
    score = F.when((F.col("total") < 2) | (F.col("n_clusters") < 2), 0.0).otherwise(S.half_up(1 - F.col("top") / F.col("total"), 2))
    return out.select(concept, "total", "n_clusters", "dominant", score.alias("drift_score"), (score >= flag).alias("drift"))


def cooccurrence(rows: DataFrame, tags: Column) -> DataFrame:
    """(a, b, n) of tag pairs a < b within a row's own tags; a row's tags are few, pairs are formed row by row."""
    rows, t = rows.select(F.array_sort(F.array_distinct(tags)).alias("_t")), F.col("_t")
    pairs = F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def accumulate(rows: DataFrame, key: str, kind: Column, source: Column) -> DataFrame:
    """Evidence, discoveries, validations and distinct sources per trajectory."""
    return rows.groupBy(key).agg(F.count("*").alias("evidence"), F.count_if(kind == "Discovery").alias("discoveries"), F.count_if(kind == "Validation").alias("validations"), F.count_distinct(source).alias("sources"))


def feedback(rows: DataFrame, key: str, result: Column) -> DataFrame:
    """More violations than supports lower a trajectory; supports without violations raise it."""
    s, v = F.count_if(result == "supported"), F.count_if(result == "violated")
    return rows.groupBy(key).agg(s.alias("supports"), v.alias("violations"), F.when(v > s, "Decreasing").when((s > 0) & (v == 0), "Increasing").otherwise("Stable").alias("confidence"))
