"""Paged fetches, many-pattern matching and flattened reasoning over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import terms as M
from cairnlight.plans.registry import query, table
from cairnlight.sources import pages as P


@query("paged_range_fetch", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1993-03-01' AND o_orderdate < TIMESTAMP '1997-07-01' GROUP BY o_custkey")
def paged_range_fetch(spark, sf_dir):
    """The first work of each key in a range of days, fetched in pages of ten thousand rows."""
    works = P.fetch_range(spark, f"{sf_dir}/orders.parquet", "o_orderdate", "1993-03-01", "1997-06-30", rows=10_000)
    return P.first_by_key(works.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


_PHRASE = "array_to_string(string_split(text, ' ')[1:3], ' ')"


@query("many_term_matches", f"""WITH t AS (SELECT DISTINCT item_id AS name, lower({_PHRASE}) AS term FROM benchmark), d AS (SELECT doc_id, lower(text) AS s FROM documents WHERE text <> '')
SELECT DISTINCT doc_id, name FROM d, t WHERE contains(s, term) OR contains(term, s)""")
def many_term_matches(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.lower(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("term"))
    return M.matches(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), terms)


_HINTS = {"cold": ("winter",), "ring": ("fastener", "bolt"), "any small widget or so": ("little part",)}
_GENERIC, _TOPICS = ("bolt", "plate"), ("Widget wire", "Zinc", "gear and ring")
_TOKENS = "list_filter(list_transform(regexp_split_to_array(n, '[\\s+/(),;-]+'), lambda w: regexp_replace(w, '^[''\"]+|[''\"]+$', '', 'g')), lambda w: length(w) >= 4 AND w NOT IN ('bolt', 'plate'))"
_GIVEN = " || ".join(f"CASE WHEN contains(n, '{k}') OR contains('{k}', n) THEN [{', '.join(repr(h) for h in hs)}] ELSE []::VARCHAR[] END" for k, hs in _HINTS.items())


@query("trajectory_keywords", f"""WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part), k AS (SELECT p_partkey, {_TOKENS} || {_GIVEN} AS ks FROM p),
a AS (SELECT p_partkey, ks || list_filter(['widget wire', 'zinc', 'gear and ring'], lambda t: len(list_filter(ks, lambda x: contains(t, x) OR contains(x, t))) > 0) AS ks FROM k),
u AS (SELECT DISTINCT p_partkey, unnest(ks) AS w FROM a)
SELECT p_partkey, coalesce(string_agg(w, '|' ORDER BY length(w) DESC, w), '') AS keywords FROM p LEFT JOIN u USING (p_partkey) GROUP BY 1""")
def trajectory_keywords(spark, sf_dir):
    words = M.expanded_keywords(F.col("p_name"), _HINTS, _GENERIC, _TOPICS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, "|").alias("keywords"))


_MADE = """'{"causal":{"question":"' || event_type || '?","none":null,"steps":[{"k":' || props || '},["' || user_id || '", true]]},"empty":" ","value":' || event_id || '}'"""


@query("reasoning_leaves", "SELECT event_id, event_type || '?|' || json_extract_string(props, '$.k') || '|' || user_id || '|True|' || event_id AS leaves FROM events")
def reasoning_leaves(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_MADE).alias("j"))
    return rows.select("event_id", F.array_join(T.json_leaves(F.col("j")), "|").alias("leaves"))
