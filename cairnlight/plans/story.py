"""Arcs and their story graphs over parts: a part is a trajectory, its type a concept, its brand a paper."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import story as Y
from cairnlight.plans.registry import query, table

_TERMS = {"arc-cold": ("cold", "blue"), "arc-wide": ("widget", "bolt"), "arc-none": ("no such name",)}
_TWIN = """WITH t AS (SELECT p_partkey AS pos, p_name AS name, p_size AS ev, CASE p_size % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'active' WHEN 2 THEN 'watching' ELSE 'odd' END AS status, CASE WHEN p_partkey % 3 = 2 THEN 'gap ' || p_partkey ELSE '' END AS missing, p_type AS c, p_brand AS b FROM part),
a AS (SELECT 'arc-cold' AS arc, * FROM t WHERE contains(lower(name), 'cold') OR contains(lower(name), 'blue') UNION ALL SELECT 'arc-wide', * FROM t WHERE contains(lower(name), 'widget') OR contains(lower(name), 'bolt')),
cs AS (SELECT arc, c, max(ev) AS n FROM a GROUP BY ALL), ct AS (SELECT arc, string_agg(c || '=' || n, ',' ORDER BY n DESC, c DESC) AS concepts, sum(n) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY n DESC, c DESC) AS r FROM cs) WHERE r <= 5 GROUP BY 1), cn AS (SELECT arc, count(*) AS concept_count FROM cs GROUP BY 1),
ps AS (SELECT arc, lower(b) AS k, min(pos) AS pos FROM a GROUP BY ALL), pt AS (SELECT arc, string_agg(k, ',' ORDER BY pos) AS papers FROM (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos) AS r FROM ps) WHERE r <= 8 GROUP BY 1), pn AS (SELECT arc, count(*) AS paper_count FROM ps GROUP BY 1),
s AS (SELECT arc, sum(ev) AS summed, CASE WHEN bool_or(status = 'active') THEN 'active' ELSE 'watching' END AS status, coalesce(arg_min(missing, pos) FILTER (missing <> ''), '') AS missing_link FROM a GROUP BY 1),
arcs AS (SELECT arc, status, greatest(summed, shown + paper_count)::BIGINT AS evidence_count, paper_count, concept_count, missing_link, concepts, papers FROM s JOIN ct USING (arc) JOIN cn USING (arc) JOIN pt USING (arc) JOIN pn USING (arc))"""
_ALL = "(VALUES " + ", ".join(f"({i}, '{n[0]}', '{n[3]}')" for i, n in enumerate(Y.NODES)) + ") AS n(place, node_id, state)"


def _arcs(spark, sf_dir):
    size = F.col("p_size") % 4
    status = F.when(size == 0, "seed").when(size == 1, "active").when(size == 2, "watching").otherwise("odd")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), status.alias("status"), F.col("p_size").alias("evidence_count"), F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("gap "), F.col("p_partkey").cast("string"))).otherwise("").alias("missing_link"),
        F.lit("").alias("next_move"), F.array(F.struct(F.col("p_type").alias("name"), F.col("p_size").alias("appearances"))).alias("concepts"), F.array(F.struct(F.col("p_brand").alias("doi"), F.lit("").alias("title"))).alias("papers"))
    return Y.arcs(rows, _TERMS)


@query("story_nodes", _TWIN + f" SELECT arc, node_id, CASE WHEN node_id = 'story-conceptual-shift' THEN '' ELSE missing_link END AS missing_link, state AS status, evidence_count, paper_count, concept_count, concepts, CASE WHEN node_id = 'story-conceptual-shift' THEN array_to_string(string_split(papers, ',')[1:2], ',') ELSE papers END AS papers FROM arcs, {_ALL}")
def story_nodes(spark, sf_dir):
    rows = Y.nodes(_arcs(spark, sf_dir), {t: F.concat(F.lit(f"{t} of "), F.col("arc")) for _, t, _, _ in Y.NODES})
    listed = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select("arc", "node_id", "missing_link", "status", "evidence_count", "paper_count", "concept_count", listed("concepts", lambda x: F.concat_ws("=", x["name"], x["appearances"].cast("string"))).alias("concepts"), listed("papers", lambda x: F.lower(x["doi"])).alias("papers"))


@query("story_edges", _TWIN + " SELECT arc, source, target, 'evolves_to' AS type FROM arcs, (VALUES " + ", ".join(f"('{a[0]}', '{b[0]}')" for a, b in zip(Y.NODES, Y.NODES[1:])) + ") AS e(source, target)")
def story_edges(spark, sf_dir):
    return Y.edges(_arcs(spark, sf_dir))
