"""Learning from overrides and reviews over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import learning as L
from cairnlight.plans.registry import query, table

def _overrides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    user = F.when(F.col("l_linenumber") % 2 == 0, "approved").otherwise("rejected")
    kernel = F.when(F.col("l_linestatus") == "O", "LOW").otherwise("HIGH")
    return li.select(user.alias("user_decision"), kernel.alias("kernel_decision"), F.col("l_returnflag").alias("problem_class"), F.concat(F.lit("q"), (F.col("l_quantity") % 5).cast("int").cast("string")).alias("concept"), F.col("l_linestatus").alias("strategic_value"))


@query("override_patterns", """WITH o AS (SELECT l_linenumber % 2 = 0 AS yes, l_linestatus = 'O' AS low, l_returnflag AS p, 'q' || (l_quantity % 5)::INT AS c, l_linestatus AS s FROM lineitem)
SELECT 'boost' AS kind, '{"problem_class":"' || p || '","concept":"' || c || '","strategic_value":"' || s || '"}' AS key, count(*) AS n FROM o WHERE yes AND low GROUP BY ALL
UNION ALL SELECT 'penalty', '{"problem_class":"' || p || '"}', count(*) FROM o WHERE NOT yes AND NOT low GROUP BY ALL""")
def override_patterns(spark, sf_dir):
    return L.override_patterns(_overrides(spark, sf_dir))


_CORE = ("ther", "tion", "hati")


@query("review_phrases", """WITH w AS (SELECT doc_id % 3 = 0 AS yes, doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE lang = 'en'),
g AS (SELECT yes, doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS key FROM w),
c AS (SELECT key, count(*) FILTER (yes) AS a, count(*) FILTER (NOT yes) AS r FROM g WHERE (contains(key, 'ther') OR contains(key, 'tion') OR contains(key, 'hati')) AND key NOT IN ('the ther') GROUP BY 1)
SELECT 'keyword' AS kind, key, a AS n FROM c, (SELECT count(*) FILTER (yes) AS all_a, count(*) FILTER (NOT yes) AS all_r FROM w) WHERE a >= 2 AND a * greatest(all_r, 1) >= 2.0 * r * all_a""")
def review_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return L.contrasting_phrases(docs, F.col("text"), F.col("doc_id") % 3 == 0, _CORE, ("the ther",))
