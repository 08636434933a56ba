"""Validation of stored records over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlight.operators import records as R
from cairnlight.plans.registry import query, table

_JSON = """'{"id":"' || event_id || '","target_type":"' || CASE WHEN event_id % 3 = 0 THEN 'paper' ELSE event_type END || '","target_id":' ||
 CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '0' ELSE '"t"' END || ',"override_type":"' || CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE '' END || '","created_at":"x"}'"""
_TARGETS, _TYPES = (", ".join(f"'{v}'" for v in values) for values in (R.OVERRIDE_TARGET, R.OVERRIDE_TYPE))


@query("override_record_issues", f"""WITH r AS (SELECT event_id, ({_JSON})::JSON AS j FROM events),
f AS (SELECT event_id, j, unnest(['id', 'target_type', 'target_id', 'override_type', 'user_reason', 'created_at']) AS f FROM r)
SELECT event_id, 'override' AS kind, '$.override.' || f AS path, 'is required' AS message FROM f WHERE coalesce(json_type(j, '$.' || f), 'NULL') = 'NULL' OR json_extract_string(j, '$.' || f) IN ('', '[]')
UNION ALL SELECT event_id, 'override', '$.override.target_type', 'invalid override target type' FROM r WHERE json_extract_string(j, '$.target_type') NOT IN ({_TARGETS})
UNION ALL SELECT event_id, 'override', '$.override.override_type', 'invalid override type' FROM r WHERE json_extract_string(j, '$.override_type') NOT IN ({_TYPES})""")
def override_record_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_JSON).alias("r"))
    return R.record_issues(rows, "event_id", "r", R.KINDS["override"])


#: Rules that text in place of a list, number, object or known word breaks, whether the field is there or not.
_ALWAYS = {
    k: [(f, m) for f, _, m in kind.choices] + [(f, "must be boolean") for f in kind.flags] + [(f, "must be a number from 0 to 1") for f in kind.shares] + [(f, "must be a list") for f in kind.lists] + [(f, "must be an object") for f in kind.objects]
    for k, kind in R.KINDS.items()
}
_KINDS = list(R.KINDS)
_QUOTED = lambda s: s.replace("'", "''")
_RECORD = "CASE event_id % 14 " + " ".join(f"WHEN {i} THEN '{{' || " + " || ',' || ".join(f"""'"{f}":' || CASE WHEN (event_id + {j}) % 3 = 0 THEN 'null' ELSE '"bad"' END""" for j, f in enumerate(R.KINDS[k].required)) + " || '}'" for i, k in enumerate(_KINDS)) + " END"
_BROKEN = ", ".join(f"({i}, '{k}', '{f}', '{_QUOTED(m)}')" for i, k in enumerate(_KINDS) for f, m in _ALWAYS[k])
_NEEDED = ", ".join(f"({i}, '{k}', '{f}', {j})" for i, k in enumerate(_KINDS) for j, f in enumerate(R.KINDS[k].required))


@query("stored_record_issues", f"""SELECT event_id, k || '.' || f AS path, m AS message FROM events, (VALUES {_BROKEN}) AS b(i, k, f, m) WHERE event_id % 14 = i
UNION ALL SELECT event_id, k || '.' || f, 'is required' FROM events, (VALUES {_NEEDED}) AS n(i, k, f, j) WHERE event_id % 14 = i AND (event_id + j) % 3 = 0""")
def stored_record_issues(spark, sf_dir):
    """All fourteen kinds in one table, each record by the rules of its kind."""
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("event_id") % 14 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.try_parse_json(F.expr(_RECORD)).alias("record"))
    found = None
    for name in _KINDS:
        found = F.when(F.col("kind") == name, R.issues_of(F.col("record"), R.KINDS[name])) if found is None else found.when(F.col("kind") == name, R.issues_of(F.col("record"), R.KINDS[name]))
    return rows.select("event_id", F.explode(found).alias("i")).select("event_id", F.substring(F.col("i.path"), F.lit(3), F.length("i.path")).alias("path"), "i.message")
