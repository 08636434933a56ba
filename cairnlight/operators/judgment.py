"""Questions, moves, objects and queues of the judgment layer, and the files its sources lie in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T
from cairnlight.operators import merge as M
from cairnlight.operators import ranking as R

#: Status, confidence and entrenchment of objects by kind; None is worked out from the item (fixed values).
OBJECTS = {
    "belief": ("approved", 7.0, 7.0), "rejected_idea": ("rejected", 0.0, 1.0), "contradiction": ("contested", 5.0, 4.0),
    "decision": ("approved", 7.0, 6.0), "open_question": ("open", None, 2.0), "claim": ("candidate", None, None),
}
TIER_RANKS = {"HIGH_PRIORITY": 5.0, "CURATED_LIBRARY": 4.5, "IMPORTANT": 4.0, "POTENTIAL": 3.0, "WATCHLIST": 2.0, "BLIND_SPOT": 1.0}
CURATED_FOCUS = ((2, ("organic electrochemical", "oect")), (2, ("rna", "rna biomarkers")), (1, ("small molecule", "small-molecule")))


def open_questions(stories: DataFrame, concepts: DataFrame, limit: int = 8, each: int = 8) -> DataFrame:
    """rank, type, title: questions of story nodes first, then gaps of concepts whose question isn't among them.

    ``stories``: pos, node_type, title. ``concepts``: name, gap, appearances, last_seen. Each title or name counts once;
    ``each`` of either are drawn, ``limit`` kept. Only the first few rows of each side move beyond a partial aggregate.
    """
    nodes = stories.select("pos", "node_type", T.clean(F.col("title"), 180).alias("title")).filter(F.col("node_type").isin("next_question", "question") & (F.col("title") != ""))
    told = M.first_seen(nodes, ["title"], [F.col("pos")]).orderBy("pos").limit(each).select(F.lit(0).alias("source"), F.col("pos").cast("long").alias("at"), F.lit("open_question").alias("type"), "title")
    known = concepts.select(T.clean(F.col("name"), 120).alias("name"), T.clean(F.col("gap"), 220).alias("gap"), "appearances", "last_seen").filter((F.col("name") != "") & (F.col("gap") != ""))
    best = known.groupBy("name").agg(F.max(F.struct("appearances", "last_seen")).alias("x"))
    gaps = best.orderBy(F.desc("x"), "name").limit(each)
    asked = gaps.select(F.lit(1).alias("source"), (-F.col("x.appearances")).cast("long").alias("at"), F.lit("concept_gap").alias("type"), F.concat(F.lit("What would make "), "name", F.lit(" decisive?")).alias("title"))
    rows = told.unionByName(asked.join(told.select("title"), "title", "left_anti"))
    return rows.orderBy("source", "at", "title").limit(limit)


def next_moves(pressures: DataFrame, questions: DataFrame, claims: DataFrame, limit: int = 4) -> DataFrame:
    """type and title of the first moves: pressures to resolve or verify, then questions, then claims. All have pos, title."""
    verb = {"contradiction": ("resolve", "Resolve: "), "untested_constraint": ("verify", "Verify constraint: ")}
    one = lambda df, k, type_, head: df.select(F.lit(k).alias("source"), "pos", type_.alias("type"), F.concat(head, "title").alias("title"))
    kind = F.col("type")
    pressed = one(pressures.filter(kind.isin(*verb)), 0, F.when(kind == "contradiction", "resolve").otherwise("verify"), F.when(kind == "contradiction", verb["contradiction"][1]).otherwise(verb["untested_constraint"][1]))
    rows = pressed.unionByName(one(questions, 1, F.lit("sharpen_question"), F.lit("Sharpen: "))).unionByName(one(claims, 2, F.lit("commit_or_reject"), F.lit("Commit or reject: ")))
    return rows.orderBy("source", "pos", "title").limit(limit).select("type", "title")


def objects(kind: Column, evidence: Column, score: Column) -> Column:
    """struct(status, confidence, entrenchment) of an item by its kind; confidence is kept within 0 and 10."""
    out = F.lit(None).cast("struct<status:string,confidence:double,entrenchment:double>")
    claim = F.least(F.lit(10.0), F.coalesce(score / 3.0, F.lit(3.0)))
    worked = {"open_question": (F.least(F.lit(6.0), F.coalesce(evidence, F.lit(0.0)) / 12.0) + 2.0, F.lit(2.0)), "claim": (claim, F.greatest(F.lit(1.0), claim / 2.0))}
    for name, (status, confidence, entrenchment) in OBJECTS.items():
        c, e = worked.get(name, (F.lit(confidence), F.lit(entrenchment)))
        kept = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))
        out = F.when(kind == name, F.struct(F.lit(status).alias("status"), kept(c).alias("confidence"), kept(e).alias("entrenchment"))).otherwise(out)
    return out


def trajectory_priority(tier: Column, text: Column, score: Column, when: Column, ranks: Mapping[str, float] = TIER_RANKS, focus=CURATED_FOCUS) -> Column:
    """What trajectories sort by, descending: rank of the tier, focus of a curated row, score, time."""
    points = sum((F.when(T.contains_any(text, phrases), n).otherwise(0) for n, phrases in focus), F.lit(0))
    return F.struct(T.mapped(tier, ranks, 0.0).alias("tier_rank"), F.when(tier == "CURATED_LIBRARY", points).otherwise(0).alias("focus"), F.coalesce(score, F.lit(0.0)).alias("score"), when.alias("at"))


def task_queue(tasks: DataFrame, rank: Column, priority: Column, tie: str, limit: int = 100) -> DataFrame:
    """The first tasks by queue rank (none: last), then by priority."""
    return tasks.orderBy(F.coalesce(rank, F.lit(999999.0)), F.desc(F.coalesce(priority, F.lit(0.0))), tie).limit(limit)


def belief_state(contest: Column, pending: Column, challenge: Column, support: Column) -> Column:
    return F.when(contest + pending > 0, "contested").when(challenge > 0, "pressure").when(support > 0, "formalised").otherwise("thin")


def display_id(concepts: Column, domain: Column, key: Column) -> Column:
    """What a belief is shown under: its concepts or domain decide, else the end of its id."""
    held = F.transform(concepts, lambda x: F.lower(F.trim(x)))
    return (F.when(F.array_contains(held, "oect") & F.array_contains(held, "ev"), "B-OECT")
            .when(F.contains(F.lower(T.blank(domain)), F.lit("research-os")) | F.array_contains(held, "belief-kernel"), "B-KERNEL")
            .otherwise(F.concat(F.lit("B-"), F.upper(F.left(F.substring_index(key, "_", -1), F.lit(6))))))


def journals(rows: DataFrame, name: str, code: str, wanted: Sequence[str] = (), focus: Sequence[str] = ()) -> DataFrame:
    """Rows with a code whose name is wanted, or in focus where nothing is wanted (an empty focus holds all)."""
    names = [n.lower().strip() for n in wanted if n.strip()] or list(focus)
    kept = rows.filter(T.filled(F.col(code)).isNotNull())
    return kept.filter(F.lower(F.trim(F.col(name))).isin(*names)) if names else kept


def overestimate(given: Column, estimated: Column, support: Column) -> Column:
    """struct(flag, support): two points less, never under 0, where High was given and the rules say Low."""
    over = (F.trim(T.blank(given)) == "High") & (estimated == "Low")
    return F.struct(over.alias("flag"), F.when(over, F.greatest(F.lit(0.0), support - 2)).otherwise(support).alias("support"))


def rule_candidates(stored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules that overrides give, those stored already once: id, source_override_id, status, rule. ``overrides``: id, rule."""
    new = overrides.select(T.stable_id("rule_", F.col("id").cast("string"), F.col("rule")).alias("id"), F.col("id").alias("source_override_id"), F.lit("candidate").alias("status"), "rule").dropDuplicates(["id"])
    return stored.unionByName(new.join(stored.select("id"), "id", "left_anti"))


def migration_plan(records: DataFrame, files: DataFrame, action: str) -> DataFrame:
    """source_id, status and issues of the records with the action. ``records``: source_id, action, source, destination;
    ``files``: path (each once)."""
    there = lambda side: files.select(F.col("path").alias(side), F.lit(True).alias(f"{side}_there"))
    rows = records.filter(F.col("action") == action).join(there("source"), "source", "left").join(there("destination"), "destination", "left")
    s, d = F.coalesce("source_there", F.lit(False)), F.coalesce("destination_there", F.lit(False))
    given = T.filled(F.col("destination")).isNotNull()
    found = F.array(F.when(~s, F.lit("missing_source")), F.when(~given, F.lit("missing_destination")).when(d, F.lit("destination_exists")), F.when(s & given & (F.col("source") == F.col("destination")), F.lit("source_equals_destination")))
    issues = F.filter(found, lambda x: x.isNotNull())
    return rows.select("source_id", F.when(F.size(issues) > 0, "blocked").otherwise("ready").alias("status"), issues.alias("issues"))


def best_by(rows: DataFrame, title: str, pos: str, metrics: Sequence[str]) -> DataFrame:
    """One row: per metric the title with its maximum, the first in ``pos`` among equals."""
    return rows.agg(*(F.max_by(title, F.struct(F.col(m), -F.col(pos))).alias(f"best_{m}") for m in metrics))


def latest_with(rows: DataFrame, day: str, has: Column) -> DataFrame:
    """One row: the newest day with any row that has it, else the newest."""
    return rows.agg(F.coalesce(F.max(F.when(has, F.col(day))), F.max(day)).alias(day))


def by_id(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows with the wanted keys; a key without a row is an error when it is read."""
    found = wanted.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return found.withColumn(key, checked.cast(rows.schema[key].dataType)).drop("_there")


def harvest(rows: DataFrame, journal: str, key: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """Rows of all chunks, each key once (the first by order), at most ``cap`` of a journal."""
    return R.top_k(M.first_seen(rows.withColumn("_key", key), ["_key"], order).drop("_key"), [journal], order, cap).drop("rank")


def privacy(topics: Column, non_research: Column, low_signal: Column) -> Column:
    return F.when(non_research, "excluded_private_or_admin").when(low_signal, "excluded_low_signal").when(F.size(topics) > 0, "research_candidate").otherwise("unknown")


def path_facts(path: Column, home: str, topics: Mapping[str, str], non_research: str, low_signal: Sequence[str], curated: Sequence[str]) -> Column:
    """struct(bucket, parent, topics, curated, privacy) of a file's path: its first folder under ``home`` (or under the
    root), up to four folders around it, and what its words and folders say of it."""
    inside = F.startswith(path, F.lit(home + "/"))
    parts = F.split(F.substring(path, F.lit(len(home) + 2), F.length(path)), "/")
    around = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    parent = F.when(F.size(around) == 0, ".").when((F.size(around) >= 3) & (F.get(around, F.lit(0)) == "Library"), F.concat(F.array_join(F.slice(around, 1, 3), "/"), F.lit("/..."))).otherwise(F.array_join(F.slice(around, 1, 4), "/"))
    words = F.translate(F.lower(path), "_-", "  ")
    named = F.filter(F.array(*(F.when(words.rlike(p), F.lit(t)) for t, p in topics.items())), lambda x: x.isNotNull())
    low = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(x) for x in low_signal)))
    return F.struct(
        F.when(inside, F.get(parts, F.lit(0))).otherwise(F.concat(F.lit("/"), F.get(F.split(path, "/"), F.lit(1)))).alias("bucket"),
        F.when(inside, parent).otherwise(F.regexp_replace(path, "/[^/]*$", "")).alias("parent"),
        named.alias("topics"), T.contains_any(words, curated).alias("curated"), privacy(named, words.rlike(non_research), low).alias("privacy"))


def tokens_of(*fields: Column) -> Column:
    """Tokens of fields that are lists, single values, or maps of switches, each once."""
    return F.filter(F.array_distinct(F.transform(F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields))), lambda x: F.lower(F.trim(x)))), lambda x: x != "")


def switched_on(switches: Column) -> Column:
    """Keys of a map that are on."""
    return F.map_keys(F.map_filter(switches, lambda _, v: T.truthy(v)))
