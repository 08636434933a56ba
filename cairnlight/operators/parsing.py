"""Text protocols to columns: KEY: value responses, Markdown sections and digests, tags with attributes, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlight.functions import text as T


def lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, line) of every line."""
    return rows.select(key, F.posexplode(F.split(T.blank(text), "\n")).alias("pos", "line"))


def last_of_each(parts: Column, name: str, value: str) -> Column:
    """Of structs with ``name``, ``at`` and ``value``: the last by ``at`` for each name, as (name, value), by sorting."""
    ordered = F.array_sort(F.transform(parts, lambda x: F.struct(x[name].alias("n"), (-x["at"]).alias("back"), x[value].alias("v"))))
    kept = lambda o: F.transform(o, lambda x, i: F.when((i == 0) | (F.get(o, i - 1)["n"] != x["n"]), x))
    return F.filter(T.bound(ordered, kept), lambda x: x.isNotNull())


def fields(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, field, value) of KEY: value and KEY = value lines. Bold marks go; bullets join the field before them.

    A field given again starts over. A text is folded where it stands: nothing moves, and repeated keys are texts of
    their own.
    """

    def parsed(line: Column) -> Column:
        raw = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\*\*", ""), r"\*+$", "")
        return T.bound(raw, lambda r: T.bound(F.when(F.instr(r, ":") > 0, F.instr(r, ":")).otherwise(F.instr(r, "=")), lambda at: split(r, at)))

    def split(raw: Column, at: Column) -> Column:
        name = F.replace(F.replace(F.lower(F.trim(F.substring(raw, F.lit(1), at - 1))), F.lit(" "), F.lit("_")), F.lit("*"), F.lit(""))
        value = F.regexp_replace(F.trim(F.substring(raw, at + 1, F.length(raw))), r"\*+$", "")
        bullet = F.startswith(raw, F.lit("-"))
        field = T.bound(name, lambda n: F.when(~bullet & (at > 0) & (n != "") & (F.length(n) < 60), n))
        return T.bound(field, lambda n: F.struct(n.alias("name"), F.when(n.isNotNull(), value).when(bullet, raw).alias("part")))

    parts = T.once(rows.select(key, text.alias("_text")), _parts=F.filter(F.transform(F.split(T.blank(F.col("_text")), "\n"), parsed), lambda x: x["part"].isNotNull())).select(key, "_parts")
    heads = F.filter(F.transform("_parts", lambda x, i: F.when(x["name"].isNotNull(), i)), lambda i: i.isNotNull())
    at = T.once(parts, _heads=heads)
    end = lambda i: F.coalesce(F.get("_heads", i + 1), F.size("_parts"))
    whole = F.transform("_heads", lambda h, i: F.struct(F.get("_parts", h)["name"].alias("name"), h.alias("at"), F.array_join(F.transform(F.slice("_parts", h + 1, end(i) - h), lambda x: x["part"]), "\n").alias("value")))
    last = T.once(at, _whole=whole).select(key, F.explode(last_of_each(F.col("_whole"), "name", "value")).alias("x"))
    return last.select(key, F.col("x.n").alias("field"), F.col("x.v").alias("value"))


def canonical_tier(c: Column) -> Column:
    t = F.upper(T.blank(c))
    out = F.when(F.contains(t, F.lit("HIGH")), "HIGH_PRIORITY")
    for word, tier in (("IMPORTANT", "IMPORTANT"), ("POTENTIAL", "POTENTIAL"), ("WATCHLIST", "WATCHLIST"), ("LOW", "LOW_PRIORITY"), ("COMMENTARY", "COMMENTARY"), ("IGNORE", "IGNORE")):
        out = out.when(F.contains(t, F.lit(word)), tier)
    return out.otherwise(F.when(t == "", "LOW_PRIORITY").otherwise(F.replace(F.trim(t), F.lit(" "), F.lit("_"))))


def sections(rows: DataFrame, key: str, text: Column, mark: str = "## ") -> DataFrame:
    """(key, section, body) of a Markdown text's sections; what stands before the first mark is left out."""
    parts = F.split(F.concat(F.lit("\n"), T.blank(text)), "\n" + mark)
    one = rows.select(key, F.explode(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))).alias("s"))
    return one.select(key, F.trim(F.substring_index("s", "\n", 1)).alias("section"), F.trim(F.substring("s", F.length(F.substring_index("s", "\n", 1)) + F.lit(2), F.length("s"))).alias("body"))


def entries(body: Column, mark: str = "### ") -> Column:
    """The blocks of a section that start with the mark, without it."""
    parts = F.split(F.concat(F.lit("\n"), T.blank(body)), "\n" + mark)
    return F.filter(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.trim(p) != "")


def labelled(block: Column, name: str) -> Column:
    """The value of a '- **Name:** value' line."""
    return F.trim(F.regexp_extract(block, rf"(?m)^- \*\*{name}:\*\*[ \t]*(.*)$", 1))


def tag_attribute(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute of every such tag, in page order; absent or empty values are left out."""
    values = F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^>]*?\s{attribute}\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1))
    return F.filter(values, lambda v: v != "")


def best_candidate(html: Column, kinds: Sequence[tuple[str, str, int]], bad_hints: Sequence[str], good: str) -> Column:
    """The best URL of the tags' attributes: by priority and then page order, of a displayable form, with no bad hint."""
    def ranked(values: Column, priority: int) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(priority).alias("priority"), i.alias("at"), v.alias("url")))

    found = F.concat(*(ranked(tag_attribute(html, t, a), p) for t, a, p in kinds))
    fits = F.filter(found, lambda x: x["url"].rlike(good) & (~T.contains_any(F.lower(x["url"]), bad_hints) if bad_hints else F.lit(True)))
    return F.coalesce(F.array_min(fits)["url"], F.lit(""))


def absolute(url: Column, page: Column) -> Column:
    """A URL joined to its page's: absolute, scheme-relative, root-relative and plain relative ones."""
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    return (F.when(url.rlike("^https?://"), url).when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(page, "^(https?:)", 1), url))
            .when(F.startswith(url, F.lit("/")), F.concat(origin, url)).when(url == "", "").otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), url)))


def table_rules(rows: DataFrame, key: str, text: Column, heading: str) -> DataFrame:
    """(key, pos, cells) of Markdown table rows that follow a line with the heading; rule lines are left out."""
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    all_lines = lines(rows, key, text).withColumn("on", F.max(F.contains("line", F.lit(heading)).cast("int")).over(order))
    body = all_lines.filter((F.col("on") == 1) & F.startswith(F.trim("line"), F.lit("|")) & ~F.trim("line").rlike(r"^\|[\s:|-]+\|$") & ~F.contains("line", F.lit(heading)))
    return body.select(key, "pos", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda v: F.trim(v)).alias("cells"))
