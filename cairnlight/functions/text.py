"""Column functions on text: preparation, cleaning, tokens, terms, n-grams, identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASHES = "[-‐‑‒–—―]"


def blank(c: Column) -> Column:
    """Null reads as the empty string, at every boundary."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The empty string reads as null."""
    return F.when(F.trim(c) != "", c)


def prepare(c: Column) -> Column:
    """Tags dropped, dashes to blanks, lower case, trimmed: what phrases are looked up in."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(blank(c), "<[^>]+>", ""), DASHES, " ")))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are evaluated once a row, however many expressions and filters read them.

    A projection would be merged into its readers, which then repeat it; a generator of one row isn't.
    """
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.explode(F.array(made)).alias("_once")).select("*", *(F.col(f"_once.{n}").alias(n) for n in columns)).drop("_once")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, for expressions that read it many times where ``once`` can't stand."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise_title(c: Column) -> Column:
    """The milder form trend reports use: lower case, hyphens to blanks, italics marks dropped."""
    return F.replace(F.replace(F.replace(F.lower(blank(c)), F.lit("-"), F.lit(" ")), F.lit("<i>"), F.lit("")), F.lit("</i>"), F.lit(""))


def clean(c: Column, limit: int | None = None) -> Column:
    """Tags to blanks, white space collapsed; over ``limit`` the text is cut and ends in three dots."""
    out = F.trim(F.regexp_replace(F.regexp_replace(blank(c), "<[^>]+>", " "), r"\s+", " "))
    return out if limit is None else F.when(F.length(out) > limit, F.concat(F.rtrim(F.left(out, F.lit(limit - 3))), F.lit("..."))).otherwise(out)


def label(c: Column) -> Column:
    """Lower-case snake label."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words(c: Column) -> Column:
    """Tokens between white space, none empty."""
    return F.filter(F.split(F.trim(blank(c)), r"\s+"), lambda w: w != "")


def contains_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether any literal occurs; no row is repeated per phrase.

    Each is looked for in the bytes of the text, which is evaluated once: an alternation tries all of them at every
    character. As with an empty pattern, no phrases are in every text.
    """
    found = [F.lit(p) for p in phrases]
    return bound(c, lambda t: reduce(or_, (F.contains(t, p) for p in found))) if found else F.contains(c, F.lit(""))


def term_pattern(term: str, short_only: bool = False) -> str:
    """Alphanumeric terms match whole tokens (with ``short_only`` those of four letters at most), others anywhere."""
    term = term.lower().strip()
    whole = re.fullmatch("[a-z0-9]{1,4}" if short_only else "[a-z0-9]+", term)
    return rf"(?<![a-z0-9]){term}(?![a-z0-9])" if whole else re.escape(term)


def has_term(c: Column, term: str, short_only: bool = False) -> Column:
    return c.rlike(term_pattern(term, short_only))


def term_weight(c: Column, weights: Mapping[str, float]) -> Column:
    """Sum of weights of the terms that match."""
    out = F.lit(0.0)
    for term, weight in weights.items():
        out = out + F.when(has_term(c, term), F.lit(float(weight))).otherwise(F.lit(0.0))
    return out


def count_terms(c: Column, terms: Iterable[str]) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + has_term(c, term, short_only=True).cast("int")
    return out


def ngrams(tokens: Column, n: int, joint: str = " ") -> Column:
    """Runs of n tokens; none if there are fewer. Shifted slices are zipped, so ``tokens`` isn't evaluated per position."""
    size = F.greatest(F.lit(0), F.size(tokens) - (n - 1))
    shifted = F.arrays_zip(*(F.slice(tokens, k + 1, size).alias(f"g{k}") for k in range(n)))
    return F.transform(shifted, lambda x: F.concat_ws(joint, *(x[f"g{k}"] for k in range(n))))


def doi_of(link: Column) -> Column:
    """A DOI inside a link, else the article slug under the 10.1038 prefix, without trailing dots."""
    direct = F.regexp_extract(blank(link), r"(10\.\d{4,}/\S+)", 1)
    slug = F.regexp_extract(blank(link), r"/articles/([^/?#\s]+)", 1)
    return F.regexp_replace(F.when(direct != "", direct).when(slug != "", F.concat(F.lit("10.1038/"), slug)).otherwise(""), r"\.+$", "")


def normalise_doi(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(blank(c), r"(?i)^\s*(https?://(dx\.)?doi\.org/|doi:\s*)", ""))), r"\.+$", "")


def stable_id(prefix: str, *parts: Column, n: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(n)))


def number(c: Column, default: float = 0.0) -> Column:
    """A number from text; null, empty and unreadable text gives the default."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def ratio_score(c: Column) -> Column:
    """The number of '8/10' or '7.5 foo', as a double; 0 if there is none."""
    return F.coalesce(F.regexp_extract(blank(c), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def clamp(c: Column, low: float, high: float, digits: int) -> Column:
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), c)), digits)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(blank(c.cast("string")))).isin("1", "true", "yes", "y")


def iso_date(parts: Column) -> Column:
    """[y, m, d] to YYYY-MM-DD, [y, m] to YYYY-MM, anything else to the empty string."""
    return F.when(F.size(parts) >= 3, F.format_string("%04d-%02d-%02d", parts[0], parts[1], parts[2])).when(F.size(parts) == 2, F.format_string("%04d-%02d", parts[0], parts[1])).otherwise("")


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(blank(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_sentence(c: Column, patterns: Iterable[str]) -> Column:
    """The first sentence that matches the earliest pattern with any match."""
    def first(pattern: str) -> Column:
        return F.get(F.filter(sentences(c), lambda s: F.lower(s).rlike(pattern)), F.lit(0))

    return F.coalesce(*(first(p) for p in patterns))


def mapped(c: Column, table: Mapping[str, object], default: object) -> Column:
    """Lookup in a literal map; the default for other keys and null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


#: Words that a title writes in their own way, and what a detection limit is told by (fixed values).
ACRONYMS = {"ev": "EV", "oect": "OECT", "nir": "NIR", "bodipy": "BODIPY", "bbb": "BBB", "rna": "RNA", "gpcr": "GPCR"}
SMALL_WORDS = ("and", "for", "of", "to", "via", "with")
DETECTION_LIMIT = ("lod", "limit of detection", "sensitivity", "attomolar", "femtomolar", "particles/ml", "copies/ml")
#: Words that say nothing of a story's subject, singular forms added to plurals, and short subjects looked for as they are.
STORY_STOP_WORDS = tuple("paper papers sensor sensors sensing biosensor biosensors biosensing platform platforms system systems diagnostic diagnostics enabled based using with from molecular".split())
STORY_STEMS = {"bioelectronics": "bioelectronic", "nanophotonics": "nanophotonic", "biointerfaces": "biointerface"}
STORY_SHORT = ("oect", "ev", "nir", "bbb", "rna")


def title_case(c: Column, acronyms: Mapping[str, str] = ACRONYMS, small: Iterable[str] = SMALL_WORDS) -> Column:
    """Each word with its first letter large and the rest small, but acronyms and small words; what is between stays."""
    table = {**acronyms, **{w: w for w in small}}
    parts = F.regexp_extract_all(blank(c), F.lit(r"(\w+|\W+)"), F.lit(0))
    one = lambda w: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(w)), F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.regexp_replace(F.array_join(F.transform(parts, one), ""), "'S", "'s")


def has_detection_limit(c: Column, phrases: Iterable[str] = DETECTION_LIMIT) -> Column:
    """Whether a phrase stands in the text as words of its own."""
    return F.lower(blank(c)).rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(re.escape(p) for p in phrases)})(?![\p{{L}}\p{{N}}_])")


def elapsed(c: Column) -> Column:
    """A whole number of milliseconds from text, never under 0; 0 for anything else."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.when(blank(c).rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(c).try_cast("long")), F.lit(0).cast("long")))


def reviewer_id(c: Column) -> Column:
    """Stable id of a name, whatever its case and blanks."""
    return F.concat(F.lit("reviewer_"), F.left(F.sha2(F.lower(F.regexp_replace(F.trim(blank(c)), r"\s+", " ")), 256), F.lit(16)))


def first_filled(*values: Column, default: str = "") -> Column:
    """The first value that holds anything without its markup."""
    return F.coalesce(*(filled(clean(v)) for v in values), F.lit(default))


def plain_inline(c: Column) -> Column:
    """Text without bold and slanted marks and without tags."""
    return clean(F.regexp_replace(F.regexp_replace(blank(c), r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1"))


def relevance_terms(c: Column, stop: Iterable[str] = STORY_STOP_WORDS, stems: Mapping[str, str] = STORY_STEMS, short: Iterable[str] = STORY_SHORT) -> Column:
    """Sorted terms of a story's name: words of four letters and more, stems of some, and short subjects inside it."""
    low = F.lower(blank(c))
    tokens = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*stop))
    added = [F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in {**stems, **{s: s for s in short}}.items()]
    return F.array_sort(F.array_distinct(F.concat(tokens, F.filter(F.array(*added), lambda w: w.isNotNull()))))


def stemmed_words(c: Column) -> Column:
    """Words of three letters and more, two of them rewritten."""
    low = F.replace(F.replace(F.lower(blank(c)), F.lit("bioelectronics"), F.lit("bioelectronic")), F.lit("electrochemical"), F.lit("electronic"))
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def search_text(*fields: Column) -> Column:
    """Fields as one lower-case text to look terms up in."""
    return F.lower(F.concat_ws(" ", *fields))


#: A string with what follows it if it is a name, a number, or a word of a JSON text.
JSON_LEAF = r'("(?:[^"\\]++|\\.)*+")(\s*+:)?|(-?[0-9][0-9.eE+-]*+)|(true|false)'


def json_leaves(text: Column) -> Column:
    """Every value of a JSON text that isn't null or blank, as trimmed text, in the order of the text and at any depth.

    The text is scanned once for strings, numbers and truth values; names of fields are left out. True and false are
    written with a capital. Null and malformed text has none.
    """

    def value(leaf: Column) -> Column:
        quoted = F.try_variant_get(F.try_parse_json(leaf), "$", "string")
        return F.trim(F.when(F.startswith(leaf, F.lit('"')), quoted).when(leaf == "true", "True").when(leaf == "false", "False").otherwise(leaf))

    leaves = F.regexp_extract_all(text, F.lit(JSON_LEAF), F.lit(0))
    kept = F.filter(leaves, lambda x: ~F.endswith(x, F.lit(":")))
    found = F.filter(F.transform(kept, value), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.try_parse_json(text).isNotNull(), found).otherwise(F.array().cast("array<string>"))


def reasoning_text(text: Column, *fields: Column) -> Column:
    """Fields and then every value of a JSON text, without tags, as one lower-case text to look terms up in."""
    said = F.filter(F.concat(F.array(*(blank(f) for f in fields)) if fields else F.array().cast("array<string>"), json_leaves(text)), lambda x: x != "")
    return F.lower(F.array_join(F.transform(said, lambda x: F.regexp_replace(x, "<[^>]+>", " ")), " "))
