"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Seeds are the entities of four fixed patterns. The words before them become lexical patterns; a bipartite graph of
patterns and the identifiers that follow them anywhere is scored in rounds, and identifiers after high-confidence patterns
that no fixed pattern covers become ``ctx`` spans. An identifier is a run of digits with separators, letters in groups
after a country's two (IBAN), or any token with a digit, an @ or one written out in brackets. What a fixed pattern examined
and refused (a number as long as a card's without its check digit, four dotted numbers that are no address) is never found
so, and speaks against its pattern; numbers after letters are not refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.common import bound, count_kind, located, materialize, packed, rendered, replaced, running, table, tagged

_LOCAL = r"[A-Za-z0-9._%+-]"
# Possessive forms and the run-start test match what the plain patterns match, but run in linear time and constant stack:
# an email's local part can only start where a run of its characters starts or where the last match ended (\G).
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifiers, tried in this order: four dotted numbers; two letters, two digits and groups of four; seven digits or more
#: with separators, and what hangs on them; a token with a digit, an @ or an at in brackets, up to its last letter or digit.
_IDS = (
    r"[0-9]++(?:\.[0-9]++){3}(?![\p{L}0-9]|\.[0-9])",
    r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,8}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    r"[A-Z]{0,3}[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?:\S*[\p{L}\p{N}])?+",
    r"(?=\S*[0-9@]|\S*[\[({](?i:at)[\])}])\S*[\p{L}\p{N}]",
)
#: A word, blanks, opening marks, and an identifier.
CONTEXT = rf"""(?<!\S)(\S++)\s++(?:["'\[{{<]|\((?![0-9]))*+({"|".join(_IDS)})"""
#: Words longer than this stand by their hash as patterns.
WORD = 64
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<s:int,k:int,e:int,kind:string,t:string>>"

#: Rounds of scoring; a pattern needs this many distinct seeds, this share of seed mass among its distinct instances, and no less.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 5, 0.8


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    """13 to 19 digits whose doubled alternate sum is a multiple of ten."""
    d = _digits(t)
    figures = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int"))))
    return F.length(d).between(13, 19) & (F.aggregate(F.filter(figures, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _small_parts(t: Column) -> Column:
    """Each dotted part is at most 255; parts of any length are compared as text, without a cast."""

    def small(x: Column) -> Column:
        y = F.regexp_replace(x, "^0+(?=.)", "")
        return (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))

    return F.forall(F.split(t, r"\."), small)


def base_spans(text: Column) -> Column:
    """Spans of the four fixed patterns, by kind as listed and then start. Null text has none."""
    some = lambda mark, spans: F.when(F.contains(text, F.lit(mark)), spans).otherwise(F.array().cast(SPAN))
    none = F.array().cast(SPAN)
    return F.concat(
        F.coalesce(some("@", tagged(located(text, EMAIL), "email", 0)), none),
        F.coalesce(some(".", tagged(located(text, IP), "ip", 1, lambda x: _small_parts(x["t"]))), none),
        tagged(located(text, CARD), "card", 2, lambda x: _luhn(x["t"])),
        F.coalesce(some("+", tagged(located(text, PHONE), "phone", 3, lambda x: F.length(_digits(x["t"])).between(9, 15))), none),
    )


def _word(t: Column) -> Column:
    w = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(w) > WORD, F.sha2(w, 256)).otherwise(w)


def _instance(t: Column) -> Column:
    """Identifiers with letters stand for themselves in lower case, others for their digits."""
    return F.sha2(F.when(t.rlike(r"[\p{L}@]"), F.lower(t)).otherwise(_digits(t)), 256)


def candidates(text: Column) -> Column:
    """Occurrences of an identifier after a word, as array<struct<s, e, w, t>>."""
    return F.transform(located(text, CONTEXT, 1, 2), lambda x: F.struct((x["e"] - F.length(x["t2"])).alias("s"), x["e"].alias("e"), _word(x["t"]).alias("w"), x["t2"].alias("t")))


def _covered(cands: Column, base: Column) -> Column:
    """Candidates as struct<c, seed>: whether a base span overlaps each.

    Both kinds are sorted by start. A base span that starts no later overlaps if the farthest end so far lies beyond the
    candidate's start; one that starts later, if the next start lies before its end. Both are running maxima, so nothing
    grows with the product of the two.
    """
    far = 1 << 30
    one = lambda x, c, base_: F.struct(x["s"].alias("s"), F.lit(not base_).alias("own"), x["e"].alias("e"), c.alias("c"))
    kind = "struct<s:int,e:int,w:string,t:string>"
    both = F.array_sort(F.concat(F.transform(base, lambda x: one(x, F.lit(None).cast(kind), True)), F.transform(cands, lambda x: one(x, x.cast(kind), False))))

    def of(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["own"], F.lit(0)).otherwise(x["e"])), F.greatest)
        nexts = F.reverse(running(F.transform(F.reverse(all_), lambda x: F.when(x["own"], F.lit(0)).otherwise(far - x["s"])), F.greatest))
        marked = F.transform(F.arrays_zip(all_.alias("x"), ends.alias("end"), nexts.alias("next")), lambda z: F.struct(
            z["x"]["c"].alias("c"), ((z["end"] > z["x"]["s"]) | (far - z["next"] < z["x"]["e"])).alias("seed")))
        return F.filter(marked, lambda z: z["c"].isNotNull())

    free = F.transform(cands, lambda x: F.struct(x.cast(kind).alias("c"), F.lit(False).alias("seed")))
    return F.when((F.size(base) == 0) | (F.size(cands) == 0), free).otherwise(bound(both, of))


def known(cands: Column, base: Column) -> Column:
    """Candidates with their pattern, instance, and whether a base span covers them or a fixed pattern refused them."""
    marked = F.transform(_covered(cands, base), lambda z: F.struct(
        z["c"]["s"].alias("s"), z["c"]["e"].alias("e"), z["c"]["w"].alias("pattern"), _instance(z["c"]["t"]).alias("instance"), z["c"]["t"].alias("t"), z["seed"].alias("seed"),
        z["c"]["t"].rlike(r"^(?:[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])|[0-9]+(?:\.[0-9]+){3}$)").alias("refused")))
    return F.filter(marked, lambda c: c["pattern"] != "")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a number of its own per row (_row), base spans (_base) and contextual candidates (_cands)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("*", F.monotonically_increasing_id().alias("_row"), base_spans(body).alias("_base"), candidates(body).alias("_cands"))
    return rows.withColumn("_cands", known(F.col("_cands"), F.col("_base")))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of the bipartite graph. ``edges``: distinct (pattern, instance, seed, refused); refused ones stay at 0.

    An instance starts at 1 if it was ever a seed, else 0. A pattern's confidence is the mean score of its distinct
    instances; an instance's next score is one minus the product of its patterns' doubts. Returns pattern, confidence,
    n_seeds. Both directions aggregate before they move; no pairs of instances or of patterns are formed.
    """
    state = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    out = None
    for r in range(rounds):
        scored = edges.join(state, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum(F.col("seed").cast("long")).alias("n_seeds"))
        out = materialize(scored, f"pii-patterns-{r}", replaces=[x for x in (out, state) if x is not None])
        if r + 1 < rounds:
            doubt = F.when(F.col("n_seeds") >= MIN_SEEDS, 1 - F.col("confidence")).otherwise(F.lit(1.0))
            back = edges.join(out, "pattern").groupBy("instance").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(doubt, F.lit(1e-9)))))).alias("found"),
                F.max(F.col("seed").cast("double")).alias("seed_score"), F.bool_or("refused").alias("refused"))
            score = F.when(F.col("refused"), F.col("seed_score")).otherwise(F.greatest("found", "seed_score"))
            state = materialize(back.select("instance", score.alias("score")), f"pii-instances-{r}")
    return out


def _discover(rows: DataFrame, rounds: int) -> DataFrame:
    """_row and ``_more`` (discovered spans) of the rows of ``features`` that have any."""
    seen = rows.select("_row", F.explode("_cands").alias("c")).select("_row", "c.*")
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"), F.bool_or("refused").alias("refused")), "pii-edges")
    good = score_patterns(edges, rounds).filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("n_seeds") >= MIN_SEEDS)).select("pattern")
    fresh = seen.filter(~F.col("seed") & ~F.col("refused")).join(good, "pattern", "left_semi")
    span = F.struct("s", F.lit(4).alias("k"), "e", F.lit("ctx").alias("kind"), "t")
    return fresh.groupBy("_row").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("_more"))


def _all_spans() -> Column:
    return F.concat("_base", F.coalesce(F.col("_more"), F.array().cast(SPAN)))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, ``base`` and ``spans`` (base spans and then discovered ``ctx`` spans) per row.

    Keys may be null or repeated: each row is found for itself. Null and empty texts have no spans; texts of any length
    take time in proportion to their length and a little more than that to their spans; an empty table gives no rows;
    other columns, whatever their names, are not read. Texts are read once: what later steps need goes to the shared
    folder, without texts.
    """
    rows = materialize(features(docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))).drop("text"), "pii-features")
    return rows.join(_discover(rows, rounds), "_row", "left").select(F.col("_key").alias(key), F.col("_base").alias("base"), _all_spans().alias("spans"))


def redact_all(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span of ``find`` replaced in its texts; all columns and rows as given, whatever their names.

    A text without a candidate that context could make a span has its base spans replaced where it stands; only texts
    with such a candidate move, to meet what was discovered in them. The join is a merge join at every size, since what is
    discovered grows with the corpus.
    """
    at = f"row.{text}"
    staged = materialize(features(packed(docs), at), "pii-features")
    more = materialize(_discover(staged, rounds), "pii-more")
    open_ = F.exists("_cands", lambda c: ~c["seed"] & ~c["refused"])
    put = lambda rows, spans: rows.select(F.col("row").withField(text, redact(F.col(at), spans)).alias("row"))
    still = put(staged.filter(~open_), F.col("_base"))
    moved = put(staged.filter(open_).drop("_cands").join(more.hint("merge"), "_row", "left"), _all_spans())
    return still.unionAll(moved).select("row.*")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by <kind>; overlapping spans merge under the first one's kind."""
    plain = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return replaced(text, plain, lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))


def _counted(base: Column) -> list[Column]:
    return [*(count_kind(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(rendered(base), 256).alias("base_sha256")]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counted(F.col("base")), rendered(spans).alias("spans"), count_kind(spans, "ctx").alias("n_ctx"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns alone, with their spans: the part of operator 9 that SQL can state."""
    base = base_spans(F.coalesce(F.col("text"), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", base.alias("base"))
    return rows.select("doc_id", *_counted(F.col("base")), rendered(F.col("base")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, keep: str) -> str:
    """Matches of a plain pattern that pass ``keep`` (over t), with their places: running sums of the pieces between."""
    return f"""
  SELECT doc_id, {order} AS k, '{kind}' AS kind, s, s + length(t) AS e FROM (
    SELECT doc_id, h[i] AS t, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, h, p, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS p
      FROM docs WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""


_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT ELSE (2 * reverse({_DIGITS})[i]::INT) // 10 + (2 * reverse({_DIGITS})[i]::INT) % 10 END)) % 10 = 0"""
_IP_PARTS = "len(list_filter(string_split(t, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0"
BASE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_sql_spans("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
  UNION ALL {_sql_spans("ip", 1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", _IP_PARTS)}
  UNION ALL {_sql_spans("card", 2, "[0-9](?:[ -]?[0-9])+", _LUHN)}
  UNION ALL {_sql_spans("phone", 3, "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)
"""
QUERIES = {"op9_pii": op9_pii, "pii_base": pii_base}
ORACLE: dict[str, str] = {"pii_base": BASE_SQL}
