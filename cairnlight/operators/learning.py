"""What reviewers' overrides and reviews teach: patterns and key phrases, counted and kept by version.

Counts combine on the map side. A ledger of what was learned holds the version that it came from; learning a version again
changes nothing, so a job that is run twice, or resumed, leaves the ledger as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions import text as T

LEDGER = ("version", "kind", "key", "n")
# Decisions of a user and of the rules that teach, and the core words of the field.
BOOSTED, PENALISED = ("approved", ("LOW",)), ("rejected", ("HIGH", "IMPORTANT"))
DOMAIN_CORE = (
    "transistor", "gate", "channel", "ionic", "dielectric", "photochemical", "rotor", "motor", "photon", "elastomer", "conductivity", "polyelectrolyte", "nanoribbon", "condensate", "molecular motor", "stretchable",
    "biointerface", "thin film", "organic electrochemical", "electric double layer", "contact injection", "iontronic", "single ion", "light emitting transistor", "ionogel", "mechanoreceptor", "synaptic transistor",
    "semiconducting polymer", "foreign body", "immune compatible", "phase behavior",
)
# End of fixed values.


def _pattern(**parts: Column) -> Column:
    """A JSON object of texts, in the order given; null ones are empty."""
    return F.to_json(F.struct(*(T.blank(c).alias(k) for k, c in parts.items())))


def override_patterns(overrides: DataFrame) -> DataFrame:
    """(kind, key, n) of overrides (user_decision, kernel_decision, problem_class, concept, strategic_value): boosts of what
    was approved against a low verdict, penalties of what was rejected against a high one. Others teach nothing."""
    met = lambda rule: (F.col("user_decision") == rule[0]) & F.col("kernel_decision").isin(*rule[1])
    boost = _pattern(problem_class=F.col("problem_class"), concept=F.col("concept"), strategic_value=F.col("strategic_value"))
    kind = F.when(met(BOOSTED), F.struct(F.lit("boost").alias("kind"), boost.alias("key"))).when(met(PENALISED), F.struct(F.lit("penalty").alias("kind"), _pattern(problem_class=F.col("problem_class")).alias("key")))
    return overrides.select(kind.alias("x")).filter("x IS NOT NULL").groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def review_phrases(text: Column, core: Sequence[str] = DOMAIN_CORE, known: Sequence[str] = ()) -> Column:
    """The distinct two- and three-word phrases of a text that hold a core word and aren't known, sorted."""
    words = F.regexp_extract_all(F.lower(T.blank(text)), F.lit("[a-z]+"), F.lit(0))  # taken once: many expressions read them
    held = lambda p: reduce(or_, (F.contains(p, F.lit(c)) for c in core), F.lit(False))
    fresh = F.array_distinct(T.bound(words, lambda w: F.concat(*(F.filter(T.ngrams(w, n), held) for n in (2, 3)))))
    return F.array_sort(F.array_except(fresh, F.array(*(F.lit(k) for k in known))) if known else fresh)


def contrasting_phrases(reviews: DataFrame, text: Column, accepted: Column, core: Sequence[str] = DOMAIN_CORE, known: Sequence[str] = (), least: int = 2, ratio: float = 2.0) -> DataFrame:
    """(kind, key, n): phrases of accepted reviews that tell them from rejected ones.

    A phrase counts once a text; it is kept where at least ``least`` accepted texts hold it, and the share of accepted texts
    that do is ``ratio`` times that of rejected ones or more. Texts without a verdict teach nothing.
    """
    rows = reviews.select(accepted.alias("yes"), review_phrases(text, core, known).alias("phrases")).filter("yes IS NOT NULL")
    # the totals travel as counts of a phrase of their own, so one aggregate gives both
    held = rows.select("yes", F.explode(F.concat(F.array(F.lit("")), "phrases")).alias("key")).groupBy("key").agg(F.count_if("yes").alias("a"), F.count_if(~F.col("yes")).alias("r"))
    total = lambda c: F.coalesce(held.filter("key = ''").select(c).scalar(), F.lit(0))
    found = held.filter((F.col("key") != "") & (F.col("a") >= least))
    tells = F.col("a") * F.greatest(total("r"), F.lit(1)) >= ratio * F.col("r") * total("a")
    return found.filter(tells).select(F.lit("keyword").alias("kind"), "key", F.col("a").alias("n"))


def learn(ledger: DataFrame, learned: DataFrame, version: Column) -> DataFrame:
    """The ledger (version, kind, key, n) with what a version taught (kind, key, n); what it holds of a version stays.

    Learning the same version again gives the same ledger, whatever was learned then.
    """
    rows = learned.select(version.cast("string").alias("version"), "kind", "key", F.col("n").cast("long").alias("n"))
    known = ledger.select("version").distinct()
    return ledger.select(*LEDGER).unionByName(rows.join(known, "version", "left_anti"))


def boosts(ledger: DataFrame, least: int = 2) -> DataFrame:
    """(key, n) of boosts that all versions together met ``least`` times or more."""
    return ledger.filter("kind = 'boost'").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
