"""Substring search for any number of needles in one plan, by postings of short grams.

A text that holds a needle holds all the needle's grams of three letters (a shorter needle is its own gram). Postings of the
grams that some needle has are cut out where texts are read, ids and grams alone. A needle takes the gram with the fewest
postings in its scope, so a common ending or a frequent word pairs nothing; only the texts so met are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

GRAM = 3


def _runs(text: Column, n: int) -> Column:
    """All overlapping runs of ``n`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def grams(text: Column, lengths: Iterable[int] = range(1, GRAM + 1)) -> Column:
    """The distinct runs of one to GRAM characters of a text, or of the named ``lengths`` alone."""
    return F.array_distinct(F.concat(*[_runs(text, n) for n in lengths]))


def needle_grams(needle: Column) -> Column:
    """The grams of which a text that holds the needle must have each: runs of GRAM characters, or a shorter needle itself."""
    return F.when(F.length(needle) < GRAM, F.array(needle)).otherwise(F.array_distinct(_runs(needle, GRAM)))


def find(texts: DataFrame, needles: DataFrame, ids: list[str], scope: list[str] = []) -> DataFrame:
    """(scope, ids, needle) of every text (scope, ids, ``text``) that holds a ``needle`` of its scope; both are compared as they are.

    Empty and null needles and null texts match nothing; repeated needles count once. ``ids`` name a text within its scope.
    """
    asked = needles.where(F.length("needle") > 0).select(*scope, "needle").distinct()
    wanted = asked.select(*scope, "needle", F.explode(needle_grams(F.col("needle"))).alias("gram"))
    # Only runs as long as a gram that is asked for are cut out: GRAM numbers at most come to the driver.
    lengths = sorted(r.n for r in wanted.select(F.length("gram").alias("n")).distinct().collect())
    postings = texts.select(*scope, *ids, F.explode(grams(F.col("text"), lengths or [GRAM])).alias("gram"))
    postings = staged(postings.join(wanted.select(*scope, "gram").distinct(), [*scope, "gram"], "left_semi"))
    often = postings.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram that no text has rules its needle out, and it is the rarest one.
    rated = wanted.join(often, [*scope, "gram"], "left").groupBy(*scope, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g"))
    seeds = staged(rated.where("_g.n > 0").select(*scope, "needle", F.col("_g.gram").alias("gram")))
    met = postings.join(seeds, [*scope, "gram"]).select(*scope, *ids, "needle")
    return texts.join(met, [*scope, *ids]).where(F.col("text").contains(F.col("needle"))).select(*scope, *ids, "needle")
