"""Verdicts from scores and from what is missing, and how verdicts are tallied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..vocab import OUTCOMES, ROLL_UP
from .quantities import once, verdict
from .similarity import lcs_length, ratio, reaches
from .text import missing, normalized


def banded(common: Column, a: Column, b: Column, settings: Settings = DEFAULT) -> Column:
    """match, needs_review or mismatch of two texts by their common length, in integers."""
    return F.when(reaches(common, a, b, settings.match_threshold), "match").when(reaches(common, a, b, settings.review_threshold), "needs_review").otherwise("mismatch")


def band(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score >= settings.match_threshold, "match").when(score >= settings.review_threshold, "needs_review").otherwise("mismatch")


def missing_outcome(label: Column, declared: Column) -> Column:
    """Outcome where a side is missing, null where none is."""
    return F.when(missing(declared), "not_compared").when(missing(label), "mismatch")


def compared_text(label: Column, declared: Column, settings: Settings = DEFAULT, common=lcs_length) -> Column:
    """Outcome of two texts: the missing rule, then review where nothing is left to compare, then the band."""
    a, b = normalized(label), normalized(declared)
    return F.coalesce(missing_outcome(label, declared), F.when((a == "") | (b == ""), "needs_review"), F.when(a == b, "match").otherwise(banded(common(a, b), a, b, settings)))


def text_verdict(label: Column, declared: Column, settings: Settings = DEFAULT, lcs: Column | None = None, folded: tuple[Column, Column] | None = None) -> Column:
    """struct (outcome, score, code) of two texts; outcomes as compared_text() gives them, scores to one decimal.

    lcs: a column with the common length of the normalized texts, where it is computed already; folded: those texts.
    """

    def decide(a: Column, b: Column, n: Column) -> Column:
        return (
            F.when(missing(declared), verdict("not_compared", None, "undeclared"))
            .when(missing(label), verdict("mismatch", None, "absent"))
            .when((a == "") | (b == ""), verdict("needs_review", None, "no_text"))
            .when(a == b, verdict("match", 100.0, "text"))
            .otherwise(verdict(banded(n, a, b, settings), F.round(ratio(n, a, b), 1), "text"))
        )

    a, b = folded or (normalized(label), normalized(declared))
    return once(decide, a, b, F.when(a != b, lcs_length(a, b)) if lcs is None else lcs)


def presence(label: Column, declared: Column) -> Column:
    """Fields that need only be there: present or mismatch where nothing is declared, null else."""
    return F.when(missing(declared), F.when(missing(label), "mismatch").otherwise("present"))


def circular(outcome: Column, own_artwork: Column, from_artwork: Column) -> Column:
    """A match of a value with the artwork it was read from proves nothing."""
    return F.when(own_artwork & from_artwork & (outcome == "match"), "artwork_derived").otherwise(outcome)


def tally(df: DataFrame, outcome: str, *keys: str) -> DataFrame:
    """A count column for each outcome, zero where there is none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES])


def rolled_up(df: DataFrame, outcome: str, *keys: str) -> DataFrame:
    """The worst outcome of each group."""
    rank = F.array_position(F.array(*map(F.lit, ROLL_UP)), F.col(outcome))
    return df.groupBy(*keys).agg(F.min_by(outcome, rank).alias("row_outcome"))


def checks(df: DataFrame, outcome: str, *keys: str) -> DataFrame:
    """passed, checks and derived of each group."""
    passed = F.count_if(F.col(outcome).isin("match", "present"))
    derived = F.count_if(F.col(outcome) == "artwork_derived")
    return df.groupBy(*keys).agg(passed.alias("passed"), (F.count("*") - derived).alias("checks"), derived.alias("derived"))


def rolled_tallies(df: DataFrame, outcome: str, *levels: str) -> DataFrame:
    """(levels, level, n, a count of each outcome, worst, passed, derived): of each group of all levels, of ever fewer of them, and of all rows.

    levels go from the widest to the narrowest, such as batch and item. level is how many of them a row is of; the others are
    null. worst is the outcome that a roll-up shows. One pass: rows are expanded to the levels after they are counted by the
    narrowest, so that the shuffle has one row a group and task.
    """
    rank = F.array_position(F.array(*map(F.lit, ROLL_UP)), F.col(outcome))
    own = df.groupBy(*levels).agg(F.count("*").alias("n"), *[F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES], F.min(F.when(rank > 0, rank)).alias("least"))
    sets = [list(levels[:k]) for k in range(len(levels), -1, -1)]
    numbers = ["n", *OUTCOMES]
    level = sum((1 - F.grouping(c).cast("int") for c in levels), F.lit(0)).alias("level")
    every = own.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(level, *[F.sum(c).alias(c) for c in numbers], F.min("least").alias("least"))
    worst = F.try_element_at(F.array(*map(F.lit, ROLL_UP)), F.col("least").cast("int"))
    return every.select(*levels, "level", *numbers, worst.alias("worst"), (F.col("match") + F.col("present")).alias("passed"), F.col("artwork_derived").alias("derived"))
