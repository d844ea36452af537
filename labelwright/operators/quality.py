"""Quality of verdicts against the truth, latencies and phase totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import lcs_length
from . import item
from .order_statistics import quantiles


def metrics(df: DataFrame, *keys: str, reported: str = "reported", truth: str = "truth") -> DataFrame:
    """precision, recall, review_rate and false_match of each group; null where nothing can be divided by."""
    said, is_ = F.col(reported) == "match", F.col(truth) == "match"
    n, both = F.count_if, F.count_if(said & is_)
    return df.groupBy(*keys).agg(
        F.try_divide(both, n(said)).alias("precision"), F.try_divide(both, n(is_)).alias("recall"),
        F.try_divide(n(F.col(reported) == "needs_review"), F.count("*")).alias("review_rate"),
        F.try_divide(n(said & (F.col(truth) == "mismatch")), n(said)).alias("false_match"),
    )


def golden_truth(items: DataFrame, declared: DataFrame, printed: DataFrame, common=lcs_length) -> DataFrame:
    """(item_id, field, truth): the outcome that the comparison rules give of what is printed and what is declared.

    items, declared and printed as item.decided() takes items, declared and values. There is no text to search, so that a
    difference of a verdict from it is the reading's or the search's.
    """
    none = items.select("item_id").limit(0).selectExpr("item_id", "0 AS sheet", "0 AS unit", "0 AS column", "0 AS block", "'' AS text")
    return item.decided(items, declared, printed, none, common=common).select("item_id", "field", F.col("outcome").alias("truth"))


def evaluated(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """metrics() by field of verdicts (item_id, field, outcome) against truth (item_id, field, truth); fields of one side only take no part."""
    both = verdicts.select("item_id", "field", F.col("outcome").alias("reported")).join(truth, ["item_id", "field"])
    return metrics(both, "field")


def latencies(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, least, mean, median, most); the median is exact, however large a group is."""
    return quantiles(df, value, (0.5,), *keys).select(*keys, "least", "mean", F.col("quantiles")[0].alias("median"), "most")


def phase_totals(df: DataFrame, phases: list[str], *keys: str) -> DataFrame:
    """Sum of ms by phase, and unaccounted: what of phase `total` the others leave, at least 0."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("ms"))), F.lit(0.0))
    own = df.groupBy(*keys).agg(of("total").alias("total"), *[of(p).alias(p) for p in phases])
    return own.withColumn("unaccounted", F.greatest(F.col("total") - sum((F.col(p) for p in phases), F.lit(0.0)), F.lit(0.0)))


def word_counts(readings: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, words): words of the readings' texts, cut at white space."""
    own = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))
    return readings.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(text).isNotNull(), own)), F.lit(0)).cast("long").alias("words"))


def histogram(df: DataFrame, of: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, of).agg(F.count("*").alias("n"))


def expected_rows(expected: DataFrame, applications: DataFrame) -> DataFrame:
    """Golden rows: what is printed and what is declared, by file name, with the fields of applications under said_*."""
    said = applications.select("filename", *[F.col(c).alias(f"said_{c}") for c in applications.columns if c != "filename"])
    return expected.join(said, F.col("image_filename") == F.col("filename"), "inner").drop("filename")


def expected_counts(expected: DataFrame, applications: DataFrame, said: str, *by: str) -> DataFrame:
    """(by, n, said): of the groups of expected_rows() by columns of expected the number of golden rows, and of different values of
    the applications' column `said`.

    Equal rows of either side are one with its number before they meet, so that copies under one file name are never paired.
    """
    one = lambda df: df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    rows = expected_rows(one(expected), one(applications))
    return rows.groupBy(*by).agg(F.sum(F.col("copies") * F.col("said_copies")).alias("n"), F.count_distinct(f"said_{said}").alias("said"))


def replicated(files: DataFrame, copies: int) -> DataFrame:
    """Each file `copies` times under stems of their own."""
    return files.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("filename", F.format_string("%03d-%s", "copy", "filename"))
