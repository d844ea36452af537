"""Merging several readings of one item, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def best_reading(readings: DataFrame, *keys: str, rank: tuple[str, ...] = ("confidence",), order: str = "sheet_idx") -> DataFrame:
    """(keys, value, sheet): of each field the value that ranks highest; ties go to the earlier sheet. Nulls take no part.

    Fields located by size rank by ("prominence", "confidence"), those located by pattern by confidence.
    """
    kept = readings.where("value IS NOT NULL")
    return kept.groupBy(*keys).agg(F.max_by(F.struct("value", F.col(order).alias("sheet")), F.struct(*rank, -F.col(order))).alias("best")).select(*keys, "best.value", "best.sheet")


def longest_text(readings: DataFrame, *keys: str, order: str = "sheet_idx") -> DataFrame:
    """(keys, value, sheet): the longest text, then the most confident, then the earlier."""
    sized = readings.where("value IS NOT NULL").withColumn("size", F.length("value"))
    return best_reading(sized, *keys, rank=("size", "confidence"), order=order)


def declined(readings: DataFrame, *keys: str) -> DataFrame:
    """(keys, declined): no sheet has the value and one declined to choose."""
    return readings.groupBy(*keys).agg((~F.bool_or(F.col("value").isNotNull()) & F.bool_or("declined")).alias("declined"))


def combined_error(readings: DataFrame, *keys: str) -> DataFrame:
    """(keys, error, detail): of items without a usable reading. One reading keeps its code; of several it is
    all_photos_unreadable, with the code that they share or `mixed`. Null for items with a usable reading.
    """
    own = readings.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(F.col("error").isNull()).alias("usable"), F.sort_array(F.collect_set("error")).alias("codes"))
    shared = F.when(F.size("codes") == 1, F.get("codes", F.lit(0))).otherwise(F.lit("mixed"))
    failed = lambda c: F.when(~F.col("usable"), c)
    return own.select(*keys, failed(F.when(F.col("n") == 1, F.get("codes", F.lit(0))).otherwise("all_photos_unreadable")).alias("error"), failed(F.when(F.col("n") > 1, shared)).alias("detail"))


def arm(readings: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, arm, basis): the arm to trust of arms with confidence and words.

    One arm: short_circuit. One within 1.0 of the best confidence: confidence. One of those with most words: coverage. Else
    the highest confidence, then the first: confidence.
    """
    whole, first = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("confidence"), "arm")
    seen = readings.withColumn("arms", F.count("*").over(whole)).withColumn("top", F.max("confidence").over(whole)).where(F.col("confidence") >= F.col("top") - settings.confidence_tie)
    seen = seen.withColumn("rivals", F.count("*").over(whole)).withColumn("most", F.max("words").over(whole))
    seen = seen.withColumn("leaders", F.count_if(F.col("words") == F.col("most")).over(whole)).withColumn("turn", F.row_number().over(first))
    by_words = (F.col("rivals") > 1) & (F.col("leaders") == 1)
    chosen = seen.where(F.when(by_words, F.col("words") == F.col("most")).otherwise(F.col("turn") == 1))
    return chosen.select(*keys, "arm", F.when(F.col("arms") == 1, "short_circuit").when(by_words, "coverage").otherwise("confidence").alias("basis"))


def quarter_turn(a: Column, b: Column, c: Column, d: Column, page_turn: Column) -> Column:
    """0 to 3 quarter turns of a placement matrix on a page turned by so many degrees; null if mirrored or slanted by over 1 degree."""
    angle, other = F.degrees(F.atan2(b, a)), F.degrees(F.atan2(-c, d))
    turns = F.rint(angle / 90)
    slanted = (F.abs(angle - turns * 90) > 1) | (F.abs(F.pmod(angle - other + 180, F.lit(360.0)) - 180) > 1)
    return F.when((a * d - b * c > 0) & ~slanted, F.pmod(turns.cast("int") + (page_turn / 90).cast("int"), F.lit(4)))
