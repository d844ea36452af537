"""From word boxes to columns, lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def gaps(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_left, gap_right): blanks that no word of the sheet covers, between covered stretches."""
    order = Window.partitionBy(*keys).orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    seen = words.withColumn("reach", F.max("right").over(order))
    return seen.where(F.col("left") > F.col("reach") + 1).select(*keys, (F.col("reach") + 1).alias("gap_left"), (F.col("left") - 1).alias("gap_right"))


def columns(words: DataFrame, sheets: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, column, col_left, col_right): a sheet's columns, cut in the middle of blanks that are wide enough.

    words: keys, left, right, height; sheets: keys, width. A blank must be 2.5 % of the width, and 1.25 times the largest
    type within one blank's width beside it; type is the shorter side of a box.
    """
    blank = gaps(words, *keys).join(sheets.select(*keys, "width"), list(keys)).withColumn("size", F.col("gap_right") - F.col("gap_left") + 1)
    wide = blank.where(F.col("size") >= F.greatest(F.lit(1), F.rint(F.col("width") * settings.column_gap_share)))
    boxes = words.select(*keys, "left", "right", F.least(F.col("right") - F.col("left") + 1, F.col("height")).alias("type"))
    near = (F.col("right") >= F.col("gap_left") - F.col("size")) & (F.col("left") <= F.col("gap_right") + F.col("size"))
    typed = wide.join(boxes, list(keys)).groupBy(*keys, "gap_left", "gap_right", "size").agg(F.max(F.when(near, F.col("type"))).alias("type"))
    cuts = typed.where(F.col("type").isNull() | (F.col("size") >= F.col("type") * settings.column_gap_type)).select(*keys, F.floor((F.col("gap_left") + F.col("gap_right")) / 2).cast("int").alias("col_left"))
    starts = sheets.select(*keys, F.lit(0).alias("col_left")).unionByName(cuts)
    order = Window.partitionBy(*keys).orderBy("col_left")
    ended = starts.withColumn("col_right", F.lead("col_left").over(order)).withColumn("column", F.row_number().over(order) - 1)
    return ended.join(sheets.select(*keys, "width"), list(keys)).select(*keys, "column", "col_left", F.coalesce("col_right", "width").alias("col_right"))


def placed(words: DataFrame, cols: DataFrame, *keys: str) -> DataFrame:
    """words with the column that holds their centre; the last one where none does."""
    held = cols.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "col_left", "col_right"))).alias("cols"))
    centre = (F.col("left") + F.col("right")) / 2
    inside = F.get(F.filter("cols", lambda c: (centre >= c["col_left"]) & (centre < c["col_right"])), F.lit(0))["column"]
    return words.join(held, list(keys), "left").withColumn("column", F.coalesce(inside, F.size("cols") - 1, F.lit(0))).drop("cols")


def lines(words: DataFrame, *keys: str) -> DataFrame:
    """Lines of words (keys, page, column, block, par, line, word_idx, text, conf, left, top, width, height), in reading order."""
    kept = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    made = kept.groupBy(*keys, "page", "column", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.round(F.avg("conf"), 1).alias("confidence"), F.avg("height").alias("height"), F.round(F.avg("width"), 1).alias("width"),
        F.min("top").alias("top"), F.min("word_idx").alias("first_word"),
    )
    order = Window.partitionBy(*keys).orderBy("page", "column", "top", "first_word")
    return made.withColumn("line_idx", F.row_number().over(order) - 1).withColumn("sideways", (F.col("width") > 0) & (F.col("height") > F.col("width")))


def islands(rows: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """rows with `island`: the number of the block of neighbouring lines of one size that a line is in.

    A line joins the one before it if it follows it directly in the same region, their heights are within 25 %, and its
    top is at most 2.5 line heights below. Heights of 0 never join.
    """
    order = Window.partitionBy(*keys).orderBy("line_idx")
    before = lambda c: F.lag(c).over(order)
    tall, short = F.greatest("height", before("height")), F.least("height", before("height"))
    joins = (
        (F.col("line_idx") == before("line_idx") + 1) & (F.col("column") == before("column")) & (F.col("block") == before("block"))
        & (short > 0) & ((tall - short) <= tall * settings.size_tolerance) & (F.col("top") - before("top") <= tall * settings.gap_lines)
    )
    marked = rows.withColumn("starts", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return marked.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def as_blocks() -> list[Column]:
    """Aggregates of a block's lines: first_line, n_lines, text, height, top, confidence, column, block."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), " ")
    return [
        F.min("line_idx").alias("first_line"), F.count("*").alias("n_lines"), text.alias("text"), F.max("height").alias("height"), F.min("top").alias("top"),
        F.round(F.avg("confidence"), 1).alias("confidence"), F.min_by("column", "line_idx").alias("column"), F.min_by("block", "line_idx").alias("block"),
    ]


def blocks(rows: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """Blocks of neighbouring lines of one size (see islands): keys, island, and as_blocks()'s columns.

    Lines that are `sideways` (where there is such a column) are in no block and part their neighbours, as their height is not
    their type's.
    """
    rows = rows.where(~F.coalesce("sideways", F.lit(False))) if "sideways" in rows.columns else rows
    return islands(rows, *keys, settings=settings).groupBy(*keys, "island").agg(*as_blocks())


def unclaimed(rows: DataFrame, claims: list[DataFrame], *keys: str) -> DataFrame:
    """Lines that no field located by pattern has claimed: claims are tables of keys and line_idx. Places stay, so that a claimed line parts its neighbours."""
    taken = claims[0].select(*keys, "line_idx")
    for more in claims[1:]:
        taken = taken.unionByName(more.select(*keys, "line_idx"))
    return rows.join(taken.distinct(), [*keys, "line_idx"], "left_anti")


def by_size(found: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """found with turn, the block's rank by size on its sheet, and clear: it stands out of those that follow.

    The tallest is first. A block stands out if the next is at most 0.7 of it; the last one always does, and without heights
    the first line's does.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("height"), "top", "first_line")
    clear = F.col("next").isNull() | (F.col("height") <= 0) | (F.col("next") <= F.col("height") * settings.stand_out)
    return found.withColumn("turn", F.row_number().over(order)).withColumn("next", F.lead("height").over(order)).withColumn("clear", clear).drop("next")


def stand_out(found: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """The block that stands out of each sheet by size: keys and its columns, or none."""
    return by_size(found, *keys, settings=settings).where("turn = 1 AND clear").drop("turn", "clear")


def two_fields(found: DataFrame, sheets: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, field, text, declined, and found's confidence, height, column, block): brand_name, the block that stands out of its
    sheet by size (see by_size), and class_type, the one that does of the rest.

    The second is looked for only where there is a first. declined: there were blocks to choose from, and none was chosen.
    """
    ranked = by_size(found, *keys, settings=settings)
    carried = [c for c in ("text", "confidence", "height", "column", "block") if c in found.columns]
    pick = lambda turn: F.max(F.when((F.col("turn") == turn) & F.col("clear"), F.struct(*carried)))
    own = ranked.groupBy(*keys).agg(pick(1).alias("first"), pick(2).alias("second"), F.count("*").alias("n"))
    both = sheets.select(*keys).join(own, list(keys), "left").withColumn("second", F.when(F.col("first").isNotNull(), F.col("second")))
    left = F.coalesce("n", F.lit(0)) - F.when(F.col("first").isNotNull(), 1).otherwise(0)
    row = lambda field, c, n: F.struct(F.lit(field).alias("field"), F.col(c).alias("b"), (F.col(c).isNull() & (n > 0)).alias("declined"))
    rows = both.select(*keys, F.explode(F.array(row("brand_name", "first", F.coalesce("n", F.lit(0))), row("class_type", "second", left))).alias("r"))
    return rows.select(*keys, "r.field", "r.b.*", "r.declined").select(*keys, "field", *carried, "declined")


def segmentation(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, columns, regions, n_lines, confidence) of lines; confidence is their mean to one decimal, 0 where there is none."""
    return rows.groupBy(*keys).agg(F.count_distinct("column").alias("columns"), F.count_distinct("column", "block").alias("regions"), F.count("*").alias("n_lines"), mean_confidence(F.col("confidence")).alias("confidence"))


def bounds(cols: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_columns, bounds): a sheet's columns, with an array of structs (left, right) in their order, of columns() rows."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("column", "col_left", "col_right"))), lambda c: F.struct(c["col_left"].alias("left"), c["col_right"].alias("right")))
    return cols.groupBy(*keys).agg(F.count("*").alias("n_columns"), every.alias("bounds"))


def mean_confidence(c: Column) -> Column:
    """An aggregate: the mean to one decimal, 0.0 of nothing."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1)


def item_confidence(sheets: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """(keys, confidence): the mean of the usable sheets' means (keys, confidence, error), not weighted by words.

    It is rounded as SQL engines round doubles: ten times the mean to a whole number. The product's own rounding takes up the
    last bit that a sum of doubles may lack, so that a mean of 36.15 that came out as 36.14999999999999 is 36.2.
    order: the column by which an item's sheets are summed up, one after the other. Without it the last bit of a sum, and so a
    mean between two tenths, depends on how rows are dealt out.
    """
    usable = F.when(F.col("error").isNull(), F.col("confidence"))
    rounded = lambda mean: (F.round(F.coalesce(mean, F.lit(0.0)) * 10) / 10).alias("confidence")
    if order is None:
        return sheets.groupBy(*keys).agg(rounded(F.avg(usable)))
    turns = Window.partitionBy(*keys).orderBy(order)
    so_far = sheets.select(*keys, F.avg(usable).over(turns.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_mean"), F.lead(F.lit(True)).over(turns).alias("_more"))
    return so_far.where("_more IS NULL").select(*keys, rounded(F.col("_mean")))
