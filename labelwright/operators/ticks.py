"""Which product type's box is ticked on a page: from captions and luminances to documents.ticked()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import BOX_GAP, BOX_SIZE, OPTION_STEMS
from . import documents


def captions(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, option, left, top, right, bottom): of each option the first run of words on one line that begin as its caption does.

    words: keys, word_idx, text, left, top, right, bottom. Signs around a word do not count.
    """
    own = words.withColumn("text", F.regexp_replace("text", r"^[ .:,]+|[ .:,]+$", ""))
    boxes = [documents.caption_box(own, stems, *keys).withColumn("option", F.lit(option)) for option, stems in OPTION_STEMS.items()]
    return reduce(DataFrame.unionByName, boxes)


def windows(boxes: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, option, x0, y0, x1, y1): the square left of each caption that holds its box, cut to the page; ends are outside.

    It is BOX_SIZE caption heights wide and high, ends BOX_GAP of them before the caption, and is centred on its line. Places
    are whole numbers, ties to even. pages: keys, width, height.
    """
    tall = F.col("bottom") - F.col("top")
    size, right, top = tall * BOX_SIZE, F.col("left") - tall * BOX_GAP, (F.col("top") + F.col("bottom")) / 2 - tall * (BOX_SIZE / 2)
    whole = lambda c, most: F.least(F.greatest(F.rint(c), F.lit(0)), most).cast("int")
    x, y = (lambda c: whole(c, F.col("width"))), (lambda c: whole(c, F.col("height")))
    return boxes.join(pages.select(*keys, "width", "height"), list(keys)).select(*keys, "option", x(right - size).alias("x0"), y(top).alias("y0"), x(right).alias("x1"), y(top + size).alias("y1"))


def means(boxes: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, option, luminance): the mean of the cells in each window (keys, option, x0, y0, x1, y1), null where it holds none.

    cells: keys, x, y, luminance. They pass a table of their partition's windows one by one and are summed there, so that they
    are neither sorted nor held, and what leaves a task is a sum for each window. Cells that come partitioned by keys are not
    shuffled, either.
    """
    asked = boxes.where("x1 > x0 AND y1 > y0").select(*keys, "option", "x0", "y0", "x1", "y1").hint("shuffle_hash")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    met = cells.select(*keys, "x", "y", "luminance").join(asked, list(keys)).where(inside)
    found = met.groupBy(*keys, "option").agg((F.sum("luminance") / F.count("luminance")).alias("luminance"))
    return boxes.select(*keys, "option").join(found, [*keys, "option"], "left")


def read(words: DataFrame, cells: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, separation, reason) of pages (keys, width, height), as documents.ticked() has them.

    A page without any caption is not_located, too.
    """
    seen = means(windows(captions(words, *keys), pages, *keys), cells, *keys)
    out = pages.select(*keys).join(documents.ticked(seen, *keys), list(keys), "left")
    return out.withColumn("reason", F.coalesce("reason", F.lit("not_located")))
