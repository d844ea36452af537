"""From the lines of an item's sheets to its fields: what is read off each sheet, merged, searched for and decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.quantities import states_alcohol, states_net_contents
from ..functions.similarity import lcs_length
from ..vocab import FIELDS, STATEMENT_BODY
from . import item, layout, search, statement


def located(lines: DataFrame, *keys: str, body: str = STATEMENT_BODY) -> DataFrame:
    """lines (keys, line_idx, text, ...) with the field that claims each, null for none, and their sheet's statement.

    government_warning claims the statement's lines with a letter. Of the other lines the first that states an alcohol content and
    the first that states net contents are theirs; one line may be both, and then is alcohol_content with `both` true.
    """
    seen = statement.within(lines, *keys, body=body)
    inside = F.coalesce(F.col("line_idx").between(F.col("first"), F.col("last")) & F.col("text").rlike(r"\p{L}"), F.lit(False))
    seen = seen.withColumn("_in", inside)
    sheet = Window.partitionBy(*keys)
    at = lambda states: F.min(F.when(~F.col("_in") & states(F.col("text")), F.col("line_idx"))).over(sheet)
    seen = seen.withColumn("_abv", at(states_alcohol)).withColumn("_net", at(states_net_contents))
    abv, net = (F.coalesce(F.col("line_idx") == F.col(c), F.lit(False)) for c in ("_abv", "_net"))
    claim = F.when(F.col("_in"), "government_warning").when(abv, "alcohol_content").when(net, "net_contents")
    return seen.withColumn("claim", claim).withColumn("both", abv & net).drop("_in", "_abv", "_net", "first", "last")


def fields(lines: DataFrame, *keys: str, body: str = STATEMENT_BODY, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, field, value, confidence, prominence, column, block, declined, differing, illegible): a row for each of the five fields of each sheet.

    lines: as layout.lines() makes them. Alcohol and net contents are the lines that state them, the statement its lines, brand
    and class the blocks that stand out of the lines that nothing claims (see layout.two_fields). prominence is the type's
    height, 0 for a field found by pattern. A field that is not there has a null value, and so has a statement that its check
    does not find. differing and illegible are the statement's lines as statement.legibility() counts them; null for other fields.

    Windows and groups of one partitioning: lines are shuffled once, and each step reads the one before it, so that nothing is
    computed twice.
    """
    differs, unsure = statement.illegibility(body, settings)
    kind = F.coalesce("claim", F.when(F.coalesce("sideways", F.lit(False)), "sideways").otherwise("size"))
    claimed = located(lines, *keys, body=body).withColumn("kind", kind).withColumn("differs", differs).withColumn("unsure", unsure)
    # claimed lines leave their places, so that they part their neighbours
    placed = layout.islands(claimed, *keys, "kind", settings=settings).withColumn("island", F.when(F.col("kind") == "size", F.col("island")).otherwise(0))
    more = [F.max("statement").alias("statement"), F.max("both").alias("both"), F.count_if("differs").alias("differing"), F.count_if("unsure").alias("illegible")]
    parts = placed.groupBy(*keys, "kind", "island").agg(*layout.as_blocks(), *more)
    ranked = layout.by_size(parts, *keys, "kind", settings=settings)

    def pick(cond, value=F.col("text"), size=F.lit(0.0), differing=F.lit(None).cast("long"), illegible=F.lit(None).cast("long")):
        own = F.struct(value.alias("value"), "confidence", size.alias("prominence"), "column", "block", differing.alias("differing"), illegible.alias("illegible"))
        return F.max(F.when(cond, own))

    large = lambda turn: pick((F.col("kind") == "size") & (F.col("turn") == turn) & F.col("clear"), size=F.col("height").cast("double"))
    said = (F.col("kind") == "government_warning") & statement.located(F.col("statement"))[0]
    sheets = ranked.groupBy(*keys).agg(
        large(1).alias("brand_name"), large(2).alias("class_type"), pick(F.col("kind") == "alcohol_content").alias("alcohol_content"), pick((F.col("kind") == "net_contents") | F.col("both")).alias("net_contents"),
        pick(said, F.col("statement"), differing=F.col("differing"), illegible=F.col("illegible")).alias("government_warning"), F.count_if(F.col("kind") == "size").alias("sized"),
    )
    first = F.col("brand_name").isNotNull()
    sheets = sheets.withColumn("class_type", F.when(first, F.col("class_type")))
    left = {"brand_name": F.col("sized"), "class_type": F.col("sized") - first.cast("int")}
    row = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("r"), (F.col(f).isNull() & (left.get(f, F.lit(0)) > 0)).alias("declined"))
    return sheets.select(*keys, F.explode(F.array(*map(row, FIELDS))).alias("x")).select(*keys, "x.field", "x.r.*", "x.declined")


def merged(read: DataFrame, key: str = "item_id", sheet: str = "sheet") -> DataFrame:
    """(item_id, field, value, sheet, column, block, differing, illegible, declined): of each field the sheet that shows it best.

    Brand and class: the largest type, then the surest reading; the statement: the longest, then the surest; others: the surest.
    Ties go to the earlier sheet. declined: no sheet has it, and one had blocks to choose from.
    """
    size = F.when(F.col("field") == "government_warning", F.length("value")).otherwise(F.col("prominence"))
    rank = F.when(F.col("value").isNotNull(), F.struct(size, "confidence", -F.col(sheet)))
    best = read.groupBy(key, "field").agg(F.max_by(F.struct("value", F.col(sheet).alias("sheet"), "column", "block", "differing", "illegible"), rank).alias("b"), F.max("declined").alias("declined"))
    return best.select(key, "field", "b.*", (F.col("b.value").isNull() & F.col("declined")).alias("declined"))


def verified(words: DataFrame, items: DataFrame, declared: DataFrame, photos: DataFrame, body: str = STATEMENT_BODY, settings: Settings = DEFAULT, common=lcs_length, strict: bool = False) -> DataFrame:
    """A row for each of the five fields of items (item_id, side), from words (item_id, sheet, page, column, block, ...).

    words: what layout.lines() takes. Lines are assembled, fields read off each sheet and merged, declared values (item_id,
    field, declared, source) searched for, and each field decided: see item.decided(). The statement's row has its check's
    outcome, mismatch where no sheet has it. photos (item_id, sheet, panel) name the pictures that values come from.
    """
    keys = ("item_id", "sheet")
    lines = layout.lines(words, *keys)
    values = merged(fields(lines, *keys, body=body, settings=settings))
    rows = item.decided(items, declared, values, search.units(lines, *keys), settings, common, strict, body)
    return item.with_panels(rows, photos)
