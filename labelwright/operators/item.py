"""One item's verdicts: what is declared, what the label shows, and a decision for every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.quantities import abv_verdict, held, net_contents_verdict, once, verdict, with_abv
from ..functions.similarity import lcs_length
from ..functions.text import NATIVE, Folding, folding, missing
from ..functions.verdict import text_verdict
from ..vocab import COMPARED, FIELDS
from . import search, statement

UPLOADED, ARTWORK = "uploaded_photographs", "application_artwork"
SEARCHED, PRESENCE, RESCUED = ("brand_name", "class_type"), ("alcohol_content", "net_contents"), ("net_contents",)
#: Where a document's value came from, and what that is called in a result.
SOURCES = {"form_fields": "parsed_from_form", "embedded_text": "parsed_from_form", "embedded_artwork": "parsed_from_artwork", "product_type_box": "read_from_tick"}


def label_side(pictures: Column, panels: Column) -> Column:
    """The label is what was uploaded, else the document's own artwork; null where there is neither."""
    return F.when(pictures > 0, UPLOADED).when(panels > 0, ARTWORK)


def resolved(typed: Column, document: Column, source: Column, cleared: Column) -> Column:
    """struct (value, source): a typed value, else the document's unless its field was cleared, else absent."""
    named = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    made = lambda value, name: F.struct(value.alias("value"), name.alias("source"))
    return (
        F.when(~missing(typed), made(typed, F.lit("typed")))
        .when(~missing(document) & ~F.coalesce(cleared, F.lit(False)), made(document, F.coalesce(F.try_element_at(named, source), F.lit("parsed_from_form"))))
        .otherwise(made(F.lit(None).cast("string"), F.lit("absent")))
    )


def circular(side: Column, source: Column) -> Column:
    """Both sides of the row are one reading of the document's own artwork."""
    return F.coalesce((side == ARTWORK) & (source == "parsed_from_artwork"), F.lit(False))


def records(items: DataFrame, declared: DataFrame, values: DataFrame, names: tuple[str, ...] = COMPARED) -> DataFrame:
    """(item_id, side, fields): a row for each of items (item_id, side), with a struct for each field of names, in order.

    declared (item_id, field, declared, source) and values (item_id, field, value, sheet, column, block, declined) have at
    most one row a field; all three inputs are brought together by one shuffle. A field without a row has nulls. Rows with a
    null item_id are left out.
    """
    said = F.struct("field", "declared", "source")
    counts = [c for c in ("differing", "illegible") if c in values.columns]
    read = F.struct("field", "value", "sheet", "column", "block", "declined", *counts)
    none = lambda table, c: F.lit(None).cast(table.select(c).schema[0].dataType)
    heads = items.select("item_id", F.struct("side").alias("head"), none(declared, said).alias("said"), none(values, read).alias("read"))
    heads = heads.unionByName(declared.select("item_id", said.alias("said")), allowMissingColumns=True).unionByName(values.select("item_id", read.alias("read")), allowMissingColumns=True)
    whole = heads.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max("head").alias("head"), F.collect_list("said").alias("said"), F.collect_list("read").alias("read")).where("head IS NOT NULL")
    of = lambda c, f: F.get(F.filter(c, lambda x: x["field"] == f), F.lit(0))
    side = F.col("head.side")

    def one(f: Column) -> Column:
        d, v = of("said", f), of("read", f)
        own = circular(side, d["source"])
        shown = F.when(~(f.isin(*PRESENCE) & own), d["declared"])
        asks = ~missing(shown) & (f.isin(*SEARCHED) | f.isin(*RESCUED) & v["value"].isNull())
        return F.struct(
            f.alias("field"), own.alias("own"), shown.alias("said"), F.when(asks, F.trim(shown)).alias("needle"), v["value"].alias("value"),
            v["sheet"].alias("sheet"), v["column"].alias("column"), v["block"].alias("block"), v["declined"].alias("declined"),
            *[v[c].alias(c) for c in counts],
        )

    return whole.select("item_id", side.alias("side"), F.transform(F.array(*map(F.lit, names)), one).alias("fields"))


def best_hits(asked: DataFrame, units: DataFrame, settings: Settings = DEFAULT, common=lcs_length, strict: bool = False, folding: Folding = NATIVE) -> DataFrame:
    """(item_id, hits): of asked (item_id, asks), an array of (field, needle), the best sheet's hit of each field of items with units.

    A hit is a struct (field, hit, score, code, sheet, column, block, outcome). Each sheet's units (item_id, sheet, unit,
    column, block, text) are searched by themselves; ties go to the earlier sheet, and a sheet without a hit comes last.
    Only a class or type is also searched without its trailing code. Units meet an item's needles where its records are, and
    each stretch gives a row of its best run for each needle.
    """
    asked = asked.select("item_id", search.asked(F.col("asks")).alias("asks")).select("*", search.goals(F.col("asks")).alias("goals"))
    own = asked.join(units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id"), "item_id")
    keys = ("item_id", "sheet", "column", "block")
    best = search.unit_hits(own, *keys, common=common, strict=strict, folding=folding)
    if search.in_rows(common, strict, folding):
        best = best.repartition("item_id")
    place = F.struct(F.round("raw", 1).alias("score"), "hit", F.struct("column", "block").alias("unit"))
    turn = lambda i: F.max_by(F.when(F.col("raw").isNotNull(), place), F.when(F.col("turn") == i, search.order(strict, "unit", "size", "start"))).alias(f"h{i}")
    sheets = best.groupBy("item_id", "field", "sheet", "declared").agg(turn(0), turn(1))
    sheets = sheets.select("item_id", "field", "sheet", *search.chosen(F.col("h0"), F.col("h1"), F.col("declared"), settings))
    rank = F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("sheet"))
    hit = F.struct("field", "hit", "score", "code", "sheet", F.col("unit.column").alias("column"), F.col("unit.block").alias("block"), "outcome")
    fields = sheets.groupBy("item_id", "field").agg(F.max_by(hit, rank).alias("h"))
    return fields.groupBy("item_id").agg(F.collect_list("h").alias("hits"))


def decided(items: DataFrame, declared: DataFrame, values: DataFrame, units: DataFrame, settings: Settings = DEFAULT, common=lcs_length, strict: bool = False, body: str | None = None) -> DataFrame:
    """A row for every compared field of items (item_id, side): outcome, score, code, label_value, declared, sheet, column, block.

    declared and values: see records(); units and strict: see best_hits(). Brand and class are searched where they are
    declared and there is text, else compared with the reading. Net contents that no pattern found are taken from a search at
    match level; alcohol never is. A hit below review gives no label value. On a circular row a declared presence field is
    withdrawn, and a match is artwork_derived, without a score. A field that a ranking declined has that as its code, unless
    it was searched for. Every input is shuffled by item once; the records are used for the search and for the decision.

    body: the statement's, where it is to be decided, too. Its value is the statement as read, with the counts differing and
    illegible; its row has no score and no declared value.

    settings.strict_text: texts are compared after NFKC and casefold; see text.folding(). Hits are then in composed form.
    """
    text_form = folding(items.sparkSession, settings.strict_text)
    whole = records(items, declared, values, COMPARED if body is None else FIELDS)
    asks = F.transform(F.filter("fields", lambda f: f["needle"].isNotNull()), lambda f: F.struct(f["field"].alias("field"), f["needle"].alias("needle")))
    hits = best_hits(whole.select("item_id", asks.alias("asks")).where(F.size("asks") > 0), units, settings, common, strict, text_form)
    both = whole.join(hits, "item_id", "left").select("item_id", "hits", F.explode("fields").alias("f")).select("item_id", "hits", "f.*")
    field = F.col("field")
    seen = both.withColumn("h", F.get(F.filter("hits", lambda h: h["field"] == field), F.lit(0))).drop("hits")
    searched = field.isin(*SEARCHED) & F.col("h.outcome").isNotNull()
    rescued = field.isin(*RESCUED) & F.coalesce(F.col("h.score") >= settings.match_threshold, F.lit(False))
    shows = F.col("h.outcome").isin("match", "needs_review")
    pick = lambda hit, read: F.when(searched, F.when(shows, F.col(f"h.{hit}"))).when(rescued, F.col(f"h.{hit}")).otherwise(F.col(read))
    seen = seen.withColumn("searched", searched).withColumn("rescued", rescued).withColumn("label_value", pick("hit", "value"))
    label, said = F.col("label_value"), F.col("said")
    code = lambda c: verdict(F.col("h.outcome"), F.col("h.score"), c)
    found = F.when(F.col("h.score").isNull(), code("no_text")).when(F.col("h.outcome") == "match", code("found")).when(shows, code("close")).otherwise(code("not_found"))
    as_text = lambda c: F.when(~F.col("searched") & (field != "government_warning"), text_form.fold(text_form.compose(c)))  # others have verdicts of their own
    seen = seen.withColumn("_a", as_text(label)).withColumn("_b", as_text(said))
    compared = F.col("_a") != F.col("_b")
    seen = seen.withColumn("lcs", common(F.when(compared, F.col("_a")), F.when(compared, F.col("_b"))))
    text = text_verdict(label, said, settings, F.col("lcs"), (F.col("_a"), F.col("_b")))
    seen = seen.withColumn("_seen", F.when(field == "alcohol_content", label)).withColumn("_said", F.when(field == "alcohol_content", said))
    seen = with_abv(with_abv(seen, "_seen", "_seen_"), "_said", "_said_")
    made = (
        F.when(F.col("searched"), found)
        .when(field == "alcohol_content", abv_verdict(label, said, text["score"], settings, (held("_seen_"), held("_said_"))))
        .when(field == "net_contents", net_contents_verdict(label, said, text))
        .otherwise(text)
    )
    if body is not None:
        checks = statement.check(label, body, settings, F.coalesce("differing", F.lit(0)), F.coalesce("illegible", F.lit(0)))
        said_so = once(lambda c: F.struct(c["outcome"].alias("outcome"), F.lit(None).cast("double").alias("score"), F.when(c["found"], "statement").otherwise("absent").alias("code")), checks)
        made = F.when(field == "government_warning", said_so).otherwise(made)
    judged = seen.withColumn("v", made)
    derived = F.col("own") & (F.col("v.outcome") == "match") & (field != "government_warning")
    declined = F.coalesce(F.col("declined"), F.lit(False)) & ~F.col("searched") & ~F.col("rescued")
    return judged.select(
        "item_id", "field", F.when(derived, "artwork_derived").otherwise(F.col("v.outcome")).alias("outcome"), F.when(~derived, F.col("v.score")).alias("score"),
        F.when(declined, "declined").when(derived, "artwork").otherwise(F.col("v.code")).alias("code"), "label_value", F.when(~missing(said), said).alias("declared"),
        pick("sheet", "sheet").alias("sheet"), pick("column", "column").alias("column"), pick("block", "block").alias("block"),
    )


def with_panels(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """rows with the panel of the picture that their value came from: photos (item_id, sheet, panel)."""
    return rows.join(photos.select("item_id", "sheet", "panel"), ["item_id", "sheet"], "left")


def results(rows: DataFrame, statement: DataFrame) -> DataFrame:
    """(item_id, result): one JSON object an item, its fields in order and the statement's row last.

    statement: item_id and outcome of the statement's check.
    """
    order = F.array_position(F.array(*map(F.lit, COMPARED)), F.col("field"))
    fields = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("turn"), "field", "outcome", "score", "code", "label_value", "declared"))).alias("f"))
    both = fields.join(statement.select("item_id", F.col("outcome").alias("statement")), "item_id", "left")
    plain = F.transform("f", lambda x: F.struct(x["field"].alias("field"), x["outcome"].alias("outcome"), x["score"].alias("score"), x["code"].alias("code"), x["label_value"].alias("label_value"), x["declared"].alias("declared")))
    return both.select("item_id", F.to_json(F.struct("item_id", plain.alias("fields"), "statement")).alias("result"))
