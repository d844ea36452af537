"""Batches of files: grouping by name, shapes of groups, row errors, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import guarded_cell, stem
from ..vocab import OUTCOMES


#: Accepted media types, and the shapes of a group.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/tiff")
DOCUMENT_TYPES = (*IMAGE_TYPES, "application/pdf")
SHAPES = ("pair", "application", "image", "ambiguous", "failed", "reading")


def grouped(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Items of files (batch, idx, filename, ...): batch, stem, position by first appearance, n_files, first_file."""
    own = files.withColumn("stem", stem(F.col("filename"))).groupBy(batch, "stem").agg(F.min("idx").alias("first"), F.count("*").alias("n_files"), F.min_by("filename", "idx").alias("first_file"))
    return own.withColumn("position", F.row_number().over(Window.partitionBy(batch).orderBy("first"))).drop("first")


def renamed_duplicates(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """files with name: a repeated filename gets its overall place, so that it stays a row of its own."""
    nth = F.row_number().over(Window.partitionBy(batch, "filename").orderBy("idx"))
    part = F.row_number().over(Window.partitionBy(batch).orderBy("idx"))
    out = files.withColumn("nth", nth).withColumn("part", part)
    return out.withColumn("name", F.when(F.col("nth") > 1, F.format_string("%s (duplicate, part %d)", "filename", "part")).otherwise(F.col("filename"))).drop("nth", "part")


def group_shape(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, shape) of files with side (application, label, failed or null while unknown)."""
    n = lambda side: F.count_if(F.col("side") == side)
    own = files.groupBy(*keys).agg(F.count_if(F.col("side").isNull()).alias("unknown"), n("failed").alias("failed"), n("application").alias("a"), n("label").alias("l"))
    shape = F.when(F.col("unknown") > 0, "reading").when(F.col("failed") > 0, "failed").when((F.col("a") == 1) & (F.col("l") == 1), "pair").when((F.col("a") == 1) & (F.col("l") == 0), "application").when((F.col("a") == 0) & (F.col("l") == 1), "image").otherwise("ambiguous")
    return own.select(*keys, shape.alias("shape"))


def row_error(applications: Column, labels: Column, panels: Column | None = None) -> Column:
    """Error code of a batch row by its counts, documents first; null if it can be checked. A row holds one label."""
    nothing = labels == 0 if panels is None else (labels == 0) & (F.coalesce(panels, F.lit(0)) == 0)
    return F.when(applications > 1, "duplicate_application_document").when(labels > 1, "duplicate_label_stem").when(nothing, "no_label_to_check")


def item_error(applications: Column, labels: Column, panels: Column, settings: Settings = DEFAULT) -> Column:
    """Error code of a single item, which may have several pictures of its label; null if it can be checked."""
    return F.when(labels > settings.max_photos, "too_many_photos").when(applications > 1, "too_many_application_documents").when((labels == 0) & (panels == 0), "no_label_to_check")


def file_error(content_type: Column, size: Column, allowed: tuple[str, ...], settings: Settings = DEFAULT) -> Column:
    """Error code of a file by type and size; null if it is accepted. A null type is not allowed."""
    return F.when(~F.coalesce(content_type.isin(*allowed), F.lit(False)), "unsupported_media_type").when(size > settings.max_file_bytes, "file_too_large")


def refuse_oversized(files: DataFrame, batch: str = "batch_id", settings: Settings = DEFAULT) -> None:
    """Raise before any work if a batch has more rows than are allowed."""
    worst = files.groupBy(batch).agg(F.count_distinct(stem(F.col("filename"))).alias("n")).agg(F.max("n")).first()[0]
    if worst and worst > settings.max_rows:
        raise ValueError(f"{worst} rows in a batch; {settings.max_rows} are allowed")


def refusals(files: DataFrame, batch: str = "batch_id", settings: Settings = DEFAULT) -> DataFrame:
    """(batch, error, rows, limit): the batches with more rows than are allowed, by the stems of their files (batch, filename)."""
    sizes = files.groupBy(batch).agg(F.count_distinct(stem(F.col("filename"))).alias("rows"))
    return sizes.where(F.col("rows") > settings.max_rows).select(batch, F.lit("batch_too_large").alias("error"), "rows", F.lit(settings.max_rows).cast("long").alias("limit"))


def admitted(files: DataFrame, batch: str = "batch_id", settings: Settings = DEFAULT) -> DataFrame:
    """files without those of refused batches: such a batch is refused as a whole, before any of its files is looked at."""
    return files.join(refusals(files, batch, settings).select(batch), batch, "left_anti")


def bucket_tally(rows: DataFrame, outcome: str = "row_outcome") -> DataFrame:
    """(turn, bucket, n): rows of each outcome and of `error`, zero where there is none; turn is the order of display."""
    spark = rows.sparkSession
    buckets = spark.createDataFrame([(o, i) for i, o in enumerate((*OUTCOMES, "error"))], "bucket string, turn int")
    counted = rows.groupBy(F.col(outcome).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counted, "bucket", "left").select("turn", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def lines(files: DataFrame, checked: DataFrame, batch: str = "batch_id") -> DataFrame:
    """A line for each item of files (batch, idx, filename, content_type, size, side, panels): batch, position, name, status, error.

    The first thing wrong decides, and stays with its row: a file that is not accepted, in the order of files, then the
    counts. checked (batch, stem, error) has the errors of reading, which come last. The name is the first label's, else
    the first file's.
    """
    own = files.withColumn("stem", stem(F.col("filename"))).withColumn("wrong", file_error(F.col("content_type"), F.col("size"), DOCUMENT_TYPES))
    label = F.col("side") == "label"
    made = own.groupBy(batch, "stem").agg(
        F.min("idx").alias("first"), F.count("*").alias("n_files"), F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("idx"))).alias("wrong"),
        F.count_if(F.col("side") == "application").alias("applications"), F.count_if(label).alias("labels"), F.max("panels").alias("panels"),
        F.min_by("filename", "idx").alias("first_file"), F.min_by("filename", F.when(label, F.col("idx"))).alias("first_label"),
    )
    made = made.withColumn("position", F.row_number().over(Window.partitionBy(batch).orderBy("first"))).join(checked, [batch, "stem"], "left")
    name = F.when(F.col("wrong").isNull(), F.coalesce("first_label", "first_file")).otherwise(F.col("first_file"))
    error = F.coalesce("wrong", row_error(F.col("applications"), F.col("labels"), F.col("panels")), "error")
    side = F.when(error.isNull(), F.when(F.col("labels") == 0, "application_artwork").otherwise("uploaded_photographs"))
    return made.select(batch, "position", "stem", "n_files", name.alias("name"), F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"), side.alias("label_side"))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters of lines(): rows, files, failures, artwork_sided."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("n_files").alias("files"), F.count_if(F.col("status") == "error").alias("failures"), F.count_if(F.col("label_side") == "application_artwork").alias("artwork_sided"))


def shown(rows: DataFrame, received: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows (batch, position, name) with the lines received (batch, position, name, status) by position.

    A row without a line is pending; a line without a row is shown as well. A line's name goes first; one without any
    name is called by its position.
    """
    line = received.select(batch, "position", F.col("name").alias("line_name"), "status")
    both = rows.join(line, [batch, "position"], "full_outer")
    name = F.coalesce("line_name", "name", F.concat(F.lit("Label "), F.col("position").cast("string")))
    return both.select(batch, "position", name.alias("name"), F.coalesce("status", F.lit("pending")).alias("status"))


def shape_counts(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, shape, n): groups of each shape, zero where there is none."""
    counts = groups.groupBy(*keys).agg(*[F.count_if(F.col("shape") == s).alias(s) for s in SHAPES])
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), F.col(s).alias("n")) for s in SHAPES])).alias("x")).select(*keys, "x.*")


def export_rows(results: DataFrame) -> DataFrame:
    """One guarded row for each item and field of results (item, position, error, fields), one for an errored item; place is the field's."""
    flat = results.select("item", "position", "error", F.posexplode_outer("fields").alias("place", "f"))
    cells = [guarded_cell(F.col(c)).alias(c) for c in ("item", "error")] + [guarded_cell(F.col(f"f.{c}")).alias(c) for c in ("field", "label_value", "application_value", "outcome", "reason")]
    return flat.select("position", "place", *cells, F.format_number("f.score", 1).alias("score"))
