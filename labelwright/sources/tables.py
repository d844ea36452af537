"""Sources and sinks of the verification pipeline. Recognition of images and PDF is an adapter that yields `words`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = "item_id string, sheet_idx int, word_idx int, text string, conf double, left int, top int, width int, height int, page int, block int, par int, line int"
EXPECTED = "image_filename string, brand_name string, class_type string, alcohol_content string, net_contents string, government_warning_present string, government_warning string, notes string"
APPLICATIONS = "filename string, brand_name string, class_type string, alcohol_content string, net_contents string, beverage_type string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Submitted files of a folder with idx, their place by path. Paths alone are sorted, in ranges, and numbered."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.join(numbered(own.select("path"), "path"), "path").withColumn("filename", F.element_at(F.split("path", "/"), -1))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with idx, the place from 0 in the order of `by`: partitions are ranges of it, and only their sizes are summed in one place."""
    ranged = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id())
    own = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("idx", F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


def submitted(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts (keys, part, turn, filename) as one list: files, then images, then the document; idx from 0, and file-N for a missing name."""
    rank = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "turn")) - 1
    return parts.withColumn("idx", idx).withColumn("filename", F.when(F.trim("filename") != "", F.col("filename")).otherwise(F.concat(F.lit("file-"), (F.col("idx") + 1).cast("string"))))


def page_lines(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, line_idx, text): non-blank lines of pages (keys, page, text), numbered across pages; a page without text is skipped."""
    split = pages.where("text IS NOT NULL").select(*keys, "page", F.posexplode(F.split("text", r"\R")).alias("at", "line")).withColumn("text", _stripped("line")).where("text <> ''")
    return split.withColumn("line_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "at")) - 1).select(*keys, "line_idx", "text")


def _stripped(c: str):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)


def text_lines(docs: DataFrame, text: str, *keys: str, keep_top: bool = True) -> DataFrame:
    """Non-blank lines of a text column: keys, line_idx, top (the place before blanks went), text, stripped."""
    split = docs.select(*keys, F.posexplode(F.split(text, r"\R")).alias("top", "line")).withColumn("text", _stripped("line")).where("text <> ''")
    return split.withColumn("line_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("top")) - 1).select(*keys, "line_idx", *(["top"] if keep_top else []), "text")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: The export's header, and the parts of an upload in their order.
EXPORT = {"item": "Item", "field": "Field", "label_value": "Label value", "application_value": "Application value", "score": "Score", "outcome": "Outcome", "reason": "Reason", "error": "Error"}
PARTS = ("files", "image", "application_document")


def write_csv(rows: DataFrame, path: str) -> None:
    """export_rows() as CSV of eight columns with a header, quoted where needed; lines end in CR LF.

    Rows are lines of text in order of position and of an item's fields, as Spark's CSV writer has no line end of two characters.
    """
    cell = lambda c: F.coalesce(F.when(F.col(c).rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)), F.lit(""))
    line = F.concat_ws(",", *[cell(c) for c in EXPORT])
    head = rows.sparkSession.createDataFrame([(-1, 0, ",".join(EXPORT.values()))], "position long, place int, line string")
    ordered = head.unionByName(rows.select(F.col("position").cast("long").alias("position"), F.col("place").cast("int").alias("place"), line.alias("line"))).orderBy("position", "place").select("line")
    ordered.write.mode("overwrite").option("lineSep", "\r\n").text(path)
