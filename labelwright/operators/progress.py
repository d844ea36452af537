"""A batch's lines on their way: counters in passing, numbered lines, a sink that keeps each once, and a reader of broken streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: What a line carries beside its row.
LINE = "batch_id long, position long, total long, name string, status string, error string"


def counters() -> list[Column]:
    """Aggregates of batch.lines(): rows, files, failures, artwork_sided."""
    return [
        F.count("*").alias("rows"), F.sum("n_files").alias("files"), F.count_if(F.col("status") == "error").alias("failures"),
        F.count_if(F.col("label_side") == "application_artwork").alias("artwork_sided"),
    ]


def observed(rows: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """rows, and what counters() give of them when they have been written: the job that writes them counts them, no other does."""
    seen = Observation(name)
    return rows.observe(seen, *counters()), seen


def numbered(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """rows with total, the number of rows of their batch."""
    return rows.withColumn("total", F.count("*").over(Window.partitionBy(batch)))


def as_text(rows: DataFrame, columns: tuple[str, ...] = tuple(c.split(" ")[0] for c in LINE.split(", "))) -> Column:
    """A row as one line of JSON."""
    return F.to_json(F.struct(*columns))


def whole_lines(texts: DataFrame, *keys: str, schema: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Of texts (keys, line): the rows of lines that are whole, and (keys, line) of those that are not.

    A line is whole if it is an object of JSON, be it the last one without a line end. Blank lines are neither. Whole lines
    count wherever they stand: one that is broken takes no other with it.
    """
    made = F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    seen = texts.where("trim(line) <> ''").select(*keys, "line", made.alias("made"))
    good = F.col("made._corrupt").isNull() & F.col("made").isNotNull() & F.trim("line").startswith("{")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    whole = seen.where(F.coalesce(good, F.lit(False))).select(*keys, *[F.col(f"made.{c}").alias(c) for c in names if c not in keys])
    return whole, seen.where(~F.coalesce(good, F.lit(False))).select(*keys, "line")


def read(spark: SparkSession, path: str, schema: str = LINE) -> tuple[DataFrame, DataFrame]:
    """whole_lines() of the text files of a folder, cut off or not; a line that was sent twice is one row."""
    whole, broken = whole_lines(spark.read.text(path).withColumnRenamed("value", "line"), schema=schema)
    return whole.distinct(), broken


def missing(rows: DataFrame, received: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The rows whose (batch, position) has not been received."""
    return rows.join(received.select(batch, "position").distinct(), [batch, "position"], "left_anti")


def resumed(rows: DataFrame, path: str, batch: str = "batch_id") -> DataFrame:
    """Add to the folder the lines of rows that it lacks, by (batch, position), and give its whole lines.

    What was written before a failure stays, and is not written again, so that running it once more changes nothing. Files
    come to the folder by Spark's commit, whole or not at all; a cut file is left as it is, and its cut line is written anew.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    rest = missing(rows, read(spark, path)[0], batch) if there else rows
    rest.select(as_text(rest).alias("value")).write.mode("append").text(path)
    return read(spark, path)[0]
