"""Rows that fail stay rows: each stage takes and gives a value or an error, and nothing that one row holds stops another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import missing
from .batch import DOCUMENT_TYPES, file_error

RECORD = "file string, type string, size string, words string, _corrupt string"
WORDS = "array<struct<text:string,height:string>>"


def started(value: Column) -> Column:
    """struct (value, error): a value without an error."""
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"))


def then(before: Column, make: Callable[[Column], Column], fails: Callable[[Column], Column]) -> Column:
    """struct (value, error) after a stage: make() of the value where there is no error, unless fails() names one.

    An error stays the row's, with the value that the stages before it gave lost; make() must be null on what it can't do,
    by try_ functions, not raise.
    """
    value = before["value"]
    error = F.coalesce(before["error"], fails(value))
    return F.struct(F.when(error.isNull(), make(value)).alias("value"), error.alias("error"))


def parsed(line: Column) -> Column:
    """struct (value, error) of a line of JSON: file, type, size and words as text; unreadable_line where it is no JSON object."""
    made = F.from_json(line, RECORD, {"columnNameOfCorruptRecord": "_corrupt"})
    whole = started(made)
    return then(whole, lambda v: v.dropFields("_corrupt"), lambda v: F.when(v.isNull() | v["_corrupt"].isNotNull() | ~F.coalesce(F.trim(line).startswith("{"), F.lit(False)), "unreadable_line"))


def accepted(record: Column, settings: Settings = DEFAULT) -> Column:
    """struct (value, error) of parsed(): a name, a type that is allowed, a size that is a number and not too large; size as long."""
    named = then(record, lambda v: v, lambda v: F.when(missing(v["file"]), "no_name"))
    size = lambda v: F.when(v["size"].rlike(r"^\d{1,18}$"), v["size"]).try_cast("long")
    sized = then(named, lambda v: v.withField("size", size(v)), lambda v: F.when(size(v).isNull(), "unreadable_size"))
    return then(sized, lambda v: v, lambda v: file_error(v["type"], v["size"], DOCUMENT_TYPES, settings))


def read(record: Column) -> Column:
    """struct (value, error) of accepted(): words as structs (text, height); unreadable_words where one has no text or no height of a number."""
    number = lambda w: F.when(w["height"].rlike(r"^\d+(\.\d+)?$"), w["height"]).try_cast("double")
    made = lambda v: F.transform(F.from_json(v["words"], WORDS), lambda w: F.struct(w["text"].alias("text"), number(w).alias("height")))
    wrong = lambda v: F.when(made(v).isNull() | F.exists(made(v), lambda w: w["text"].isNull() | w["height"].isNull()), "unreadable_words")
    return then(record, lambda v: v.withField("words", made(v)), wrong)


def lines(raw: DataFrame, *keys: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, position, name, status, error, text, height): a line for each raw row (keys, position, line), in error or not.

    The first stage that fails names the error, and the stages after it leave the row alone. name: the file's where the
    line could be parsed, else the position's. Repeated rows give repeated lines; a null line is unreadable.
    """
    own = raw.select(*keys, "position", parsed(F.col("line")).alias("p"))
    own = own.withColumn("a", accepted(F.col("p"))).withColumn("r", read(F.col("a")))
    name = F.coalesce(F.when(~missing(F.col("p.value.file")), F.col("p.value.file")), F.concat(F.lit("Label "), F.col("position").cast("string")))
    words = F.col("r.value.words")
    return own.select(
        *keys, "position", name.alias("name"), F.when(F.col("r.error").isNull(), "ok").otherwise("error").alias("status"), F.col("r.error").alias("error"),
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.array_max(F.transform(words, lambda w: w["height"])).alias("height"),
    )
