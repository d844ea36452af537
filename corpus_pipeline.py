"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents, with text and n_chars as the stage leaves them. run() writes each stage's rows to the shared folder.

1. language: documents whose language is rejected go: no text, no letter, or no margin between the languages.
2. near_dedup: of each group of near copies the document of the smallest id stays. Rows of one id are documents of their own
   where their texts are not near copies: of those that are, the longest stays. A row without text goes where its id has a
   text. A null id stays.
3. suffix_dedup: repeated passages of 200 bytes or more go from the texts, in whole characters. No document goes; one that
   is nothing but repeats has an empty text. A null id keeps its text.
4. pii: personal data is replaced by its kind.
5. packing: the texts' tokens in sequences of at most 4096, a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.llm import langid, near_dedup, pii, suffix_dedup
from labelwright.llm.base import documents, marked, release, without_ids, written
from labelwright.llm.catalog import held_out, packed_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    model = langid.trained(docs.where(~held_out()))
    return langid.judged(docs.select(*COLUMNS), model, name="_language").where("NOT _language.rejected").drop("_language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document; see above for rows of one id."""
    gone = written(near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "gone")
    return one_row_each(without_ids(docs.select(*COLUMNS), gone))


def one_row_each(docs: DataFrame) -> DataFrame:
    """Of the rows of each id that is not null one for each text that is no near copy of another; only rows whose id may repeat
    are shuffled, and only those that do repeat are searched for near copies, each text under a number of its own.
    """
    often = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated_ids")
    if often.isEmpty():
        return docs.select(*COLUMNS)
    seen = marked(docs, often)
    alone = seen.where("NOT _may OR doc_id IS NULL").select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    some = seen.where("_may AND doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    texts = some.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("_most")).withColumnRenamed("doc_id", "_id")
    real = texts.join(sizes, F.col("doc_id") == F.col("_id")).where("text <> '' OR _most = 0").drop("_id", "_most")
    # of an id's near copies the longest stays
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text")
    turns = written(real.withColumn("_turn", F.row_number().over(order)), "texts_of_ids")
    several = turns.where("_turn = 2").select("doc_id")
    many = written(turns.join(several, "doc_id").withColumn("_key", F.monotonically_increasing_id()), "numbered_texts")
    parts = near_dedup.near_duplicates(many.select("_key", "text"), id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    first = many.join(parts, "_key").groupBy("doc_id", "component_id").agg(F.min_by(F.struct("text", "_rest"), "_turn").alias("_row"))
    single = turns.join(several, "doc_id", "left_anti").select("doc_id", "text", "_rest")
    kept = single.unionByName(first.select("doc_id", "_row.text", "_row._rest"))
    return alone.unionByName(kept.select("doc_id", "text", *[F.col(f"_rest.{c}").alias(c) for c in rest]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages."""
    out = suffix_dedup.without_repeats(docs, carry=("lang", "source", "n_chars"), as_text=True)
    return _with_text(out, F.col("kept")).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind."""
    out = pii.searched(docs.select(*COLUMNS), name="_personal")
    return _with_text(out, F.col("_personal.masked"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: the sequence that it is in, and its place there."""
    return packed_documents(docs)


STAGES = [("language", language), ("near_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("pii", personal_data), ("packing", packing)]
ORACLE_SQL = None  # language and packing have no SQL form; tests/llm hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written as Parquet and read again as the next one's input."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), name), docs
        release(before)  # no later stage reads it
    return STAGES[-1][1](spark, docs, sf_dir)
