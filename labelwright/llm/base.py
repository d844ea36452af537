"""Shared plumbing of the corpus operators: shared-folder tables, hashing, batching."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in local mode, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_labelwright_dir", None)
        if not found:
            found = spark._labelwright_dir = f"file://{tempfile.mkdtemp(prefix='labelwright-')}"
            atexit.register(_remove, spark, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # the session may have ended; the folder is then the cluster's to clear
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._labelwright_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_labelwright_path", None):
            _remove(t.sparkSession, path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that others can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


_remembered: list = []
_owner = [""]


def remembered(cache):
    """Registers what a module keeps between tasks; a worker clears it when another module's function comes."""
    _remembered.append(cache)
    return cache


def settle(owner: str) -> None:
    """Workers are used again by other operators: before a task, what an earlier operator kept goes, and its memory with it."""
    if _owner[0] != owner:
        for cache in _remembered:
            cache.clear()
        trim()
        _owner[0] = owner


def trim() -> None:
    """After a task, free memory goes back to the system, as executors' Python workers live on."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


ROWS_A_BATCH, ROWS_SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def smaller_batches(spark: SparkSession) -> None:
    """Batches of whole texts are at most ROWS_A_BATCH rows, unless the session has fewer: both sides of a worker's pipe hold one."""
    if not 0 < int(spark.conf.get(ROWS_SETTING, "10000")) <= ROWS_A_BATCH:
        spark.conf.set(ROWS_SETTING, str(ROWS_A_BATCH))


def by_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    ship(df.sparkSession)
    smaller_batches(df.sparkSession)
    owner = owner or function.__module__

    def run(batches):
        settle(owner)
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return by_arrow(df, run, schema, owner or function.__module__)


def chunks(sizes: list[int], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to about `most` at most, of at most `rows` rows; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start == rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> U64(32))
    h *= MIX_A
    h ^= h >> U64(29)
    h *= MIX_B
    h ^= h >> U64(32)
    return h


def long_hash(data: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >= 1 << 63 else h


class WordHashes(dict):
    """Word -> 64-bit hash; cleared when large, so a worker's memory stays bounded."""

    LARGEST = 250_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LARGEST:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


WORDS = remembered(WordHashes())


def word_shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every text, sorted, and offsets; A-Z lower-cased, split at ASCII space.

    A text with fewer than `width` words has one shingle, its whole sequence; without words, none.
    """
    words, counts = [], []
    for text in texts:
        own = text.encode().lower().split() if text else ()
        words += own
        counts.append(len(own))
    h, n = WORDS.of(words), np.array(counts, np.int64)
    ends = np.cumsum(n)
    rows = np.maximum(n - width + 1, np.minimum(n, 1))
    at = np.repeat(ends - n - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
    last = np.repeat(ends, rows)
    out = np.full(len(at), 0x51ED270B, U64)
    for j in range(width):
        inside = at + j < last
        step = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(inside, mixed(out * MIX_B + step + U64(j + 1)), out)
    starts = np.concatenate(([0], np.cumsum(rows)))
    parts = [np.unique(out[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else out), offsets


def packed(text: str | None) -> bytes:
    """UTF-8, zstd: texts that must be shuffled travel at under half their size."""
    return zstandard.ZstdCompressor(level=1).compress((text or "").encode())


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def zipped(docs: DataFrame, carry: tuple[str, ...] = (), keyed: bool = False) -> DataFrame:
    """(doc_id, z, rest): compressed texts of (doc_id, text) for a shuffle; rest is a struct of the carried columns.

    keyed adds text_key, 128 bits of the hash of the text's bytes.
    """
    rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    own = docs.select("doc_id", "text", rest.alias("rest"))

    def run(batch):
        c = zstandard.ZstdCompressor(level=1)
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for a, b in chunks(sizes, 1 << 23):
            rows = [(x or "").encode() for x in batch.column(1).slice(a, b - a).to_pylist()]
            made = {"doc_id": batch.column(0).slice(a, b - a), "z": pa.array(map(c.compress, rows), pa.binary()), "rest": batch.column(2).slice(a, b - a)}
            if keyed:
                made["text_key"] = pa.array(map(xxhash.xxh3_128_digest, rows), pa.binary())
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return mapped(own, run, f"doc_id long, z binary, rest {own.schema['rest'].dataType.simpleString()}" + ", text_key binary" * keyed)


BITS_AN_ID, MOST_BITS = 16, 27


def marked(df: DataFrame, ids: DataFrame, key: str = "doc_id", name: str = "_may") -> DataFrame:
    """df with a boolean column that is true for every key in the one-column table of ids, and for few others.

    Ids are hashed into a bitmap of 16 bits an id, up to 2^MOST_BITS bits (2 million 64-bit words): a larger number of ids
    makes it less selective, never wrong. It is joined by broadcast of its words that are not 0, and keeps rows that a join
    would drop out of the join's shuffle. A null key may be either.
    """
    n = ids.count()
    bits = min(max(16, (n * BITS_AN_ID).bit_length()), MOST_BITS)
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    flag = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (at(c) % 64).cast("int"))
    words = ids.select(F.col(ids.columns[0]).alias("_id")).select(F.floor(at("_id") / 64).alias("_word"), flag("_id").alias("_bits"))
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    found = df.join(F.broadcast(words), F.floor(at(key) / 64) == F.col("_word"), "left")  # 2^21 rows of 16 bytes at most
    return found.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(flag(key)) != 0, F.lit(False))).drop("_word", "_bits")


def among(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key may be in the one-column table of ids: all that are, and few others."""
    return marked(df, ids, key).where("_may").drop("_may")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """df without the rows whose key is in the one-column table of ids; only rows that may be in it are shuffled. Null keys stay."""
    seen = marked(df, ids, key)
    stay = seen.where(f"NOT _may OR `{key}` IS NULL").drop("_may")
    gone = ids.select(F.col(ids.columns[0]).alias(key))
    return stay.unionByName(seen.where(f"_may AND `{key}` IS NOT NULL").drop("_may").join(gone, key, "left_anti"))


def appended(df: DataFrame, source: str, name: str, kind: str, function: Callable[[pa.Array], pa.Array], most: int = 1 << 20, keep: bool = True) -> DataFrame:
    """df with a column computed from a string or int-array column, in slices of about `most` bytes; a column of that name is replaced.

    keep=False leaves the source column out, so that it does not travel back.
    """
    kept = [c for c in df.columns if c != name and (keep or c != source)]
    inner = df.select(F.col(f"`{source}`").alias("value"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("rest"))

    def run(batch):
        values = batch.column(0)
        sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        for a, b in chunks(pc.fill_null(sizes, 0).to_pylist(), most):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), function(values.slice(a, b - a))], names=["rest", "made"])

    out = mapped(inner, run, f"rest {inner.schema['rest'].dataType.simpleString()}, made {kind}", function.__module__)
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(kept)], F.col("made").alias(name))
