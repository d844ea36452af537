"""Quality selection by importance resampling of hashed n-grams.

Two bag-of-n-grams models over the same hashed buckets are counted: one of the target (rows labelled good), one of all
raw text. A document's weight is the ratio of its probabilities under both, so its log weight is the sum of its n-grams'
log ratios. Adding Gumbel noise and taking the k largest keys draws k documents without replacement in proportion to
their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import U64, mixed

BUCKETS, SMOOTHING, SHARE, SEED = 1 << 14, 0.5, 0.85, 20240607
BATCH_CHARS = 1 << 20


def buckets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every text's words and word pairs, and how many each text has."""
    words, counts = [], []
    for text in texts:
        own = text.encode().lower().split() if text else ()
        words += own
        counts.append(len(own))
    h, n = base.WORDS.of(words), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    both = owner[1:] == owner[:-1]
    pairs = mixed(h[:-1] * base.MIX_A + h[1:])[both]
    every = np.concatenate((h, pairs))
    at = np.concatenate((owner, owner[1:][both]))
    order = np.argsort(at, kind="stable")
    return (mixed(every) % U64(BUCKETS)).astype(np.int64)[order], np.bincount(at, minlength=len(n))


def counted(docs: DataFrame) -> np.ndarray:
    """N-grams of (text) by bucket, over all rows: BUCKETS numbers reach the driver, whatever the input."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in base.chunks([len(x or "") for x in texts], BATCH_CHARS):
                total += np.bincount(buckets_of(texts[a:b])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in base.by_arrow(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def trained(docs: DataFrame, target: DataFrame) -> list[float]:
    """Log ratio of the target's and the raw model's probability by bucket, of tables with a text column."""
    good, raw = counted(target), counted(docs)
    p, q = ((c + SMOOTHING) / (c + SMOOTHING).sum() for c in (good, raw))
    ratio = np.log(p / q)
    return (ratio if good.sum() else np.zeros(BUCKETS)).tolist()


def weighed(docs: DataFrame, model: list[float], seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key) of (doc_id, text): key is the weight with Gumbel noise of a hash of id and seed."""

    def run(batch):
        ratio = np.array(model)
        texts, ids = batch.column(1).to_pylist(), batch.column(0)
        for a, b in base.chunks([len(x or "") for x in texts], BATCH_CHARS):
            found, n = buckets_of(texts[a:b])
            owner = np.repeat(np.arange(b - a), n)
            weight = np.bincount(owner, weights=ratio[found], minlength=b - a).astype(float)
            own = ids.slice(a, b - a)
            h = mixed(np.nan_to_num(own.fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64).view(U64) + U64(seed))
            noise = -np.log(-np.log((h >> U64(11)).astype(float) / (1 << 53) + 2.0**-54))
            yield pa.RecordBatch.from_arrays([own, pa.array(weight), pa.array(weight + noise)], names=["doc_id", "log_weight", "key"])

    return base.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, log_weight double, key double")


def threshold(keys: DataFrame, k: int, name: str = "rank_key") -> int | None:
    """The k-th largest of a long column, exactly: the interval that holds it is cut in 4096 until it is one value.

    Each pass counts by interval where the rows are; at most 4096 counts reach the driver.
    """
    low, high = keys.agg(F.min(name), F.max(name)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = -(-(high - low + 1) // 4096)
        inside = keys.where(F.col(name).between(low, high)).select(F.floor((F.col(name) - F.lit(low)) / F.lit(width)).cast("int").alias("cell"))
        for cell, n in sorted(inside.groupBy("cell").count().collect(), reverse=True):
            if k <= n:
                low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
                break
            k -= n
    return low


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, key, selected. ceil(share * rows) documents of the largest keys are selected.

    target: rows with text_col of the target distribution; none makes all weights 0. Null or text without words: weight
    0. Keys are compared in steps of 2^-20; of equal ones the smaller ids go first, a null id counts as 2^62. Ids may be null or
    repeat; repeated rows agree, and only they can make the number selected larger. An empty table gives an empty result.
    Other columns are ignored.
    """
    own = base.renamed(docs, doc_id=id_col, text=text_col)
    model = trained(own, base.renamed(target, text=text_col))
    out = base.written(weighed(own, model, seed), "weights")
    ranked = out.withColumn("rank_key", F.round(F.col("key") * F.lit(float(1 << 20))).cast("long"))
    k = -int(-share * out.count() // 1)
    least = threshold(ranked, k)
    if least is None:
        return ranked.select("doc_id", "log_weight", "key", F.lit(False).alias("selected"))
    tied = ranked.where(F.col("rank_key") == F.lit(least)).select((-F.coalesce("doc_id", F.lit(1 << 62))).alias("turn"))
    last = threshold(tied, k - ranked.where(F.col("rank_key") > F.lit(least)).count(), "turn")
    first = -F.coalesce("doc_id", F.lit(1 << 62)) >= F.lit(last)
    return ranked.select("doc_id", "log_weight", "key", ((F.col("rank_key") > F.lit(least)) | (F.col("rank_key") == F.lit(least)) & first).alias("selected"))
