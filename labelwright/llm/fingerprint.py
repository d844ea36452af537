"""Document fingerprints by locally consistent parsing.

Each level first names runs of one symbol, then reduces the alphabet by deterministic coin tossing: a symbol's label
becomes the place of the lowest bit in which it differs from its left neighbour, and that bit; four steps leave six
labels, of which neighbours differ. Blocks start at local maxima of the labels, so they depend on a few symbols
around them only, and a block's name is the hash of its symbols: a substring has the same interior names at any
offset of any text. The names of the block level are the symbols of the next.

A fingerprint holds, for each of three levels (phrases of about 9, 27 and 80 characters), 32 minima of hashed
names, each hashed again to 16 bits. The likeness of two is the share of equal minima, the mean Jaccard similarity of their phrase sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import U64, mixed

LEVELS, SLOTS = (2, 3, 4), 32
BATCH_CHARS = 1 << 19
SEEDS = mixed(np.arange(1, SLOTS + 1, dtype=U64) * base.MIX_A)
EMPTY = "0" * (4 * SLOTS * len(LEVELS))
_steps = mixed(np.arange(1, 4097, dtype=U64) * base.MIX_B) | U64(1)


def parsed(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and their number in each text. names: joined symbols of texts; no size is 0."""
    starts = np.cumsum(sizes) - sizes
    head = np.zeros(len(names), bool)
    head[starts] = True
    change = head.copy()
    change[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(change)
    runs = np.diff(np.concatenate((at, [len(names)])))
    x = names[at]
    if len(at) < len(names):
        many = runs > 1
        x[many] = mixed(x[many] + runs[many].astype(U64) * base.MIX_A)
    head = head[at]
    label = x
    for step in range(4):
        low = label[1:] ^ label[:-1]
        low &= ~low + low.dtype.type(1)
        place = np.bitwise_count(low - low.dtype.type(1))
        new = np.empty(len(label), np.uint8)
        new[1:] = 2 * place + ((label[1:] & low) != 0)
        first = np.flatnonzero(head)
        new[first] = (label[first] & label.dtype.type(1)).astype(np.uint8)
        label = new
    begin = head.copy()
    rise, fall = np.zeros(len(label), bool), np.ones(len(label), bool)
    rise[1:] = (label[1:] > label[:-1]) & ~head[:-1]
    fall[:-1] = (label[:-1] > label[1:]) | head[1:]
    begin |= rise & fall & ~head
    cut = np.flatnonzero(begin)
    length = np.diff(np.concatenate((cut, [len(x)])))
    inside = np.arange(len(x)) - np.repeat(cut, length)
    total = np.add.reduceat(mixed(x.copy()) * _steps[inside & 4095], cut)
    return mixed(total + length.astype(U64) * base.MIX_B), np.add.reduceat(begin, np.flatnonzero(head)).astype(np.int64)


def minima(texts: list[str]) -> np.ndarray:
    """len(texts) x (levels * SLOTS) 16-bit values; 0 throughout for an empty text."""
    out = np.zeros((len(texts), len(LEVELS) * SLOTS), np.uint16)
    full = [i for i, x in enumerate(texts) if x]
    if not full:
        return out
    codes = np.frombuffer("".join([texts[i] for i in full]).encode("utf-32-le"), np.uint32)
    names = mixed(codes.astype(U64) + U64(1))
    sizes = np.array([len(texts[i]) for i in full], np.int64)
    for level in range(1, LEVELS[-1] + 1):
        names, sizes = parsed(names, sizes)
        if level in LEVELS:
            starts = np.cumsum(sizes) - sizes
            at = LEVELS.index(level) * SLOTS
            for j, seed in enumerate(SEEDS):
                least = np.minimum.reduceat((names ^ seed) * base.MIX_A, starts)
                out[full, at + j] = (mixed(least) >> U64(48)).astype(np.uint16)  # the top bits of a minimum of many are all 0
    return out


def written_out(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint. Null text: as empty, all zeros. Equal texts have equal ones."""

    def run(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in base.chunks([len(x) for x in texts], BATCH_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(written_out(minima(texts[a:b])))], names=["doc_id", "fingerprint"])

    own = base.renamed(docs, doc_id=id_col, text=text_col)
    return base.mapped(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def likeness(a: str | None, b: str | None) -> float:
    """Share of equal minima of two fingerprints, 0 to 1."""
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def _bucketed(docs: DataFrame, parts: int) -> tuple[DataFrame, list[int]]:
    """Rows (bucket, turn, doc_id, z) by ranges of ids, and each bucket's first row again in the one before it.

    turn 1 marks those; the very first row comes again in the last bucket. Only bounds of buckets reach the driver.
    """
    shares = ", ".join(str(k / parts) for k in range(1, parts))
    bounds = docs.selectExpr(f"percentile_approx(doc_id, array({shares}), 10000)").first()[0] if parts > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def placed(batch):
        yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, batch.column(0).to_numpy(), "right"), pa.int32()), batch.column(0)], names=["bucket", "doc_id"])

    least = {r[0]: r[1] for r in base.mapped(docs.select("doc_id"), placed, "bucket int, doc_id long").groupBy("bucket").agg(F.min("doc_id")).collect()}
    order = sorted(least)
    again = {least[b]: order[k - 1] for k, b in enumerate(order)}

    def run(batch):
        ids = batch.column(0).to_pylist()
        own = np.searchsorted(bounds, np.array(ids, np.int64), "right").tolist()
        z = [base.packed(x) for x in batch.column(1).to_pylist()]
        rows = [(b, 0, i, x) for b, i, x in zip(own, ids, z)] + [(again[i], 1, i, x) for i, x in zip(ids, z) if i in again]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "turn", "doc_id", "z"])

    return base.mapped(docs, run, "bucket int, turn int, doc_id long, z binary"), order


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has the last floor(n/2) of the n code points replaced by as many first ones of the next document, or
    by all it has; next is by ascending id, after the last comes the first. One row per document: doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next. Null text: as empty. Repeated ids follow one another in the
    order of their compressed texts. Rows with a null id have no place in the order and are left out. One row alone is
    its own next. An empty table gives an empty result. Other columns are ignored.
    """
    own = base.renamed(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = 4 * base.shuffle_parts(docs.sparkSession)
    rows, _ = _bucketed(own, parts)
    dealt = rows.repartition(parts // 4, "bucket").sortWithinPartitions("bucket", "turn", "doc_id", "z")

    def done(held: list[tuple[int, str]]) -> pa.RecordBatch:
        """Rows of all but the last, whose texts follow one another."""
        texts = [x for _, x in held]
        edited = []
        for x, y in zip(texts, texts[1:]):
            half = len(x) // 2
            edited.append(x[: len(x) - half] + y[:half])
        prints, changed = minima(texts), minima(edited)
        near = [(prints[:-1] == y).mean(axis=1) for y in (changed, prints[1:])]
        columns = [[i for i, _ in held[:-1]], [len(x) for x in texts[:-1]], edited, written_out(prints[:-1]), written_out(changed), *near]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[int, str]] = []
        size, bucket, closed = 0, None, False
        for batch in batches:
            for b, turn, i, z in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    held, size, bucket, closed = [], 0, b, False
                if closed:
                    continue  # a repeated id came again
                text = base.unpacked(z).decode()
                held.append((i, text))
                size += len(text)
                closed = turn == 1
                if closed or size > BATCH_CHARS:
                    if len(held) > 1:
                        yield done(held)
                    held, size = held[-1:], len(text)

    return base.by_arrow(dealt, run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
