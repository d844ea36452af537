"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): round i throws every shingle into a hashed bin of `coords`
bins with a value that starts with i; a bin keeps its minimum. After `coords` such rounds, round
coords + j throws all shingles into bin j, so every coordinate is filled. Equal coordinates have the
probability of the Jaccard similarity, with the concentration of independent MinHash, in O(n + t log t).

Links: documents of one banding bucket are first compared with two agreed leaders of the bucket, which is
linear in its size. Buckets whose documents are then not yet of one component are completed: every
document outside the least component of its bucket is compared with those of other components. In buckets of up to
SMALL documents, pairs whose sizes and sketches allow the similarity are verified. Larger buckets are pooled by
their least component; a pool's outsiders are the query set against all of the pool, in cells of bounded blocks,
where an inverted index counts intersections and only links come out. No pair of different components that shares a
bucket is left out. Verification counts the intersection of the full shingle sets.
At 64 bands of 6 coordinates a pair at 0.75 shares no bucket with probability 4e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import U64, mixed
from .components import components

WIDTH, PERCENT, BANDS, ROWS = 5, 75, 64, 6
SMALL, BLOCK, BLOCK_SHINGLES = 32, 500, 500_000
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000
UNSET = U64(0xFFFFFFFFFFFFFFFF)


def sketch(items: np.ndarray, offsets: np.ndarray, coords: int) -> np.ndarray:
    """Fast similarity sketches, one row per set; sets must not be empty."""
    sets = len(offsets) - 1
    flat = np.full(sets * coords, UNSET, U64)
    owner = np.repeat(np.arange(sets) * coords, np.diff(offsets))
    low = U64((1 << 48) - 1)
    for i in range(2 * coords):
        h = mixed(items + U64((i + 1) * int(base.MIX_B) % (1 << 64)))
        bins = ((h >> U64(40)) * U64(coords) >> U64(24)).astype(np.int64) if i < coords else i - coords
        np.minimum.at(flat, owner + bins, (U64(i) << U64(48)) | (mixed(h) & low))
        if i < 8 or i % 8 == 0:
            open_sets = (flat.reshape(sets, coords) == UNSET).any(axis=1)
            if not open_sets.any():
                break
            if i >= 2:
                keep = open_sets[owner // coords]
                items, owner = items[keep], owner[keep]
    return flat.reshape(sets, coords)


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    rows = sketches.shape[1] // bands
    parts = sketches.reshape(len(sketches), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), parts.shape[:2]).copy()
    for j in range(rows):
        out = mixed(out * base.MIX_B + parts[:, :, j])
    return out


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, bits) of (doc_id, text); bits: one bit of each coordinate."""
    coords = bands * rows

    def run(batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in base.chunks([len(x or "") for x in texts], BATCH_BYTES, BATCH_ROWS):
            items, offsets = base.word_shingles(texts[a:b], width)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            keys = [xxhash.xxh3_128_digest(items[s:e].tobytes()) if e > s else None for s, e in zip(offsets[:-1], offsets[1:])]
            found = sketch(items, np.concatenate(([0], np.cumsum(sizes[full]))), coords)
            band = band_keys(found, bands).view(np.int64)
            bits = np.packbits((mixed(found.copy()) & U64(1)).astype(np.uint8), axis=1)
            words = np.zeros((len(full), (bits.shape[1] + 7) // 8 * 8), np.uint8)
            words[:, : bits.shape[1]] = bits
            words = words.view(np.int64)

            def lists(rows_of):
                ends = np.zeros(b - a + 1, np.int32)
                ends[1:][full] = rows_of.shape[1]
                return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(rows_of.ravel()))

            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(keys, pa.binary()), lists(band), lists(words)], names=["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return base.mapped(docs, run, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def matches(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Compressed texts are shuffled: b's to its pairs, and a's once to each block of BLOCK of its pairs, before them. A task
    reads them in that order and holds one a's set, and those of a bounded slice of its b.
    """
    need = base.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "need")
    texts = base.zipped(base.among(docs, need))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "n").cast("int").alias("block"))
    members = dealt.join(texts.select(F.col("doc_id").alias("b"), "z"), "b").select("a", "block", F.lit(1).alias("turn"), "b", "z")
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    heads = heads.join(texts.select(F.col("doc_id").alias("a"), "z"), "a").select("a", "block", F.lit(0).alias("turn"), F.col("a").alias("b"), "z")
    rows = heads.unionByName(members).repartition(base.shuffle_parts(docs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "turn")

    def run(batches):
        own, held = None, {}
        for batch in batches:
            z = batch.column(4).to_pylist()
            for s, e in base.chunks(list(map(len, z)), BATCH_BYTES >> 2, BATCH_ROWS):
                a, _, turn, b, _ = (c.slice(s, e - s).to_pylist() for c in batch.columns)
                items, offsets = base.word_shingles([base.unpacked(x).decode() for x in z[s:e]], width)
                yes = []
                for i in range(e - s):
                    mine = items[offsets[i] : offsets[i + 1]]
                    if a[i] != own:
                        own, held = a[i], {}
                    if not turn[i]:
                        held[xxhash.xxh3_128_digest(mine.tobytes())] = mine.copy()  # rows of one id may differ
                    yes.append(bool(turn[i]) and any((n := matches(x, mine)) and 100 * n >= percent * (len(x) + len(mine) - n) for x in held.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(3).slice(s, e - s)], names=["a", "b"]).filter(pa.array(yes))

    return base.by_arrow(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of `width`-word shingles.
    component_id is the smallest id reachable over links, the document's own included.
    Null or empty text: no shingles, no links, its own component. Fewer than `width` words: one shingle, the
    whole sequence. Repeated rows get a row each, with the same component; rows of one id and different texts are one
    document that links by any of its texts. A null id has a null component and kept = true. An empty table gives an empty result. Other columns of the input are ignored.
    """
    docs = base.renamed(docs, doc_id=id_col, text=text_col)
    first = base.written(sketched(docs, width, bands, rows), "sketches")
    known = first.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = base.written(known.join(sets.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").select("doc_id", "set_key", "n_shingles", "bands", "bits"), "representatives")
    copies = base.written(known.select("doc_id", "set_key").join(sets, "set_key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")

    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    led = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("l1"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("l2")).where("n > 1").select("key", "l1", "l2")
    shared = base.written(keyed.join(led, "key"), "buckets")
    stars = shared.select(F.col("doc_id").alias("b"), F.explode(F.array("l1", "l2")).alias("a")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = base.written(plausible(stars, reps, percent, bands * rows), "tried")
    edges = base.written(verified(tried, docs, width, percent).distinct(), "links")

    parts = components(edges)
    placed = shared.select("key", "doc_id").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    spread = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least < most")
    loose = base.written(placed.join(spread.select("key", "least", "size"), "key"), "loose")
    narrow = loose.where(F.col("size") <= SMALL).join(reps.select("doc_id", F.col("n_shingles").alias("n"), "bits"), "doc_id")
    left, right = narrow.where("component <> least").alias("x"), narrow.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.least")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    rest = left.join(right, (F.col("x.key") == F.col("y.key")) & apart & _sizes_allow("x.n", "y.n", percent) & _bits_allow("x.bits", "y.bits", percent, bands * rows))
    rest = rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = base.written(verified(base.written(rest, "rest"), docs, width, percent).distinct(), "links")
    pools = loose.where(F.col("size") > SMALL).select("least", "doc_id", "component").distinct()
    pools = base.written(pools.join(reps.select("doc_id", F.col("n_shingles").alias("n")).distinct(), "doc_id").select("least", "doc_id", "component", "n"), "pools")
    more = more.union(base.written(pooled(pools, docs, width, percent).distinct(), "links"))
    groups = components(edges.union(more).union(copies.select("a", "b")))
    base.release(shared, loose, pools, parts, reps)
    out = first.select("doc_id", "n_shingles").join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def pooled(pools: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components in a pool (least, doc_id, component, n).

    One side is the pool's documents outside the least component, the other all of them; each cell holds a block of both,
    of about BLOCK documents and BLOCK_SHINGLES shingles (n).
    """
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    out = (F.col("component") != F.col("least")).cast("int")
    sizes = pools.groupBy("least").agg(blocks(F.count("*"), F.sum("n")).alias("rows"), blocks(F.sum(out), F.sum(out * F.col("n"))).alias("asks"))
    texts = base.zipped(base.among(docs, pools.select("doc_id").distinct())).select("doc_id", "z")
    own = pools.join(sizes, "least").join(texts, "doc_id")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("least", "doc_id", "component", "z")
    rows = own.select(*columns, F.lit(False).alias("asks_"), block("rows").alias("r"), every("asks").alias("q"))
    asks = own.where("component <> least").select(*columns, F.lit(True).alias("asks_"), every("rows").alias("r"), block("asks").alias("q"))

    def cell(table: pa.Table) -> pa.Table:
        ids, parts, ask = (np.asarray(table.column(c)) for c in ("doc_id", "component", "asks_"))
        texts = [base.unpacked(z).decode() for z in table.column("z").to_pylist()]
        items, offsets = base.word_shingles(texts, width)
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(ids)), n)
        held = ~ask[owner]
        order = np.argsort(items[held], kind="stable")
        keys, holders = items[held][order], owner[held][order]
        found = []
        for i in np.flatnonzero(ask):
            mine = items[offsets[i] : offsets[i + 1]]
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            count = high - low
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            both = np.bincount(holders[at], minlength=len(ids))
            yes = np.flatnonzero((both > 0) & (parts != parts[i]) & (100 * both >= percent * (n + n[i] - both)))
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in yes]
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    base.ship(docs.sparkSession)
    return rows.unionByName(asks).groupBy("least", "r", "q").applyInArrow(cell, "a long, b long")


def _sizes_allow(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _bits_allow(x: str, y: str, percent: int, coords: int):
    """Bits differ with half the probability of unlike coordinates; five deviations above what the similarity asks for."""
    p = (1 - percent / 100) / 2
    most = int(coords * p + 5 * (coords * p * (1 - p)) ** 0.5)
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range((coords + 63) // 64)), F.lit(0))
    return differ <= most


def plausible(pairs: DataFrame, reps: DataFrame, percent: int, coords: int) -> DataFrame:
    """Pairs whose sizes and sketch bits allow the similarity."""
    own = reps.select("doc_id", F.col("n_shingles").alias("n"), "bits")
    of = lambda c: own.select(*[F.col(x).alias(f"{c}_{x}" if x != "doc_id" else c) for x in own.columns])
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_sizes_allow("a_n", "b_n", percent) & _bits_allow("a_bits", "b_bits", percent, coords)).select("a", "b")
