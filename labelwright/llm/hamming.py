"""Exact top-k search over binary codes by multi-index hashing with growing radii.

Codes are cut into segments, and each segment's values index the codes. Step by step the search radius of one segment
grows by one bit: a query probes the values that differ from its own in exactly so many bits, and verifies the codes
found there. A code not seen at radii r_1 .. r_m differs in more than r_i bits in each segment i, so it is at least
sum(r_i + 1) bits away; a query is done when its k-th verified distance is below that.

Rows and queries are dealt into blocks of bounded size; each cell of a row block and a query block has an index of its
own, and the cells' answers are merged. Equal codes are one code on both sides. Of a code's rows the k + 1 least ids are
enough for any answer, so a code that many rows share makes one entry.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .base import U64

BITS, K = 64, 10
ROW_BLOCK, LEAST_ROW_BLOCK, QUERY_BLOCK = 500_000, 4096, 50_000
CANDIDATES = 1 << 21


def signs(vector: str) -> Column:
    """64-bit code of an array column: bit i is set where component i is above 0. Missing, null and NaN components are not.

    An array of more than BITS components is an error, as its code would leave some out.
    """
    total = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
        value = F.get(F.col(vector), F.lit(i))
        total = total.bitwiseOR(F.when((value > 0) & ~F.isnan(value), bit).otherwise(F.lit(0).cast("long")))
    too_long = F.raise_error(F.format_string(f"a vector has %d components; codes have {BITS} bits", F.size(vector))).cast("long")
    return F.when(F.size(vector) > BITS, too_long).when(F.col(vector).isNotNull(), total)


def _cuts(rows: int) -> list[tuple[int, int]]:
    """(shift, bits) of the segments: about log2(rows) bits each."""
    m = max(2, min(8, round(BITS / max(8.0, np.log2(max(rows, 2))))))
    edges = [round(BITS * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Index:
    """Codes by the values of each segment."""

    def __init__(self, codes: np.ndarray, least: np.ndarray):
        self.codes, self.least, self.cuts = codes, least, _cuts(len(codes))
        self.order, self.starts = [], []
        for shift, bits in self.cuts:
            value = self._value(codes, shift, bits)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << bits) + 1)))

    @staticmethod
    def _value(codes: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((codes >> U64(shift)) & U64((1 << bits) - 1)).astype(np.int64)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of each query's k first codes by distance, then least id: positions, not values."""
        radius = [-1] * len(self.cuts)
        bound = np.full(len(queries), BITS + 1)
        held = (np.empty(0, np.int64),) * 3
        active = np.arange(len(queries))
        answers = []
        while len(active):
            i = min((j for j, (_, bits) in enumerate(self.cuts) if radius[j] < bits), key=lambda j: (radius[j], j), default=None)
            if i is None:
                break
            found = list(self._grown(queries, active, bound, i, radius))
            radius[i] += 1
            held = self._best(*(np.concatenate(x) for x in zip(held, *found)), k)
            counts = np.bincount(held[0], minlength=len(queries))
            full = counts >= k
            bound[full] = held[2][np.cumsum(counts)[full] - 1]
            done = bound < sum(r + 1 for r in radius)
            out = done[held[0]]
            answers.append(tuple(x[out] for x in held))
            held = tuple(x[~out] for x in held)
            active = active[~done[active]]
            bound[done] = -1
        answers.append(held)
        return tuple(np.concatenate(x) for x in zip(*answers))

    def _grown(self, queries, active, bound, i, radius):
        """Newly seen codes of segment i at one bit more than its radius."""
        shift, bits = self.cuts[i]
        masks = np.array([sum(1 << b for b in own) for own in combinations(range(bits), radius[i] + 1)], np.int64)
        step = max(1, int(CANDIDATES * (1 << bits) / (len(masks) * (len(self.codes) + (1 << bits)))))
        for a in range(0, len(active), step):
            own = active[a : a + step]
            probes = (self._value(queries[own], shift, bits)[:, None] ^ masks).ravel()
            first = self.starts[i][probes]
            count = self.starts[i][probes + 1] - first
            query = np.repeat(np.repeat(own, len(masks)), count)
            at = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            code = self.order[i][at]
            differ = queries[query] ^ self.codes[code]
            distance = np.bitwise_count(differ).astype(np.int64)
            new = distance <= bound[query]
            for j, (s, b) in enumerate(self.cuts):
                if j != i and radius[j] >= 0:
                    new &= np.bitwise_count((differ >> U64(s)) & U64((1 << b) - 1)) > radius[j]
            yield query[new], code[new], distance[new]

    def _best(self, query, code, distance, k):
        order = np.lexsort((self.least[code], distance, query))
        query, code, distance = query[order], code[order], distance[order]
        first = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.empty(0, bool)
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else query
        kept = rank < k
        return query[kept], code[kept], distance[kept]


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, code_col: str, k: int = K) -> DataFrame:
    """The k rows nearest to each query by Hamming distance: query_id, rank (from 1), neighbour_id, distance.

    Ties go to the smaller id; a query's own id is not its neighbour. Exact: every row is in the index. Rows with a null
    id or code take no part. Repeated rows count once. Fewer than k other rows: all of them. Empty tables: no result.
    Other columns are ignored.
    """
    own = lambda df: base.renamed(df, id=id_col, code=code_col).where("id IS NOT NULL AND code IS NOT NULL").distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = base.written(own(rows).withColumn("turn", first).where(F.col("turn") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = base.written(own(queries), "queries")
    wanted = asked.select("code").distinct()
    count, total = few.count(), wanted.count()
    parts = base.shuffle_parts(rows.sparkSession)
    row_blocks = max(1, -(-count // ROW_BLOCK), min(parts, count // LEAST_ROW_BLOCK))
    query_blocks = max(1, -(-total // QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    left = few.select("code", F.get("ids", F.lit(0)).alias("least"), spread(row_blocks).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = wanted.select("code", F.lit(None).cast("long").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("r"), spread(query_blocks).alias("q"))

    def cell(table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy().view(U64)
        asks = np.asarray(table.column("least").is_null())
        least = table.column("least").fill_null(0).to_numpy()[~asks]
        codes, asked_codes = code[~asks], code[asks]
        names = ["ask", "code", "least", "distance"]
        if not len(codes) or not len(asked_codes):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        query, at, distance = Index(codes, least).nearest(asked_codes, k + 1)
        return pa.table([pa.array(asked_codes[query].view(np.int64)), pa.array(codes[at].view(np.int64)), pa.array(least[at]), pa.array(distance)], names=names)

    base.ship(rows.sparkSession)
    cells = left.unionByName(right).repartition(min(row_blocks * query_blocks, 4 * parts), "r", "q")  # by number: AQE leaves them apart
    near = cells.groupBy("r", "q").applyInArrow(cell, "ask long, code long, least long, distance long")
    best = F.row_number().over(Window.partitionBy("ask").orderBy("distance", "least"))
    near = near.withColumn("turn", best).where(F.col("turn") <= k + 1).select("ask", "code", "distance")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("ask")).join(near, "ask").join(few, "code").select("query_id", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", "distance")
