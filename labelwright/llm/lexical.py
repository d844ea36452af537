"""Ranked lexical search by Block-Max WAND over an inverted index in segments.

build() makes segments of bounded text in the tasks that read it, so documents are not shuffled. A segment numbers its rows by
ascending id; a term's postings are cut into blocks of BLOCK postings. A block is compressed on its own: differences of row
numbers and occurrences, each packed at the block's least bit width. Beside it stand its first and last row and its impacts,
the pairs (occurrences, length) that no other posting of the block beats in both: the greatest score that the block can give
follows from them exactly, for any counts of the whole collection, so that the index is made in one pass.

search() brings the postings of the items' terms together by segment. There an item's terms go from the one of the highest
possible score down. As soon as ten scores are known, a row that may still count has a term of the first few, which together with
all later ones can reach the tenth; only such rows are candidates. For each further term a shallow move to the block that
would hold a candidate gives that block's greatest score; candidates that can't reach the tenth score with it and the greatest
scores of the terms to come go, and only blocks that hold one of the others are decompressed. Segments' best rows are merged
by a window.

One segment of PRIMED is searched before the others: an item's tenth score there is a score that its tenth document has at
least, and all segments skip what lies below it from the start. Only that number of each item goes from pass to pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, terms

TABLE = terms.byte_table(terms.ALPHANUMERIC)
BLOCK, TOP, SEGMENT_BYTES, SEGMENT_ROWS, ITEMS, NEEDLES, PRIMED = 128, 10, 1 << 24, 1 << 18, 512, 1 << 15, 32
SEGMENTS = "segment string, rows long, n_docs long, n_terms long, ids binary, lengths binary"
POSTINGS = "segment string, term string, df long, firsts array<int>, lasts array<int>, impacts array<int>, impact_sizes array<int>, widths binary, data binary"


class Segment:
    """Postings of rows as they come; finished() sorts and packs them."""

    def __init__(self):
        self.ids, self.rows, self.terms, self.times, self.size = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        before = len(self.ids)
        self.ids += ids.to_pylist()
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0
        for row, term, n, names in terms.counts(texts, TABLE):
            self.rows.append((row + before).astype(np.int32))
            self.times.append(n.astype(np.int32))
            self.terms.append(pa.DictionaryArray.from_arrays(pa.array(term.astype(np.int32)), names))

    def finished(self) -> tuple[dict, pa.RecordBatch | None]:
        """The segment's own row, and its postings, a row a term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        rows = place[np.concatenate([np.empty(0, np.int32), *self.rows])]
        times = np.concatenate([np.empty(0, np.int32), *self.times])
        lengths = np.bincount(rows, times, len(order)).astype(np.int64)
        name = uuid.uuid4().hex  # a task that runs again names its segments anew; only what is written counts
        null = np.iinfo(np.int64).min
        ids = np.array([null if self.ids[i] is None else self.ids[i] for i in order], np.int64)
        own = {"segment": name, "rows": len(order), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "ids": ids.tobytes(), "lengths": lengths.tobytes()}
        if not len(rows):
            return own, None
        merged = pa.chunked_array(self.terms).unify_dictionaries()
        term = np.concatenate([c.indices.to_numpy() for c in merged.chunks])
        by = np.lexsort((rows, term))
        return own, packed_postings(name, term[by], rows[by], times[by], lengths, merged.chunk(0).dictionary)


def packed_postings(name: str, term: np.ndarray, rows: np.ndarray, times: np.ndarray, lengths: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Postings sorted by (term, row) as a row a term, in blocks."""
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(term)])))
    blocks = -(-sizes // BLOCK)
    of_term = np.repeat(np.arange(len(starts)), blocks)
    step = np.arange(len(of_term)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[of_term] + BLOCK * step
    count = np.minimum(sizes[of_term] - BLOCK * step, BLOCK)
    last = first + count - 1
    in_block = np.repeat(np.arange(len(first)), count)
    gaps = np.concatenate(([0], np.diff(rows)))
    gaps[first] = 0
    beats = _unbeaten(in_block, times, lengths[rows])
    pairs = np.stack((times[beats], lengths[rows[beats]].astype(np.int32)), axis=1).ravel().astype(np.int32)
    n_pairs = np.bincount(in_block[beats], minlength=len(first))
    widths = np.stack((_widths(np.maximum.reduceat(gaps, first)), _widths(np.maximum.reduceat(times - 1, first))), axis=1).astype(np.uint8)
    data, data_sizes = _pack(first, count, widths, gaps, times - 1)
    at = np.concatenate(([0], np.cumsum(blocks)))  # of each term's blocks
    lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    binaries = lambda values, offsets: pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    made = {
        "segment": pa.array([name] * len(starts)),
        "term": names.take(pa.array(term[starts])),
        "df": pa.array(sizes, pa.int64()),
        "firsts": lists(rows[first], at),
        "lasts": lists(rows[last], at),
        "impacts": lists(pairs, 2 * np.concatenate(([0], np.cumsum(n_pairs)))[at]),
        "impact_sizes": lists(n_pairs, at),
        "widths": binaries(widths.tobytes(), 2 * at),
        "data": binaries(data.tobytes(), np.concatenate(([0], np.cumsum(data_sizes)))[at]),
    }
    return pa.RecordBatch.from_pydict(made)


def _unbeaten(block: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the postings for which no posting of the block has as many occurrences in a shorter row, or more in one as short."""
    order = np.lexsort((lengths, -times, block))
    fall = (int(lengths.max()) + 1) * block[order]
    value = lengths[order] - fall  # each block's values lie below those of the block before
    least = np.minimum.accumulate(value)
    return order[np.concatenate(([True], value[1:] < least[:-1]))]


def _widths(most: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64)


def _bytes(count: np.ndarray, width: np.ndarray) -> np.ndarray:
    return -(-count * width.astype(np.int64) // 8)


def _pack(first: np.ndarray, count: np.ndarray, widths: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes one after the other, and their sizes: each block's gaps, then its occurrences."""
    parts = np.stack([_bytes(count, widths[:, k]) for k in range(2)], axis=1)
    sizes = parts.sum(axis=1)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.uint8)
    lane = np.arange(BLOCK)
    for k, own in enumerate(values):
        for width in np.unique(widths[:, k][widths[:, k] > 0]).tolist():
            for chosen in np.array_split(found := np.flatnonzero(widths[:, k] == width), max(1, len(found) >> 12)):
                n = count[chosen]
                longest = int(n.max())
                inside = lane[:longest] < n[:, None]
                cells = np.where(inside, own[np.minimum(first[chosen][:, None] + lane[:longest], len(own) - 1)], 0)
                bits = (cells[:, :, None] >> np.arange(width)) & 1
                rows = np.packbits(bits.reshape(len(chosen), -1).astype(np.uint8), axis=1, bitorder="little")
                size = parts[chosen, k]
                to = (start[chosen] + (parts[chosen, 0] if k else 0))[:, None] + np.arange(rows.shape[1])
                real = np.arange(rows.shape[1]) < size[:, None]
                out[to[real]] = rows[real]
    return out, sizes


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(segments, postings) of docs, written to the shared folder.

    Each row is a document; ids may repeat or be null (a null one goes last among equal scores). A row without terms is in its
    segment and in no posting. Other columns are ignored. A segment ends after segment_bytes of text, or with its task.
    """
    own = base.renamed(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in base.chunks(sizes, terms.SLICE_BYTES):
                if segment.ids and (segment.size + sum(sizes[a:b]) > segment_bytes or len(segment.ids) >= SEGMENT_ROWS):
                    yield from _emitted(segment)
                    segment = Segment()
                segment.add(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
        if segment.ids:
            yield from _emitted(segment)

    both = base.written(base.by_arrow(own, run, f"own struct<{_struct(SEGMENTS)}>, posting struct<{_struct(POSTINGS)}>", __name__), "lexical_index")
    return both.where("own IS NOT NULL").select("own.*"), both.where("posting IS NOT NULL").select("posting.*")


def _struct(schema: str) -> str:
    return ", ".join(":".join(x.split(" ")) for x in schema.split(", "))


def _emitted(segment: Segment) -> Iterator[pa.RecordBatch]:
    own, postings = segment.finished()
    kinds = pa.struct([("segment", pa.string()), ("rows", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary())])
    lists = {c: pa.list_(pa.int32()) for c in ("firsts", "lasts", "impacts", "impact_sizes")}
    kinds_p = pa.struct([("segment", pa.string()), ("term", pa.string()), ("df", pa.int64()), *lists.items(), ("widths", pa.binary()), ("data", pa.binary())])
    yield pa.RecordBatch.from_arrays([pa.array([own], kinds), pa.nulls(1, kinds_p)], names=["own", "posting"])
    if postings is not None:
        for a in range(0, len(postings), 1 << 14):
            part = postings.slice(a, 1 << 14)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), kinds), pa.StructArray.from_arrays(part.columns, fields=list(kinds_p))], names=["own", "posting"])


def unpacked_values(data: np.ndarray, at: np.ndarray, count: np.ndarray, widths: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
    """Puts each block's values, packed from byte `at` on, into out from place `to` on."""
    lane = np.arange(BLOCK)
    for width in np.unique(widths).tolist():
        for own in np.array_split(found := np.flatnonzero(widths == width), max(1, len(found) >> 12)):
            inside = lane < count[own][:, None]
            places = (to[own][:, None] + lane)[inside]
            if not width:
                out[places] = 0
                continue
            n = -(-BLOCK * width // 8)
            raw = data[np.minimum(at[own][:, None] + np.arange(n), len(data) - 1)]
            bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : BLOCK * width].reshape(len(own), BLOCK, width)
            out[places] = (bits @ (1 << np.arange(width)))[inside]


class Searched:
    """The postings of one segment for the terms of some items: block limits at once, postings as they are needed."""

    def __init__(self, postings: pa.Table, lengths: np.ndarray, n_docs: int, n_terms: int):
        p = postings.combine_chunks()
        column = lambda c: p[c].chunk(0) if p[c].num_chunks else pa.array([], p.schema.field(c).type)
        flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        blob = lambda c: np.frombuffer(b"".join(column(c).to_pylist()), np.uint8)
        part = lambda n: 25 + (75 * n * n_docs) // n_terms
        self.m, self.weight, df = part(lengths), column("weight").to_numpy(), column("df").to_numpy()
        blocks = -(-df // BLOCK)
        self.edges = np.concatenate(([0], np.cumsum(blocks)))
        of_term = np.repeat(np.arange(len(df)), blocks)
        step = np.arange(len(of_term)) - self.edges[of_term]
        self.count = np.minimum(df[of_term] - BLOCK * step, BLOCK)
        self.first, self.end, self.of_term = flat("firsts"), flat("lasts") + 1, of_term
        self.widths, self.data = blob("widths").reshape(-1, 2), blob("data")
        self.sizes = np.stack([_bytes(self.count, self.widths[:, k]) for k in range(2)], axis=1)
        total = self.sizes.sum(axis=1)
        self.at = np.cumsum(total) - total
        pairs, n_pairs = flat("impacts").reshape(-1, 2), flat("impact_sizes")
        impact = self.weight[np.repeat(of_term, n_pairs)] * ((1_000_000_000 * pairs[:, 0]) // (1000 * pairs[:, 0] + 8 * part(pairs[:, 1])))
        self.most = np.maximum.reduceat(impact, np.cumsum(n_pairs) - n_pairs) if len(impact) else impact
        self.to = np.cumsum(self.count) - self.count
        self.rows, self.impact = np.empty(self.count.sum(), np.int32), np.empty(self.count.sum(), np.int64)
        self.ready = np.zeros(len(self.count), bool)

    def decompress(self, blocks: np.ndarray) -> None:
        """Postings of those blocks that are still packed."""
        new = blocks[~self.ready[blocks]]
        if not len(new):
            return
        self.ready[new] = True
        to, count = self.to[new], self.count[new]
        places = _ranges(to, count)
        gaps, times = np.empty(len(self.rows), np.int32), np.empty(len(self.rows), np.int64)
        unpacked_values(self.data, self.at[new], count, self.widths[new, 0], to, gaps)
        unpacked_values(self.data, self.at[new] + self.sizes[new, 0], count, self.widths[new, 1], to, times)
        sums = np.cumsum(gaps[places])
        own = np.cumsum(count) - count
        rows = sums - np.repeat(sums[own] - self.first[new], count)
        n = times[places] + 1
        self.rows[places] = rows
        self.impact[places] = np.repeat(self.weight[self.of_term[new]], count) * ((1_000_000_000 * n) // (1000 * n + 8 * self.m[rows]))

    def shallow(self, term: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of a term that would hold each of ascending rows, and whether the row is within its limits."""
        a, b = self.edges[term], self.edges[term + 1]
        block = np.minimum(a + np.searchsorted(self.end[a:b], rows, "right"), b - 1)
        return block, (self.first[block] <= rows) & (rows < self.end[block])

    def impacts(self, blocks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The impact of ascending rows in a term's blocks, ascending and each once; 0 where a row has no posting there."""
        self.decompress(blocks)
        at = _ranges(self.to[blocks], self.count[blocks])
        own = self.rows[at]
        place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        return np.where(own[place] == rows, self.impact[at[place]], 0)

    def scored(self, order: list[tuple[int, int, int]], rows: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ascending rows whose score is at least floor, and their scores. order: (term, times, highest score), the highest first."""
        sums, rest = np.zeros(len(rows), np.int64), sum(top for _, _, top in order)
        for term, times, top in order:
            rest -= top
            block, inside = self.shallow(term, rows)
            stay = sums + np.where(inside, times * self.most[block], 0) + rest >= floor
            rows, sums, block, inside = rows[stay], sums[stay], block[stay], inside[stay]
            if inside.any():
                sums[inside] += times * self.impacts(np.unique(block[inside]), rows[inside])
        return rows[sums >= floor], sums[sums >= floor]

    def rows_of(self, term: int, times: int, others: int, floor: int) -> np.ndarray:
        """A term's rows, but for those of blocks that can't reach floor with the highest scores of all other terms."""
        blocks = np.arange(self.edges[term], self.edges[term + 1])
        blocks = blocks[times * self.most[blocks] + others >= floor]
        self.decompress(blocks)
        return self.rows[_ranges(self.to[blocks], self.count[blocks])].astype(np.int64)

    def best(self, needles: np.ndarray, times: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best rows for an item's terms, which occur in it so many times; equal scores by ascending row.

        Rows with a score below `least` are of no interest.
        """
        tops = [int(n * self.most[self.edges[t] : self.edges[t + 1]].max()) for t, n in zip(needles, times)]
        order = sorted(zip(needles.tolist(), times.tolist(), tops), key=lambda x: -x[2])
        whole, rest = sum(tops), sum(tops)
        # the rows of the best blocks give a first floor
        strong = [self.edges[t] + int(np.argmax(self.most[self.edges[t] : self.edges[t + 1]])) for t, _, _ in order[:2]]
        self.decompress(np.array(strong))
        seen = np.unique(np.concatenate([self.rows[self.to[b] : self.to[b] + self.count[b]] for b in strong])).astype(np.int64)
        rows, scores = self.scored(order, seen, least)
        first = np.lexsort((rows, -scores))[:most]
        rows, scores = rows[first], scores[first]
        floor = max(least, int(scores[-1])) if len(scores) == most else least
        new = []
        for term, n, top in order:
            if rest < floor:
                break  # a row with none of the terms so far can't reach it; an equal score may still win by its row
            new.append(self.rows_of(term, n, whole - top, floor))
            rest -= top
        found, sums = self.scored(order, np.setdiff1d(np.concatenate([*new, seen[:0]]), seen), floor)
        rows, scores = np.concatenate((rows, found)), np.concatenate((scores, sums))
        first = np.lexsort((rows, -scores))[:most]
        rows, scores = rows[first], scores[first]
        return rows, scores


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def needles(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of items; equal rows count once, terms of unlike rows of one id are added up."""
    own = base.renamed(items, item_id=item_col, text=text_col).distinct()

    def run(batch):
        for row, term, n, names in terms.counts(batch.column(1), TABLE):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(term)), pa.array(n, pa.int64())], names=["item_id", "term", "times"])

    found = base.mapped(own, run, f"item_id {own.schema['item_id'].dataType.simpleString()}, term string, times long", __name__)
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def search(index: tuple[DataFrame, DataFrame], items: DataFrame, most: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `most` documents of highest score above 0, equal ones by ascending id, from 1.

    index: build()'s tables. An item without terms, or with none that a document has, gives no row. Items are dealt into blocks
    of about ITEMS; a segment's postings meet one block's items at a time.
    """
    segments, postings = index
    wanted = base.written(needles(items, item_col, text_col), "needles")
    size = wanted.agg(F.count_distinct(F.struct("item_id")).alias("items"), F.count("*").alias("n")).first()
    whole = segments.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    blocks = max(1, -(-size["items"] // ITEMS), -(-size["n"] // NEEDLES))
    n_docs, n_terms = int(whole["n_docs"] or 0), max(int(whole["n_terms"] or 0), 1)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    kind = wanted.schema["item_id"].dataType.simpleString()
    key = F.xxhash64("term")
    near = base.among(postings.withColumn("_key", key), wanted.select(key.alias("_key")).distinct(), "_key").drop("_key")
    near = base.written(near.join(wanted.select("term").distinct(), "term", "left_semi"), "needed_postings")
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.sum("df") + 1).cast("double"))).alias("weight")
    weights = near.groupBy("term").agg(weight)
    own = segments.select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", "lengths")

    def run(postings: pa.Table, own: pa.Table) -> pa.Table:
        base.settle(__name__)
        schema = pa.schema([("item_id", postings.schema.field("users").type.value_type.field("item_id").type), ("doc_id", pa.int64()), ("score", pa.int64())])
        if not len(postings):
            return schema.empty_table()
        ids, lengths = (np.frombuffer(own[c][0].as_py(), np.int64) for c in ("ids", "lengths"))
        segment = Searched(postings, lengths, n_docs, n_terms)
        users = postings["users"].combine_chunks()
        users = users.chunk(0) if isinstance(users, pa.ChunkedArray) else users
        flat = users.flatten()
        names = flat.field("item_id").dictionary_encode("encode")
        of_term, item, times, least = np.repeat(np.arange(len(users)), pc.list_value_length(users).to_numpy()), names.indices.to_numpy(), flat.field("times").to_numpy(), flat.field("least").to_numpy()
        by = np.argsort(item, kind="stable")
        out = []
        for part in np.split(by, np.flatnonzero(np.diff(item[by])) + 1):
            rows, scores = segment.best(of_term[part], times[part], most, int(least[part[0]]))
            out.append((np.full(len(rows), item[part[0]]), ids[rows], scores))
        item, doc, scores = (np.concatenate(x) for x in zip(*out))
        doc = pa.array(doc, mask=doc == np.iinfo(np.int64).min)
        return pa.table([names.dictionary.take(pa.array(item)), doc, pa.array(scores)], schema=schema)

    def best(postings: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
        """(item_id, doc_id, score): each segment's best rows for the items of wanted (item_id, term, times, least)."""
        dealt = wanted.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("item_id", "times", "least")).alias("users"))  # ITEMS or so at most
        found = postings.join(dealt.join(weights, "term"), "term").select("segment", "block", "term", "df", "weight", "firsts", "lasts", "impacts", "impact_sizes", "widths", "data", "users")
        return found.groupBy("segment", "block").cogroup(own.groupBy("segment", "block")).applyInArrow(run, f"item_id {kind}, doc_id long, score long")

    base.ship(near.sparkSession)
    some = lambda table: table.where(F.pmod(F.xxhash64("segment"), F.lit(PRIMED)) == 0)
    first = best(some(near), some(own), wanted.withColumn("least", F.lit(1).cast("long")))
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
    floors = base.written(first.withColumn("turn", turn).where(F.col("turn") == most).select(F.col("item_id").alias("_item"), F.col("score").alias("_least")), "least_scores")
    primed = wanted.join(floors, F.col("item_id").eqNullSafe(F.col("_item")), "left").select("item_id", "term", "times", F.coalesce("_least", F.lit(1)).alias("least"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best(near, own, primed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = TOP) -> DataFrame:
    """search() of items (item_id, text) over an index of all docs (doc_id, text)."""
    return search(build(docs), items, most)
