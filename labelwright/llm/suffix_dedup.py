"""Exact substring deduplication over a distributed, sparse enhanced suffix array.

Every `length`-byte window belongs to its minimizer, the leftmost least hashed `gram`-byte string in it; equal
windows have equal minimizers. A maximal run of windows with one minimizer is a snippet. Only snippets whose
minimizer occurs twice can hold a repeated window, so counting minimizers (one in 76 bytes) leaves few to be
shuffled, and all snippets of one minimizer meet in one task.

There the suffixes that start at the minimizers are sorted, and a stack scan over their common prefixes builds
the common-prefix interval tree. In each interval (right extension d) the reversed left contexts get an interval
tree of their own (left extension l). An inner node of both that is diverse to the right and to the left is a
maximal repeat of l + d bytes, reported with all its occurrences, not only neighbouring ones.

Skew: equal texts are one text; equal snippets of a task are reported there and sent once; minimizers with more
than `hot` occurrences are dealt out by whole windows (hashed with 128 bits) instead, of which each task
sends one, so that no group is without bound and none is dropped. Texts are named by 128 bits of their hash. Where only
the covered bytes are asked for, each task unites the spans of a text before it writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import U64, mixed

LENGTH, GRAM, HOT = 200, 50, 5000
SEGMENT = 1 << 18
SLICE = 1 << 22
SEEN = 100_000
BASE = U64(0x5851F42D4C957F2D)
INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
POSITION = U64((1 << 24) - 1)
BYTE_HASH = mixed(np.arange(1, 257, dtype=U64) * base.MIX_A)
_powers: list[np.ndarray] = base.remembered([])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        most = max(n, SEGMENT + (SEGMENT >> 1))
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(most, x, U64)))) for x in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Joined bytes of about SEGMENT, and (text, offset in it, place in the joined bytes) of their parts.

    A longer text is cut into parts that overlap by length - 1, so that every window is in one part.
    """
    parts, place, held = [], 0, []
    for i, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), SEGMENT):
            part = text[a : a + SEGMENT + length - 1]
            if place and place + len(part) > SEGMENT:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                parts, place, held = [], 0, []
            parts.append((i, a, place))
            held.append(part)
            place += len(part)
    if parts:
        yield np.frombuffer(b"".join(held), np.uint8), parts


def snippets(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each joined segment: text, first window, number of windows, minimizer's offset from it, minimizer hash."""
    for data, parts in segments(texts, length):
        up, down = powers(len(data) + 1)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=U64)))
        h = mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
        width = length - gram + 1
        n = len(h)
        key = np.full(-(-n // width) * width, 0xFFFFFFFFFFFFFFFF, U64)
        key[:n] = (h & ~POSITION) | np.arange(n, dtype=U64)
        blocks = key.reshape(-1, width)
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        least = (np.minimum(after[: n - width + 1], before[width - 1 : n]) & POSITION).astype(np.int64)
        ends = [*(p for _, _, p in parts[1:]), len(data)]
        sizes = np.array([e - p - length + 1 for (_, _, p), e in zip(parts, ends)])
        places = np.array([p for _, _, p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        valid = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + places[owner]
        at = least[valid]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((first, [len(at)])))
        own = owner[first]
        begin = valid[first]
        texts_of, offsets = np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts])
        yield texts_of[own], begin - places[own] + offsets[own], count, at[first] - begin, h[at[first]].view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(strings: list[bytes], least: int) -> Iterator[tuple[int, list[int]]]:
    """Common-prefix interval tree of the strings: (depth, members) of each inner node at least so deep.

    Members of a node share `depth` bytes and not all of them one more.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack: list[tuple[int, int]] = []  # (depth, left end)
    for i in range(1, len(order) + 1):
        depth = common(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        left = i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            yield d, order[left:i]
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def repeats(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through the anchors: (left extension, right extension, members). lefts are reversed."""
    if len(rights) == 2:
        d, left = common(*rights), common(*lefts)
        if left + d >= length:
            yield left, d, [0, 1]
        return
    deepest = max(map(len, lefts))
    for d, members in intervals(rights, max(1, length - deepest)):
        for left, own in intervals([lefts[i] for i in members], max(0, length - d)):
            found = [members[i] for i in own]
            one = rights[found[0]]
            if any(len(rights[i]) == d or rights[i][d] != one[d] if len(one) > d else True for i in found):  # diverse to the right as well
                yield left, d, found


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, n_bytes, text_key, anchors): the minimizers of a text's snippets, a repeated one as often."""

    def run(batch):
        for a, b in base.chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), SLICE):
            yield sliced(batch.slice(a, b - a))

    def sliced(batch):
        ids, texts = batch.column(0), [(x or "").encode() for x in batch.column(1).to_pylist()]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for owner, _, _, _, h in snippets(texts, length, gram):
            cut = np.flatnonzero(np.diff(owner)) + 1
            for i, part in zip(owner[np.concatenate(([0], cut))], np.split(h, cut)):
                found[i].append(part)
        sizes = [sum(map(len, x)) for x in found]
        flat = np.concatenate([p for x in found for p in x]) if any(sizes) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()), lists], names=["doc_id", "n_bytes", "text_key", "anchors"])

    return base.mapped(docs, run, "doc_id long, n_bytes long, text_key binary, anchors array<long>")


ROWS = "key long, text binary, start long, pre long, size long, window binary, snippet binary, twin binary, twin_start long"
KINDS = (pa.int64(), pa.binary(), *(pa.int64(),) * 3, *(pa.binary(),) * 3, pa.int64())
FLUSH = 20_000


def united(spans: list[tuple[bytes, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """The maximal runs (text, start, size) of spans of such."""
    now: list | None = None
    for text, start, size in sorted(spans):
        if now and now[0] == text and start <= now[1] + now[2]:
            now[2] = max(now[2], start + size - now[1])
        else:
            if now:
                yield tuple(now)
            now = [text, start, size]
    if now:
        yield tuple(now)


def candidates(texts: DataFrame, length: int, gram: int, groups: bool) -> DataFrame:
    """Of (text_key, z, repeated): the snippets to compare.

    repeated: the text's minimizers that occur twice or more, with a flag for hot ones. Rows without key are spans that
    are known to repeat: a task met the same string before, at twin_start of the text twin (groups), or runs of such.
    """

    def run(batches):
        seen: dict[bytes, list] = {}
        out: list[tuple] = []
        spans: list[tuple] = []

        def known(key: bytes, text: bytes, start: int, size: int) -> bool:
            """Whether this task has met the string before; if so, both places are reported."""
            if (first := seen.get(key)) is None:
                if len(seen) > SEEN:
                    seen.clear()
                seen[key] = [text, start, False]
                return False
            if groups:
                out.append((None, text, start, 0, size, key, None, first[0], first[1]))
            else:
                spans.append((text, start, size))
            if not first[2]:
                first[2] = True
                if groups:
                    out.append((None, *first[:2], 0, size, key, None, *first[:2]))
                else:
                    spans.append((*first[:2], size))
            return True

        def rows():
            out.extend((None, text, start, 0, size, None, None, None, None) for text, start, size in united(spans))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=[x.split()[0] for x in ROWS.split(", ")])
            out.clear()
            spans.clear()
            return made

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [base.unpacked(z) for z in batch.column(1).to_pylist()]
            wanted = [{x["a"]: x["h"] for x in r} for r in batch.column(2).to_pylist()]
            for owner, begin, count, pre, h in snippets(texts, length, gram):
                for i, a, n, p, key in zip(owner.tolist(), begin.tolist(), count.tolist(), pre.tolist(), h.tolist()):
                    if (hot := wanted[i].get(key)) is None:
                        continue
                    part = texts[i][a : a + n + length - 1]
                    if not (hot and groups) and known(xxhash.xxh3_128_digest(part), names[i], a, len(part)):
                        continue
                    if not hot:
                        out.append((key, names[i], a, p, len(part), None, part, None, None))
                        continue
                    for j in range(n):
                        w = xxhash.xxh3_128_digest(part[j : j + length])
                        # a group's windows follow their own twins: a snippet's twin may have windows that are twins themselves
                        if n == 1 and not groups or not known(w, names[i], a + j, length):
                            out.append((int.from_bytes(w[:8], "little", signed=True), names[i], a + j, 0, length, w, None, None, None))
                if len(out) + len(spans) > FLUSH:
                    yield rows()
        if out or spans:
            yield rows()

    return base.by_arrow(texts, run, ROWS)


GROUP = "repeat long, text binary, start long, size long, snippet long, twin binary, twin_start long"


def grouped(found: DataFrame, length: int, groups: bool) -> DataFrame:
    """Of candidates, with groups the maximal repeats by occurrence, else bundles of the runs that they cover (see bundled).

    repeat: 64-bit hash of the string that a group's occurrences share; snippet: where the occurrence's snippet starts. A
    group is maximal within its minimizer's windows; a longer repeat comes as overlapping groups of the same occurrences.
    Rows with twin are strings that a task has met before.
    """
    schema = GROUP if groups else BUNDLE
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()) if groups else (pa.binary(), pa.int64(), pa.int64())

    def run(batches):
        out: list[tuple] = []
        group: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            windows: dict[bytes, list] = {}
            strings = [r for r in group if r[6] is not None]
            for r in group:
                if r[5] is not None:
                    windows.setdefault(r[5], []).append(r)
            for w, own in windows.items():
                if len(own) > 1:
                    name = signed(w)
                    out.extend((name, r[1], r[2], r[4], r[2], None, None) if groups else (r[1], r[2], r[4]) for r in own)
            if len(strings) > 1:
                for left, right, own in repeats([r[6][r[3] :] for r in strings], [r[6][: r[3]][::-1] for r in strings], length):
                    if groups:
                        r = strings[own[0]]
                        name = signed(xxhash.xxh3_128_digest(r[6][r[3] - left : r[3] + right]))
                        out.extend((name, strings[i][1], strings[i][2] + strings[i][3] - left, left + right, strings[i][2], None, None) for i in own)
                    else:
                        out.extend((strings[i][1], strings[i][2] + strings[i][3] - left, left + right) for i in own)
                    if len(out) > FLUSH:
                        yield from rows(5 * FLUSH)
            yield from rows(FLUSH)

        def rows(most: int) -> Iterator[pa.RecordBatch]:
            """What is found, once it is more than most; runs that touch are one."""
            if len(out) > most and not groups:
                out[:] = united(out)
            if len(out) > most >> 1 and not groups:
                yield bundled(out)
                out.clear()
            elif len(out) > most >> 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])
                out.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] is None:
                    out.append((signed(row[5]), row[1], row[2], row[4], row[2], row[7], row[8]) if groups else (row[1], row[2], row[4]))
                    continue
                if group and group[0][0] != row[0]:
                    yield from close()
                    group = []
                group.append(row)
            yield from rows(5 * FLUSH)
        if group:
            yield from close()
        if not groups:
            out[:] = united(out)
        yield from rows(0)

    parts = base.shuffle_parts(found.sparkSession)
    dealt = found.repartition(parts, F.coalesce("key", F.xxhash64("text", "start"))).sortWithinPartitions("key")
    return base.by_arrow(dealt, run, schema)


BUNDLE, BUNDLES = "bundle int, texts binary, starts array<long>, sizes array<long>", 4096


def bundled(spans: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    """Spans (text, start, size) as a row for each of BUNDLES ranges of texts' names that has some.

    A window that many texts share leaves each of them a span in that window's task. Such spans travel by the bundle, and
    are no rows of their own.
    """
    names = np.frombuffer(b"".join(s[0] for s in spans), np.uint8).reshape(len(spans), 16)
    bundle = (names[:, 0].astype(np.int64) << 4) | (names[:, 1] >> 4)
    order = np.argsort(bundle, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(bundle[order]) != 0)))
    edges = np.concatenate((first, [len(spans)]))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.array(values, np.int64)[order]))
    texts = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((16 * edges).astype(np.int32)), pa.py_buffer(names[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bundle[order][first], pa.int32()), texts, lists([s[1] for s in spans]), lists([s[2] for s in spans])], names=["bundle", "texts", "starts", "sizes"])


def by_text(bundles: DataFrame) -> DataFrame:
    """(text_key, found): each text's runs, united, of bundles of spans. A task holds the spans of one bundle of texts at a time."""

    def run(batches):
        held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            spans = united([(t[16 * i : 16 * i + 16], int(a), int(n)) for t, starts, sizes in held for i, (a, n) in enumerate(zip(starts, sizes))])
            keys, runs = [], []
            for text, start, size in spans:
                if not keys or keys[-1] != text:
                    keys.append(text)
                    runs.append([])
                runs[-1].append({"start": start, "size": size})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(runs, kind)], names=["text_key", "found"])

        for batch in batches:
            starts, sizes = (batch.column(i) for i in (2, 3))
            for i, (bundle, texts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if bundle != now:
                    if held:
                        yield from close()
                    held.clear()
                    now = bundle
                held.append((texts, starts[i].values.to_numpy(), sizes[i].values.to_numpy()))
        if held:
            yield from close()

    dealt = bundles.repartition(base.shuffle_parts(bundles.sparkSession), "bundle").sortWithinPartitions("bundle")
    return base.by_arrow(dealt, run, "text_key binary, found array<struct<start:long,size:long>>")


def signed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


class Found:
    """Tables of one search: texts (doc_id, n_bytes, text_key), equal (text_key, rep, n), and spans as grouped() defines them."""

    def __init__(self, docs: DataFrame, length: int, gram: int, hot: int, groups: bool):
        first = base.written(anchors(docs, length, gram).where(F.col("n_bytes") >= length), "anchors")
        self.texts = first.select("doc_id", "n_bytes", "text_key")
        self.equal = base.written(self.texts.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "texts")
        reps = self.equal.select("text_key", F.col("rep").alias("doc_id"))
        places = first.join(reps, ["doc_id", "text_key"], "left_semi").select("doc_id", "text_key", F.explode("anchors").alias("a"))
        often = places.groupBy("a").count().where("count > 1").select("a", (F.col("count") > hot).alias("h"))
        wanted = places.distinct().join(often, "a").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("a", "h")).alias("repeated"))
        wanted = base.written(wanted, "minimizers")
        texts = base.zipped(docs, keyed=True).join(wanted, ["doc_id", "text_key"])
        self.spans = base.written(grouped(candidates(texts.select("text_key", "z", "repeated"), length, gram, groups), length, groups), "repeats")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Maximal repeat groups (repeat, doc_id, start, size) of (doc_id, text): a row for each of a group's occurrences.

    repeat names the string that a group's occurrences share. Occurrences that a task did not send, as it had met their
    snippet before, follow their twin into its groups, and equal texts follow the one that stands for them; a text that
    comes twice is a group as a whole. Rows with a null id are left out.

    Where a minimizer occurs more than `hot` times, its groups are the `length`-byte strings in its windows, each with all its
    occurrences: together they cover what the maximal repeats cover, which hold them.
    """
    found = Found(docs, length, gram, hot, True)
    own = found.spans.where("twin IS NULL").select("repeat", "text", "start", "size", "snippet")
    twins = found.spans.where("twin IS NOT NULL")
    away = twins.where("text <> twin OR start <> twin_start").select("twin", "twin_start", F.col("text").alias("text_"), F.col("start").alias("start_"), F.col("size").alias("size_"))
    same = own.join(away, (F.col("text") == F.col("twin")) & (F.col("snippet") == F.col("twin_start")))
    moved = same.select("repeat", F.col("text_").alias("text"), (F.col("start_") + F.col("start") - F.col("snippet")).alias("start"), "size")
    every = own.drop("snippet").unionByName(moved).unionByName(twins.select("repeat", "text", "start", "size")).distinct()
    holders = found.texts.select("doc_id", F.col("text_key").alias("text")).distinct()
    whole = found.texts.join(found.equal.where("n > 1").select("text_key"), "text_key")
    whole = whole.select(F.xxhash64("text_key").alias("repeat"), "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("size"))
    return every.join(holders, "text").select("repeat", "doc_id", "start", "size").unionByName(whole)


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The run a..b without the characters that it only cuts."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of struct start, stop), kept (binary), and the carried columns.

    spans are the maximal byte runs covered by a `length`-byte string that starts at another place too, in any
    document; overlapping occurrences count and strings are judged on the input. kept is the rest; as_text makes it a
    string that also keeps the characters of which a run covers a part only.
    Null text: as empty. Texts shorter than `length` are kept whole. Repeated rows are repeats of each other; rows of one id
    and different texts are texts of their own.
    Rows with a null id can't be addressed: they take no part and are left out. Columns not carried are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("rest")).where("doc_id IS NOT NULL")
    found = Found(own.select("doc_id", "text"), length, gram, hot, False)
    one = found.equal.where("n = 1").select("text_key", F.col("rep").alias("doc_id"))
    parts = by_text(found.spans)
    whole = found.equal.where("n > 1").select("text_key").join(found.texts, "text_key")
    whole = whole.select("doc_id", "text_key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("size"))).alias("found")).distinct()
    spans = parts.join(one, "text_key").select("doc_id", "text_key", "found").unionByName(whole)
    joined = base.zipped(own, ("rest",), keyed=True).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "z", "found", F.col("rest.c0").alias("rest"))

    def run(batch):
        for a, b in base.chunks(pc.binary_length(batch.column(1)).to_pylist(), SLICE >> 2):
            yield sliced(batch.slice(a, b - a))

    def sliced(batch):
        kept, sizes, runs = [], [], []
        for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = base.unpacked(z)
            sizes.append(len(text))
            own: list[list[int]] = []
            for a, e in sorted((x["start"], x["start"] + x["size"]) for x in found or ()):
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], e)
                else:
                    own.append([a, e])
            cut = [whole_characters(text, a, b) for a, b in own] if as_text else own
            edges = [0, *(x for pair in cut for x in pair), len(text)]
            left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            kept.append(left.decode() if as_text else left)
            runs.append([{"start": a, "stop": b} for a, b in own])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.string() if as_text else pa.binary()), batch.column(3)], names=["doc_id", "n_bytes", "spans", "kept", "rest"])

    kind = own.schema["rest"].dataType.simpleString()
    out = base.mapped(joined, run, f"doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept {'string' if as_text else 'binary'}, rest {kind}")
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)])
