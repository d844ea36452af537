"""Byte-pair encoding with a segment tree over adjacent pair ranks.

Each leaf of a word's tree holds (rank, place) of the pair that starts at a symbol; an inner node holds the
least of its two children, so the root is the leftmost pair of the lowest rank. A merge changes three leaves
and their paths to the root; encoding ends when the root shows no mergeable pair. Words of like length are
merged side by side, one merge a word a step, so that each step is a few array operations.

Ranks, ids and byte symbols come from a tokenizer file, whose path is a parameter. Texts are cut at single
spaces, where the pre-tokenizer always cuts too. A batch's distinct pieces are merged once, and its texts' ids
gathered by arrays; nothing is remembered from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import base

#: The byte-level pre-tokenizer's pattern, as the tokenizer files' format defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters that are one character in any case and form, then ASCII punctuation, no apostrophe among it: two pre-tokens at most.
PLAIN = r"^(?P<letters>(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?)(?P<signs>(?: ?[!-&(-/:-@\[-`{-~]+)?)$"
CELLS = 1 << 16
BATCH_CHARS = 1 << 22
NONE = np.int64(1 << 62)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranks and results of the merges by pair of ids, as an open hash table for arrays of pairs."""

    def __init__(self, pairs: list[tuple[int, int, int]], ids: int):
        self.ids = ids
        size = 1 << (len(pairs) * 4).bit_length()
        self.mask = size - 1
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        for rank, (a, b, made) in enumerate(pairs):
            key = a * ids + b
            at = self._slot(key)
            while self.keys[at] not in (-1, key):
                at = at + 1 & self.mask
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at], self.made[at] = key, rank, made
        self.result = np.array([m for _, _, m in pairs] or [0], np.int64)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 15) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair doesn't merge or right is below 0."""
        key = left * self.ids + right
        at = self._slot(key)
        found = self.keys.take(at)
        out = np.where((found == key) & (right >= 0), self.ranks.take(at), NONE)
        todo = np.flatnonzero((found != key) & (found != -1) & (right >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Runs:
    """Runs of numbers, end to end in `values`, of `counts` numbers each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.starts = np.cumsum(counts) - counts

    def take(self, at: np.ndarray) -> Runs:
        """The runs at the given positions, in that order."""
        counts = self.counts[at]
        before = np.cumsum(counts) - counts
        return Runs(self.values[np.repeat(self.starts[at] - before, counts) + np.arange(counts.sum())], counts)

    def through(self, parts: Runs) -> Runs:
        """Each run's numbers replaced by the run of parts at that number."""
        own = parts.take(self.values)
        ends = np.concatenate(([0], np.cumsum(own.counts)))
        return Runs(own.values, ends[self.starts + self.counts] - ends[self.starts])


def joined(runs: list[Runs]) -> Runs:
    return Runs(np.concatenate([r.values for r in runs]), np.concatenate([r.counts for r in runs]))


def string_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes end to end and their numbers, without a Python object a word."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    edges = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8), np.diff(edges)


def word_runs(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lists of strings: each string's place among the distinct ones, those, and the lists' sizes."""
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy(), flat.dictionary, pc.list_value_length(lists).to_numpy()


def cut_pieces(pieces: pa.Array, cut: Callable[[str], list[str]]) -> tuple[Runs, pa.Array]:
    """Each piece's parts as places among the distinct parts, and those: PLAIN's two, or what cut() makes of others."""
    both = pc.extract_regex(pieces, PLAIN)
    simple = both.is_valid().to_numpy(zero_copy_only=False)
    easy, hard = np.flatnonzero(simple), np.flatnonzero(~simple)
    at, others, sizes = word_runs(pa.array(list(map(cut, pieces.take(pa.array(hard)).to_pylist())), pa.list_(pa.string())))
    plain = both.take(pa.array(easy))
    every = pa.concat_arrays([pc.struct_field(plain, "letters"), pc.struct_field(plain, "signs"), others]).dictionary_encode()
    place, n = every.indices.to_numpy().astype(np.int64), len(easy)
    runs = joined([Runs(place[: 2 * n].reshape(2, n).T.ravel(), np.full(n, 2)), Runs(place[2 * n :][at], sizes)])
    back = np.empty(len(pieces), np.int64)
    back[np.concatenate((easy, hard))] = np.arange(len(pieces))
    return runs.take(back), every.dictionary


def merged(words: pa.Array, first: np.ndarray, merges: Merges, final: np.ndarray | None = None) -> Runs:
    """Each word's ids after all merges; first: the id of each byte, final: of a word's last byte."""
    data, sizes = string_bytes(words)
    symbols = first[data]
    starts = np.cumsum(sizes) - sizes
    if final is not None:
        ends = (starts + sizes - 1)[sizes > 0]
        symbols[ends] = final[data[ends]]
    bits = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    order, found = [np.flatnonzero(sizes == 0)], [Runs(np.empty(0, np.int32), np.zeros((sizes == 0).sum(), np.int64))]
    for k in np.unique(bits).tolist():
        own = np.flatnonzero((bits == k) & (sizes > 0))
        step = max(1, CELLS >> k)
        for a in range(0, len(own), step):
            order.append(own[a : a + step])
            found.append(_merge(symbols, starts[order[-1]], sizes[order[-1]], k, merges))
    back = np.empty(len(sizes), np.int64)
    back[np.concatenate(order)] = np.arange(len(sizes))
    return joined(found).take(back)


def _merge(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int, merges: Merges) -> Runs:
    """The words' runs after all merges; a word's tree, symbols and links lie together, one word after the other."""
    leaves, n = 1 << bits, len(sizes)
    kind = np.int32 if len(merges.result) * leaves < 1 << 31 else np.int64
    none = np.iinfo(kind).max
    wide = leaves + 1  # a place behind the last one
    place = np.arange(wide)
    symbol = np.where(place < sizes[:, None], symbols[np.minimum(starts[:, None] + place, len(symbols) - 1)], -1)
    after = np.minimum(np.arange(1, wide + 1), sizes[:, None])
    before = np.repeat(np.arange(-1, leaves)[None], n, axis=0)
    rank = merges.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, leaves)
    tree = np.full((n, 2 * leaves), none, kind)
    tree[:, leaves:] = np.where(rank < NONE, rank * leaves + place[:-1], none)
    for k in range(bits - 1, -1, -1):
        np.minimum(tree[:, 2 << k : 4 << k : 2], tree[:, (2 << k) + 1 : 4 << k : 2], out=tree[:, 1 << k : 2 << k])
    active = np.flatnonzero(tree[:, 1] < none)
    symbol, after, before, tree = symbol.ravel(), after.ravel(), before.ravel(), tree.ravel()
    while len(active):
        top, low = active * 2 * leaves, active * wide
        root = tree.take(top + 1).astype(np.int64)
        at = root & leaves - 1
        right = after.take(low + at)
        then, prev = after.take(low + right), before.take(low + at)
        made = merges.result.take(root >> bits)
        symbol[low + at], symbol[low + right] = made, -1
        after[low + at] = then
        before[low + then] = at
        new = merges.rank(made, symbol.take(low + then))  # the place behind the last one holds -1
        first = np.flatnonzero(prev >= 0)
        old = merges.rank(symbol.take(low[first] + prev[first]), made[first])
        tree[top + leaves + right] = none
        tree[top + leaves + at] = np.where(new < NONE, new * leaves + at, none)
        tree[top[first] + leaves + prev[first]] = np.where(old < NONE, old * leaves + prev[first], none)
        tops = np.concatenate((top, top, top[first]))
        nodes = leaves + np.concatenate((right, at, prev[first]))
        for _ in range(bits):  # the paths to the root
            nodes >>= 1
            left = tops + 2 * nodes
            tree[tops + nodes] = np.minimum(tree.take(left), tree.take(left + 1))
        active = active[tree.take(top + 1) < none]
    symbol = symbol.reshape(n, wide)
    live = symbol >= 0
    return Runs(symbol[live].astype(np.int32), live.sum(axis=1))


class Encoder:
    """A byte-level BPE tokenizer file, without its post-processor."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {**vocab, **self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], max(named.values()) + 1)
        signs = byte_symbols()
        self.first = np.array([vocab[s] for s in signs])
        self.cut = regex.compile(PATTERN)
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, special tokens among them."""
        edges = [0, *(e for m in self.stops.finditer(text) for e in m.span()), len(text)] if self.stops else [0, len(text)]
        parts = [text[a:b] for a, b in zip(edges, edges[1:])]
        return [y for i, x in enumerate(parts) for y in ([x] if i % 2 else self.cut.findall(x))]

    def _cut(self, texts: pa.Array) -> tuple[Runs, pa.Array]:
        """Each text's pieces as places among the distinct ones, and those.

        A text without two white spaces in a row and without special tokens is cut at its single spaces: one that
        follows begins with its space. Others are cut by the pattern as a whole.
        """
        hard = pc.match_substring_regex(texts, r"[\s\p{Z}\x0b\x1c-\x1f\x85][\s\p{Z}\x0b\x1c-\x1f\x85]")
        for token in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, token))
        places = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        whole = pa.array([self.pieces(x) for x in texts.take(pa.array(places)).to_pylist()], pa.list_(pa.string()))
        plain = np.flatnonzero(~hard.to_numpy(zero_copy_only=False))
        at, words, sizes = word_runs(pc.split_pattern(texts.take(pa.array(plain)), " "))
        begins = np.cumsum(sizes) - sizes  # a text's first piece has no space before it
        spaced = pc.binary_join_element_wise("", words, " ")
        heads, tails = words.take(pa.array(at[begins])), pa.concat_arrays([spaced, whole.flatten()])
        own = at.astype(np.int64)
        own[begins] = len(tails) + np.arange(len(begins))
        runs = joined([Runs(own, sizes), Runs(len(words) + np.arange(len(whole.flatten())), pc.list_value_length(whole).to_numpy())])
        back = np.empty(len(texts), np.int64)
        back[np.concatenate((plain, places))] = np.arange(len(texts))
        every = pa.concat_arrays([tails, heads]).dictionary_encode()
        runs = runs.take(back)
        return Runs(every.indices.to_numpy()[runs.values], runs.counts), every.dictionary

    def ids(self, texts: pa.Array) -> Runs:
        """Token ids of each text."""
        texts = pc.fill_null(texts, "")
        runs, pieces = self._cut(texts)
        cut, words = cut_pieces(pieces, lambda x: [x] if x in self.special else self.cut.findall(x))
        found = merged(words, self.first, self.merges)
        for token, i in self.special.items():
            for place in np.flatnonzero(pc.equal(words, token).to_numpy(zero_copy_only=False)):
                values = [found.values[: found.starts[place]], np.array([i], np.int32), found.values[found.starts[place] + found.counts[place] :]]
                found = Runs(np.concatenate(values), np.where(np.arange(len(words)) == place, 1, found.counts))
        return runs.through(cut.through(found))


class Decoder:
    """The bytes of a byte-level BPE file's tokens, in one array."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        back = {s: b for b, s in enumerate(byte_symbols())}
        tokens = [b""] * (max(named.values()) + 1)
        for name, i in named.items():
            tokens[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of joined id lists of the given sizes; bytes that are not UTF-8 become U+FFFD."""
        own = self.sizes[ids]
        ends = np.cumsum(own)
        at = np.repeat(self.starts[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        data = self.bytes[at].tobytes()
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]


_decoders: dict[str, Decoder] = base.remembered({})
_encoders: dict[str, Encoder] = base.remembered({})


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def int_lists(rows: Runs) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rows.counts))), pa.int32()), pa.array(rows.values, pa.int32()))


def encoded(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col array<int>: the tokens of text_col by the byte-level BPE file at `path`, which every executor has.

    The same ids as the tokenizers library gives without special tokens added; a special token's string in the text
    becomes its id, as there. Null or empty text: no ids. A column named ids_col is replaced; others pass through.
    """
    return base.appended(df, text_col, ids_col, "array<int>", lambda texts: int_lists(encoder(path).ids(texts)), BATCH_CHARS)


def decoded(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text of ids_col; bytes that are not UTF-8 become U+FFFD. Null ids: the empty text."""

    def texts(rows):
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        return pa.array(decoder(path).texts(flat, sizes), pa.string())

    return base.appended(df, ids_col, text_col, "string", texts, BATCH_CHARS)
