"""Best-fit packing of documents into sequences of bounded length, by hierarchical residual packing.

Every partition packs its items best-fit, longest first. Nearly full bins are final. The underfull ones become
single items, of fewer partitions a round, and are packed again, until one partition is left or a round no
longer reduces their number. An item is a row of numbers, never a text, and a task holds a bounded number.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, bpe

CAPACITY, END_ID, SLACK, ITEMS_PER_TASK, FAN_IN = 4096, 1, 8, 100_000, 8
BATCH_BYTES = 1 << 21
SEPARATORS = "[\x1c-\x1f]"  # white space by some rules and not by the tokenizer's
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"  # letters whose lower case is one letter, and which are in normal form


#: Fixed value: the pre-tokenizer's pattern in the tokenizer file; what it does not match is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class Tokens:
    """Ids of whole texts by a BPE file with word ends that drops white space.

    Distinct words are merged once a batch by the segment trees of `bpe`; those that hold a special token's string, and
    texts with separators that only one of the two white-space rules knows, by the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        signs = bpe.byte_symbols()
        self.inner = np.array([vocab[x] for x in signs])
        self.final = np.array([vocab[x + WORD_END] for x in signs])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = bpe.Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], len(vocab) + len(spec["added_tokens"]))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile(PATTERN)

    @cached_property
    def tokenizer(self):
        """The library's own, which few texts need: it is made for the first of them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def _encoded(self, texts: list[str]) -> bpe.Runs:
        if not texts:
            return bpe.Runs(np.empty(0, np.int32), np.empty(0, np.int64))
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found = [np.array(e.ids, np.int32) for e in encode(texts, add_special_tokens=False)]
        return bpe.Runs(np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def _parts(self, word: str) -> list[str]:
        """What the pre-tokenizer cuts out of a word."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            word = word.lower() if "Σ" not in word else "".join(map(str.lower, word))
        else:
            word = word.lower()
        return [word] if word.isalpha() else self.cut.findall(word)

    def _words(self, words: pa.Array) -> bpe.Runs:
        """Ids of distinct words, which hold no white space."""
        special = pc.equal(words, None).fill_null(False)
        for token in self.special:
            special = pc.or_(special, pc.match_substring(words, token))
        special = special.to_numpy(zero_copy_only=False)
        plain, known = np.flatnonzero(~special), np.flatnonzero(special)
        cut, parts = bpe.cut_pieces(words.take(pa.array(plain)), self._parts)
        lower = parts.dictionary_encode() if not len(parts) else pc.if_else(pc.match_substring_regex(parts, LATIN), pc.utf8_lower(parts), parts).dictionary_encode()
        found = bpe.merged(lower.dictionary, self.inner, self.merges, self.final).take(lower.indices.to_numpy())
        back = np.empty(len(words), np.int64)
        back[np.concatenate((plain, known))] = np.arange(len(words))
        return bpe.joined([cut.through(found), self._encoded(words.take(pa.array(known)).to_pylist())]).take(back)

    def ids(self, texts: pa.Array) -> bpe.Runs:
        """Token ids of each text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, SEPARATORS).to_numpy(zero_copy_only=False)
        plain, whole = np.flatnonzero(~odd), np.flatnonzero(odd)
        at, words, sizes = bpe.word_runs(pc.ascii_split_whitespace(texts.take(pa.array(plain))))
        found = bpe.Runs(at, sizes).through(self._words(words))
        back = np.empty(len(texts), np.int64)
        back[np.concatenate((plain, whole))] = np.arange(len(texts))
        return bpe.joined([found, self._encoded(texts.take(pa.array(whole)).to_pylist())]).take(back)


_tokens: dict[str, Tokens] = base.remembered({})


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of the documents' tokens, ids as little-endian 32-bit numbers.

    A document is its tokens by the tokenizer file at `path`, without special tokens added, and then end_id; only one of
    more than `capacity` is cut, every `capacity` tokens. Null or empty text: one piece, end_id alone. Ids may be null or
    repeat; each row has pieces of its own. Other columns are ignored.
    """

    def run(batch):
        texts = batch.column(1)
        for a, b in base.chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_BYTES):
            found = tokens(path).ids(texts.slice(a, b - a))
            ends = np.cumsum(found.counts)
            values = np.insert(found.values, ends, end_id).astype("<u4")
            sizes = found.counts + 1
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(b - a), cuts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            edges = pa.py_buffer((4 * np.concatenate(([0], np.cumsum(length)))).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(row), [None, edges, pa.py_buffer(values)])
            made = [batch.column(0).take(pa.array(a + row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids"])

    own = base.renamed(docs, doc_id=id_col, text=text_col)
    return base.mapped(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, into the fullest bin that holds it. A set bit tells which residuals exist."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := present >> size:
            left = size + (fits & -fits).bit_length() - 1
            own = open_bins[left].pop()
            if not open_bins[left]:
                present ^= 1 << left
        else:
            left, own = capacity, count
            count += 1
        bins[i] = own
        left -= size
        open_bins[left].append(own)
        present |= 1 << left
    return bins


def _round(items: DataFrame, parts: int, number: int, capacity: int, slack: int, last: bool) -> DataFrame:
    names = [c for c in items.columns if c != "done"]

    def run(batches):
        if not (found := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(found).combine_chunks()
        old, size, offset = (table.column(c).to_numpy() for c in ("bin", "length", "offset"))
        order = np.lexsort((offset, old))
        table, old, size, offset = table.take(pa.array(order)), old[order], size[order], offset[order]
        first = np.concatenate(([True], old[1:] != old[:-1])) if number else np.ones(len(old), bool)
        item = np.cumsum(first) - 1
        fill = np.bincount(item, weights=size).astype(np.int64)
        bins = best_fit(fill, capacity)
        by_bin = np.argsort(bins, kind="stable")
        total = np.cumsum(fill[by_bin]) - fill[by_bin]
        starts = np.concatenate(([True], bins[by_bin][1:] != bins[by_bin][:-1]))
        base_of = np.empty(len(fill), np.int64)
        base_of[by_bin] = total - np.repeat(total[starts], np.diff(np.concatenate((np.flatnonzero(starts), [len(fill)]))))
        full = np.bincount(bins, weights=fill).astype(np.int64)
        where = TaskContext.get().partitionId()
        made = {"bin": (number << 56) + (where << 32) + bins[item], "offset": offset + base_of[item]}
        for name, values in made.items():
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        table = table.append_column("done", pa.array((full[bins[item]] >= capacity - slack) | last))
        yield from table.to_batches(max_chunksize=20_000)

    schema = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in names) + ", done boolean"
    dealt = items.select(*names).repartition(parts, "bin")
    return base.by_arrow(dealt, run, schema)


def packed(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """items with sequence_id and offset: their places in sequences of at most `capacity`, gapless from 0.

    items: any columns with length, 1 to capacity; columns sequence_id, offset, bin and done are replaced. Bins within
    `slack` of the capacity are final at once. An empty table gives an empty result.
    """
    own = items.drop("sequence_id", "offset", "bin", "done")
    now = base.written(own.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")), "items")
    count = now.count()
    found, number = [], 0
    while True:
        parts = max(1, -(-count // per_task))
        if number:
            parts = max(parts, -(-before // FAN_IN))
        last = parts == 1 or number > 1 and count > 0.9 * previous
        then = base.written(_round(now, parts, number, capacity, slack, last), "bins")
        if not number:
            base.release(now)
        found.append(then.where("done"))
        if last:
            break
        previous, before, number = count, parts, number + 1
        now = then.where("NOT done")
        count = now.select("bin").distinct().count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("bin", "sequence_id").drop("done")
