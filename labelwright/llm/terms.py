"""Term counts of texts by arrays: a table of bytes separates terms, and each slice of text is counted at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS, ALPHANUMERIC = "", "0123456789"
SLICE_BYTES = 1 << 22


def byte_table(ascii_signs: str) -> bytes:
    """A-Z in lower case; every other ASCII byte but a-z and those named becomes a space; bytes of other characters stay."""
    keep = {*map(ord, ascii_signs), *range(ord("a"), ord("z") + 1), *range(128, 256)}
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in keep else 32 for b in range(256))


def counts(texts: pa.Array, table: bytes, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, term, occurrences) of each term of each row, rows ascending, and the terms that the second array numbers.

    Rows come in slices of about `most` bytes. A longer text is cut between terms, and its slices' counts are added up.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        if sizes[start] > most:
            yield _long(texts[start].as_py().encode().translate(table), start, most)
            start += 1
            continue
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right")))
        data = b"".join((x or "").encode() for x in texts.slice(start, end - start).to_pylist()).translate(table)
        offsets = np.concatenate(([0], np.cumsum(sizes[start:end]))).astype(np.int32)
        row, term, n, names = _counted(pa.StringArray.from_buffers(end - start, pa.py_buffer(offsets), pa.py_buffer(data)))
        yield row + start, term, n, names
        start = end


def _long(data: bytes, row: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    at, total = 0, pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        _, term, n, names = _counted(pa.array([data[at:end].decode()], pa.string()))
        total = pa.concat_tables([total, pa.table({"term": names.take(pa.array(term)), "n": n})]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
        at = end
    total = total.combine_chunks()
    return np.full(len(total), row), np.arange(len(total)), total["n"].to_numpy(), pa.concat_arrays([pa.array([], pa.string()), *total["term"].chunks])


def _counted(separated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    lists = pc.ascii_split_whitespace(separated)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    real = pc.not_equal(words, "")
    words, rows = words.filter(real).dictionary_encode(), rows[real.to_numpy(zero_copy_only=False)]
    n = max(len(words.dictionary), 1)
    keys, times = np.unique(rows * n + words.indices.to_numpy(), return_counts=True)
    return keys // n, keys % n, times, words.dictionary
