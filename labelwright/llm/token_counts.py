"""Token counts by the tokenizer libraries: batches encoded in Arrow functions, of which only lengths come back.

A batch holds rows of about BATCH_BYTES; a longer text is worked through in stretches of PART characters. Texts are cut at
safe boundaries, where no token and no rule of the tokenizer reaches across, so that a text's count is the sum of its
parts' counts. Parts are mostly words, which repeat: a batch's distinct parts are encoded once each, in slices.

Safe boundaries are read off the tokenizer file. A byte-level file whose pre-tokenizer splits by its own expression (a
space begins a pre-token and never ends one) is cut before a space that follows no white space; so is one that drops
white space between words. A sentencepiece model that puts its space mark before the text, and has no piece with the mark
inside, is cut between ASCII letters and digits, where the mark that it adds stands for the space. Other files: whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base

BATCH_BYTES, PART, SLICE = 1 << 22, 1 << 20, 1 << 14
#: The pre-tokenizer's expression of files that drop white space, as in the public word-end vocabulary.
DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "\N{LOWER ONE EIGHTH BLOCK}"
#: White space, by any library's definition, before a space.
BEFORE_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85] "


class Lengths:
    """Numbers of tokens by a tokenizers file (.json); nothing is added, cut off or filled up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cut = re.compile(r"(?<=\S)(?= )") if self._space_begins(json.load(f)) else None

    @staticmethod
    def _space_begins(spec: dict) -> bool:
        """Whether each space after no white space is a boundary that nothing reaches across."""
        added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        names = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])}
        first = steps[0]
        if first.get("type") == "ByteLevel":
            return added and not names and len(steps) == 1 and first["use_regex"] and not first["add_prefix_space"]
        drops = first.get("type") == "Split" and first["pattern"] == {"Regex": DROPS_SPACE} and first["behavior"] == "Removed" and first["invert"]
        return bool(added and drops and names <= {"NFC", "Replace", "Lowercase"})

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Each text's number of parts, all parts' places among the distinct ones, and those."""
        if self.cut is None:
            found = texts.dictionary_encode()
            return np.ones(len(texts), np.int64), found.indices.to_numpy(), found.dictionary
        hard = pc.match_substring_regex(texts, BEFORE_SPACE).to_numpy(zero_copy_only=False)
        easy = pc.split_pattern(texts.filter(pa.array(~hard)), " ")
        rest = pa.array([self.cut.split(x) for x in texts.filter(pa.array(hard)).to_pylist()], pa.list_(pa.string()))
        sizes = np.empty(len(texts), np.int64)
        sizes[~hard], sizes[hard] = pc.list_value_length(easy).to_numpy(), pc.list_value_length(rest).to_numpy()
        words = easy.flatten().dictionary_encode()
        inner, first = words.indices.to_numpy().astype(np.int64), np.cumsum(sizes[~hard]) - sizes[~hard]
        inner[first] += len(words.dictionary)  # a text's first part has no space before it
        spaced = pc.binary_join_element_wise("", words.dictionary, " ")
        others = rest.flatten()
        every = pa.concat_arrays([spaced, words.dictionary, others])
        places = np.empty(sizes.sum(), np.int64)
        is_hard = np.repeat(hard, sizes)
        places[~is_hard], places[is_hard] = inner, 2 * len(spaced) + np.arange(len(others))
        used, places = np.unique(places, return_inverse=True)
        found = every.take(pa.array(used)).dictionary_encode()
        return sizes, found.indices.to_numpy()[places], found.dictionary

    def encoded_lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def of(self, texts: pa.Array, part: int = PART) -> np.ndarray:
        """The number of tokens of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if self.cut is not None and len(texts) and pc.max(pc.utf8_length(texts)).as_py() > part:
            return np.array([sum(self._sum(pa.array([x]))[0] for x in stretches(t, self.cut, part)) for t in texts.to_pylist()], np.int64)
        return self._sum(texts)

    def _sum(self, texts: pa.Array) -> np.ndarray:
        sizes, places, parts = self.parts(texts)
        counts = np.fromiter((n for a in range(0, len(parts), SLICE) for n in self.encoded_lengths(parts.slice(a, SLICE).to_pylist())), np.int64, len(parts))
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), counts[places], len(sizes)).astype(np.int64)


class PieceLengths(Lengths):
    """Numbers of tokens by a sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        marked = all(MARK not in p.lstrip(MARK) for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.cut = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])") if marked else None

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        lists = pa.array([self.cut.split(x) if self.cut else [x] for x in texts.to_pylist()], pa.list_(pa.string()))
        found = lists.flatten().dictionary_encode()
        return pc.list_value_length(lists).to_numpy(), found.indices.to_numpy(), found.dictionary

    def encoded_lengths(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(parts, num_threads=1)]


def stretches(text: str, cut: re.Pattern, part: int):
    """A text in stretches of `part` characters or more, up to the next safe boundary; without one, the rest is whole."""
    at = 0
    while m := cut.search(text, at + part):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


_known: dict[str, Lengths] = base.remembered({})


def lengths(path: str) -> Lengths:
    if path not in _known:
        _known[path] = (PieceLengths if path.endswith(".model") else Lengths)(path)
    return _known[path]


def counted(df: DataFrame, path: str, text_col: str = "text", name: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """df with `name` long: the number of tokens of text_col by the tokenizer file at `path`, which every executor has.

    A .json file is read by the tokenizers library, a .model file by sentencepiece; no tokens are added at begin or end,
    truncation and padding of the file are unused, and special tokens' strings in a text count as the library's default
    has them. Null or empty text: 0. Rows with null or repeated ids and other columns pass through, a column called `name`
    is replaced; keep_text=False leaves text_col out. An empty table gives an empty one.
    """
    return base.appended(df, text_col, name, "long", lambda texts: pa.array(lengths(path).of(texts), pa.int64()), BATCH_BYTES, keep_text)
