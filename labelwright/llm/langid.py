"""Language identification by compression against per-language dictionaries.

A text is lower-cased; for each language the whole of it is compressed by zstandard with a raw-content dictionary of that
language, and the smallest result wins. All texts are compressed at one level. Equal sizes go to the language with more
training documents. The margin is (second - best) / length; a narrow one is a rejection. Sizes are whole bytes: below
1 / NARROW bytes of text only a tie is narrow.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

UNDETERMINED = "und"
MOST_BROADCAST = 10_000
ROWS_PER_LANGUAGE, DICTIONARY_BYTES, MODEL_BYTES, LEVEL, NARROW = 400, 256 << 10, 64 << 20, 6, 0.002
LETTER = regex.compile(r"\p{L}")


def lowered(text: str) -> bytes:
    return text.lower().encode()


def trained(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes, int]]:
    """(language, dictionary, training documents) of labelled rows (doc_id, text, lang).

    A dictionary holds whole lower-cased texts of at most `rows` rows a language, those of the least hash, up to `size`
    bytes, and all dictionaries MODEL_BYTES; texts over 64k characters are not sampled. Rows without text or language are
    left out, other columns ignored.
    """
    own = base.renamed(labelled, doc_id="doc_id", text="text", lang="lang")
    counts = base.written(own.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if languages <= MOST_BROADCAST:  # a row a language; else Spark joins as it likes
        counts = F.broadcast(counts)
    h = F.abs(F.xxhash64("doc_id", "lang") % 1_000_000)
    near = own.where(F.length("text").between(1, 1 << 16)).withColumn("h", h).join(counts, "lang").where(F.col("h") * F.col("n") <= 4 * rows * 1_000_000)
    ranked = near.select("lang", "n", "text", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text")).alias("k")).where(F.col("k") <= rows)
    size = min(size, MODEL_BYTES // max(languages, 1))
    before = F.coalesce(F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = ranked.withColumn("before", before).where(F.col("before") < size)  # what the driver gets is bounded, too
    found: dict[str, list] = {}
    for r in sorted(needed.select("lang", "k", "n", "text").collect(), key=lambda r: (r.lang, r.k)):
        own_words = found.setdefault(r.lang, [r.n, b""])
        own_words[1] += b" " * bool(own_words[1]) + lowered(r.text)
    return [(lang, words[-size:], n) for lang, (n, words) in found.items() if LETTER.search(words.decode())]


class Sizes:
    def __init__(self, model: list[tuple[str, bytes, int]]):
        self.languages = sorted(model, key=lambda m: (-m[2], m[0]))
        self.compressors = [self._compressor(words, LEVEL) for _, words, _ in self.languages]

    @staticmethod
    def _compressor(words: bytes, level: int) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str | None) -> tuple[str, float, float]:
        """Language, margin and score of a text."""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        words = lowered(text)
        sizes = [len(c.compress(words)) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = (min(sizes[:best] + sizes[best + 1 :], default=sizes[best] + len(words)) - sizes[best]) / len(words)
        return self.languages[best][0], margin, 1 - math.exp(-50 * margin)


def judged(docs: DataFrame, model: list[tuple[str, bytes, int]], text_col: str = "text", name: str = "language") -> DataFrame:
    """docs with a struct column (lang_pred, score, margin, rejected); every other column passes through.

    Null text or no letter: `und`, score 0, rejected. Otherwise a language of the model, rejected where the margin
    is below NARROW. Without any training row all is `und`. A column of that name is replaced.
    """
    held: list[Sizes] = []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DICTIONARY_BYTES a language at most

    def found(texts):
        if not held:
            held.append(Sizes(shared.value))
        rows = [(lang, score, margin, lang == UNDETERMINED or margin < NARROW) for lang, margin, score in map(held[0].of, texts.to_pylist())]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["lang_pred", "score", "margin", "rejected"])

    return base.appended(docs, text_col, name, "struct<lang_pred:string,score:double,margin:double,rejected:boolean>", found)


def identified(docs: DataFrame, model: list[tuple[str, bytes, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), margin, rejected, as judged() defines them.

    Ids may be null or repeat; other columns are ignored.
    """
    return judged(base.renamed(docs, doc_id=id_col, text=text_col), model).select("doc_id", "language.*")
