"""Text normalization as columns. Native: Unicode compatibility forms are not folded (see strict_normalized)."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship

QUOTES, STRAIGHT = "‘’‚‛′´`“”″", "'" * 7 + '"' * 3


def missing(c: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    """Quotes straightened, punctuation to spaces, white space collapsed, lower case."""
    straight = F.translate(c, QUOTES, STRAIGHT)
    return F.lower(one_spaced(F.regexp_replace(straight, r"\p{P}", " ")))


def strict_normalized(spark):
    """A pandas UDF of normalized() with NFKC before and casefold after, for text beyond what native functions fold."""
    ship(spark)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        table = str.maketrans(QUOTES, STRAIGHT)

        def one(text):
            if text is None:
                return None
            text = unicodedata.normalize("NFKC", text).translate(table)
            return " ".join("".join(" " if unicodedata.category(ch)[0] == "P" else ch for ch in text).split()).casefold()

        return texts.map(one, na_action="ignore")

    return fold


def _folded_sign(ch: str) -> str:
    """What strict_normalized() makes of one character; punctuation and white space become a space."""
    made = unicodedata.normalize("NFKC", ch).translate(str.maketrans(QUOTES, STRAIGHT))
    return "".join(" " if unicodedata.category(x)[0] == "P" or x.isspace() else x for x in made).casefold()


@functools.cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(signs, what each becomes, what some become of several or no signs) of all code points that a fold changes.

    Made from Python's Unicode data, so that the native form and the Python form have the same version of it.
    """
    found = {ch: made for ch in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (made := _folded_sign(ch)) != ch}
    one = [(ch, made) for ch, made in found.items() if len(made) == 1]
    return "".join(ch for ch, _ in one), "".join(made for _, made in one), {ch: made for ch, made in found.items() if len(made) != 1}


@functools.cache
def lower_tables() -> tuple[str, str]:
    """(signs, their lower case) of all code points whose lower case is one sign, and another."""
    found = [(ch, ch.lower()) for ch in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if len(ch.lower()) == 1 and ch.lower() != ch]
    return "".join(ch for ch, _ in found), "".join(made for _, made in found)


def lower_same_length(c: Column) -> Column:
    """Lower case sign by sign; a sign whose lower case is several stays, so that places in the text stay, too."""
    return F.translate(c, *lower_tables())


#: Signs that another before them may take up or move past in NFKC: marks, and the vowels and ends of Hangul.
JOINING = r"[\p{M}\x{1161}-\x{1175}\x{11a8}-\x{11c2}]"


def strict_folded(spark, joined: bool = True) -> Callable[[Column], Column]:
    """strict_normalized() by native functions: a function of a text column.

    Signs that become one sign go by `translate`, all others by a map that only texts with such signs need. Texts with signs that
    join the one before them (JOINING) are the Python form's work, as NFKC is no matter of single signs there; others do not
    go to Python. joined=False leaves Python out, for texts that have none.
    """
    signs, one, more = fold_tables()
    several = "".join(more)
    pairs = F.create_map(*[F.lit(x) for ch, made in more.items() for x in (ch, made)])
    python = strict_normalized(spark) if joined else None

    def fold(c: Column) -> Column:
        plain = F.translate(c, signs, one)
        has = lambda x: F.length(F.translate(x, several, "")) < F.length(x)
        long_ = F.array_join(F.transform(F.split(plain, ""), lambda ch: F.when(has(ch), F.try_element_at(pairs, ch)).otherwise(ch)), "")
        native = F.trim(F.regexp_replace(F.when(has(plain), long_).otherwise(plain), " +", " "))
        if python is None:
            return native
        joins = c.rlike(JOINING)
        return F.when(joins, python(F.when(joins, c))).otherwise(native)

    return fold


def composed(spark) -> Callable[[Column], Column]:
    """A function of a text column: NFC, by Python where there are signs that join others, and as it is elsewhere."""
    ship(spark)

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    def form(c: Column) -> Column:
        joins = c.rlike(JOINING)
        return F.when(joins, compose(F.when(joins, c))).otherwise(c)

    return form


class Folding(NamedTuple):
    """How texts are prepared for a comparison: compose, of whole texts, and fold, of texts or of single words after it."""

    compose: Callable[[Column], Column]
    fold: Callable[[Column], Column]


NATIVE = Folding(lambda c: c, normalized)


def folding(spark, strict: bool) -> Folding:
    """NATIVE, or NFKC and casefold: words are folded by native functions, after texts with joining signs have been composed."""
    return Folding(composed(spark), strict_folded(spark, joined=False)) if strict else NATIVE


def rejoined_hyphens(c: Column) -> Column:
    """Words that a line break splits at a hyphen."""
    return F.regexp_replace(c, "(?U)(?<=\\w)[-\u2010\u2011]\\s+(?=\\w)", "")


def tokens(c: Column, fold: Callable[[Column], Column] = normalized) -> Column:
    """Array of struct (printed, norm) of the words that normalize to something."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    norm = lambda w: F.when(w.rlike("^[A-Za-z0-9]+$"), F.lower(w)).otherwise(fold(w))  # a plain word only has its case to lose
    return F.filter(F.transform(words, lambda w: F.struct(w.alias("printed"), norm(w).alias("norm"))), lambda t: t["norm"] != "")


#: White space as the native forms have it; str.split() also cuts at four separators of information.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def printed_words(text: str) -> list[str]:
    """The words of tokens(), in Python, with those that normalize to nothing."""
    if any(x in text for x in "\x1c\x1d\x1e\x1f"):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def punctuation(spark) -> dict[int, str]:
    """What normalized() makes spaces of, for str.translate(): the signs that the session's own expressions know, as versions of Unicode differ. Asked for once a session."""
    context = spark.sparkContext
    if not hasattr(context, "_labelwright_punctuation"):
        sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").where(sign.rlike(r"\p{P}")).collect()
        context._labelwright_punctuation = dict.fromkeys([*map(ord, QUOTES), *(r.id for r in found)], " ")
    return context._labelwright_punctuation


def normalized_word(word: str, signs: dict[int, str]) -> str:
    """normalized() of one word, in Python; signs: see punctuation()."""
    plain = word.strip("!\"#%&'()*,-./:;?@[\\]_`{}")
    if plain.isascii() and plain.isalnum():
        return plain.lower()
    return " ".join(x for x in word.translate(signs).split(" ") if x).lower()


def has_words(c: Column) -> Column:
    """Whether tokens() has any, without cutting the text."""
    return F.translate(c, QUOTES, STRAIGHT).rlike(r"(?U)[^\s\p{P}]")


def stem(name: Column) -> Column:
    """File name without its folders and last extension, lower case; a name that is only an extension stays."""
    last = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.lower(F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last))


def without_code(c: Column) -> Column:
    """Text before a trailing code of one to three capitals or digits; null where there is none."""
    found = F.regexp_extract(c, r"^(.*\S)\s+([A-Z0-9]{1,3})\s*$", 1)
    return F.when(found != "", found)


def guarded_cell(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
