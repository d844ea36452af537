"""Personal data with source offsets, plain and disguised.

Plain spans are found by patterns. For disguised ones, transducers rewrite the text: look-alike characters become
ASCII and invisible ones vanish; spelled digits become digits; at/dot disguises become @ and a point. Every
rewritten character keeps the source range it came from, so identifiers that are found in the rewritten text map back
to source spans. A text is rewritten if it has any sign of what a transducer handles; signs() is wider than they are.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Kinds in the order of reports, and what an identifier looks like.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = regex.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = regex.compile(r"[0-9]")

#: Spelled digits of English, German, French and Spanish, and words for @ and the point.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
ENDINGS = frozenset("com org net edu gov mil int info biz io co dev app ai me tv de fr es it nl be at ch uk eu us ca au jp cn in br mx pl se no fi dk pt ie ru".split())
#: Labels that make a spoken address ordinary words ("was at the dot and").
COMMON = frozenset("a an the this that these those some any each every no one and or but of in on to is was were are be it he she we you they i as for with by from then there which what who when where not so if than his her its our your their my".split())
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba"), ("dot", "punkt", "punto", "point")
#: Letters of other scripts that look like ASCII ones; compatibility forms come from Unicode itself.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaovpABEZHIKMNOPTYXia"))
INVISIBLE = "­​‌‍⁠﻿"

_word = "|".join(sorted(SPELLED, key=len, reverse=True))
_digit = rf"(?:(?<![^\W_])(?:{_word})(?![^\W_])|[0-9])"
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_open, _shut = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_bracketed = rf"\s{{0,2}}{_open}(?:\.|{_dot}){_shut}\s{{0,2}}"
SPELLED_RUN = regex.compile(rf"(?:(?<![^\W_])plus\s|\+\s?)?{_digit}(?:[\s,-]{{0,2}}{_digit}|{_bracketed}|\s?(?<![^\W_])(?:{_dot})(?![^\W_])\s?|\.(?={_digit})){{5,}}", regex.I)
RUN_PART = regex.compile(rf"(?P<plus>plus\s|\+)|(?P<dot>{_bracketed}|\s?(?<![^\W_])(?:{_dot})(?![^\W_])\s?|\.)|(?P<digit>{_digit})", regex.I)
AT = rf"(?:\s{{0,2}}{_open}(?:@|{_at}){_shut}\s{{0,2}}|\s(?:{_at})\s|\s?@\s?)"
DOT = rf"(?:\s{{0,2}}{_open}(?:\.|{_dot}){_shut}\s{{0,2}}|\s(?:{_dot})\s|\.)"
#: Any number of labels; one that follows another's point begins no address, so that a long chain is read once.
DISGUISED = regex.compile(rf"(?<![A-Za-z0-9._%+-])(?<![A-Za-z0-9_%+-]{DOT})[A-Za-z0-9_%+-]++(?:{DOT}[A-Za-z0-9_%+-]++)*+(?P<at>{AT})[A-Za-z0-9-]++(?P<dots>(?:{DOT}[A-Za-z0-9-]++)++)", regex.I)
AT_RE, DOT_RE = regex.compile(AT, regex.I), regex.compile(DOT, regex.I)
BRACKETED = regex.compile(rf"{_open}(?:@|{_at}|\.|{_dot}){_shut}", regex.I)
SPOKEN_DOT = regex.compile(rf"\s(?:{_dot})\s", regex.I)
MIXED = re.compile(r"[0-9][ -]?[OoIl|]|[OoIl|][0-9]")
LETTERS = regex.compile(r"(?<![^\W0-9_])[OoIl|](?:[ -]?[OoIl|])*(?![^\W0-9_])")
LETTER_GROUP, SPACED = regex.compile("[OoIl|]+"), regex.compile("[0-9][ -]")
LETTER_DIGITS = str.maketrans("OoIl|", "00111")
#: A spaced @ before these is no address: a handle, which has no space after the @, or a price or an hour.
HANDLE, NUMBER = regex.compile(r"\s@"), regex.compile(r"[0-9]+\.[0-9]+")


def _trie(words: list[str]) -> str:
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    whole = heads.pop("", None)
    return f"(?:{'|'.join(h + _trie(t) for h, t in heads.items())}){'?' * bool(whole)}" if heads else ""


#: Signs, for lower-case texts. Of a run: a spelled digit beside another digit, a disguised point between two, plus before one. Of
#: an address: a worded at and a label before a point of any form.
_one, _point = rf"{_trie(list(SPELLED))}(?![^\W_])", rf"\s?(?:{_dot})\s?|\s{{0,2}}{_open}(?:\.|{_dot}){_shut}\s{{0,2}}"
RUN_SIGNS = [re.compile(p) for p in (rf"\b{_one}(?:(?:{_point})?[\s,-]{{0,2}}|\.)(?:[0-9]|{_one})", rf"[0-9](?:(?:[\s,-]{{0,2}}|\.){_one}|(?:{_point})[\s,-]{{0,2}}(?:[0-9]|{_one}))", r"\bplus\s[0-9]")]
MAIL_SIGN = regex.compile(rf"(?<=[\s\[({{<])(?:{_at})\s{{0,2}}[\])}}>]?\s{{0,2}}[a-z0-9-]++{DOT}[a-z0-9-]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @ outwards: linear, and the same as the leftmost matches of the whole pattern."""
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > least and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            found.append((a, m.end(), "email"))
            least = m.end()
            at = text.find("@", least)
        else:
            at = text.find("@", at + 1)
    return found


def plain(text: str) -> list[Span]:
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 400 and int(p) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return found


class Tape:
    """A rewritten text; each character has the source range it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges, ascending and disjoint; a replacement's characters all stand for the whole range."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _lookalike(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain_form = unicodedata.normalize("NFKC", c)
    return plain_form if len(plain_form) == 1 and plain_form.isascii() else c


def _letters(tape: Tape) -> None:
    """Look-alike letters between digits, each perhaps after a space or hyphen; of other runs the letters that touch a digit, bars apart."""
    text, edits = tape.text, []
    for m in LETTERS.finditer(text):
        a, b = m.span()
        touch = text[a - 1 : a].isdecimal(), text[b : b + 1].isdecimal()
        near = touch[0] or bool(SPACED.fullmatch(text, max(a - 2, 0), a)), touch[1] or bool(SPACED.match(text[b : b + 2][::-1]))
        own = range(a, b)
        if not all(near):
            parts = [p.span() for p in LETTER_GROUP.finditer(text, a, b) if "|" not in p[0]]
            own = [i for x, y in parts if touch[0] and x == a or touch[1] and y == b for i in range(x, y)]
        edits += [(i, i + 1, text[i].translate(LETTER_DIGITS)) for i in own if text[i] not in " -"]
    tape.rewrite(edits)


def _digits(tape: Tape) -> None:
    edits = []
    for run in SPELLED_RUN.finditer(tape.text):
        if not any(c.isalpha() or c in "[({<" for c in run[0]):
            continue
        at, last = run.start(), ""
        for m in RUN_PART.finditer(run[0]):
            new = "+" if m["plus"] else "." if m["dot"] else str(SPELLED.get(m["digit"].lower(), m["digit"]))
            begin = run.start() + m.start()
            if last.isdecimal() and m[0].isdecimal() and tape.text[at:begin] in (" ", "-"):
                at = begin  # identifiers may hold it, and an address may follow another number
            edits.append((at, run.start() + m.end(), new))
            at, last = run.start() + m.end(), m[0]
    tape.rewrite(edits)


def _ending(m: regex.Match) -> str:
    return regex.split(r"[^A-Za-z0-9-]", m[0])[-1].lower()


def _labelled(m: regex.Match) -> bool:
    """Whether a spoken address of an ending that is not listed has labels for words. "at ... point" is ordinary English."""
    labels = [x for x in DOT_RE.split(m[0][m.end("at") - m.start() :].lower()) if x]
    english = m["at"].strip().lower() == "at" and any(d.strip().lower() == "point" for d in DOT_RE.findall(m["dots"]))
    return not english and labels[-1][:1].isalpha() and len(labels[-1]) > 1 and COMMON.isdisjoint(labels)


def _mails(tape: Tape) -> None:
    edits = []
    for m in DISGUISED.finditer(tape.text):
        spaced = m["at"] != "@" and m["at"].strip() == "@"
        if spaced and (HANDLE.fullmatch(m["at"]) and _ending(m) not in ENDINGS or NUMBER.fullmatch(tape.text, m.end("at"), m.end())):
            continue
        worded = any(c.isalpha() for c in m["at"]) and not any(c in m["at"] for c in "[({<")
        local = regex.split(r"[^a-z0-9]", tape.text[m.start() : m.start("at")].lower())[-1]
        if worded and not BRACKETED.search(m["dots"]) and (local in COMMON or not (SPOKEN_DOT.search(m["dots"]) and (_ending(m) in ENDINGS or _labelled(m)))):
            continue  # an ordinary "at", before an address or among other words
        a, b = m.span("at")
        edits += [(*d.span(), ".") for d in DOT_RE.finditer(tape.text, m.start(), a) if d[0] != "."]
        edits += [(a, b, "@")] * (m["at"] != "@")
        edits += [(*d.span(), ".") for d in DOT_RE.finditer(tape.text, b, m.end()) if d[0] != "."]
    tape.rewrite(edits)


def signs(text: str) -> bool:
    """Whether any transducer may rewrite the text. None looks for less than its sign."""
    if "@" in text or DIGIT.search(text) and MIXED.search(text):
        return True
    lower = text.lower()
    return any(p.search(lower) for p in RUN_SIGNS) or bool(MAIL_SIGN.search(lower))


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows; none that lies within a plain one of its kind."""
    marks = () if text.isascii() else {c for c in set(text) if c > "\u007f" and _lookalike(c) != c}
    if not (marks or signs(text)):
        return []
    tape = Tape(text)
    if marks:
        tape.rewrite([(i, i + 1, _lookalike(c)) for i, c in enumerate(text) if c in marks])
    if MIXED.search(tape.text):
        _letters(tape)
    _digits(tape)
    _mails(tape)
    if tape.text == text:
        return []
    found = []
    for a, b, kind in plain(tape.text):
        start, end = tape.starts[a], tape.ends[b - 1]
        if not any(k == kind and x <= start and end <= y for x, y, k in known):
            found.append((start, end, kind))
    return found


def spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    """(start, stop, kind, added), by start, then kind; offsets in code points, stop exclusive."""
    if not text:
        return []
    known = plain(text)
    found = [(*s, False) for s in known] + [(*s, True) for s in disguised(text, known)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, found: list[tuple[int, int, str, bool]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def searched(docs: DataFrame, text_col: str = "text", name: str = "personal") -> DataFrame:
    """docs with a struct column: spans (array of struct start, stop, kind, added) and masked, the text without them.

    Null text: no spans, null masked. Empty text: no spans. Texts are searched whole. Every other column passes through;
    one of that name is replaced. added tells spans that only the rewritten text showed.
    """

    def found(column):
        texts = column.to_pylist()
        own = [spans(x) for x in texts]
        rows = [[{"start": a, "stop": b, "kind": k, "added": d} for a, b, k, d in f] for f in own]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("added", pa.bool_())]))
        clean = [x if not f else masked(x, f) for x, f in zip(texts, own)]
        return pa.StructArray.from_arrays([pa.array(rows, kind), pa.array(clean, pa.string())], names=["spans", "masked"])

    return base.appended(docs, text_col, name, "struct<spans:array<struct<start:long,stop:long,kind:string,added:boolean>>,masked:string>", found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans, masked, as searched() defines them. Ids may be null or repeat; other columns are ignored."""
    return searched(base.renamed(docs, doc_id=id_col, text=text_col)).select("doc_id", "personal.*")


def joined(column: str, added: bool):
    """kind:start:stop of the spans, comma-joined; with or without the added ones."""
    own = F.col(column) if added else F.filter(column, lambda s: ~s["added"])
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
