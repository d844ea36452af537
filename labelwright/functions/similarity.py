"""String similarity: longest common subsequence ratio, edit distance routing and character differences."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship


BITS = 62


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence. Up to BITS characters of the shorter text a row of the dynamic programme is
    the bits of one number, and each character of the other maps it to the next; longer texts have arrays as rows.
    """
    short, long_ = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    return F.when(F.length(short) <= BITS, _lcs_bits(long_, short)).otherwise(_lcs_arrays(a, b))


def _lcs_bits(a: Column, b: Column) -> Column:
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def length(long_: Column, short: Column) -> Column:
        full = F.call_function("shiftleft", one, F.size(short)) - 1

        def step(row: Column, ch: Column) -> Column:
            hit = row.bitwiseAND(F.aggregate(short, zero, lambda m, x: F.call_function("shiftleft", m, F.lit(1)) + F.when(x == ch, one).otherwise(zero)))
            return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

        return F.size(short) - F.bit_count(F.aggregate(long_, full, step))

    held = F.array(F.struct(letters(a).alias("a"), F.reverse(letters(b)).alias("b")))  # letters are cut once a row
    return F.get(F.transform(held, lambda r: length(r["a"], r["b"])), F.lit(0)).cast("int")


def _lcs_arrays(a: Column, b: Column) -> Column:
    """One row of the programme is an array; each character of a maps the row to the next."""
    left, right = F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.array_repeat(F.lit(0), F.size(right) + 1)

    def step(row: Column, ch: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            same = F.element_at(right, j) == ch
            up, diagonal, before = F.element_at(row, j + 1), F.element_at(row, j), F.element_at(made, -1)
            return F.array_append(made, F.when(same, diagonal + 1).otherwise(F.greatest(up, before)))

        places = F.filter(F.sequence(F.lit(0), F.size(right)), lambda j: j > 0)
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(left, zero, step), -1)


def lcs_length_udf(spark):
    """The same by bit-parallel rows in Python integers: one operation on big integers per character.

    Its attribute `runs` is best_runs() as a function of two columns: words joined by NEXT, and an array of goals in this form.
    """
    ship(spark)

    @F.pandas_udf("int")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs(x, y) for x, y in zip(a, b)], dtype="Int32")

    @F.arrow_udf("array<struct<raw:double,size:int,start:int>>")
    def runs(words: pa.Array, goals: pa.Array) -> pa.Array:
        counts = pc.list_value_length(goals).to_numpy(zero_copy_only=False)
        w, g = words.dictionary_encode(), goals.flatten().dictionary_encode()
        pairs = np.repeat(w.indices.to_numpy().astype(np.int64), counts) * max(1, len(g.dictionary)) + g.indices.to_numpy()
        own, back = np.unique(pairs, return_inverse=True)  # equal texts are scored once a batch
        raw, size, start = best_runs(w.dictionary.to_pylist(), g.dictionary.to_pylist(), *np.divmod(own, max(1, len(g.dictionary))))
        best = pa.StructArray.from_arrays([pa.array(raw), pa.array(size), pa.array(start)], names=["raw", "size", "start"], mask=pa.array(size == 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), best.take(pa.array(back)))

    length.runs = runs
    return length


def _lcs(a: str | None, b: str | None) -> int | None:
    if a is None or b is None:
        return None
    places: dict[str, int] = {}
    for j, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


#: Between words that are handed over as one text; no normalized word has it.
NEXT = "\n"
#: Starts of runs in a stretch of words, goals' signs in a row of bits, pairs and numbers held at once.
STRETCH, SIGNS, PAIRS, TABLE = 64, 64, 1024, 1 << 22


def best_runs(texts: list[str], goals: list[str], t: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw, size, start) of the best run of n - 1 to n + 1 words of each pair (texts[t], goals[g]), n the goal's words; size 0: none.

    Words are joined by NEXT; the first STRETCH words are starts. Equal ratios go to the shorter run, then the earlier start.
    All starts of a block of pairs go through their signs together, and a longer run goes on from the shorter one's row of bits.
    """
    words = lambda x: np.array([y.count(NEXT) + 1 for y in x], np.int64)
    some = lambda x: np.array([y != "" for y in x], bool)
    signs = np.frombuffer("".join(x + NEXT for x in texts).encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(signs == ord(NEXT))
    begins = np.concatenate(([0], ends + 1))
    per, n = words(texts), words(goals) * some(goals)
    first, m = np.cumsum(per) - per, per * some(texts)
    plain = [x.replace(NEXT, " ") for x in goals]
    long_ = np.array([len(x) for x in plain], np.int64)
    letters = sorted(set("".join(plain)))
    known = np.zeros(max([ord(" "), *map(ord, letters), int(signs.max(initial=0))]) + 1, np.int32)
    known[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    code = known[np.where(signs == ord(NEXT), ord(" "), signs)]
    raw, size, start = np.zeros(len(t)), np.zeros(len(t), np.int32), np.zeros(len(t), np.int32)
    starts = np.where(n[g] > 0, np.clip(m[t] - np.maximum(n[g] - 1, 1) + 1, 0, STRETCH), 0)
    order = np.argsort(g, kind="stable")
    order = order[starts[order] > 0]
    step = min(PAIRS, max(1, TABLE // (len(letters) + 1)))
    for a in range(0, len(order), step):
        pairs = order[a : a + step]
        of, pair = np.unique(g[pairs], return_inverse=True)
        here = np.repeat(np.arange(len(pairs)), starts[pairs])
        before = np.cumsum(starts[pairs]) - starts[pairs]
        at = np.arange(len(here)) - before[here]
        word, ask = first[t[pairs]][here] + at, g[pairs][here]
        sizes = n[ask] + np.array([[-1], [0], [1]])
        fits = (sizes >= 1) & (at + sizes <= m[t[pairs]][here])
        lengths = np.where(fits, ends[np.minimum(word + sizes - 1, len(ends) - 1)] - begins[word], -1)
        common = _common(code, begins[word], lengths, [plain[x] for x in of], pair[here], known)
        scores = np.where(fits, 200.0 * common / np.where(fits, lengths + long_[ask], 1), -1.0)
        best = np.maximum.reduceat(scores.max(axis=0), before)
        place = np.where(scores == best[here], sizes * STRETCH + at, np.iinfo(np.int64).max).min(axis=0)
        place = np.minimum.reduceat(place, before)
        raw[pairs], size[pairs], start[pairs] = best, place // STRETCH, place % STRETCH + 1
    return raw, size, start


def _common(code: np.ndarray, at: np.ndarray, lengths: np.ndarray, goals: list[str], goal: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common lengths of goals[goal] and the signs code[at : at + length], for some lengths (-1: none) of each place; 0 where there is none.

    A goal of over SIGNS signs has several numbers as its row; their carries go from one to the next.
    """
    limbs = max(1, -(-max(map(len, goals)) // SIGNS))
    table, full = np.zeros((limbs, len(goals), int(known.max()) + 1), np.uint64), np.zeros((limbs, len(goals)), np.uint64)
    for k, text in enumerate(goals):
        for j, ch in enumerate(text):
            bit = np.uint64(1 << j % SIGNS)
            table[j // SIGNS, k, known[ord(ch)]] |= bit
            full[j // SIGNS, k] |= bit
    turn = np.argsort(-lengths.max(axis=0), kind="stable")  # the longest first, so that those still at work are a head
    at, goal, lengths = at[turn], goal[turn], lengths[:, turn]
    most = lengths.max(axis=0)
    ended = [np.argsort(x, kind="stable") for x in lengths]
    steps = np.arange(int(most[0]) + 2)
    bounds = [np.searchsorted(x[o], steps) for x, o in zip(lengths, ended)]
    alive = np.searchsorted(-most, -steps)
    all_, base, table = full[:, goal], (goal * table.shape[2]).astype(np.int32), table.reshape(limbs, -1)
    rows, zeros = all_.copy(), np.zeros(lengths.shape, np.int64)
    for s in range(int(most[0]) + 1):
        for k, o in enumerate(ended):
            done = o[bounds[k][s] : bounds[k][s + 1]]
            if len(done):
                zeros[k, done] = np.bitwise_count(all_[:, done] & ~rows[:, done]).sum(axis=0)
        n = alive[s]
        if not n:
            break
        cell, carry = base[:n] + code.take(at[:n] + s), None
        for x in range(limbs):
            row = rows[x, :n]
            hit = table[x].take(cell)
            hit &= row
            sum_ = row + hit
            if limbs > 1:
                more = sum_ < row
                if carry is not None:
                    sum_ += carry
                    more |= sum_ < carry
                carry = more.astype(np.uint64)
            row -= hit
            row |= sum_
            row &= all_[x, :n]
    out = np.zeros(lengths.shape, np.int64)
    out[:, turn] = zeros
    return out


def common_lengths(texts: list[str], goals: list[str], goal: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each text with goals[goal]; neither is empty."""
    of, pair = np.unique(goal, return_inverse=True)
    own = [goals[x] for x in of.tolist()]
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in texts], np.int64)
    letters = sorted(set("".join(own)))
    known = np.zeros(max([*map(ord, letters), int(signs.max(initial=0))]) + 1, np.int32)
    known[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    return _common(known[signs], np.cumsum(lengths) - lengths, lengths[None], own, pair, known)[0]


def ratio(common: Column, a: Column, b: Column) -> Column:
    """0 to 100: twice the common length over both; two empty texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / total)


def reaches(common: Column, a: Column, b: Column, threshold: int) -> Column:
    """Whether the ratio is at least the threshold, in integers."""
    return common * 200 >= (F.length(a) + F.length(b)) * threshold


class Goals:
    """Common-subsequence lengths of texts with many goals at once: goals' rows of bits lie side by side in numbers of SIGNS bits.

    A bit between two rows takes up the carry. Goals of SIGNS signs or more are compared one by one.
    """

    def __init__(self, goals: list[str]):
        self.sizes = np.array([len(g) for g in goals], np.int64)
        self.long = [(k, g) for k, g in enumerate(goals) if len(g) >= SIGNS]
        self.limb, self.shift, at = np.zeros(len(goals), np.int64), np.zeros(len(goals), np.uint64), 0
        for k, g in enumerate(goals):
            if 0 < len(g) < SIGNS:
                at = at if at % SIGNS + len(g) <= SIGNS else -(-at // SIGNS) * SIGNS
                self.limb[k], self.shift[k] = at // SIGNS, at % SIGNS
                at += len(g) + 1
        self.mask = np.array([(1 << len(g)) - 1 if len(g) < SIGNS else 0 for g in goals], np.uint64)
        letters = sorted(set("".join(g for g in goals if len(g) < SIGNS)))
        self.known = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        self.known[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.table = np.zeros((len(letters) + 1, -(-at // SIGNS)), np.uint64)
        for k, g in enumerate(goals):
            for j, ch in enumerate(g) if len(g) < SIGNS else ():
                self.table[self.known[ord(ch)], self.limb[k]] |= np.uint64(1) << (self.shift[k] + np.uint64(j))
        self.full = np.bitwise_or.reduce(self.table, axis=0)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each goal."""
        out = np.zeros((len(texts), len(self.sizes)), np.int64)
        step = max(1, (1 << 17) // max(1, len(self.full), len(self.sizes)))
        for a in range(0, len(texts) if len(self.full) else 0, step):
            part = texts[a : a + step]
            signs = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            code = self.known.take(np.minimum(signs, len(self.known) - 1))
            own = np.repeat(np.arange(len(part)), [len(x) for x in part])[code > 0]  # a sign that no goal has changes no row
            code, size = code[code > 0], np.bincount(own, minlength=len(part))
            turn = np.argsort(-size, kind="stable")  # the longest first, so that those still at work are a head
            begins = (np.cumsum(size) - size)[turn]
            alive = np.searchsorted(-size[turn], -np.arange(int(size.max(initial=0))))
            rows = np.repeat(self.full[None], len(part), axis=0)
            for s, n in enumerate(alive.tolist()):
                row = rows[:n]
                hit = self.table.take(code.take(begins[:n] + s), axis=0)
                hit &= row
                sum_ = row + hit
                row -= hit
                row |= sum_
                row &= self.full
            left = np.bitwise_count(rows.take(self.limb, axis=1) >> self.shift & self.mask)
            out[a + turn] = np.where(self.mask > 0, self.sizes - left, 0)
        for k, goal in self.long:
            out[:, k] = [_lcs(x, goal) for x in texts]
        return out


def least_sum(size: int, words: int, threshold: int) -> int:
    """What the gains of a run's words sum to at least, if the run is to score `threshold` to one decimal against `size` characters.

    A run scores so if DEPTH * common >= (20 * threshold - 1) * (its length + size): its rounded score is then at or above. The
    common length is at most the sum of the words' own, and one more for each space between them that the needle also has;
    the length is the words' and the spaces'. So a word's gain is DEPTH * common - (20 * threshold - 1) * its length.
    """
    return (20 * threshold - 1) * (size + words - 1)


DEPTH = 4000


def differences(spark):
    """A pandas UDF: array of (kind, text), kind same, missing (expected only) or added (observed only).

    Alignment ignores case; texts come from the originals. A replacement is its added part, then its missing part.
    """
    ship(spark)

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def diff(observed: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([_diff(x, y) for x, y in zip(observed, expected)])

    return diff


def _diff(observed: str | None, expected: str | None):
    if observed is None or expected is None:
        return None
    fold = lambda text: "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, fold(observed), fold(expected), autojunk=False).get_opcodes():
        if tag == "equal":
            out.append({"kind": "same", "text": observed[a:b]})
            continue
        if b > a:
            out.append({"kind": "added", "text": observed[a:b]})
        if d > c:
            out.append({"kind": "missing", "text": expected[c:d]})
    return out
