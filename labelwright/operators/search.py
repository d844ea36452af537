"""Search of a declared value in observed text: a whole-word run first, then the best window of about as many words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import DEFAULT, Settings
from ..functions.similarity import DEPTH, NEXT, STRETCH, Goals, common_lengths, lcs_length, least_sum, ratio
from ..functions.text import NATIVE, SPACES, Folding, has_words, normalized, normalized_word, printed_words, punctuation, tokens, without_code
from ..functions.verdict import band
from ..session import ship


def units(lines: DataFrame, *keys: str) -> DataFrame:
    """Search units of lines (keys, column, block, line_idx, text): one per region in order of first appearance."""
    own = lines.groupBy(*keys, "column", "block").agg(F.min("line_idx").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return own.where(has_words(F.col("text"))).select(*keys, "column", "block", turn.alias("unit"), "text")


def windows(pairs: DataFrame, *keys: str, folding: Folding = NATIVE) -> DataFrame:
    """(keys, unit, before, size, start, hit, seen, goal): the runs of a unit's words that a needle is compared with.

    pairs: keys, needle, unit, text. Runs have one word less than the needle, as many or one more; lengths below one word
    or beyond the unit's are left out, not cut to fit. A pair without any run has one row, of nulls. Texts are dealt out in
    stretches of STRETCH starts, so that a long one is many tasks' work and no row carries the whole of it.
    """
    split = pairs.withColumn("_text", folding.compose(F.col("text"))).withColumn("_needle", folding.compose(F.col("needle")))
    split = split.withColumn("words", tokens(F.col("_text"), folding.fold)).withColumn("want", tokens(F.col("_needle"), folding.fold))
    goal = F.array_join(F.transform("want", lambda t: t["norm"]), " ").alias("goal")
    size = F.coalesce(F.size("words"), F.lit(0))
    first = F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(STRETCH))).alias("before")
    dealt = split.select(*keys, "unit", goal, F.coalesce(F.size("want"), F.lit(0)).alias("n"), size.alias("m"), "words", first)
    dealt = dealt.select(*keys, "unit", "goal", "n", "m", "before", F.slice("words", F.col("before") + 1, F.col("n") + STRETCH).alias("words"))
    dealt = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "unit", "before")
    return runs(dealt, *keys, "unit", "goal")


def runs(dealt: DataFrame, *keys: str) -> DataFrame:
    """(keys, before, size, start, hit, seen) of stretches (keys, n, m, before, words): all runs of n - 1 to n + 1 words that start in each.

    words: the printed and normalized words from place `before` on, of m in all; enough of them for the longest run.
    """
    sizes = F.filter(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1), lambda s: (s >= 1) & (s <= F.col("m") - F.col("before")) & (F.col("n") > 0))
    last = F.least(F.lit(STRETCH), F.col("m") - F.col("before") - F.col("size") + 1)
    every = dealt.select("*", F.explode_outer(sizes).alias("size")).select("*", F.explode_outer(F.sequence(F.lit(1), last)).alias("at"))
    own = every.withColumn("own", F.slice("words", F.col("at"), F.col("size")))
    joined = lambda part: F.array_join(F.transform("own", lambda t: t[part]), " ")
    return own.select(*keys, "before", "size", (F.col("before") + F.col("at")).alias("start"), joined("printed").alias("hit"), joined("norm").alias("seen"))


def order(strict: bool, *place: str) -> Column:
    """What the best of scored runs is the greatest of: raw, then the earliest place.

    strict: the place that a pass in order would end with if it keeps a best score rounded to one decimal and compares raw
    scores with that. Such a pass takes the first run of the highest rounded score, as its raw score is above all lower
    rounded ones; from then on it takes each run whose raw score is above that rounded one. So the last of those is its
    result, or the first of the highest rounded score where there is none: the greatest of a struct, in any order of rows.
    """
    if not strict:
        return F.struct("raw", *[-F.col(c) for c in place])
    rounded = F.round("raw", 1)
    above = F.col("raw") > rounded
    return F.struct(rounded, above, *[F.when(above, F.col(c)).otherwise(-F.col(c)) for c in place])


def hits(pairs: DataFrame, *keys: str, common=lcs_length, strict: bool = False, folding: Folding = NATIVE) -> DataFrame:
    """(keys, unit, size, start, hit, raw): of each stretch of each pair the best run, as order() has it; nulls where there is none.

    One shuffle: the best of a stretch is chosen where its runs are made.
    """
    every = windows(pairs, *keys, folding=folding)
    scored = every.withColumn("raw", ratio(common(F.col("seen"), F.col("goal")), F.col("seen"), F.col("goal")))
    best = scored.groupBy(*keys, "unit", "before").agg(F.max_by(F.struct("size", "start", "hit", "raw"), order(strict, "unit", "size", "start")).alias("best"))
    return best.select(*keys, "unit", "best.*")


def asked(needles: Column) -> Column:
    """What unit_hits() searches for, of needles, an array of structs (field, needle): each as it is (turn 0), and a class or type
    also without a trailing code (turn 1). An array of structs (field, declared, turn, needle).
    """
    ask = lambda a, turn, c: F.struct(a["field"].alias("field"), a["needle"].alias("declared"), F.lit(turn).alias("turn"), c.alias("needle"))
    turns = F.flatten(F.transform(needles, lambda a: F.array(ask(a, 0, a["needle"]), ask(a, 1, F.when(a["field"] == "class_type", without_code(a["needle"]))))))
    return F.filter(turns, lambda a: (a["turn"] == 0) | a["needle"].isNotNull())


def goals(asks: Column) -> Column:
    """The words of the needles of asked(), each needle's joined by NEXT."""
    return F.transform(asks, lambda a: F.coalesce(F.array_join(F.transform(tokens(a["needle"]), lambda w: w["norm"]), NEXT), F.lit("")))


def in_rows(common, strict: bool, folding: Folding) -> bool:
    """Whether unit_hits() needs a row for each run: for a pass in order, other folding, or a `common` without runs (see lcs_length_udf())."""
    return strict or folding is not NATIVE or not hasattr(common, "runs")


def unit_hits(units: DataFrame, *keys: str, common=lcs_length, strict: bool = False, folding: Folding = NATIVE) -> DataFrame:
    """(keys, field, declared, turn, unit, size, start, hit, raw): of each stretch of units (keys, unit, text, asks, goals) the best run for each of its asks.

    asks and goals: as asked() and goals() make them. The rows of hits(), nulls where there is no run; a unit's words are cut
    once for all asks, and its runs stay in one row, unless they must be rows: see in_rows().
    """
    own = ("field", "declared", "turn")
    if in_rows(common, strict, folding):
        pairs = units.select(*keys, "unit", "text", F.explode("asks").alias("a")).select(*keys, "unit", "text", *[f"a.{c}" for c in own], "a.needle")
        return hits(pairs, *keys, *own, common=common, strict=strict, folding=folding)
    split = units.select(*keys, "unit", "asks", "goals", tokens(F.col("text")).alias("words"))
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.size("words"), F.lit(0)) - 1, F.lit(0)), F.lit(STRETCH))).alias("before")
    most = F.array_max(F.transform("goals", lambda g: F.size(F.split(g, NEXT))))
    dealt = split.select("*", first).withColumn("words", F.slice("words", F.col("before") + 1, most + STRETCH))
    seen = F.coalesce(F.array_join(F.transform("words", lambda w: w["norm"]), NEXT), F.lit(""))
    best = dealt.withColumn("runs", common.runs(seen, F.col("goals")))

    def row(a: Column, i: Column) -> Column:
        run = F.get("runs", i)
        hit = F.when(run.isNotNull(), F.array_join(F.transform(F.slice("words", run["start"], run["size"]), lambda w: w["printed"]), " "))
        return F.struct(*[a[c].alias(c) for c in own], run["size"].alias("size"), (F.col("before") + run["start"]).alias("start"), hit.alias("hit"), run["raw"].alias("raw"))

    each = best.select(*keys, "unit", F.explode(F.transform("asks", row)).alias("r"))
    return each.select(*keys, *[f"r.{c}" for c in own], "unit", *[f"r.{c}" for c in ("size", "start", "hit", "raw")])


def found(pairs: DataFrame, *keys: str, common=lcs_length, strict: bool = False, folding: Folding = NATIVE) -> DataFrame:
    """The hit of each group of pairs (keys, needle, unit, text): text, score to one decimal, unit; no row if no hit.

    A run equal to the needle scores 100, which no other does, so it beats every other, however early. Equal scores go to the
    earlier unit, then the shorter run, then the earlier start; strict: see order().
    """
    best = hits(pairs, *keys, common=common, strict=strict, folding=folding).where("raw IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct("hit", "raw", "unit"), order(strict, "unit", "size", "start")).alias("best"))
    return best.select(*keys, F.col("best.hit").alias("hit"), F.round("best.raw", 1).alias("score"), F.col("best.unit").alias("unit"))


def both_turns(pairs: DataFrame, *keys: str, strip_code: bool | Column = True, text: str = "text") -> DataFrame:
    """pairs (keys, needle, unit, text) with turn 0 for each needle as it is, and 1 for what is left of it without a trailing code.

    `declared` is the needle as it was.
    """
    asks = F.lit(strip_code) if isinstance(strip_code, bool) else strip_code
    ask = lambda turn, c: F.struct(F.lit(turn).alias("turn"), c.alias("needle"))
    turns = F.filter(F.array(ask(0, F.col("needle")), ask(1, F.when(asks, without_code(F.col("needle"))))), lambda t: (t["turn"] == 0) | t["needle"].isNotNull())
    return pairs.select(*keys, "unit", text, F.col("needle").alias("declared"), F.explode(turns).alias("ask")).select(*keys, "unit", text, "declared", "ask.turn", "ask.needle")


def verified(pairs: DataFrame, *keys: str, strip_code: bool | Column = True, settings: Settings = DEFAULT, common=lcs_length, strict: bool = False, folding: Folding = NATIVE) -> DataFrame:
    """Outcome of searching each needle: keys, hit, score, unit, code, outcome.

    A value that does not match is also searched without its trailing code, and that hit is taken if it is better: both are
    searched at once. The rounded score is banded. No hit at all is a mismatch without a score.
    """
    best = hits(both_turns(pairs, *keys, strip_code=strip_code), *keys, "declared", "turn", common=common, strict=strict, folding=folding)
    turn = lambda i: F.max_by(F.when(F.col("raw").isNotNull(), F.struct(F.round("raw", 1).alias("score"), "hit", "unit")), F.when(F.col("turn") == i, order(strict, "unit", "size", "start"))).alias(f"h{i}")
    out = best.groupBy(*keys, "declared").agg(turn(0), turn(1))
    return out.select(*keys, *chosen(F.col("h0"), F.col("h1"), F.col("declared"), settings))


def chosen(plain: Column, shorter: Column, needle: Column, settings: Settings = DEFAULT) -> list[Column]:
    """hit, score, unit, code, outcome of the hits (struct score, hit, unit) of a needle and of what is left without its code."""
    fails = F.coalesce(plain["score"], F.lit(-1.0)) < settings.match_threshold
    better = F.coalesce(fails & (shorter["score"] > F.coalesce(plain["score"], F.lit(-1.0))), F.lit(False))
    pick = lambda c: F.when(better, shorter[c]).otherwise(plain[c])
    outcome = F.when(pick("score").isNull(), "mismatch").otherwise(band(pick("score"), settings))
    code = F.when(better, F.regexp_extract(needle, r"([A-Z0-9]{1,3})\s*$", 1))
    return [pick("hit").alias("hit"), pick("score").alias("score"), pick("unit").alias("unit"), code.alias("code"), outcome.alias("outcome")]


#: Needles of a pass; numbers of a table of gains that a task holds before it begins a new one; words of texts searched at once.
GOALS, GAINS, WORDS = 4096, 1 << 24, 1 << 16
#: Printed words that a task knows at once, and characters of a text that are cut into words at once.
KNOWN, PIECE = 1 << 17, 1 << 20


class Gains(dict):
    """The index of words: numbers of printed words, equal where their normalized forms are, and the gains of these against goals (text, words).

    Number 0 is of words that normalize to nothing, WALL stands between texts and for words that are too long for any goal, and is in no run. In a run that scores
    `threshold` or more the gains that least_sum() speaks of have a least sum, and some word has at least the average of it:
    `goal` and `size` are those of the runs for which a word does, in `count` entries of a word from `first` on.
    """

    WALL = 1

    def __init__(self, goals: list[tuple[str, int]], threshold: int, signs: dict[int, str]):
        self.own, self.threshold, self.signs = Goals([text for text, _ in goals]), threshold, signs
        self.counts = np.array([[n + d for d in (-1, 0, 1)] for _, n in goals], np.int64)
        self.least = np.array([[_least(len(text), n, n + d, threshold) for d in (-1, 0, 1)] for text, n in goals], np.int64)
        self.longest = max(DEPTH * len(text) // (20 * threshold - 1) - len(text) for text, _ in goals)  # the goal's whole length in common
        self.needs = -(-self.least // np.maximum(self.counts, 1))
        self.texts, self.numbers = ["", None], {"": 0}
        wide = max(len(text) for text, _ in goals) >= 1 << 14
        self.gain = np.full((2, len(goals)), -1 << (50 if wide else 30), np.int64 if wide else np.int32)
        self.first, self.count = np.zeros(2, np.int64), np.zeros(2, np.int64)
        self.goal, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        norm = normalized_word(word, self.signs)
        if len(norm) > self.longest:
            return self.WALL
        number = self[word] = self.numbers.setdefault(norm, len(self.texts))
        if number == len(self.texts):
            self.texts.append(norm)
        return number

    def full(self, most: int, known: int) -> bool:
        return len(self.texts) * len(self.counts) > most or len(self) > known

    def learn(self) -> None:
        """Gains of the words that are new since the last call; every word is compared with all goals at once."""
        step = max(1, (1 << 21) // len(self.counts))
        if len(self.gain) < len(self.texts):
            self.gain = np.concatenate((self.gain, np.zeros((len(self.texts), len(self.counts)), self.gain.dtype)))
        while (done := len(self.first)) < len(self.texts):
            new = self.texts[done : done + step]
            gain = DEPTH * self.own.lengths(new) - (20 * self.threshold - 1) * np.array([[len(t)] for t in new])
            w, g = np.nonzero(gain >= self.needs.min(axis=1))
            x, d = np.nonzero(gain[w, g][:, None] >= self.needs[g])
            count = np.bincount(w[x], minlength=len(new))
            self.first = np.concatenate((self.first, len(self.goal) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.goal, self.size = np.concatenate((self.goal, g[x])), np.concatenate((self.size, self.counts[g[x], d]))
            self.gain[done : done + len(new)] = gain

    def runs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, goal), each once, of the runs of words (numbers) whose gains sum to what the goal asks for at least."""
        self.learn()
        count = self.count[words]
        place = np.repeat(np.arange(len(words)), count)
        entry = np.arange(len(place)) + np.repeat(self.first[words] - (np.cumsum(count) - count), count)
        goal, size = self.goal[entry], self.size[entry]
        goals, flat, made = len(self.counts), self.gain.ravel(), [np.zeros((3, 0), np.int64)]
        for s in np.unique(size).tolist():
            walled = np.pad(words.astype(np.int64), s, constant_values=self.WALL) * goals
            here, step = np.flatnonzero(size == s), max(1, (1 << 20) // s)
            for a in range(0, len(here), step):
                p, g = place[here[a : a + step]], goal[here[a : a + step]]
                total = np.zeros((2 * s, len(p)), np.int64)
                for d in range(2 * s - 1):
                    total[d + 1] = total[d] + flat.take(walled.take(p + d + 1) + g)
                k, x = np.nonzero(total[s:] - total[:s] >= self.least[g, s - self.counts[g, 0]])
                made.append(np.stack((p[x] - s + 1 + k, np.full(len(x), s), g[x])))
        start, size, goal = np.concatenate(made, axis=1)
        high = int(size.max(initial=0)) + 1
        start, own = np.divmod(np.unique((start * high + size) * goals + goal), high * goals)
        return start, *np.divmod(own, goals)


def _least(size: int, n: int, words: int, threshold: int) -> int:
    """The least sum of a run's gains; more than any where the run has no word."""
    return least_sum(size, words, threshold) - DEPTH * min(words - 1, n - 1) if words >= 1 else 1 << 60


def reaching(needles: DataFrame, texts: DataFrame, text_id: str, threshold: int = DEFAULT.review_threshold, common=lcs_length) -> DataFrame:
    """(needle, text_id, hit, score): for each distinct normalized needle and each text the best run, where its score is at least `threshold`.

    needles: needle; texts: text_id, text. The rows are those of found() over all pairs of the two whose score is as high, with
    its rules for ties; no pair is made to get them. Texts' distinct words are compared with the needles, GOALS of them at a
    time, and form an index (Gains): of a run that reaches the threshold one word has its share of the run's common subsequence.
    Where such a word occurs, and only there, the runs around it whose words together have enough of it are scored. Texts are
    cut and searched where they are read. Needles or texts without words, and nulls, have no row.
    """
    goal = F.array_join(F.transform(tokens(F.col("needle")), lambda t: t["norm"]), " ")
    asked = needles.select("needle").distinct().select(goal.alias("needle"))  # distinct() or a filter after this would have every row of needles normalized
    texts = spread(texts.select(text_id, "text"))
    blocks = max(1, -(-asked.count() // GOALS))
    found = None
    for block in range(blocks):  # a pass over the texts for so many needles; nearly always one
        of_block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block)
        held = [(text, text.count(" ") + 1) for text in sorted({r.needle for r in of_block.collect() if r.needle})]
        part = _reaching(held, texts, text_id, threshold, common)
        found = part if found is None else found.unionByName(part)
    return found


def candidates(held: list, texts: DataFrame, text_id: str, threshold: int) -> DataFrame:
    """(needle, text_id, size, start, hit, seen): the runs that reaching() scores, which reach the threshold by common_lengths(); one that two pieces of a text have may come twice.

    held: needles' texts and numbers of words. A task cuts its texts into words, in pieces, and looks for runs in WORDS of them
    at once; a piece begins with the last words of the one before it that a run around its first word may start with.
    """
    ship(texts.sparkSession)
    types = {f.name: f.dataType for f in texts.schema}
    schema = StructType([StructField("needle", StringType()), StructField(text_id, types[text_id]), *[StructField(c, IntegerType()) for c in ("size", "start")], *[StructField(c, StringType()) for c in ("hit", "seen")]])
    goals, lengths = [text for text, _ in held], np.array([len(text) for text, _ in held], np.int64)
    signs = punctuation(texts.sparkSession)
    limit, most = GAINS, max((n for _, n in held), default=0)

    def run(batches):
        index = Gains(held, threshold, signs) if held else None

        def searched(ids, rows, begins, offsets, words, printed):
            numbers = np.concatenate(words)
            start, size, goal = index.runs(numbers)
            numbers = [index.texts[x] for x in numbers.tolist()]
            seen = [" ".join(numbers[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())]
            if seen:
                reach = DEPTH * common_lengths(seen, goals, goal) >= (20 * threshold - 1) * (np.array([len(x) for x in seen]) + lengths[goal])
                start, size, goal, seen = start[reach], size[reach], goal[reach], [x for x, ok in zip(seen, reach.tolist()) if ok]
            text = np.searchsorted(begins, start, "right") - 1
            columns = [
                pa.array([goals[g] for g in goal.tolist()], pa.string()), ids.take(pa.array(np.array(rows, np.int64)[text])),
                pa.array(size.astype(np.int32)), pa.array((start - np.array(begins)[text] + np.array(offsets)[text] + 1).astype(np.int32)),
                pa.array([" ".join(printed[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())], pa.string()), pa.array(seen, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches if held else ():
            ids, block, size = batch.column(0), ([], [], [], [], []), 0
            for row, text in enumerate(batch.column(1)):
                offset, words, printed = 0, np.zeros(0, np.int64), []
                for piece in pieces(text.as_py(), PIECE):
                    kept = max(0, len(words) - most)
                    offset, words, printed = offset + kept, words[kept:], printed[kept:]
                    numbers = np.fromiter(map(index.__getitem__, piece), np.int64, len(piece))
                    if not numbers.all():
                        some = np.flatnonzero(numbers)
                        numbers, piece = numbers[some], [piece[x] for x in some.tolist()]
                    words, printed = np.concatenate((words, numbers)), printed + piece
                    rows, begins, offsets, held_words, held_printed = block
                    rows.append(row), begins.append(size), offsets.append(offset)
                    held_words += [words, [Gains.WALL]]
                    held_printed += printed
                    held_printed.append("")
                    size += len(words) + 1
                    if size >= WORDS:
                        yield searched(ids, *block)
                        block, size = ([], [], [], [], []), 0
                        if index.full(limit, KNOWN):
                            index = Gains(held, threshold, signs)
                            words = np.fromiter(map(index.__getitem__, printed), np.int64, len(printed))
            if size:
                yield searched(ids, *block)

    return texts.select(text_id, "text").mapInArrow(run, schema)


def pieces(text: str | None, most: int):
    """Lists of the words of a text, of at least `most` characters and what is left of the last word; the last one as it is."""
    at = 0
    while text is not None and at < len(text):
        gap = SPACES.search(text, at + most)
        end = gap.start() if gap else len(text)
        yield printed_words(text[at:end] if at or gap else text)
        at = end


def spread(table: DataFrame) -> DataFrame:
    """table in as many partitions as a shuffle has, where a small input came in fewer; a large one stays where it is."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(parts) if table.rdd.getNumPartitions() < parts else table


def _reaching(held: list, texts: DataFrame, text_id: str, threshold: int, common) -> DataFrame:
    rows = candidates(held, texts, text_id, threshold)
    scored = rows.withColumn("raw", ratio(common(F.col("seen"), F.col("needle")), F.col("seen"), F.col("needle"))).where(F.round("raw", 1) >= threshold)
    best = scored.groupBy("needle", text_id).agg(F.max_by(F.struct("hit", "raw"), order(False, "size", "start")).alias("best"))
    return best.select("needle", text_id, F.col("best.hit").alias("hit"), F.round("best.raw", 1).alias("score"))


RUN = 5


def contained(needles: DataFrame, texts: DataFrame, needle_id: str, text_id: str) -> DataFrame:
    """Distinct (needle_id, text_id) of needles (needle_id, text) that are whole-word runs of texts (text_id, text).

    A needle's key is the hash of its first RUN words, or of all where they are fewer. Texts give (id, hash) rows of the
    runs of the lengths that needles have, never the text; those that meet a key are few, and are joined with their texts
    again and compared. Needles without words are in nothing.
    """
    words = F.split(normalized(F.col("text")), " +")  # no text: one word that is empty
    own = needles.select(needle_id, words.alias("w")).where("w[0] <> ''")
    own = own.select(needle_id, F.array_join("w", " ").alias("want"), F.least(F.size("w"), F.lit(RUN)).alias("n"), F.xxhash64(F.array_join(F.slice("w", 1, RUN), " ")).alias("h"))
    lengths = sorted(r.n for r in own.select("n").distinct().collect())  # RUN numbers at most
    hay = texts.select(text_id, words.alias("w")).select(text_id, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH))).alias("before")) if lengths else None
    if hay is None:
        return needles.select(needle_id).join(texts.select(text_id), F.lit(False))
    hay = hay.select(text_id, (F.size("w") - F.col("before")).alias("left"), F.slice("w", F.col("before") + 1, STRETCH + RUN - 1).alias("w"))
    hay = hay.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n")).withColumn("last", F.least(F.lit(STRETCH), F.col("left") - F.col("n") + 1)).where("last > 0")
    hay = hay.select(text_id, "w", "n", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("at")).select(text_id, F.xxhash64(F.array_join(F.slice("w", F.col("at"), F.col("n")), " ")).alias("h"))
    pairs = hay.join(own.select("h").distinct(), "h", "left_semi").distinct().join(own, "h").select(needle_id, text_id, "want").distinct()
    both = pairs.join(texts.select(text_id, "text"), text_id)
    have = F.concat(F.lit(" "), normalized(F.col("text")), F.lit(" "))
    return both.where(F.contains(have, F.concat(F.lit(" "), "want", F.lit(" ")))).select(needle_id, text_id).distinct()
