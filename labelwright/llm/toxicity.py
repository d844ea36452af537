"""Toxicity by a weighted finite-state pattern grammar.

Terminals are insults, threats, targets, futures, negations, reported speech, and the marks that open or close a quotation or
a clause. Each component is a transducer: an arc reads a symbol, writes one and has a weight. Each reads what the one
before it writes; they are composed lazily, joint states being built as they are met, and weights multiply along the arcs.
The first reads from right to left, as a quotation's report may follow it; the others read from left to right. What they write
in place of an insult or a threat is scored: an insult more with a target in its clause, less in the scope of a negation
or of reported speech; a threat by its future and its target. A document's score is a logistic function of the sums.

Fixed lists name the terminals. Insults are also learned: prefixes of words that labelled toxic rows share and others
lack, chosen greedily until each toxic row is covered `COVER` times, with log-odds as weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

TRAINING_ROWS, LONGEST, COVER, LEAST_ROWS, LEAST_ODDS, MOST_TERMS = 8000, 1 << 15, 4, 4, 3.0, 400
TRAINING_BYTES = 64 << 20
PREFIXES = range(3, 11)
CUT = 0.3

#: Terminals of English, German, French and Spanish.
INSULTS = "idiot moron imbecile scumbag bastard asshole dickhead retard bitch dumbass arschloch vollidiot wichser connard salope imbécile gilipollas cabrón pendejo".split()
INSULT_ENDINGS = ["", *"s es e en n in innen ic".split()]
THREATS = "kill murder stab strangle shoot töten umbringen erschlagen tuer égorger matar degollar".split()
VOCATIVES = "you du ihr tu vous usted ustedes tú".split()
TARGETS = "your yourself he she they them dich dir euch toi vas ti te".split()
FUTURES = "will gonna shall going werde werden wird vais voy va".split()
NEGATIONS = "not never no nobody none neither nor without cannot nicht kein keine keiner nie niemand weder ohne pas jamais personne sans nunca nadie tampoco sin ni".split()
CONTRASTS = "but however though aber sondern doch mais pero sino".split()
REPORTS = "say said says wrote claimed call called calls quoted reported told shouted replied sagte sagt rief schrieb dit déclare écrit dijo escribió".split()

(INSULT, THREAT, VOCATIVE, TARGET, FUTURE, NEGATION, CONTRAST, REPORT, COMMA, OPEN, CLOSE, BREAK, OTHER) = range(13)
#: What components write in place of an insult or a threat.
NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT = range(13, 17)
NEGATED, REPORTED = {INSULT: NOT_INSULT, THREAT: NOT_THREAT}, {INSULT: SAID_INSULT, THREAT: SAID_THREAT}
WORD = regex.compile(r"\p{L}[\p{L}\p{M}']*")
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}']*|[\"“”„«»]|[.!?;]+(?=[\s\"“”«»]|$)|,")
AHEAD = 4


def attribution(s: int, t: int) -> tuple[int, int, float]:
    """From right to left: a quotation is reported if a report follows it within AHEAD words.

    States: words that a report still reaches; -1 in a reported quotation, -2 in another.
    """
    if s < 0:
        return (0 if t == OPEN else s), (REPORTED.get(t, t) if s == -1 else t), 1.0
    if t == CLOSE:
        return (-1 if s else -2), t, 1.0
    return (AHEAD if t == REPORT else 0 if t == BREAK else max(s - 1, 0)), t, 1.0


def report(s: int, t: int) -> tuple[int, int, float]:
    """A report holds to the end of its clause, or of the quotation that it opens. States: 1 in a clause, 2 in a quotation."""
    if t == CLOSE or (t == BREAK and s == 1):
        return 0, t, 1.0
    if s == 0:
        return int(t == REPORT), t, 1.0
    return (2 if t == OPEN else s), REPORTED.get(t, t), 1.0


def negation(s: int, t: int) -> tuple[int, int, float]:
    """A negation holds to a contrast or the clause's end, but for "no, ..." and an insult right after a "you".

    States: 1 in its scope, 2 right after it, 3 right after a vocative in its scope.
    """
    if t == NEGATION:
        return 2, t, 1.0
    if s == 0 or t in (CONTRAST, OPEN, CLOSE, BREAK) or (t == COMMA and s == 2):
        return 0, t, 1.0
    if s == 3 and t in NEGATED:
        return 0, t, 1.0
    return (3 if t == VOCATIVE else 1), NEGATED.get(t, t), 1.0


def announcement(s: int, t: int) -> tuple[int, int, float]:
    """A threat weighs more within AHEAD words after a future. States: the words that are left."""
    if t == THREAT:
        return max(s - 1, 0), t, 2.0 if s else 0.5
    return (AHEAD if t == FUTURE else 0 if t == BREAK else max(s - 1, 0)), t, 1.0


def repetition(s: int, t: int) -> tuple[int, int, float]:
    """A clause's second insult weighs a quarter more, later ones half. States: offences so far, 2 at most."""
    if t in (INSULT, THREAT):
        return min(s + 1, 2), t, 1 + 0.25 * s if t == INSULT else 1.0
    return (0 if t == BREAK else s), t, 1.0


def target(s: int, t: int) -> tuple[int, int, float]:
    """State 1: the clause has a target, before or after its offence; its final weight is the clause's aim."""
    return (0 if t == BREAK else 1 if t in (TARGET, VOCATIVE) else s), t, 1.0


BACKWARD, FORWARD = (attribution,), (report, negation, announcement, repetition, target)


class Composed:
    """Lazy composition of transducers: arcs of joint states, made when first met; there are few."""

    def __init__(self, components):
        self.components, self.arcs = components, {}
        self.start = (0,) * len(components)

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int, float]:
        if (found := self.arcs.get((state, symbol))) is None:
            out, total, then = symbol, 1.0, []
            for component, s in zip(self.components, state):
                s, out, weight = component(s, out)
                total *= weight
                then.append(s)
            found = self.arcs[state, symbol] = tuple(then), out, total
        return found


def forms(verb: str) -> list[str]:
    """A verb and its regular English forms; those that are no words match nothing."""
    stem = verb.removesuffix("e")
    return [verb, f"{verb}s", *(f"{stem}{twice}{e}" for twice in ("", stem[-1]) for e in ("ed", "ing"))]


FEATURES = ("plain", "plain_most", "aimed", "negated", "reported", "threat")


class Grammar:
    """The composed transducers over a lexicon: insults as prefixes of words, with weights, and the fixed lists."""

    MOST_WORDS = 50_000

    def __init__(self, insults: dict[str, float]):
        self.weights, self.backward, self.forward = insults, Composed(BACKWARD), Composed(FORWARD)
        named = ((VOCATIVE, VOCATIVES), (TARGET, TARGETS), (FUTURE, FUTURES), (NEGATION, NEGATIONS), (CONTRAST, CONTRASTS), (REPORT, REPORTS))
        self.fixed = {w: (kind, 1.0) for kind, ws in named for w in ws}
        self.fixed |= {w: (THREAT, 1.0) for verb in THREATS for w in forms(verb)}
        self.fixed |= {w + e: (INSULT, 3.0) for w in INSULTS for e in INSULT_ENDINGS}
        self.seen: dict[str, tuple[int, float]] = {}
        self.finder = ahocorasick.Automaton()
        for w in (*insults, *INSULTS, *(v.removesuffix("e") for v in THREATS)):
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def terminal(self, word: str) -> tuple[int, float]:
        """A word's terminal and weight; the words met last are kept."""
        if (found := self.seen.get(word)) is None:
            own = word.rstrip("'").removesuffix("'s")
            most = max((self.weights[p] for n in range(2, len(own) + 1) if (p := own[:n]) in self.weights), default=None)
            short = NEGATION if own.endswith("n't") else FUTURE if own.endswith("'ll") else OTHER
            found = (INSULT, most) if most is not None else self.fixed.get(own, (short, 1.0))
            if len(self.seen) >= self.MOST_WORDS:
                self.seen.clear()
            self.seen[word] = found
        return found

    def symbols(self, line: str) -> tuple[bytearray, dict[int, float]]:
        """A line's symbols, one byte each, and the weights of its insults by place."""
        out, weights = bytearray(), {}
        for m in TOKEN.finditer(line):
            token = m[0]
            first = token[0]
            if first in '"“”„«»':
                before, after = line[m.start() - 1 : m.start()] if m.start() else " ", line[m.end() : m.end() + 1] or " "
                if after.isspace():  # set off by spaces on both sides, the mark itself tells
                    out.append(OPEN if before.isspace() and first == "«" else CLOSE)
                else:
                    out.append(OPEN if before.isspace() or before in "([:,-—" else CLOSE)
            elif first in ".!?;":
                out.append(BREAK)
            elif first == ",":
                out.append(COMMA)
            else:
                kind, weight = self.terminal(token)
                if kind == INSULT:
                    weights[len(out)] = weight
                out.append(kind)
        out.append(BREAK)
        return out, weights

    def clauses(self, line: str) -> Iterator[list[float]]:
        """FEATURES' weights of each clause of a line, plain_most as plain."""
        symbols, weights = self.symbols(line)
        if CLOSE in symbols:  # else it writes what it reads
            state = self.backward.start
            for i in range(len(symbols) - 1, -1, -1):
                state, symbols[i], _ = self.backward.step(state, symbols[i])
        state, sums = self.forward.start, [0.0] * (SAID_THREAT + 1)
        for i, symbol in enumerate(symbols):
            if symbol == BREAK:
                plain, aimed = sums[INSULT], state[-1]
                yield [plain, plain, plain * aimed, sums[NOT_INSULT], sums[SAID_INSULT], sums[THREAT] * (1 + aimed)]
                sums = [0.0] * len(sums)
            state, out, weight = self.forward.step(state, symbol)
            sums[out] += weight * weights.get(i, 1.0)

    def features(self, text: str | None) -> np.ndarray | None:
        """Sums over the lines in which an insult or a threat begins a word; None if there is none."""
        if not text:
            return None
        low = text.lower().replace("’", "'")
        sums, done = None, -1
        for end, n in self.finder.iter(low):
            a = end - n + 1
            if a < done or (a and low[a - 1].isalpha()):
                continue
            done = low.find("\n", a) + 1 or len(low) + 1
            sums = np.zeros(len(FEATURES)) if sums is None else sums
            for clause in self.clauses(low[low.rfind("\n", 0, a) + 1 : done]):
                most = max(sums[1], clause[1])
                sums += clause
                sums[1] = most
        return None if sums is None else np.log1p(sums)


def learned(toxic: list[set[str]], other: list[set[str]]) -> dict[str, float]:
    """Prefixes with weights: log-odds of the rows that have a word with the prefix."""
    prefixes = lambda ws: {w[:n] for w in ws for n in PREFIXES if len(w) >= n}
    own = [prefixes(ws) for ws in toxic]
    rows = Counter(p for ps in own for p in ps)
    often = {p for p, n in rows.items() if n >= max(LEAST_ROWS, 0.004 * len(toxic))}
    against = Counter(p for ws in other for p in prefixes(ws) & often)
    odds = {p: math.log((rows[p] + 0.5) / (len(toxic) + 1)) - math.log((against[p] + 0.5) / (len(other) + 1)) for p in often}
    odds = {p: x for p, x in odds.items() if x >= LEAST_ODDS}
    where: dict[str, list[int]] = {p: [] for p in odds}
    for i, ps in enumerate(own):
        for p in ps & odds.keys():
            where[p].append(i)
    need, out = [COVER] * len(toxic), {}
    gains = {p: len(w) for p, w in where.items()}
    while gains and len(out) < MOST_TERMS:
        best = max(gains, key=lambda p: (gains[p] - 3 * against[p], len(p), p))
        now = sum(need[i] > 0 for i in where[best])
        if now < gains[best]:
            gains[best] = now
            if now < max(LEAST_ROWS, 0.01 * len(toxic)):
                del gains[best]
            continue
        if gains[best] < max(LEAST_ROWS, 0.01 * len(toxic)):
            break
        out[best] = odds[best]
        del gains[best]
        for i in where[best]:
            need[i] -= need[i] > 0
        gains = {p: g for p, g in gains.items() if not p.startswith(best) and not (best.startswith(p) and rows[p] <= 1.2 * rows[best])}
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps: bias and weights."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def least(rows: DataFrame, key, most: int) -> DataFrame:
    """The rows of the `most` least values of a 64-bit key, without repeated rows. Only keys are sorted, never texts."""
    keyed = rows.withColumn("_h", key)
    last = keyed.select("_h").distinct().orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    return keyed.where(F.col("_h") <= (last if last is not None else 0)).distinct()


def sampled(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """2 * rows of the labels (doc_id, toxic), those of the least hash of the id: enough for trained(), before any join."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    return least(known, F.xxhash64("doc_id"), 2 * rows).drop("_h")


def trained(labelled: DataFrame, rows: int = TRAINING_ROWS, size: int = TRAINING_BYTES) -> tuple[dict[str, float], list[float]]:
    """(insult lexicon, bias and weights) of labelled rows (doc_id, text, toxic 0 or 1).

    Learns from `rows` rows at most, those of the least hash, up to `size` bytes of text, and of equal texts from one; texts
    over LONGEST characters are not sampled. Null texts and labels are left out. With labels of one value only, the fixed
    lists and weights hold.
    """
    usable = labelled.where(F.col("toxic").isNotNull() & F.length("text").between(1, LONGEST)).select("doc_id", "text", "toxic")
    some = least(usable, F.xxhash64("doc_id", "text"), rows)
    before = F.sum(F.octet_length("text")).over(Window.orderBy("_h", "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, 0))  # of `rows` rows
    chosen = some.withColumn("_size", before).where(F.col("_size") <= size).select("doc_id", "text", "toxic")
    sample = {r.text: int(r.toxic) for r in sorted(chosen.collect())}
    y = np.array(list(sample.values()), float)
    if not 0 < y.sum() < len(y):
        return {}, [-4.0, 1.0, 1.0, 1.0, 0.2, 0.2, 1.0]
    words = [set(WORD.findall(t.lower())) for t in sample]
    lexicon = learned([w for w, v in zip(words, y) if v], [w for w, v in zip(words, y) if not v])
    grammar = Grammar(lexicon)
    zero = np.zeros(len(FEATURES))
    x = np.array([zero if (f := grammar.features(t)) is None else f for t in sample])
    return lexicon, fitted(x, y)


def scored(docs: DataFrame, model: tuple[dict[str, float], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from CUT), and the FEATURES of its clauses.

    Null or empty text, and text without terminals: the score of no match. Whole texts are read. Ids may be null or
    repeat; other columns are ignored.
    """
    lexicon, weights = model
    made: list[Grammar] = []

    def run(batch):
        if not made:
            made.append(Grammar(lexicon))
        zero = np.zeros(len(FEATURES))
        x = np.array([zero if (f := made[0].features(t)) is None else f for t in batch.column(1).to_pylist()])
        score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32)), *map(pa.array, np.ascontiguousarray(x.T))], names=["doc_id", "score", "predicted", *FEATURES])

    own = base.renamed(docs, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    return base.mapped(own, run, f"doc_id {kind}, score double, predicted int, " + ", ".join(f"{f} double" for f in FEATURES))
