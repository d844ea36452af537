"""The search: its index against all pairs, the pass in order against a loop, and how often inputs are shuffled."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelwright.functions.similarity import Goals, _lcs
from labelwright.functions.text import normalized_word, printed_words, punctuation, tokens
from labelwright.operators import item, search
from labelwright.plans import catalog, searches  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_common_lengths_of_many_texts_at_once():
    rng = random.Random(2)
    some = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "a" * 200, "ab" * 90]
    got = Goals(some).lengths(some + ["zz"])
    assert got.tolist() == [[_lcs(a, b) for b in some] for a in some + ["zz"]]


def damaged(rng, text):
    signs = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(signs) + 1)
        signs[at : at + rng.randrange(2)] = rng.choice(["", "x", " ", "e"])
    return "".join(signs)


@pytest.mark.parametrize("threshold", [80, 95, 60])
def test_index_gives_what_all_pairs_give(spark, monkeypatch, threshold):
    rng = random.Random(threshold)
    words = "the old oak barrel red bolt small ring a of company gear".split()
    needles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(25)] + ["Red Bolt", "red  bolt!", "--", None, ""]
    texts = [(k, " ".join(damaged(rng, rng.choice([w for w in needles if w])) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(90)))) for k in range(30)] + [(90, None), (91, "- -"), (92, "theold oakbarrel"), (93, "red"), (94, "The, RED. bolt ")]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string").withColumn("goal", F.lit(1)), spark.createDataFrame(texts, "doc_id long, text string").withColumn("size", F.lit(1))
    asked = n.selectExpr("lower(trim(regexp_replace(regexp_replace(needle, '[^a-zA-Z]+', ' '), ' +', ' '))) AS needle").where("needle <> ''").distinct()
    pairs = asked.withColumn("unit", F.lit(0)).join(t.select("doc_id", "text"), F.lit(True)).withColumn("asked", F.col("needle"))
    want = {(r.asked, r.doc_id, r.hit, r.score) for r in search.found(pairs, "asked", "doc_id").where(f"score >= {threshold}").collect()}
    for goals, held in ((4096, 1 << 21), (7, 0)):  # in several passes, and without a broadcast
        monkeypatch.setattr(search, "GOALS", goals)
        monkeypatch.setattr(search, "GAINS", held)
        assert {tuple(r) for r in search.reaching(n, t, "doc_id", threshold).collect()} == want
    assert want


def test_index_leaves_out_most_runs(spark):
    made = []
    whole = search.candidates
    search.candidates = lambda *a: made.append(whole(*a)) or made[-1]
    try:
        rows = catalog.queries()["search_names_in_documents"](spark, SF).count()
    finally:
        search.candidates = whole
    words = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(size(split(text, ' ')))").first()[0]
    needles = spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().count()
    assert 0 < rows < made[0].count() < 0.05 * 3 * words * needles


@pytest.mark.parametrize("piece, words, known", [(1, 1, 0), (40, 30, 20), (1 << 20, 1 << 16, 1 << 19)])
def test_index_in_pieces_of_texts(spark, monkeypatch, piece, words, known):
    rng = random.Random(piece)
    some = "the old oak barrel red bolt small ring a of company gear - \u2019 B\u00f6lt".split()
    needles = ["old oak barrel", "red bolt", "ring", "small ring of the old company"]
    texts = [(k, " ".join(damaged(rng, rng.choice(needles)) if rng.random() < 0.3 else rng.choice(some) for _ in range(60))) for k in range(12)]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "doc_id long, text string")
    pairs = n.join(t, F.lit(True)).select("needle", "doc_id", F.lit(0).alias("unit"), "text", F.col("needle").alias("asked"))
    want = {(r.asked, r.doc_id, r.hit, r.score) for r in search.found(pairs, "asked", "doc_id").where("score >= 80").collect()}
    for name, value in (("PIECE", piece), ("WORDS", words), ("KNOWN", known)):
        monkeypatch.setattr(search, name, value)
    assert {tuple(r) for r in search.reaching(n, t, "doc_id").collect()} == want
    assert len(want) > 12


def test_search_makes_no_row_of_a_word(spark):
    plan = catalog.queries()["search_names_in_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_words_in_python_are_the_native_ones(spark):
    signs = [chr(x) for x in (*range(1, 0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(x)) not in ("Cn", "Co")]
    texts = [" ".join(w for ch in signs[a : a + 500] for w in (f"A{ch}B{ch}{ch}c", ch, f"{ch}D\u03a3", f"x{ch}")) for a in range(0, len(signs), 500)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", "text", tokens(F.col("text")).alias("t")).collect()
    known = punctuation(spark)
    for r in got:
        assert [(t.printed, t.norm) for t in r.t] == [(w, n) for w in printed_words(r.text) if (n := normalized_word(w, known))]


def in_order(runs):
    best = None
    for hit, raw in runs:
        if best is None or raw > best[1]:
            best = (hit, float(f"{raw + 1e-9:.1f}"))
    return best


def test_pass_in_order(spark):
    rng = random.Random(4)
    pairs, want = [], {}
    for k in range(60):
        needle = " ".join(rng.choice(["blue", "bolt", "ring", "hot"]) for _ in range(rng.randrange(1, 4)))
        units = [" ".join(rng.choice(["bluc", "blve", "bolt", "bott", "rin", "r1ng", "hot", "x"]) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 9))) for _ in range(3)]
        n, runs = len(needle.split()), []
        for u, text in enumerate(units):
            pairs.append((k, needle, u, text))
            words = text.split()
            for size in range(n - 1, n + 2):
                if 1 <= size <= len(words):
                    for at in range(len(words) - size + 1):
                        seen = " ".join(words[at : at + size])
                        runs.append((seen, 200 * _lcs(seen, needle) / (len(seen) + len(needle))))
        if runs:
            want[k] = in_order(runs)
    df = spark.createDataFrame(pairs, "id int, needle string, unit int, text string").repartition(7)
    assert {r.id: (r.hit, r.score) for r in search.found(df, "id", strict=True).collect()} == want
    plain = {r.id: (r.hit, r.score) for r in search.found(df, "id").collect()}
    assert plain != want and plain.keys() == want.keys()


def test_units_shorter_than_the_needle(spark):
    rows = [(1, "the old oak barrel", 0, "theold oakbarrel"), (2, "the old oak barrel", 0, "theold oak barrel"), (3, "oak", 0, " . "), (4, "oak", 0, None), (5, "oak barrel", 0, "oak")]
    got = {r.id: (r.hit, r.score, r.outcome) for r in search.verified(spark.createDataFrame(rows, "id int, needle string, unit int, text string"), "id").collect()}
    assert got == {1: (None, None, "mismatch"), 2: ("theold oak barrel", 97.1, "match"), 3: (None, None, "mismatch"), 4: (None, None, "mismatch"), 5: ("oak", 46.2, "mismatch")}


def test_items_are_shuffled_once(spark):
    plan = catalog.queries()["item_verdicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= 6
    assert len(re.findall(r"FileScan parquet", plan)) <= 2 * 13  # the query's own unions of a table's columns


def test_items_without_units_or_rows(spark):
    items = spark.createDataFrame([(1, "uploaded_photographs"), (2, "application_artwork"), (3, None)], "item_id long, side string")
    declared = spark.createDataFrame([(1, "brand_name", "Oak Barrel", "typed"), (2, "net_contents", "750 mL", "parsed_from_artwork"), (9, "brand_name", "x", "typed")], "item_id long, field string, declared string, source string")
    values = spark.createDataFrame([(2, "net_contents", "750 mL", 0, 0, 1, False)], "item_id long, field string, value string, sheet int, column int, block int, declined boolean")
    units = spark.createDataFrame([(1, 0, 0, 0, 1, " - "), (1, 1, 0, 0, 2, "OAK BARREL")], "item_id long, sheet int, unit int, column int, block int, text string")
    got = {(r.item_id, r.field): (r.outcome, r.code, r.label_value, r.sheet) for r in item.decided(items, declared, values, units).collect()}
    assert len(got) == 12
    assert got[1, "brand_name"] == ("match", "found", "OAK BARREL", 1)
    assert got[2, "net_contents"][0] == "present" and got[3, "brand_name"][:2] == ("not_compared", "undeclared")
    none = item.decided(items, declared, values, units.where("sheet = 0")).where("item_id = 1 AND field = 'brand_name'").first()
    assert (none.outcome, none.score, none.code) == ("mismatch", None, "no_text")
