"""The best run of a stretch against all its runs, and the statement's check where each part is made once."""

import random

import numpy as np
from pyspark.sql import functions as F

from labelwright.functions.similarity import NEXT, STRETCH, _lcs, best_runs, lcs_length_udf
from labelwright.operators import item, panels, search, statement
from labelwright.vocab import STATEMENT_BODY, STATEMENT_PREFIX


def slow(text, goal):
    best, words, own = None, text.split(NEXT), goal.split(NEXT)
    for size in range(len(own) - 1, len(own) + 2):
        for at in range(min(STRETCH, len(words) - size + 1)):
            if size and text and goal:
                seen, want = " ".join(words[at : at + size]), " ".join(own)
                best = max(best or (-1,), (200.0 * _lcs(seen, want) / (len(seen) + len(want)), -size, -at - 1))
    return best


def test_best_runs_are_those_of_a_loop():
    rng = random.Random(1)
    some = lambda n: NEXT.join(rng.choice("the old oak é 𝔸 of-x ring a gearwheel".split()) for _ in range(n))
    texts = [some(rng.randrange(80)) for _ in range(25)] + ["", "a", f"a b{NEXT}c"]
    goals = [some(rng.randrange(1, 6)) for _ in range(10)] + ["", some(30), f"zz{NEXT}q", "ab" * 32, "b" * 65, "ab" * 64 + "a"]  # rows of one number and of more
    t, g = np.divmod(np.arange(len(texts) * len(goals)), len(goals))
    raw, size, start = best_runs(texts, goals, t, g)
    assert [(r, -s, -a) if s else None for r, s, a in zip(raw.tolist(), size.tolist(), start.tolist())] == [slow(texts[x], goals[y]) for x, y in zip(t, g)]


def test_runs_stay_in_a_units_row(spark):
    rng = random.Random(3)
    words = "old oak 0ak, barrel b-arrel A1 ring' -- café".split()
    rows = [(k, u, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 9, 150])))) for k in range(12) for u in range(3)] + [(12, 0, None), (13, 0, " - ")]
    asks = F.array(F.struct(F.lit("brand_name").alias("field"), F.lit("old oak").alias("needle")), F.struct(F.lit("class_type").alias("field"), F.lit("Oak Barrel A1").alias("needle")), F.struct(F.lit("net_contents").alias("field"), F.lit("--").alias("needle")))
    units = spark.createDataFrame(rows, "id int, unit int, text string").withColumn("asks", search.asked(asks)).withColumn("goals", search.goals(F.col("asks")))
    common = lcs_length_udf(spark)
    quick, plain = (search.unit_hits(units, "id", common=c) for c in (common, lambda a, b: common(a, b)))
    places = lambda df: df.withColumn("start", F.when(F.col("raw").isNotNull(), F.col("start"))).select(*quick.columns).collect()
    assert sorted(map(repr, places(quick))) == sorted(map(repr, places(plain)))
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in nodes(plain) and "Aggregate" not in nodes(quick)  # no row for each run, and none sorted


def test_items_search_without_rows_of_runs(spark):
    items = spark.createDataFrame([(1, "uploaded_photographs")], "item_id long, side string")
    declared = spark.createDataFrame([(1, "brand_name", "Oak Barrel", "typed"), (1, "class_type", "old gin A1", "typed")], "item_id long, field string, declared string, source string")
    values = spark.createDataFrame([], "item_id long, field string, value string, sheet int, column int, block int, declined boolean")
    units = spark.createDataFrame([(1, 0, 0, 0, 1, "the oak barel"), (1, 1, 0, 0, 2, "OAK BARREL, old gin")], "item_id long, sheet int, unit int, column int, block int, text string")
    out = item.decided(items, declared, values, units, common=lcs_length_udf(spark))
    got = {r.field: (r.outcome, r.label_value, r.sheet) for r in out.collect()}
    assert got["brand_name"] == ("match", "OAK BARREL,", 1) and got["class_type"] == ("match", "old gin", 1)
    assert "runs(" in out._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([(1, 0, 0, 0, 1, "OAK BARREL", 90.0, 20.0, 90.0, 0, False)], "item_id long, ordinal int, line_idx int, column int, block int, text string, confidence double, height double, width double, top int, sideways boolean")
    shown = panels.shown(lines, declared, "item_id", common=lcs_length_udf(spark))
    assert [(r.brand_name, r.class_type) for r in shown.collect()] == [(True, False)]
    assert "runs(" in shown._jdf.queryExecution().executedPlan().toString()


def test_a_check_follows_edits_only_to_a_near_miss(spark):
    texts = [f"{STATEMENT_PREFIX} {STATEMENT_BODY}", f"{STATEMENT_PREFIX} {STATEMENT_BODY}x", f"{STATEMENT_PREFIX} {STATEMENT_BODY[3:]}", f"Warning {STATEMENT_BODY}", f"{STATEMENT_BODY[:-2]}", "no statement", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    own = df.select("id", statement.check(F.col("t")).alias("c"), *[c.alias(n) for n, c in statement.checked(F.col("t")).items()])
    got = {r.id: r for r in own.collect()}
    assert [got[i].outcome for i in range(8)] == ["match", "needs_review", "mismatch", "mismatch", "mismatch", "mismatch", "mismatch", "mismatch"]
    assert [(got[i].found, got[i].prefix_upper, got[i].exact, got[i].near_miss, got[i].distance) for i in range(8)] == [
        (True, True, True, False, 0), (True, True, False, True, 1), (True, True, False, False, 4), (True, None, True, False, 0), (True, None, False, True, 2), *[(False, None, False, False, None)] * 3,
    ]
    assert all(got[i].c[n] == got[i][n] for i in range(8) for n in ("found", "prefix_upper", "exact", "near_miss", "outcome"))
    plan = df.select(statement.check(F.col("t"))["outcome"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") <= 2  # more in a plan of checked()
