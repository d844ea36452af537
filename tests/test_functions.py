"""Unit vectors of the verification functions and operators."""

import random

import pytest
from pyspark.sql import functions as F

from labelwright.functions import quantities as Q
from labelwright.functions import similarity as S
from labelwright.functions import text as T
from labelwright.functions import verdict as V
from labelwright.operators import batch, documents, layout, merge, quality, search, statement
from labelwright.vocab import STATEMENT_BODY, STATEMENT_PREFIX


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_text(spark):
    rows = [("STONE’S  Throw!",), ("a b",), ("100% & + $",)]
    assert [r[0] for r in values(spark, rows, "t string", T.normalized(F.col("t")))] == ["stone s throw", "a b", "100 + $"]
    names = [("0001-STONES.PDF",), ("a.front.png",), ("batch/a.png",), ("in\\B.PNG",), ("none",), (".png",)]
    assert [r[0] for r in values(spark, names, "t string", T.stem(F.col("t")))] == ["0001-stones", "a.front", "a", "b", "none", ".png"]
    assert values(spark, [("preg-\nnancy",)], "t string", T.rejoined_hyphens(F.col("t"))) == [("pregnancy",)]
    assert values(spark, [("=1",), ("a=1",), ("@x",)], "t string", T.guarded_cell(F.col("t"))) == [("'=1",), ("a=1",), ("'@x",)]
    fold = T.strict_normalized(spark)
    assert values(spark, [("ﬁne Straße",), (None,)], "t string", fold(F.col("t"))) == [("fine strasse",), (None,)]


def test_similarity(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    udf = S.lcs_length_udf(spark)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[-1]))
            row = now
        return row[-1]

    found = values(spark, rows, "a string, b string", "a", "b", S.lcs_length(F.col("a"), F.col("b")), udf("a", "b"))
    assert all(n == m == plain(a, b) for a, b, n, m in found)
    diff = S.differences(spark)
    got = values(spark, [("the labl text", "the label text")], "a string, b string", diff("a", "b"))[0][0]
    assert [(d.kind, d.text) for d in got] == [("same", "the lab"), ("missing", "e"), ("same", "l text")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("45% Alc./Vol. (90 Proof)", (45.0, 90.0, None, None)), ("45", (45.0, None, None, None)), ("ABV 12.5 percent", (12.5, None, None, None)),
        ("46.3% ALC/VOL (92-6 PROOF)", (46.3, 92.6, None, None)), ("80-90 PROOF", (None, 90.0, None, None)), ("12 to 14% alc/vol", (None, None, 12.0, 14.0)), ("forty five percent", (None,) * 4),
    ],
)
def test_abv(spark, text, want):
    assert tuple(values(spark, [(text,)], "t string", Q.abv(F.col("t")))[0][0]) == want


def test_compared_quantities(spark):
    abv = [("45% Alc./Vol. (90 Proof)", "45"), ("45", "45.1"), ("45% Alc./Vol. (92 Proof)", "45"), ("12 to 14% alc/vol", "13"), ("forty five", "45"), (None, "45"), ("45%", None), (None, None)]
    got = values(spark, abv, "a string, b string", Q.abv_verdict(F.col("a"), F.col("b"))["outcome"])
    assert [r[0] for r in got] == ["match", "mismatch", "needs_review", "needs_review", "needs_review", "mismatch", "present", "mismatch"]
    net = [("750 mL", "750ml"), ("1 PINT", "1 pt"), ("12 OZ", "12 fl. oz."), ("CONT.700ML.e", "700 mL"), ("750 mL", "25.4 fl oz"), ("750", "750 mL"), ("750 mL", "700 mL"), ("half", "some"), ("50 CL", ""), ("", None)]
    got = values(spark, net, "a string, b string", Q.net_contents_verdict(F.col("a"), F.col("b"), F.struct(F.lit("text").alias("outcome"), F.lit(1.0).alias("score")))["outcome"])
    assert [r[0] for r in got] == ["match", "match", "match", "match", "needs_review", "needs_review", "mismatch", "text", "present", "mismatch"]
    lines = [("44% ALC/VOL 700 ML",), ("impact by 7%",), ("ALC/VOL",), ("750",), ("ALCIVOL 40",), ("ML",)]
    assert values(spark, lines, "t string", Q.states_alcohol(F.col("t")), Q.states_net_contents(F.col("t"))) == [(True, True), (False, False), (False, False), (False, False), (True, False), (False, False)]


def test_verdicts(spark):
    rows = [("STONE'S THROW", "Stone’s Throw"), ("Stone's Throw", "Copper Kettle"), ("x", " "), (None, "x"), ("--", "x")]
    got = values(spark, rows, "a string, b string", V.compared_text(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == ["match", "mismatch", "not_compared", "mismatch", "needs_review"]
    assert [r[0] for r in values(spark, [(95.0,), (94.9,), (80.0,), (79.9,)], "s double", V.band(F.col("s")))] == ["match", "needs_review", "needs_review", "mismatch"]
    df = spark.createDataFrame([(1, "match"), (1, "present"), (2, "match"), (2, "needs_review"), (3, "present")], "k int, o string")
    assert {r.k: r.row_outcome for r in V.rolled_up(df, "o", "k").collect()} == {1: "match", 2: "needs_review", 3: "present"}


def test_search(spark):
    texts = {1: ("SIERRA VERDE", "word " * 40 + "Sierra, Verde. " + "more " * 40), 2: ("SIERRA VERDE", "SIERRA VERDF small"), 3: ("ROSA", "PROSAIC BOTTLES"), 4: ("MEZCAL FB", "SMALL BATCH MEZCAL"), 5: ("--", "any text"), 6: ("ROSA", "PROSAIC ROSA BOTTLES")}
    pairs = spark.createDataFrame([(k, n, 0, t) for k, (n, t) in texts.items()], "id int, needle string, unit int, text string")
    got = {r.id: r for r in search.verified(pairs, "id").collect()}
    assert (got[1].hit, got[1].score, got[1].outcome) == ("Sierra, Verde.", 100.0, "match")
    assert got[2].outcome == "needs_review" and got[3].score < 80 and got[6].score == 100
    assert (got[4].outcome, got[4].code) == ("match", "FB") and got[5].score is None and got[5].outcome == "mismatch"
    two = spark.createDataFrame([(1, "ab cd", 0, "ab ce"), (1, "ab cd", 1, "x ab cd")], "id int, needle string, unit int, text string")
    assert search.found(two, "id").first().unit == 1


def test_statement(spark):
    whole = f"{STATEMENT_PREFIX} {STATEMENT_BODY}"
    rows = [(whole,), (whole.replace("Warning", "warning").replace("drive", "drve"),), (whole.replace("GOVERNMENT", "Government"),), (whole.replace("women should not drink", "people drink"),), (None,)]
    got = [r[0] for r in values(spark, rows, "t string", statement.checked(F.col("t"))["outcome"])]
    assert got == ["match", "needs_review", "mismatch", "mismatch", "mismatch"]
    lines = spark.createDataFrame([(1, 0, "A fine thing"), (1, 1, "12345"), (1, 2, "GOVERNMENT WARNING: (1) Accord-"), (1, 3, "ing to the Surgeon General,"), (2, 0, "Warning"), (2, 1, "according to the"), (2, 2, "surgeon general"), (3, 0, "nothing")], "id int, line_idx int, text string")
    assert {r.id: r["first"] for r in statement.first_line(lines, "id").collect()} == {1: 2, 2: 0}
    assert statement.block(lines.where("id = 1"), "id").first().statement.startswith("GOVERNMENT WARNING")


def test_statement_without_an_intact_prefix(spark):
    body, far = STATEMENT_BODY, "x" * 170
    rows = [
        (f"G0VERNM WARNING: {body}", 0, 0), (f"G0VERNM WARNING: {body}", 2, 2), (f"G0VERNM WARNING: {body}", 2, 1), (f"fine\n{body}", 1, 1),
        (f"warning {'y' * 41} {body}", 0, 0), (f"warning\n{body}", 0, 0), (f"according to the {far} birth defects", 1, 1), ("according to the maker", 1, 1),
        (f"{STATEMENT_PREFIX} {body}", 1, 1), (f"{STATEMENT_PREFIX} {body.replace('drive', 'drve')}", 1, 1), (f"{STATEMENT_PREFIX} {body.replace('birth defects', 'harm')}", 3, 3), (None, 1, 1),
    ]
    cols = statement.checked(F.col("t"), differing=F.col("d"), illegible=F.col("i"))
    got = [tuple(r) for r in values(spark, rows, "t string, d int, i int", F.struct(cols["found"], cols["prefix_upper"], cols["exact"], cols["outcome"]).alias("r")) for r in [r[0]]]
    read, lost = (True, None, True), (False, None, False)
    assert got == [
        (*read, "mismatch"), (*read, "not_certified"), (*read, "mismatch"), (*read, "not_certified"), (*read, "mismatch"), (*read, "mismatch"), (*lost, "mismatch"), (*lost, "mismatch"),
        (True, True, True, "match"), (True, True, False, "needs_review"), (True, True, False, "not_certified"), (*lost, "mismatch"),
    ]
    lines = spark.createDataFrame([(1, "According to the Sur-", 50.0), (1, "geon Genxral", 60.0), (1, "birth defcts", 90.0), (1, "123", 10.0)], "id int, text string, confidence double")
    assert tuple(statement.legibility(lines, "id").first()) == (1, 2, 1)


def test_layout(spark):
    words = spark.createDataFrame([(1, i, t, 90.0, a, 10 * b, a + 40, 10, 1, 1, 1, b) for i, (t, a, b) in enumerate([("one", 0, 0), ("two", 45, 0), ("far", 500, 0), ("next", 0, 1)])], "sheet int, word_idx int, text string, conf double, left int, top int, right int, height int, page int, block int, par int, line int").withColumn("width", F.lit(40))
    sheets = spark.createDataFrame([(1, 1000)], "sheet int, width int")
    cols = layout.columns(words, sheets, "sheet")
    assert sorted((r.column, r.col_left, r.col_right) for r in cols.collect()) == [(0, 0, 292), (1, 292, 1000)]
    lines = layout.lines(layout.placed(words, cols, "sheet"), "sheet")
    assert [(r.line_idx, r.text) for r in lines.orderBy("line_idx").collect()] == [(0, "one two"), (1, "next"), (2, "far")]
    rows = spark.createDataFrame([(1, 0, "big", 40.0, 0), (1, 1, "small", 10.0, 50), (1, 2, "lines", 10.0, 62)], "sheet int, line_idx int, text string, height double, top int").selectExpr("*", "0 AS column", "0 AS block", "90.0D AS confidence")
    found = layout.blocks(rows, "sheet")
    assert [r.text for r in found.orderBy("island").collect()] == ["big", "small lines"]
    assert layout.stand_out(found, "sheet").first().text == "big"


def test_documents_and_merge(spark):
    lines = spark.createDataFrame([(1, 0, "6. BRAND NAME (Required)"), (1, 1, "Copper Kettle"), (1, 2, "Class/Type Code: 141"), (1, 3, "CLASS/TYPE DESCRIPTION: Whisky"), (1, 4, "NET CONTENTS"), (1, 5, "")], "id int, line_idx int, text string")
    assert {r.field: r.value for r in documents.caption_values(lines, "id").collect()} == {"brand_name": "Copper Kettle", "class_type": "Whisky", "net_contents": None}
    panels = spark.createDataFrame([(1, 0, 0, 900_000, 10, True, False), (1, 1, 0, 800_000, 10, True, False), (1, 2, 0, 700_000, 1, True, True), (1, 3, 0, 1_000, 1, True, False)], "id int, ordinal int, page int, pixels int, reads int, has_text boolean, satisfies boolean")
    assert [r.status for r in documents.scan(panels, "id").orderBy("ordinal").collect()] == ["read", "read", "not_reached", "too_small"]
    readings = spark.createDataFrame([(1, "a", 0, 80.0), (1, "b", 1, 90.0), (1, "c", 2, 90.0), (1, None, 3, 99.0)], "id int, value string, sheet_idx int, confidence double")
    assert tuple(merge.best_reading(readings, "id").first())[1:] == ("b", 1)
    turn = merge.quarter_turn(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0))
    assert values(spark, [(1.0, 0.0, 0.0, 1.0), (0.0, 1.0, -1.0, 0.0), (1.0, 0.0, 0.0, -1.0), (1.0, 0.2, -0.2, 1.0)], "a double, b double, c double, d double", turn) == [(0,), (1,), (None,), (None,)]


def test_batch_and_quality(spark):
    files = spark.createDataFrame([(1, 0, "b.pdf"), (1, 1, "a.png"), (1, 2, "B.PNG"), (1, 3, "c.pdf")], "batch_id int, idx int, filename string")
    assert {r.stem: (r.position, r.n_files) for r in batch.grouped(files).collect()} == {"b": (1, 2), "a": (2, 1), "c": (3, 1)}
    with pytest.raises(ValueError):
        batch.refuse_oversized(spark.range(301).selectExpr("1 AS batch_id", "concat(id, '.png') AS filename"))
    df = spark.createDataFrame([("match", "match"), ("match", "mismatch"), ("needs_review", "match"), ("mismatch", "mismatch")], "reported string, truth string")
    assert tuple(quality.metrics(df).first()) == (0.5, 0.5, 0.25, 0.5)
    assert tuple(quality.metrics(df.limit(0)).first()) == (None, None, None, None)
