"""Documents and sheets: captions, boxes, panels and the fields read off lines, on rows made by hand."""

from pyspark.sql import functions as F

from labelwright.functions.similarity import lcs_length_udf
from labelwright.operators import documents, layout, panels, reading, ticks
from labelwright.vocab import STATEMENT_BODY, STATEMENT_PREFIX

WORDS = "item_id long, sheet int, page int, column int, block int, par int, line int, word_idx int, text string, conf double, left int, top int, width int, height int"


def printed(item, sheet, line, text, height, width=100, conf=90.0, block=1):
    return [(item, sheet, 1, 0, block, 1, line, i, t, conf, 10 * i, 20 * line, width, height) for i, t in enumerate(text.split())]


def test_values_below_captions(spark):
    texts = {
        1: ["6. BRAND NAME (Required)", "OLD OAK", "BARREL", "NET CONTENTS: 750 mL", "Class/Type Code", "141 extra"], 2: ["Brand Name : Description - X", "7. FANCIFUL NAME (If any)", "8. next"], 3: ["CLASS/TYPE DESCRIPTION: 21 - Malt beverages", "Class/Type code 7"],
        4: ["FANCIFUL NAME", " ", "lost"], 5: ["nothing", None], 6: ["Brand name", "Wines and", None, "spirits"],
    }
    lines = spark.createDataFrame([(k, i, t) for k, own in texts.items() for i, t in enumerate(own)], "id int, line_idx int, text string")
    got = {r.id: tuple(r)[1:] for r in documents.text_values(lines, "id").collect()}
    assert got == {
        1: ("OLD OAK BARREL", None, None, "141", None, "750 mL", None, True), 2: ("X", None, None, None, None, None, None, True), 3: (None, None, "Malt beverages", "21", None, None, "malt beverage", True),
        4: (None,) * 7 + (False,), 5: (None,) * 7 + (False,), 6: ("Wines and", None, None, None, None, None, "wine", True),
    }


def test_sideways_lines_are_in_no_block(spark):
    rows = printed(1, 0, 0, "TALL EDGE", 300, 20) + printed(1, 0, 1, "OAK BARREL", 60) + printed(1, 0, 2, "Gin", 20) + printed(2, 0, 0, "a b", 60) + printed(2, 0, 4, "c d", 55, block=2) + printed(3, 0, 0, "12% alc 750 ml", 30)
    lines = layout.lines(spark.createDataFrame(rows, WORDS), "item_id", "sheet")
    got = {(r.item_id, r.field): (r.value, r.declined) for r in reading.fields(lines, "item_id", "sheet").collect()}
    assert got[1, "brand_name"] == ("OAK BARREL", False) and got[1, "class_type"] == ("Gin", False)
    assert got[2, "brand_name"] == got[2, "class_type"] == (None, True)
    assert got[3, "alcohol_content"] == got[3, "net_contents"] == ("12% alc 750 ml", False) and got[3, "brand_name"] == (None, False)


def test_words_to_verdicts(spark):
    rows = printed(1, 0, 0, "OLD OAK BARREL", 60) + printed(1, 0, 1, "Straight Whiskey", 30) + printed(1, 0, 2, "45% Alc/Vol (90 Proof)", 12) + printed(1, 1, 0, "750 mL", 10) + printed(1, 1, 1, f"{STATEMENT_PREFIX} {STATEMENT_BODY}", 8) + printed(1, 1, 2, "OLD 0AK BARREL", 90)
    items = spark.createDataFrame([(1, "uploaded_photographs"), (2, None)], "item_id long, side string")
    declared = spark.createDataFrame([(1, "brand_name", "Old Oak Barrel", "typed"), (1, "alcohol_content", "45%", "typed")], "item_id long, field string, declared string, source string")
    photos = spark.createDataFrame([(1, 1, "back")], "item_id long, sheet int, panel string")
    got = {(r.item_id, r.field): (r.outcome, r.label_value, r.sheet, r.panel) for r in reading.verified(spark.createDataFrame(rows, WORDS), items, declared, photos).collect()}
    assert len(got) == 10
    assert got[1, "brand_name"] == ("match", "OLD OAK BARREL", 0, None) and got[1, "class_type"][:2] == ("not_compared", "Straight Whiskey")
    assert got[1, "net_contents"] == ("present", "750 mL", 1, "back") and got[1, "government_warning"][0] == "match"
    assert got[1, "alcohol_content"][0] == "match" and got[2, "government_warning"] == ("mismatch", None, None, None)


def test_larger_type_is_the_brand_s_reading(spark):
    rows = printed(1, 0, 0, "SMALL SURE", 20, conf=99.0) + printed(1, 1, 0, "LARGE", 70, conf=60.0) + printed(1, 2, 0, "LARGER TIE", 70, conf=60.0)
    read = reading.fields(layout.lines(spark.createDataFrame(rows, WORDS), "item_id", "sheet"), "item_id", "sheet")
    got = {r.field: (r.value, r.sheet) for r in reading.merged(read).collect()}
    assert got["brand_name"] == ("LARGE", 1) and got["net_contents"] == (None, None)


def test_scan_stops_where_declared_values_are_shown(spark):
    statement = f"{STATEMENT_PREFIX} {STATEMENT_BODY}"
    rows = printed(1, 0, 0, "750 mL 12% alc", 10) + printed(1, 1, 0, "OLD OAK GIN", 60) + printed(1, 1, 1, "other small", 20) + printed(1, 2, 0, statement, 8) + printed(1, 4, 0, "unread", 9)
    lines = layout.lines(spark.createDataFrame(rows, WORDS), "item_id", "sheet").withColumnRenamed("sheet", "ordinal")
    pages = [(0, 900_000, 4, True), (1, 800_000, 4, True), (2, 700_000, 4, True), (3, 950_000, 50, None), (4, 600_000, 4, True), (5, 100, 4, True)]
    table = spark.createDataFrame([(1, o, 0, px, reads, has) for o, px, reads, has in pages], "item_id long, ordinal int, page int, pixels long, reads int, has_text boolean")
    asked = lambda brand: spark.createDataFrame([(1, "brand_name", brand), (1, "class_type", "gin FB")], "item_id long, field string, declared string")
    of = lambda brand: {r.ordinal: r.status for r in panels.scanned(table, lines, asked(brand), "item_id", common=lcs_length_udf(spark)).collect()}
    assert of("Old Oak") == {3: "undecodable", 0: "read", 1: "read", 2: "read", 4: "not_needed", 5: "too_small"}
    assert of("Elsewhere")[4] == "read" and of(" ")[4] == "not_needed"


def test_boxes_of_captions(spark):
    words = [(1, i, t, a, b, a + 8, b + 4) for i, (t, a, b) in enumerate([("Wine,", 20, 10), ("DISTILLED", 40, 10), ("spirits", 50, 11), ("malt", 60, 10), ("beverages", 70, 30)])]
    df = spark.createDataFrame(words, "id int, word_idx int, text string, left int, top int, right int, bottom int")
    boxes = ticks.captions(df, "id")
    assert {(r.option, r.left, r.top, r.right, r.bottom) for r in boxes.collect()} == {("wine", 20, 10, 28, 14), ("distilled spirits", 40, 10, 58, 15)}
    pages = spark.createDataFrame([(1, 100, 13), (2, 5, 5)], "id int, width int, height int")
    assert {(r.option, r.x0, r.y0, r.x1, r.y1) for r in ticks.windows(boxes, pages, "id").collect()} == {("wine", 9, 7, 19, 13), ("distilled spirits", 27, 6, 39, 13)}
    cells = spark.createDataFrame([(1, x, y, (x * y) % 7) for x in range(100) for y in range(13)], "id int, x int, y int, luminance long").repartition(5)
    windows = spark.createDataFrame([(1, "a", 0, 0, 3, 2), (1, "b", 5, 4, 100, 13), (1, "none", 7, 7, 7, 9)], "id int, option string, x0 int, y0 int, x1 int, y1 int")
    mean = lambda x0, y0, x1, y1: sum((x * y) % 7 for x in range(x0, x1) for y in range(y0, y1)) / ((x1 - x0) * (y1 - y0))
    assert {r.option: r.luminance for r in ticks.means(windows, cells, "id").collect()} == {"a": mean(0, 0, 3, 2), "b": mean(5, 4, 100, 13), "none": None}
    assert {r.id: r.reason for r in ticks.read(df, cells, pages, "id").collect()} == {1: "not_located", 2: "not_located"}


def test_bounds_of_columns(spark):
    cols = spark.createDataFrame([(1, 1, 300, 700), (1, 0, 0, 300), (2, 0, 0, 50)], "sheet int, column int, col_left int, col_right int")
    got = {r.sheet: [tuple(b) for b in r.bounds] for r in layout.bounds(cols, "sheet").where(F.col("n_columns") > 0).collect()}
    assert got == {1: [(0, 300), (300, 700)], 2: [(0, 50)]}
