"""The whole way of an item: from the words of its sheets to its decided fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import lcs_length_udf
from ..operators import layout, panels, quality, reading
from ..vocab import STATEMENT_PREFIX
from .registry import query, table
from .verdicts import _DECIDE, _PIECES, _SQL_JOINED, _SQL_STATEMENT, _SQL_STATEMENT_OUTCOME

#: Sheets' lines (sheet, line, height, width, block, text, condition): what is printed on them is made from a part.
_PRINTED = [
    (0, 0, "CASE WHEN p_partkey % 7 = 0 THEN 28 ELSE 60 END", 120, 1, "upper(p_name)", "p_partkey % 13 <> 0"),
    (0, 1, "26", 120, 2, "concat(p_type, ' ', p_name, ' whisky')", "p_partkey % 3 <> 2"),
    (0, 2, "12", 120, 2, "concat(p_size, '% Alc/Vol (', 2 * p_size + CASE WHEN p_partkey % 8 = 0 THEN 4 ELSE 0 END, ' Proof)')", "p_partkey % 5 <> 0"),
    (0, 3, "300", 20, 3, "concat('EDGE ', p_type)", "p_partkey % 4 < 2"),
    (0, 4, "12", 120, 4, "concat('bottled by ', p_brand)", "p_partkey % 2 = 0"),
    (1, 0, "40", 120, 1, "p_name", "p_partkey % 6 = 1"),
    (1, 1, "11", 120, 1, "concat(p_size, ' ML 12% vol')", "p_partkey % 6 > 2"),
    (1, 2, "9", 120, 2, f"CASE WHEN p_partkey % 9 = 0 THEN 'Warning' ELSE '{STATEMENT_PREFIX}' END", "p_partkey % 10 <> 0"),
    (1, 3, "9", 120, 2, "'12 % *'", "p_partkey % 3 = 0"),
    *[(1, 4 + i, "9", 120, 2, f"CASE WHEN p_partkey % 11 = {i} THEN replace('{t}', 'e', 'c') ELSE '{t}' END", "true") for i, t in enumerate(_PIECES)],
    (1, 9, "9", 120, 2, "concat(p_size, ' fl oz ', p_brand)", "true"),
    (2, 0, "9", 120, 2, f"'{STATEMENT_PREFIX} {_PIECES[0]}'", "p_partkey % 2 = 1"),
]
_LINES = " UNION ALL ".join(
    f"SELECT p_partkey AS item_id, {sheet} AS sheet, {line} AS line, CAST({height} AS INT) AS height, {width} AS width, {block} AS block, {text} AS text, CAST(CASE WHEN (p_partkey + {line}) % 4 = 0 THEN 55 ELSE 91 END AS DOUBLE) AS conf FROM part WHERE {when}"
    for sheet, line, height, width, block, text, when in _PRINTED
)
_ITEMS = "SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'application_artwork' ELSE 'uploaded_photographs' END AS side FROM part"
_DECLARED = " UNION ALL ".join(
    f"SELECT p_partkey AS item_id, '{field}' AS field, {value} AS declared, CASE WHEN p_partkey % 9 < 4 THEN 'parsed_from_artwork' ELSE 'typed' END AS source FROM part"
    for field, value in (
        ("brand_name", "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN translate(p_name, 'e', 'c') ELSE p_name END"),
        ("class_type", "CASE WHEN p_partkey % 4 <> 3 THEN concat(lower(p_type), ' ', p_name, ' whisky FB') END"),
        ("alcohol_content", "CASE WHEN p_partkey % 4 <> 0 THEN concat(p_size, ' percent') END"),
        ("net_contents", "CASE WHEN p_partkey % 7 <> 0 THEN concat(p_size, ' mL') END"),
    )
)
_PHOTOS = "SELECT p_partkey AS item_id, 0 AS sheet, concat('panel ', p_brand) AS panel FROM part WHERE p_partkey % 2 = 0"
_ALCOHOL = r"(?i)\b(?:alcohol|alc|abv|vol(?:ume)?|proof)\b|alc[\W_il1]{1,3}vol"
_CONTENTS = r"(?i)\d+(?:\.\d+)?\s*(?:ml|mls|milli\.?\s*lit(?:er|re)s?|l|lit(?:er|re)s?|cl|centi\.?\s*lit(?:er|re)s?|fl\.?\s*oz|fluid\.?\s*ounces?|oz|pint|pt|quart|qt|gallon|gal)\b"

_CHAIN = rf"""wd AS (SELECT item_id, sheet, line, height, width, block, conf, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM ({_LINES})),
ln AS (SELECT *, row_number() OVER (PARTITION BY item_id, sheet ORDER BY line) - 1 AS line_idx, 2 * line * 10 AS top, 10 * item_id + sheet AS k FROM (SELECT item_id, sheet, line, string_agg(w, ' ' ORDER BY i) AS text, avg(height) AS height, avg(width) AS width, round(avg(conf), 1) AS confidence, any_value(block) AS block FROM wd WHERE trim(w) <> '' GROUP BY item_id, sheet, line)),
st AS (WITH l AS (SELECT k AS item_id, line_idx, text, confidence FROM ln), {_SQL_STATEMENT} SELECT v.*, f.first, e.last FROM v LEFT JOIN f USING (item_id) LEFT JOIN e USING (item_id)),
cl AS (SELECT ln.*, coalesce(line_idx BETWEEN st.first AND st.last AND regexp_matches(text, '\p{{L}}'), false) AS inside, regexp_matches(text, '{_ALCOHOL}') AND regexp_matches(text, '\d') AS says_alcohol, regexp_matches(text, '{_CONTENTS}') AS says_contents FROM ln LEFT JOIN st ON st.item_id = ln.k),
la AS (SELECT *, min(line_idx) FILTER (NOT inside AND says_alcohol) OVER (PARTITION BY k) AS abv, min(line_idx) FILTER (NOT inside AND says_contents) OVER (PARTITION BY k) AS net FROM cl),
bl AS (WITH k AS (SELECT k AS l_orderkey, line_idx, height, top, 0 AS col, block, text, confidence FROM la WHERE NOT inside AND coalesce(line_idx <> abv, true) AND coalesce(line_idx <> net, true) AND NOT (width > 0 AND height > width)), {_SQL_JOINED} SELECT * FROM b),
rk AS (SELECT *, row_number() OVER w AS turn, lead(height) OVER w AS next, count(*) OVER (PARTITION BY l_orderkey) AS n FROM bl WINDOW w AS (PARTITION BY l_orderkey ORDER BY height DESC, top, first_line)),
o1 AS (SELECT * FROM rk WHERE turn = 1 AND (next IS NULL OR next <= 0.7 * height)), o2 AS (SELECT * FROM rk WHERE turn = 2 AND (next IS NULL OR next <= 0.7 * height) AND l_orderkey IN (SELECT l_orderkey FROM o1)),
sh AS (SELECT DISTINCT item_id, sheet, k, coalesce((SELECT any_value(n) FROM rk WHERE l_orderkey = ln.k), 0) AS n FROM ln),
rd AS (SELECT item_id, sheet, 'brand_name' AS field, o.text AS value, o.confidence, o.height AS size, o.block, o.text IS NULL AND sh.n > 0 AS declined FROM sh LEFT JOIN o1 o ON l_orderkey = k
  UNION ALL SELECT item_id, sheet, 'class_type', o.text, o.confidence, o.height, o.block, o.text IS NULL AND sh.n > CASE WHEN k IN (SELECT l_orderkey FROM o1) THEN 1 ELSE 0 END FROM sh LEFT JOIN o2 o ON l_orderkey = k
  UNION ALL SELECT item_id, sheet, 'alcohol_content', text, confidence, 0, block, false FROM la WHERE line_idx = abv UNION ALL SELECT item_id, sheet, 'net_contents', text, confidence, 0, block, false FROM la WHERE line_idx = net),
mg AS (SELECT item_id, field, arg_max({{'value': value, 'sheet': sheet, 'block': block}}, (size, confidence, -sheet)) FILTER (value IS NOT NULL) AS b, bool_or(declined) AS declined FROM rd GROUP BY 1, 2),
items AS ({_ITEMS}), declared_ AS ({_DECLARED}),
values_ AS (SELECT item_id, field, b.value AS value, b.sheet AS sheet, CASE WHEN b.value IS NOT NULL THEN 0 END AS region_column, b.block AS block, coalesce(b.value IS NULL AND declined, false) AS declined FROM (SELECT item_id, field FROM items, (VALUES ('brand_name'), ('class_type'), ('alcohol_content'), ('net_contents')) x(field)) LEFT JOIN mg USING (item_id, field)),
units_ AS (SELECT item_id, sheet, row_number() OVER (PARTITION BY item_id, sheet ORDER BY first) - 1 AS unit, 0 AS region_column, block, text FROM (SELECT item_id, sheet, block, min(line_idx) AS first, string_agg(text, ' ' ORDER BY line_idx) AS text FROM ln GROUP BY 1, 2, 3) WHERE regexp_matches(text, '[^\s\p{{P}}]')),
{_DECIDE},
sm AS (SELECT item_id // 10 AS item_id, item_id % 10 AS sheet, t, {_SQL_STATEMENT_OUTCOME} AS outcome, row_number() OVER (PARTITION BY item_id // 10 ORDER BY length(t) DESC, coalesce(sure, 0) DESC, item_id % 10) AS turn FROM st LEFT JOIN (SELECT k, round(avg(confidence), 1) AS sure FROM cl WHERE inside GROUP BY 1) ON k = item_id WHERE found),
every AS (SELECT * FROM decided UNION ALL SELECT i.item_id, 'government_warning', coalesce(sm.outcome, 'mismatch'), NULL, CASE WHEN sm.item_id IS NULL THEN 'absent' ELSE 'statement' END, t, NULL, sheet, CASE WHEN sm.item_id IS NOT NULL THEN 0 END, CASE WHEN sm.item_id IS NOT NULL THEN 2 END FROM items i LEFT JOIN sm ON sm.item_id = i.item_id AND turn = 1)"""


@query(f"WITH RECURSIVE {_CHAIN}, photos AS ({_PHOTOS}) SELECT item_id, field, outcome, score, code, label_value, declared, sheet, block, panel FROM every LEFT JOIN photos USING (item_id, sheet)")
def item_chain(spark, sf_dir):
    """From word boxes to decided fields: lines, claims, blocks by size, merged readings, searches, verdicts and the statement."""
    words, of = _inputs(spark, sf_dir)
    return reading.verified(words, of(_ITEMS), of(_DECLARED), of(_PHOTOS), common=lcs_length_udf(spark)).drop("column")


def _inputs(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_chain_parts")
    of = lambda sql: spark.sql(sql.replace("FROM part", "FROM _chain_parts"))
    words = of(_LINES).select("*", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return words.select("item_id", "sheet", F.lit(1).alias("page"), F.lit(0).alias("column"), "block", F.lit(1).alias("par"), "line", F.col("i").alias("word_idx"), F.col("w").alias("text"), "conf", (F.col("i") * 130).alias("left"), (F.col("line") * 20).alias("top"), "width", "height"), of


#: Panels of a document, a sheet each and one without lines; the size, the cost and what became of the picture by rule.
_PANELS = " UNION ALL ".join(f"SELECT p_partkey AS item_id, {k} AS ordinal, {k} % 2 AS page, CAST(200000 + (p_partkey * {k + 3}) % 7 * 90000 AS BIGINT) AS pixels, CAST(4 + (p_partkey + {k}) % 9 AS INT) AS reads, CASE WHEN (p_partkey + {k}) % 8 = 0 THEN NULL ELSE {k} < 3 END AS has_text FROM part" for k in range(4))


@query(f"""WITH RECURSIVE {_CHAIN}, pn AS ({_PANELS}),
own AS (SELECT item_id, sheet, bool_or(field = 'brand_name' AND value IS NOT NULL) AS brand, bool_or(field = 'class_type' AND value IS NOT NULL) AS class, bool_or(field = 'alcohol_content') AS alcohol, bool_or(field = 'net_contents') AS contents FROM rd GROUP BY 1, 2),
hit AS (SELECT item_id, sheet, bool_or(field = 'brand_name' AND outcome = 'match') AS brand, bool_or(field = 'class_type' AND outcome = 'match') AS class FROM f GROUP BY 1, 2),
ask AS (SELECT item_id, bool_or(field = 'brand_name' AND coalesce(trim(declared), '') <> '') AS brand, bool_or(field = 'class_type' AND coalesce(trim(declared), '') <> '') AS class FROM declared_ GROUP BY 1),
sw AS (SELECT pn.*, coalesce(has_text, false) AND coalesce(CASE WHEN ask.brand THEN hit.brand ELSE own.brand END, false) AS brand, coalesce(has_text, false) AND coalesce(CASE WHEN ask.class THEN hit.class ELSE own.class END, false) AS class, coalesce(has_text AND own.alcohol, false) AS alcohol, coalesce(has_text AND own.contents, false) AS contents, coalesce(has_text AND st.found, false) AS warning
  FROM pn LEFT JOIN own ON own.item_id = pn.item_id AND own.sheet = ordinal LEFT JOIN hit ON hit.item_id = pn.item_id AND hit.sheet = ordinal LEFT JOIN ask ON ask.item_id = pn.item_id LEFT JOIN st ON st.item_id = 10 * pn.item_id + ordinal),
rn AS (SELECT *, pixels >= 250000 AS fits, row_number() OVER w AS rank, coalesce(sum(reads) FILTER (has_text IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, bool_or(brand) OVER w AND bool_or(class) OVER w AND bool_or(alcohol) OVER w AND bool_or(contents) OVER w AND bool_or(warning) OVER w AS satisfies FROM sw WINDOW w AS (PARTITION BY item_id, pixels >= 250000 ORDER BY pixels DESC, page, ordinal)),
ov AS (SELECT *, coalesce(bool_or(satisfies AND coalesce(has_text, false)) OVER (PARTITION BY item_id, fits ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM rn),
sp AS (SELECT *, min(rank) FILTER (spent >= 16) OVER v AS spent_at, min(rank) FILTER (over) OVER v AS over_at FROM ov WINDOW v AS (PARTITION BY item_id, fits ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT item_id, ordinal, rank, satisfies, CASE WHEN NOT fits THEN 'too_small' WHEN rank > 8 THEN 'not_read' WHEN over_at IS NOT NULL AND (spent_at IS NULL OR over_at <= spent_at) THEN 'not_needed' WHEN spent_at IS NOT NULL THEN 'not_reached' WHEN has_text IS NULL THEN 'undecodable' WHEN has_text THEN 'read' ELSE 'no_text' END AS status FROM sp""")
def panel_pool(spark, sf_dir):
    """The scan of a document's pictures, stopped by what the panels so far show of its declared values."""
    words, of = _inputs(spark, sf_dir)
    lines = layout.lines(words, "item_id", "sheet").withColumnRenamed("sheet", "ordinal")
    out = panels.scanned(of(_PANELS), lines, of(_DECLARED), "item_id", common=lcs_length_udf(spark))
    return out.select("item_id", "ordinal", F.col("rank").cast("long").alias("rank"), "satisfies", "status")


#: What is printed of each field, as a golden file has it: the line's text where the line is there.
_GOLDEN_LINES = {"brand_name": (0, 0), "class_type": (0, 1), "alcohol_content": (0, 2), "net_contents": (1, 1)}
_GOLDEN = " UNION ALL ".join(
    f"SELECT p_partkey AS item_id, '{field}' AS field, CASE WHEN {when} THEN {text} END AS value, {sheet} AS sheet, 0 AS region_column, {block} AS block, false AS declined FROM part"
    for field, at in _GOLDEN_LINES.items() for sheet, line, _, _, block, text, when in _PRINTED if (sheet, line) == at
)


@query(f"""WITH RECURSIVE {_CHAIN}, truth AS (WITH RECURSIVE items AS ({_ITEMS}), declared_ AS ({_DECLARED}), values_ AS ({_GOLDEN}), units_ AS (SELECT 0 AS item_id, 0 AS sheet, 0 AS unit, 0 AS region_column, 0 AS block, '' AS text WHERE false), {_DECIDE} SELECT item_id, field, outcome AS truth FROM decided),
b AS (SELECT field, outcome AS reported, truth FROM every JOIN truth USING (item_id, field))
SELECT field, count(*) FILTER (reported = 'match' AND truth = 'match') / nullif(count(*) FILTER (reported = 'match'), 0) AS precision, count(*) FILTER (reported = 'match' AND truth = 'match') / nullif(count(*) FILTER (truth = 'match'), 0) AS recall,
  count(*) FILTER (reported = 'needs_review') / count(*) AS review_rate, count(*) FILTER (reported = 'match' AND truth = 'mismatch') / nullif(count(*) FILTER (reported = 'match'), 0) AS false_match FROM b GROUP BY field""")
def golden_metrics(spark, sf_dir):
    """Verdicts from words against the truth, which is what the same rules say of the printed values themselves."""
    words, of = _inputs(spark, sf_dir)
    common = lcs_length_udf(spark)
    printed = of(_GOLDEN).withColumnRenamed("region_column", "column")
    truth = quality.golden_truth(of(_ITEMS), of(_DECLARED), printed, common)
    reported = reading.verified(words, of(_ITEMS), of(_DECLARED), of(_PHOTOS), common=common)
    return quality.evaluated(reported, truth)
