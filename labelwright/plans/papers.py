"""Queries of application documents: their values from forms, text, pictures and boxes, and what is left to say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, ticks
from .registry import made, query, table

# --- values of a document, which an order stands for -------------------------------------------------------------------


@query("""SELECT o_orderkey, field, arg_min(value, idx) AS value FROM (SELECT o_orderkey, idx, CASE WHEN regexp_matches(name, '(?i)\\bbrand\\s+name\\b') THEN 'brand_name' WHEN regexp_matches(name, '(?i)\\bfanciful\\s+name\\b') THEN 'fanciful_name' END AS field, value FROM w
  UNION ALL SELECT o_orderkey, idx, 'beverage_type', CASE regexp_replace(lower(export), '[^a-z]', '', 'g') WHEN 'wine' THEN 'wine' WHEN 'spirits' THEN 'distilled spirits' WHEN 'maltbeverages' THEN 'malt beverage' END FROM w WHERE checked AND regexp_matches(name, '(?i)check\\s*box\\s*22'))
  WHERE field IS NOT NULL AND trim(value) <> '' GROUP BY 1, 2""".replace("FROM w", """FROM (SELECT l_orderkey AS o_orderkey, l_linenumber AS idx, CASE l_linenumber % 4 WHEN 0 THEN '6. Brand  Name' WHEN 1 THEN 'FANCIFUL NAME (if any)' WHEN 2 THEN 'Check Box22' ELSE 'Serial' END AS name,
  CASE WHEN l_quantity > 10 THEN l_returnflag ELSE ' ' END AS value, l_quantity > 25 AS checked, CASE l_partkey % 4 WHEN 0 THEN 'Wine' WHEN 1 THEN 'Spirits' WHEN 2 THEN 'Malt Beverages' ELSE 'Off' END AS export FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"""))
def form_values(spark, sf_dir):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    widgets = table(spark, sf_dir, "lineitem").withColumn("turn", turn).where("turn = 1").selectExpr(
        "l_orderkey AS o_orderkey", "l_linenumber AS idx", "CASE l_linenumber % 4 WHEN 0 THEN '6. Brand  Name' WHEN 1 THEN 'FANCIFUL NAME (if any)' WHEN 2 THEN 'Check Box22' ELSE 'Serial' END AS name",
        "CASE WHEN l_quantity > 10 THEN l_returnflag ELSE ' ' END AS value", "l_quantity > 25 AS checked", "CASE l_partkey % 4 WHEN 0 THEN 'Wine' WHEN 1 THEN 'Spirits' WHEN 2 THEN 'Malt Beverages' ELSE 'Off' END AS export",
    )
    return documents.form_values(widgets, "o_orderkey")


_BOX = "CASE WHEN c_custkey % 9 = k THEN NULL ELSE CAST(200 - (c_custkey * (k + 3)) % 40 AS DOUBLE) - CASE WHEN c_custkey % 3 = k THEN 15 ELSE 0 END END"
_OPTION = "CASE k WHEN 0 THEN 'wine' WHEN 1 THEN 'distilled spirits' ELSE CASE WHEN c_custkey % 17 = 0 THEN 'wine' ELSE 'malt beverage' END END"


def _boxes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return c.selectExpr("c_custkey", f"{_OPTION} AS option", f"{_BOX} AS luminance")


_SQL_TICKS = f"""x AS (SELECT c_custkey, {_OPTION} AS option, {_BOX} AS luminance FROM customer, (VALUES (0), (1), (2)) v(k)),
g AS (SELECT c_custkey, count(DISTINCT option) AS options, count(luminance) AS read, arg_min(option, (luminance, option)) AS darkest, min(luminance) AS least, list_sort(list(luminance) FILTER (luminance IS NOT NULL))[2] AS next FROM x GROUP BY 1),
ticks AS (SELECT *, CASE WHEN options < 3 THEN 'not_located' WHEN read < 3 THEN 'unreadable' WHEN next - least < 12 THEN 'too_close' ELSE 'ticked' END AS reason FROM g)"""


@query(f"WITH {_SQL_TICKS} SELECT c_custkey, CASE WHEN reason = 'ticked' THEN darkest END AS value, CASE WHEN reason IN ('ticked', 'too_close') THEN round(next - least, 1) END AS separation, reason FROM ticks")
def ticked_types(spark, sf_dir):
    """The product type whose box is clearly the darkest."""
    return documents.ticked(_boxes(spark, sf_dir), "c_custkey")


_TEXT_SIDE = [
    ("brand_name", "CASE WHEN c_custkey % 2 = 0 THEN c_name END", "CASE WHEN c_custkey % 4 = 0 THEN 'form_fields' ELSE 'embedded_text' END"),
    ("net_contents", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
    ("beverage_type", "CASE WHEN c_custkey % 5 < 3 THEN 'wine' END", "CASE WHEN c_custkey % 5 = 0 THEN 'form_fields' ELSE 'embedded_text' END"),
]
_SQL_TEXT = " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, {v} AS value, CASE WHEN {v} IS NOT NULL THEN {s} END AS source FROM customer" for f, v, s in _TEXT_SIDE)
_SQL_PANELS = " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, CASE WHEN (c_custkey + {r}) % 3 = 0 THEN concat('{f} ', {r}) END AS value, CAST((c_custkey * {r + 2}) % 5 AS DOUBLE) AS confidence, {r} AS rank FROM customer" for f in ("brand_name", "net_contents", "alcohol_content") for r in range(4))
_SQL_MERGED = f"""{_SQL_TICKS}, t AS ({_SQL_TEXT}), p AS (SELECT c_custkey, field, arg_max(value, (confidence, -rank)) AS value, arg_max(rank, (confidence, -rank)) AS rank FROM ({_SQL_PANELS}) WHERE value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT c_custkey, field, coalesce(t.value, p.value) AS value, CASE WHEN t.value IS NOT NULL THEN t.source WHEN p.value IS NOT NULL THEN 'embedded_artwork' END AS source, CASE WHEN t.value IS NULL THEN p.rank END AS panel FROM t FULL JOIN p USING (c_custkey, field)),
k AS (SELECT c_custkey, 'beverage_type' AS field, CASE WHEN reason = 'ticked' THEN darkest END AS tick, true AS sampled FROM ticks WHERE reason IN ('ticked', 'too_close')),
o AS (SELECT *, coalesce(sampled, false) AND (value IS NULL OR source = 'embedded_text') AS over FROM b FULL JOIN k USING (c_custkey, field)),
merged AS (SELECT * FROM (SELECT c_custkey, field, CASE WHEN over THEN tick ELSE value END AS value, CASE WHEN over THEN CASE WHEN tick IS NOT NULL THEN 'product_type_box' END ELSE source END AS source, CASE WHEN NOT over THEN panel END AS panel FROM o) WHERE value IS NOT NULL)"""


def _merged(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_paper_customers")
    of = lambda sql: spark.sql(sql.replace("FROM customer", "FROM _paper_customers"))
    return documents.merged(of(_SQL_TEXT), of(_SQL_PANELS), documents.ticked(_boxes(spark, sf_dir), "c_custkey"), "c_custkey")


@query(f"WITH {_SQL_MERGED} SELECT * FROM merged")
def document_values(spark, sf_dir):
    """A document's values: the text's, what its pictures add, and the ticked box."""
    return _merged(spark, sf_dir)


_FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "beverage_type")


@query(f"""WITH {_SQL_MERGED}, h AS (SELECT c_custkey, list(field) AS have, bool_or(source = 'embedded_artwork') AS own FROM merged GROUP BY 1)
SELECT c_custkey, array_to_string(list_concat([ 'no:' || f FOR f IN {list(_FIELDS)} IF NOT coalesce(list_contains(have, f), false)], list_filter([CASE WHEN c_custkey % 6 + c_custkey % 2 > 0 THEN 'budget' END, CASE WHEN own THEN 'self_consistency' END], lambda x: x IS NOT NULL)), ',') AS notes, c_custkey % 3 = 0 AND c_custkey % 4 = 0 AS pages FROM customer LEFT JOIN h USING (c_custkey)""")
def document_notes(spark, sf_dir):
    """What is to be said of a document, and whether its pages are read as pictures."""
    reads = made(spark, sf_dir, "customer", "c_custkey", "c_custkey % 6 AS pages_left", "c_custkey % 2 AS panels_left", "c_custkey % 3 AS in_form", "c_custkey % 4 AS in_text")
    out = documents.notes(_merged(spark, sf_dir), reads, _FIELDS, "c_custkey").select("c_custkey", F.array_join("notes", ",").alias("notes"))
    return out.join(reads.select("c_custkey", documents.needs_pages(F.col("in_form"), F.col("in_text")).alias("pages")), "c_custkey")


@query(f"""WITH {_SQL_MERGED} SELECT c_custkey, f.field FROM customer, (VALUES {', '.join(f"('{f}')" for f in _FIELDS[:4])}) f(field) WHERE c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.c_custkey = customer.c_custkey AND m.field = f.field)""")
def pending_fields(spark, sf_dir):
    items = made(spark, sf_dir, "customer", "c_custkey", "c_custkey % 2 = 1 AS artwork_read", "c_custkey % 3 AS pictures")
    return documents.pending(items, _merged(spark, sf_dir), _FIELDS[:4], "c_custkey")


_SHOWS = {"brand_name": "l_quantity > 20", "class_type": "l_discount > 0.02", "alcohol_content": "l_tax > 0.03", "net_contents": "l_returnflag = 'A'", "warning": "l_partkey % 2 = 0"}
_RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@query(f"""WITH p AS (SELECT l_orderkey, {_RANK} AS rank, {', '.join(f'{c} AS {n}' for n, c in _SHOWS.items())} FROM lineitem)
SELECT l_orderkey, rank, {' AND '.join(f'bool_or({n}) OVER w' for n in _SHOWS)} AS satisfies FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY rank)""")
def panels_satisfied(spark, sf_dir):
    """From which panel on everything has been seen."""
    panels = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_RANK} AS rank", *[f"{c} AS {n}" for n, c in _SHOWS.items()])
    return documents.satisfied(panels, "l_orderkey").select("l_orderkey", F.col("rank").cast("long").alias("rank"), "satisfies")


@query("""WITH w AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS t FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)),
  b AS (SELECT doc_id, i, t, i % 50 * 10 AS l, i // 50 * 20 + i % 7 AS top, i % 50 * 10 + 9 AS r, i // 50 * 20 + i % 7 + 8 AS z FROM w),
  n AS (SELECT *, lead(t) OVER o AS t2, lead(l) OVER o AS l2, lead(top) OVER o AS top2, lead(r) OVER o AS r2, lead(z) OVER o AS z2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS turn FROM n WHERE starts_with(lower(t), 'the') AND starts_with(lower(t2), 'th') AND abs(top - top2) <= 4)
  SELECT doc_id, least(l, l2) AS "left", least(top, top2) AS top, greatest(r, r2) AS "right", greatest(z, z2) AS bottom FROM h WHERE turn = 1""")
def caption_boxes(spark, sf_dir):
    """The box of the first run of words with given beginnings, in whole texts laid out fifty words a line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")).alias("i", "text"))
    line, place = F.floor(F.col("i") / 50) * 20 + F.col("i") % 7, F.col("i") % 50 * 10
    words = d.select("doc_id", F.col("i").alias("word_idx"), "text", place.cast("long").alias("left"), line.alias("top"), (place + 9).cast("long").alias("right"), (line + 8).alias("bottom"))
    return documents.caption_box(words, ("the", "th"), "doc_id")


_TYPED = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' - ', p_type) WHEN 1 THEN concat(p_size, ': ', p_name) WHEN 2 THEN concat('Type ', p_size, '-', p_type) ELSE concat(p_size, p_type) END"


@query(f"SELECT p_partkey, nullif(regexp_extract(t, '^\\s*(\\d{{1,4}})\\s*[-–:]\\s*(.+)$', 1), '') AS code, CASE WHEN regexp_matches(t, '^\\s*(\\d{{1,4}})\\s*[-–:]\\s*(.+)$') THEN trim(regexp_extract(t, '^\\s*(\\d{{1,4}})\\s*[-–:]\\s*(.+)$', 2)) ELSE t END AS name FROM (SELECT p_partkey, {_TYPED} AS t FROM part)")
def coded_types(spark, sf_dir):
    p = made(spark, sf_dir, "part", "p_partkey", f"{_TYPED} AS t")
    return p.select("p_partkey", documents.coded_type(F.col("t")).alias("c")).select("p_partkey", "c.*")


_BASIS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in documents.BASES.items())


@query(f"WITH s(basis, sentence) AS (VALUES {_BASIS}) SELECT page_id, sentence FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf_content' WHEN 1 THEN 'undecodable' WHEN 2 THEN 'captions' ELSE 'no_marks' END AS basis FROM pages) LEFT JOIN s USING (basis)")
def basis_sentences(spark, sf_dir):
    """Why files were taken for what they are, from their first bytes, text and captions."""
    k = F.col("page_id") % 4
    head = F.encode(F.when(k == 0, "%PDF-1.7").otherwise(F.substring("html", 1, 8)), "UTF-8")
    side = documents.file_side(F.lit("image/png"), head, F.regexp_replace("html", documents.MARKS, ""), k != 1, k == 2)
    named = F.create_map(*[F.lit(x) for pair in documents.BASES.items() for x in pair])
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(named, side["basis"]).alias("sentence"))


# --- boxes on a page of luminances -----------------------------------------------------------------------------------------

_WIDE, _HIGH = 64, 24
#: A page's words: three captions in a line, one of them missing, broken over two lines or at the page's edge by rule.
_CAPTIONS = [
    (0, "'TYPE'", "2", "1", "8", "4"), (1, "CASE WHEN c_custkey % 13 = 0 THEN 'VINE' ELSE 'Wine:' END", "CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 12 END", "8 + c_custkey % 5", "18", "11 + c_custkey % 5"),
    (2, "'DISTILLED'", "30", "9", "36", "12"), (3, "'(SPIRITS),'", "37", "9", "42", "12"), (4, "'distilled'", "32", "10", "38", "13"), (5, "'Spirits'", "39", "CASE WHEN c_custkey % 11 = 0 THEN 20 ELSE 10 END", "44", "13"),
    (6, "'MALT'", "54", "12", "58", "16"), (7, "'BEVERAGES'", "59", "12", "63", "16"),
]
_WORDS_SQL = " UNION ALL ".join(f"SELECT c_custkey, {i} AS word_idx, {t} AS text, CAST({a} AS INT) AS x_left, CAST({b} AS INT) AS y_top, CAST({c} AS INT) AS x_right, CAST({d} AS INT) AS y_bottom FROM customer" for i, t, a, b, c, d in _CAPTIONS)
_INK = "CASE WHEN c_custkey % 4 = CASE WHEN x < 16 THEN 0 WHEN x < 36 THEN 1 ELSE 2 END AND (x + y + c_custkey) % 3 = 0 THEN 60 ELSE 0 END"
_CELL = f"CAST(250 - (x * 7 + y * 3 + c_custkey) % 9 - {_INK} AS BIGINT)"
_STEMS = [("wine", ("wine",)), ("distilled spirits", ("distilled", "spirits")), ("malt beverage", ("malt", "beverage"))]
_RUNS = " UNION ALL ".join(
    f"SELECT c_custkey, '{option}' AS option, word_idx, l, t, r, b FROM (SELECT c_custkey, word_idx, " + (
        f"x_left AS l, y_top AS t, x_right AS r, y_bottom AS b FROM s WHERE starts_with(lower(text), '{stems[0]}'))" if len(stems) == 1 else
        f"least(x_left, l2) AS l, least(y_top, t2) AS t, greatest(x_right, r2) AS r, greatest(y_bottom, b2) AS b FROM s WHERE starts_with(lower(text), '{stems[0]}') AND starts_with(lower(n2), '{stems[1]}') AND abs(y_top - t2) <= greatest(y_bottom - y_top, b2 - t2) * 0.5)")
    for option, stems in _STEMS
)


@query(f"""WITH w AS (SELECT * REPLACE (regexp_replace(text, '^[ .:,]+|[ .:,]+$', '', 'g') AS text) FROM ({_WORDS_SQL})),
s AS (SELECT *, lead(text) OVER o AS n2, lead(x_left) OVER o AS l2, lead(y_top) OVER o AS t2, lead(x_right) OVER o AS r2, lead(y_bottom) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY c_custkey ORDER BY word_idx)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, option ORDER BY word_idx) AS k FROM ({_RUNS})) WHERE k = 1),
z AS (SELECT c_custkey, option, greatest(round_even(l - (b - t) * 0.25 - (b - t) * 2.4, 0), 0) AS x0, least(round_even(l - (b - t) * 0.25, 0), {_WIDE}) AS x1, greatest(round_even((t + b) / 2 - (b - t) * 1.2, 0), 0) AS y0, least(round_even((t + b) / 2 - (b - t) * 1.2 + (b - t) * 2.4, 0), {_HIGH}) AS y1 FROM f),
c AS (SELECT c_custkey, x, y, {_CELL} AS luminance FROM customer, range({_WIDE}) a(x), range({_HIGH}) e(y)),
m AS (SELECT z.c_custkey, option, avg(luminance) AS luminance FROM z LEFT JOIN c ON c.c_custkey = z.c_custkey AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2),
g AS (SELECT c_custkey, count(*) AS options, count(luminance) AS read, arg_min(option, (luminance, option)) AS darkest, min(luminance) AS least, list_sort(list(luminance) FILTER (luminance IS NOT NULL))[2] AS next FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN coalesce(options, 0) < 3 THEN 'not_located' WHEN read < 3 THEN 'unreadable' WHEN next - least < 12 THEN 'too_close' ELSE 'ticked' END AS reason FROM customer LEFT JOIN g USING (c_custkey))
SELECT c_custkey, CASE WHEN reason = 'ticked' THEN darkest END AS value, CASE WHEN reason IN ('ticked', 'too_close') THEN round(next - least, 1) END AS separation, reason FROM r""")
def ticked_pages(spark, sf_dir):
    """The ticked box of each page, from its captions' places and its luminances."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("_ticked_customers")
    words = spark.sql(_WORDS_SQL.replace("FROM customer", "FROM _ticked_customers")).withColumnsRenamed({"x_left": "left", "y_top": "top", "x_right": "right", "y_bottom": "bottom"})
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"))
    # dealt out by page before its cells are made, so that no cell is
    dealt = pages.select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    grid = dealt.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(_WIDE - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(_HIGH - 1))).alias("y"))
    return ticks.read(words, grid.selectExpr("c_custkey", "x", "y", f"{_CELL} AS luminance"), pages, "c_custkey")


# --- a document's text: its own words as values of captions ---------------------------------------------------------------

_TEXT_LINES = [
    "split_part(t, chr(10), 1)",
    "CASE doc_id % 4 WHEN 0 THEN concat('6. BRAND NAME (Required): ', split_part(t, ' ', 1)) ELSE 'Item 6) Brand  Name (Required)' END",
    "CASE doc_id % 4 WHEN 3 THEN ' ' ELSE split_part(t, ' ', 2) END",
    "CASE WHEN doc_id % 3 = 0 THEN concat(' : ', split_part(t, ' ', 3)) ELSE '7. FANCIFUL NAME (If any' END",
    "split_part(t, chr(10), 2)",
    "CASE doc_id % 5 WHEN 0 THEN 'CLASS/TYPE CODE' WHEN 1 THEN concat('Class or type code: ', doc_id % 900, ' x') ELSE 'STATUS : OPEN' END",
    "CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 700 AS STRING) ELSE 'Alcohol content' END",
    "concat(doc_id % 50, '% alc')",
    "CASE doc_id % 6 WHEN 0 THEN concat('Class/Type Description: ', doc_id % 1000, ' - ', lang, ' WINE') WHEN 1 THEN 'CLASS TYPE' ELSE concat('class / type designation: ', lang, CASE WHEN doc_id % 6 < 4 THEN ' of malt beverages' ELSE '' END) END",
    "concat(source, CASE WHEN doc_id % 7 = 0 THEN ' distilled spirits' ELSE ' house' END)",
    "CASE WHEN doc_id % 2 = 0 THEN 'NET CONTENTS 750 mL' ELSE split_part(t, ' ', 4) END",
]
_TEXT_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS line_idx, {e} AS text FROM (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents)" for i, e in enumerate(_TEXT_LINES))
_RESIDUE, _STOPS, _QUALIFIER, _CODED = (p.replace(r"\u2013", "–") for p in (documents.RESIDUE, documents.STOPS, documents.QUALIFIER, documents.CODED))
_TYPE = r"class(?:\s*/\s*|\s+(?:or\s+)?)type"
_CODED_TYPE = rf"(?i)^\s*{_TYPE}(?:\s+(?:description|designation))?\s*code\b"
_PATTERNS = {
    "brand_name": r"(?i)^\s*(?:item\s+)?(?:6\s*[.)]\s*)?brand\s+name\b", "fanciful_name": r"(?i)^\s*(?:item\s+)?(?:7\s*[.)]\s*)?fanciful\s+name\b", "class_type": rf"(?i)^\s*{_TYPE}\b",
    "class_type_code": _CODED_TYPE, "alcohol_content": r"(?i)^\s*alcohol\s+content\b", "net_contents": r"(?i)^\s*net\s+contents\b",
}
_BARE = rf"nullif(trim(regexp_replace(regexp_replace({{0}}, '{_RESIDUE}', ''), '^[\s:–-]+', '')), '')"
_OF = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _PATTERNS)
_HITS = " UNION ALL ".join(f"SELECT *, '{f}' AS field, regexp_replace(text, '{p}', '') AS rest FROM a WHERE regexp_matches(text, '{p}')" + (f" AND NOT regexp_matches(text, '{_CODED_TYPE}')" if f == "class_type" else "") for f, p in _PATTERNS.items())


@query(f"""WITH l AS ({_TEXT_SQL.replace('AS STRING', 'AS VARCHAR')}),
a AS (SELECT *, lead(text, 1) OVER w AS one, lead(text, 2) OVER w AS two FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)),
h AS (SELECT *, coalesce(trim(one) = '' OR regexp_matches(one, '{_STOPS}'), true) AS stop1, coalesce(trim(two) = '' OR regexp_matches(two, '{_STOPS}'), true) AS stop2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY line_idx) AS k FROM ({_HITS})) WHERE k = 1),
v AS (SELECT doc_id, field, coalesce({_BARE.format(f"regexp_replace(rest, '{_QUALIFIER}', '')")}, CASE WHEN NOT stop1 THEN {_BARE.format("trim(one) || CASE WHEN stop2 THEN '' ELSE ' ' || trim(two) END")} END) AS value FROM h),
o AS (SELECT doc_id, {_OF} FROM v GROUP BY 1),
s AS (SELECT doc_id, bool_or(regexp_matches(text, '(?i)\\bwines?\\b')) AS w, bool_or(regexp_matches(text, '(?i)\\bdistilled\\s+spirits\\b')) AS d, bool_or(regexp_matches(text, '(?i)\\bmalt\\s+beverages?\\b')) AS m FROM l GROUP BY 1),
b AS (SELECT *, CASE WHEN w::INT + d::INT + m::INT = 1 THEN CASE WHEN w THEN 'wine' WHEN d THEN 'distilled spirits' ELSE 'malt beverage' END END AS beverage_type FROM s LEFT JOIN o USING (doc_id))
SELECT doc_id, brand_name, fanciful_name, CASE WHEN regexp_matches(class_type, '{_CODED}') THEN trim(regexp_extract(class_type, '{_CODED}', 2)) ELSE class_type END AS class_type, coalesce(nullif(regexp_extract(class_type, '{_CODED}', 1), ''), nullif(regexp_extract(class_type_code, '^(\\d{{1,4}})\\b', 1), '')) AS class_type_code, alcohol_content, net_contents, beverage_type,
  coalesce(brand_name, fanciful_name, class_type, alcohol_content, net_contents, beverage_type) IS NOT NULL AS found, CASE WHEN doc_id % 9 = 0 THEN 'undecodable' WHEN coalesce(brand_name, fanciful_name, class_type, alcohol_content, net_contents, beverage_type) IS NOT NULL THEN 'captions' ELSE 'no_marks' END AS basis FROM b""")
def document_texts(spark, sf_dir):
    """The values that a document's captions have in its own text, its code and type, and what it is taken for by them."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_captioned_documents")
    lines = spark.sql(_TEXT_SQL.replace("FROM documents", "FROM _captioned_documents"))
    values = documents.text_values(lines, "doc_id")
    side = documents.file_side(F.lit("image/png"), F.lit(None).cast("binary"), F.lit(""), F.col("doc_id") % 9 != 0, F.col("found"))
    return values.withColumn("basis", side["basis"])
