"""Queries of items: search, decisions field by field, and the statement's check over lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..functions.register import register
from ..functions.similarity import lcs_length_udf
from ..operators import item, layout, merge, search, statement
from ..vocab import COMPARED, STATEMENT_BODY, STATEMENT_PREFIX, UNITS
from .catalog import SQL_ABV, SQL_NET
from .registry import made, query, sql_abv, sql_lcs, sql_missing, sql_net, sql_normalized, sql_verified, table

# --- items: made from parts, by expressions that the oracle shares; what is decided of them is computed by either side ---

_SIDE = "CASE WHEN p_partkey % 3 = 0 THEN 'application_artwork' ELSE 'uploaded_photographs' END"
_DECLARED = {
    "brand_name": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN translate(p_name, 'e', 'c') WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(p_type, ' other') ELSE p_name END",
    "class_type": "CASE p_partkey % 5 WHEN 0 THEN concat(p_type, ' FB1') WHEN 1 THEN ' ' ELSE concat(p_type, ' ', p_brand) END",
    "alcohol_content": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(p_size, ' percent') WHEN 2 THEN p_type ELSE concat(p_size + 1, '%') END",
    "net_contents": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat(p_size, ' L') WHEN 2 THEN lower(p_type) ELSE concat(p_size, ' mL') END",
}
_SOURCE = "CASE WHEN p_partkey % 9 < 5 THEN 'parsed_from_artwork' ELSE 'typed' END"
_VALUES = {
    "brand_name": "CASE WHEN p_partkey % 8 < 6 THEN p_name END",
    "class_type": "CASE WHEN p_partkey % 8 < 5 THEN p_type END",
    "alcohol_content": "CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN concat(p_size, '% (', 2 * p_size + 2, ' proof)') WHEN 2 THEN '12 to 14%' WHEN 3 THEN 'strong stuff' ELSE concat(p_size, '% alc/vol (', 2 * p_size, ' Proof)') END",
    "net_contents": "CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN p_type WHEN 3 THEN concat(p_size, ' fl oz') WHEN 4 THEN NULL ELSE concat(p_size, ' ML') END",
}
_UNITS = (
    (0, 0, "concat('the fine ', p_name)"),
    (0, 1, "concat(p_type, ' ', p_brand, ' ', p_size, ' mL')"),
    (1, 0, "concat(translate(p_name, 'o', '0'), ' label')"),
)
_KEPT = "p_partkey % 13 <> 0"  # others have no text at all


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_SQL_DECLARED = _union([f"SELECT p_partkey AS item_id, '{f}' AS field, {e} AS declared, {_SOURCE} AS source FROM part" for f, e in _DECLARED.items()])
_SQL_VALUES = _union([f"SELECT p_partkey AS item_id, '{f}' AS field, {e} AS value, 0 AS sheet, 0 AS region_column, 5 AS block, p_partkey % 8 >= 6 AS declined FROM part" for f, e in _VALUES.items()])
_SQL_UNITS = _union([f"SELECT p_partkey AS item_id, {s} AS sheet, {u} AS unit, {u} AS region_column, {s} AS block, {e} AS text FROM part WHERE {_KEPT}" for s, u, e in _UNITS])


def _inputs(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_item_parts")
    of = lambda sql: spark.sql(sql.replace("FROM part", "FROM _item_parts")).withColumnsRenamed({"region_column": "column"})
    return of(f"SELECT p_partkey AS item_id, {_SIDE} AS side FROM part"), of(_SQL_DECLARED), of(_SQL_VALUES), of(_SQL_UNITS)


def _decided(spark, sf_dir):
    return item.decided(*_inputs(spark, sf_dir), common=lcs_length_udf(spark))


_ASKED = f"""SELECT item_id, field, trim(said) AS needle FROM rows_ WHERE NOT {sql_missing('said')} AND (field IN ('brand_name', 'class_type') OR field = 'net_contents' AND value IS NULL)"""
#: From items, declared_, values_ and units_ to `decided`.
_DECIDE = f"""rows_ AS (SELECT *, CASE WHEN NOT (own AND field IN ('alcohol_content', 'net_contents')) THEN declared END AS said FROM (SELECT *, side = 'application_artwork' AND source = 'parsed_from_artwork' AS own FROM items JOIN declared_ USING (item_id) JOIN values_ USING (item_id, field))),
{sql_verified('f', f'SELECT item_id, field, sheet, needle, unit, text FROM ({_ASKED}) JOIN units_ USING (item_id)', 'item_id, field, sheet', "field = 'class_type'")},
best AS (SELECT f.* EXCLUDE (unit), u.region_column AS hit_column, u.block AS hit_block FROM (SELECT *, row_number() OVER (PARTITION BY item_id, field ORDER BY coalesce(score, -1) DESC, sheet) AS turn FROM f) f LEFT JOIN units_ u ON u.item_id = f.item_id AND u.sheet = f.sheet AND u.unit = f.unit WHERE turn = 1),
seen AS (SELECT r.*, b.hit, b.score AS hit_score, b.outcome AS hit_outcome, b.sheet AS hit_sheet, hit_column, hit_block, b.item_id IS NOT NULL AND r.field IN ('brand_name', 'class_type') AS searched, coalesce(r.field = 'net_contents' AND b.score >= 95, false) AS rescued FROM rows_ r LEFT JOIN best b ON b.item_id = r.item_id AND b.field = r.field),
label AS (SELECT *, CASE WHEN searched THEN CASE WHEN hit_outcome <> 'mismatch' THEN hit END WHEN rescued THEN hit ELSE value END AS label_value FROM seen),
normed AS (SELECT *, {sql_normalized('label_value')} AS na, {sql_normalized('said')} AS nb FROM label),
{sql_lcs('t', 'SELECT na AS a, nb AS b FROM normed')},
scored AS (SELECT n.*, 2.0 * lcs / nullif(length(na) + length(nb), 0) * 100 AS raw FROM normed n LEFT JOIN t ON t.a = na AND t.b = nb),
texts AS (SELECT *, CASE WHEN {sql_missing('said')} THEN {{'outcome': 'not_compared', 'score': NULL::DOUBLE, 'code': 'undeclared'}} WHEN {sql_missing('label_value')} THEN {{'outcome': 'mismatch', 'score': NULL, 'code': 'absent'}} WHEN na = '' OR nb = '' THEN {{'outcome': 'needs_review', 'score': NULL, 'code': 'no_text'}}
  ELSE {{'outcome': CASE WHEN raw >= 95 THEN 'match' WHEN raw >= 80 THEN 'needs_review' ELSE 'mismatch' END, 'score': round(raw, 1), 'code': 'text'}} END AS x FROM scored),
parsed AS (SELECT * EXCLUDE (declared), said AS declared, label_value AS label FROM texts),
judged AS (SELECT *, CASE WHEN searched THEN {{'outcome': hit_outcome, 'score': hit_score, 'code': CASE WHEN hit_score IS NULL THEN 'no_text' WHEN hit_outcome = 'match' THEN 'found' WHEN hit_outcome = 'mismatch' THEN 'not_found' ELSE 'close' END}}
  WHEN field = 'alcohol_content' THEN (SELECT {SQL_ABV.replace('$text', 'x.score')} FROM (SELECT {sql_abv('label')} AS v, {sql_abv('declared')} AS s)) WHEN field = 'net_contents' THEN (SELECT {SQL_NET.replace('$outcome', 'x.outcome').replace('$score', 'x.score')} FROM (SELECT {sql_net('label', UNITS)} AS v, {sql_net('declared', UNITS)} AS s)) ELSE x END AS r FROM parsed),
decided AS (SELECT item_id, field, CASE WHEN own AND r.outcome = 'match' THEN 'artwork_derived' ELSE r.outcome END AS outcome, CASE WHEN NOT (own AND r.outcome = 'match') THEN r.score END AS score,
  CASE WHEN declined AND NOT searched AND NOT rescued THEN 'declined' WHEN own AND r.outcome = 'match' THEN 'artwork' ELSE r.code END AS code, label_value, CASE WHEN NOT {sql_missing('said')} THEN said END AS declared,
  CASE WHEN searched THEN CASE WHEN hit_outcome <> 'mismatch' THEN hit_sheet END WHEN rescued THEN hit_sheet ELSE sheet END AS sheet, CASE WHEN searched THEN CASE WHEN hit_outcome <> 'mismatch' THEN hit_column END WHEN rescued THEN hit_column ELSE region_column END AS "column", CASE WHEN searched THEN CASE WHEN hit_outcome <> 'mismatch' THEN hit_block END WHEN rescued THEN hit_block ELSE block END AS block FROM judged)"""
_DECISIONS = f"""items AS (SELECT p_partkey AS item_id, {_SIDE} AS side FROM part), declared_ AS ({_SQL_DECLARED}), values_ AS ({_SQL_VALUES}), units_ AS ({_SQL_UNITS}), {_DECIDE}"""


@query(f"WITH RECURSIVE {_DECISIONS} SELECT * FROM decided")
def item_verdicts(spark, sf_dir):
    """The field decisions of an item for each part, from its declared values, its merged readings and its sheets' text."""
    return _decided(spark, sf_dir)


@query(f"""WITH RECURSIVE {_DECISIONS}, s AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN 'match' ELSE 'not_certified' END AS statement FROM part)
SELECT item_id, {', '.join(f"max(outcome) FILTER (field = '{f}') AS {f}" for f in COMPARED)}, any_value(statement) AS statement, count(*) AS n, max(label_value) FILTER (field = 'net_contents') AS contents FROM decided JOIN s USING (item_id) GROUP BY item_id""")
def item_results(spark, sf_dir):
    """Result objects, read again from their JSON."""
    said = made(spark, sf_dir, "part", "p_partkey AS item_id", "CASE WHEN p_size % 2 = 0 THEN 'match' ELSE 'not_certified' END AS outcome")
    out = item.results(_decided(spark, sf_dir), said)
    back = F.from_json("result", "item_id long, fields array<struct<field:string,outcome:string,score:double,code:string,label_value:string,declared:string>>, statement string")
    return out.select(back.alias("r")).select("r.item_id", *[F.col("r.fields")[i]["outcome"].alias(f) for i, f in enumerate(COMPARED)], "r.statement", F.size("r.fields").cast("long").alias("n"), F.col("r.fields")[3]["label_value"].alias("contents"))


_TYPED = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '  ' END"
_PAPER = "CASE WHEN p_partkey % 5 <> 0 THEN p_type END"
_FROM = "CASE p_partkey % 6 WHEN 0 THEN 'form_fields' WHEN 1 THEN 'embedded_text' WHEN 2 THEN 'embedded_artwork' WHEN 3 THEN 'product_type_box' WHEN 4 THEN 'embedded_text' ELSE 'form_fields' END"


@query(f"""SELECT p_partkey, CASE WHEN trim(t) <> '' THEN t WHEN trim(d) <> '' AND NOT c THEN d END AS value, CASE WHEN trim(t) <> '' THEN 'typed' WHEN trim(d) <> '' AND NOT c THEN CASE f WHEN 'embedded_artwork' THEN 'parsed_from_artwork' WHEN 'product_type_box' THEN 'read_from_tick' ELSE 'parsed_from_form' END ELSE 'absent' END AS source,
  CASE WHEN pictures > 0 THEN 'uploaded_photographs' WHEN panels > 0 THEN 'application_artwork' END AS side FROM (SELECT p_partkey, {_TYPED} AS t, {_PAPER} AS d, {_FROM} AS f, p_partkey % 7 = 0 AS c, p_partkey % 3 AS pictures, p_partkey % 2 AS panels FROM part)""")
def resolved_values(spark, sf_dir):
    p = made(spark, sf_dir, "part", "p_partkey", f"{_TYPED} AS t", f"{_PAPER} AS d", f"{_FROM} AS f", "p_partkey % 7 = 0 AS c", "p_partkey % 3 AS pictures", "p_partkey % 2 AS panels")
    return p.select("p_partkey", item.resolved(F.col("t"), F.col("d"), F.col("f"), F.col("c")).alias("r"), item.label_side(F.col("pictures"), F.col("panels")).alias("side")).select("p_partkey", "r.*", "side")


@query(f"""WITH d AS ({_SQL_VALUES}) SELECT item_id, field, any_value(value) IS NULL AND bool_or(declined) AS declined FROM d GROUP BY 1, 2""")
def declined_fields(spark, sf_dir):
    return merge.declined(_inputs(spark, sf_dir)[2], "item_id", "field")


@query("""WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'unreadable_image' WHEN 'purchase' THEN 'no_text_found' WHEN 'signup' THEN 'no_text_found' WHEN 'view' THEN CASE WHEN value > 100 THEN 'no_text_found' END ELSE 'unreadable_image' END AS error, event_id % 500 AS part FROM events)
  SELECT user_id, part, CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN CASE WHEN count(*) = 1 THEN any_value(error) ELSE 'all_photos_unreadable' END END AS error, CASE WHEN count(*) FILTER (error IS NULL) = 0 AND count(*) > 1 THEN CASE WHEN count(DISTINCT error) = 1 THEN any_value(error) ELSE 'mixed' END END AS detail FROM r GROUP BY 1, 2""")
def sheet_errors(spark, sf_dir):
    error = "CASE event_type WHEN 'error' THEN 'unreadable_image' WHEN 'purchase' THEN 'no_text_found' WHEN 'signup' THEN 'no_text_found' WHEN 'view' THEN CASE WHEN value > 100 THEN 'no_text_found' END ELSE 'unreadable_image' END AS error"
    return merge.combined_error(made(spark, sf_dir, "events", "user_id", "event_id % 500 AS part", error), "user_id", "part")


_MATRIX = "CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 3 END AS DOUBLE) AS a, CAST(CASE event_id % 5 WHEN 1 THEN 2 WHEN 3 THEN -2 WHEN 4 THEN value / 1000 ELSE 0 END AS DOUBLE) AS b, CAST(CASE event_id % 5 WHEN 1 THEN -2 WHEN 3 THEN 2 WHEN 4 THEN -value / 1000 ELSE 0 END AS DOUBLE) AS c, CAST(CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 4 = 0 THEN -2 ELSE 2 END WHEN 2 THEN -1 WHEN 4 THEN 3 ELSE 0 END AS DOUBLE) AS d, CAST(event_id % 4 * 90 AS INT) AS turned"


@query(f"""SELECT event_id, CASE WHEN a * d - b * c > 0 AND abs(g - t * 90) <= 1 AND abs(((g - o + 180) % 360 + 360) % 360 - 180) <= 1 THEN (((t + turned // 90) % 4 + 4) % 4)::INT END AS turns FROM (SELECT *, round_even(g / 90, 0) AS t FROM (SELECT *, degrees(atan2(b, a)) AS g, degrees(atan2(-c, d)) AS o FROM (SELECT event_id, {_MATRIX} FROM events)))""")
def quarter_turns(spark, sf_dir):
    from .catalog import _split

    m = made(spark, sf_dir, "events", "event_id", *_split(_MATRIX))
    return m.select("event_id", merge.quarter_turn(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("turned")).alias("turns"))


# --- the statement over lines -------------------------------------------------------------------------------------------

_W = STATEMENT_BODY.split()
_CUTS = [_W[:9], _W[9:21], _W[21:29], _W[29:]]
_PIECES = [" ".join(c) for c in _CUTS]
#: Lines by rule: a prefix whole, in title case, damaged or absent; a word misspelt; a hyphenated line; another text.
_HEAD = f"CASE item_id % 7 WHEN 0 THEN 'Government Warning:' WHEN 1 THEN 'G0VERNM WARNING' WHEN 2 THEN '12345' ELSE '{STATEMENT_PREFIX}' END"
_L1, _L2, _L3, _L4 = (
    f"CASE WHEN item_id % 5 = 0 THEN replace('{_PIECES[0]}', 'women', 'worn-') ELSE '{_PIECES[0]}' END",
    f"CASE item_id % 6 WHEN 0 THEN replace('{_PIECES[1]}', 'drink', 'drnk') WHEN 1 THEN replace('{_PIECES[1]}', 'birth', 'brth defcts') WHEN 2 THEN upper('{_PIECES[1]}') ELSE '{_PIECES[1]}' END",
    f"replace('{_PIECES[2]}', 'impairs', CASE WHEN item_id % 4 = 0 THEN 'im-' ELSE 'impairs' END)",
    f"CASE WHEN item_id % 9 = 0 THEN concat('and may cost you ', item_id, ' of them') WHEN item_id % 4 = 0 THEN concat('{_PIECES[3]}', '') ELSE '{_PIECES[3]}' END",
)
_LINES = ["substring(text, 1, 40)", _HEAD, "'***'", _L1, _L2, _L3, _L4, "concat('bottled by ', item_id)"]
_CONF = "CAST(CASE WHEN (item_id + line_idx) % 3 = 0 THEN 50 WHEN item_id % 2 = 0 THEN 60 ELSE 90 END AS DOUBLE)"
_STATEMENT_LINES = _union([f"SELECT item_id, {i} AS line_idx, {e} AS text FROM benchmark" for i, e in enumerate(_LINES)])


def _statement_lines(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("_statement_items")
    return spark.sql(f"SELECT *, {_CONF} AS confidence FROM ({_STATEMENT_LINES.replace('FROM benchmark', 'FROM _statement_items')})")


_SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_REJOIN = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_])[-‐‑]\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
_OPEN, _GO = r"(?i)according\s+to\s+the|surgeon\s+general", r"(?i)surgeon\s+general|should\s+not\s+drink|birth\s+defects|alcoholic\s+beverages"


#: From lines l to the check of each item's statement, v.
_SQL_STATEMENT = rf"""a AS (SELECT *, concat_ws(' ', text, lead(text, 1) OVER w, lead(text, 2) OVER w) AS ahead FROM l WINDOW w AS (PARTITION BY item_id ORDER BY line_idx)),
f AS (SELECT item_id, coalesce(min(line_idx) FILTER (regexp_matches(text, '(?i)government\s+warning\s*:?')), min(line_idx) FILTER (regexp_matches(text, '(?i)\bwarning\b') AND regexp_matches(ahead, '{_OPEN}') AND regexp_matches(ahead, '{_GO}')), min(line_idx) FILTER (regexp_matches(text, '{_OPEN}') AND regexp_matches(ahead, '{_GO}'))) AS first FROM a GROUP BY 1),
k AS (SELECT l.*, string_agg(text, chr(10)) OVER (PARTITION BY item_id ORDER BY line_idx) AS so_far FROM l JOIN f USING (item_id) WHERE line_idx >= first AND regexp_matches(text, '\p{{L}}')),
z AS (SELECT *, length({_SPACE.format(_REJOIN.format('so_far'))}) AS size FROM k),
e AS (SELECT item_id, coalesce(min(line_idx) FILTER (size >= {len(STATEMENT_PREFIX) + 1 + len(STATEMENT_BODY)}), max(line_idx)) AS last FROM z GROUP BY 1),
b AS (SELECT item_id, z.so_far AS t FROM z JOIN e USING (item_id) WHERE line_idx = last),
g AS (SELECT item_id, count(*) FILTER (d) AS differing, count(*) FILTER (d AND confidence > 0 AND confidence < 80) AS illegible FROM (SELECT k.*, NOT contains(lower('{STATEMENT_PREFIX} {STATEMENT_BODY}'), trim(regexp_replace(lower({_SPACE.format('text')}), '[-‐‑]+$', ''))) AS d FROM k JOIN e USING (item_id) WHERE line_idx <= last) GROUP BY 1),
p AS (SELECT *, coalesce(regexp_matches(t, '(?i)government\s+warning\s*:?'), false) AS legible, regexp_extract(t, '(?i)(government\s+warning)\s*:?', 1) AS prefix, regexp_extract(t, '(?is)^(.*?)((?:\(\s*1\s*\)\s*)?according\s+to\s+the|surgeon\s+general)(.*)$', ['before', 'opening', 'after']) AS o FROM (SELECT DISTINCT item_id FROM l) LEFT JOIN b USING (item_id)),
q AS (SELECT *, coalesce(o.opening <> '' AND regexp_matches(substr(o.after, 1, 200), '(?is)^.{{0,160}}?(?:{_GO[4:]})'), false) AS opened, regexp_extract(o.before, '([^\n]*)$', 1) AS line FROM p),
r AS (SELECT *, legible OR opened AS found, CASE WHEN legible THEN regexp_extract(t, '(?is)government\s+warning\s*:?(.*)$', 1) WHEN opened THEN (CASE WHEN regexp_matches(line, '(?is)^.*\bwarning\s*:?(.*)$') AND length(regexp_extract(line, '(?is)^.*\bwarning\s*:?(.*)$', 1)) <= 40 THEN regexp_extract(line, '(?is)^.*\bwarning\s*:?(.*)$', 1) ELSE '' END) || o.opening || o.after ELSE '' END AS rest FROM q),
s AS (SELECT *, CASE WHEN legible THEN upper(prefix) = prefix END AS prefix_upper, lower({_SPACE.format(_REJOIN.format('rest'))}) AS seen, lower('{STATEMENT_BODY}') AS want FROM r),
u AS (SELECT *, found AND seen = want AS exact, CASE WHEN seen = want THEN 0 ELSE levenshtein(seen, want) END AS distance FROM s),
v AS (SELECT *, found AND NOT exact AND distance BETWEEN 1 AND {DEFAULT.near_miss_edits} AS near_miss FROM u LEFT JOIN g USING (item_id))"""
_SQL_STATEMENT_OUTCOME = "CASE WHEN exact AND prefix_upper THEN 'match' WHEN near_miss AND prefix_upper THEN 'needs_review' WHEN found AND (NOT exact OR prefix_upper IS NULL) AND NOT near_miss AND differing > 0 AND differing = illegible THEN 'not_certified' ELSE 'mismatch' END"


@query(rf"""WITH l AS (SELECT *, {_CONF} AS confidence FROM ({_STATEMENT_LINES})),
{_SQL_STATEMENT}
SELECT item_id, found, prefix_upper, exact, CASE WHEN found THEN distance END AS distance, near_miss, {_SQL_STATEMENT_OUTCOME} AS outcome FROM v""")
def statement_lines(spark, sf_dir):
    """The statement's check from lines with confidences: its first line, its block, its legibility and its outcome."""
    return statement.judged(_statement_lines(spark, sf_dir), "item_id")


@query("SELECT conv_id, \"column\", block, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS unit, text FROM (SELECT conv_id, turn % 2 AS \"column\", length(text) % 3 AS block, min(turn) AS first, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2, 3) WHERE regexp_matches(text, '[^\\s\\p{P}]')")
def label_units(spark, sf_dir):
    lines = made(spark, sf_dir, "conversations", "conv_id", "turn % 2 AS column", "length(text) % 3 AS block", "turn AS line_idx", "text").where("text IS NOT NULL")
    return search.units(lines, "conv_id").withColumn("unit", F.col("unit").cast("long"))


@query(r"SELECT doc_id, regexp_replace(text, '([\p{L}\p{N}_])[-‐‑]\s+([\p{L}\p{N}_])', '\1\2', 'g') AS joined, length(lower(text)) AS size FROM documents")
def folded_texts(spark, sf_dir):
    """Whole texts with line-break hyphens rejoined, and the length that lower-casing keeps."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.rejoined_hyphens(F.col("text")).alias("joined"), F.length(F.lower("text")).cast("long").alias("size"))


@query(f"SELECT p_partkey, {sql_normalized('p_name')} AS norm, regexp_extract(p_brand, '^[^#]*', 0) = 'Brand' AS brand, CASE WHEN p_type = 'PROMO' THEN 100.0 ELSE NULL END AS same FROM part")
def sql_functions(spark, sf_dir):
    """The registered functions from SQL."""
    register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("_function_parts")
    return spark.sql("SELECT p_partkey, lw_normalized(p_name) AS norm, lw_stem(concat('x/', lower(p_brand), '.png')) LIKE 'brand#%' AS brand, CASE WHEN p_type = 'PROMO' THEN lw_ratio(p_name, p_name) END AS same FROM _function_parts")


# --- blocks, fields by size ---------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber AS line_idx, max(l_quantity) AS height, 20 * l_linenumber AS top, max(l_partkey) % 2 AS col, max(l_suppkey) % 2 AS block, concat('t', max(l_partkey)) AS text, max(l_tax) * 1000 AS confidence, max(l_discount) >= 0.09 AS claimed"


def _sized(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_sized_lines")
    return spark.sql(f"SELECT {_LINE} FROM _sized_lines GROUP BY l_orderkey, l_linenumber").withColumnRenamed("col", "column")


#: From unclaimed lines k to blocks b.
_SQL_JOINED = """p AS (SELECT *, CASE WHEN line_idx = lag(line_idx) OVER w + 1 AND col = lag(col) OVER w AND block = lag(block) OVER w AND least(height, lag(height) OVER w) > 0 AND abs(height - lag(height) OVER w) <= 0.25 * greatest(height, lag(height) OVER w) AND top - lag(top) OVER w <= 2.5 * greatest(height, lag(height) OVER w) THEN 0 ELSE 1 END AS s FROM k WINDOW w AS (PARTITION BY l_orderkey ORDER BY line_idx)),
g AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY line_idx) AS island FROM p),
b AS (SELECT l_orderkey, island, min(line_idx) AS first_line, string_agg(text, ' ' ORDER BY line_idx) AS text, max(height) AS height, min(top) AS top, round(avg(confidence), 1) AS confidence, min(col) AS col, min(block) AS block FROM g GROUP BY 1, 2)"""
_SQL_BLOCKS = f"""l AS (SELECT {_LINE} FROM lineitem GROUP BY l_orderkey, l_linenumber), k AS (SELECT * FROM l WHERE NOT claimed), {_SQL_JOINED}"""


@query(f"""WITH {_SQL_BLOCKS}, r AS (SELECT *, row_number() OVER w AS turn, lead(height) OVER w AS next FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY height DESC, top, first_line)),
f AS (SELECT * FROM r WHERE turn = 1 AND (next IS NULL OR height <= 0 OR next <= 0.7 * height)), r2 AS (SELECT *, row_number() OVER w AS turn2, lead(height) OVER w AS next2 FROM r WHERE turn > 1 AND l_orderkey IN (SELECT l_orderkey FROM f) WINDOW w AS (PARTITION BY l_orderkey ORDER BY height DESC, top, first_line)),
s AS (SELECT * FROM r2 WHERE turn2 = 1 AND (next2 IS NULL OR height <= 0 OR next2 <= 0.7 * height)), o AS (SELECT DISTINCT l_orderkey FROM l)
SELECT o.l_orderkey, 'brand_name' AS field, f.text, f.text IS NULL AND o.l_orderkey IN (SELECT l_orderkey FROM b) AS declined FROM o LEFT JOIN f USING (l_orderkey) UNION ALL SELECT o.l_orderkey, 'class_type', s.text, s.text IS NULL AND o.l_orderkey IN (SELECT l_orderkey FROM r2 UNION SELECT l_orderkey FROM b WHERE l_orderkey NOT IN (SELECT l_orderkey FROM f)) FROM o LEFT JOIN s USING (l_orderkey)""")
def field_blocks(spark, sf_dir):
    """Brand and class by size: unclaimed lines, their blocks, and those that stand out."""
    rows = _sized(spark, sf_dir)
    found = layout.blocks(layout.unclaimed(rows, [rows.where("claimed")], "l_orderkey"), "l_orderkey")
    return layout.two_fields(found, rows.select("l_orderkey").distinct(), "l_orderkey").select("l_orderkey", "field", "text", "declined")


@query(f"""SELECT l_orderkey, count(DISTINCT col) AS columns, count(DISTINCT (col, block)) AS regions, count(*) AS n_lines, round(coalesce(avg(confidence), 0), 1) AS confidence FROM (SELECT {_LINE} FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1""")
def segmentations(spark, sf_dir):
    return layout.segmentation(_sized(spark, sf_dir), "l_orderkey")


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), 0), 1) AS confidence FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def item_confidences(spark, sf_dir):
    sheets = made(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value AS confidence", "CASE WHEN event_type = 'error' THEN 'no_text_found' END AS error").where("event_type IN ('error', 'view')")
    return layout.item_confidence(sheets, "user_id", order="event_id")


@query("""WITH b AS (SELECT l_orderkey AS sheet, l_linenumber, (l_partkey % 997)::INT AS l, (l_partkey % 997)::INT + l_quantity::INT AS r FROM lineitem) SELECT sheet, l_linenumber, l AS "left", CASE WHEN (l + r) / 2 < 300 THEN 0 WHEN (l + r) / 2 < 700 THEN 1 ELSE 2 END AS "column" FROM b""")
def placed_words(spark, sf_dir):
    """Words in given columns; what lies beyond the last one is in it."""
    words = made(spark, sf_dir, "lineitem", "l_orderkey AS sheet", "l_linenumber", "CAST(l_partkey % 997 AS INT) AS left", "CAST(l_partkey % 997 AS INT) + CAST(l_quantity AS INT) AS right")
    cols = words.select("sheet").distinct().select("sheet", F.posexplode(F.array(*[F.struct(F.lit(a).alias("col_left"), F.lit(b).alias("col_right")) for a, b in ((0, 300), (300, 700), (700, 900))])).alias("column", "c")).select("sheet", "column", "c.*")
    return layout.placed(words, cols, "sheet").select("sheet", "l_linenumber", "left", "column")
