"""Queries of batches on their way: rows that fail, refused batches, counters, broken streams, and tallies of every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdict
from ..functions.text import without_code
from ..operators import batch, guarded, progress
from ..vocab import OUTCOMES, ROLL_UP
from .batches import _SQL_LINES, _lines
from .registry import made, query, sql_missing, table

#: A row's line of JSON: whole, cut off, no object, without a name, or with a type, size or word that can't be used.
_WORDS = """concat('[{"text": "', event_type, '", "height": ', user_id % 50, '}, {"text": "x", "height": ', CASE WHEN event_id % 13 = 4 THEN '"tall"' ELSE '7.5' END, '}]')"""
_OBJECT = f"""concat('{{"file": ', CASE WHEN event_id % 17 = 3 THEN 'null' ELSE concat('"f', event_id, '.png"') END, ', "type": "', CASE WHEN event_id % 19 = 5 THEN 'text/plain' ELSE 'image/png' END, '", "size": ', CASE WHEN event_id % 11 = 2 THEN '"large"' WHEN event_id % 23 = 1 THEN '99000000' ELSE CAST(user_id AS STRING) END, ', "words": ', CASE WHEN event_id % 29 = 6 THEN '"none"' ELSE {_WORDS} END, '}}')"""
_LINE = f"CASE WHEN event_id % 31 = 7 THEN NULL WHEN event_id % 37 = 8 THEN 'no json' WHEN event_id % 41 = 9 THEN substring({_OBJECT}, 1, CAST(20 + event_id % 30 AS INT)) ELSE {_OBJECT} END"


@query(f"""WITH e AS (SELECT user_id, event_id AS position, {_LINE.replace('AS STRING', 'AS VARCHAR')} AS line FROM events),
p AS (SELECT *, coalesce(json_valid(line) AND starts_with(trim(line), '{{'), false) AS whole FROM e),
v AS (SELECT *, CASE WHEN whole THEN json_extract_string(line, '$.file') END AS file, CASE WHEN whole THEN json_extract_string(line, '$.type') END AS type, CASE WHEN whole THEN json_extract_string(line, '$.size') END AS size, CASE WHEN whole THEN json_extract(line, '$.words') END AS words FROM p),
w AS (SELECT *, CASE WHEN json_type(words) = 'ARRAY' THEN [{{'t': json_extract_string(x, '$.text'), 'h': CASE WHEN regexp_full_match(json_extract_string(x, '$.height'), '\\d+(\\.\\d+)?') THEN try_cast(json_extract_string(x, '$.height') AS DOUBLE) END}} FOR x IN json_extract(words, '$[*]')] END AS own FROM v),
x AS (SELECT *, CASE WHEN NOT whole THEN 'unreadable_line' WHEN coalesce(trim(file), '') = '' THEN 'no_name' WHEN NOT coalesce(regexp_full_match(size, '\\d{{1,18}}'), false) THEN 'unreadable_size' WHEN type NOT IN ('image/jpeg', 'image/png', 'image/webp', 'image/tiff', 'application/pdf') THEN 'unsupported_media_type' WHEN try_cast(size AS BIGINT) > 10485760 THEN 'file_too_large'
  WHEN own IS NULL OR len(list_filter(own, lambda k: k.t IS NULL OR k.h IS NULL)) > 0 THEN 'unreadable_words' END AS error FROM w)
SELECT user_id, position, coalesce(nullif(trim(file), ''), 'Label ' || position) AS name, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN array_to_string([k.t FOR k IN own], ' ') END AS text, CASE WHEN error IS NULL THEN list_max([k.h FOR k IN own]) END AS height FROM x""")
def guarded_lines(spark, sf_dir):
    """Lines of JSON, many of them broken, each with its result or its own error."""
    raw = made(spark, sf_dir, "events", "user_id", "event_id AS position", f"{_LINE} AS line")
    return guarded.lines(raw, "user_id")


_STEMMED = "o_orderkey % 7 AS batch_id, concat('A', CAST(floor(o_orderkey / CASE WHEN o_orderkey % 7 < 3 THEN 60 ELSE 4 END) AS INT), '.png') AS filename"


@query(f"""WITH f AS (SELECT batch_id, lower(regexp_replace(filename, '\\.[^.]*$', '')) AS stem FROM (SELECT {_STEMMED} FROM orders)), n AS (SELECT batch_id, count(DISTINCT stem) AS rows, count(*) AS files FROM f GROUP BY 1)
SELECT batch_id, CASE WHEN rows > 300 THEN 'batch_too_large' END AS error, rows, CASE WHEN rows <= 300 THEN files ELSE 0 END AS admitted FROM n""")
def refused_batches(spark, sf_dir):
    """Batches of more than 300 rows are refused whole; the files of the others are admitted."""
    from .catalog import _split

    files = made(spark, sf_dir, "orders", *_split(_STEMMED))
    counts = files.groupBy("batch_id").agg(F.count_distinct(batch.stem(F.col("filename"))).alias("rows"))
    kept = batch.admitted(files).groupBy("batch_id").agg(F.count("*").alias("admitted"))
    out = counts.join(batch.refusals(files).select("batch_id", "error"), "batch_id", "left").join(kept, "batch_id", "left")
    return out.select("batch_id", "error", "rows", F.coalesce("admitted", F.lit(0)).cast("long").alias("admitted"))


@query(f"WITH {_SQL_LINES} SELECT count(*) AS rows, sum(n_files)::BIGINT AS files, count(*) FILTER (status = 'error') AS failures, count(*) FILTER (label_side = 'application_artwork') AS artwork_sided FROM lines")
def observed_counters(spark, sf_dir):
    """The counters of a batch, taken while its lines are written."""
    rows, seen = progress.observed(_lines(spark, sf_dir))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "files", "failures", "artwork_sided"))], "rows long, files long, failures long, artwork_sided long")


_CUT = "floor(length(sent) * (0.2 + batch_id % 7 * 0.1))"


@query(f"""WITH {_SQL_LINES}, nn AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS total FROM lines),
t AS (SELECT batch_id, string_agg(concat('{{"batch_id":', batch_id, ',"position":', position, ',"total":', total, ',"name":"', name, '","status":"', status, '"', CASE WHEN error IS NOT NULL THEN concat(',"error":"', error, '"') ELSE '' END, '}}'), chr(10) ORDER BY position) || chr(10) AS sent FROM nn GROUP BY 1),
ct AS (SELECT batch_id, unnest(string_split(substring(sent, 1, CAST({_CUT} AS INT)), chr(10))) AS line FROM t),
k AS (SELECT batch_id, count(*) FILTER (json_valid(line)) AS received, count(*) FILTER (NOT json_valid(line)) AS broken, count(*) FILTER (CASE WHEN json_valid(line) THEN json_extract_string(line, '$.status') = 'error' END) AS failures FROM ct WHERE line <> '' GROUP BY 1)
SELECT t.batch_id, coalesce(received, 0) AS received, coalesce(broken, 0) AS broken, coalesce(failures, 0) AS failures, any_value(total) - coalesce(received, 0) AS missing, any_value(total) AS total FROM t LEFT JOIN k USING (batch_id) JOIN nn USING (batch_id) GROUP BY t.batch_id, received, broken, failures""")
def broken_streams(spark, sf_dir):
    """Each batch's lines as one text, cut off somewhere: the whole lines, what is broken, and what is to be sent again."""
    rows = progress.numbered(_lines(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", progress.as_text(rows).alias("line")))), lambda x: x["line"]), "\n")
    sent = rows.groupBy("batch_id").agg(F.concat(text, F.lit("\n")).alias("sent"))
    cut = sent.select("batch_id", F.explode(F.split(F.substring("sent", F.lit(1), F.expr(_CUT).cast("int")), "\n")).alias("line"))
    whole, broken = progress.whole_lines(cut, "batch_id")
    got = whole.groupBy("batch_id").agg(F.count("*").alias("received"), F.count_if(F.col("status") == "error").alias("failures"))
    lost = broken.groupBy("batch_id").agg(F.count("*").alias("broken"))
    again = progress.missing(rows, whole).groupBy("batch_id").agg(F.count("*").alias("missing"))
    out = rows.groupBy("batch_id").agg(F.max("total").alias("total")).join(got, "batch_id", "left").join(lost, "batch_id", "left").join(again, "batch_id", "left")
    return out.na.fill(0).select("batch_id", "received", "broken", "failures", "missing", "total")


_RESULT = "CASE WHEN l_linenumber % 11 = 0 THEN NULL WHEN l_quantity > 40 THEN 'match' WHEN l_quantity > 30 THEN 'present' WHEN l_discount > 0.07 THEN 'needs_review' WHEN l_tax > 0.06 THEN 'mismatch' WHEN l_returnflag = 'R' THEN 'not_compared' WHEN l_returnflag = 'A' THEN 'artwork_derived' ELSE 'not_certified' END"
_RANKED = ", ".join(f"('{o}', {i})" for i, o in enumerate(ROLL_UP))


@query(f"""WITH r AS (SELECT l_suppkey % 5 AS batch_id, l_orderkey AS item_id, {_RESULT} AS outcome FROM lineitem), k(outcome, place) AS (VALUES {_RANKED}),
g AS (SELECT batch_id, item_id, 2 - grouping(batch_id) - grouping(item_id) AS level, count(*) AS n, {', '.join(f"count(*) FILTER (r.outcome = '{o}') AS {o}" for o in OUTCOMES)}, min(place) AS least FROM r LEFT JOIN k USING (outcome) GROUP BY GROUPING SETS ((batch_id, item_id), (batch_id), ()))
SELECT batch_id, item_id, level::INT AS level, n, {', '.join(OUTCOMES)}, k.outcome AS worst, match + present AS passed, artwork_derived AS derived FROM g LEFT JOIN k ON place = least""")
def rolled_tallies(spark, sf_dir):
    """Tallies and the worst outcome by item, by batch and in all, from one pass."""
    rows = made(spark, sf_dir, "lineitem", "l_suppkey % 5 AS batch_id", "l_orderkey AS item_id", f"{_RESULT} AS outcome")
    return verdict.rolled_tallies(rows, "outcome", "batch_id", "item_id")


# --- rules on texts as they are: blank lines, capitals at the end, counts of files -----------------------------------------

_SIDES = "SELECT doc_id, split_part(text, chr(10), 2) AS label, CASE WHEN lang = 'de' THEN split_part(text, chr(10), 40) ELSE split_part(text, chr(10), 3) END AS declared FROM documents"
_CODES = "SELECT conv_id, turn, concat(substring(upper(translate(text, 'ß', 's')), 1 + turn % 9, 30), CASE WHEN length(text) % 3 = 0 THEN ' ' ELSE '' END) AS t FROM conversations"


@query(f"""SELECT doc_id, CASE WHEN {sql_missing('declared')} THEN 'not_compared' WHEN {sql_missing('label')} THEN 'mismatch' END AS missing, CASE WHEN {sql_missing('declared')} THEN CASE WHEN {sql_missing('label')} THEN 'mismatch' ELSE 'present' END END AS presence FROM ({_SIDES})""")
def missing_texts(spark, sf_dir):
    """What is said where a line of a text is missing or blank, and of fields that need only be there."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_sided_documents")
    sides = spark.sql(_SIDES.replace("FROM documents", "FROM _sided_documents"))
    label, declared = F.col("label"), F.col("declared")
    return sides.select("doc_id", verdict.missing_outcome(label, declared).alias("missing"), verdict.presence(label, declared).alias("presence"))


@query(rf"SELECT conv_id, turn, nullif(regexp_extract(t, '^(.*\S)\s+([A-Z0-9]{{1,3}})\s*$', 1), '') AS plain, regexp_matches(t, '^.*\S\s+[A-Z0-9]{{1,3}}\s*$') AS coded FROM ({_CODES})")
def trailing_codes(spark, sf_dir):
    """Texts in capitals with and without a short word at their end."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_coded_turns")
    turns = spark.sql(_CODES.replace("FROM conversations", "FROM _coded_turns"))
    return turns.select("conv_id", "turn", without_code(F.col("t")).alias("plain"), without_code(F.col("t")).isNotNull().alias("coded"))


_COUNTED = "SELECT o_custkey AS item, count(*) FILTER (WHERE o_orderstatus = 'F') AS labels, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS applications, count(*) FILTER (WHERE o_totalprice > 300000) AS panels FROM orders GROUP BY o_custkey"


@query(f"SELECT item, CASE WHEN labels > 3 THEN 'too_many_photos' WHEN applications > 1 THEN 'too_many_application_documents' WHEN labels = 0 AND panels = 0 THEN 'no_label_to_check' END AS error, CASE WHEN applications > 1 THEN 'duplicate_application_document' WHEN labels > 1 THEN 'duplicate_label_stem' WHEN labels = 0 AND panels = 0 THEN 'no_label_to_check' END AS row_error FROM ({_COUNTED})")
def counted_errors(spark, sf_dir):
    """Errors of items and of rows by the counts of their files."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("_counted_orders")
    counts = spark.sql(_COUNTED.replace("FROM orders", "FROM _counted_orders"))
    a, n, p = F.col("applications"), F.col("labels"), F.col("panels")
    return counts.select("item", batch.item_error(a, n, p).alias("error"), batch.row_error(a, n, p).alias("row_error"))
