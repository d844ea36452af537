"""Queries of batches: guards, lines, counters, what is shown, sources and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch, order_statistics, presentation, quality
from ..sources import tables
from .registry import made, query, table

# --- batch rows, made from orders: names, types and sizes by rule ---

_FILE = (
    "o_orderkey % 10 AS batch_id", "o_orderkey AS idx", "concat('A', CAST(floor(o_orderkey / 3) AS INT), CASE WHEN o_orderkey % 3 = 2 THEN '.x' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN '.PDF' ELSE '.png' END) AS filename",
    "CASE o_orderkey % 23 WHEN 0 THEN 'text/plain' WHEN 1 THEN NULL ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'application/pdf' ELSE 'image/png' END END AS content_type",
    "CASE WHEN o_orderkey % 29 = 0 THEN 20000000 ELSE CAST(o_totalprice AS INT) END AS size", "CASE WHEN o_orderkey % 5 = 0 THEN 'application' ELSE 'label' END AS side", "CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS panels",
)
_BATCH = "o_orderkey % 10 + 10 * (o_orderkey % 200) AS batch_id"
_FILES = [_BATCH if "batch_id" in c else c.replace("floor(o_orderkey / 3)", "floor(o_orderkey / 1000)") for c in _FILE]
_SQL_LINES = f"""files AS (SELECT {', '.join(_FILES)} FROM orders),
w AS (SELECT *, lower(regexp_replace(filename, '\\.[^.]*$', '')) AS stem, CASE WHEN coalesce(content_type, '') NOT IN ('image/jpeg', 'image/png', 'image/webp', 'image/tiff', 'application/pdf') THEN 'unsupported_media_type' WHEN size > 10485760 THEN 'file_too_large' END AS wrong FROM files),
g AS (SELECT batch_id, stem, min(idx) AS first, count(*) AS n_files, arg_min(wrong, idx) FILTER (wrong IS NOT NULL) AS wrong, count(*) FILTER (side = 'application') AS a, count(*) FILTER (side = 'label') AS l, max(panels) AS panels, arg_min(filename, idx) AS first_file, arg_min(filename, idx) FILTER (side = 'label') AS first_label FROM w GROUP BY 1, 2),
c AS (SELECT batch_id, stem, CASE WHEN first % 31 = 0 THEN 'verification_failed' END AS failed FROM g),
e AS (SELECT g.*, row_number() OVER (PARTITION BY batch_id ORDER BY first) AS position, coalesce(wrong, CASE WHEN a > 1 THEN 'duplicate_application_document' WHEN l > 1 THEN 'duplicate_label_stem' WHEN l = 0 AND panels = 0 THEN 'no_label_to_check' END, failed) AS error FROM g JOIN c USING (batch_id, stem)),
lines AS (SELECT batch_id, position, stem, n_files, CASE WHEN wrong IS NULL THEN coalesce(first_label, first_file) ELSE first_file END AS name, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN CASE WHEN l = 0 THEN 'application_artwork' ELSE 'uploaded_photographs' END END AS label_side FROM e)"""


def _lines(spark, sf_dir):
    files = made(spark, sf_dir, "orders", *_FILES)
    own = batch.grouped(files).join(files.withColumn("stem", batch.stem(F.col("filename"))).groupBy("batch_id", "stem").agg(F.min("idx").alias("first")), ["batch_id", "stem"])
    checked = own.select("batch_id", "stem", F.when(F.col("first") % 31 == 0, "verification_failed").alias("error"))
    return batch.lines(files, checked).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_SQL_LINES} SELECT * FROM lines")
def batch_lines(spark, sf_dir):
    """A line for each row of a batch, its errors kept to it."""
    return _lines(spark, sf_dir)


@query(f"WITH {_SQL_LINES} SELECT batch_id, count(*) AS rows, sum(n_files)::BIGINT AS files, count(*) FILTER (status = 'error') AS failures, count(*) FILTER (label_side = 'application_artwork') AS artwork_sided, count(DISTINCT stem) AS stems FROM lines GROUP BY 1")
def batch_summary(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return batch.summary(lines, "batch_id").join(lines.groupBy("batch_id").agg(F.count_distinct("stem").alias("stems")), "batch_id")


@query(f"""WITH {_SQL_LINES}, r AS (SELECT batch_id, position, name AS row_name FROM lines WHERE position % 3 <> 0), x AS (SELECT batch_id, position, CASE WHEN position % 4 <> 0 THEN name END AS line_name, status FROM lines WHERE position % 2 = 0)
SELECT batch_id, position, coalesce(line_name, row_name, 'Label ' || position) AS name, coalesce(status, 'pending') AS status FROM r FULL JOIN x USING (batch_id, position)""")
def batch_shown(spark, sf_dir):
    """Predicted rows with the lines received so far."""
    lines = _lines(spark, sf_dir)
    rows = lines.where("position % 3 <> 0").select("batch_id", "position", "name")
    received = lines.where("position % 2 = 0").withColumn("name", F.when(F.col("position") % 4 != 0, F.col("name")))
    return batch.shown(rows, received).orderBy("batch_id", "position")


@query("""WITH f AS (SELECT o_orderkey % 10 AS batch_id, o_orderkey // 3 AS stem, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'application' ELSE 'label' END AS side FROM orders),
  n AS (SELECT batch_id, stem, count(*) FILTER (side IS NULL) AS u, count(*) FILTER (side = 'failed') AS x, count(*) FILTER (side = 'application') AS a, count(*) FILTER (side = 'label') AS l FROM f GROUP BY 1, 2),
  s AS (SELECT batch_id, CASE WHEN u > 0 THEN 'reading' WHEN x > 0 THEN 'failed' WHEN a = 1 AND l = 1 THEN 'pair' WHEN a = 1 AND l = 0 THEN 'application' WHEN a = 0 AND l = 1 THEN 'image' ELSE 'ambiguous' END AS shape FROM n)
  SELECT b.batch_id, v.shape, count(s.shape) AS n FROM (SELECT DISTINCT batch_id FROM s) b CROSS JOIN (VALUES ('pair'), ('application'), ('image'), ('ambiguous'), ('failed'), ('reading')) v(shape) LEFT JOIN s ON s.batch_id = b.batch_id AND s.shape = v.shape GROUP BY 1, 2""")
def shape_counts(spark, sf_dir):
    side = "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'application' ELSE 'label' END AS side"
    files = made(spark, sf_dir, "orders", "o_orderkey % 10 AS batch_id", "CAST(floor(o_orderkey / 3) AS BIGINT) AS stem", side)
    return batch.shape_counts(batch.group_shape(files, "batch_id", "stem"), "batch_id")


@query("SELECT o_orderkey, CASE WHEN l > 3 THEN 'too_many_photos' WHEN a > 1 THEN 'too_many_application_documents' WHEN l = 0 AND p = 0 THEN 'no_label_to_check' END AS error FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 6 AS l, o_orderkey % 2 AS p FROM orders)")
def item_errors(spark, sf_dir):
    o = made(spark, sf_dir, "orders", "o_orderkey", "o_orderkey % 3 AS a", "o_orderkey % 6 AS l", "o_orderkey % 2 AS p")
    return o.select("o_orderkey", batch.item_error(F.col("a"), F.col("l"), F.col("p")).alias("error"))


# --- what is shown ------------------------------------------------------------------------------------------------------

_OUTCOME = "CASE l_linenumber % 9 WHEN 0 THEN 'match' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'not_compared' WHEN 4 THEN 'present' WHEN 5 THEN 'artwork_derived' WHEN 6 THEN 'not_certified' WHEN 7 THEN 'of tomorrow' END"
_SENTENCE = "It may stand elsewhere on the label."
_REASON = f"CASE l_linenumber % 3 WHEN 0 THEN concat(l_returnflag, ' was found. {_SENTENCE}') WHEN 1 THEN concat('{_SENTENCE} ', l_returnflag) ELSE l_returnflag END"
_SHOWN = ", ".join(f"('{k}', '{a}', '{b}', '{c}')" for k, (a, b, c) in presentation.SHOWN.items())


@query(f"""WITH s(outcome, label, glyph, tone) AS (VALUES {_SHOWN}), o AS (SELECT l_orderkey, l_linenumber, {_OUTCOME} AS outcome, {_REASON} AS reason FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(s.label, 'Not compared') AS label, coalesce(s.glyph, 'dash') AS glyph, coalesce(s.tone, 'neutral') AS tone, CASE WHEN suffix(reason, '{_SENTENCE}') THEN trim(reason[:-{len(_SENTENCE) + 1}]) ELSE reason END AS reason FROM o LEFT JOIN s USING (outcome)""")
def shown_outcomes(spark, sf_dir):
    o = made(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", f"{_OUTCOME} AS outcome", f"{_REASON} AS reason")
    return o.select("l_orderkey", "l_linenumber", presentation.shown(F.col("outcome")).alias("s"), presentation.without_suffix(F.col("reason"), _SENTENCE).alias("reason")).select("l_orderkey", "l_linenumber", "s.*", "reason")


_CODES = [*presentation.SAID, "file_too_large", "file_too_large", "never_heard_of"]
_CODE = f"CASE event_id % {len(_CODES) + 1} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_MESSAGE = "CASE event_id % 4 WHEN 0 THEN 'Send fewer photographs of it.' WHEN 1 THEN 'Send smaller batches.' WHEN 2 THEN event_type END"
_SAID = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in presentation.SAID.items())


@query(f"""WITH s(code, sentence) AS (VALUES {_SAID}), e AS (SELECT event_id, {_CODE} AS code, {_MESSAGE} AS message FROM events),
c AS (SELECT event_id, CASE WHEN code = 'file_too_large' AND contains(lower(message), 'fewer photographs') THEN 'submission_too_large' WHEN code = 'file_too_large' AND contains(lower(message), 'smaller batches') THEN 'batch_envelope_too_large' ELSE code END AS code FROM e)
SELECT event_id, coalesce(sentence, '{presentation.UNKNOWN}') AS sentence FROM c LEFT JOIN s USING (code)""")
def said_errors(spark, sf_dir):
    e = made(spark, sf_dir, "events", "event_id", f"{_CODE} AS code", f"{_MESSAGE} AS message")
    return e.select("event_id", presentation.said(F.col("code"), F.col("message")).alias("sentence"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, row_number() OVER w - 1 AS idx, CASE WHEN trim(n) <> '' THEN n ELSE 'file-' || (row_number() OVER w) END AS filename FROM (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'files' ELSE 'application_document' END AS part, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY CASE part WHEN 'files' THEN 0 WHEN 'image' THEN 1 ELSE 2 END, event_id)")
def submitted_files(spark, sf_dir):
    parts = made(spark, sf_dir, "events", "user_id", "event_id", "event_id AS turn", "CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'files' ELSE 'application_document' END AS part", "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS filename")
    return tables.submitted(parts, "user_id").select("user_id", "event_id", F.col("idx").cast("long").alias("idx"), "filename")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def numbered_files(spark, sf_dir):
    return tables.numbered(made(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey").select("o_orderkey", F.col("idx").cast("long").alias("idx"))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS place, unnest(s) AS line FROM (SELECT conv_id, turn, string_split_regex(text, '\r\n|[\n\v\f\r]|\x{85}|\x{2028}|\x{2029}') AS s FROM (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10) || ' ') AS text FROM conversations WHERE turn % 7 <> 3) WHERE text IS NOT NULL))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS line_idx, trim(line) AS text FROM l WHERE trim(line) <> ''""")
def document_pages(spark, sf_dir):
    """Lines across a document's pages, which conversations' turns stand for; some can't be read."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.when(F.col("turn") % 7 != 3, F.replace("text", F.lit(". "), F.lit(".\n "))).alias("text"))
    return tables.page_lines(pages, "conv_id").withColumn("line_idx", F.col("line_idx").cast("long"))


@query(r"SELECT doc_id, line_idx, top, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS line_idx, top, text FROM (SELECT doc_id, unnest(range(len(s))) AS top, trim(unnest(s)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)) WHERE text <> '')")
def text_lines(spark, sf_dir):
    """Lines of whole documents, with their places before blank ones went."""
    out = tables.text_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return out.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.col("top").cast("long").alias("top"), "text")


@query("SELECT p_name || '.png' AS image_filename, count(*) AS n, count(DISTINCT said) AS said FROM (SELECT a.p_name, b.p_type AS said FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_size > 25) GROUP BY 1")
def golden_rows(spark, sf_dir):
    """What is printed with what is declared, by file name."""
    expected = made(spark, sf_dir, "part", "concat(p_name, '.png') AS image_filename", "p_type AS class_type")
    said = made(spark, sf_dir, "part", "concat(p_name, '.png') AS filename", "p_type AS class_type", "p_size").where("p_size > 25").drop("p_size")
    return quality.expected_counts(expected, said, "class_type", "image_filename")


@query("SELECT printf('%03d-', c) || p_name AS filename, c::INT AS copy, p_partkey FROM part, range(1, 4) t(c)")
def replicated_files(spark, sf_dir):
    return quality.replicated(made(spark, sf_dir, "part", "p_partkey", "p_name AS filename"), 3)


# --- measures -----------------------------------------------------------------------------------------------------------


@query(r"SELECT conv_id, role, sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY 1, 2")
def word_counts(spark, sf_dir):
    return quality.word_counts(table(spark, sf_dir, "conversations"), "text", "conv_id", "role")


@query("SELECT user_id, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def status_histogram(spark, sf_dir):
    return quality.histogram(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "status", "user_id")


@query("SELECT l_orderkey, min(l_quantity) AS least, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def row_times(spark, sf_dir):
    return quality.latencies(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey").withColumn("mean", F.round("mean", 6))


@query("""WITH t AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'total' ELSE event_type END AS phase, (value * 100)::BIGINT::DOUBLE * (CASE event_type WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 100 END ELSE 1 END) AS ms FROM events),
  s AS (SELECT user_id, coalesce(sum(ms) FILTER (phase = 'total'), 0) AS total, coalesce(sum(ms) FILTER (phase = 'click'), 0) AS click, coalesce(sum(ms) FILTER (phase = 'error'), 0) AS error, coalesce(sum(ms) FILTER (phase = 'purchase'), 0) AS purchase FROM t GROUP BY 1) SELECT *, greatest(total - click - error - purchase, 0) AS unaccounted FROM s""")
def phase_totals(spark, sf_dir):
    """Disjoint phases of a total, and what they leave of it."""
    ms = F.round(F.col("value") * 100).cast("long").cast("double") * F.when(F.col("event_type") == "view", F.when(F.col("user_id") % 2 == 0, 1).otherwise(100)).otherwise(1)
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", "total").otherwise(F.col("event_type")).alias("phase"), ms.alias("ms"))
    return quality.phase_totals(e, ["click", "error", "purchase"], "user_id")


@query("SELECT event_type, user_id % 3 AS shard, count(value) AS n, min(value) AS least, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.999) AS p999, max(value) AS most FROM events GROUP BY ALL")
def value_quantiles(spark, sf_dir):
    """Exact quantiles of each type and shard, by narrowing intervals."""
    e = made(spark, sf_dir, "events", "event_type", "user_id % 3 AS shard", "value")
    out = order_statistics.quantiles(e, "value", (0.05, 0.5, 0.95, 0.999), "event_type", "shard")
    return out.select("event_type", "shard", "n", "least", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("p05", "median", "p95", "p999"))], "most")
