"""Registered queries: every operator over the driver's tables, with an independent SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import text as T
from ..functions import verdict as V
from ..functions.similarity import differences, lcs_length_udf
from ..operators import batch, documents, layout, merge, quality, search, statement
from ..vocab import OUTCOMES, STATEMENT_BODY, STATEMENT_PREFIX, UNITS
from .registry import FOUND, ORACLES, query, sql_abv, sql_missing, sql_net, sql_normalized, sql_verified, table


# --- text and similarity -------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS key, 'part' AS kind, {sql_normalized('p_name')} AS norm FROM part UNION ALL SELECT s_suppkey, 'supplier', {sql_normalized('s_name')} FROM supplier UNION ALL SELECT c_custkey, 'customer', {sql_normalized('c_name')} FROM customer")
def normalize_names(spark, sf_dir):
    one = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("key"), F.lit(t).alias("kind"), T.normalized(F.col(n)).alias("norm"))
    return one("part", "p_partkey", "p_name").union(one("supplier", "s_suppkey", "s_name")).union(one("customer", "c_custkey", "c_name"))


@query(f"SELECT doc_id, length(n) AS chars, len(list_filter(string_split(n, ' '), lambda w: w <> '')) AS words, md5(n) AS digest FROM (SELECT doc_id, {sql_normalized('text')} AS n FROM documents)")
def normalize_documents(spark, sf_dir):
    n = T.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").cast("long").alias("chars"), F.size(F.filter(F.split("n", " "), lambda w: w != "")).cast("long").alias("words"), F.md5("n").alias("digest"))


def _part_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = p.select("p_partkey", F.col("p_name").alias("label")), p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_partkey") % 7 == 0, " ").when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_name")).alias("declared"), F.col("p_partkey").alias("other"))
    same = b.withColumn("declared", F.when(F.col("other") % 3 == 0, F.upper("declared")).otherwise(F.col("declared")))
    mine = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", F.lit("extra")).alias("own"))
    return a.join(same, "p_partkey").join(mine, "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("own")).otherwise(F.col("label")).alias("label"), "declared")


_PAIRS = f"""pairs AS (SELECT a.p_partkey, CASE WHEN a.p_partkey % 4 = 0 THEN b.p_name || ' extra' ELSE a.p_name END AS label,
  CASE WHEN b.p_partkey % 7 = 0 THEN ' ' WHEN b.p_partkey % 5 = 0 THEN NULL WHEN b.p_partkey % 3 = 0 THEN upper(b.p_name) ELSE b.p_name END AS declared
  FROM part a JOIN part b ON b.p_partkey - 1 = a.p_partkey),
normed AS (SELECT *, {sql_normalized('label')} AS a, {sql_normalized('declared')} AS b FROM pairs),
rows_ AS (SELECT p_partkey, a, b, 0 AS i, [0 FOR x IN range(length(b) + 1)] AS r FROM normed WHERE coalesce(trim(declared), '') <> ''
  UNION ALL SELECT p_partkey, a, b, i + 1, [list_max(cand[1:k]) FOR k IN range(1, length(b) + 2)] FROM
    (SELECT p_partkey, a, b, i, [greatest(r[j + 1], CASE WHEN j > 0 AND substr(b, j, 1) = substr(a, i + 1, 1) THEN r[j] + 1 ELSE 0 END) FOR j IN range(length(b) + 1)] AS cand FROM rows_ WHERE i < length(a))),
scored AS (SELECT n.p_partkey, r[len(r)] AS lcs, length(n.a) + length(n.b) AS total, n.declared FROM normed n LEFT JOIN rows_ s ON s.p_partkey = n.p_partkey AND s.i = length(n.a)),
compared AS (SELECT p_partkey, CASE WHEN coalesce(trim(declared), '') = '' THEN 'not_compared' WHEN 200 * lcs >= 95 * total THEN 'match' WHEN 200 * lcs >= 80 * total THEN 'needs_review' ELSE 'mismatch' END AS outcome FROM scored)"""


@query(f"WITH RECURSIVE {_PAIRS} SELECT p_partkey, outcome FROM compared")
def compare_part_names(spark, sf_dir):
    pairs = _part_pairs(spark, sf_dir)
    return pairs.select("p_partkey", V.compared_text(F.col("label"), F.col("declared"), common=lcs_length_udf(spark)).alias("outcome"))


@query(f"WITH RECURSIVE {_PAIRS} SELECT " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in OUTCOMES) + " FROM compared")
def band_tally(spark, sf_dir):
    return V.tally(_part_pairs(spark, sf_dir).withColumn("outcome", V.compared_text(F.col("label"), F.col("declared"))), "outcome")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'not_compared' WHEN o_orderkey % 4 = 2 THEN 'mismatch' END AS outcome FROM orders")
def missing_rules(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    label = F.when(k.isin(0, 2), F.lit("  ")).otherwise(F.col("o_orderpriority"))
    declared = F.when(k == 0, None).when(k == 1, F.lit("\t ")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.missing_outcome(label, declared).alias("outcome"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS plain FROM part")
def trailing_code(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_type"), F.lit(" FB1"))).otherwise(F.concat(F.col("p_type"), F.lit(" Fbx1")))
    return table(spark, sf_dir, "part").select("p_partkey", T.without_code(code).alias("plain"))


# --- quantities ----------------------------------------------------------------------------------------------------


_P, _SAID = "CAST(round(l_discount * 100, 0) AS INT)", "CAST(round(l_tax * 100, 0) AS INT)"
_ABV_TEXT = (
    f"CASE l_linenumber WHEN 1 THEN concat({_P}, '% Alc./Vol.') WHEN 2 THEN concat({_P}, ' percent (', 2 * {_P}, ' Proof)') WHEN 3 THEN concat({_P}, '% (', 2 * {_P}, '-5 PROOF)') "
    f"WHEN 4 THEN concat('ALC ', {_P}, ' to ', {_P} + 2, '% alc/vol') WHEN 5 THEN concat({_P}, CASE WHEN l_orderkey % 3 = 0 THEN '.5' ELSE '' END) WHEN 6 THEN l_returnflag ELSE CASE WHEN l_orderkey % 2 = 0 THEN ' ' END END"
)
_ABV_SAID = f"CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN l_returnflag ELSE concat({_SAID}, '%') END"


def _abv(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_ABV_TEXT} AS label", f"{_ABV_SAID} AS declared")


_ABV = f"""texts AS (SELECT l_orderkey, l_linenumber, {_ABV_TEXT} AS label, {_ABV_SAID} AS declared FROM lineitem), abv AS (SELECT *, {sql_abv('label')} AS v, {sql_abv('declared')} AS s FROM texts)"""
SQL_ABV = f"""CASE WHEN {sql_missing('label')} THEN {{'outcome': 'mismatch', 'score': NULL::DOUBLE, 'code': 'absent'}} WHEN v.proof IS NOT NULL AND v.percent IS NOT NULL AND abs(v.proof - 2 * v.percent) > 1e-9 THEN {{'outcome': 'needs_review', 'score': NULL, 'code': 'contradiction'}}
  WHEN {sql_missing('declared')} THEN {{'outcome': 'present', 'score': NULL, 'code': 'present'}} WHEN v.low IS NOT NULL THEN {{'outcome': 'needs_review', 'score': NULL, 'code': 'range'}} WHEN v.percent IS NULL OR s.percent IS NULL THEN {{'outcome': 'needs_review', 'score': $text, 'code': 'unread'}}
  WHEN v.percent = s.percent THEN {{'outcome': 'match', 'score': 100.0, 'code': 'equal'}} ELSE {{'outcome': 'mismatch', 'score': 0.0, 'code': 'differs'}} END"""


@query(f"WITH {_ABV} SELECT l_orderkey, l_linenumber, v.percent AS percent, v.proof AS proof, v.low AS low, v.high AS high FROM abv")
def abv_parse(spark, sf_dir):
    return Q.with_abv(_abv(spark, sf_dir), "label", "").drop("label", "declared")


@query(f"WITH {_ABV} SELECT l_orderkey, l_linenumber, r.outcome AS outcome, r.score AS score, r.code AS code FROM (SELECT *, {SQL_ABV.replace('$text', 'NULL')} AS r FROM abv)")
def abv_compare(spark, sf_dir):
    read = Q.with_abv(Q.with_abv(_abv(spark, sf_dir), "label", "seen_"), "declared", "said_")
    made = Q.abv_verdict(F.col("label"), F.col("declared"), F.lit(None), readings=(Q.held("seen_"), Q.held("said_")))
    return read.select("l_orderkey", "l_linenumber", made.alias("v")).select("l_orderkey", "l_linenumber", "v.*")


_SPELLINGS = [n for names in UNITS.values() for n in names if not n.startswith("fluid")]  # in print those two are spaced
_UNIT_CASE = "CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate([*_SPELLINGS, "fl. oz.", "fluid ounces", "milli litres", "barrels"])) + " END"
_UNIT_CASE = _UNIT_CASE.format(n=len(_SPELLINGS) + 4)
_NET_TEXT = f"CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 11 = 0 THEN p_name WHEN p_partkey % 17 = 0 THEN '' ELSE concat('CONT. ', p_size, ' ', upper({_UNIT_CASE})) END"
_NET_SAID = f"CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN concat(p_size, ' Gal.') WHEN p_partkey % 8 = 0 THEN concat(p_size + 1, {_UNIT_CASE}) WHEN p_partkey % 13 = 0 THEN upper(p_name) ELSE concat(p_size, {_UNIT_CASE}) END"


def _contents(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NET_TEXT} AS label", f"{_NET_SAID} AS declared")


_NET = f"texts AS (SELECT p_partkey, {_NET_TEXT} AS label, {_NET_SAID} AS declared FROM part), net AS (SELECT *, {sql_net('label', UNITS)} AS v, {sql_net('declared', UNITS)} AS s FROM texts)"
SQL_NET = f"""CASE WHEN {sql_missing('label')} THEN {{'outcome': 'mismatch', 'score': NULL::DOUBLE, 'code': 'absent'}} WHEN {sql_missing('declared')} THEN {{'outcome': 'present', 'score': NULL, 'code': 'present'}} WHEN v.value IS NULL OR s.value IS NULL THEN {{'outcome': $outcome, 'score': $score, 'code': 'text'}}
  WHEN v.unit IS NULL OR s.unit IS NULL THEN {{'outcome': 'needs_review', 'score': NULL, 'code': 'no_unit'}} WHEN v.unit <> s.unit THEN {{'outcome': 'needs_review', 'score': NULL, 'code': 'units'}} WHEN abs(v.value - s.value) < 1e-9 THEN {{'outcome': 'match', 'score': 100.0, 'code': 'equal'}} ELSE {{'outcome': 'mismatch', 'score': 0.0, 'code': 'differs'}} END"""


@query(f"WITH {_NET} SELECT p_partkey, v.value AS value, v.unit AS unit FROM net")
def net_contents_parse(spark, sf_dir):
    return _contents(spark, sf_dir).select("p_partkey", Q.net_contents(F.col("label")).alias("v")).select("p_partkey", "v.*")


@query(f"WITH {_NET} SELECT p_partkey, r.outcome AS outcome, r.score AS score, r.code AS code FROM (SELECT *, {SQL_NET.replace('$outcome', repr('by_text')).replace('$score', 'NULL')} AS r FROM net)")
def net_contents_compare(spark, sf_dir):
    by_text = F.struct(F.lit("by_text").alias("outcome"), F.lit(None).cast("double").alias("score"))
    return _contents(spark, sf_dir).select("p_partkey", Q.net_contents_verdict(F.col("label"), F.col("declared"), by_text).alias("v")).select("p_partkey", "v.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'mismatch' ELSE 'present' END END AS outcome FROM part")
def presence_checks(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name"))
    declared = F.when(F.col("p_partkey") % 2 == 1, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", V.presence(label, declared).alias("outcome"))


@query(r"SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)\b(?:alcohol|alc|abv|vol(?:ume)?|proof)\b|alc[\W_il1]{1,3}vol') AND regexp_matches(line, '\d+(?:\.\d+)?')) AS alcohol_lines, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def located_lines(spark, sf_dir):
    from ..sources.tables import text_lines

    own = text_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return own.groupBy("doc_id").agg(F.count_if(Q.states_alcohol(F.col("text"))).alias("alcohol_lines"), F.count("*").alias("lines"))


# --- search and statement ------------------------------------------------------------------------------------------


@query(f"""SELECT b.item_id, d.doc_id FROM (SELECT item_id, {sql_normalized('text')} AS n FROM benchmark) b
  JOIN (SELECT doc_id, {sql_normalized('text')} AS n FROM documents) d ON contains(' ' || d.n || ' ', ' ' || b.n || ' ') WHERE b.n <> ''""")
def search_benchmark_exact(spark, sf_dir):
    """Whole-word runs of benchmark texts in documents."""
    return search.contained(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


_NEEDLES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' FB') WHEN 1 THEN translate(p_name, 'e', 'c') ELSE p_name END AS needle FROM part WHERE p_partkey > 0"
_TEXTS = "SELECT p_partkey - d AS p_partkey, CAST(d AS INT) AS unit, concat('the fine ', p_name, ' label') AS text FROM part JOIN (SELECT 0 AS d UNION ALL SELECT 1) t ON true WHERE p_partkey > 0"


@query(f"WITH RECURSIVE {sql_verified('v', f'SELECT p_partkey, needle, unit, text FROM ({_NEEDLES}) n JOIN ({_TEXTS}) t USING (p_partkey)', 'p_partkey')} SELECT p_partkey, hit, score, code, outcome FROM v")
def search_fuzzy_names(spark, sf_dir):
    """Part names, damaged by rule, searched in the names that follow them."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_searched_parts")
    pairs = spark.sql(f"SELECT p_partkey, needle, unit, text FROM ({_NEEDLES}) n JOIN ({_TEXTS}) t USING (p_partkey)".replace("FROM part", "FROM _searched_parts"))
    return search.verified(pairs, "p_partkey", common=lcs_length_udf(spark)).select("p_partkey", "hit", "score", "code", "outcome")


def _statements(spark, sf_dir):
    k = F.col("item_id") % 6
    body, prefix = F.lit(STATEMENT_BODY), F.lit(STATEMENT_PREFIX)
    text = F.when(k == 0, F.concat_ws(" ", prefix, body)).when(k == 1, F.concat_ws("  ", prefix, F.upper(body))).when(k == 2, F.concat_ws(" ", prefix, F.regexp_replace(body, "drive", "drve"))).when(k == 3, F.concat_ws(" ", F.initcap(prefix), body)).when(k == 4, F.concat_ws(" ", prefix, F.regexp_replace(body, "birth defects", "harm"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("statement"))


@query("SELECT item_id, k < 5 AS found, CASE WHEN k < 5 THEN k <> 3 END AS prefix_upper, k IN (0, 1, 3) AS exact, CASE WHEN k IN (0, 1, 3) THEN 0 WHEN k = 2 THEN 1 WHEN k = 4 THEN 12 END AS distance, k = 2 AS near_miss, CASE WHEN k IN (0, 1) THEN 'match' WHEN k = 2 THEN 'needs_review' ELSE 'mismatch' END AS outcome FROM (SELECT item_id, item_id % 6 AS k FROM benchmark)")
def statement_check(spark, sf_dir):
    return _statements(spark, sf_dir).select("item_id", *[c.alias(n) for n, c in statement.checked(F.col("statement")).items()])


_BODY = STATEMENT_BODY.replace("'", "''")


@query(f"""SELECT item_id, CASE item_id % 6 WHEN 0 THEN concat_ws(' ', '{STATEMENT_PREFIX}', b) WHEN 1 THEN concat_ws('  ', '{STATEMENT_PREFIX}', upper(b)) WHEN 2 THEN concat_ws(' ', '{STATEMENT_PREFIX}', replace(b, 'drive', 'drve')) WHEN 3 THEN concat_ws(' ', 'Government Warning:', b) WHEN 4 THEN concat_ws(' ', '{STATEMENT_PREFIX}', replace(b, 'birth defects', 'harm')) ELSE text END AS seen,
  lower('{STATEMENT_PREFIX} ' || b) AS want FROM (SELECT item_id, text, '{_BODY}' AS b FROM benchmark)""")
def statement_diff(spark, sf_dir):
    """The differences, put together again: what is the same and added gives the text, what is the same and missing the statement, case aside."""
    diff = differences(spark)
    own = _statements(spark, sf_dir).select("item_id", diff(F.col("statement"), F.lit(f"{STATEMENT_PREFIX} {STATEMENT_BODY}")).alias("diff"))
    side = lambda kind: F.array_join(F.transform(F.filter("diff", lambda d: d["kind"].isin("same", kind)), lambda d: d["text"]), "")
    return own.select("item_id", side("added").alias("seen"), F.lower(side("missing")).alias("want"))


# --- batches and verdict rows --------------------------------------------------------------------------------------

_VERDICT = """verdicts AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'mismatch' WHEN l_quantity < 10 THEN 'needs_review' WHEN l_quantity < 15 THEN 'not_compared'
  WHEN l_quantity < 20 THEN 'artwork_derived' WHEN l_quantity < 30 THEN 'present' ELSE 'match' END AS outcome FROM lineitem)"""


def _verdicts(spark, sf_dir):
    q = F.col("l_quantity")
    outcome = F.when(F.col("l_returnflag") == "R", "mismatch").when(q < 10, "needs_review").when(q < 15, "not_compared").when(q < 20, "artwork_derived").when(q < 30, "present").otherwise("match")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query(f"""WITH {_VERDICT}, worst AS (SELECT l_orderkey, min(CASE outcome WHEN 'mismatch' THEN 1 WHEN 'needs_review' THEN 3 WHEN 'not_compared' THEN 4 WHEN 'artwork_derived' THEN 5 WHEN 'match' THEN 6 ELSE 7 END) AS r FROM verdicts GROUP BY 1)
  SELECT b.turn, b.bucket, count(w.r) AS n FROM (VALUES (0, 'match', 6), (1, 'needs_review', 3), (2, 'mismatch', 1), (3, 'not_compared', 4), (4, 'present', 7), (5, 'artwork_derived', 5), (6, 'not_certified', 2), (7, 'error', 0)) b(turn, bucket, r) LEFT JOIN worst w ON w.r = b.r GROUP BY 1, 2""")
def row_outcome(spark, sf_dir):
    return batch.bucket_tally(V.rolled_up(_verdicts(spark, sf_dir), "outcome", "l_orderkey"))


@query(f"WITH {_VERDICT} SELECT l_orderkey, count(*) FILTER (outcome IN ('match', 'present')) AS passed, count(*) FILTER (outcome <> 'artwork_derived') AS checks, count(*) FILTER (outcome = 'artwork_derived') AS derived FROM verdicts GROUP BY 1")
def checks_passed(spark, sf_dir):
    return V.checks(_verdicts(spark, sf_dir), "outcome", "l_orderkey")


def _files(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "in/").otherwise("IN\\"), F.lit("A"), F.floor(k / 3).cast("string"), F.when(k % 3 == 0, ".front").otherwise(""), F.when(k % 5 == 0, ".PDF").otherwise(".png"))
    return table(spark, sf_dir, "orders").select((k % 10).alias("batch_id"), k.alias("idx"), name.alias("filename"), F.when(k % 11 == 0, None).when(k % 5 == 0, "application").otherwise("label").alias("side"))


_FILES = """files AS (SELECT o_orderkey % 10 AS batch_id, o_orderkey AS idx, (CASE WHEN o_orderkey % 2 = 0 THEN 'in/' ELSE 'IN' || chr(92) END) || 'A' || (o_orderkey // 3)::VARCHAR || (CASE WHEN o_orderkey % 3 = 0 THEN '.front' ELSE '' END) || (CASE WHEN o_orderkey % 5 = 0 THEN '.PDF' ELSE '.png' END) AS filename,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'application' ELSE 'label' END AS side, 'a' || (o_orderkey // 3)::VARCHAR || (CASE WHEN o_orderkey % 3 = 0 THEN '.front' ELSE '' END) AS stem FROM orders)"""


@query(f"WITH {_FILES} SELECT batch_id, stem, count(*) AS n_files, arg_min(filename, idx) AS first_file, row_number() OVER (PARTITION BY batch_id ORDER BY min(idx)) AS position FROM files GROUP BY batch_id, stem")
def stem_group(spark, sf_dir):
    return batch.grouped(_files(spark, sf_dir)).select("batch_id", "stem", "n_files", "first_file", F.col("position").cast("long").alias("position"))


@query(f"WITH {_FILES}, n AS (SELECT stem, count(*) FILTER (side IS NULL) AS u, count(*) FILTER (side = 'application') AS a, count(*) FILTER (side = 'label') AS l FROM files GROUP BY stem) SELECT stem, CASE WHEN u > 0 THEN 'reading' WHEN a = 1 AND l = 1 THEN 'pair' WHEN a = 1 AND l = 0 THEN 'application' WHEN a = 0 AND l = 1 THEN 'image' ELSE 'ambiguous' END AS shape FROM n")
def group_shapes(spark, sf_dir):
    return batch.group_shape(_files(spark, sf_dir).withColumn("stem", T.stem(F.col("filename"))), "stem")


@query("SELECT user_id, event_id, CASE WHEN nth > 1 THEN event_type || ' (duplicate, part ' || part || ')' ELSE event_type END AS name FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)")
def duplicate_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("filename"))
    return batch.renamed_duplicates(e, "user_id").select("user_id", F.col("idx").alias("event_id"), "name")


@query(f"WITH {_VERDICT} SELECT l_orderkey AS position, CASE WHEN l_linenumber % 2 = 0 THEN '''=' ELSE '' END || outcome AS outcome, l_linenumber::VARCHAR AS field FROM verdicts")
def flatten_export(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    said = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("="), F.col("outcome"))).otherwise(F.col("outcome"))
    null = F.lit(None).cast("string")
    fields = F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("field"), said.alias("outcome"), null.alias("label_value"), null.alias("application_value"), null.alias("reason"), F.lit(None).cast("double").alias("score")))
    rows = v.groupBy(F.col("l_orderkey").alias("position")).agg(fields.alias("fields")).withColumn("item", F.col("position").cast("string")).withColumn("error", null)
    return batch.export_rows(rows).select("position", "outcome", "field")


# --- merging -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(props, {'v': value, 'e': -event_id}) AS value, arg_max(event_id, {'v': value, 'e': -event_id}) AS sheet FROM events GROUP BY 1, 2")
def merge_best_reading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("props").alias("value"), F.col("value").alias("confidence"), F.col("event_id").alias("sheet_idx"))
    return merge.best_reading(e, "user_id", "event_type")


@query("SELECT conv_id, role, arg_max(text, {'n': length(text), 't': -turn}) AS value, arg_max(turn, {'n': length(text), 't': -turn}) AS sheet FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2")
def merge_longest_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("text").alias("value"), F.lit(0.0).alias("confidence"), F.col("turn").alias("sheet_idx"))
    return merge.longest_text(c, "conv_id", "role")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN c_name END, n_name) AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'typed' WHEN o_orderkey % 2 = 0 AND c_name IS NOT NULL THEN 'form' WHEN n_name IS NOT NULL THEN 'text' ELSE 'absent' END AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def source_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    typed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("value"))
    form = own.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("c_name")).alias("value"))
    text = own.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", F.col("n_name").alias("value"))
    return documents.coalesced(o, [("typed", typed), ("form", form), ("text", text)], "o_orderkey")


@query("""WITH t AS (SELECT user_id, event_type AS arm, round(avg(value), 6) AS confidence, count(*) AS words FROM events GROUP BY 1, 2), s AS (SELECT *, count(*) OVER w AS arms, max(confidence) OVER w AS top FROM t WINDOW w AS (PARTITION BY user_id)),
  c AS (SELECT *, count(*) OVER w AS rivals, max(words) OVER w AS most FROM s WHERE confidence >= top - 1.0 WINDOW w AS (PARTITION BY user_id)),
  d AS (SELECT *, count(*) FILTER (words = most) OVER w AS leaders, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, arm) AS turn FROM c WINDOW w AS (PARTITION BY user_id))
  SELECT user_id, arm, CASE WHEN arms = 1 THEN 'short_circuit' WHEN rivals > 1 AND leaders = 1 THEN 'coverage' ELSE 'confidence' END AS basis FROM d WHERE CASE WHEN rivals > 1 AND leaders = 1 THEN words = most ELSE turn = 1 END""")
def arm_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("confidence"), F.count("*").alias("words"))
    return merge.arm(e, "user_id")


# --- layout and documents ------------------------------------------------------------------------------------------


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    left = (F.col("l_partkey") % 997).cast("int")
    return li.select(F.col("l_orderkey").alias("sheet"), left.alias("left"), (left + F.col("l_quantity").cast("int")).alias("right"), F.lit(12).alias("height"))


@query("""WITH b AS (SELECT l_orderkey AS sheet, (l_partkey % 997)::INT AS l, (l_partkey % 997)::INT + l_quantity::INT AS r FROM lineitem), s AS (SELECT *, max(r) OVER (PARTITION BY sheet ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
  SELECT sheet, reach + 1 AS gap_left, l - 1 AS gap_right FROM s WHERE l > reach + 1""")
def column_gaps(spark, sf_dir):
    return layout.gaps(_boxes(spark, sf_dir), "sheet")


@query("""WITH b AS (SELECT l_orderkey AS sheet, (l_partkey % 997)::INT AS l, (l_partkey % 997)::INT + l_quantity::INT AS r, 12 AS height FROM lineitem), s AS (SELECT *, max(r) OVER (PARTITION BY sheet ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
  g AS (SELECT sheet, reach + 1 AS a, l - 1 AS z, l - 1 - reach AS size FROM s WHERE l > reach + 1 AND l - 1 - reach >= greatest(1, round_even(1100 * 0.025, 0))),
  t AS (SELECT g.sheet, a, z, size, max(least(r - l + 1, height)) FILTER (r >= a - size AND l <= z + size) AS type FROM g JOIN b ON b.sheet = g.sheet GROUP BY ALL),
  c AS (SELECT sheet, (a + z) // 2 AS col_left FROM t WHERE type IS NULL OR size >= 1.25 * type UNION ALL SELECT DISTINCT sheet, 0 FROM b)
  SELECT sheet, (row_number() OVER w - 1)::INT AS column, col_left::INT AS col_left, coalesce(lead(col_left) OVER w, 1100)::INT AS col_right FROM c WINDOW w AS (PARTITION BY sheet ORDER BY col_left)""")
def column_cuts(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return layout.columns(boxes, boxes.select("sheet").distinct().withColumn("width", F.lit(1100)), "sheet")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS i, max(l_quantity) AS h, l_linenumber * 20 AS top FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(i) OVER w AS pi, lag(h) OVER w AS ph, lag(top) OVER w AS pt FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
  m AS (SELECT *, CASE WHEN i = pi + 1 AND greatest(h, ph) - least(h, ph) <= 0.25 * greatest(h, ph) AND top - pt <= 2.5 * greatest(h, ph) THEN 0 ELSE 1 END AS s FROM p), g AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT l_orderkey, island::BIGINT AS island, min(i) AS first_line, count(*) AS n_lines, max(h) AS height FROM g GROUP BY 1, 2""")
def line_blocks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    li = li.select("l_orderkey", F.col("l_linenumber").alias("line_idx"), F.lit(0).alias("column"), F.lit(0).alias("block"), F.col("l_quantity").alias("height"), (F.col("l_linenumber") * 20).alias("top"), F.lit("x").alias("text"), F.lit(1.0).alias("confidence"))
    return layout.blocks(li, "l_orderkey").select("l_orderkey", F.col("island").cast("long").alias("island"), "first_line", "n_lines", "height")


_WORD = "l_orderkey AS sheet, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 100 + CAST(l_quantity AS INT)) AS word_idx, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE l_returnflag END AS text, CAST(l_quantity * 2 - 5 AS DOUBLE) AS conf, CAST(l_partkey % 997 AS INT) AS left, CAST(l_suppkey % 300 AS INT) AS top, CAST(l_quantity AS INT) AS width, CAST(l_suppkey % 40 AS INT) AS height, CAST(l_linenumber % 2 AS INT) AS page, CAST(l_partkey % 2 AS INT) AS column, 1 AS block, 1 AS par, CAST(l_linenumber % 3 AS INT) AS line"


@query(f"""WITH w AS (SELECT {_WORD.replace('AS left', 'AS "left"').replace('AS column', 'AS "column"')} FROM lineitem), g AS (SELECT sheet, page, "column", line, string_agg(text, ' ' ORDER BY word_idx) AS text, round(avg(conf), 1) AS confidence, avg(height) AS height, round(avg(width), 1) AS width, min(top) AS top, min(word_idx) AS first FROM w WHERE trim(text) <> '' AND conf >= 0 GROUP BY 1, 2, 3, 4)
  SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY page, "column", top, first) - 1 AS line_idx, text, confidence, round(height, 6) AS height, width, top, width > 0 AND g.height > width AS sideways FROM g""")
def line_assembly(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").selectExpr(*_split(_WORD))
    return layout.lines(words, "sheet").select("sheet", F.col("line_idx").cast("long").alias("line_idx"), "text", "confidence", F.round("height", 6).alias("height"), "width", "top", "sideways")


def _split(columns: str) -> list[str]:
    """A select list's columns; commas within parentheses part none."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        out[-1] += ch if ch != "," or depth else ""
        if ch == "," and not depth:
            out.append("")
    return out


def _captioned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("head"))
    k = F.col("doc_id") % 4
    rows = F.array(
        F.when(k == 0, F.concat(F.lit("6. BRAND NAME (Required): B"), F.col("doc_id").cast("string"))).otherwise("6. BRAND NAME (Required)"),
        F.when(k == 1, F.concat(F.lit("B"), F.col("doc_id").cast("string"))).when(k == 2, "7. FANCIFUL NAME (If any)").otherwise(" "),
        F.lit("CLASS/TYPE CODE: 141"), F.concat(F.lit("Class/Type Description: 141 - T"), F.col("doc_id").cast("string")), F.lit("NET CONTENTS"), F.lit("STATUS: OPEN"),
    )
    return d.select("doc_id", F.posexplode(rows).alias("line_idx", "text"))


@query("""SELECT doc_id, f AS field, CASE f WHEN 'brand_name' THEN CASE WHEN doc_id % 4 < 2 THEN 'B' || doc_id END WHEN 'class_type' THEN '141 - T' || doc_id END AS value FROM documents, (VALUES ('brand_name'), ('class_type'), ('net_contents')) v(f)
  UNION ALL SELECT doc_id, 'fanciful_name', NULL FROM documents WHERE doc_id % 4 = 2""")
def caption_values(spark, sf_dir):
    """The form's lines stand before the document's own; a fanciful name's caption has its text's first line below it."""
    return documents.caption_values(_captioned(spark, sf_dir), "doc_id")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'wine' WHEN 1 THEN 'malt beverage' END AS product_type FROM documents")
def sole_type(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.concat_ws(" ", F.lit("a"), F.when(k.isin(0, 2), "Wines"), F.when(k.isin(1, 2), "MALT  BEVERAGE"))
    return documents.sole_type(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "t", "doc_id")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice * 10 >= 250000 THEN l_extendedprice * 10 END AS px, l_extendedprice * 10 AS pixels, (l_quantity / 5)::INT AS reads, l_quantity >= 10 AS has_text, l_quantity >= 45 AS ok FROM lineitem),
  r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(reads) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, coalesce(bool_or(ok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM p WINDOW w AS (PARTITION BY l_orderkey, px IS NULL ORDER BY pixels DESC, l_linenumber)),
  s AS (SELECT *, min(rank) FILTER (spent >= 16) OVER v AS sa, min(rank) FILTER (done) OVER v AS da FROM r WINDOW v AS (PARTITION BY l_orderkey, px IS NULL ORDER BY rank ROWS UNBOUNDED PRECEDING))
  SELECT l_orderkey, l_linenumber, CASE WHEN px IS NULL THEN 'too_small' WHEN rank > 8 THEN 'not_read' WHEN da IS NOT NULL AND (sa IS NULL OR da <= sa) THEN 'not_needed' WHEN sa IS NOT NULL THEN 'not_reached' WHEN has_text THEN 'read' ELSE 'no_text' END AS status FROM s""")
def panel_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    panels = li.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.lit(0).alias("page"), (F.col("l_extendedprice") * 10).alias("pixels"), F.round(F.col("l_quantity") / 5).cast("int").alias("reads"), (F.col("l_quantity") >= 10).alias("has_text"), (F.col("l_quantity") >= 45).alias("satisfies"))
    return documents.scan(panels, "l_orderkey").select("l_orderkey", F.col("ordinal").alias("l_linenumber"), "status")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'application' WHEN page_id % 5 = 1 THEN 'application' WHEN page_id % 5 = 2 THEN 'label' WHEN page_id % 5 = 3 THEN 'application' ELSE 'label' END AS side, CASE page_id % 5 WHEN 0 THEN 'pdf_content' WHEN 1 THEN 'pdf_declared' WHEN 2 THEN 'undecodable' WHEN 3 THEN 'form_marks' ELSE 'no_marks' END AS basis FROM pages")
def classify_files(spark, sf_dir):
    k = F.col("page_id") % 5
    head = F.encode(F.when(k == 0, "%PDF-1.7").otherwise(F.substring("html", 1, 8)), "UTF-8")
    text = F.when(k == 3, F.concat(F.lit("TTB F 5100.31 "), F.col("html"))).otherwise(F.col("html"))
    side = documents.file_side(F.when(k == 1, "application/pdf").otherwise("image/png"), head, text, k != 2, F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", side.alias("s")).select("page_id", "s.*")


# --- quality -------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT source, CASE WHEN quality = 1 THEN 'match' ELSE 'mismatch' END AS truth, CASE WHEN n_chars > 1200 THEN 'match' WHEN n_chars > 600 THEN 'needs_review' ELSE 'mismatch' END AS reported FROM labels JOIN documents USING (doc_id))
  SELECT source, count(*) FILTER (reported = 'match' AND truth = 'match') / nullif(count(*) FILTER (reported = 'match'), 0) AS precision, count(*) FILTER (reported = 'match' AND truth = 'match') / nullif(count(*) FILTER (truth = 'match'), 0) AS recall,
  count(*) FILTER (reported = 'needs_review') / count(*) AS review_rate, count(*) FILTER (reported = 'match' AND truth = 'mismatch') / nullif(count(*) FILTER (reported = 'match'), 0) AS false_match FROM v GROUP BY source""")
def quality_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    n = F.col("n_chars")
    said = d.select("source", F.when(F.col("quality") == 1, "match").otherwise("mismatch").alias("truth"), F.when(n > 1200, "match").when(n > 600, "needs_review").otherwise("mismatch").alias("reported"))
    return quality.metrics(said, "source")


@query("SELECT event_type, min(value) AS least, round(avg(value), 6) AS mean, median(value) AS median, max(value) AS most FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    return quality.latencies(table(spark, sf_dir, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


def queries() -> dict:
    from . import batches, chain, papers, searches, streams, verdicts  # noqa: F401  they register their queries

    return dict(FOUND)


def oracle_sql() -> dict:
    queries()
    return dict(ORACLES)
