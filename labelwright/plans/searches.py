"""Queries of the search: the index of words, the pass in order, and needles longer than the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.register import register
from ..functions.similarity import lcs_length_udf
from ..operators import search
from .registry import query, sql_lcs, sql_normalized, sql_verified, table

#: Documents in which a part's name stands, damaged; the others hold near hits by chance only.
_TEXTS = "SELECT doc_id, CASE WHEN p_name IS NULL THEN text WHEN doc_id % 3 = 0 THEN concat(translate(p_name, 'et', 'ci'), ' - ', text) ELSE concat(text, ' The ', replace(p_name, ' ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '  ' END), ', ', doc_id) END AS text FROM documents LEFT JOIN part ON p_partkey = doc_id"
_ASCII = r"regexp_replace({0}, '[^\x00-\x7F]', '~', 'g')"


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT {sql_normalized('p_name')} AS needle FROM part WHERE p_name IS NOT NULL),
t AS (SELECT doc_id, list_filter([{{'p': x, 'n': {sql_normalized('x')}}} FOR x IN string_split_regex(trim(text), '\\s+')], lambda t: t.n <> '') AS w FROM ({_TEXTS})),
z AS (SELECT DISTINCT unnest([k - 1, k, k + 1]) AS size FROM (SELECT len(string_split(needle, ' ')) AS k FROM n)),
r AS (SELECT doc_id, size, start, array_to_string([x.n FOR x IN w[start : start + size - 1]], ' ') AS seen, array_to_string([x.p FOR x IN w[start : start + size - 1]], ' ') AS hit FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM t, z WHERE size >= 1)),
d AS (SELECT DISTINCT seen, size FROM r),
c AS (SELECT seen AS a, needle AS b, size FROM d, n WHERE abs(size - len(string_split(needle, ' '))) <= 1 AND 2 * least(length(seen), length(needle)) >= 0.79 * (length(seen) + length(needle)) AND levenshtein({_ASCII.format('seen')}, {_ASCII.format('needle')}) <= 0.201 * (length(seen) + length(needle))),
{sql_lcs('l', 'SELECT a, b FROM c')},
s AS (SELECT b AS needle, doc_id, hit, r.size, start, 200.0 * lcs / (length(a) + length(b)) AS raw FROM c JOIN l USING (a, b) JOIN r ON r.seen = a AND r.size = c.size)
SELECT needle, doc_id, hit, round(raw, 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY needle, doc_id ORDER BY raw DESC, size, start) AS turn FROM s WHERE round(raw, 1) >= 80) WHERE turn = 1""")
def search_names_in_documents(spark, sf_dir):
    """Every part name in every document, by the index of words: the best run of each pair that reaches review."""
    for name in ("documents", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_{name}_searched")
    texts = spark.sql(_TEXTS.replace("FROM documents", "FROM _documents_searched").replace("JOIN part", "JOIN _part_searched"))
    return search.reaching(table(spark, sf_dir, "part").select(F.col("p_name").alias("needle")), texts, "doc_id", common=lcs_length_udf(spark))


_PASSED = """SELECT p_partkey, 0 AS unit, concat('old ', upper(translate(p_name, 'e', 'c')), ' or ', translate(p_name, 'e', 'c'), ' x ', translate(p_name, 'g', 'q')) AS text, p_name AS needle FROM part
  UNION ALL SELECT p_partkey, 1, concat(upper(translate(p_name, 'eo', 'cu')), ' ', p_type, ' ', upper(translate(p_name, 'e', 'c'))), p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 2, p_type, concat('the ', p_name, ' ', p_brand) FROM part WHERE p_partkey % 5 = 0"""


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey, unit, needle, text FROM ({_PASSED})),
g AS (SELECT p_partkey, needle, unit, [x.n FOR x IN w] AS norm, [x.p FOR x IN w] AS printed, {sql_normalized('needle')} AS goal FROM (SELECT *, list_filter([{{'p': x, 'n': {sql_normalized('x')}}} FOR x IN string_split_regex(trim(text), '\\s+')], lambda t: t.n <> '') AS w FROM p)),
w AS (SELECT p_partkey, needle, goal, unit, size, start, array_to_string(norm[start : start + size - 1], ' ') AS seen, array_to_string(printed[start : start + size - 1], ' ') AS hit FROM (SELECT *, unnest(range(1, len(norm) - size + 2)) AS start FROM (SELECT *, unnest([len(string_split(goal, ' ')) + d FOR d IN [-1, 0, 1] IF len(string_split(goal, ' ')) + d BETWEEN 1 AND len(norm)]) AS size FROM g))),
{sql_lcs('l', 'SELECT seen AS a, goal AS b FROM w')},
o AS (SELECT p_partkey, needle, hit, 200.0 * lcs / (length(seen) + length(goal)) AS raw, row_number() OVER (PARTITION BY p_partkey, needle ORDER BY unit, size, start) AS turn FROM w JOIN l ON seen = a AND goal = b),
f AS (SELECT p_partkey, needle, turn, round(raw, 1) AS best, hit FROM o WHERE turn = 1
  UNION ALL SELECT f.p_partkey, f.needle, o.turn, CASE WHEN raw > best THEN round(raw, 1) ELSE best END, CASE WHEN raw > best THEN o.hit ELSE f.hit END FROM f JOIN o ON o.p_partkey = f.p_partkey AND o.needle = f.needle AND o.turn = f.turn + 1),
e AS (SELECT p_partkey, needle, hit AS earliest FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, needle ORDER BY raw DESC, turn) AS k FROM o) WHERE k = 1)
SELECT p_partkey, needle, f.hit, best AS score, earliest, f.hit <> earliest AS differs FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, needle ORDER BY turn DESC) AS k FROM f) f JOIN e USING (p_partkey, needle) WHERE k = 1""")
def search_strict(spark, sf_dir):
    """The hit that a pass in order ends with, which compares raw scores with a rounded best, beside the earliest best one."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_passed_parts")
    pairs = spark.sql(_PASSED.replace("FROM part", "FROM _passed_parts"))
    one = lambda strict: search.found(pairs.withColumn("asked", F.col("needle")), "p_partkey", "asked", common=lcs_length_udf(spark), strict=strict)
    plain = one(False).select("p_partkey", "asked", F.col("hit").alias("earliest"))
    return one(True).join(plain, ["p_partkey", "asked"]).select("p_partkey", F.col("asked").alias("needle"), "hit", "score", "earliest", (F.col("hit") != F.col("earliest")).alias("differs"))


_SHORT = "SELECT p_partkey, 0 AS unit, concat('the ', p_name, ' company') AS needle, CASE p_partkey % 4 WHEN 0 THEN replace(concat('the', p_name, 'company'), ' ', '') WHEN 1 THEN concat('the', replace(p_name, ' ', ''), ' company') WHEN 2 THEN concat('the ', p_name, ' companies') ELSE ' - ' END AS text FROM part UNION ALL SELECT p_partkey, 1, concat('the ', p_name, ' company'), p_type FROM part WHERE p_partkey % 2 = 0"


@query(f"WITH RECURSIVE {sql_verified('v', _SHORT, 'p_partkey')} SELECT p_partkey, hit, score, code, outcome FROM v")
def search_short_units(spark, sf_dir):
    """Needles in units with fewer words than they have: a run of one word less is the shortest that is compared."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_short_parts")
    return search.verified(spark.sql(_SHORT.replace("FROM part", "FROM _short_parts")), "p_partkey", common=lcs_length_udf(spark)).select("p_partkey", "hit", "score", "code", "outcome")


#: Texts with signs that stand for others: a ligature, a fraction, a sharp s, a dotted capital I, wide letters, an accent on its own.
_SIGNED = "replace(replace(replace(replace(replace(replace(text, 'fi', 'ﬁ'), 'on', 'on½'), 'ss', 'ß'), 'D', 'İ'), 'th', 'ｔＨ'), 'é', concat('e', chr(769)))"
_SPELT = "replace(replace(replace(replace(replace(replace({0}, 'ﬁ', 'fi'), '½', '1⁄2'), 'ß', 'ss'), 'İ', concat('i', chr(775))), 'ｔＨ', 'th'), concat('e', chr(769)), 'é')"


@query(f"SELECT doc_id, md5({sql_normalized(_SPELT.format(_SIGNED))}) AS folded, length({_SIGNED}) AS size FROM documents WHERE text IS NOT NULL")
def strict_texts(spark, sf_dir):
    """NFKC and casefold by native functions, of whole texts with signs that it changes; lower case that keeps lengths."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_signed_documents")
    signed = spark.sql(f"SELECT doc_id, {_SIGNED.replace('chr(769)', 'decode(unhex(\'CC81\'), \'UTF-8\')')} AS text FROM _signed_documents WHERE text IS NOT NULL")
    lower = T.lower_same_length(F.col("text"))
    return signed.select("doc_id", F.md5(T.strict_folded(spark)(F.col("text"))).alias("folded"), F.length(lower).cast("long").alias("size"))


_DAMAGED = "concat(translate(p_name, 'ei', 'cl'), ' ', p_size % 10)"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey, p_name AS a, {_DAMAGED} AS b, CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS c FROM part), {sql_lcs('l', 'SELECT b AS a, a AS b FROM p')}
SELECT p_partkey, {sql_normalized('upper(p.b)')} AS norm, coalesce(trim(c), '') = '' AS missing, lower(regexp_replace(p.a, ' ', '_')) || '.' || p_partkey AS stem, lcs, round(200.0 * lcs / (length(p.a) + length(p.b)), 6) AS ratio, {sql_normalized('p.b')} || ' fi' AS strict, p.a AS expected, p.b AS observed
FROM p JOIN l ON l.a = p.b AND l.b = p.a""")
def sql_functions_text(spark, sf_dir):
    """Every registered function from SQL, on names and what damage made of them."""
    register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("_damaged_parts")
    spark.sql(f"SELECT *, {_DAMAGED} AS damaged, CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS c FROM _damaged_parts").createOrReplaceTempView("_damaged_names")
    return spark.sql("""SELECT p_partkey, lw_normalized(upper(damaged)) AS norm, lw_missing(c) AS missing, lw_stem(concat('a/b\\\\', replace(initcap(p_name), ' ', '_'), '.', p_partkey, '.png')) AS stem, lw_lcs(damaged, p_name) AS lcs, round(lw_ratio(damaged, p_name), 6) AS ratio, lw_strict_normalized(concat(damaged, ' \ufb01')) AS strict,
        array_join(transform(filter(lw_differences(damaged, p_name), d -> d.kind <> 'added'), d -> d.text), '') AS expected, array_join(transform(filter(lw_differences(damaged, p_name), d -> d.kind <> 'missing'), d -> d.text), '') AS observed FROM _damaged_names""")
