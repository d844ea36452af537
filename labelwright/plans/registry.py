"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

FOUND: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table by expressions that Spark and the oracles share."""
    return table(spark, sf_dir, name).selectExpr(*columns)


def sql_normalized(c: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(translate({c}, '{T.QUOTES}', '{T.STRAIGHT.replace(chr(39), chr(39) * 2)}'), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g')))"


def sql_missing(c: str) -> str:
    return f"(coalesce(trim({c}), '') = '')"


def sql_lcs(name: str, pairs: str) -> str:
    """CTEs: name(a, b, lcs) for each distinct (a, b) of pairs, by the bits of one number a row; b has at most 60 characters."""
    return f"""{name}_d AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL),
{name}_r AS (SELECT a, b, 0 AS i, ((1::BIGINT << length(b)) - 1) AS r FROM {name}_d
  UNION ALL SELECT a, b, i + 1, ((r + h) | (r - h)) & ((1::BIGINT << length(b)) - 1) FROM
    (SELECT a, b, i, r, r & coalesce(list_sum([CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN 1::BIGINT << (j - 1) ELSE 0 END FOR j IN range(1, length(b) + 1)]), 0)::BIGINT AS h FROM {name}_r WHERE i < length(a))),
{name} AS (SELECT a, b, length(b) - bit_count(r) AS lcs FROM {name}_r WHERE i = length(a))"""


def sql_found(name: str, pairs: str, keys: str) -> str:
    """CTEs: name(keys, hit, score, unit), the best window of each group of pairs (keys, needle, unit, text)."""
    words = lambda c: f"list_filter([{{'p': x, 'n': {sql_normalized('x')}}} FOR x IN string_split_regex(trim({c}), '\\s+')], lambda t: t.n <> '')"
    return f"""{name}_t AS (SELECT {keys}, unit, {words('text')} AS w, [t.n FOR t IN {words('needle')}] AS want, {sql_normalized('needle')} AS goal FROM ({pairs})),
{name}_s AS (SELECT *, len(want) AS n, len(w) AS m FROM {name}_t WHERE len(want) > 0 AND len(w) > 0),
{name}_e AS (SELECT {keys}, unit, n AS size, s AS start, w[s : s + n - 1] AS c, 100.0::DOUBLE AS raw, 1 AS sure FROM (SELECT *, unnest(range(1, m + 1)) AS s FROM {name}_s) WHERE [t.n FOR t IN w[s : s + n - 1]] = want),
{name}_w AS (SELECT {keys}, unit, goal, size, start, w[start : start + size - 1] AS c FROM (SELECT *, unnest(range(1, m - size + 2)) AS start FROM
  (SELECT *, unnest([n + d FOR d IN [-1, 0, 1] IF n + d BETWEEN 1 AND m]) AS size FROM {name}_s s WHERE NOT EXISTS (SELECT 1 FROM {name}_e e WHERE {' AND '.join(f'e.{k.strip()} = s.{k.strip()}' for k in keys.split(','))})))),
{name}_x AS (SELECT *, array_to_string([t.n FOR t IN c], ' ') AS seen FROM {name}_w),
{sql_lcs(f'{name}_l', f'SELECT seen AS a, goal AS b FROM {name}_x')},
{name}_a AS (SELECT {keys}, unit, size, start, c, raw, sure FROM {name}_e UNION ALL SELECT {keys}, unit, size, start, c, CASE WHEN length(seen) + length(goal) = 0 THEN 100 ELSE 200.0 * lcs / (length(seen) + length(goal)) END, 0 FROM {name}_x JOIN {name}_l ON seen = a AND goal = b),
{name} AS (SELECT {keys}, array_to_string([t.p FOR t IN c], ' ') AS hit, round(raw, 1) AS score, unit FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sure DESC, raw DESC, unit, size, start) AS turn FROM {name}_a) WHERE turn = 1)"""


def sql_verified(name: str, pairs: str, keys: str, strip: str = "true") -> str:
    """CTEs: name(keys, hit, score, unit, code, outcome), searched again without a trailing code where that is asked and better."""
    same = " AND ".join(f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(","))
    code = r"regexp_extract(needle, '^(.*\S)\s+([A-Z0-9]{1,3})\s*$', 1)"
    return f"""{name}_p AS ({pairs}),
{sql_found(f'{name}_1', f'SELECT * FROM {name}_p', keys)},
{name}_q AS (SELECT * EXCLUDE needle, {code} AS needle FROM {name}_p p WHERE ({strip}) AND {code} <> '' AND NOT EXISTS (SELECT 1 FROM {name}_1 f WHERE {same.format('f', 'p')} AND f.score >= 95)),
{sql_found(f'{name}_2', f'SELECT * FROM {name}_q', keys)},
{name} AS (SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, CASE WHEN better THEN s.hit ELSE f.hit END AS hit, CASE WHEN better THEN s.score ELSE f.score END AS score, CASE WHEN better THEN s.unit ELSE f.unit END AS unit,
  CASE WHEN better THEN regexp_extract(needle, '([A-Z0-9]{{1,3}})\\s*$', 1) END AS code,
  CASE WHEN coalesce(CASE WHEN better THEN s.score ELSE f.score END, -1) < 80 THEN 'mismatch' WHEN CASE WHEN better THEN s.score ELSE f.score END < 95 THEN 'needs_review' ELSE 'match' END AS outcome
  FROM (SELECT DISTINCT {keys}, needle FROM {name}_p) a LEFT JOIN {name}_1 f ON {same.format('a', 'f')} LEFT JOIN {name}_2 s ON {same.format('a', 's')}, LATERAL (SELECT coalesce(s.score > coalesce(f.score, -1), false) AS better))"""


#: An alcohol content's readings in SQL, for a subquery with a text column c.
_NUMBER = r"\d+(?:\.\d+)?"


def sql_abv(c: str) -> str:
    """A struct (percent, proof, low, high)."""
    text = rf"regexp_replace({c}, '(?i)(\d+)[-–°·,](\d)(\s*proof\b)', '\1.\2\3')"
    rest = rf"regexp_replace({text}, '(?i)({_NUMBER})\s*proof', ' ', 'g')"
    number = lambda t, p, g=1: rf"try_cast(nullif(regexp_extract({t}, '{p}', {g}), '') AS DOUBLE)"
    span = rf"(?i)({_NUMBER})\s*(?:%|percent)?\s*(?:to|-|–)\s*({_NUMBER})\s*(?:%|percent)"
    low, high = number(rest, span, 1), number(rest, span, 2)
    proof, bare = rf"(?i)({_NUMBER})\s*proof", rf"^\s*({_NUMBER})\s*$"
    percent = rf"(?i)({_NUMBER})\s*(?:%|percent)"
    return f"{{'percent': CASE WHEN {low} IS NULL THEN coalesce({number(rest, percent)}, {number(rest, bare)}) END, 'proof': {number(text, proof)}, 'low': {low}, 'high': {high}}}"


def sql_net(c: str, units: dict[str, tuple[str, ...]]) -> str:
    """A struct (value, unit): a number against a unit in any of its spellings, else a bare number."""
    spelled = {n: (rf"fl\.?\s*{n[2:]}" if n == "floz" else rf"{n[:5]}\s*{n[5:]}" if n.startswith(("fluid", "milli", "centi")) else n) for names in units.values() for n in names}
    every = "|".join(sorted(spelled.values(), key=len, reverse=True))
    value, unit = (rf"regexp_extract({c}, '(?i)({_NUMBER})\s*({every})\b', {g})" for g in (1, 2))
    folded = rf"regexp_replace(lower({unit}), '[\s.]', '', 'g')"
    cases = " ".join(f"WHEN {folded} IN ({', '.join(repr(n) for n in names)}) THEN '{u}'" for u, names in units.items())
    bare = rf"regexp_extract({c}, '^\s*({_NUMBER})\s*$', 1)"
    return f"{{'value': coalesce(try_cast(nullif({value}, '') AS DOUBLE), try_cast(nullif({bare}, '') AS DOUBLE)), 'unit': CASE WHEN {value} <> '' THEN CASE {cases} END END}}"
