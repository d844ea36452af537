"""Scalars of this package as SQL functions, under the prefix lw_."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .similarity import differences, lcs_length_udf
from .text import strict_normalized


def register(spark: SparkSession) -> None:
    """For this session: lw_normalized, lw_stem, lw_missing, lw_ratio by SQL; lw_lcs, lw_strict_normalized, lw_differences by Arrow."""
    from .text import QUOTES, STRAIGHT

    quoted = STRAIGHT.replace("'", "\\'")
    made = {
        "lw_missing(x STRING) RETURNS BOOLEAN": r"coalesce(trim(regexp_replace(x, '(?U)\\s+', ' ')), '') = ''",
        "lw_normalized(x STRING) RETURNS STRING": rf"lower(trim(regexp_replace(regexp_replace(translate(x, '{QUOTES}', '{quoted}'), '\\p{{P}}', ' '), '(?U)\\s+', ' ')))",
        "lw_stem(x STRING) RETURNS STRING": r"lower(regexp_replace(regexp_extract(x, '([^/\\\\]*)$', 1), '(?<=.)\\.[^.]*$', ''))",
        "lw_ratio(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN length(a) + length(b) = 0 THEN 100D ELSE 200D * lw_lcs(a, b) / (length(a) + length(b)) END",
    }
    for name, function in (("lw_lcs", lcs_length_udf), ("lw_strict_normalized", strict_normalized), ("lw_differences", differences)):
        spark.udf.register(name, function(spark))
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
