"""The stop of a scan of a document's pictures: whether the panels read so far show all that a check will look for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.similarity import lcs_length
from ..functions.text import missing
from ..vocab import FIELDS
from . import documents, reading, search

#: Fields that are searched for where the document declares them; a panel shows the others if they are read off it.
ASKED = ("brand_name", "class_type")


def shown(lines: DataFrame, declared: DataFrame, *keys: str, settings: Settings = DEFAULT, common=lcs_length) -> DataFrame:
    """(keys, ordinal, and a boolean for each of the five fields): what each panel shows of what is asked of its document.

    lines: keys, ordinal and the columns of layout.lines(); declared: keys, field, declared. A declared brand or class is
    shown by a hit at match level in one of the panel's units, of a class also without its trailing code; an undeclared one,
    and every other field, by the panel's own reading.

    Hits are those of each panel's units. A search of several panels' units together finds the value at match level just where
    one of them does, so documents.satisfied() over the panels' ranks is that search, without making it again for each panel.
    """
    panel = (*keys, "ordinal")
    read = reading.fields(lines, *panel, settings=settings)
    own = read.groupBy(*panel).agg(*[F.bool_or((F.col("field") == f) & F.col("value").isNotNull()).alias(f"own_{f}") for f in FIELDS])
    asked = declared.where(F.col("field").isin(*ASKED) & ~missing(F.col("declared"))).select(*keys, "field", F.trim("declared").alias("needle"))
    needed = asked.groupBy(*keys).agg(F.collect_list(F.struct("field", "needle")).alias("asks"), *[F.bool_or(F.col("field") == f).alias(f"asks_{f}") for f in ASKED])
    pairs = needed.select(*keys, search.asked(F.col("asks")).alias("asks")).select("*", search.goals(F.col("asks")).alias("goals")).join(search.units(lines, *panel), list(keys))
    best = search.unit_hits(pairs, *panel, common=common).groupBy(*panel).agg(
        *[F.max(F.when(F.col("field") == f, F.round("raw", 1))).alias(f"hit_{f}") for f in ASKED]
    )
    both = own.join(best, list(panel), "left").join(needed.drop("asks"), list(keys), "left")
    hit = lambda f: F.coalesce(F.col(f"hit_{f}") >= settings.match_threshold, F.lit(False))
    shows = {f: F.when(F.coalesce(f"asks_{f}", F.lit(False)), hit(f)).otherwise(F.col(f"own_{f}")) if f in ASKED else F.col(f"own_{f}") for f in FIELDS}
    return both.select(*panel, *[c.alias(f) for f, c in shows.items()])


def scanned(panels: DataFrame, lines: DataFrame, declared: DataFrame, *keys: str, settings: Settings = DEFAULT, common=lcs_length) -> DataFrame:
    """panels (keys, ordinal, page, pixels, reads, has_text) with rank, satisfies and status: documents.scan() with the stop computed.

    satisfies: with this panel, those that fit and can be read show all five fields. Panels without lines show nothing.
    """
    seen = shown(lines, declared, *keys, settings=settings, common=common).withColumnRenamed("government_warning", "warning")
    legible = F.coalesce("has_text", F.lit(False))
    names = ("brand_name", "class_type", "alcohol_content", "net_contents", "warning")
    every = panels.join(seen, [*keys, "ordinal"], "left").withColumns({c: legible & F.coalesce(c, F.lit(False)) for c in names})
    fits = every.withColumn("fits", F.col("pixels") >= settings.min_pixels)
    ranked = fits.withColumn("rank", F.row_number().over(documents.by_area(*keys, "fits")))
    return documents.scan(documents.satisfied(ranked, *keys, "fits").drop("rank", "fits", *names), *keys, settings=settings)
