"""Exact quantiles of many groups at once, by intervals that narrow; no task holds a group's values.

Each group has an interval for each rank that is asked for, first from its least to its greatest value. A round deals the values
inside into BUCKETS of equal width and keeps their counts, least and greatest values; the bucket that holds the rank is the
next interval, from its own least to its own greatest value. Counts are summed in each task before they are shuffled, so a
group of any size gives a task at most BUCKETS rows a rank. As many rounds follow as bring SMALL values an interval, where values
are spread evenly; the last step counts what is left by value and gives the rank's, however much that is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, SMALL, BROADCAST = 1024, 10_000, 1 << 20
#: The greatest finite double.
EDGE = math.nextafter(math.inf, 0)


def quantiles(df: DataFrame, value: str, fractions: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, n, least, mean, most, quantiles): of a number column; quantiles is an array with one for each fraction, 0 to 1.

    A quantile between two values is interpolated, at place (n - 1) * fraction from 0, so that the median of an even number is
    the mean of the two in the middle. Nulls and NaN are left out; a group of nothing else has n = 0 and nulls. Infinite values
    count as the greatest finite doubles. An empty table gives none.
    """
    number = F.col(f"`{value}`").cast("double")
    own = df.select(*keys, F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.least(number, F.lit(EDGE)), F.lit(-EDGE))).alias("v"))
    whole = own.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    size = whole.agg(F.max("n").alias("n"), F.count("*").alias("groups")).first()
    places = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    state = whole.where("n > 0").select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    few = size["groups"] * 2 * len(fractions) <= BROADCAST
    for _ in range(max(0, math.ceil(math.log(max(size["n"] or 1, 1) / SMALL, BUCKETS)))):
        state = _narrowed(_inside(own, state, keys, few), keys)
    at = _inside(own, state, keys, few).groupBy(*keys, "rank", "before", "v").agg(F.count("*").alias("count"))
    found = _holding(at.withColumnRenamed("v", "bucket"), keys).select(*keys, "rank", F.col("bucket").alias("x"))
    got = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    both = whole.join(_same(got, keys), _equal(keys), "left").drop(*[f"_{k}" for k in keys])

    def between(p: Column) -> Column:
        low, high = F.try_element_at("at", F.floor(p)), F.try_element_at("at", F.ceil(p))
        part = p - F.floor(p)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return both.select(*keys, "n", "least", "mean", "most", F.when(F.col("n") > 0, F.array(*map(between, places))).alias("quantiles"))


def _same(df: DataFrame, keys) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _equal(keys) -> Column:
    """Keys are equal, nulls too."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def _inside(own: DataFrame, state: DataFrame, keys, few: bool) -> DataFrame:
    """The values in each rank's interval. Few groups' intervals are broadcast, and values stay where they are."""
    held = _same(state, keys)
    return own.join(F.broadcast(held) if few else held, _equal(keys) & F.col("v").between(F.col("lo"), F.col("hi"))).drop(*[f"_{k}" for k in keys])


def _narrowed(values: DataFrame, keys) -> DataFrame:
    """Each rank's next interval. An interval of SMALL values or fewer, or of one value, is one bucket."""
    half = F.col("hi") / 2 - F.col("lo") / 2  # a whole difference may be too large
    place = F.floor((F.col("v") / 2 - F.col("lo") / 2) / half * BUCKETS)
    bucket = F.when((F.col("inside") > SMALL) & (half > 0), F.least(place, F.lit(BUCKETS - 1))).otherwise(0)
    counts = values.groupBy(*keys, "rank", "before", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    held = _holding(counts, keys)
    return held.select(*keys, "rank", (F.col("before") + F.col("so_far") - F.col("count")).alias("before"), F.col("count").alias("inside"), "lo", "hi")


def _holding(counts: DataFrame, keys) -> DataFrame:
    """Of counts (keys, rank, before, bucket, count) the bucket that each rank is in; before: values below the first bucket."""
    order = Window.partitionBy(*keys, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = counts.withColumn("so_far", F.sum("count").over(order))
    inside = F.col("rank") - F.col("before")
    return seen.where((inside < F.col("so_far")) & (inside >= F.col("so_far") - F.col("count")))
