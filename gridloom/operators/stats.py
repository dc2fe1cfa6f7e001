"""Grouped statistics of integers and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.colors import truncated_mean


def simple(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 for a single value)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"), F.count(value).alias("n"))


def sample(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As ``simple``, with mode (smallest of ties), integer median, median frequency and number of distinct values.

    Works on the histogram, so a group is as large as its distinct values, and hot groups are pre-aggregated.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*keys)
    ranked = hist.withColumn("upto", F.sum("c").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)
    pick = lambda col, k: F.max(F.when(at(k), F.col(col)))
    total, squares, n = F.sum(F.col("v") * F.col("c")), F.sum(F.col("v") * F.col("v") * F.col("c")), F.first("n")
    mean = total / n
    half = lambda s: F.when(s < 0, -F.floor(-s / 2)).otherwise(F.floor(s / 2))
    return ranked.groupBy(*keys).agg(
        mean.alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest((squares - total * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))).otherwise(F.lit(0.0)).alias("deviation"),
        F.min_by("v", F.struct(-F.col("c"), "v")).alias("mode"),
        half(pick("v", lower) + pick("v", upper)).alias("median"),
        half(pick("c", lower) + pick("c", upper)).alias("median_frequency"),
        F.count(F.lit(1)).alias("bins"),
        n.alias("n"),
    )


def percentile(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """The element at place n * percent / 100 of the sorted values; null for 100 and beyond."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*keys)
    ranked = hist.withColumn("upto", F.sum("c").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    place = F.floor(F.col("n") * percent / 100)
    return ranked.groupBy(*keys).agg(F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("v"))).alias("value"))


def colors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Truncated mean and sample deviation of r, g and b."""
    out = []
    for c in "rgb":
        out += [truncated_mean(F.sum(c), F.count(c)).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_deviation")]
    return df.groupBy(*keys).agg(*out)


def color_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable channel sums and the truncated average colour."""
    sums = [F.sum(c).alias(f"{c}_sum") for c in "rgb"]
    return df.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"), *(truncated_mean(F.sum(c), F.count(c)).alias(f"{c}_average") for c in "rgb"))


def merge_color_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merges rows of ``color_sums`` without going back to the pixels."""
    return df.groupBy(*keys).agg(*(F.sum(f"{c}_sum").alias(f"{c}_sum") for c in "rgb"), F.sum("n").alias("n")).select("*", *(truncated_mean(F.col(f"{c}_sum"), F.col("n")).alias(f"{c}_average") for c in "rgb"))


def retract_color_sums(whole: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """``whole`` without what ``part`` summed up: rows of ``color_sums`` on either side. Groups that nothing is left of have null averages."""
    sums = [*(f"{c}_sum" for c in "rgb"), "n"]
    taken = part.select(*keys, *(F.col(c).alias(f"part_{c}") for c in sums))
    left = whole.join(taken, keys, "left").select(*keys, *((F.col(c) - F.coalesce(f"part_{c}", F.lit(0))).alias(c) for c in sums))
    return left.select("*", *(truncated_mean(F.col(f"{c}_sum"), F.col("n")).alias(f"{c}_average") for c in "rgb"))
