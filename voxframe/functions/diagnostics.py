"""Run times and sizes: summaries of measured operations and readable forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def summary(runs: DataFrame, operation: str, value: str) -> DataFrame:
    """Count, total, extremes, mean and share of all time of each operation."""
    each = runs.groupBy(operation).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    # one row an operation: a window over them all is small
    return each.withColumn("mean", F.col("total") / F.col("n")).withColumn("percent", 100 * F.col("total") / F.sum("total").over(Window.partitionBy()))


def compared(runs: DataFrame, operation: str, value: str, baseline: Column) -> DataFrame:
    """Mean of the runs where ``baseline`` holds and of the others, and how many times faster the others are, for operations that have both."""
    each = runs.groupBy(operation).agg(F.avg(F.when(baseline, F.col(value))).alias("baseline"), F.avg(F.when(~baseline, F.col(value))).alias("other"))
    return each.where("baseline IS NOT NULL AND other IS NOT NULL").withColumn("speedup", F.col("baseline") / F.nullif(F.col("other"), F.lit(0.0)))


def duration(ms: Column) -> Column:
    """Milliseconds in the unit that suits them."""
    ms = ms.cast("double")
    return F.when(ms < 1, F.format_string("%.1f us", ms * 1000)).when(ms < 1000, F.format_string("%.1f ms", ms)).when(ms < 60000, F.format_string("%.2f s", ms / 1000)).otherwise(F.format_string("%d min %.0f s", F.floor(ms / 60000), ms % 60000 / 1000))


def size(count: Column) -> Column:
    """Bytes in the unit that suits them."""
    out = F.format_string("%.1f TB", count / F.lit(1024.0**4))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(count < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", count / F.lit(1024.0**k))).otherwise(out)
    return F.when(count < 1024, F.format_string("%d B", count.cast("long"))).otherwise(out)
