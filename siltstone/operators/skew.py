"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first counted by (key, value); a hot key is then only as many rows as it has distinct
values, spread over all tasks. Counts, exact distinct counts, modes and percentiles per key
come from those weighted values.

Defined results: a null key is a group of its own and is kept (callers drop it); a null value
counts as a row but is no distinct value, no mode and enters no percentile. Ties for the mode go
to the least value. No rows give no groups. Percentiles interpolate linearly, as over the
expanded values. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compress(df: DataFrame, by: tuple[str, ...], value: Column) -> DataFrame:
    """(by..., value, weight): one row per distinct value of a key, with its number of rows."""
    return df.select(*by, value.alias("value")).groupBy(*by, "value").agg(F.count("*").alias("weight"))


def summarise(weighted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per key: n rows, n_values distinct values, mode and its weight. Every aggregate combines before the shuffle."""
    known = F.col("value").isNotNull()
    # least value of the greatest weight: order by weight, then by the complement through min
    best = F.max(F.when(known, F.col("weight")))
    first = weighted.groupBy(*by).agg(
        F.sum("weight").alias("n"),
        F.count("value").alias("n_values"),
        best.alias("mode_weight"),
        F.min_by(F.when(known, F.col("value")), F.when(known, F.struct(-F.col("weight"), F.col("value")))).alias("mode"),
    )
    return first


def percentiles(weighted: DataFrame, by: tuple[str, ...], measure: Column, points: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact percentiles per key of a number made from the weighted values: (by..., p50, p90, ...).

    The weights are summed by (key, number) first. The number should have a bounded range (a
    length, a size class): one buffer holds a key's distinct numbers, at most that range.
    """
    w = weighted.where(measure.isNotNull()).groupBy(*by, measure.cast("double").alias("number")).agg(F.sum("weight").alias("w"))
    return w.groupBy(*by).agg(*(F.percentile("number", F.lit(p), F.col("w")).alias(f"p{round(p * 100)}") for p in points))


def heavy_keys(summary: DataFrame, totals: DataFrame, share: float, by: str = "table_name") -> DataFrame:
    """Keys that hold at least ``share`` of all rows of their table.

    ``totals`` has one row per table with its number of rows, ``total``, null keys included.
    """
    # decimal, so that a key with just the share counts
    least = F.col("total").cast("decimal(20,0)") * F.lit(str(share)).cast("decimal(12,9)")
    return summary.join(F.broadcast(totals), by).where(F.col("key").isNotNull() & (F.col("n").cast("decimal(20,0)") >= least))
