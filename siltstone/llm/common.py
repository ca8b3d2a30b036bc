"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Give a narrow, CPU-heavy step enough tasks.

    A scan makes at least one split a core once every core has a file's opening cost to read; only smaller inputs
    are redistributed, round robin, so no key can pile up. The size is that of the plan's sources: nothing is run for it.
    ``tasks`` sets the number instead.
    """
    if tasks:
        return df.repartition(tasks)
    cores = df.sparkSession.sparkContext.defaultParallelism
    opening = df.sparkSession._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df if size >= cores * opening else df.repartition(cores)
