"""Row numbers and lags over one global order, without one task that sees all rows.

Rows are cut into blocks of about equal numbers of rows by boundaries of the order column, which a sample sets as in a
range partitioner: it decides how even the blocks are, never a result. Only the blocks' totals, at most BLOCKS rows, pass through one task. Rows that make one block are numbered in one pass.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at per block, and blocks at most.
BLOCK, BLOCKS = 1_000_000, 10_000
#: Values looked at per boundary.
SAMPLED = 40


def whole_div(column: str, n: int) -> Column:
    """Integer division of a long column, exact over its whole range."""
    return F.expr(f"`{column}` div {n}")


def _in_blocks(df: DataFrame, by: str, block: int) -> DataFrame | None:
    """Add ``__block``, which rises with ``by``; null values are in the first block. None if one block is enough."""
    rows = df.count()
    blocks = min(BLOCKS, -(-rows // block))
    if blocks < 2:
        return None
    sample = df.select(F.col(by).cast("double").alias("v")).where(F.col("v").isNotNull()).sample(min(1.0, SAMPLED * blocks / rows), seed=7)
    values = sorted(r.v for r in sample.collect())  # about SAMPLED * BLOCKS numbers at most
    cuts = sorted({values[len(values) * k // blocks] for k in range(1, blocks)}) if values else []
    splits = [-float("inf"), *cuts, float("inf")]
    tagged = df.withColumn("__v", F.coalesce(F.col(by).cast("double"), F.lit(-float("inf"))))
    return Bucketizer(splits=splits, inputCol="__v", outputCol="__block").transform(tagged).drop("__v")


def with_ordinal(df: DataFrame, by: str, name: str = "ordinal", block: int = BLOCK) -> DataFrame:
    """Add ``name``, the row's number from 0 in ascending order of the long column ``by``.

    ``by`` must be unique and not null for a defined result; rows with a null ``by`` come
    first, in no order among themselves. No rows give no rows. A column called as ``name`` is replaced.
    """
    df = df.drop(name)
    ascending = F.col(by).asc_nulls_first()
    tagged = _in_blocks(df, by, block)
    if tagged is None:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(ascending)) - 1).cast("long"))
    sums = tagged.groupBy("__block").agg(F.count("*").alias("__n"))
    # totals only; the empty partition key sorts them in one task
    before = sums.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__block").orderBy(ascending))
    return (
        tagged.withColumn("__local", local)
        .join(F.broadcast(before), "__block")
        .withColumn(name, (F.col("__before") + F.col("__local") - 1).cast("long"))
        .drop("__block", "__before", "__local")
    )


def with_previous(df: DataFrame, by: str, value: str, name: str, default: Column, block: int = BLOCK) -> DataFrame:
    """Add ``name``: ``value`` of the row before in ascending order of ``by``; ``default`` for the first row."""
    df = df.drop(name)
    ascending = F.col(by).asc_nulls_first()
    tagged = _in_blocks(df, by, block)
    if tagged is None:
        before = F.lag(F.struct(F.col(value).alias("v"))).over(Window.orderBy(ascending))
        return df.withColumn("__use", before).withColumn(name, F.when(F.col("__use").isNull(), default).otherwise(F.col("__use.v"))).drop("__use")
    ends = tagged.groupBy("__block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(by)).alias("__last"))
    before = ends.select("__block", F.lag("__last").over(Window.orderBy("__block")).alias("__carry"))
    w = Window.partitionBy("__block").orderBy(ascending)
    prev = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    return (
        tagged.withColumn("__prev", prev)
        .join(F.broadcast(before), "__block")
        .withColumn("__use", F.coalesce(F.col("__prev"), F.col("__carry")))
        .withColumn(name, F.when(F.col("__use").isNull(), default).otherwise(F.col("__use.v")))
        .drop("__block", "__prev", "__carry", "__use")
    )
