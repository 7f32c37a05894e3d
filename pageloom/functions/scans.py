"""Scans along an order within a key, in two levels, so that a key with most of the rows isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def carried(df: DataFrame, keys: list[str], order: str, block: Column, out: str, add: Column, reset: Column | None = None) -> DataFrame:
    """Adds `out`: what the rows before a row, by `order` within keys, add up to since the last one of them that resets, that one included.

    block must not decrease along the order. Rows are summed within their block, and what crosses blocks is one row for each of
    them. keys may be null, order may not.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns({"_block": block, "_add": add, "_reset": F.coalesce(reset, F.lit(False)).cast("long") if reset is not None else F.lit(0).cast("long")})
    w = W.partitionBy(*keys, "_block").orderBy(order)
    df = df.withColumn("_since", F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_so_far", F.sum("_add").over(W.partitionBy(*keys, "_block", "_since").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_before", F.struct(F.coalesce(F.lag("_so_far").over(w), F.lit(0)).alias("sum"), F.coalesce(F.lag("_since").over(w), F.lit(0)).alias("resets")))
    ends = df.groupBy(*keys, "_block").agg(F.max_by("_so_far", order).alias("end"), F.max("_reset").alias("resets"))
    v = W.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("since", F.sum("resets").over(v.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("so_far", F.sum("end").over(W.partitionBy(*keys, "since").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_block").alias("_b"), F.coalesce(F.lag("so_far").over(v), F.lit(0)).alias("_into"))
    same = F.col("_block") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    df = df.join(ends, same)
    total = F.col("_before")["sum"] + F.when(F.col("_before")["resets"] == 0, F.col("_into")).otherwise(0)
    return df.withColumn(out, total).drop("_block", "_add", "_reset", "_since", "_so_far", "_before", "_b", "_into", *names)


def following(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, out: str) -> DataFrame:
    """Adds `out`: the value of the next row, by `order` within keys; null for the last one. As carried(), in two levels."""
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumn("_block", block).withColumn("_next", F.lead(F.struct(value)).over(W.partitionBy(*keys, "_block").orderBy(*order)))
    firsts = df.groupBy(*keys, "_block").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    firsts = firsts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_block").alias("_b"), F.lead("_first").over(W.partitionBy(*keys).orderBy("_block")).alias("_then"))
    same = F.col("_block") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    df = df.join(firsts, same).withColumn(out, F.when(F.col("_next").isNull(), F.col("_then")).otherwise(F.col("_next")[value]))
    return df.drop("_block", "_next", "_b", "_then", *names)
