"""Approximate profiles that merge (A2, A5): quantile and distinct sketches kept per period.

A table of sketches has one row per period and column; periods are merged into any longer one
without reading the rows again. Quantiles come from KLL sketches (rank error about 2 / k of the
rows, whatever their number), distinct counts from HyperLogLog sketches (standard error about
1.04 / sqrt(2 ** lg_k)). NULLs are counted, not sketched; a column without values has NULL
quantiles and 0 distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 1_024
LG_K = 14


def sketch_table(df: DataFrame, period: Sequence[str], cols: Sequence[str], k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(period, column, rows, nulls, low, high, quantiles, distinct) of numeric ``cols``: partial
    sketches per task, merged in one shuffle."""
    long = df.select(*period, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols])).alias("__c"))
    long = long.select(*period, "__c.column", "__c.value")
    return long.groupBy(*period, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", k).alias("quantiles"),
        F.hll_sketch_agg(F.col("value").cast("string"), lg_k).alias("distinct"))


def merge_sketches(table: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """A sketch table over the coarser ``period`` (none: one row a column)."""
    return table.groupBy(*period, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def approximate_profile(table: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """describe() from sketches: count, nulls, min, max, ``q<percent>`` and approx_distinct."""
    has = F.col("rows") > F.col("nulls")
    out = [F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"q{round(100 * p)}")
           for p in probs]
    kept = [c for c in table.columns if c not in ("rows", "nulls", "low", "high", "quantiles", "distinct")]
    return table.select(*kept, (F.col("rows") - F.col("nulls")).alias("count"), "nulls", F.col("low").alias("min"),
                        F.col("high").alias("max"), *out, F.hll_sketch_estimate("distinct").alias("approx_distinct"))
