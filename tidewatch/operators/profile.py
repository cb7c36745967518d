"""Table profiling (A2-A7): describe, value counts, null counts, distinct values, class
share, schema summary. Every statistic is a distributed aggregate; only one row per
column (or per class) comes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.history import running
from tidewatch.operators.position import BROADCAST_ROWS

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def q(c: str):
    return F.col(f"`{c}`")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 (numeric): per column count, mean, std (sample), min, 25/50/75 % (exact, linear
    interpolation) and max, as one row per column.

    All columns go through one pass: the table is unpivoted to (column_name, value),
    the moments are one grouped aggregate, and the quartiles one keyed exact-quantile
    computation (numbering per column, hot-key safe), joined on column_name.
    """
    items = [F.struct(F.lit(c).alias("column_name"), q(c).cast("double").alias("_v")) for c in cols]
    long = df.select(F.explode(F.array(*items)).alias("_r")).select("_r.*").filter(F.col("_v").isNotNull())
    v = F.col("_v")
    moments = long.groupBy("column_name").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quart = keyed_quantiles(long, ["column_name"], "_v", [0.25, 0.5, 0.75], "p")
    return moments.join(quart, "column_name").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 (text): per column count, unique, top (most frequent; ties -> smallest value), freq."""
    out = None
    for c in cols:
        vc = df.filter(q(c).isNotNull()).groupBy(q(c).alias("v")).count()
        best = F.min(F.struct((-F.col("count")).alias("nc"), F.col("v").alias("v")))
        row = vc.agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("_b")).select(
            F.lit(c).alias("column_name"), F.coalesce("count", F.lit(0)).alias("count"), "unique",
            F.col("_b.v").cast("string").alias("top"), (-F.col("_b.nc")).alias("freq"))
        out = row if out is None else out.unionByName(row)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3: rows per value (NULL counted as its own value)."""
    return df.groupBy(q(col).alias(col)).agg(F.count(F.lit(1)).alias("count"))


def null_counts(df: DataFrame) -> DataFrame:
    """A4: NULL count per column, long form (column_name, nulls); one pass."""
    one = df.agg(*[F.sum(q(c).isNull().cast("long")).alias(c) for c in df.columns])
    items = [F.struct(F.lit(c).alias("column_name"), F.coalesce(q(c), F.lit(0)).alias("nulls")) for c in df.columns]
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def unique(df: DataFrame, col: str) -> DataFrame:
    """A5: distinct values of a column."""
    return df.select(q(col)).distinct()


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and their share in percent. The window runs over the grouped
    counts (one row per class), not over the table."""
    g = df.groupBy(q(label).alias(label)).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy())
    return g.withColumn("percent", F.col("count") * 100.0 / tot)


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-NULL count, Spark type and kind (numeric/text)."""
    types = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(q(c)).alias(c) for c in df.columns])
    items = [F.struct(F.lit(c).alias("column_name"), q(c).alias("non_null"), F.lit(types[c]).alias("dtype"),
                      F.lit("numeric" if types[c] in NUMERIC else "text").alias("kind")) for c in df.columns]
    return one.select("__rows", F.explode(F.array(*items)).alias("r")).select(
        F.col("__rows").alias("rows"), "r.*")


def keyed_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    prefix: str = "q") -> DataFrame:
    """Exact linearly interpolated quantiles of ``col`` per key (one row per key, one
    column ``<prefix><100p>`` per probability). Rows are first counted per (key, value)
    with map-side partials, so a value that most rows share is one row; the running count
    over the distinct values (hot-key safe) then gives the value at each rank."""
    keys = list(keys)
    counted = (df.select(*keys, q(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
               .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = running(counted, keys, ["_v"], {"_upto": ("sum", F.col("_c"))})
    if keys:
        # one row per key: broadcast only after counting it
        ranked = upto.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, keys)
    else:
        ranked = upto.withColumn("_n", F.lit(sizes.first()[0]))
    aggs = []
    for p in probs:
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi, frac = F.floor(h) + 1, F.ceil(h) + 1, h - F.floor(h)
        vlo = F.min(F.when(F.col("_upto") >= lo, F.col("_v")))
        vhi = F.min(F.when(F.col("_upto") >= hi, F.col("_v")))
        aggs.append((vlo + F.max(frac) * (vhi - vlo)).alias(f"{prefix}{int(round(p * 100))}"))
    return ranked.groupBy(*keys).agg(*aggs)


def keyed_quantile(df: DataFrame, keys: Sequence[str], col: str, p: float, out: str = "threshold") -> DataFrame:
    """Exact linearly interpolated ``p``-quantile of ``col`` per key: one row per key."""
    res = keyed_quantiles(df, keys, col, [p], "_q")
    return res.withColumnRenamed(f"_q{int(round(p * 100))}", out)
