"""Projection, numeric inference and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this many distinct values a column is one-hot encoded as one sparse vector column
# instead of one column per value.
MAX_ONE_HOT = 1_000

# A number as text: sign, digits with an optional point, optional exponent. Type suffixes
# (1d, 2f) and NaN are text.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def q(c: str):
    return F.col(f"`{c}`")


def select_features(df: DataFrame, time_col: str, cols: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Time plus chosen columns, optionally renamed (names may contain spaces)."""
    if isinstance(cols, Mapping):
        return df.select(q(time_col), *[q(a).alias(b) for a, b in cols.items()])
    return df.select(q(time_col), *[q(c) for c in cols])


def infer_numeric_report(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """P8, one aggregation pass: per text column whether every value is a number (``NUMBER``;
    a NaN is not), whether all are digit strings that fit a bigint, whether any is NULL,
    and the inferred type."""
    cols = [c for c in df.columns if c not in skip]
    aggs = []
    for c in cols:
        x = q(c).cast("string")
        number = x.rlike(NUMBER) & x.try_cast("double").isNotNull()
        digits = x.rlike("^[0-9]+$") & x.try_cast("bigint").isNotNull()
        aggs += [F.bool_and(F.coalesce(number, x.isNull())).alias(f"{c}__n"),
                 F.bool_and(digits).alias(f"{c}__d"),
                 F.bool_or(x.isNull()).alias(f"{c}__z")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("all_numeric"),
                     F.col(f"{c}__d").alias("all_digits"), F.col(f"{c}__z").alias("any_null")) for c in cols]
    long = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    inferred = (F.when(F.col("any_null") | ~F.col("all_numeric"), "string")
                .when(F.col("all_digits"), "bigint").otherwise("double"))
    return long.withColumn("inferred", inferred)


def infer_numeric(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Cast each column to the type ``infer_numeric_report`` found (one small collect:
    one row per column)."""
    kinds = {r["column_name"]: r["inferred"] for r in infer_numeric_report(df, skip).collect()}
    return df.select(*[(q(c).cast(kinds[c]) if kinds.get(c, "string") != "string" else q(c)).alias(c)
                       for c in df.columns])


def _one_hot_vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    for c in cols:
        steps = [StringIndexer(inputCol="_text", outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
                 OneHotEncoder(inputCol="_index", outputCol=f"{c}-vector", dropLast=False, handleInvalid="error")]
        text = df.withColumn("_text", q(c).cast("string"))
        df = Pipeline(stages=steps).fit(text).transform(text).drop("_text", "_index")
    return df


def one_hot(df: DataFrame, cols: Sequence[str], values: Mapping[str, Sequence] | None = None,
            drop_source: bool = True) -> DataFrame:
    """``<col>-<value>`` 0/1 columns per distinct value (sorted), source dropped.

    Distinct values come from one aggregation job unless given; the count is checked
    before anything reaches the driver. A column with more than ``MAX_ONE_HOT`` values
    becomes one sparse 0/1 vector ``<col>-vector`` (Spark ML's indexer in alphabetical
    order and one-hot encoder, all categories kept, NULL in a category of its own).
    """
    values = dict(values or {})
    missing = [c for c in cols if c not in values]
    if missing:
        counts = df.agg(*[F.countDistinct(q(c)).alias(c) for c in missing]).first()
        wide = [c for c in missing if counts[c] > MAX_ONE_HOT]
        narrow = [c for c in missing if c not in wide]
        found = df.agg(*[F.sort_array(F.collect_set(q(c))).alias(c) for c in narrow]).first() if narrow else {}
        for c in narrow:
            values[c] = list(found[c])
        df = _one_hot_vectors(df, wide)
    out = [q(c) for c in df.columns if not (drop_source and c in cols)]
    for c in [c for c in cols if c in values]:
        out += [F.when(q(c) == F.lit(v), 1).otherwise(0).alias(f"{c}-{v}") for v in values[c]]
    return df.select(*out)
