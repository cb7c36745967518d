"""Time-series table work: ranges, long points, pivots, upserts, saved tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir


def read_range(df: DataFrame, time_col: str, start: str, stop: str) -> DataFrame:
    """Rows with ``start <= time < stop``. Literal bounds let Parquet skip row groups."""
    t = F.col(time_col)
    dtype = dict(df.dtypes)[time_col]
    lo, hi = F.lit(start).cast(dtype), F.lit(stop).cast(dtype)
    return df.filter((t >= lo) & (t < hi))


def to_points(df: DataFrame, time_col: str, num_cols: Sequence[str], str_cols: Sequence[str] = (),
              tags: Sequence[str] = ()) -> DataFrame:
    """Unpivot to (_time, *tags, _field, _value DOUBLE, _value_str STRING) in one pass.

    Numbers go to ``_value``; the listed text fields go to ``_value_str``.
    """
    items = [F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("double").alias("v"),
                      F.lit(None).cast("string").alias("s")) for c in num_cols]
    items += [F.struct(F.lit(c).alias("f"), F.lit(None).cast("double").alias("v"),
                       F.col(f"`{c}`").cast("string").alias("s")) for c in str_cols]
    return (df.select(F.col(time_col).alias("_time"), *tags, F.explode(F.array(*items)).alias("_p"))
            .select("_time", *tags, F.col("_p.f").alias("_field"), F.col("_p.v").alias("_value"),
                    F.col("_p.s").alias("_value_str")))


def pivot_points(df: DataFrame, row_key: Sequence[str], field: str, value: str,
                 fields: Sequence[str]) -> DataFrame:
    """Long -> wide. The explicit field list avoids a distinct-values job; the pivot is
    one hash aggregation on the row key with map-side partial aggregation."""
    return df.groupBy(*row_key).pivot(field, list(fields)).agg(F.max(value))


def upsert_latest(df: DataFrame, keys: Sequence[str], version_col: str) -> DataFrame:
    """Keep, per key, the row with the largest ``version_col`` (last write wins).

    Written as ``max(struct(version, row))``: a partial (map-side) aggregate, so a hot
    key is reduced inside every task before the shuffle instead of landing whole in one.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(F.col(version_col).alias("_v"), *[F.col(f"`{c}`") for c in rest])
    return (df.groupBy(*keys).agg(F.max(packed).alias("_row"))
            .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]))


def shared_path(spark, name: str) -> str:
    """A folder under the cluster's shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def save_selected(df: DataFrame, time_col: str, cols: Sequence[str], label_col: str, name: str,
                  path: str | None = None) -> DataFrame:
    """Write (time, *cols, label) as Parquet and read it back. Without ``path`` each
    call writes to a folder of its own under the shared location."""
    import uuid
    path = path or shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.select(time_col, *cols, label_col).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def result_schema(ids: Sequence[int]) -> str:
    """Schema of a results table for the intervals with these ids."""
    return ("algorithm STRING, detections BIGINT, `false-alarms` BIGINT, "
            + ", ".join(f"`attack{i}-detected` INT, `attack{i}-delay` DOUBLE" for i in ids))


def save_results(df: DataFrame, path: str) -> None:
    """Append detector result rows to a CSV table (header written once per file)."""
    df.write.mode("append").option("header", True).csv(path)


def read_results(spark, path: str, ids: Sequence[int]) -> DataFrame:
    """The results table of a board over the intervals ``ids``; a file whose header has
    other columns is an error, not a misread."""
    return (spark.read.option("header", True).option("enforceSchema", False).schema(result_schema(ids)).csv(path))
