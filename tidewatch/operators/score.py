"""Alarm attribution and detector scoreboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.operators.labels import interval_match


def attribute(alarms: DataFrame, time_col: str, intervals: DataFrame, row_key=None) -> DataFrame:
    """Interval of each alarm (NULL if none) and its delay in seconds from the start."""
    return interval_match(alarms, time_col, intervals, "interval_id", "delay", row_key)


def scoreboard(alarms: DataFrame, time_col: str, label_col: str, intervals: DataFrame, algorithm: str,
               hit: str = fixed.HIT_LABEL, row_key=None) -> DataFrame:
    """One result row for a detector from its alarm rows.

    detections = alarms on ``hit`` rows; false-alarms = alarms on other rows; per
    interval i: attack{i}-detected (0/1) and attack{i}-delay = first non-zero delay
    (0 doubles as "unset", so delay 0 is never recorded), else 0. One global
    aggregate with map-side partials; interval ids come from the (small) interval table.
    """
    lit = getattr(intervals, "_tw_literal", None)
    ids = (sorted(r[0] for r in lit) if lit is not None else
           [r[0] for r in intervals.select("interval_id").orderBy("interval_id").collect()])
    m = attribute(alarms, time_col, intervals, row_key)
    is_hit = F.col(label_col) == F.lit(hit)
    aggs = [F.count(F.when(is_hit, 1)).alias("detections"),
            F.count(F.when(~is_hit | F.col(label_col).isNull(), 1)).alias("false-alarms")]
    for i in ids:
        here = is_hit & (F.col("interval_id") == i)
        aggs += [F.coalesce(F.max(F.when(here, 1)), F.lit(0)).alias(f"attack{i}-detected"),
                 F.coalesce(F.min(F.when(here & (F.col("delay") > 0), F.col("delay"))),
                            F.lit(0.0)).alias(f"attack{i}-delay")]
    return m.agg(*aggs).select(F.lit(algorithm).alias("algorithm"), "*")


def summarise_scores(df: DataFrame) -> DataFrame:
    """Attacks-detected = sum of the detected flags; average-delay = delay sum /
    attacks-detected (NULL when nothing was detected)."""
    n = sorted(int(c[len("attack"):-len("-detected")]) for c in df.columns if c.endswith("-detected"))
    det = sum((F.col(f"`attack{i}-detected`") for i in n), F.lit(0))
    dly = sum((F.col(f"`attack{i}-delay`") for i in n), F.lit(0.0))
    return (df.withColumn("attacks-detected", det)
            .withColumn("average-delay", F.try_divide(dly, F.col("`attacks-detected`").cast("double"))))


def rank_scores(df: DataFrame, by: str = "attacks-detected", ascending: bool = True) -> DataFrame:
    """O1: order a scoreboard (NULLs last)."""
    c = F.col(f"`{by}`")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "algorithm")
