"""Time-interval labelling and point-in-interval matching (range join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import fixed

# Interval tables up to this many rows are matched by a broadcast nested-loop range join
# (rows x intervals comparisons, so kept small); larger ones by a bucketed equi-join.
BROADCAST_INTERVALS = 64
# Bucket width for the equi-join fallback on large interval tables.
BUCKET_SECONDS = 86_400


def interval_table(spark: SparkSession, rows: Sequence[tuple] = fixed.EVENT_INTERVALS) -> DataFrame:
    """(interval_id INT, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ) from literal rows."""
    rows = [(int(i), s, e) for i, s, e in rows]
    df = spark.createDataFrame(rows, "interval_id INT, start_s STRING, end_s STRING")
    out = df.select("interval_id",
                    F.to_timestamp_ntz("start_s").alias("start"),
                    F.to_timestamp_ntz("end_s").alias("end"))
    # literal rows are known on the driver: keep them so no job is needed to inspect them
    out._tw_literal = sorted(rows, key=lambda r: (r[1], r[0]))
    return out


def _literal(iv: DataFrame):
    return getattr(iv, "_tw_literal", None)


def _count(iv: DataFrame) -> int:
    lit = _literal(iv)
    return len(lit) if lit is not None else iv.count()


def truncate_time(df: DataFrame, col: str, unit: str = "second", out: str | None = None) -> DataFrame:
    """Truncate a timestamp column to ``unit``, keeping its type (a TIMESTAMP_NTZ
    stays time-zone free; ``date_trunc`` alone would return a session-zone TIMESTAMP)."""
    dtype = dict(df.dtypes)[col]
    return df.withColumn(out or col, F.date_trunc(unit, F.col(col)).cast(dtype))


def _bucketed(iv: DataFrame) -> DataFrame:
    bsec = F.lit(BUCKET_SECONDS)
    lo = F.floor(F.unix_timestamp(F.col("start").cast("timestamp")) / bsec)
    hi = F.floor(F.unix_timestamp(F.col("end").cast("timestamp")) / bsec)
    return iv.withColumn("_bkt", F.explode(F.sequence(lo, hi)))


def _disjoint(iv: DataFrame) -> bool:
    """True if no two intervals share a point. Overlapping intervals share a time
    bucket, so the check runs per bucket (distributed, no global sort)."""
    lit = _literal(iv)
    if lit is not None:
        return all(lit[i][1] > lit[i - 1][2] for i in range(1, len(lit)))
    w = (Window.partitionBy("_bkt").orderBy("start", "interval_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    prev_end = F.max("end").over(w)
    bad = (_bucketed(iv).select((F.col("start") <= prev_end).alias("o"))
           .filter("o").limit(1).count())
    return bad == 0


def _matches(df: DataFrame, time_col: str, iv: DataFrame, small: bool) -> DataFrame:
    """Left join rows to every interval that contains their time (closed ends)."""
    t = F.col(time_col)
    ivc = iv.select(F.col("interval_id").alias("_iid"), F.col("start").alias("_ivs"),
                    F.col("end").alias("_ive"))
    if small:
        return df.join(F.broadcast(ivc), t.between(F.col("_ivs"), F.col("_ive")), "left")
    # Large interval tables: equi-join on a time bucket, then the exact range test.
    ivb = (_bucketed(iv).select(F.col("interval_id").alias("_iid"), F.col("start").alias("_ivs"),
                                F.col("end").alias("_ive"), "_bkt"))
    rows = df.withColumn("_bkt", F.floor(F.unix_timestamp(t.cast("timestamp")) / F.lit(BUCKET_SECONDS)))
    return (rows.join(ivb, (rows["_bkt"] == ivb["_bkt"]) & t.between(ivb["_ivs"], ivb["_ive"]), "left")
            .drop(ivb["_bkt"]).drop("_bkt"))


def interval_match(df: DataFrame, time_col: str, intervals: DataFrame,
                   id_col: str = "interval_id", since_col: str | None = "seconds_since_start",
                   row_key: Sequence[str] | None = None) -> DataFrame:
    """The interval containing each row's time (smallest id if several), NULL if none,
    and whole seconds since that interval's start.

    Disjoint interval tables (checked) give at most one match per row, so no
    de-duplication is needed; overlapping tables need ``row_key`` (unique per row)
    and pay one aggregation on it.
    """
    n = _count(intervals)
    small = n <= BROADCAST_INTERVALS
    joined = _matches(df, time_col, intervals, small)
    if not _disjoint(intervals):
        if not row_key:
            raise ValueError("overlapping intervals need row_key to pick one match per row")
        first = F.min(F.struct("_iid", "_ivs")).alias("_m")
        cols = [c for c in df.columns if c not in row_key]
        joined = (joined.groupBy(*row_key)
                  .agg(first, *[F.first(c).alias(c) for c in cols])
                  .select(*df.columns, F.col("_m._iid").alias("_iid"), F.col("_m._ivs").alias("_ivs")))
    out = joined.withColumn(id_col, F.col("_iid"))
    if since_col:
        # difference of wall-clock values: independent of the session time zone
        out = out.withColumn(since_col, F.timestamp_diff("SECOND", F.col("_ivs"), F.col(time_col)).cast("double"))
    return out.drop("_iid", "_ivs", "_ive")


def label_intervals(df: DataFrame, time_col: str, intervals: DataFrame, label_col: str = "attack_label",
                    hit: str = fixed.HIT_LABEL, miss: str = fixed.MISS_LABEL,
                    ) -> DataFrame:
    """``hit`` if the time lies in any closed interval, else ``miss`` (NULL time -> miss)."""
    if _count(intervals) <= 16:
        # A handful of intervals: a CASE chain keeps the scan map-only and codegen'd.
        conds = None
        lit = _literal(intervals)
        bounds = ([(s, e) for _, s, e in lit] if lit is not None else
                  [(r["start"].isoformat(sep=" "), r["end"].isoformat(sep=" "))
                   for r in intervals.select("start", "end").collect()])
        for start, end in bounds:
            lo = F.lit(start).cast("timestamp_ntz")
            hi = F.lit(end).cast("timestamp_ntz")
            c = F.col(time_col).between(lo, hi)
            conds = c if conds is None else (conds | c)
        lab = F.when(conds, F.lit(hit)).otherwise(F.lit(miss)) if conds is not None else F.lit(miss)
        return df.withColumn(label_col, lab)
    # More intervals, overlapping or not: a label only asks whether a match exists, so a
    # semi join gives the hits and an anti join the rest (no choice among matches).
    t = F.col(time_col)
    if _count(intervals) <= BROADCAST_INTERVALS:
        rows, iv = df, F.broadcast(intervals.select(F.col("start").alias("_ivs"), F.col("end").alias("_ive")))
        cond = t.between(F.col("_ivs"), F.col("_ive"))
    else:
        iv = _bucketed(intervals).select(F.col("start").alias("_ivs"), F.col("end").alias("_ive"), "_bkt")
        rows = df.withColumn("_rbkt", F.floor(F.unix_timestamp(t.cast("timestamp")) / F.lit(BUCKET_SECONDS)))
        cond = (F.col("_rbkt") == F.col("_bkt")) & t.between(F.col("_ivs"), F.col("_ive"))
    hits = rows.join(iv, cond, "left_semi").withColumn(label_col, F.lit(hit))
    rest = rows.join(iv, cond, "left_anti").withColumn(label_col, F.lit(miss))
    return hits.unionByName(rest).drop("_rbkt")
