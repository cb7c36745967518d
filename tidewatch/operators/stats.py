"""Sliding event-time window statistics (A1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT_SECONDS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
                 "day": 86400, "days": 86400}


MOST_COPIES = 4  # copies of a row in overlapping windows, beyond which panes are cheaper


def duration_seconds(text: str) -> int:
    """'10 minutes' -> 600."""
    num, unit = text.split()
    return int(num) * _UNIT_SECONDS[unit.lower()]


def stat_columns(cols: Sequence[str], size: str = "10 minutes") -> list[Column]:
    """Per column: count, mean, min, max, sample stddev, rate (rows per hour of window),
    and avg_10min (same value as mean; both names are kept)."""
    per_hour = 3600.0 / duration_seconds(size)
    out: list[Column] = []
    for c in cols:
        x = F.col(f"`{c}`")
        out += [
            F.count(x).alias(f"{c}_count"),
            F.avg(x).alias(f"{c}_mean"),
            F.min(x).alias(f"{c}_min"),
            F.max(x).alias(f"{c}_max"),
            F.stddev_samp(x).alias(f"{c}_stddev"),
            (F.count(x) * F.lit(per_hour)).alias(f"{c}_rate"),
            F.avg(x).alias(f"{c}_avg_10min"),
        ]
    return out


def window_stats(df: DataFrame, time_col: str, cols: Sequence[str], by: Sequence[str] = (),
                 size: str = "10 minutes", slide: str = "5 minutes",
                 flatten: bool = True) -> DataFrame:
    """A1: ``groupBy(window(time, size, slide), *by).agg(stats)``.

    Catalyst expands each row into size/slide copies before the partial aggregate, so the
    shuffle carries one partial row per (window, group, task). Where that is more than
    ``MOST_COPIES`` copies and ``slide`` divides ``size``, a batch is first reduced to panes (one
    state per slide and group) and only the panes are copied into their windows: a second,
    small shuffle instead of multiplied rows, with the same result. Streams always expand (a
    second aggregate would need append mode). Rows with a NULL time fall in no window.
    """
    long, short = duration_seconds(size), duration_seconds(slide)
    if not df.isStreaming and long > MOST_COPIES * short and long % short == 0:
        g = _window_stats_by_panes(df, time_col, cols, by, size, slide)
    else:
        g = df.groupBy(F.window(F.col(time_col), size, slide).alias("window"), *by).agg(*stat_columns(cols, size))
    if flatten:
        g = g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                     *[c for c in g.columns if c != "window"])
    return g


def _merged(panes: Column) -> Column:
    """(n, mean, m2) of several such states: counts, means and centred second moments of parts."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2")))

    return F.aggregate(panes, empty, add)


def _window_stats_by_panes(df: DataFrame, time_col: str, cols: Sequence[str], by: Sequence[str], size: str,
                           slide: str) -> DataFrame:
    """The same rows from panes: a window merges at most size / slide states of a group."""
    long, short = duration_seconds(size), duration_seconds(slide)
    by, states = list(by), []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        n = F.count(x)
        states += [F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).cast("double").alias("mean"),
                            F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2")).alias(f"__s{i}"),
                   F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    panes = df.groupBy(F.window(F.col(time_col), slide).alias("__pane"), *by).agg(*states)
    opens = [F.col("__pane.start") - F.expr(f"INTERVAL {k * short} SECONDS") for k in range(long // short)]
    windows = panes.withColumn("__start", F.explode(F.array(*opens)))
    # the states of a window come in the order of its panes, so that sums do not depend on the shuffle
    merged = windows.groupBy("__start", *by).agg(
        *[F.transform(F.array_sort(F.collect_list(F.struct(F.col("__pane.start").alias("at"), F.col(f"__s{i}").alias("s")))),
                      lambda p: p["s"]).alias(f"__s{i}") for i in range(len(cols))],
        *[f(f"__{w}{i}").alias(f"__{w}{i}") for i in range(len(cols)) for f, w in ((F.min, "lo"), (F.max, "hi"))])
    merged = merged.withColumns({f"__s{i}": _merged(F.col(f"__s{i}")) for i in range(len(cols))})
    per_hour, out = 3600.0 / long, []
    for i, c in enumerate(cols):
        s = F.col(f"__s{i}")
        n, mean = s["n"], F.when(s["n"] > 0, s["mean"])
        out += [n.alias(f"{c}_count"), mean.alias(f"{c}_mean"), F.col(f"__lo{i}").alias(f"{c}_min"),
                F.col(f"__hi{i}").alias(f"{c}_max"), F.when(n > 1, F.sqrt(s["m2"] / (n - 1))).alias(f"{c}_stddev"),
                (n * F.lit(per_hour)).alias(f"{c}_rate"), mean.alias(f"{c}_avg_10min")]
    end = F.col("__start") + F.expr(f"INTERVAL {long} SECONDS")
    return merged.select(F.struct(F.col("__start").alias("start"), end.alias("end")).alias("window"), *by, *out)
