"""Detectors comparing consecutive multivariate records.

The features of one record are treated as a 1-D sample, as in the method being
reproduced. Work per row is array higher-order functions on a bounded row frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.position import bounded_frames


def _log_sum_exp(array: str, t: str = "t") -> str:
    """log sum exp over ``array``, each element seen once: the fold keeps the largest
    element so far and the sum of the others relative to it."""
    return (f"aggregate({array}, named_struct('m', CAST('-Infinity' AS DOUBLE), 's', CAST(0.0 AS DOUBLE)), "
            f"(acc, {t}) -> IF({t} > acc.m, named_struct('m', {t}, 's', acc.s * exp(acc.m - {t}) + 1.0), "
            f"named_struct('m', acc.m, 's', acc.s + exp({t} - acc.m))), acc -> acc.m + ln(acc.s))")


def _lse(sample: str, x: str, h: float) -> str:
    """log sum_s exp(-(x-s)^2 / (2h^2)) over array ``sample`` (stable)."""
    return _log_sum_exp(f"transform({sample}, s -> -(({x}) - s) * (({x}) - s) / {2.0 * h * h!r})", "u")


def log_density_ratio_expr(prev: str, cur: str, h: float) -> str:
    """log of mean_i p_cur(x_i) / p_prev(x_i) over x_i in ``cur`` (Gaussian KDE, bandwidth h).

    Kernel normalisers cancel because both samples have the same size; the mean of
    ratios is taken in log space, so nothing overflows or divides by zero. O(d^2)."""
    d = f"transform({cur}, x -> {_lse(cur, 'x', h)} - {_lse(prev, 'x', h)})"
    return f"({_log_sum_exp(d)} - ln(size({cur})))"


def density_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str],
                  h: float = 0.2, n: int = 10, limit: float = 1.5) -> DataFrame:
    """Relative density ratio of each record against the previous one, and an alarm
    when the largest ratio among the last ``n`` records exceeds ``limit``.

    Output ``log_rdr`` (this record), ``log_rdr_max`` (last n) and ``alarm``; rows from
    the second record of each series on. Three window stages on one sort: previous
    record, its ratio, rolling max.
    """
    feats = F.array(*[F.col(f"`{c}`").cast("double") for c in xs])
    stages = [
        lambda fr: {"_cur": feats, "_prev": F.lag(feats, 1).over(fr())},
        lambda fr: {"log_rdr": F.when(F.col("_prev").isNotNull(),
                                      F.expr(log_density_ratio_expr("_prev", "_cur", h)))},
        lambda fr: {"log_rdr_max": F.max("log_rdr").over(fr(-(n - 1), 0))},
    ]
    res = bounded_frames(df, keys, order, n + 1, stages)
    return (res.filter(F.col("_prev").isNotNull())
            .withColumn("alarm", F.col("log_rdr_max") > F.lit(math.log(limit)))
            .drop("_cur", "_prev"))


def nn_distance(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str],
                kth: int = 2) -> DataFrame:
    """For each feature of the current record, the distance to the ``kth`` nearest
    feature of the previous record; ``avg_nn`` is their mean (from the second record on)."""
    feats = F.array(*[F.col(f"`{c}`").cast("double") for c in xs])
    res = bounded_frames(df, keys, order, 2, lambda fr: {"_h": F.collect_list(feats).over(fr(-1, 0))})
    res = res.filter(F.size("_h") == 2)
    per = F.expr(f"transform(_h[1], x -> try_element_at(array_sort(transform(_h[0], p -> abs(x - p))), {kth}))")
    avg = F.aggregate(per, F.lit(0.0), lambda a, v: a + v) / F.size(per)
    return res.withColumn("avg_nn", avg).drop("_h")


def block_histogram_kl(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, m: int = 50,
                       bins: int = 10, limit: float = 1e-5) -> DataFrame:
    """D8 drift points with a usable divergence: the score series (e.g. ``avg_nn``) of
    each key is cut into complete blocks of ``m`` records; each block's histogram
    (``bins`` equal-width bins over the key's score range) is compared with the previous
    block's by KL (+0.5 smoothing); drift when KL > ``limit``.

    Only bins non-empty in one of the two blocks contribute (empty in both gives 0), so
    the work follows the data: a full outer join of consecutive block histograms.
    """
    from tidewatch.operators.history import full_blocks
    keys = list(keys)
    blk = full_blocks(df.select(*keys, *order, *([score] if score not in order else [])), keys, order, m)
    rng = blk.groupBy(*keys).agg(F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    span = F.col("_mx") - F.col("_mn")
    b = F.when(span <= 0, F.lit(0)).otherwise(
        F.least(F.greatest(F.floor((F.col(score) - F.col("_mn")) / span * bins), F.lit(0)), F.lit(bins - 1)))
    hist = (blk.join(rng, keys).withColumn("_bin", b.cast("int"))
            .groupBy(*keys, "block", "_bin").agg(F.count(F.lit(1)).alias("_c")))
    prev = hist.select(*keys, (F.col("block") + 1).alias("block"), "_bin", F.col("_c").alias("_cp"))
    both = hist.join(prev, [*keys, "block", "_bin"], "full_outer").fillna(0, ["_c", "_cp"])
    z = m + bins / 2.0
    pp, pc = (F.col("_cp") + 0.5) / z, (F.col("_c") + 0.5) / z
    blocks = blk.select(*keys, "block").distinct()
    kl = (both.groupBy(*keys, "block").agg(F.sum(pp * F.log(pp / pc)).alias("kl_divergence"))
          .join(blocks.filter(F.col("block") > 0), [*keys, "block"]))
    return kl.withColumn("drift_detected", F.col("kl_divergence") > F.lit(limit))
