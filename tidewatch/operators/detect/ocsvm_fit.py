"""Linear one-class SVM fitted per key, with a convergence test (D6 scorer).

minimise 1/2 |w|^2 - rho + 1/(nu n) sum_i max(0, rho - w.x_i). For a given w the best rho
is the nu-quantile of w.x, and the gradient is w - v, v being the mean of the nu share of
rows with the smallest w.x: the problem is the point of smallest norm in the hull of all
such means. Frank-Wolfe steps with exact line search move w towards v until the duality
gap w.(w - v) is at most ``tol`` |w|^2.

Features are divided by their standard deviation, never centred: the model separates the
data from the origin, so centred data have no solution but w = 0. Score = rho - w.x (large
= unusual); about a ``nu`` share of the training rows scores above 0.

Keys of up to ``GROUP_ROWS`` rows are fitted each in one task; larger ones by the same
steps as grouped aggregates over all tasks, with the parameter table checkpointed: the same
start, share of rows, line search, tolerance and step limit. There the quantile is found by
counting rows in bins, then in bins of the quantile's bin, until that holds equal rows. A fit that is not within the
tolerance after the last step is an error, unless the caller takes the gap it left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.position import BROADCAST_ROWS

GROUP_ROWS = 500_000
STEPS = 2_000           # no fit needed as many so far
TOLERANCE = 1e-3
BINS = 4_096            # of a spread key's w.x, counted to find its quantile


def worst_mean(x: np.ndarray, w: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(mean of the ``share`` rows with the smallest w.x, the last of them in part; their
    largest w.x)."""
    dots = x @ w
    whole = min(int(share), len(x) - 1)
    order = np.argpartition(dots, whole)
    part = share - whole
    total = x[order[:whole]].sum(axis=0) + part * x[order[whole]]
    return total / share, float(dots[order[whole]])


def fit_rows(x: np.ndarray, nu: float, steps: int = STEPS, tol: float = TOLERANCE):
    """(w, rho, relative duality gap) of the rows of ``x``."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    z = x / scale
    share = min(max(nu * len(z), 1.0), float(len(z)))
    w, gap = z.mean(axis=0), 1.0
    for _ in range(steps):
        v, rho = worst_mean(z, w, share)
        norm = float(w @ w)
        gap = float(w @ (w - v)) / norm if norm > 0 else 0.0
        if gap <= tol:
            break
        step = w - v
        w = w - min(1.0, float(w @ step) / float(step @ step)) * step
    _, rho = worst_mean(z, w, share)
    return w / scale, rho, gap


def _fit_groups(train: DataFrame, keys: list[str], xs: Sequence[str], nu: float, steps: int, tol: float) -> DataFrame:
    types = dict(train.dtypes)
    names = [f"w_{i}" for i in range(len(xs))]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} double" for n in [*names, "rho", "gap"]])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        w, rho, gap = fit_rows(pdf[list(xs)].to_numpy(dtype=float), nu, steps, tol)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *w.tolist(), rho, gap]], columns=[*keys, *names, "rho", "gap"])

    return train.groupBy(*keys).applyInPandas(fn, schema)


def _fit_spread(train: DataFrame, keys: list[str], xs: Sequence[str], nu: float, steps: int, tol: float) -> DataFrame:
    """The same steps for keys too large for one task, as grouped aggregates."""
    d = len(xs)
    col = [F.col(f"`{c}`") for c in xs]
    train = train.persist(StorageLevel.DISK_ONLY)
    params = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(f"s_{i}") for i, c in enumerate(col)],
        *[f(c).alias(f"{n}_{i}") for i, c in enumerate(col) for n, f in (("w", F.avg), ("lo", F.min), ("hi", F.max))])
    fixed = [*keys, "_n", *[f"{n}_{i}" for i in range(d) for n in ("s", "lo", "hi")]]
    params = params.select(*fixed, *[(F.col(f"w_{i}") / F.col(f"s_{i}")).alias(f"w_{i}") for i in range(d)],
                           F.lit(1.0).alias("gap")).checkpoint(eager=True)
    z = [col[i] / F.col(f"s_{i}") for i in range(d)]

    def lowest(p):
        """``p`` with rho and, of the rows below rho and of those at rho, the number (_below, _at)
        and sums (b_<i>, a_<i>)."""
        ends = [(F.col(f"w_{i}") * F.col(f"lo_{i}") / F.col(f"s_{i}"), F.col(f"w_{i}") * F.col(f"hi_{i}") / F.col(f"s_{i}"))
                for i in range(d)]
        held = [*fixed, *[f"w_{i}" for i in range(d)]]
        at = p.select(*held, sum(F.least(*e) for e in ends).alias("_lo"), sum(F.greatest(*e) for e in ends).alias("_hi"),
                      F.lit(0).cast("long").alias("_below"), *[F.lit(0.0).alias(f"b_{i}") for i in range(d)])
        target = F.greatest(F.ceil(F.col("_n") * nu), F.lit(1))
        inside, going = F.lit(True), True  # at first rows may stand beside the bounds by a rounding
        upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        while going:
            rows = (train.join(F.broadcast(at), keys) if keys else train.join(F.broadcast(at)))  # one row per large key
            rows = rows.withColumn("_dot", sum(z[i] * F.col(f"w_{i}") for i in range(d))).where(inside)
            span = F.col("_hi") / 2 - F.col("_lo") / 2
            place = F.floor(F.when(span > 0, (F.col("_dot") / 2 - F.col("_lo") / 2) / span * BINS).otherwise(0.0))
            bins = rows.groupBy(*keys, F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).alias("_bin")).agg(
                F.count(F.lit(1)).alias("_at"), F.min("_dot").alias("_min"), F.max("_dot").alias("_max"),
                *[F.sum(z[i]).alias(f"a_{i}") for i in range(d)])
            bins = bins.select("*", F.sum("_at").over(upto).alias("_upto"), *[
                F.coalesce(F.sum(f"a_{i}").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"u_{i}")
                for i in range(d)])
            bins = (bins.join(F.broadcast(at), keys) if keys else bins.join(F.broadcast(at))).withColumn(
                "_before", F.col("_below") + F.col("_upto") - F.col("_at"))
            at = (bins.where((F.col("_before") < target) & (F.col("_before") + F.col("_at") >= target))
                  .select(*held, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_before").alias("_below"), "_at",
                          *[(F.col(f"b_{i}") + F.col(f"u_{i}")).alias(f"b_{i}") for i in range(d)], *[f"a_{i}" for i in range(d)])
                  .checkpoint(eager=True))
            inside = F.col("_dot").between(F.col("_lo"), F.col("_hi"))
            found, at = at, at.drop("_at", *[f"a_{i}" for i in range(d)])
            going = at.where(F.col("_lo") < F.col("_hi")).limit(1).count() > 0
        return found.withColumnRenamed("_lo", "rho").drop("_hi")

    for _ in range(steps):
        # the nu share of rows with the smallest w.x: those below rho whole, those at rho in part
        share = F.least(F.greatest(F.col("_n") * nu, F.lit(1.0)), F.col("_n").cast("double"))
        part = F.coalesce(F.least(F.greatest(F.try_divide(share - F.col("_below"), F.col("_at")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        taken = F.col("_below") + part * F.col("_at")
        both = lowest(params).select("*", *[((F.col(f"b_{i}") + part * F.col(f"a_{i}")) / taken).alias(f"v_{i}") for i in range(d)])
        norm = sum(F.col(f"w_{i}") * F.col(f"w_{i}") for i in range(d))
        down = sum(F.col(f"w_{i}") * (F.col(f"w_{i}") - F.col(f"v_{i}")) for i in range(d))
        size = sum((F.col(f"w_{i}") - F.col(f"v_{i}")) * (F.col(f"w_{i}") - F.col(f"v_{i}")) for i in range(d))
        both = both.withColumn("gap", F.when(norm > 0, down / norm).otherwise(F.lit(0.0))).withColumn(
            "_g", F.when(F.col("gap") <= tol, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(down, size))))
        params = both.select(*fixed, *[(F.col(f"w_{i}") - F.coalesce("_g", F.lit(0.0)) * (F.col(f"w_{i}") - F.col(f"v_{i}")))
                                       .alias(f"w_{i}") for i in range(d)], "gap").checkpoint(eager=True)
        if params.where(F.col("gap") > tol).limit(1).count() == 0:
            break
    rho = lowest(params).select(*keys, "rho")
    train.unpersist()
    out = params.join(rho, keys) if keys else params.join(F.broadcast(rho))
    return out.select(*keys, *[(F.col(f"w_{i}") / F.col(f"s_{i}")).alias(f"w_{i}") for i in range(d)], "rho", "gap")


def fit_one_class_svm(train: DataFrame, keys: Sequence[str], xs: Sequence[str], nu: float = 0.1,
                      steps: int = STEPS, tol: float = TOLERANCE, take_gap: bool = False) -> DataFrame:
    """(keys, w_<i>, rho, gap): one linear model per key in the units of ``xs``; ``gap`` is
    the relative duality gap that is left. A gap above ``tol`` after ``steps`` steps raises,
    unless ``take_gap``: then it is the caller's to judge. Rows with a NULL feature are not
    fitted."""
    fitted = _fit(train, keys, xs, nu, steps, tol).checkpoint(eager=True)  # one row per key
    worst = fitted.agg(F.max("gap")).first()[0]
    if not take_gap and worst is not None and worst > tol:
        raise RuntimeError(f"a one-class SVM has a relative duality gap of {worst:.3g} after {steps} steps (tolerance {tol:g})")
    return fitted


def _fit(train: DataFrame, keys: Sequence[str], xs: Sequence[str], nu: float, steps: int, tol: float) -> DataFrame:
    keys = list(keys)
    whole = train.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in xs]).dropna(subset=list(xs))
    if not keys:
        return _fit_spread(whole, keys, xs, nu, steps, tol)
    sizes = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select(*keys)
    if sizes.limit(1).count() == 0:
        return _fit_groups(whole, keys, xs, nu, steps, tol)
    large = sizes.checkpoint(eager=True)
    return _fit_groups(whole.join(large, keys, "left_anti"), keys, xs, nu, steps, tol).unionByName(
        _fit_spread(whole.join(large, keys, "left_semi"), keys, xs, nu, steps, tol))


def svm_scores(df: DataFrame, params: DataFrame, keys: Sequence[str], xs: Sequence[str],
               out: str = "score") -> DataFrame:
    keys = list(keys)
    params = params.checkpoint(eager=True)  # one row per key
    p = F.broadcast(params) if params.count() <= BROADCAST_ROWS else params
    j = df.join(p, keys) if keys else df.join(F.broadcast(params))
    dot = sum(F.col(f"`{c}`").cast("double") * F.col(f"w_{i}") for i, c in enumerate(xs))
    return j.withColumn(out, F.col("rho") - dot).drop(*[f"w_{i}" for i in range(len(xs))], "rho", "gap")
