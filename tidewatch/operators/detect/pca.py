"""PCA-based change detection (D5), after Qahtan et al. (2015).

Per key: tumbling blocks of ``window`` records; block 0 is the reference. Principal
components of the reference block (enough to explain ``var_kept`` of its variance)
come from its covariance, which is one aggregate (``covar_pop``, merge-safe at any offset);
only that d x d matrix per key reaches Python (``applyInPandas`` over one row per key)
for the eigen-decomposition. Every row is projected on its key's components by column
arithmetic; per (block, component) an equal-width histogram over the reference range
gives the density; the block's divergence is the largest KL (+0.5 smoothing) over the
components; Page-Hinkley over the per-block divergence gives 'warning' / 'drift'.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detect.chain import walk_blocks
from tidewatch.operators.detect.univariate import page_hinkley_of_values
from tidewatch.operators.history import full_blocks
from tidewatch.operators.position import BROADCAST_ROWS


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _principal_axes(c: np.ndarray, var_kept: float) -> list[list[np.ndarray]]:
    """The axes that explain ``var_kept`` of the variance, of each covariance matrix of ``c``."""
    d = c.shape[-1]
    vals, vecs = np.linalg.eigh(c)
    vals, vecs = np.clip(vals[:, ::-1], 0, None), vecs[:, :, ::-1]
    out = []
    for at in range(len(c)):
        total = vals[at].sum()
        k = d if total <= 0 else int(np.searchsorted(np.cumsum(vals[at]) / total, var_kept - 1e-12) + 1)
        axes = [vecs[at, :, comp] for comp in range(min(k, d))]
        out.append([v if v[np.argmax(np.abs(v))] >= 0 else -v for v in axes])  # deterministic sign
    return out


def reference_components(ref: DataFrame, keys: Sequence[str], xs: Sequence[str], var_kept: float = 0.99) -> DataFrame:
    """(keys, comp, mean_<i>, w_<i>) principal axes of each key's reference rows."""
    keys = list(keys)
    d = len(xs)
    x = [F.col(f"`{c}`").cast("double") for c in xs]
    sums = [F.avg(x[i]).alias(f"_m{i}") for i in range(d)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"_c{i}_{j}") for i in range(d) for j in range(i, d)]
    mom = ref.groupBy(*keys).agg(*sums)
    key_types = dict(mom.dtypes)
    schema = ", ".join([f"`{k}` {key_types[k]}" for k in keys] + ["comp int"] +
                       [f"mean_{i} double" for i in range(d)] + [f"w_{i} double" for i in range(d)])

    def eig(batches):
        cols = [*keys, "comp"] + [f"mean_{i}" for i in range(d)] + [f"w_{i}" for i in range(d)]
        for pdf in batches:  # one row per key: all matrices of a batch are decomposed together
            c = np.zeros((len(pdf), d, d))
            for i in range(d):
                for j in range(i, d):
                    c[:, i, j] = c[:, j, i] = pdf[f"_c{i}_{j}"]
            out = []
            means = pdf[[f"_m{i}" for i in range(d)]].to_numpy()
            for at, axes in enumerate(_principal_axes(c, var_kept)):
                key = [pdf[k].iloc[at] for k in keys]
                out += [[*key, comp, *means[at].tolist(), *v.tolist()] for comp, v in enumerate(axes)]
            yield pd.DataFrame(out, columns=cols)

    return mom.mapInPandas(eig, schema)


def _pca_round(blk: DataFrame, refs: DataFrame, keys: list[str], xs: Sequence[str], window: int, delta: float,
               lam: float, warn: float, bins: int, var_kept: float) -> DataFrame:
    """Divergence + Page-Hinkley for every block after each key's reference ``_ref``."""
    rel = blk.join(_maybe_broadcast(refs), keys).filter(F.col("block") >= F.col("_ref"))
    rows = rel.select(*keys, "block", "_ref", *xs)
    is_ref = F.col("block") == F.col("_ref")
    comps = reference_components(rows.filter(is_ref), keys, xs, var_kept).checkpoint(eager=True)
    proj = rows.join(_maybe_broadcast(comps), keys).withColumn(
        "_z", sum((F.col(f"`{c}`").cast("double") - F.col(f"mean_{i}")) * F.col(f"w_{i}")
                  for i, c in enumerate(xs))).select(*keys, "block", "_ref", "comp", "_z")
    rng = (proj.filter(is_ref).groupBy(*keys, "comp")
           .agg(F.min("_z").alias("_zmin"), F.max("_z").alias("_zmax")).checkpoint(eager=True))
    span = F.col("_zmax") - F.col("_zmin")
    b = F.when(span <= 0, F.lit(0)).otherwise(
        F.least(F.greatest(F.floor((F.col("_z") - F.col("_zmin")) / span * bins), F.lit(0)), F.lit(bins - 1)))
    hist = (proj.join(_maybe_broadcast(rng), [*keys, "comp"]).withColumn("_bin", b.cast("int"))
            .groupBy(*keys, "block", "_ref", "comp", "_bin").agg(F.count(F.lit(1)).alias("_c")))
    # KL(ref || test) with +0.5 smoothing; both blocks hold ``window`` rows, so with
    # z = window + bins/2: KL = sum_b pr log pr - sum_{b: c>0} pr (log(c+.5) - log .5) - log(.5/z).
    # Only non-empty test bins are touched: no blocks x bins grid.
    z = window + bins / 2.0
    ref = hist.filter(is_ref).select(*keys, "comp", "_bin", F.col("_c").alias("_cr"))
    allbins = rng.select(*keys, "comp").withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    prob = (allbins.join(ref, [*keys, "comp", "_bin"], "left").fillna(0, ["_cr"])
            .withColumn("_pr", (F.col("_cr") + 0.5) / z).checkpoint(eager=True))
    ent = prob.groupBy(*keys, "comp").agg(F.sum(F.col("_pr") * F.log("_pr")).alias("_h"))
    part = (hist.filter(~is_ref).join(prob.select(*keys, "comp", "_bin", "_pr"), [*keys, "comp", "_bin"])
            .groupBy(*keys, "block", "_ref", "comp")
            .agg(F.sum(F.col("_pr") * (F.log(F.col("_c") + 0.5) - F.lit(float(np.log(0.5))))).alias("_s")))
    kl = part.join(ent, [*keys, "comp"]).withColumn(
        "_kl", F.col("_h") - F.col("_s") - F.lit(float(np.log(0.5 / z))))
    # written once: Page-Hinkley counts the table before it scans it
    div = kl.groupBy(*keys, "block", "_ref").agg(F.max("_kl").alias("divergence")).checkpoint(eager=True)
    ph = page_hinkley_of_values(div, keys, ["block"], "divergence", delta=delta, lam=lam, warn=warn)
    return ph.select(*keys, "block", F.col("_ref").alias("ref_block"), "divergence", "ph_stat", "state")


class ReferenceDensity:
    """Components and histograms of one reference block (rows x axes), for blocks that are at
    hand in a task: the divergence of ``_pca_round``."""

    def __init__(self, x: np.ndarray, known: np.ndarray, bins: int, var_kept: float):
        d = x.shape[1]
        self.bins, self.z = bins, len(x) + bins / 2.0
        # NULLs take no part in a mean or covariance, as in the column form
        self.means = [x[known[:, i], i].mean() if known[:, i].any() else np.nan for i in range(d)]
        c = np.zeros((1, d, d))
        for i in range(d):
            for j in range(i, d):
                both = known[:, i] & known[:, j]
                a, b = x[both, i], x[both, j]
                c[0, i, j] = c[0, j, i] = ((a - a.mean()) * (b - b.mean())).mean() if len(a) else np.nan
        self.axes = _principal_axes(c, var_kept)[0]
        self.ranges, self.prob = [], []
        for axis in self.axes:
            z, seen = self._project(x, axis), known.all(axis=1)
            self.ranges.append((z[seen].min(), z[seen].max()) if seen.any() else (np.nan, np.nan))
            self.prob.append((np.bincount(self._bin(z, len(self.ranges) - 1), minlength=bins) + 0.5) / self.z)

    def _project(self, x: np.ndarray, axis: np.ndarray) -> np.ndarray:
        return sum((x[..., i] - m) * axis[i] for i, m in enumerate(self.means))

    def _bin(self, z: np.ndarray, comp: int) -> np.ndarray:
        lo, hi = self.ranges[comp]
        if hi - lo <= 0:
            return np.zeros(z.shape, dtype=np.int64)
        raw = np.floor((z - lo) / (hi - lo) * self.bins)
        return np.where(np.isnan(raw), 0, np.clip(raw, 0, self.bins - 1)).astype(np.int64)  # NULL, NaN: the first bin

    def divergence(self, blocks: np.ndarray) -> np.ndarray:
        n, kl = len(blocks), []
        for comp, (axis, pr) in enumerate(zip(self.axes, self.prob)):
            cell = self._bin(self._project(blocks, axis), comp) + self.bins * np.arange(n)[:, None]
            pt = (np.bincount(cell.ravel(), minlength=n * self.bins).reshape(n, -1) + 0.5) / self.z
            kl.append((pr * np.log(pr / pt)).sum(axis=1))
        return np.max(kl, axis=0)


def pca_cd(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], window: int = 50,
           delta: float = 0.1, lam: float = 1.0, warn: float = 0.5, bins: int = 10,
           var_kept: float = 0.99, reset: bool = False) -> DataFrame:
    """Per (key, block) after the reference: divergence (max KL over components),
    Page-Hinkley statistic and state. Only full blocks are scored.

    ``reset=True``: after a 'drift' state the drifting block becomes the reference and
    Page-Hinkley restarts; sequential within a key, so each key's blocks are walked once,
    in chunks of bounded size (``chain.walk_blocks``).
    """
    keys = list(keys)
    blk = full_blocks(df.select(*keys, *order, *[c for c in xs if c not in order]), keys, order, window, values=xs)
    if not reset:
        refs = blk.select(*keys).distinct().withColumn("_ref", F.lit(0).cast("long"))
        return _pca_round(blk, refs, keys, xs, window, delta, lam, warn, bins, var_kept)

    def fit(x, known, held):
        density, held = ReferenceDensity(x, known, bins, var_kept), dict(held or {"sum": 0.0, "n": 0.0, "m": 0.0, "low": np.inf})

        def score(blocks, _):  # Page-Hinkley goes on from the blocks before
            kl = density.divergence(blocks)
            sums, n = held["sum"] + np.cumsum(kl), held["n"] + np.arange(1.0, len(kl) + 1)
            m = held["m"] + np.cumsum(kl - sums / n - delta)
            low = np.minimum(np.minimum.accumulate(m), held["low"])
            held.update(sum=sums[-1], n=n[-1], m=m[-1], low=low[-1])
            return {"divergence": kl, "ph_stat": m - low, "sum": sums, "n": n, "m": m, "low": low, "_drift": m - low > lam}
        return score

    found = walk_blocks(blk, keys, xs, window, fit, "divergence double, ph_stat double, sum double, n double, m double, low double",
                        ["sum", "n", "m", "low"])
    blk.unpersist()
    state = F.when(F.col("_drift"), "drift").when(F.col("ph_stat") > warn * lam, "warning").otherwise("none")
    return found.select(*keys, "block", "ref_block", "divergence", "ph_stat", state.alias("state"))
