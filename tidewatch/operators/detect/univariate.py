"""Univariate change detectors over keyed, ordered series.

Each detector is one window pass (``bounded_frames``) plus array higher-order
functions evaluated inside whole-stage code generation; no Python runs per row.

NULL rule (batch and streams): histories and positions are made of the non-NULL values;
a row whose value is NULL is kept, with NULL results, and changes no other row's result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewatch import fixed
from tidewatch.functions.scalars import normal_cdf_expr
from tidewatch.functions.vectorized import ks_counts
from tidewatch.operators.history import nulls_apart, running
from tidewatch.operators.position import BLOCK_ROWS, _shuffle_partitions, bounded_frames, largest_group, with_position

KS_PIECE = 16_384  # rows of a series whose windows are compared in one grouped call


# --- D1 CUSUM ---------------------------------------------------------------------

def cusum(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int = 10,
          k: float = 1.0, h: float = 5.0, **frame_opts) -> DataFrame:
    """One-sided CUSUM recomputed over the last ``n`` values of each series.

    m = mean(history); S = fold(max(0, S + v - m - k)) from S=0; alarm when S > h.
    Only rows with a full history are returned.
    """
    def detect(rows: DataFrame) -> DataFrame:
        res = bounded_frames(rows, keys, order, n, lambda fr: {
            "_hist": F.collect_list(F.col(x)).over(fr(-(n - 1), 0)),
            "_m": F.avg(F.col(x)).over(fr(-(n - 1), 0))}, **frame_opts)
        res = res.filter(F.size("_hist") == n)
        s = F.expr(f"aggregate(_hist, CAST(0.0 AS DOUBLE), (acc, v) -> greatest(CAST(0.0 AS DOUBLE), acc + v - _m - {float(k)!r}))")
        return (res.withColumn("cusum", s).withColumn("alarm", F.col("cusum") > F.lit(float(h)))
                .drop("_hist", "_m"))

    return nulls_apart(df, x, detect)


# --- D2 Cramer-von Mises ------------------------------------------------------------

def cvm_critical(alpha: float) -> float:
    if alpha not in fixed.CVM_CRITICAL:
        raise ValueError(f"alpha must be one of {sorted(fixed.CVM_CRITICAL)}")
    return fixed.CVM_CRITICAL[alpha]


def cvm(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int = 10,
        alpha: float = 0.05, min_shift: float = 10.0, standardise: bool = False) -> DataFrame:
    """Cramer-von Mises statistic of the last ``n`` values against N(0, 1).

    W2 = 1/(12n) + sum_i ((2i-1)/(2n) - Phi(x_(i)))^2 over the sorted history (raw
    values unless ``standardise``). Rejection uses Stephens' modified statistic
    W* = (W2 - 0.4/n + 0.6/n^2)(1 + 1/n) against its critical value at ``alpha``.
    Alarm when rejected and |x - mean(history)| > ``min_shift``.
    """
    return nulls_apart(df, x, lambda rows: _cvm(rows, keys, order, x, n, alpha, min_shift, standardise))


def _cvm(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int, alpha: float,
         min_shift: float, standardise: bool) -> DataFrame:
    res = bounded_frames(df, keys, order, n, lambda fr: {
        "_hist": F.collect_list(F.col(x)).over(fr(-(n - 1), 0)),
        "_m": F.avg(F.col(x)).over(fr(-(n - 1), 0)),
        "_sd": F.stddev_samp(F.col(x)).over(fr(-(n - 1), 0))})
    res = res.filter(F.size("_hist") == n)
    z = "coalesce(try_divide(v - _m, _sd), 0.0)" if standardise else "v"
    terms = (f"transform(array_sort(_hist), (v, i) -> pow((2 * i + 1) / (2.0 * {n}) - "
             f"{normal_cdf_expr(z)}, 2))")
    w2 = F.expr(f"1.0 / (12 * {n}) + aggregate({terms}, CAST(0.0 AS DOUBLE), (a, t) -> a + t)")
    crit = cvm_critical(alpha)
    wstar = (F.col("cvm_w2") - 0.4 / n + 0.6 / (n * n)) * (1.0 + 1.0 / n)
    return (res.withColumn("cvm_w2", w2)
            .withColumn("shift", F.abs(F.col(x) - F.col("_m")))
            .withColumn("rejected", wstar > F.lit(crit))
            .withColumn("alarm", F.col("rejected") & (F.col("shift") > F.lit(float(min_shift))))
            .drop("_hist", "_m", "_sd"))


# --- D3 KSWIN ----------------------------------------------------------------------

def ks_exact_pvalue(n: int, k: int) -> float:
    """P(D >= k/n) for two samples of equal size n (exact, continuous data)."""
    total = comb(2 * n, n)
    s = 0
    j = 1
    while n - j * k >= 0:
        s += (-1) ** (j - 1) * comb(2 * n, n - j * k)
        j += 1
    return min(1.0, 2.0 * s / total)


def ks_critical_count(n: int, alpha: float) -> int:
    """Smallest k with P(D >= k/n) <= alpha (computed once, on the driver, from n and alpha)."""
    for k in range(1, n + 1):
        if ks_exact_pvalue(n, k) <= alpha:
            return k
    return n + 1


_KS_FOLD = """aggregate(
  array_sort(concat(transform(older, v -> named_struct('v', v, 't', 0)),
                    transform(recent, v -> named_struct('v', v, 't', 1)))),
  named_struct('c1', 0, 'c2', 0, 'p', CAST(NULL AS DOUBLE), 'd', 0),
  (s, e) -> named_struct(
     'c1', s.c1 + IF(e.t = 0, 1, 0),
     'c2', s.c2 + IF(e.t = 1, 1, 0),
     'p', e.v,
     'd', IF(s.p IS NOT NULL AND e.v > s.p, greatest(s.d, abs(s.c1 - s.c2)), s.d)),
  s -> s.d)"""


def kswin(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, window: int = 200,
          stat: int = 100, alpha: float = 1e-4, warmup: int = 0, min_stat: float = 0.1,
          method: str = "arrow", pos_col: str | None = None) -> DataFrame:
    """D3 without reset: two-sample KS test of the older ``window-stat`` values against
    the newest ``stat`` values of the last ``window`` (requires window = 2 * stat).

    The statistic is a merge pass over the sorted union (ties handled by only evaluating
    between distinct values): ``method="arrow"`` runs it with numpy over pieces of a series,
    ``"sql"`` as an array fold. Alarm when D >= the exact critical value at
    ``alpha`` and D > ``min_stat``. With ``warmup`` = W > 0, records 1..W-1 only fill the
    window, record W is skipped, and testing starts at record W+1.
    """
    if window != 2 * stat:
        raise ValueError("exact test implemented for window = 2 * stat")
    return nulls_apart(df, x, lambda rows: kswin_of_values(rows, keys, order, x, window, stat, alpha, warmup, min_stat,
                                                           method, pos_col))


def kswin_of_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, window: int, stat: int,
                    alpha: float, warmup: int, min_stat: float, method: str = "arrow",
                    pos_col: str | None = None) -> DataFrame:
    """``kswin`` on rows without NULL values."""
    kcrit = ks_critical_count(stat, alpha)
    src = df
    if warmup > 0:
        src = with_position(df, keys, order, "_wpos").filter(F.col("_wpos") != warmup)
    if method == "arrow":
        res = _ks_of_pieces(src, list(keys), order, x, window, stat, pos_col)
    else:
        res = bounded_frames(src, keys, order, window, lambda fr: {
            "older": F.collect_list(F.col(x)).over(fr(-(window - 1), -stat)),
            "recent": F.collect_list(F.col(x)).over(fr(-(stat - 1), 0))}, pos_col=pos_col)
        res = res.filter((F.size("older") == window - stat) & (F.size("recent") == stat))
        res = res.withColumn("ks_count", F.expr(_KS_FOLD)).drop("older", "recent")
    if warmup > 0:
        res = res.filter(F.col("_wpos") > warmup).drop("_wpos")
    return (res.withColumn("ks_d", F.col("ks_count") / F.lit(float(stat)))
            .withColumn("alarm", (F.col("ks_count") >= kcrit) & (F.col("ks_d") > min_stat)))


def _ks_of_pieces(df: DataFrame, keys: list[str], order: Sequence[str], x: str, window: int, stat: int,
                  pos_col: str | None) -> DataFrame:
    """The rows that end a full window, with ``ks_count``. A series is cut into pieces of
    ``KS_PIECE`` rows (at least four windows); a piece gets the ``window`` - 1 rows before it and
    is one grouped call, so that a row is handed to Python once and not its whole window."""
    import pyarrow as pa

    size = max(KS_PIECE, 4 * window)
    p = pos_col or "_kspos"
    pos = with_position(df, keys, order, p)
    piece = F.floor((F.col(p) - 1) / size)
    tail = (F.col(p) - 1) % size >= size - (window - 1)
    rows = pos.withColumn("_piece", F.explode(F.when(tail, F.array(piece, piece + 1)).otherwise(F.array(piece))))
    names = [*df.columns] + ([p] if pos_col else [])
    schema = StructType([pos.schema[n] for n in names] + [StructField("ks_count", IntegerType())])

    def fn(part: pa.Table) -> pa.Table:
        at = part.column(p).to_numpy()
        order_of = np.argsort(at)
        home = (at[order_of] - 1) // size == part.column("_piece")[0].as_py()
        found = ks_counts(part.column(x).cast(pa.float64(), safe=False).to_numpy()[order_of], window, stat) if len(at) >= window else []
        mine = home[window - 1:]
        kept = part.select(names).take(pa.array(order_of[window - 1:][mine]))
        return kept.append_column("ks_count", pa.array(np.asarray(found, dtype=np.int32)[mine], pa.int32()))

    # a fixed number: the rows are few bytes for their work, which adaptive plans would put into few tasks
    tasks = max(_shuffle_partitions(df), df.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys, "_piece").groupBy(*keys, "_piece").applyInArrow(fn, schema)


# --- D5b Page-Hinkley --------------------------------------------------------------

def page_hinkley(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, delta: float = 0.005,
                 lam: float = 50.0, warn: float = 0.5, force_blocks: bool = False) -> DataFrame:
    """m_t = sum_{i<=t} (x_i - mean_i - delta), M_t = min_{i<=t} m_i;
    state 'drift' when m_t - M_t > lam, 'warning' when > warn * lam, else 'none'.

    Three running scans (sum, sum, min); each is hot-key safe via ``running``.
    """
    return nulls_apart(df, x, lambda rows: page_hinkley_of_values(rows, keys, order, x, delta, lam, warn, force_blocks))


def page_hinkley_of_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, delta: float = 0.005,
                           lam: float = 50.0, warn: float = 0.5, force_blocks: bool = False) -> DataFrame:
    """``page_hinkley`` on rows without NULL values."""
    split = force_blocks or largest_group(df, keys) > BLOCK_ROWS  # one size check for all three scans
    a = running(df, keys, order, {"_cs": ("sum", F.col(x)), "_cn": ("sum", F.lit(1))}, blocks=split)
    a = a.withColumn("_dev", F.col(x) - F.col("_cs") / F.col("_cn") - F.lit(delta))
    b = running(a, keys, order, {"ph_m": ("sum", F.col("_dev"))}, blocks=split)
    c = running(b, keys, order, {"ph_min": ("min", F.col("ph_m"))}, blocks=split)
    gap = F.col("ph_m") - F.col("ph_min")
    state = F.when(gap > lam, "drift").when(gap > warn * lam, "warning").otherwise("none")
    return c.withColumn("ph_stat", gap).withColumn("state", state).drop("_cs", "_cn", "_dev")
