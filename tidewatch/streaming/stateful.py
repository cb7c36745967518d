"""Keyed stateful detectors for streams.

Row windows (``lag``, ``rowsBetween``) are refused on streaming DataFrames, so the
history-based detectors keep their bounded history in Spark's state store via
``applyInPandasWithState``: per key, the last ``n-1`` values (or the KSWIN window) are
the state, each micro-batch's rows of that key are sorted by the order columns and
scored with numpy, and the new tail is stored. State per key is bounded by the window,
not by the stream. Rows of a key that arrive in a later batch than newer rows are
appended in arrival order, as a record-at-a-time consumer would. Values that are NULL take
no place in a history; their rows come out with NULL results, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewatch.operators.detect.univariate import ks_critical_count


def _sorted_batches(pdfs, order: Sequence[str]) -> pd.DataFrame:
    frames = [p for p in pdfs if len(p)]
    if not frames:
        return pd.DataFrame()
    return pd.concat(frames, ignore_index=True).sort_values(list(order), kind="mergesort")


def _values(pdf: pd.DataFrame, x: str, id_col: str):
    """(values, ids) of the rows with a value, and the ids of the rows without one."""
    v = pdf[x].astype(float).to_numpy()
    ids, known = pdf[id_col].to_numpy(), pdf[x].notna().to_numpy()
    return v[known], ids[known], ids[~known]


def histories(hist: list[float], vals: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values at each new value that has so many (one row each)."""
    both = np.concatenate([np.array(hist, dtype=float), vals])
    if len(both) < n:
        return np.zeros((0, n))
    return np.lib.stride_tricks.sliding_window_view(both, n)[-min(len(vals), len(both) - n + 1):]


def cusum_of_histories(w: np.ndarray, k: float) -> np.ndarray:
    """D1's statistic of each row of ``w`` (a history), all folds at once."""
    m, s = w.mean(axis=1), np.zeros(len(w))
    for j in range(w.shape[1]):
        s = np.maximum(0.0, s + w[:, j] - m - k)
    return s


def _run(df: DataFrame, keys: Sequence[str], fn, out_schema: str, state_schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                    GroupStateTimeout.NoTimeout)


def cusum_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, id_col: str,
                 n: int = 10, k: float = 1.0, h: float = 5.0) -> DataFrame:
    """D1 over a stream; same output rows as the batch form on in-order input."""
    key_types = dict(df.dtypes)
    out_schema = ", ".join([f"`{c}` {key_types[c]}" for c in keys] +
                           [f"`{id_col}` {key_types[id_col]}", f"`{x}` double", "cusum double", "alarm boolean"])

    def fn(key, pdfs, state):
        pdf = _sorted_batches(pdfs, order)
        hist = list(state.get[0]) if state.exists else []
        out = []
        if len(pdf):
            vals, ids, without = _values(pdf, x, id_col)
            w = histories(hist, vals, n)
            s = cusum_of_histories(w, k)
            first = len(vals) - len(w)
            out = [(*key, i, float(v), float(c), bool(c > h)) for i, v, c in zip(ids[first:], vals[first:], s)]
            out += [(*key, i, None, None, None) for i in without]
            state.update(((hist + vals.tolist())[-(n - 1):] if n > 1 else [],))
        yield pd.DataFrame(out, columns=[*keys, id_col, x, "cusum", "alarm"])

    return _run(df, keys, fn, out_schema, "hist array<double>")


KSWIN_ROWS = 4_096  # windows compared at once


def ks_counts(values: np.ndarray, window: int, stat: int) -> np.ndarray:
    """D3's statistic of every ``window`` values in a row: the largest difference between the
    numbers of older and of newest (``stat``) values up to any value."""
    w = np.lib.stride_tricks.sliding_window_view(values, window)
    order = np.argsort(w, axis=1, kind="stable")
    ranked = np.take_along_axis(w, order, axis=1)
    apart = np.abs(np.cumsum(np.where(order < window - stat, 1, -1), axis=1))
    apart[:, :-1][ranked[:, :-1] == ranked[:, 1:]] = 0  # equal values count together
    return apart.max(axis=1)


def _with_key(key, keys: Sequence[str], columns: dict) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    for at, (name, value) in enumerate(zip(keys, key)):
        out.insert(at, name, [value] * len(out))
    return out


def kswin_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, id_col: str,
                 window: int = 200, stat: int = 100, alpha: float = 1e-4, warmup: int = 0,
                 min_stat: float = 0.1) -> DataFrame:
    """D3 with reset over a stream (the reference's sequential semantics): after an
    alarm the window keeps only the newest ``stat`` values and must refill before the
    next test. State per key: window contents and the record counter."""
    kcrit = ks_critical_count(stat, alpha)
    key_types = dict(df.dtypes)
    out_schema = ", ".join([f"`{c}` {key_types[c]}" for c in keys] +
                           [f"`{id_col}` {key_types[id_col]}", f"`{x}` double", "ks_count int", "ks_d double",
                            "alarm boolean"])

    cols = list(dict.fromkeys([*order, x, id_col]))
    names = [*keys, id_col, x, "ks_count", "ks_d", "alarm"]

    def fn(key, pdfs, state):
        pdf = _sorted_batches((p[cols] for p in pdfs), order)
        win, seen = (list(state.get[0]), int(state.get[1])) if state.exists else ([], 0)
        if not len(pdf):
            yield pd.DataFrame([], columns=names)
            return
        vals, ids, without = _values(pdf, x, id_col)
        del pdf
        count = seen + 1 + np.arange(len(vals))
        seen += len(vals)
        if warmup > 0:
            vals, ids, count = (v[count != warmup] for v in (vals, ids, count))
        both = np.concatenate([np.array(win, dtype=float), vals])
        start, first = 0, len(win)  # of the window's values, of the new ones
        for at in range(max(first, window - 1), len(both), KSWIN_ROWS):
            ends = np.arange(at, min(at + KSWIN_ROWS, len(both)))
            c = ks_counts(both[at - window + 1:ends[-1] + 1], window, stat)
            ready = count[ends - first] >= warmup
            fires = (c >= kcrit) & (c / stat > min_stat) & ready
            tested, real = np.zeros(len(ends), dtype=bool), np.zeros(len(ends), dtype=bool)
            tested[max(0, start + window - 1 - at):] = True
            for i in np.nonzero(fires)[0].tolist():
                if tested[i]:  # the window restarts from its newest values and must refill
                    real[i], start = True, at + i - stat + 1
                    tested[i + 1:max(i + 1, start + window - 1 - at)] = False
            tested &= ready
            yield _with_key(key, keys, {id_col: ids[ends - first][tested], x: both[ends][tested], "ks_count": c[tested],
                                        "ks_d": c[tested] / stat, "alarm": real[tested]})
        if len(without):
            none = [None] * len(without)
            yield _with_key(key, keys, {id_col: without, x: none, "ks_count": none, "ks_d": none, "alarm": none})
        state.update((both[max(start, len(both) - window):].tolist(), seen))

    return _run(df, keys, fn, out_schema, "win array<double>, seen bigint")


def nn_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], id_col: str,
              time_col: str, kth: int = 2, limit: float = 1e-5) -> DataFrame:
    """D8 / S11 over a stream: per record the mean kth-nearest distance of its features
    to the previous record's, and the drift point (time, flag, divergence). The
    divergence of that mean with itself is 0 as in the method reproduced, so the flag
    only fires if ``limit`` < 0; state per key is the previous feature vector."""
    key_types = dict(df.dtypes)
    out_schema = ", ".join([f"`{c}` {key_types[c]}" for c in keys] +
                           [f"`{id_col}` {key_types[id_col]}", f"`{time_col}` {key_types[time_col]}",
                            "avg_nn double", "drift_detected boolean", "kl_divergence double"])

    def fn(key, pdfs, state):
        pdf = _sorted_batches(pdfs, order)
        if not len(pdf):
            yield pd.DataFrame([], columns=[*keys, id_col, time_col, "avg_nn", "drift_detected", "kl_divergence"])
            return
        mat = pdf[list(xs)].astype(float).to_numpy()
        first = 0 if state.exists else 1  # a key's first record has none before it
        before = np.vstack([state.get[0], mat[:-1]]) if state.exists else mat[:-1]
        state.update((mat[-1].tolist(),))
        d = np.sort(np.abs(mat[first:, :, None] - before[:, None, :]), axis=2)
        avg = d[:, :, kth - 1].mean(axis=1) if d.shape[2] >= kth else np.full(len(d), np.nan)
        kl = np.zeros(len(d))
        yield _with_key(key, keys, {id_col: pdf[id_col].iloc[first:].reset_index(drop=True),
                                    time_col: pdf[time_col].iloc[first:].reset_index(drop=True),
                                    "avg_nn": avg, "drift_detected": kl > limit, "kl_divergence": kl})

    return _run(df, keys, fn, out_schema, "prev array<double>")


def cvm_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, id_col: str,
               n: int = 10, crit: float = 0.461, min_shift: float = 10.0) -> DataFrame:
    """D2 over a stream (raw values against N(0,1), Stephens' modified statistic, gated by
    |x - mean(history)| > min_shift); same rows as the batch form on in-order input."""
    from tidewatch.functions.scalars import normal_cdf_py
    key_types = dict(df.dtypes)
    out_schema = ", ".join([f"`{c}` {key_types[c]}" for c in keys] +
                           [f"`{id_col}` {key_types[id_col]}", f"`{x}` double", "cvm_w2 double",
                            "shift double", "alarm boolean"])

    def fn(key, pdfs, state):
        pdf = _sorted_batches(pdfs, order)
        hist = list(state.get[0]) if state.exists else []
        rows = []
        if len(pdf):
            vals, ids, without = _values(pdf, x, id_col)
            w = histories(hist, vals, n)
            first = len(vals) - len(w)
            cdf = dict(zip(np.unique(w), map(normal_cdf_py, np.unique(w).tolist())))
            p = np.array([cdf[u] for u in np.sort(w, axis=1).ravel().tolist()]).reshape(w.shape)
            w2 = 1.0 / (12 * n) + (((2 * np.arange(n) + 1) / (2.0 * n) - p) ** 2).sum(axis=1)
            wstar = (w2 - 0.4 / n + 0.6 / (n * n)) * (1 + 1.0 / n)
            shift = np.abs(vals[first:] - w.mean(axis=1))
            rows = [(*key, i, float(v), float(c), float(d), bool(e > crit and d > min_shift))
                    for i, v, c, d, e in zip(ids[first:], vals[first:], w2, shift, wstar)]
            rows += [(*key, i, None, None, None, None) for i in without]
            state.update(((hist + vals.tolist())[-(n - 1):] if n > 1 else [],))
        yield pd.DataFrame(rows, columns=[*keys, id_col, x, "cvm_w2", "shift", "alarm"])

    return _run(df, keys, fn, out_schema, "hist array<double>")
