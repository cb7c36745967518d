"""Numpy forms of statistics that are slow as interpreted higher-order functions."""

from __future__ import annotations

import numpy as np


KS_ROWS = 4_096  # windows that are compared at once


def ks_counts(values: np.ndarray, window: int, stat: int) -> np.ndarray:
    """Two-sample KS statistic times n of every ``window`` values in a row, the newest ``stat``
    against as many older ones: max over values v of |#(older <= v) - #(recent <= v)|,
    evaluated after ties."""
    known, rank = np.unique(values, return_inverse=True)  # NaN is one value, the largest
    nan = len(known) - 1 if len(known) and np.isnan(known[-1]) else -1
    w = np.lib.stride_tricks.sliding_window_view(rank.astype(np.int32) * 2, window)
    recent = (np.arange(window) >= window - stat).astype(np.int32)
    out = [np.zeros(0, dtype=np.int32)]
    for k in range(0, len(w), KS_ROWS):
        v = np.sort(w[k:k + KS_ROWS] + recent, axis=1)
        run = np.abs(np.cumsum(1 - 2 * (v & 1), axis=1, dtype=np.int32))
        v >>= 1
        run[:, :-1][(v[:, 1:] == v[:, :-1]) | (v[:, 1:] == nan)] = 0
        out.append(run.max(axis=1))
    return np.concatenate(out)
