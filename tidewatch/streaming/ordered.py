"""Keyed detectors over a stream in event-time order.

The detectors of ``stateful`` take late rows in the order of arrival. Here a key's rows wait
in a state buffer until the watermark has passed them; an event-time timer then hands them on
as one run sorted by (time, id), so the results are those of the batch forms whatever the
order in which rows arrive, as long as none is later than ``delay`` (later ones are dropped
by Spark, as in every event-time aggregate).

Keys are dealt by hash to ``buckets``, and a bucket is what Spark keeps state for: a call, a
timer and the state's reads and writes are paid for once a bucket and micro-batch, and a
bucket's keys are computed in arrays. The state of a bucket is the last few rows of each of its
keys (as many as the detector's window) and the rows of the last ``delay`` of event time, as
Arrow tables. The number of buckets bounds the tasks that share a stream and can't change over a
restart. With ``idle`` a key that has had no row for so long (in event time) is forgotten; its
next row starts a new series.

Rows without a time cannot be placed and are left out, as are times before 1970 (a watermark
starts there); of rows that are equal in (time, id)
either may come first. NULL and NaN features are the same. Needs the RocksDB state store
(``io.rocksdb_state``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.streaming.stateful import cusum_of_histories

BUCKETS = 256
# what stands for NULL in columns that pandas would turn into floats or can't sort
FILL = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "boolean": False, "string": ""}
MARK, TAIL, NEW = 0, 1, 2  # rows of a bucket: time of a key's last row, its last rows, rows to run


class Detector(NamedTuple):
    """``run(x, place)``: output columns (values, missing) of rows in the order of their series, each at
    ``place`` in its series or in what is left of it; rows at ``first`` and later have an output.
    ``tail`` rows of a series are kept. With ``known_only`` rows without a value have no place."""

    run: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]
    first: int
    tail: int
    known_only: bool


def to_blob(p: pd.DataFrame) -> bytes:
    import pyarrow as pa

    table, sink = pa.Table.from_pandas(p, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pd.DataFrame:
    import pyarrow as pa
    return pa.ipc.open_stream(pa.py_buffer(bytes(blob))).read_all().to_pandas()


def nullable(values, missing) -> pd.Series:
    """``values`` with NULL where ``missing``; numbers and truth values stay as they are."""
    values = pd.Series(values).reset_index(drop=True)
    if not missing.any():
        return values
    if values.dtype.kind == "b":
        return pd.Series(pd.arrays.BooleanArray(values.to_numpy(), missing))
    if values.dtype.kind == "i":
        return pd.Series(pd.arrays.IntegerArray(values.to_numpy(), missing))
    return values.where(~missing) if values.dtype.kind in "fM" else values.astype(object).where(~missing, None)


def run_series(rows: pd.DataFrame, key_columns: list[str], n_features: int, detector: Detector, idle: int | None):
    """A bucket's rows (columns ``key_columns``, kind, micros, id, id_null, x0 ...), those of a key that
    are kept before its new ones: (output frame of the new rows, rows to keep). ``idle``: microseconds
    after which a key's next row starts a new series."""
    rows_code = code = rows.groupby(key_columns, dropna=False, sort=False).ngroup().to_numpy()
    kind, t, ids = rows["kind"].to_numpy(), rows["micros"].to_numpy(), rows["id"].to_numpy()
    marked = np.full(code.max() + 1, -1)
    marked[code[kind == MARK]] = t[kind == MARK]
    if ids.dtype.kind not in "iufMm":
        ids = pd.factorize(rows["id"], sort=True)[0]
    new = kind == NEW
    order = np.lexsort((np.where(new, ids, ids[:1]), rows["id_null"].to_numpy() & new, np.where(new, t, 0), kind, code))
    order = order[kind[order] != MARK]
    code, t, new = code[order], t[order], new[order]
    x = rows[[f"x{i}" for i in range(n_features)]].to_numpy(dtype=float)[order]
    starts = np.append(True, code[1:] != code[:-1])
    if idle is not None:
        before = np.append(-1, t[:-1])
        first_new = new & (starts | np.append(True, ~new[:-1]))
        before[first_new] = marked[code[first_new]]
        late = new & (t - before >= idle) & (before >= 0)
        starts |= late
    series = np.cumsum(starts) - 1
    last_series = np.zeros(len(marked), dtype=np.int64)
    last_series[code] = series  # the last one written counts: rows are in order

    known = np.flatnonzero(~np.isnan(x[:, 0])) if detector.known_only else np.arange(len(x))
    mine = series[known]
    size = np.bincount(mine, minlength=series[-1] + 1) if len(series) else np.zeros(0, np.int64)
    place = np.arange(len(known)) - np.repeat(np.cumsum(size) - size, size)
    columns = detector.run(x[known], place)
    out = np.flatnonzero(new[known] & (place >= detector.first))
    blank = np.setdiff1d(np.flatnonzero(new), known, assume_unique=True)
    at = order[np.concatenate([known[out], blank])]
    found = rows.iloc[at][[*key_columns, "id", "id_null"]].reset_index(drop=True)
    for i, (values, missing) in enumerate(columns):
        found[f"out{i}"] = nullable(np.concatenate([values[out], np.zeros(len(blank), values.dtype)]),
                                    np.concatenate([missing[out], np.ones(len(blank), dtype=bool)]))

    stays = (mine == last_series[code[known]]) & (np.repeat(size, size) - place <= detector.tail)
    kept = rows.iloc[order[known[stays]]].assign(kind=TAIL, micros=0, id=rows["id"].iloc[0], id_null=False)
    if idle is not None:
        newest = marked.copy()
        newest[code[new]] = t[new]  # in order: the last one counts
        one = np.unique(rows_code, return_index=True)[1]
        kept = pd.concat([rows.iloc[one].assign(kind=MARK, micros=newest, id=rows["id"].iloc[0], id_null=False), kept])
    return found, kept


class EventOrder(StatefulProcessor):
    """Holds a bucket's rows back until the watermark has passed them, then runs the detector on
    those of all its keys."""

    def __init__(self, key_columns: list[str], n_features: int, detector: Detector, idle_ms: int | None):
        self.key_columns, self.n_features, self.detector = key_columns, n_features, detector
        self.idle = None if idle_ms is None else idle_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")
        self.due = handle.getValueState("due", "t bigint")  # when the first row that waits is to be run

    def handleInputRows(self, key, rows, timerValues):
        frames = [p for p in rows if len(p)]
        if frames:
            p = pd.concat(frames, ignore_index=True)
            self.waiting.appendValue((to_blob(p[[*self.key_columns, "micros", "id", "id_null",
                                                 *[f"x{i}" for i in range(self.n_features)]]]),))
            first, due = int(p["micros"].min()), self.due.get()
            if due is None or first < due[0]:
                self._wait(first)
        return iter(())

    def _wait(self, t: int) -> None:
        self.due.update((t,))
        self.handle.registerTimer(t // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = self.due.get()
        if due is not None and due[0] <= passed:
            yield from self._run(passed)
        elif self.idle is not None:
            kept = self.kept.get()
            if kept is not None:
                self._keep(from_blob(kept[0]), passed)

    def _run(self, passed: int):
        rows = pd.concat([from_blob(part[0]) for part in self.waiting.get()], ignore_index=True)
        ready = rows["micros"].to_numpy() <= passed
        rest = rows[~ready]
        if len(rest):
            self.waiting.put([(to_blob(rest),)])
            self._wait(int(rest["micros"].min()))
        else:
            self.waiting.clear()
            self.due.clear()
        rows, kept = rows[ready].assign(kind=NEW), self.kept.get()
        if kept is not None:
            rows = pd.concat([from_blob(kept[0]), rows])
        found, kept = run_series(rows.reset_index(drop=True), self.key_columns, self.n_features, self.detector, self.idle)
        self._keep(kept, passed)
        if len(found):
            yield pd.DataFrame({**{k: nullable(found[k], found[f"{k}_null"].to_numpy())
                                   for k in self.key_columns if not k.endswith("_null")},
                                "id": nullable(found["id"], found["id_null"].to_numpy()),
                                **{c: found[c] for c in found.columns if c.startswith("out")}})

    def _keep(self, kept: pd.DataFrame, passed: int) -> None:
        """Write the rows to keep, without those of keys that have been idle for too long."""
        if self.idle is not None and len(kept):
            marks = (kept["kind"] == MARK).to_numpy()
            code = kept.groupby(self.key_columns, dropna=False, sort=False).ngroup().to_numpy()
            last = np.zeros(code.max() + 1, dtype=np.int64)
            last[code[marks]] = kept["micros"].to_numpy()[marks]
            kept = kept[last[code] + self.idle > passed]
            if len(kept):
                self.handle.registerTimer(int((last[last + self.idle > passed].min() + self.idle) // 1000 + 1))
        if len(kept):
            self.kept.update((to_blob(kept),))
        else:
            self.kept.clear()

    def close(self) -> None:
        pass


def in_event_order(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str, xs: Sequence[str], delay: str,
                   detector: Detector, out: str, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows (keys, id, columns ``out``) of ``detector`` over each key's rows in event-time order.
    ``out`` is the DDL schema of flat columns, ``delay`` the watermark's delay."""
    types = dict(df.dtypes)

    def filled(c):
        return F.coalesce(F.col(c), F.lit(FILL[types[c]]).cast(types[c])) if types[c] in FILL else F.col(c)

    # names of its own: the processor's frames rename columns that begin with an underscore
    key_names, feature_names = [f"key{i}" for i in range(len(keys))], [f"x{i}" for i in range(len(xs))]
    at = F.col(time_col).cast("timestamp")
    rows = (df.where(F.col(time_col).isNotNull())
            .select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
                    *[filled(k).alias(n) for k, n in zip(keys, key_names)],
                    *[F.col(k).isNull().alias(f"{n}_null") for k, n in zip(keys, key_names)],
                    filled(id_col).alias("id"), F.col(id_col).isNull().alias("id_null"), at.alias("at"),
                    F.unix_micros(at).alias("micros"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, feature_names)])
            .withWatermark("at", delay))
    fields = [c.strip().split(" ", 1) for c in out.split(",")]
    schema = ", ".join([f"{n} {types[k]}" for k, n in zip(keys, key_names)] + [f"id {types[id_col]}"]
                       + [f"out{i} {kind}" for i, (_, kind) in enumerate(fields)])
    processor = EventOrder([*key_names, *[f"{n}_null" for n in key_names]], len(xs), detector, idle_ms)
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, key_names)], F.col("id").alias(id_col),
                        *[F.col(f"out{i}").alias(name.strip("`")) for i, (name, _) in enumerate(fields)])


def cusum_detector(n: int, k: float, h: float) -> Detector:
    """D1; the last n - 1 values of a series are kept, rows without a value come out without results."""
    def run(x, place):
        v, s = x[:, 0], np.full(len(x), np.nan)
        at = np.flatnonzero(place >= n - 1)
        if len(at):
            s[at] = cusum_of_histories(np.lib.stride_tricks.sliding_window_view(v, n)[at - n + 1], k)
        none = np.zeros(len(x), dtype=bool)
        return [(v, none), (s, none), (s > h, none)]
    return Detector(run, n - 1, n - 1, True)


def cusum_in_order(df: DataFrame, keys: Sequence[str], time_col: str, x: str, id_col: str, delay: str, n: int = 10,
                   k: float = 1.0, h: float = 5.0, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """D1 over a stream in event-time order: the rows of the batch form."""
    return in_event_order(df, keys, time_col, id_col, [x], delay, cusum_detector(n, k, h),
                          f"`{x}` double, cusum double, alarm boolean", idle_ms, buckets)


def log_density_ratios(rows: np.ndarray, h: float) -> np.ndarray:
    """D7 of each row against the one before it: log mean_i p_cur(x_i) / p_prev(x_i)."""
    cur, prev = rows[1:], rows[:-1]

    def log_kernel_sums(sample):
        d = cur[:, :, None] - sample[:, None, :]
        return np.logaddexp.reduce(-(d * d) / (2 * h * h), axis=2)

    if not len(cur):
        return np.zeros(0)
    return np.logaddexp.reduce(log_kernel_sums(cur) - log_kernel_sums(prev), axis=1) - math.log(rows.shape[1])


class MaxQueue:
    """Maximum of the last ``n`` numbers, by a queue of falling numbers with their places.
    NaN takes a place but is no maximum."""

    def __init__(self, n: int, places=(), numbers=(), at: int = 0):
        self.n, self.at = n, at
        self.queue = list(zip(places, numbers))

    def push(self, v: float) -> float:
        q = self.queue
        if v == v:
            while q and q[-1][1] <= v:
                q.pop()
            q.append((self.at, v))
        if q and q[0][0] <= self.at - self.n:
            del q[0]
        self.at += 1
        return q[0][1] if q else math.nan


def sliding_max(values: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``MaxQueue`` over many series at once: of each value and those before it in its series, n in
    all, the maximum, and whether there is one (NaN takes a place but is no maximum)."""
    known = ~np.isnan(values)
    values = np.where(known, values, -np.inf)
    top, any_known = values.copy(), known.copy()
    for j in range(1, min(n, len(values))):
        inside = place[j:] >= j
        top[j:] = np.maximum(top[j:], np.where(inside, values[:-j], -np.inf))
        any_known[j:] |= inside & known[:-j]
    return top, any_known


def density_ratio_detector(h: float, n: int, limit: float) -> Detector:
    """D7; the last n rows of a series are kept: n ratios with the next row's."""
    def run(x, place):
        r = np.full(len(x), np.nan)
        r[1:] = log_density_ratios(x, h)
        r[place == 0] = np.nan
        top, known = sliding_max(r, place, n)
        return [(r, np.isnan(r)), (top, ~known), (top > math.log(limit), ~known)]
    return Detector(run, 1, n, False)


def density_ratio_stream(df: DataFrame, keys: Sequence[str], time_col: str, xs: Sequence[str], id_col: str, delay: str,
                         h: float = 0.2, n: int = 10, limit: float = 1.5, idle_ms: int | None = None,
                         buckets: int = BUCKETS) -> DataFrame:
    """D7 over a stream in event-time order: the rows of the batch form."""
    return in_event_order(df, keys, time_col, id_col, xs, delay, density_ratio_detector(h, n, limit),
                          "log_rdr double, log_rdr_max double, alarm boolean", idle_ms, buckets)
