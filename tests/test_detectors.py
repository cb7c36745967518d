"""Detectors against plain-Python loops on hand-made series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.operators.detect import univariate as U
from tidewatch.operators.detect import vector as V


def series(spark, rows):
    return spark.createDataFrame(rows, "key STRING, t BIGINT, x DOUBLE, y DOUBLE")


def make_rows(seed=7):
    rnd = random.Random(seed)
    rows = []
    for key, n, kind in [("step", 300, "step"), ("ramp", 120, "ramp"), ("flat", 40, "flat"), ("short", 6, "flat")]:
        for t in range(n):
            if kind == "step":
                x = rnd.gauss(0, 1) + (8.0 if t >= 150 else 0.0)
            elif kind == "ramp":
                x = t * 0.3 + rnd.gauss(0, 0.5)
            else:
                x = 5.0
            rows.append((key, t, float(round(x, 3)), float(round(rnd.gauss(0, 1), 3))))
    return rows


def py_cusum(vals, n, k, h):
    out = {}
    for i in range(n - 1, len(vals)):
        hist = vals[i - n + 1:i + 1]
        m = sum(hist) / n
        s = 0.0
        for v in hist:
            s = max(0.0, s + v - m - k)
        out[i] = (s, s > h)
    return out


def test_cusum_matches_loop(spark):
    rows = make_rows()
    got = {(r.key, r.t): (r.cusum, r.alarm) for r in
           U.cusum(series(spark, rows), ["key"], ["t"], "x", 10, 1.0, 5.0).collect()}
    for key in {r[0] for r in rows}:
        vals = [r[2] for r in rows if r[0] == key]
        want = py_cusum(vals, 10, 1.0, 5.0)
        assert {(key, t) for t in want} == {k for k in got if k[0] == key}
        for t, (s, a) in want.items():
            assert got[(key, t)][0] == pytest.approx(s, abs=1e-9)
            assert got[(key, t)][1] == a


def phi(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def test_cvm_statistic_and_gate(spark):
    rows = make_rows()
    got = {(r.key, r.t): r for r in U.cvm(series(spark, rows), ["key"], ["t"], "x", 10, 0.05, 3.0).collect()}
    for key in {r[0] for r in rows}:
        vals = [r[2] for r in rows if r[0] == key]
        for i in range(9, len(vals)):
            hist = sorted(vals[i - 9:i + 1])
            w2 = 1 / 120 + sum(((2 * j + 1) / 20 - phi(v)) ** 2 for j, v in enumerate(hist))
            r = got[(key, i)]
            assert r.cvm_w2 == pytest.approx(w2, abs=1e-6)  # erf polynomial error 1.5e-7
            wstar = (w2 - 0.04 + 0.006) * 1.1
            shift = abs(vals[i] - sum(vals[i - 9:i + 1]) / 10)
            if abs(wstar - 0.461) > 1e-5:
                assert r.alarm == (wstar > 0.461 and shift > 3.0)


def ks_count_py(a, b):
    grid = sorted(set(a) | set(b))
    return max(abs(sum(x <= v for x in a) - sum(x <= v for x in b)) for v in grid)


@pytest.mark.parametrize("method", ["arrow", "sql"])
def test_kswin_noreset_matches_loop(spark, method):
    rows = make_rows()
    got = {(r.key, r.t): r for r in
           U.kswin(series(spark, rows), ["key"], ["t"], "x", 40, 20, 0.05, method=method).collect()}
    k = U.ks_critical_count(20, 0.05)
    for key in {r[0] for r in rows}:
        vals = [r[2] for r in rows if r[0] == key]
        for i in range(39, len(vals)):
            c = ks_count_py(vals[i - 39:i - 19], vals[i - 19:i + 1])
            assert got[(key, i)].ks_count == c
            assert got[(key, i)].alarm == (c >= k and c / 20 > 0.1)
        assert len([g for g in got if g[0] == key]) == max(0, len(vals) - 39)


def test_ks_critical_values():
    # thresholds of the exact equal-sample test
    assert [U.ks_critical_count(20, a) for a in (0.05, 0.01, 1e-4)] == [9, 11, 14]
    assert [U.ks_critical_count(100, a) for a in (0.05, 0.01, 1e-4)] == [20, 23, 32]


def test_density_ratio_matches_loop(spark):
    rows = make_rows()
    got = {(r.key, r.t): r for r in
           V.density_ratio(series(spark, rows), ["key"], ["t"], ["x", "y"], 0.2, 10, 1.5).collect()}
    for key in {r[0] for r in rows}:
        pts = [(r[2], r[3]) for r in rows if r[0] == key]
        ratios = []
        for i in range(1, len(pts)):
            cur, prev = np.array(pts[i]), np.array(pts[i - 1])

            def lse(sample, x):
                a = -((x - sample) ** 2) / (2 * 0.04)
                return a.max() + math.log(np.exp(a - a.max()).sum())
            d = np.array([lse(cur, x) - lse(prev, x) for x in cur])
            lr = d.max() + math.log(np.exp(d - d.max()).sum()) - math.log(len(cur))
            ratios.append(lr)
            r = got[(key, i)]
            assert r.log_rdr == pytest.approx(lr, rel=1e-9, abs=1e-9)
            assert r.log_rdr_max == pytest.approx(max(ratios[-10:]), rel=1e-9, abs=1e-9)


def test_page_hinkley_matches_loop(spark):
    rows = make_rows()
    got = {(r.key, r.t): r for r in U.page_hinkley(series(spark, rows), ["key"], ["t"], "x", 0.005, 50.0).collect()}
    for key in {r[0] for r in rows}:
        vals = [r[2] for r in rows if r[0] == key]
        s = m = 0.0
        mn = float("inf")
        for i, v in enumerate(vals):
            s += v
            m += v - s / (i + 1) - 0.005
            mn = min(mn, m)
            assert got[(key, i)].ph_stat == pytest.approx(m - mn, abs=1e-9)


def test_cvm_alpha_table():
    assert U.cvm_critical(0.05) == fixed.CVM_CRITICAL[0.05]
    with pytest.raises(ValueError):
        U.cvm_critical(0.2)


def py_kswin_reset(vals, window, stat, kcrit, warmup=0):
    out = {}
    win, seen = [], 0
    for i, v in enumerate(vals):
        seen += 1
        if warmup > 0 and seen == warmup:
            continue
        win = (win + [v])[-window:]
        if len(win) < window or (warmup > 0 and seen < warmup):
            continue
        c = ks_count_py(win[:window - stat], win[window - stat:])
        alarm = c >= kcrit and c / stat > 0.1
        out[i] = (c, alarm)
        if alarm:
            win = win[window - stat:]
    return out


def test_kswin_reset_matches_sequential_loop(spark):
    from tidewatch.operators.detect.reset import kswin_reset
    rnd = random.Random(3)
    rows = []
    for key, n in [("a", 400), ("b", 150)]:
        for t in range(n):
            shift = 4.0 if (t // 60) % 2 else 0.0
            rows.append((key, t, float(round(rnd.gauss(0, 1) + shift, 3)), 0.0))
    k = U.ks_critical_count(20, 0.05)
    got = {(r.key, r.t): (r.ks_count, r.alarm) for r in
           kswin_reset(series(spark, rows), ["key"], ["t"], "x", 40, 20, 0.05).collect()}
    want = {}
    for key in ("a", "b"):
        vals = [r[2] for r in rows if r[0] == key]
        for i, cv in py_kswin_reset(vals, 40, 20, k).items():
            want[(key, i)] = cv
    assert any(a for _, a in want.values())
    assert got == want


def test_kswin_stream_matches_sequential_loop(spark):
    from tidewatch.streaming.stateful import kswin_stream
    rnd = random.Random(5)
    rows = [("a", t, float(round(rnd.gauss(0, 1) + (3.0 if t > 90 else 0.0), 3)), 0.0) for t in range(200)]
    df = series(spark, rows)
    # applyInPandasWithState needs a streaming input: a file stream over the rows.
    import tempfile
    path = tempfile.mkdtemp(prefix="kswin-src-", dir="/tmp")
    df.write.mode("overwrite").parquet(path)
    src = spark.readStream.schema(df.schema).parquet(path)
    det = kswin_stream(src, ["key"], ["t"], "x", "t", 40, 20, 0.05)
    q = det.writeStream.format("memory").queryName("kswin_test").outputMode("append").trigger(
        availableNow=True).option("checkpointLocation", tempfile.mkdtemp(dir="/tmp")).start()
    q.awaitTermination()
    got = {r.t: (r.ks_count, r.alarm) for r in spark.sql("SELECT * FROM kswin_test").collect()}
    want = py_kswin_reset([r[2] for r in rows], 40, 20, U.ks_critical_count(20, 0.05))
    assert got == want
