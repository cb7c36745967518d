"""kdq-tree, PCA-CD and one-class SVM on planted changes; stream restart from checkpoint."""

import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators.detect.kdq import _kl_rows, kdq_tree
from tidewatch.operators.detect.ocsvm import one_class_svm
from tidewatch.operators.detect.pca import pca_cd


def planted(spark, n=600, change_at=400, dims=3, seed=11):
    rnd = random.Random(seed)
    rows = []
    for key in ("a", "b"):
        for t in range(n):
            shift = 3.0 if (key == "a" and t >= change_at) else 0.0
            rows.append((key, t, *[rnd.gauss(0, 1) + shift for _ in range(dims)]))
    cols = ", ".join(f"x{i} DOUBLE" for i in range(dims))
    return spark.createDataFrame(rows, f"key STRING, t BIGINT, {cols}")


def test_kdq_flags_the_shifted_blocks(spark):
    df = planted(spark)
    out = {(r.key, r.block): r for r in
           kdq_tree(df, ["key"], ["t"], ["x0", "x1", "x2"], window=100, max_count=10, boot=200).collect()}
    assert all(out[("a", b)].drift for b in (4, 5))
    assert out[("a", 4)].kl > 5 * max(out[("a", b)].kl for b in (1, 2, 3))
    assert not any(out[("b", b)].drift and out[("b", b)].kl > out[("a", 4)].kl for b in range(1, 6))


def test_kl_smoothing_formula():
    ref, test = np.array([[3.0, 0.0, 1.0]]), np.array([[1.0, 2.0, 1.0]])
    pr = (ref + 0.5) / (4 + 1.5)
    pt = (test + 0.5) / (4 + 1.5)
    assert np.isclose(_kl_rows(ref, test)[0], np.sum(pr * np.log(pr / pt)))


def test_pca_cd_divergence_peaks_after_change(spark):
    df = planted(spark)
    out = {(r.key, r.block): r for r in
           pca_cd(df, ["key"], ["t"], ["x0", "x1", "x2"], window=50, delta=0.1, lam=1.0).collect()}
    before = max(out[("a", b)].divergence for b in range(1, 8))
    after = min(out[("a", b)].divergence for b in range(8, 12))
    assert after > before
    assert out[("a", 11)].state == "drift"


def test_one_class_svm_alarm_share(spark):
    df = planted(spark).withColumn("rid", F.monotonically_increasing_id())
    out = one_class_svm(df, ["key"], ["x0", "x1", "x2"], nu=0.1, q=0.99)
    share = out.agg(F.avg(F.col("alarm").cast("double"))).first()[0]
    assert 0.005 <= share <= 0.03


def test_stream_restarts_from_checkpoint(spark):
    from tidewatch.streaming import io as SIO
    from tidewatch.streaming.stateful import cusum_stream
    src = tempfile.mkdtemp(prefix="src-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="out-", dir="/tmp")
    rnd = random.Random(2)
    rows = [("k", t, float(rnd.gauss(0, 1))) for t in range(60)]
    schema = "key STRING, t BIGINT, x DOUBLE"
    spark.createDataFrame(rows[:30], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = SIO.read_stream(spark, "parquet", src, schema)
        q = SIO.write_stream(cusum_stream(s, ["key"], ["t"], "x", "t", 10, 0.5, 2.0), "parquet", out, ck)
        SIO.await_all([q])

    run()
    first = spark.read.parquet(out).count()
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(src)
    run()  # same checkpoint: only the new file is read, history carried in state
    got = spark.read.parquet(out)
    assert first == 21 and got.count() == 51
    assert got.select("t").distinct().count() == 51


def test_kdq_reset_moves_reference_to_last_drift(spark):
    df = planted(spark, n=900, change_at=400)
    rows = kdq_tree(df, ["key"], ["t"], ["x0", "x1", "x2"], window=100, max_count=10, boot=200,
                    reset=True).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
    for key, rs in by_key.items():
        rs.sort(key=lambda r: r.block)
        assert [r.block for r in rs] == list(range(1, 9))
        last = 0
        for r in rs:
            assert r.ref_block == last
            if r.drift:
                last = r.block
    a = {r.block: r for r in by_key["a"]}
    assert a[4].drift and a[4].ref_block == 0
    assert all(a[b].ref_block >= 4 for b in range(5, 9))
    assert not any(a[b].drift for b in range(5, 9) if a[b].ref_block == 4 and b == 5)


def test_pca_reset_restarts_after_drift(spark):
    df = planted(spark, n=900, change_at=400)
    rows = pca_cd(df, ["key"], ["t"], ["x0", "x1", "x2"], window=50, delta=0.1, lam=1.0, reset=True).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
    for key, rs in by_key.items():
        rs.sort(key=lambda r: r.block)
        assert [r.block for r in rs] == list(range(1, 18))
        last = 0
        for r in rs:
            assert r.ref_block == last
            if r.state == "drift":
                last = r.block
    assert any(r.state == "drift" for r in by_key["a"])


def midpoint_leaves(rows, max_count):
    """A plain kdq-tree: a function from a point to its leaf, and the reference counts."""
    dims = len(rows[0])
    low, high = [min(c) for c in zip(*rows)], [max(c) for c in zip(*rows)]
    leaves = []

    def build(members, lo, hi, axis):
        if len(members) <= max_count:
            leaves.append(len(members))
            number = len(leaves) - 1
            return lambda x: number
        mid = (lo[axis] + hi[axis]) / 2
        below, above = [m for m in members if m[axis] < mid], [m for m in members if m[axis] >= mid]
        left = build(below, lo, [*hi[:axis], mid, *hi[axis + 1:]], (axis + 1) % dims)
        right = build(above, [*lo[:axis], mid, *lo[axis + 1:]], hi, (axis + 1) % dims)
        return lambda x: left(x) if x[axis] < mid else right(x)

    return build(rows, low, high, 0), leaves


def test_sliding_kdq_equals_a_loop_and_needs_persistence(spark):
    from tidewatch.operators.detect.kdq import kdq_sliding

    window, df = 40, planted(spark, n=700, change_at=450, dims=2)
    got = {(r.key, r.pos): r for r in kdq_sliding(df, ["key"], ["t"], ["x0", "x1"], window=window, max_count=8, boot=200,
                                                  persistence=0.2).collect()}
    assert len(got) == 2 * (700 - 2 * window + 1)
    for key in ("a", "b"):
        rows = [(r.x0, r.x1) for r in df.where(F.col("key") == key).orderBy("t").collect()]
        leaf_of, ref = midpoint_leaves(rows[:window], 8)
        run = 0
        for pos in range(2 * window, 701):
            counts = [0] * len(ref)
            for x in rows[pos - window:pos]:
                counts[leaf_of(x)] += 1
            r = got[(key, pos)]
            assert np.isclose(r.kl, _kl_rows(np.array([ref], dtype=float), np.array([counts], dtype=float))[0]), (key, pos)
            run = run + 1 if r.kl > r.threshold else 0
            assert (r.t, r.exceeds, r.run, r.state) == (pos - 1, run > 0, run, "drift" if run > 8 else "none")
    drifts = [p for (k, p), r in got.items() if k == "a" and r.state == "drift" and p > 450]
    assert drifts and min(drifts) <= 450 + window  # within one window of the change


def test_sliding_kdq_of_short_series(spark):
    from tidewatch.operators.detect.kdq import kdq_sliding

    df = planted(spark, n=60, change_at=50, dims=2)
    assert kdq_sliding(df, ["key"], ["t"], ["x0", "x1"], window=31, max_count=8).count() == 0
    assert kdq_sliding(df, ["key"], ["t"], ["x0", "x1"], window=30, max_count=8).count() == 2


def _rounds_and_whole(spark, monkeypatch, run):
    """Rows of ``run()`` with series walked whole and in rounds of four blocks of 20 rows, and the
    number of Spark jobs of the first."""
    from tidewatch.operators.detect import chain
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("whole", "whole")
    whole = sorted(run().collect())
    jobs = len(tracker.getJobIdsForGroup("whole"))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    monkeypatch.setattr(chain, "CHUNK_ROWS", 80)
    return sorted(run().collect()), whole, jobs


def _stepped(spark):
    """Series whose level changes often (many drifts), of unlike length; some NULLs."""
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 700), ("b", 165), ("c", 39), ("d", 20)):
        level = np.repeat(rng.integers(0, 6, n // 60 + 1) * 3.0, 60)[:n]
        x, y = level + rng.normal(0, 1, n), rng.normal(0, 1, n) - level
        rows += [(key, i, float(x[i]) if i % 31 else None, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, t long, x double, y double")


def test_kdq_reset_walks_long_series_in_rounds(spark, monkeypatch):
    df = _stepped(spark)
    rounds, whole, jobs = _rounds_and_whole(spark, monkeypatch, lambda: kdq_tree(
        df, ["key"], ["t"], ["x", "y"], window=20, max_count=5, boot=100, reset=True))
    assert rounds == whole and {r.key: 0 for r in whole} == {"a": 0, "b": 0}
    drifts = sum(r.drift for r in whole if r.key == "a")
    assert drifts >= 5 and jobs < 40  # a round for each drift took more than ten jobs
    # each reference's divergences are those of the column form on the rows from it on
    ref = max(r.ref_block for r in whole if r.key == "a")
    rest = df.where("key = 'a'").where(f"t >= {20 * ref}")
    plain = {r.block + ref: r.kl for r in kdq_tree(rest, ["key"], ["t"], ["x", "y"], window=20, max_count=5, boot=100).collect()}
    got = {r.block: r.kl for r in whole if r.key == "a" and r.ref_block == ref}
    assert got and all(abs(plain[b] - kl) < 1e-9 for b, kl in got.items())


def test_pca_reset_walks_long_series_in_rounds(spark, monkeypatch):
    from tidewatch.operators.detect.pca import pca_cd
    df = _stepped(spark)
    rounds, whole, jobs = _rounds_and_whole(spark, monkeypatch, lambda: pca_cd(
        df, ["key"], ["t"], ["x", "y"], window=20, delta=0.05, lam=0.5, reset=True))
    assert [r[:3] + r[5:] for r in rounds] == [r[:3] + r[5:] for r in whole]
    assert all(abs(a - b) < 1e-9 for r, s in zip(rounds, whole) for a, b in zip(r[3:5], s[3:5]))
    assert sum(r.state == "drift" for r in whole if r.key == "a") >= 4 and jobs < 40
    ref = max(r.ref_block for r in whole if r.key == "a")
    rest = df.where("key = 'a'").where(f"t >= {20 * ref}")
    plain = {r.block + ref: r for r in pca_cd(rest, ["key"], ["t"], ["x", "y"], window=20, delta=0.05, lam=0.5).collect()}
    got = [r for r in whole if r.key == "a" and r.ref_block == ref]
    assert got and all(abs(plain[r.block].divergence - r.divergence) < 1e-9
                       and abs(plain[r.block].ph_stat - r.ph_stat) < 1e-9 for r in got)


def test_sliding_kdq_of_chunks_is_that_of_whole_series(spark, monkeypatch):
    from tidewatch.operators.detect import kdq
    df = _stepped(spark)
    tracker = spark.sparkContext.statusTracker()

    def run(**kw):
        return sorted(kdq.kdq_sliding(df, ["key"], ["t"], ["x", "y"], window=20, max_count=5, boot=100, **kw).collect())
    spark.sparkContext.setJobGroup("sliding", "sliding")
    whole, plain = run(), run(with_threshold=False)
    assert len(tracker.getJobIdsForGroup("sliding")) < 40  # twenty jobs a run; the joins of leaves took more
    monkeypatch.setattr(kdq, "SLIDING_ROWS", 90)
    chunks = run()
    assert [(r.key, r.pos) for r in whole] == [(k, p) for k, n in (("a", 700), ("b", 165)) for p in range(40, n + 1)]
    assert [(r.key, r.pos, r.t, r.exceeds, r.run, r.state) for r in chunks] == [
        (r.key, r.pos, r.t, r.exceeds, r.run, r.state) for r in whole]
    assert max(r.run for r in whole) > 120 and all(abs(r.kl - s.kl) < 1e-9 for r, s in zip(chunks, whole))
    assert [(r.key, r.pos, r.kl) for r in plain] == [(r.key, r.pos, r.kl) for r in whole]
