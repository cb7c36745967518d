"""kdq-tree change detection (D4), after Dasu et al. (2006).

Per key the series is cut into tumbling blocks of ``window`` records (W5); block 0 is
the reference. The reference block's bounding box is split at midpoints, cycling the
axes, while a cell holds more than ``max_count`` reference rows (up to ``max_depth``
levels; by default 60, where the cells that are still too full hold all but equal rows). Leaf counts of every later block are compared with the reference by KL
divergence with +0.5 smoothing; the critical value is the (1 - alpha) quantile of the
same divergence between bootstrap resamples of the reference leaf distribution.

Everything is expressed on dyadic cell codes, so no tree object exists on the driver:
  * each row's cell code at full depth D comes from quantising every coordinate
    against the key's reference box (a column expression);
  * the split nodes are the (level, prefix) cells whose reference count exceeds
    ``max_count``: one aggregate over the (small) reference block;
  * the leaves are the children of split nodes that are not split themselves; they
    are disjoint code ranges, matched to rows by an equi-join on (key, coarse bucket)
    plus a range test inside the bucket.
Only non-empty test leaves enter the divergence, so its cost follows the data, not
blocks x leaves. The bootstrap runs per key on that key's leaf table (bounded by the
tree size) with numpy inside ``applyInPandas``. Where a tree serves only rows that a task
holds anyway (the walk that replaces references, a chunk of the sliding window), the same
cells and leaves are found there with numpy (``ReferenceTree``).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detect.chain import walk_blocks
from tidewatch.operators.history import full_blocks
from tidewatch.operators.position import BROADCAST_ROWS

COARSE_LEVELS = 8
SLIDING_ROWS = 100_000  # of a series in one grouped call
MAX_LEVELS = 60  # of a cell code in one 64-bit number


def levels(dims: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(level, axis, split index on that axis) for every level."""
    seen = [0] * dims
    out = []
    for lev in range(max_depth):
        ax = lev % dims
        out.append((lev, ax, seen[ax]))
        seen[ax] += 1
    return out


def splits_per_axis(dims: int, max_depth: int) -> list[int]:
    m = [0] * dims
    for _, ax, _ in levels(dims, max_depth):
        m[ax] += 1
    return m


def with_cell_code(df: DataFrame, xs: Sequence[str], max_depth: int, out: str = "_code") -> DataFrame:
    """Add the full-depth dyadic cell code of each row; needs columns _lo<i>, _hi<i>
    (the key's reference box). Quantised coordinates are materialised first so the
    code expression stays small (one bit term per level)."""
    d = len(xs)
    m = splits_per_axis(d, max_depth)
    for i, c in enumerate(xs):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        raw = F.floor((F.col(f"`{c}`").cast("double") - F.col(f"_lo{i}")) / span * F.lit(float(2 ** m[i])))
        qi = F.when(span <= 0, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(2 ** m[i] - 1)))
        df = df.withColumn(f"_q{i}", qi.cast("long"))
    terms = [f"shiftleft(shiftright(_q{ax}, {m[ax] - 1 - k}) & 1, {max_depth - 1 - lev})"
             for lev, ax, k in levels(d, max_depth)]
    return df.withColumn(out, F.expr(" | ".join(terms))).drop(*[f"_q{i}" for i in range(d)])


def _kl_rows(ref: np.ndarray, test: np.ndarray) -> np.ndarray:
    """KL with +0.5 smoothing for each row pair of two (samples x leaves) count matrices."""
    leaves = ref.shape[-1]
    pr = (ref + 0.5) / (ref.sum(axis=-1, keepdims=True) + leaves / 2.0)
    pt = (test + 0.5) / (test.sum(axis=-1, keepdims=True) + leaves / 2.0)
    return np.sum(pr * np.log(pr / pt), axis=-1)


def _threshold(counts: np.ndarray, window: int, boot: int, alpha: float, seed: int) -> float:
    p = counts / counts.sum()
    rng = np.random.default_rng(seed)
    a = rng.multinomial(window, p, size=boot).astype(float)
    b = rng.multinomial(window, p, size=boot).astype(float)
    return float(np.quantile(_kl_rows(a, b), 1 - alpha))


def bootstrap_thresholds(leaf_ref: DataFrame, keys: Sequence[str], window: int, boot: int, alpha: float,
                         seed: int) -> DataFrame:
    """(keys, threshold): (1-alpha) quantile of KL between two multinomial resamples of
    ``window`` rows from the key's reference leaf distribution."""
    keys = list(keys)
    key_types = dict(leaf_ref.dtypes)
    schema = ", ".join([f"`{k}` {key_types[k]}" for k in keys] + ["threshold double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: [pdf[k].iloc[0]] for k in keys}
        row["threshold"] = [_threshold(pdf["ref_count"].to_numpy(dtype=float), window, boot, alpha, seed)]
        return pd.DataFrame(row)

    return leaf_ref.groupBy(*keys).applyInPandas(fn, schema)


class ReferenceTree:
    """The tree of one reference block (rows x axes) for rows that are at hand in a task: the
    cells of ``with_cell_code`` and the leaves of ``_reference_tree``, in the order of their codes."""

    def __init__(self, x: np.ndarray, known: np.ndarray, max_count: int, depth: int):
        self.depth, self.box = depth, []
        for ax in range(x.shape[1]):
            v = x[known[:, ax], ax]
            self.box.append((v.min(), v.max()) if len(v) else (math.nan, math.nan))
        codes = np.sort(self.codes(x)).tolist()
        starts, counts, todo = [], [], [(0, 0, 0, len(codes))]
        while todo:
            level, cell, a, b = todo.pop()
            if level < depth and b - a > max_count:
                mid = bisect_left(codes, (2 * cell + 1) << (depth - level - 1), a, b)
                todo += [(level + 1, 2 * cell + 1, mid, b), (level + 1, 2 * cell, a, mid)]
            else:
                starts.append(cell << (depth - level))
                counts.append(b - a)
        self.starts, self.counts = np.array(starts, dtype=np.int64), np.array(counts, dtype=float)

    def codes(self, x: np.ndarray) -> np.ndarray:
        dims = x.shape[-1]
        m, q = splits_per_axis(dims, self.depth), []
        for ax, (lo, hi) in enumerate(self.box):
            top = 2 ** m[ax]
            if hi - lo <= 0:
                q.append(np.zeros(x.shape[:-1], dtype=np.int64))
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                raw = np.floor((x[..., ax] - lo) / (hi - lo) * float(top))
            raw = np.where(np.isnan(raw), 0.0, np.clip(raw, 0.0, float(top)))  # NULL and NaN: the first cell
            q.append(np.minimum(raw.astype(np.int64), top - 1))
        code = np.zeros(x.shape[:-1], dtype=np.int64)
        for lev, ax, k in levels(dims, self.depth):
            code |= ((q[ax] >> (m[ax] - 1 - k)) & 1) << (self.depth - 1 - lev)
        return code

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf of each row."""
        return np.searchsorted(self.starts, self.codes(x), side="right") - 1


def _reference_tree(rel: DataFrame, keys: list[str], xs: Sequence[str], max_count: int, depth: int,
                    few_keys: bool, carry: list[str]):
    """The tree of each key's reference rows (column ``_isref``): (rows, leaves). ``rows`` are the
    other rows, (keys, carry, _l, _p) with their leaf; ``leaves`` is (keys, _l, _p, ref_count, _pr,
    _nleaves), the smoothed reference share of every leaf, empty ones included."""
    coarse = min(COARSE_LEVELS, depth)
    box = (rel.filter("_isref").groupBy(*keys)
           .agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(f"_lo{i}") for i, c in enumerate(xs)],
                *[F.max(F.col(f"`{c}`").cast("double")).alias(f"_hi{i}") for i, c in enumerate(xs)]))
    boxb = F.broadcast(box) if few_keys else box
    coded = with_cell_code(rel.join(boxb, keys), xs, depth).select(*keys, *carry, "_isref", "_code")

    # split nodes from the reference block: cells at level l < depth holding > max_count rows
    ref = coded.filter("_isref")
    # reference counts of every prefix cell, levels 0..depth (the leaves' reference counts
    # are read from here, so the reference rows are never joined to the leaves)
    lv = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_l")
    pref = (ref.select(*keys, "_code", lv)
            .withColumn("_p", F.expr(f"shiftright(_code, {depth} - _l)"))
            .groupBy(*keys, "_l", "_p").agg(F.count(F.lit(1)).alias("_c"))).checkpoint(eager=True)
    # small tables (bounded by keys x tree size) are checkpointed: lineage and plans stay short
    split = (pref.filter((F.col("_c") > max_count) & (F.col("_l") < depth))
             .select(*keys, "_l", "_p").checkpoint(eager=True))

    # leaves: root if not split, else children of split nodes that are not split
    kids = split.select(*keys, (F.col("_l") + 1).alias("_l"),
                        F.explode(F.array(F.col("_p") * 2, F.col("_p") * 2 + 1)).alias("_p"))
    kids = kids.join(split, [*keys, "_l", "_p"], "left_anti")
    roots = box.select(*keys).join(split.filter(F.col("_l") == 0).select(*keys), keys, "left_anti").select(
        *keys, F.lit(0).alias("_l"), F.lit(0).cast("long").alias("_p"))
    leaves = kids.unionByName(roots)
    leaves = leaves.withColumn("_lo", F.expr(f"shiftleft(_p, {depth} - _l)")).withColumn(
        "_hi", F.expr(f"shiftleft(_p + 1, {depth} - _l)"))
    # coarse buckets: a deep leaf sits in one bucket, a shallow one spans several
    cb = F.expr(f"IF(_l >= {coarse}, array(shiftright(_p, _l - {coarse})), "
                f"sequence(shiftleft(_p, {coarse} - _l), shiftleft(_p + 1, {coarse} - _l) - 1))")
    leaves = leaves.checkpoint(eager=True)
    lb = leaves.withColumn("_b", F.explode(cb)).checkpoint(eager=True)
    nleaf = lb.count()
    lbr = lb.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_l").alias("_ll"),
                    F.col("_p").alias("_lp"), F.col("_b").alias("_lb"), "_lo", "_hi")
    lbj = F.broadcast(lbr) if nleaf <= BROADCAST_ROWS else lbr
    rows = coded.withColumn("_b", F.shiftright(F.col("_code"), depth - coarse))
    cond = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [
        F.col("_b") == F.col("_lb"), F.col("_code") >= F.col("_lo"), F.col("_code") < F.col("_hi")]
    assigned = rows.filter("not _isref").join(lbj, cond).select(*keys, *carry, F.col("_ll").alias("_l"),
                                                                F.col("_lp").alias("_p"))

    # reference distribution over all leaves (empty leaves included, +0.5 smoothing)
    ref_counts = pref.select(*keys, "_l", "_p", F.col("_c").alias("ref_count"))
    leaf_ref = leaves.select(*keys, "_l", "_p").join(ref_counts, [*keys, "_l", "_p"], "left").fillna(
        0, ["ref_count"])
    nl = leaf_ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nleaves"), F.sum("ref_count").alias("_nref"))
    pr = leaf_ref.join(nl, keys).withColumn(
        "_pr", (F.col("ref_count") + 0.5) / (F.col("_nref") + F.col("_nleaves") / 2.0)).drop("_nref").checkpoint(eager=True)
    return assigned, pr


def _reference_terms(pr: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _href, _nleaves): sum of p ln p over a key's leaves, and their number."""
    return pr.groupBy(*keys).agg(F.sum(F.col("_pr") * F.log(F.col("_pr"))).alias("_href"),
                                 F.max("_nleaves").alias("_nleaves"))


def _score_against(blk: DataFrame, refs: DataFrame, keys: list[str], xs: Sequence[str], window: int,
                   alpha: float, boot: int, max_count: int, depth: int, seed: int,
                   with_threshold: bool) -> DataFrame:
    """KL of every block after each key's reference block ``_ref`` (one tree per key)."""
    few = refs.count() <= BROADCAST_ROWS
    rel = (blk.join(F.broadcast(refs) if few else refs, keys).filter(F.col("block") >= F.col("_ref"))
           .withColumn("_isref", F.col("block") == F.col("_ref")))
    assigned, pr = _reference_tree(rel, keys, xs, max_count, depth, few, ["block", "_ref"])
    counts = assigned.groupBy(*keys, "block", "_ref", "_l", "_p").agg(F.count(F.lit(1)).alias("_n"))
    test = counts.join(pr.select(*keys, "_l", "_p", "_pr"), [*keys, "_l", "_p"])
    log_half = math.log(0.5)
    part = test.groupBy(*keys, "block", "_ref").agg(
        F.sum(F.col("_pr") * (F.log(F.col("_n") + 0.5) - F.lit(log_half))).alias("_s"),
        F.sum("_n").alias("_nt"))
    kl = (part.join(_reference_terms(pr, keys), keys)
          .withColumn("kl", F.col("_href") - (F.col("_s") + F.lit(log_half)
                                             - F.log(F.col("_nt") + F.col("_nleaves") / 2.0)))
          .select(*keys, "block", F.col("_ref").alias("ref_block"), "kl"))
    if not with_threshold:
        return kl
    # the checkpointed leaf table already holds the reference counts: no recomputation
    thr = bootstrap_thresholds(pr.select(*keys, "_l", "_p", "ref_count"), keys, window, boot, alpha, seed)
    return (kl.join(thr, keys, "left")
            .withColumn("drift", F.col("kl") > F.col("threshold"))
            .withColumn("state", F.when(F.col("drift"), "drift").otherwise("none")))


def kdq_tree(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], window: int = 1000,
             alpha: float = 0.05, boot: int = 500, max_count: int = 100, max_depth: int | None = None,
             seed: int = 1, with_threshold: bool = True, reset: bool = False) -> DataFrame:
    """Per (key, block) after the reference: KL divergence from the reference block,
    the bootstrap threshold and the drift flag. Only full blocks are compared.

    ``reset=True`` replaces the reference by the drifting block after each drift. That
    decision is sequential within a key (the next tree depends on it): each key's blocks
    are walked once, in chunks of bounded size (``chain.walk_blocks``).
    """
    keys = list(keys)
    depth = max_depth or MAX_LEVELS
    rows = df.select(*keys, *order, *[c for c in xs if c not in order])
    if not reset or not with_threshold:
        blk = full_blocks(rows, keys, order, window)
        refs = blk.select(*keys).distinct().withColumn("_ref", F.lit(0).cast("long"))
        return _score_against(blk, refs, keys, xs, window, alpha, boot, max_count, depth, seed, with_threshold)
    blk = full_blocks(rows, keys, order, window, values=xs)

    def fit(x, known, _):
        tree = ReferenceTree(x, known, max_count, depth)
        threshold, n = _threshold(tree.counts, window, boot, alpha, seed), len(tree.counts)

        def score(blocks, _):
            cell = tree.leaves(blocks) + n * np.arange(len(blocks))[:, None]
            kl = _kl_rows(tree.counts, np.bincount(cell.ravel(), minlength=n * len(blocks)).reshape(-1, n))
            return {"kl": kl, "threshold": np.full(len(kl), threshold), "_drift": kl > threshold}
        return score

    found = walk_blocks(blk, keys, xs, window, fit, "kl double, threshold double")
    blk.unpersist()
    return (found.withColumnRenamed("_drift", "drift")
            .withColumn("state", F.when(F.col("drift"), "drift").otherwise("none")))


def kdq_sliding(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], window: int = 1000,
                alpha: float = 0.05, boot: int = 500, max_count: int = 100, max_depth: int | None = None,
                seed: int = 1, persistence: float = 0.05, with_threshold: bool = True) -> DataFrame:
    """D4 record by record: the first ``window`` rows of a series are the reference, the last
    ``window`` rows (all after the reference) the test window, which slides by one row. One
    output row per record from position 2 * window on: (keys, order, pos, kl, threshold,
    exceeds, run, state); ``run`` counts the consecutive records above the threshold up to this
    one, ``state`` is 'drift' once it is more than ``persistence * window``. Series shorter than
    two windows have no output; the reference stays.

    A step of the window changes the counts of two leaves only, so the divergence is a running
    sum of differences: a row adds p (ln(c + 1.5) - ln(c + 0.5)) when it enters a leaf that
    holds c rows of the window, and takes the like away ``window`` rows later. Series are cut
    into chunks of ``SLIDING_ROWS`` rows; a chunk also gets the window before it and the
    reference rows, so each is scored in one grouped call and no task gets a whole series.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    from tidewatch.operators.position import with_position

    keys, depth = list(keys), max_depth or MAX_LEVELS
    extra = [c for c in order if c not in keys]
    cols = list(dict.fromkeys([*keys, *order, *xs]))
    types = dict(df.dtypes)
    long_enough = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * window)
                   .checkpoint(eager=True))
    sizes = long_enough.agg(F.count(F.lit(1)), F.max("_n")).first()
    few, size = sizes[0] <= BROADCAST_ROWS, max(SLIDING_ROWS, 4 * window)
    split = (sizes[1] or 0) > size
    rows = df.select(*cols).join(F.broadcast(long_enough) if few else long_enough, keys)
    rows = with_position(rows, keys, order, "_pos").select(
        *keys, *extra, "_pos", "_n", *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(xs)])
    home = F.expr(f"(_pos - 1) div {size}")
    if split:
        copies = F.array(home, F.when((F.col("_pos") % size > size - window) | (F.col("_pos") % size == 0), home + 1))
        copies = F.when(F.col("_pos") <= window, F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {size}"))).otherwise(copies)
        rows = rows.withColumn("_blk", F.explode(F.array_compact(copies)))
    else:
        rows = rows.withColumn("_blk", home)
    fields = [("_blk", "bigint", pa.int64()), ("pos", "bigint", pa.int64()), ("kl", "double", pa.float64())]
    if with_threshold:
        fields += [("threshold", "double", pa.float64()), ("exceeds", "boolean", pa.bool_()), ("_calm", "bigint", pa.int64())]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{n}` {t}" for n, t, _ in fields]
                       + [f"`{c}` {types[c]}" for c in extra])

    def fn(key: tuple, part: pa.Table) -> pa.Table:
        pos = part.column("_pos").to_numpy()
        order_of = np.argsort(pos)
        pos = pos[order_of]
        x = np.stack([part.column(f"_x{i}").to_numpy()[order_of] for i in range(len(xs))], axis=1)
        known = np.stack([part.column(f"_x{i}").is_valid().to_numpy()[order_of] for i in range(len(xs))], axis=1)
        tree = ReferenceTree(x[:window], known[:window], max_count, depth)
        pr = (tree.counts + 0.5) / (window + len(tree.counts) / 2.0)
        blk = part.column("_blk")[0].as_py()
        tested = pos[window:]
        kl = _sliding_divergence(tree.leaves(x[window:]), tested, pr, window)
        mine = np.nonzero((tested >= 2 * window) & ((tested - 1) // size == blk))[0]
        at, kl = tested[mine], kl[mine]
        found = [np.full(len(at), blk), at, kl]
        if with_threshold:
            threshold = _threshold(tree.counts, window, boot, alpha, seed)
            calm = np.maximum.accumulate(np.where(kl > threshold, 2 * window - 1, at)) if len(at) else at
            found += [np.full(len(at), threshold), kl > threshold, calm]
        columns = [pa.array([k.as_py()] * len(at), k.type) for k in key]
        columns += [pa.array(v, t) for v, (_, _, t) in zip(found, fields)]
        own = part.select(extra).take(pa.array(order_of[window + mine]))
        return pa.table(columns + own.columns, [*keys, *[n for n, _, _ in fields], *extra])

    out = rows.groupBy(*keys, "_blk").applyInArrow(lambda key, part: fn(key[:len(keys)], part), schema)
    if not with_threshold:
        return out.select(*keys, "pos", "kl", *extra)
    if split:  # the last calm record of the chunks before
        out = out.checkpoint(eager=True)
        before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        ends = out.groupBy(*keys, "_blk").agg(F.max("_calm").alias("_end"))
        ends = ends.select(*keys, "_blk", F.max("_end").over(before).alias("_end"))
        small = ends.count() <= BROADCAST_ROWS
        out = out.join(F.broadcast(ends) if small else ends, [*keys, "_blk"]).withColumn("_calm", F.greatest("_calm", "_end"))
    out = out.withColumn("run", F.col("pos") - F.col("_calm")).withColumn(
        "state", F.when(F.col("run") > persistence * window, "drift").otherwise("none"))
    return out.select(*keys, "pos", "kl", "threshold", "exceeds", "run", "state", *extra)


def _sliding_divergence(leaf: np.ndarray, pos: np.ndarray, pr: np.ndarray, window: int) -> np.ndarray:
    """KL of the last ``window`` rows at each of the rows at consecutive positions ``pos``, right
    from the ``window``-th on."""
    if not len(pos):
        return np.zeros(0)
    stride = int(pos[-1] - pos[0]) + 2 * window + 2
    at = leaf * stride + (pos - pos[0]) + window  # places of a leaf stay apart by more than a window
    order = np.argsort(at)
    place = np.empty(len(at), dtype=np.int64)
    place[order] = np.arange(len(at))
    at_sorted = at[order]
    # how many rows of the leaf are in the window before this one enters, and before it leaves
    before = place - np.searchsorted(at_sorted, at - (window - 1))
    after = np.searchsorted(at_sorted, at + window) - place
    p = pr[leaf]
    steps = p * (np.log(before + 1.5) - np.log(before + 0.5))
    steps[window:] += (p * (np.log(after - 0.5) - np.log(after + 0.5)))[:-window]
    return (pr * np.log(pr)).sum() - math.log(0.5) - np.cumsum(steps) + math.log(window + len(pr) / 2.0)
