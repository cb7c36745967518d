"""Bounded row histories per series (P10, W1-W5) and blocked running scans.

All frames reach a fixed number of rows back, so they run through
``position.bounded_frames`` and stay bounded per task even for a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.position import BLOCK_ROWS, BROADCAST_ROWS, bounded_frames, largest_group, with_position


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                  prefix: str = "prev_") -> DataFrame:
    """P10: the previous record's ``cols`` of the same series (NULL for the first)."""
    return bounded_frames(df, keys, order, 2,
                          lambda fr: {f"{prefix}{c}": F.lag(F.col(c), 1).over(fr()) for c in cols})


def nulls_apart(df: DataFrame, x: str, detect) -> DataFrame:
    """``detect`` on the rows whose ``x`` is not NULL, and the other rows with NULL in the
    columns that it adds: NULLs take no place in a history and no row is lost."""
    if not df.schema[x].nullable:
        return detect(df)
    out = detect(df.filter(F.col(f"`{x}`").isNotNull()))
    added = [F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in df.columns]
    rest = df.filter(F.col(f"`{x}`").isNull()).select("*", *added)
    return out.unionByName(rest.select(*[F.col(f"`{c}`") for c in out.columns]))


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int,
           out: str = "history", full_only: bool = True) -> DataFrame:
    """The last ``n`` non-NULL values including the current one, oldest first; with
    ``full_only`` only rows that already have ``n`` values are kept (and NULL rows, with a
    NULL history)."""
    def detect(rows: DataFrame) -> DataFrame:
        res = bounded_frames(rows, keys, order, n,
                             lambda fr: {out: F.collect_list(F.col(x)).over(fr(-(n - 1), 0))})
        return res.filter(F.size(out) == n) if full_only else res

    return nulls_apart(df, x, detect)


def rolling_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int = 10) -> DataFrame:
    """Mean of the last ``n`` values and |current - mean|."""
    res = bounded_frames(df, keys, order, n, lambda fr: {
        "rolling_mean": F.avg(F.col(x)).over(fr(-(n - 1), 0)),
        "_cnt": F.count(F.lit(1)).over(fr(-(n - 1), 0))})
    return (res.withColumn("shift", F.abs(F.col(x) - F.col("rolling_mean")))
            .withColumn("full", F.col("_cnt") == n).drop("_cnt"))


def rolling_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, n: int = 10,
                out: str = "rolling_max") -> DataFrame:
    """Maximum of the last ``n`` scores."""
    return bounded_frames(df, keys, order, n, lambda fr: {out: F.max(F.col(score)).over(fr(-(n - 1), 0))})


def half_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, window: int = 200,
                 stat: int = 100, full_only: bool = True) -> DataFrame:
    """Of the last ``window`` non-NULL values, the older ``window-stat`` and the newest
    ``stat`` (NULL rows are kept with NULL halves)."""
    def detect(rows: DataFrame) -> DataFrame:
        res = bounded_frames(rows, keys, order, window, lambda fr: {
            "older": F.collect_list(F.col(x)).over(fr(-(window - 1), -stat)),
            "recent": F.collect_list(F.col(x)).over(fr(-(stat - 1), 0))})
        if full_only:
            res = res.filter((F.size("older") == window - stat) & (F.size("recent") == stat))
        return res

    return nulls_apart(df, x, detect)


def count_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                 pos_col: str = "pos", block_col: str = "block") -> DataFrame:
    """Consecutive blocks of ``n`` records per series: block = floor((pos-1)/n)."""
    pos = with_position(df, keys, order, pos_col)
    return pos.withColumn(block_col, F.floor((F.col(pos_col) - 1) / n))


def block_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
               block_col: str = "block") -> DataFrame:
    """The last row of every block of ``n`` records: gives a detector's blocks their time."""
    blk = count_blocks(df, keys, order, n, "_bpos", block_col)
    last = F.max(F.struct("_bpos", *[F.col(f"`{c}`") for c in df.columns if c not in keys])).alias("_r")
    return (blk.groupBy(*keys, block_col).agg(last)
            .select(*keys, block_col, *[F.col(f"_r.`{c}`").alias(c) for c in df.columns if c not in keys]))


def full_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                block_col: str = "block", values: Sequence[str] | None = None) -> DataFrame:
    """W5 restricted to complete blocks of exactly ``n`` records (the trailing partial
    block of each series is left out). Block completeness comes from the per-key row
    count (a partial aggregate, no sort), joined back; the numbered rows are persisted
    because detectors read them several times, with ``values`` only the keys, the block and
    these columns as doubles."""
    from pyspark import StorageLevel
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if keys else None
    blk = count_blocks(df, keys, order, n, "_bpos", block_col)
    if keys:
        small = sizes.count() <= BROADCAST_ROWS
        blk = blk.join(F.broadcast(sizes) if small else sizes, keys)
    else:
        blk = blk.withColumn("_rows", F.lit(df.count()))
    blk = blk.filter(F.col(block_col) < F.floor(F.col("_rows") / n)).drop("_rows", "_bpos")
    if values is not None:
        blk = blk.select(*keys, block_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return blk.persist(StorageLevel.MEMORY_AND_DISK)


# --- running (unbounded-preceding) scans ---------------------------------------------

_OPS = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: dict[str, tuple[str, Column]],
            block_rows: int = BLOCK_ROWS, force_blocks: bool = False, blocks: bool | None = None) -> DataFrame:
    """Running aggregates from the first row of the series to the current row.

    ``exprs``: ``{out: (op, column)}`` with op in sum/min/max. A small series uses one
    keyed window. A large one is numbered (hot-key-safe), cut into blocks, and
    scanned in two levels: per-block totals, an exclusive prefix over the (few) blocks
    of a key, joined back to the within-block running value. ``blocks`` lets a caller
    that already knows the group sizes skip the check.
    """
    keys = list(keys)
    split = force_blocks or (blocks if blocks is not None else largest_group(df, keys) > block_rows)
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[_OPS[op](c).over(w).alias(k) for k, (op, c) in exprs.items()])
    pos = with_position(df, keys, order, "_rpos").withColumn("_rblk", F.floor((F.col("_rpos") - 1) / block_rows))
    vals = pos.select("*", *[c.alias(f"_v_{k}") for k, (op, c) in exprs.items()])
    tot = vals.groupBy(*keys, "_rblk").agg(*[_OPS[op](f"_v_{k}").alias(f"_t_{k}") for k, (op, _) in exprs.items()])
    wb = Window.partitionBy(*keys).orderBy("_rblk").rowsBetween(Window.unboundedPreceding, -1)
    pre = tot.select(*keys, "_rblk", *[_OPS[op](f"_t_{k}").over(wb).alias(f"_p_{k}") for k, (op, _) in exprs.items()])
    wi = Window.partitionBy(*keys, "_rblk").orderBy("_rpos").rowsBetween(Window.unboundedPreceding, 0)
    inner = vals.select("*", *[_OPS[op](f"_v_{k}").over(wi).alias(f"_i_{k}") for k, (op, _) in exprs.items()])
    out = inner.join(pre, [*keys, "_rblk"])
    for k, (op, _) in exprs.items():
        p, i = F.col(f"_p_{k}"), F.col(f"_i_{k}")
        out = out.withColumn(k, F.when(p.isNull(), i).otherwise(_COMBINE[op](p, i)))
    drop = ["_rpos", "_rblk"] + [f"_{t}_{k}" for k in exprs for t in ("v", "p", "i")]
    return out.drop(*drop)
