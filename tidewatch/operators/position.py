"""Record positions and bounded row frames that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task.
When one key (or the whole un-keyed series) holds a large share of the table, that
task is the job. The helpers here avoid it:

* ``with_position`` numbers records 1..n within each key. Rows are range-partitioned
  on (key, order), so a hot key is spread over many tasks by Spark's sampled range
  bounds; each task numbers its slice locally, a tiny per-(slice, key) count table
  gives the offsets, and the offsets are joined back (broadcast only when the table
  was counted and found small, else a shuffle join on (slice, key), whose groups are
  bounded by one slice). Range bounds are re-sampled every time a range exchange
  runs, so the sliced rows are written once with a reliable ``checkpoint()`` (to the
  shared ``spark.checkpoint.dir``) and both the counts and the join read that copy;
  it also cuts the lineage, so a lost executor re-reads files instead of re-sampling.
* ``bounded_frames`` evaluates row-frame window expressions of at most ``n`` rows per
  key. If the largest key is small it is a normal keyed window. Otherwise each key is
  cut into position blocks, the last ``n-1`` rows of every block are copied into the
  next block as a halo, the window runs per (key, block), and halo rows are dropped.
  Every window group then holds at most ``block_rows + n - 1`` rows.

``order`` must make rows unique within a key (add a tie-breaker such as an id).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

# Largest count table we broadcast (rows); above it the join shuffles.
BROADCAST_ROWS = 200_000
# Default rows per window group when a key is split into blocks.
BLOCK_ROWS = 1_000_000

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + index


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  pos_col: str = "pos", num_slices: int | None = None, force_range: bool = False) -> DataFrame:
    """Add ``pos_col`` = 1-based record number within ``keys`` in ``order``.

    When there are keys and none holds more than ``BLOCK_ROWS`` rows (one cheap
    aggregate to find out) a keyed ``row_number`` is used: every window group is
    bounded. Otherwise (hot key, or one un-keyed series), or with ``force_range``, the
    range-sliced numbering below spreads the work over all tasks.
    """
    keys = list(keys)
    if keys and not force_range and num_slices is None and largest_group(df, keys) <= BLOCK_ROWS:
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        return df.withColumn(pos_col, F.row_number().over(w).cast("long"))
    n = num_slices or _shuffle_partitions(df)
    sort_cols = _cols(keys) + _cols(order)
    ranged = (df.repartitionByRange(n, *sort_cols)
              .sortWithinPartitions(*sort_cols)
              .withColumn("_slice", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_slice").cast("long"), _LOCAL_BITS)))
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    counts = (ranged.groupBy("_slice", *keys)
              .agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    out = (ranged.join(offsets, ["_slice", *keys])
           .withColumn(pos_col, F.col("_offset") + F.col("_local") - F.col("_first") + 1)
           .select(*[F.col(f"`{c}`") for c in df.columns], pos_col))
    return out


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """(largest group, total rows, number of groups) in one aggregate pass."""
    if not keys:
        n = df.count()
        return n, n, 1
    r = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2] or 0)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key group (0 for an empty table)."""
    return group_sizes(df, keys)[0]


# Groups below this size are never split (splitting costs a range shuffle + checkpoint).
MIN_SPLIT_ROWS = 10_000


def choose_block_rows(df: DataFrame, keys: Sequence[str], reach: int, block_rows: int = BLOCK_ROWS) -> int | None:
    """Block size for splitting series, or None to keep one window group per key.

    Split when a key exceeds ``block_rows`` (hot key), or when there are fewer keys than
    cores and a key is large, so that the work spreads over the cluster; blocks never get
    smaller than ``MIN_SPLIT_ROWS`` or 4x the frame reach (halo overhead <= 25 %).
    """
    biggest, total, groups = group_sizes(df, keys)
    par = df.sparkSession.sparkContext.defaultParallelism
    target = min(block_rows, max(MIN_SPLIT_ROWS, 4 * reach, total // max(1, 2 * par)))
    if biggest > block_rows or (groups < par and biggest > max(target, MIN_SPLIT_ROWS)):
        return target
    return None


def _framer(base: Window):
    def frame(lo: int | None = None, hi: int | None = None):
        return base if lo is None else base.rowsBetween(lo, hi)
    return frame


def bounded_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                   columns, pos_col: str | None = None, block_rows: int = BLOCK_ROWS,
                   force_blocks: bool = False) -> DataFrame:
    """Evaluate window expressions whose frames reach at most ``n-1`` rows back.

    ``columns(frame)`` returns ``{name: expression}``; ``frame(lo, hi)`` gives the
    window spec ``rowsBetween(lo, hi)`` (``lo >= -(n-1)``, ``hi <= 0``) for whichever
    partitioning is chosen, and ``frame()`` the unframed ordered spec (for ``lag``
    with offset < n). ``columns`` may also be a list of such stages applied in turn
    (a later stage may use earlier outputs); all stages share one window spec, so
    Spark sorts once, and ``n - 1`` must cover the summed reach of the stages.
    If ``pos_col`` is given the 1-based position is kept.
    """
    keys = list(keys)
    stages = columns if isinstance(columns, (list, tuple)) else [columns]
    if n < 1:
        raise ValueError("n must be >= 1")
    chosen = block_rows if force_blocks else choose_block_rows(df, keys, n, block_rows)
    if chosen is None:
        base = Window.partitionBy(*keys).orderBy(*_cols(order))
        out = df
        if pos_col:
            out = out.withColumn(pos_col, F.row_number().over(base).cast("long"))
        for st in stages:
            exprs = st(_framer(base))
            out = out.select("*", *[e.alias(k) for k, e in exprs.items()])
        return out

    block_rows = max(chosen, n - 1)
    p = pos_col or "_pos"
    pos = with_position(df, keys, order, p, force_range=force_blocks)
    halo = n - 1
    blk = F.floor((F.col(p) - 1) / block_rows)
    in_tail = ((F.col(p) - 1) % block_rows) >= (block_rows - halo) if halo > 0 else F.lit(False)
    copies = F.when(in_tail, F.array(blk, blk + 1)).otherwise(F.array(blk))
    out = (pos.withColumn("_home", blk)
           .withColumn("_blk", F.explode(copies)))
    base = Window.partitionBy(*keys, "_blk").orderBy(p)
    for st in stages:
        exprs = st(_framer(base))
        out = out.select("*", *[e.alias(k) for k, e in exprs.items()])
    out = out.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
    if not pos_col:
        out = out.drop(p)
    return out
