"""Sequential reset semantics without a sequential scan.

KSWIN (D3) forgets its older half after an alarm: the window keeps the newest ``stat``
values and is only tested again once it is full, ``gap = window - stat`` records later,
and from then on it is the ordinary sliding window again. So an alarm at t is real iff
the plain (no-reset) test fires at t and no real alarm lies in (t - gap, t): a greedy
chain over the candidate positions, each link the first candidate at least ``gap``
after the previous one.

The chain is found by pointer doubling, all as joins on (key, position):
  next(c) = first candidate at or after c + gap (a reverse running min, hot-key safe),
  J_0 = next, J_{i+1} = J_i o J_i, S_0 = {first candidate per key},
  S_{i+1} = S_i u J_i(S_i)   (S_i holds the first 2^i links of every chain).
O(log(chain length)) rounds, bounded before starting, each a join on tables no larger
than the candidate set; every round is checkpointed to cut lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.history import running
from tidewatch.session import checkpoint_dir


def greedy_gap_chain(series: DataFrame, keys: Sequence[str], pos_col: str, cand_col: str, gap: int) -> DataFrame:
    """(keys, pos) of the greedy chain of candidates with consecutive links >= ``gap`` apart.

    ``series`` holds every testable position (contiguous per key) with a boolean
    ``cand_col``. S_i holds exactly the first 2^i links, and J_i(S_i) the next 2^i, so
    the union needs no de-duplication; the number of rounds is bounded up front by the
    longest possible chain (positions per key / gap), so no round needs a count.
    """
    import math
    keys = list(keys)
    checkpoint_dir(series.sparkSession)
    nc = running(series.select(*keys, pos_col, cand_col), keys, [F.col(pos_col).desc()],
                 {"_nc": ("min", F.when(F.col(cand_col), F.col(pos_col)))})
    lookup = nc.select(*keys, (F.col(pos_col) - gap).alias("_c"), F.col("_nc").alias("_nxt"))
    cands = series.filter(F.col(cand_col)).select(*keys, F.col(pos_col).alias("_c"))
    jump = cands.join(lookup, [*keys, "_c"], "left").checkpoint(eager=True)
    chain = cands.groupBy(*keys).agg(F.min("_c").alias("_c")).checkpoint(eager=True)
    span = jump.groupBy(*keys).agg((F.max("_c") - F.min("_c")).alias("_s")).agg(F.max("_s")).first()[0] or 0
    rounds = max(0, math.ceil(math.log2(span // gap + 1))) + 1
    for i in range(rounds):
        step = chain.join(jump, [*keys, "_c"]).filter(F.col("_nxt").isNotNull()).select(
            *keys, F.col("_nxt").alias("_c"))
        chain = chain.unionByName(step).checkpoint(eager=True)
        if i == rounds - 1:
            break
        a, b = jump.alias("a"), jump.alias("b")
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._nxt") == F.col("b._c")]
        jump = (a.join(b, cond, "left")
                .select(*[F.col(f"a.{k}") for k in keys], F.col("a._c"), F.col("b._nxt").alias("_nxt"))
                .checkpoint(eager=True))
    return chain.withColumnRenamed("_c", pos_col)


def apply_reset(tested: DataFrame, keys: Sequence[str], pos_col: str, gap: int,
                cand_col: str = "alarm") -> DataFrame:
    """Turn no-reset test results into reset semantics: keep rows still tested after
    earlier real alarms (none in the previous ``gap - 1`` rows) and flag real alarms."""
    keys = list(keys)
    # the no-reset test results are read four times below: materialise them once
    checkpoint_dir(tested.sparkSession)
    tested = tested.checkpoint(eager=True)
    chain = greedy_gap_chain(tested, keys, pos_col, cand_col, gap).withColumn("_real", F.lit(True))
    marked = tested.join(chain, [*keys, pos_col], "left").withColumn("_real", F.coalesce("_real", F.lit(False)))
    last = running(marked, keys, [pos_col], {"_last": ("max", F.when(F.col("_real"), F.col(pos_col)))})
    prev = F.col("_last")
    # _last includes the row itself; a real alarm at this row is fine, an earlier one
    # within gap-1 rows means the detector was still refilling.
    blocked = (~F.col("_real")) & prev.isNotNull() & (F.col(pos_col) - prev < gap)
    return (last.filter(~blocked)
            .withColumn(cand_col, F.col("_real")).drop("_real", "_last"))


def kswin_reset(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, window: int = 200,
                stat: int = 100, alpha: float = 1e-4, warmup: int = 0, min_stat: float = 0.1) -> DataFrame:
    """D3 with the reference's reset: alarm rows and the rows still tested around them."""
    from tidewatch.operators.detect.univariate import kswin_of_values
    from tidewatch.operators.history import nulls_apart
    if window != 2 * stat:
        raise ValueError("exact test implemented for window = 2 * stat")

    def detect(rows: DataFrame) -> DataFrame:
        tested = kswin_of_values(rows, keys, order, x, window, stat, alpha, warmup, min_stat, pos_col="_kpos")
        return apply_reset(tested, keys, "_kpos", window - stat).drop("_kpos")

    return nulls_apart(df, x, detect)
