"""Block detectors whose reference is replaced by the drifting block after every drift.

Which block is the reference depends on all drifts before it, so a series is walked from
front to back. A key's blocks are handed to one call of ``applyInArrow`` for the walk; a
series of more than ``CHUNK_ROWS`` rows is walked in rounds of so many rows, all keys in
parallel, and the next round starts from the key's last result row (its reference block is
read again). Every row is read once, however many drifts there are, and a group holds no
more than a chunk and one reference block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

CHUNK_ROWS = 500_000
TASKS_A_CORE = 16  # few keys seldom meet in one of so many tasks
FIRST_REACH = 4  # blocks scored at once after a new reference; doubled while none drifts

# score(blocks, known): {column: one value per block}, with a boolean column "_drift"
Score = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]
# fit(reference block, known, carried columns of the last row or None): its score
Fit = Callable[[np.ndarray, np.ndarray, dict | None], Score]


def _walk(x: np.ndarray, known: np.ndarray, numbers: np.ndarray, carried: dict | None, fit: Fit) -> list[dict]:
    """Result columns of every block after the first one, which is the first reference."""
    parts, ref, at = [], 0, 1
    while at < len(x):
        score, reach, drifted = fit(x[ref], known[ref], carried), FIRST_REACH, False
        while at < len(x) and not drifted:
            found = score(x[at:at + reach], known[at:at + reach])
            drifted = bool(found["_drift"].any())
            n = int(found["_drift"].argmax()) + 1 if drifted else len(found["_drift"])
            parts.append({"block": numbers[at:at + n], "ref_block": np.full(n, numbers[ref]),
                          **{c: v[:n] for c, v in found.items()}})
            at, reach = at + n, 2 * reach
        ref, carried = at - 1, None
    return parts


def walk_blocks(blk: DataFrame, keys: Sequence[str], xs: Sequence[str], window: int, fit: Fit, out: str,
                carry: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """(keys, block, ref_block, columns of the DDL ``out``) of ``fit`` and its scores over
    ``blk``: full blocks of ``window`` rows, (keys, block, xs as doubles). ``carry`` names the
    columns of ``out`` that a reference's score needs when it goes on in the next round."""
    keys, xs, carry = list(keys), list(xs), list(carry)
    types = dict(blk.dtypes)
    fields = [c.strip().split(" ", 1) for c in f"block bigint, ref_block bigint, {out}, _drift boolean".split(",")]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} {t}" for n, t in fields])
    names = [n for n, _ in fields]
    of = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def fn(key: tuple, rows: pa.Table) -> pa.Table:
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        shape = (-1, window, len(xs))
        x = np.stack([rows.column(c).to_numpy()[order] for c in xs], axis=1).reshape(shape)
        known = np.stack([rows.column(c).is_valid().to_numpy()[order] for c in xs], axis=1).reshape(shape)
        held = {c: rows.column(f"_held_{c}")[int(order[0])].as_py() for c in carry}
        parts = _walk(x, known, block[order][::window], held if all(v is not None for v in held.values()) and held else None, fit)
        n = sum(len(p["block"]) for p in parts)
        columns = [pa.array([k.as_py()] * n, k.type) for k in key]
        columns += [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], of[t]) for c, t in fields]
        return pa.table(columns, [*keys, *names])

    spark = blk.sparkSession
    checkpoint_dir(spark)
    size = max(2, (chunk_rows or CHUNK_ROWS) // window)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    last = blk.agg(F.max("block")).first()[0] or 0
    none = [F.lit(None).cast("double").alias(f"_held_{c}") for c in carry]
    parts, before = [], None
    for r in range(last // size + 1):
        rows = blk.select(*keys, "block", *xs, *none)
        if last >= size:
            rows = rows.where((F.col("block") >= r * size) & (F.col("block") < (r + 1) * size))
        if before is not None:
            rows = rows.unionByName(blk.select(*keys, "block", *xs).join(before, [*keys, "block"]))
        # a fixed number: the rows are few bytes, but adaptive plans would put all keys' walks into one task
        part = rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(fn, schema).checkpoint(eager=True)
        parts.append(part)
        # keys that go on: their reference, and what its score has come to
        end = part.where(F.col("block") == (r + 1) * size - 1)
        before = end.select(*keys, F.when(F.col("_drift"), F.col("block")).otherwise(F.col("ref_block")).alias("block"),
                            *[F.when(~F.col("_drift"), F.col(c)).alias(f"_held_{c}") for c in carry])
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
