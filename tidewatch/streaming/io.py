"""Structured Streaming sources and sinks.

Every query gets a checkpoint location under the shared checkpoint folder, so a
restarted query resumes where it stopped. Tests drive streams over file sources with
``availableNow``; the Kafka path is a set of options built by pure functions (the
connector jar is not part of this environment).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewatch.session import checkpoint_dir
from tidewatch.sources import paths


def kafka_source_options(servers: str, topic: str, starting: str = "earliest",
                         max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Options for a replayable Kafka read (from the beginning on a fresh run)."""
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    return opts


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    """S3: options for publishing (key, value) records to a Kafka topic."""
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def file_source_path(spark: SparkSession, path: str) -> str:
    """A single file is streamed through a glob on its last character (a file stream
    needs a directory or a pattern)."""
    if not any(c in path for c in "*?[{") and paths.is_file(spark, path):
        return f"{path[:-1]}[{path[-1]}]"
    return path


def read_stream(spark: SparkSession, fmt: str, path_or_topic: str, schema: StructType | str | None = None,
                max_per_trigger: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """S1 (+ S13 rate limit): a streaming DataFrame from files or Kafka."""
    r = spark.readStream.format(fmt)
    if fmt == "kafka":
        opts = dict(options or {})
        if max_per_trigger:
            opts["maxOffsetsPerTrigger"] = str(max_per_trigger)
        return r.options(**opts).option("subscribe", path_or_topic).load()
    if schema is not None:
        r = r.schema(schema)
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_per_trigger))
    return r.options(**(options or {})).load(file_source_path(spark, path_or_topic))


def stream_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name)


def new_run(spark: SparkSession, name: str) -> str:
    """A fresh folder (sink + checkpoint) for one run of a named stream."""
    return stream_folder(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_stream(df: DataFrame, fmt: str, target: str, checkpoint: str, mode: str = "append",
                 available_now: bool = True, options: dict[str, str] | None = None,
                 query_name: str | None = None) -> StreamingQuery:
    """S3/T4: start a checkpointed streaming write (file formats, kafka or memory)."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    if options:
        w = w.options(**options)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start() if fmt in ("kafka", "memory", "console") else w.start(target)


def write_complete(df: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Complete-mode result table: each trigger re-emits the whole aggregate, and
    ``foreachBatch`` overwrites the Parquet table with it."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    w = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def write_batches(df: DataFrame, target: str, checkpoint: str, mode: str = "append",
                  fn: Callable[[DataFrame, int], DataFrame] | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch (optionally transformed) to a Parquet table, in a folder
    of its own (partition column ``epoch``): a micro-batch that is run again after a
    failure replaces its rows instead of repeating them."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        out = fn(batch, epoch_id) if fn else batch
        out.write.mode("overwrite").parquet(f"{target}/epoch={epoch_id}")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def await_all(queries: Sequence[StreamingQuery], timeout_s: int | None = None) -> None:
    """T5: wait for every query (each started on its own). A failed query raises, and so
    does one that is still running after ``timeout_s`` seconds (default: wait as long as
    it takes): its sink must not be read as if it were complete."""
    for q in queries:
        ended = q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        if ended is False:
            raise TimeoutError(f"stream {q.name or q.id} has not ended after {timeout_s} s")


# A micro-batch is one file: small row groups let many tasks share it.
ROW_GROUP_BYTES = 8 << 20


def _one_file(rows: DataFrame, path: str) -> None:
    """Add ``rows`` to a folder as one Parquet file; they are read and filtered by all tasks."""
    rows.repartition(1).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def staged_copy(spark: SparkSession, src: DataFrame, name: str, time_col: str, n_files: int) -> str:
    """Write ``src`` to a new folder as ``n_files`` Parquet files in time order, one job per
    time range so file ages follow event time (a file stream reads oldest first). Rows
    without a time go to the first file."""
    path = new_run(spark, f"source-{name}-{n_files}")
    t = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    bounds = src.select(F.min(t), F.max(t)).first()
    lo, hi = float(bounds[0] or 0), float(bounds[1] or 0)
    step = (hi - lo) / n_files
    for i in range(n_files):
        a = lo + i * step
        cond = F.lit(True) if i == 0 else (t > F.lit(a))
        if i < n_files - 1:
            cond = cond & (t <= F.lit(a + step))
        if i == 0:
            cond = cond | t.isNull()
        _one_file(src.filter(cond), path)
    return path


def displaced_copy(spark: SparkSession, src: DataFrame, name: str, time_col: str, id_col: str, n_files: int) -> tuple[str, str]:
    """A source whose rows arrive out of order: (folder, delay). Time is cut into ``n_files``
    ranges; half of a range's rows (by a hash of the id) are in its own file, the others in the
    next one, so no row is later than ``delay``, one range. The last file ends with a heartbeat,
    a row with nothing but a time, more than ``delay`` after all others."""
    path = new_run(spark, f"source-{name}-displaced")
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    lo, hi = src.select(F.min(t), F.max(t)).first()
    step = ((hi or 0) - (lo or 0)) // n_files + 1
    arrives = F.floor((t - F.lit(lo or 0)) / F.lit(step)) + F.pmod(F.xxhash64(id_col), F.lit(2))
    placed = src.withColumn("__file", F.coalesce(arrives, F.lit(0)))
    for i in range(n_files + 1):
        _one_file(placed.where(F.col("__file") == i).drop("__file"), path)
    types = dict(src.dtypes)
    end = F.timestamp_micros(F.lit((hi or 0) + step + 10_000_000)).cast(types[time_col])
    spark.range(1).select(*[(end if c == time_col else F.lit(None).cast(types[c])).alias(c) for c in src.columns]).coalesce(
        1).write.mode("append").parquet(path)
    return path, f"{step // 1000 + 1} milliseconds"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB (state that outgrows the
    heap, lists and timers); others of the session are left as they are."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def upsert_stream(df: DataFrame, keys: Sequence[str], version_col: str, target: str, checkpoint: str,
                  partition_col: str, available_now: bool = True) -> StreamingQuery:
    """S9 over a stream: last write (largest ``version_col``) per key wins in a Parquet
    table partitioned by ``partition_col`` (a coarse function of the key, e.g. the day).

    Each micro-batch is reduced to its latest row per key, merged with only the target
    partitions it touches, checkpointed (so the plan no longer reads the target) and
    written with dynamic partition overwrite; untouched partitions are never rewritten.
    Re-running an epoch after a failure rewrites the same partitions with the same rows.
    """
    from tidewatch.sources.points import upsert_latest
    keys = list(keys)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        latest = upsert_latest(batch, keys, version_col)
        if paths.has_children(spark, target, f"{partition_col}="):
            # only the partitions that this batch touches (a join on the partition column prunes the scan)
            touched = latest.select(partition_col).distinct()
            old = spark.read.parquet(target).join(touched, partition_col, "left_semi")
            latest = upsert_latest(old.unionByName(latest), keys, version_col)
        merged = latest.checkpoint(eager=True)
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition_col).parquet(target))

    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
