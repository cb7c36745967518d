"""Importance resampling towards a target distribution.

Words of a text are hashed with their runs of up to three words into ``BUCKETS`` buckets; the
gain of a bucket is a log ratio of its smoothed shares in the target and in the corpus. A
text's weight is the sum of the gains of its features, looked up in one array. Gumbel noise
from a hash of the id turns "the highest scores" into a draw without replacement.

The ranking is a distributed least-significant-digit radix sort: rows stand in blocks, every
pass counts one digit of the composite key (falling score, rising doc_id, rising n_features)
per block, prefix sums over (digit, block) give each run its first destination, and the rows
move there in their order. The last destinations are the ranks.

Rules for special rows: a null text has no words; a null doc_id hashes as an empty id and
sorts after all others; repeated rows are rows of their own, so equal keys take consecutive
ranks in no stated order (only rows of one doc_id and one n_features can be equal); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, read

BUCKETS = 10_000
RUNS = 3                   # longest feature in words
LEAST_WORDS = 20           # shorter texts are not drawn
SHARE = 5                  # per cent of the others are drawn
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 10       # rows of a sort block: at least so many, and ...
MOST_BLOCKS = 1 << 12      # ... more when the blocks would be more than these, up to ...
LONGEST_BLOCK = 1 << 20    # ... so many rows
TEXTS = "doc_id {id}, n_words long, n_features long, weight long"


def buckets_of(text: str | None):
    """(words, bucket of every feature) of a text."""
    import zlib

    import numpy as np

    if not text:
        return 0, np.zeros(0, dtype=np.int64)
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    spaced = [b" " + w for w in words]
    crcs = [list(map(zlib.crc32, words))]
    for n in range(1, RUNS):  # a run's checksum goes on from that of the run without its last word
        crcs.append(list(map(zlib.crc32, spaced[n:], crcs[-1])))
    return len(words), np.concatenate([np.array(run, dtype=np.int64) for run in crcs]) % BUCKETS


def bucket_counts(texts: DataFrame, text_col: str = "text"):
    """Features of all texts in each bucket, as an array (one row per task and bucket is shuffled)."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(buckets_of(t.as_py())[1], minlength=BUCKETS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = (texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most BUCKETS rows
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def gains(corpus, target):
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    import math

    import numpy as np

    S, T = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighted(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        import pyarrow as pa

        gain = shipped.value
        for b in batches:
            rows = []
            for t in b.column(1):
                words, at = buckets_of(t.as_py())
                rows.append((words, len(at), int(gain[at].sum())))
            words, features, weight = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(
        run, TEXTS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def noise(seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]], block_rows: int | None = None) -> DataFrame:
    """``rows`` (a written table) with ``rank``, 1 for the first by the long columns ``keys``
    (name, falling), nulls last, by stable counting passes from the least significant digit on.

    Every pass shuffles the rows once, by (block, digit). A group has at most a block's rows,
    the prefix sums run over at most 2048 digits and, digit by digit, over the blocks.
    """
    facts = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}{i}") for i, (k, _) in enumerate(keys)
                                               for f in (F.min, F.max, F.count)]).first()
    size = block_rows or min(max(BLOCK_ROWS, facts.n // MOST_BLOCKS), LONGEST_BLOCK)
    digits = []
    for i, (k, falling) in reversed(list(enumerate(keys))):
        low, high = facts[f"min{i}"] or 0, facts[f"max{i}"] or 0
        if high - low < 1 << 62:
            steps, bits = (F.lit(high) - F.col(k) if falling else F.col(k) - F.lit(low)), (high - low).bit_length()
        else:  # the order of the bits themselves, the sign turned round
            turned = F.lit((1 << 63) - 1 if falling else -(1 << 63))
            steps, bits = F.col(k).bitwiseXOR(turned), 64
        for shift in range(0, bits, DIGIT_BITS):
            digits.append(F.coalesce(F.shiftrightunsigned(steps, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)), F.lit(0)))
        if facts[f"count{i}"] < facts.n:
            digits.append(F.col(k).isNull().cast("long"))
    # the first blocks take the rows as they were written
    blocks = max(1, -(-facts.n // size))
    placed = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn(
        "__block", F.pmod(F.xxhash64("__at"), F.lit(blocks)))
    for digit in digits or [F.lit(0)]:
        placed = cut(counting_pass(placed, digit, size))
    return placed.select(*rows.columns, (F.col("__at") + 1).alias("rank"))


def counting_pass(rows: DataFrame, digit, block_rows: int) -> DataFrame:
    """One stable counting pass: new ``__at`` (place from 0) and ``__block`` of every row."""
    rows = rows.withColumn("__digit", digit.cast("int"))
    counts = rows.groupBy("__block", "__digit").agg(F.count("*").alias("__n"))
    totals = counts.groupBy("__digit").agg(F.sum("__n").alias("__n"))  # at most 2048 rows
    before = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__digit").alias("__d"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("__earlier", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
               .join(F.broadcast(starts), F.col("__digit") == F.col("__d"))
               .select(F.col("__block").alias("__b"), "__d", (F.col("__start") + F.col("__earlier")).alias("__first")))
    within = Window.partitionBy("__block", "__digit").orderBy("__at")
    placed = rows.withColumn("__within", F.row_number().over(within) - 1).join(
        offsets, (F.col("__block") == F.col("__b")) & (F.col("__digit") == F.col("__d")))
    kept = [c for c in rows.columns if c not in ("__at", "__block", "__digit")]
    return placed.select(*kept, (F.col("__first") + F.col("__within")).alias("__at")).withColumn(
        "__block", F.expr(f"__at div {block_rows}"))


def resample(docs: DataFrame, target: DataFrame, seed: int = 42, share: int = SHARE,
             least_words: int = LEAST_WORDS, text_col: str = "text", block_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score and rank; the rank counts
    from 1 in the order of falling score and is null for rows that are not drawn. Drawn are
    ``share`` per cent of the rows of at least ``least_words`` words."""
    scored = cut(weighted(docs, target, text_col).withColumn("score", F.col("weight") + noise(seed)))
    able = scored.where(F.col("n_words") >= least_words)
    ranked = radix_ranked(able, [("score", True), ("doc_id", False), ("n_features", False)], block_rows)
    drawn = share * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .union(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long"))))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
