"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source gets a whole number of slots W of each period of P slots (its target weight
is W / P). Its i-th block (from 0) is released at slot floor(i P / W) and must be served
before slot ceil((i + 1) P / W). Earliest deadline first over the released blocks meets
all deadlines, so after any number of slots each source has been served its target share
to within less than one block. The schedule repeats after P slots, so one period is
computed (a fold over its slots) and every block is placed by arithmetic. The slots of a
source that has run out stay empty; no row is dropped or repeated.

Rules for special rows: a null source counts as the source ''; within a source rows are
taken in the order of md5(doc_id), then doc_id and the other columns, a null doc_id as '';
identical rows are interchangeable; an empty table gives an empty result; the text is
never read. More sources than ``period`` get one slot each, which makes the period longer.

Given weights are met exactly where they have a common period of at most ``LONGEST_PERIOD``
slots (any weights in ten-thousandths do); others are rounded to that period by largest
remainders, so a share is off by less than one slot of it. Sources that no weight names, or
with weight 0, get one slot of a period beside it, so that their rows are not lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read

BLOCK_ROWS = 16
PERIOD = 1000
LONGEST_PERIOD = 20_000   # slots of a period of given weights
RUN_ROWS = 4096           # rows that are numbered together
BROADCAST_SOURCES = 10_000


def whole_slots(weights: dict[str, float]) -> dict[str, int]:
    """Slots of each source of positive weight, in the ratio of the weights (see the module)."""
    from fractions import Fraction
    from math import gcd, lcm

    shares = {name: Fraction(str(w)) for name, w in weights.items() if w > 0}
    if not shares:
        return {}
    unit = lcm(*(f.denominator for f in shares.values()))
    slots = {name: int(f * unit) for name, f in shares.items()}
    common = gcd(*slots.values())
    slots = {name: w // common for name, w in slots.items()}
    total = sum(slots.values())
    if total <= LONGEST_PERIOD:
        return slots
    floors = {name: w * LONGEST_PERIOD // total for name, w in slots.items()}
    by_rest = sorted(slots, key=lambda name: (-(slots[name] * LONGEST_PERIOD % total), name))
    for name in by_rest[:LONGEST_PERIOD - sum(floors.values())]:
        floors[name] += 1
    return floors


def source_slots(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """One row per source: src, n (rows), w (slots in a period), p (period), idx (from 1, by
    name). Without ``weights`` a source's target is the square root of its row count, in
    slots of ``period``; with them, sources that are not named get one slot."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        total = n.agg(F.sum(F.sqrt("n")).alias("total"))
        want = F.floor(F.lit(period) * F.sqrt("n") / F.col("total"))
        slots = n.join(F.broadcast(total))  # the total is one row
    else:
        pairs = [F.lit(x) for pair in whole_slots(weights).items() for x in pair]
        want = F.create_map(*pairs)[F.col("src")] if pairs else F.lit(None)
        slots = n
    slots = slots.withColumn("w", F.greatest(F.lit(1), F.coalesce(want.cast("long"), F.lit(1))).cast("long"))
    listed = slots.agg(F.array_sort(F.collect_list(F.struct("src", "n", "w"))).alias("all"))
    return (listed.withColumn("p", F.aggregate("all", F.lit(0).cast("long"), lambda a, s: a + s["w"]))
            .select("p", F.posexplode("all").alias("at", "s"))
            .select("s.src", "s.n", "s.w", "p", (F.col("at") + 1).alias("idx")))


def one_period(slots: DataFrame) -> DataFrame:
    """(src, n, w, p, slots): the slots of each source in one period, ascending, by earliest
    deadline first. The state of the fold is the number of blocks served of each source."""
    one = slots.agg(F.array_sort(F.collect_list(F.struct("idx", "w", "src", "n"))).alias("all"),
                    F.max("p").alias("p")).where("p is not null")

    def serve(state, t):
        due = F.zip_with(F.col("all"), state["done"], lambda s, k: F.when(
            F.floor(k * F.col("p") / s["w"]) <= t,
            F.struct(F.ceil((k + 1) * F.col("p") / s["w"]).alias("deadline"), s["idx"].cast("long").alias("idx"))))
        pick = F.array_min(F.filter(due, lambda x: x.isNotNull()))["idx"]
        return F.struct(F.transform(state["done"], lambda k, i: k + F.when(i + 1 == pick, 1).otherwise(0).cast("long"))
                        .alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(F.transform("all", lambda s: F.lit(0).cast("long")).alias("done"),
                     F.array().cast("array<bigint>").alias("picks"))
    picks = one.select("all", "p", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), start, serve)["picks"]
                       .alias("picks"))
    by_slot = picks.select("all", "p", F.posexplode("picks").alias("slot", "idx"))
    mine = by_slot.groupBy("idx", "p", F.element_at("all", F.col("idx").cast("int")).alias("s")).agg(
        F.array_sort(F.collect_list("slot")).alias("slots"))
    return mine.select("s.src", "s.n", "s.w", "p", "slots")


def numbered(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``docs`` with the columns of its source and ``__at``, its place within the source from
    0. A source's rows are numbered in runs of about RUN_ROWS by the leading digits of the
    hash that orders them, so that no task gets a whole source."""
    side = F.broadcast(sources) if few else sources
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    runs = F.ceil(F.col("n") / RUN_ROWS)
    d = (docs.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("__md5", digest).join(side, "src")
         .withColumn("__run", F.floor(F.conv(F.substring("__md5", 1, 8), 16, 10).cast("double") * runs / 4294967296.0)))
    sizes = d.groupBy("src", "__run").agg(F.count("*").alias("__size"))
    before = sizes.selectExpr("src", "__run", "coalesce(sum(__size) over (partition by src order by __run "
                              "rows between unbounded preceding and 1 preceding), 0) as __before")
    order = [F.col("__md5"), F.col("doc_id"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]]
    from pyspark.sql import Window
    own = d.withColumn("__row", F.row_number().over(Window.partitionBy("src", "__run").orderBy(*order)))
    return own.join(before, ["src", "__run"]).withColumn("__at", F.col("__before") + F.col("__row") - 1)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS,
        period: int = PERIOD) -> DataFrame:
    """The rows of ``docs`` (needs doc_id and source) with block (number within the source),
    release, deadline, slot and in_block; sorted by (slot, in_block) they are the mixture.
    Columns of ``docs`` with one of those names are replaced."""
    own = {"block", "release", "deadline", "slot", "in_block", "src", "n", "w", "p", "slots"}
    kept = [c for c in docs.columns if c not in own]
    plan = one_period(source_slots(docs, weights, period))
    few = docs.select(F.coalesce("source", F.lit("")).alias("s")).distinct().limit(
        BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    block = F.floor(F.col("__at") / block_rows)
    return (numbered(docs.select(*kept), plan, few).withColumn("block", block).select(
        *kept, "block", F.floor(F.col("block") * F.col("p") / F.col("w")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("p") / F.col("w")).alias("deadline"),
        (F.floor(F.col("block") / F.col("w")) * F.col("p")
         + F.element_at("slots", (F.col("block") % F.col("w") + 1).cast("int"))).alias("slot"),
        (F.col("__at") % block_rows).cast("int").alias("in_block")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")).select(
        "doc_id", "source", "block", "release", "deadline", "slot", "in_block")


ORACLE_SQL = f"""
WITH RECURSIVE cnt AS (
  SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
w AS (
  SELECT src, n, greatest(1, CAST(floor({PERIOD} * sqrt(n) / (SELECT sum(sqrt(n)) FROM cnt)) AS BIGINT)) AS w,
         row_number() OVER (ORDER BY src) AS idx FROM cnt),
s AS (SELECT *, (SELECT CAST(sum(w) AS BIGINT) FROM w) AS p FROM w),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS t, idx, src, n, w, p, CAST(0 AS BIGINT) AS done, false AS hit FROM s
  UNION ALL
  SELECT t, idx, src, n, w, p, done + CASE WHEN rk = 1 THEN 1 ELSE 0 END, rk = 1 FROM (
    SELECT t + 1 AS t, idx, src, n, w, p, done,
           row_number() OVER (ORDER BY CASE WHEN (done * p) // w <= t + 1 THEN 0 ELSE 1 END,
                              ((done + 1) * p + w - 1) // w, idx) AS rk
    FROM fold WHERE t + 1 < p)),
picked AS (SELECT src, w, p, done - 1 AS j, t AS slot FROM fold WHERE hit),
d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         row_number() OVER (PARTITION BY coalesce(source, '')
                            ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS pos
  FROM documents),
b AS (SELECT doc_id, source, src, pos // {BLOCK_ROWS} AS block, pos % {BLOCK_ROWS} AS in_block FROM d)
SELECT b.doc_id, b.source, b.block, (b.block * k.p) // k.w AS release,
       ((b.block + 1) * k.p + k.w - 1) // k.w AS deadline,
       (b.block // k.w) * k.p + k.slot AS slot, b.in_block
FROM b JOIN picked k ON b.src = k.src AND b.block % k.w = k.j
"""
