"""Detector queries: histories (W1-W5), detectors (D1-D9) and scoreboards."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalars import normal_cdf_expr
from tidewatch.operators import history, labels, score
from tidewatch.operators.detect import univariate as U
from tidewatch.operators.detect import vector as V
from tidewatch.plans import sqlparts as S
from tidewatch.plans.catalog import register
from tidewatch.plans.inputs import LINE_ORDER, LINE_VECTOR, rounded, sensor_events, table

ORDER = ["ts", "event_id"]
W_USER = "PARTITION BY user_id ORDER BY ts, event_id"
W_TYPE = "PARTITION BY event_type ORDER BY ts, event_id"


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _rows(frame: str, lo: int, hi: int) -> str:
    def b(x):
        return "CURRENT ROW" if x == 0 else (f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING")
    return f"({frame} ROWS BETWEEN {b(lo)} AND {b(hi)})"


# --- W1 - W5 -----------------------------------------------------------------------

def _list_summary_sql(col: str, name: str) -> str:
    return (f"len({col}) AS {name}_n, round(list_sum({col}), 6) AS {name}_sum, {col}[1] AS {name}_first, "
            f"{col}[len({col})] AS {name}_last, "
            f"round(list_sum(list_transform({col}, lambda x, i: x * i)), 6) AS {name}_wsum")


def _array_summary(col: str, name: str) -> list:
    """Order-sensitive scalar summary of an array column (engines disagree on how arrays
    are handed back, so results are compared on these)."""
    c = F.col(col)
    return [F.size(c).alias(f"{name}_n"), F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(f"{name}_sum"),
            F.element_at(c, 1).alias(f"{name}_first"), F.element_at(c, -1).alias(f"{name}_last"),
            F.expr(f"aggregate(transform({col}, (x, i) -> x * (i + 1)), 0D, (a, y) -> a + y)").alias(f"{name}_wsum")]


@register("history10", f"""
SELECT event_id, user_id, {_list_summary_sql("history", "history")}
FROM (SELECT event_id, user_id, list(value) OVER {_rows(W_USER, -9, 0)} AS history FROM events)
WHERE len(history) = 10""")
def history10(spark, sf):
    """Last 10 values per user, only once 10 exist (compared by order-sensitive summary)."""
    h = history.last_n(_events(spark, sf), ["user_id"], ORDER, "value", 10)
    return rounded(h.select("event_id", "user_id", *_array_summary("history", "history")))


@register("rolling_shift", f"""
SELECT event_id, user_id, value, round(avg(value) OVER {_rows(W_USER, -9, 0)}, 6) AS rolling_mean,
       round(abs(value - avg(value) OVER {_rows(W_USER, -9, 0)}), 6) AS shift,
       count(*) OVER {_rows(W_USER, -9, 0)} = 10 AS full
FROM events""")
def rolling_shift(spark, sf):
    """Rolling mean of the last 10 values and the current value's distance from it."""
    out = history.rolling_shift(_events(spark, sf), ["user_id"], ORDER, "value", 10)
    return rounded(out.select("event_id", "user_id", "value", "rolling_mean", "shift", "full"))


@register("rolling_max", f"""
SELECT event_id, user_id, max(value) OVER {_rows(W_USER, -9, 0)} AS rolling_max FROM events""")
def rolling_max(spark, sf):
    """Maximum over the last 10 values."""
    out = history.rolling_max(_events(spark, sf), ["user_id"], ORDER, "value", 10)
    return rounded(out.select("event_id", "user_id", "rolling_max"))


@register("half_windows", f"""
SELECT event_id, event_type, {_list_summary_sql("older", "older")}, {_list_summary_sql("recent", "recent")}
FROM (SELECT event_id, event_type, list(value) OVER {_rows(W_TYPE, -199, -100)} AS older,
             list(value) OVER {_rows(W_TYPE, -99, 0)} AS recent FROM events)
WHERE len(older) = 100 AND len(recent) = 100""")
def half_windows(spark, sf):
    """Older 100 and newest 100 of the last 200 values per event type."""
    out = history.half_windows(_events(spark, sf), ["event_type"], ORDER, "value", 200, 100)
    return rounded(out.select("event_id", "event_type", *_array_summary("older", "older"),
                              *_array_summary("recent", "recent")))


@register("count_blocks", f"""
SELECT l_suppkey, block, count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity,
       round(max(l_extendedprice), 6) AS max_price
FROM (SELECT *, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) - 1) / 50) AS block
      FROM lineitem)
GROUP BY l_suppkey, block""")
def count_blocks(spark, sf):
    """Tumbling blocks of 50 records per supplier, summarised per block."""
    li = table(spark, sf, "lineitem")
    b = history.count_blocks(li, ["l_suppkey"], LINE_ORDER, 50)
    return rounded(b.groupBy("l_suppkey", "block").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("avg_quantity"),
        F.max("l_extendedprice").alias("max_price")))


# --- D1 CUSUM ------------------------------------------------------------------------

def cusum_sql(part: str, k: float = 1.0, h: float = 5.0, n: int = 10, extra: str = "") -> str:
    frame = f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
SELECT event_id, user_id, ts, value, round(c, 6) AS cusum, c > {h} AS alarm {extra} FROM (
  SELECT *, list_reduce(hist, lambda acc, v: greatest(0.0::DOUBLE, acc + v - m - {k}), 0.0::DOUBLE) AS c
  FROM (SELECT *, list(value) OVER {frame} AS hist, avg(value) OVER {frame} AS m FROM events)
  WHERE len(hist) = {n})"""


@register("cusum", cusum_sql(W_USER))
def cusum_q(spark, sf):
    """Windowed CUSUM (history 10, k 1.0, h 5) per user."""
    out = U.cusum(_events(spark, sf), ["user_id"], ORDER, "value", 10, 1.0, 5.0)
    return rounded(out.select("event_id", "user_id", "ts", "value", "cusum", "alarm"))


@register("cusum_unkeyed", cusum_sql("ORDER BY ts, event_id", 20.0, 100.0))
def cusum_unkeyed_q(spark, sf):
    """B-2 + D1: the whole table as one series, cut into position blocks with a halo
    so no task holds the series (blocks of 2,500 rows here)."""
    out = U.cusum(_events(spark, sf), [], ORDER, "value", 10, 20.0, 100.0, block_rows=2500, force_blocks=True)
    return rounded(out.select("event_id", "user_id", "ts", "value", "cusum", "alarm"))


NULLED = "CASE WHEN event_id % 17 = 3 THEN NULL ELSE value END"


@register("cusum_nulls", f"""
SELECT event_id, user_id, value, cusum, alarm FROM (
  {cusum_sql(W_USER).replace("FROM events", "FROM events WHERE event_id % 17 <> 3")})
UNION ALL SELECT event_id, user_id, NULL, NULL, NULL FROM events WHERE event_id % 17 = 3""")
def cusum_nulls_q(spark, sf):
    """D1 on a sensor that goes missing: NULL values take no place in the history and their
    rows come out with NULL results."""
    ev = _events(spark, sf).withColumn("value", F.expr(NULLED))
    out = U.cusum(ev, ["user_id"], ORDER, "value", 10, 1.0, 5.0)
    return rounded(out.select("event_id", "user_id", "value", "cusum", "alarm"))


# --- D2 CvM ---------------------------------------------------------------------------

def cvm_sql(standardise: bool, alpha: float = 0.05, min_shift: float = 10.0, n: int = 10) -> str:
    frame = _rows(W_USER, -(n - 1), 0)
    z = "coalesce(CASE WHEN sd = 0 THEN NULL ELSE (v - m) / sd END, 0.0)" if standardise else "v"
    crit = {0.05: 0.461}[alpha]  # on purpose not read from the operator's table
    return f"""
SELECT event_id, user_id, value, round(w2, 6) AS cvm_w2, round(abs(value - m), 6) AS shift,
       (w2 - {0.4 / n!r} + {0.6 / (n * n)!r}) * {1.0 + 1.0 / n!r} > {crit} AS rejected,
       (w2 - {0.4 / n!r} + {0.6 / (n * n)!r}) * {1.0 + 1.0 / n!r} > {crit} AND abs(value - m) > {min_shift} AS alarm
FROM (SELECT *, 1.0 / (12 * {n}) + list_sum(list_transform(list_sort(hist), lambda v, i:
          pow((2 * i - 1) / (2.0 * {n}) - {normal_cdf_expr(z)}, 2))) AS w2
      FROM (SELECT *, list(value) OVER {frame} AS hist, avg(value) OVER {frame} AS m,
                   stddev_samp(value) OVER {frame} AS sd FROM events)
      WHERE len(hist) = {n})"""


@register("cvm", cvm_sql(False))
def cvm_q(spark, sf):
    """Cramer-von Mises on raw values (parity: gate by |shift| > 10)."""
    out = U.cvm(_events(spark, sf), ["user_id"], ORDER, "value", 10, 0.05, 10.0)
    return rounded(out.select("event_id", "user_id", "value", "cvm_w2", "shift", "rejected", "alarm"))


@register("cvm_standardised", cvm_sql(True))
def cvm_std_q(spark, sf):
    """D2 on standardised histories (the discriminating form)."""
    out = U.cvm(_events(spark, sf), ["user_id"], ORDER, "value", 10, 0.05, 10.0, standardise=True)
    return rounded(out.select("event_id", "user_id", "value", "cvm_w2", "shift", "rejected", "alarm"))


# --- D3 KSWIN (no reset) -------------------------------------------------------------------

def kswin_sql(src: str, alpha: float = 1e-4, window: int = 200, stat: int = 100) -> str:
    k = {(100, 0.01): 23, (100, 1e-4): 32}[stat, alpha]  # on purpose not computed by the operator
    older = _rows(W_TYPE, -(window - 1), -stat)
    recent = _rows(W_TYPE, -(stat - 1), 0)
    return f"""
SELECT event_id, event_type, value, d AS ks_count, round(d / {float(stat)}, 6) AS ks_d,
       d >= {k} AND d / {float(stat)} > 0.1 AS alarm
FROM (SELECT *, list_max(list_transform(list_concat(older, recent), lambda v:
          abs(len(list_filter(older, lambda a: a <= v)) - len(list_filter(recent, lambda b: b <= v))))) AS d
      FROM (SELECT *, list(value) OVER {older} AS older, list(value) OVER {recent} AS recent FROM ({src}))
      WHERE len(older) = {window - stat} AND len(recent) = {stat})"""


@register("kswin_noreset", kswin_sql("SELECT * FROM events", 0.01))
def kswin_q(spark, sf):
    """D3 (no reset): KS of older 100 vs newest 100 of the last 200 per event type, alpha 0.01."""
    out = U.kswin(_events(spark, sf), ["event_type"], ORDER, "value", 200, 100, 0.01)
    return rounded(out.select("event_id", "event_type", "value", "ks_count", "ks_d", "alarm"))


@register("kswin_warmup", kswin_sql(f"""
SELECT * FROM (SELECT *, row_number() OVER ({W_TYPE}) AS wpos FROM events) WHERE wpos <> 1000""", 1e-4)
          .replace("WHERE len(older)", "WHERE wpos > 1000 AND len(older)"))
def kswin_warmup_q(spark, sf):
    """D3 with the reference's warm-up (999 rows fill the window, row 1000 skipped), alpha 1e-4."""
    out = U.kswin(_events(spark, sf), ["event_type"], ORDER, "value", 200, 100, 1e-4, warmup=1000)
    return rounded(out.select("event_id", "event_type", "value", "ks_count", "ks_d", "alarm"))


# --- D5b Page-Hinkley ------------------------------------------------------------------------

@register("page_hinkley", f"""
WITH a AS (SELECT *, value - sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
                  / count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 0.005 AS dev
           FROM events),
b AS (SELECT *, sum(dev) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ph_m FROM a),
c AS (SELECT *, min(ph_m) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ph_min FROM b)
SELECT event_id, user_id, round(ph_m, 6) AS ph_m, round(ph_m - ph_min, 6) AS ph_stat,
       CASE WHEN ph_m - ph_min > 50.0 THEN 'drift' WHEN ph_m - ph_min > 25.0 THEN 'warning' ELSE 'none' END AS state
FROM c""")
def page_hinkley_q(spark, sf):
    """Page-Hinkley statistic and state per user (delta 0.005, lambda 50, warning at half)."""
    out = U.page_hinkley(_events(spark, sf), ["user_id"], ORDER, "value", 0.005, 50.0, 0.5)
    return rounded(out.select("event_id", "user_id", "ph_m", "ph_stat", "state"))


# --- D7 density ratio, D8 nearest neighbour ---------------------------------------------------

def _lse_duck(sample: str, x: str, h: float) -> str:
    a = f"list_transform({sample}, lambda s: -(({x}) - s) * (({x}) - s) / {2.0 * h * h!r})"
    return f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda t: exp(t - list_max({a}))))))"


def _ldr_duck(prev: str, cur: str, h: float) -> str:
    d = f"list_transform({cur}, lambda x: {_lse_duck(cur, 'x', h)} - {_lse_duck(prev, 'x', h)})"
    return f"(list_max({d}) + ln(list_sum(list_transform({d}, lambda t: exp(t - list_max({d}))))) - ln(len({cur})))"


@register("density_ratio", f"""
WITH s AS ({S.SENSOR}),
p AS (SELECT *, [value, CAST(k AS DOUBLE)] AS cur,
             lag([value, CAST(k AS DOUBLE)]) OVER ({W_USER}) AS prev FROM s),
r AS (SELECT *, {_ldr_duck('prev', 'cur', 0.2)} AS log_rdr FROM p WHERE prev IS NOT NULL)
SELECT event_id, user_id, round(log_rdr, 6) AS log_rdr, round(log_rdr_max, 6) AS log_rdr_max,
       log_rdr_max > {math.log(1.5)!r} AS alarm
FROM (SELECT *, max(log_rdr) OVER {_rows(W_USER, -9, 0)} AS log_rdr_max FROM r)""")
def density_ratio_q(spark, sf):
    """Gaussian-KDE relative density ratio of consecutive records (value, k), h 0.2,
    alarm when the largest of the last 10 ratios exceeds 1.5."""
    out = V.density_ratio(sensor_events(spark, sf), ["user_id"], ORDER, ["value", "k"], 0.2, 10, 1.5)
    return rounded(out.select("event_id", "user_id", "log_rdr", "log_rdr_max", "alarm"))


_LW = f"PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}"


@register("nn_distance", f"""
WITH p AS (SELECT *, [{', '.join(LINE_VECTOR)}] AS cur, lag([{', '.join(LINE_VECTOR)}]) OVER ({_LW}) AS prev
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey,
       round(list_avg(list_transform(cur, lambda x: list_sort(list_transform(prev, lambda q: abs(x - q)))[2])), 6) AS avg_nn
FROM p WHERE prev IS NOT NULL""")
def nn_distance_q(spark, sf):
    """Mean 2nd-nearest distance of each feature to the previous record's features,
    over lineitem 4-vectors per supplier."""
    li = table(spark, sf, "lineitem")
    out = V.nn_distance(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, 2)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey", "avg_nn"))


# --- D9 / A8 / A9 / O1: attribution and scoreboards -------------------------------------------

def _labelled_events(spark, sf):
    ev = labels.truncate_time(_events(spark, sf), "ts", out="ts_s")
    return labels.label_intervals(ev, "ts_s", labels.interval_table(spark))


def scoreboard_sql(alarms_sql: str, algorithm: str) -> str:
    cols = []
    for i, _, _ in fixed.EVENT_INTERVALS:
        cols.append(f"coalesce(max(CASE WHEN lab = 'attack' AND iid = {i} THEN 1 END), 0) AS \"attack{i}-detected\"")
        cols.append(f"coalesce(min(CASE WHEN lab = 'attack' AND iid = {i} AND delay > 0 THEN delay END), 0.0)"
                    f" AS \"attack{i}-delay\"")
    return f"""
SELECT '{algorithm}' AS algorithm, count(CASE WHEN lab = 'attack' THEN 1 END) AS detections,
       count(CASE WHEN lab IS DISTINCT FROM 'attack' THEN 1 END) AS "false-alarms", {', '.join(cols)}
FROM (SELECT a.*, iv.interval_id AS iid, CAST(epoch(a.ts_s) - epoch(iv.start) AS DOUBLE) AS delay
      FROM (SELECT *, date_trunc('second', ts) AS ts_s, {S.label_case("date_trunc('second', ts)")} AS lab
            FROM ({alarms_sql}) WHERE alarm) a
      LEFT JOIN ({S.intervals_cte().split(' AS ', 1)[1]}) iv ON a.ts_s BETWEEN iv.start AND iv."end")"""


def _cusum_board(spark, sf):
    al = U.cusum(_labelled_events(spark, sf), ["user_id"], ORDER, "value", 10, 20.0, 100.0)
    return score.scoreboard(al.filter("alarm"), "ts_s", "attack_label", labels.interval_table(spark), "cusum",
                            row_key=["event_id"])


def _cvm_board(spark, sf):
    al = U.cvm(_labelled_events(spark, sf), ["user_id"], ORDER, "value", 10, 0.05, 60.0)
    return score.scoreboard(al.filter("alarm"), "ts_s", "attack_label", labels.interval_table(spark), "cvm",
                            row_key=["event_id"])


def _kswin_board(spark, sf):
    al = U.kswin(_labelled_events(spark, sf), ["event_type"], ORDER, "value", 200, 100, 0.01)
    return score.scoreboard(al.filter("alarm"), "ts_s", "attack_label", labels.interval_table(spark), "ks-win",
                            row_key=["event_id"])


_CUSUM_BOARD_SQL = scoreboard_sql(cusum_sql(W_USER, 20.0, 100.0), "cusum")
_CVM_BOARD_SQL = scoreboard_sql(cvm_sql(False, 0.05, 60.0).replace("SELECT event_id, user_id, value,",
                                                                  "SELECT event_id, user_id, ts, value,", 1), "cvm")
_KSWIN_BOARD_SQL = scoreboard_sql(kswin_sql("SELECT * FROM events", 0.01).replace(
    "SELECT event_id, event_type, value,", "SELECT event_id, event_type, ts, value,", 1), "ks-win")


@register("attribute_alarms", f"""
SELECT event_id, iv.interval_id, CAST(epoch(a.ts_s) - epoch(iv.start) AS DOUBLE) AS delay
FROM (SELECT *, date_trunc('second', ts) AS ts_s FROM ({cusum_sql(W_USER, 20.0, 100.0)}) WHERE alarm) a
LEFT JOIN ({S.intervals_cte().split(' AS ', 1)[1]}) iv ON a.ts_s BETWEEN iv.start AND iv."end\"""")
def attribute_alarms_q(spark, sf):
    """CUSUM (k 20, h 100) alarms attributed to intervals with delay in seconds."""
    al = U.cusum(_labelled_events(spark, sf), ["user_id"], ORDER, "value", 10, 20.0, 100.0).filter("alarm")
    return score.attribute(al, "ts_s", labels.interval_table(spark), ["event_id"]).select(
        "event_id", "interval_id", "delay")


@register("scoreboard_cusum", _CUSUM_BOARD_SQL)
def scoreboard_cusum_q(spark, sf):
    """CUSUM scoreboard (detections, false alarms, per-interval flag and delay)."""
    return _cusum_board(spark, sf)


_SUMMARY_SQL = f"""
SELECT *, {' + '.join(f'"attack{i}-detected"' for i, _, _ in fixed.EVENT_INTERVALS)} AS "attacks-detected",
       round(CASE WHEN ({' + '.join(f'"attack{i}-detected"' for i, _, _ in fixed.EVENT_INTERVALS)}) = 0 THEN NULL
            ELSE ({' + '.join(f'"attack{i}-delay"' for i, _, _ in fixed.EVENT_INTERVALS)})
                 / ({' + '.join(f'"attack{i}-detected"' for i, _, _ in fixed.EVENT_INTERVALS)}) END, 6) AS "average-delay"
FROM ({_CUSUM_BOARD_SQL} UNION ALL {_CVM_BOARD_SQL} UNION ALL {_KSWIN_BOARD_SQL})"""


@register("score_summary", _SUMMARY_SQL)
def score_summary_q(spark, sf):
    """A9 + O1: scoreboards of three detectors on events, attacks detected and average
    delay, ordered by attacks detected."""
    boards = _cusum_board(spark, sf).unionByName(_cvm_board(spark, sf)).unionByName(_kswin_board(spark, sf))
    return rounded(score.rank_scores(score.summarise_scores(boards)))


@register("rank_by_delay", f"""
SELECT *, row_number() OVER (ORDER BY "average-delay" DESC NULLS LAST, algorithm) AS rank FROM ({_SUMMARY_SQL})""")
def rank_by_delay_q(spark, sf):
    """O1: the detectors by falling average delay, with their rank."""
    boards = _cusum_board(spark, sf).unionByName(_cvm_board(spark, sf)).unionByName(_kswin_board(spark, sf))
    by = Window.orderBy(F.col("`average-delay`").desc_nulls_last(), "algorithm")  # one row per detector
    return rounded(score.summarise_scores(boards)).withColumn("rank", F.row_number().over(by))


@register("score_all")
def score_all_q(spark, sf):
    """A8 + A9: scoreboards of all six detectors on the sensor events (value, k) by event
    type. An alarm of a block detector has the time and label of its block's last row."""
    from tidewatch.operators.detect.kdq import kdq_tree
    from tidewatch.operators.detect.ocsvm import one_class_svm
    from tidewatch.operators.detect.pca import pca_cd
    keys, xs, iv = ["event_type"], ["value", "k"], labels.interval_table(spark)
    ev = labels.truncate_time(sensor_events(spark, sf), "ts", out="ts_s")
    ev = labels.label_intervals(ev, "ts_s", iv).persist(StorageLevel.MEMORY_AND_DISK)  # JSON is decoded once for all detectors
    kdq = kdq_tree(ev, keys, ORDER, xs, window=200, boot=200, max_count=40, reset=True).filter("drift")
    pca = pca_cd(ev, keys, ORDER, xs, window=100, delta=0.1, reset=True).filter("state = 'drift'")
    svm = one_class_svm(ev, keys, xs).filter("alarm")
    boards = _cusum_board(spark, sf).unionByName(_cvm_board(spark, sf)).unionByName(_kswin_board(spark, sf))
    for name, alarms in (("kdq-tree", kdq.join(history.block_ends(ev, keys, ORDER, 200), [*keys, "block"])),
                         ("pca-cd", pca.join(history.block_ends(ev, keys, ORDER, 100), [*keys, "block"])),
                         ("one-class-svm", svm)):
        boards = boards.unionByName(score.scoreboard(alarms, "ts_s", "attack_label", iv, name, row_key=["event_id"]))
    return rounded(score.rank_scores(score.summarise_scores(boards)))


# --- D3 with reset, D6 quantile filter --------------------------------------------------------

def kswin_reset_sql(alpha: float = 0.01, window: int = 200, stat: int = 100) -> str:
    """Reset semantics in SQL: the greedy alarm chain as a recursive CTE (each link the
    first no-reset alarm at least window-stat records after the previous one)."""
    gap = window - stat
    base = kswin_sql(f"SELECT *, row_number() OVER ({W_TYPE}) AS pos FROM events", alpha, window, stat)
    base = base.replace("SELECT event_id, event_type, value, d AS ks_count",
                        "SELECT event_id, event_type, value, pos, d AS ks_count", 1)
    return f"""
WITH RECURSIVE t AS ({base}),
c AS (SELECT event_type, pos FROM t WHERE alarm),
chain(event_type, pos) AS (
  SELECT event_type, min(pos) FROM c GROUP BY event_type
  UNION ALL
  SELECT ch.event_type, (SELECT min(c.pos) FROM c WHERE c.event_type = ch.event_type AND c.pos >= ch.pos + {gap})
  FROM chain ch WHERE ch.pos IS NOT NULL)
SELECT t.event_type, t.event_id, t.value, t.ks_count, t.ks_d, ch.pos IS NOT NULL AS alarm
FROM t LEFT JOIN chain ch ON ch.event_type = t.event_type AND ch.pos = t.pos
WHERE ch.pos IS NOT NULL OR NOT EXISTS (SELECT 1 FROM chain a WHERE a.event_type = t.event_type
                                        AND a.pos < t.pos AND t.pos - a.pos < {gap})"""


@register("kswin_reset", kswin_reset_sql(0.01))
def kswin_reset_q(spark, sf):
    """D3 with reset (batch): no-reset candidates in parallel, then the greedy alarm chain
    by pointer doubling; equals the sequential stream form (kswin_stream)."""
    from tidewatch.operators.detect.reset import kswin_reset
    out = kswin_reset(_events(spark, sf), ["event_type"], ORDER, "value", 200, 100, 0.01)
    return rounded(out.select("event_type", "event_id", "value", "ks_count", "ks_d", "alarm"))


@register("quantile_filter", """
SELECT e.event_id, e.event_type, e.value, round(t.threshold, 6) AS threshold, e.value >= t.threshold AS alarm
FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.995) AS threshold FROM events GROUP BY 1) t
USING (event_type)""")
def quantile_filter_q(spark, sf):
    """D6 (filter part): score >= the exact 0.995 quantile of the scores of its series."""
    from tidewatch.operators.detect.ocsvm import quantile_filter
    out = quantile_filter(_events(spark, sf), ["event_type"], "value", 0.995)
    return rounded(out.select("event_id", "event_type", "value", "threshold", "alarm"))


# --- D4 kdq-tree -------------------------------------------------------------------------

KDQ = dict(window=100, max_count=20, max_depth=40)


def _kdq_sql(window: int, max_count: int, max_depth: int) -> str:
    depth = max_depth
    xs = LINE_VECTOR
    # axis and split number of a level, written out here on purpose (not the operator's code)
    d = len(xs)
    m = [len(range(ax, depth, d)) for ax in range(d)]
    qs = ", ".join(
        f"CAST(CASE WHEN hi{i} - lo{i} <= 0 THEN 0 ELSE least(greatest(floor((CAST({c} AS DOUBLE) - lo{i}) / "
        f"(hi{i} - lo{i}) * {float(2 ** m[i])!r}), 0), {2 ** m[i] - 1}) END AS BIGINT) AS q{i}"
        for i, c in enumerate(xs))
    code = " + ".join(f"(((q{lev % d} >> {m[lev % d] - 1 - lev // d}) & 1) << {depth - 1 - lev})" for lev in range(depth))
    box = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo{i}, max(CAST({c} AS DOUBLE)) AS hi{i}" for i, c in enumerate(xs))
    return f"""
WITH b AS (SELECT l_suppkey, {', '.join(xs)}, row_number() OVER ({_LW}) AS pos,
                  floor((row_number() OVER ({_LW}) - 1) / {window}) AS block FROM lineitem),
fb AS (SELECT l_suppkey, block FROM b GROUP BY 1, 2 HAVING count(*) = {window}),
bf AS (SELECT b.* FROM b JOIN fb USING (l_suppkey, block)),
box AS (SELECT l_suppkey, {box} FROM bf WHERE block = 0 GROUP BY 1),
q AS (SELECT bf.l_suppkey, bf.block, bf.pos, {qs} FROM bf JOIN box USING (l_suppkey)),
c AS (SELECT l_suppkey, block, pos, CAST({code} AS BIGINT) AS code FROM q),
pref AS (SELECT l_suppkey, r.l, code >> ({depth} - r.l) AS p, count(*) AS cnt
         FROM c CROSS JOIN range(0, {depth}) r(l) WHERE block = 0 GROUP BY 1, 2, 3),
split AS (SELECT l_suppkey, l, p FROM pref WHERE cnt > {max_count}),
lv AS (SELECT c.l_suppkey, c.block, c.pos, c.code, count(s.p) AS depth
       FROM c CROSS JOIN range(0, {depth}) r(l)
       LEFT JOIN split s ON s.l_suppkey = c.l_suppkey AND s.l = r.l AND s.p = (c.code >> ({depth} - r.l))
       GROUP BY 1, 2, 3, 4),
cnt AS (SELECT l_suppkey, block, depth AS l, code >> ({depth} - depth) AS p, count(*) AS n FROM lv GROUP BY 1, 2, 3, 4),
kids AS (SELECT l_suppkey, l + 1 AS l, p * 2 + u.b AS p FROM split CROSS JOIN (VALUES (0), (1)) u(b)),
leaves AS (SELECT * FROM kids EXCEPT SELECT * FROM split
           UNION ALL SELECT l_suppkey, 0, 0 FROM box WHERE l_suppkey NOT IN (SELECT l_suppkey FROM split WHERE l = 0)),
nl AS (SELECT l_suppkey, count(*) AS nleaf FROM leaves GROUP BY 1),
grid AS (SELECT lf.l_suppkey, fb.block, lf.l, lf.p FROM leaves lf JOIN fb USING (l_suppkey) WHERE fb.block > 0),
g AS (SELECT grid.*, coalesce(r.n, 0) AS cr, coalesce(t.n, 0) AS ct FROM grid
      LEFT JOIN cnt r ON r.l_suppkey = grid.l_suppkey AND r.block = 0 AND r.l = grid.l AND r.p = grid.p
      LEFT JOIN cnt t ON t.l_suppkey = grid.l_suppkey AND t.block = grid.block AND t.l = grid.l AND t.p = grid.p),
pp AS (SELECT g.*, (cr + 0.5) / (sum(cr) OVER (PARTITION BY g.l_suppkey, block) + nleaf / 2.0) AS pr,
              (ct + 0.5) / (sum(ct) OVER (PARTITION BY g.l_suppkey, block) + nleaf / 2.0) AS pt
       FROM g JOIN nl USING (l_suppkey))
SELECT l_suppkey, CAST(block AS BIGINT) AS block, round(sum(pr * ln(pr / pt)), 6) AS kl FROM pp GROUP BY 1, 2"""


@register("kdq_divergence", _kdq_sql(**KDQ))
def kdq_divergence_q(spark, sf):
    """D4 core: kdq-tree on each supplier's first block of 100 lineitem 4-vectors (leaf
    bound 20), KL divergence of every later full block from it."""
    from tidewatch.operators.detect.kdq import kdq_tree
    li = table(spark, sf, "lineitem")
    out = kdq_tree(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, with_threshold=False, **KDQ)
    return rounded(out.select("l_suppkey", F.col("block").cast("long").alias("block"), "kl"))


def _kdq_sliding_sql(window: int, max_count: int, max_depth: int) -> str:
    """The same tree; all rows of series of two windows or more, every window counted anew."""
    tree = _kdq_sql(window, max_count, max_depth).split(",\ngrid AS")[0].replace(
        f"HAVING count(*) = {window}", "").replace(
        "bf AS (SELECT b.* FROM b JOIN fb USING (l_suppkey, block))",
        f"bf AS (SELECT * FROM b WHERE l_suppkey IN (SELECT l_suppkey FROM b GROUP BY 1 HAVING count(*) >= {2 * window}))")
    return tree + f""",
lr AS (SELECT l_suppkey, pos, depth AS l, code >> ({max_depth} - depth) AS p FROM lv),
pr AS (SELECT lf.l_suppkey, lf.l, lf.p, nleaf, (coalesce(r.n, 0) + 0.5) / ({window} + nleaf / 2.0) AS pr
       FROM leaves lf JOIN nl USING (l_suppkey)
       LEFT JOIN (SELECT l_suppkey, l, p, count(*) AS n FROM lr WHERE pos <= {window} GROUP BY 1, 2, 3) r
         ON r.l_suppkey = lf.l_suppkey AND r.l = lf.l AND r.p = lf.p),
h AS (SELECT l_suppkey, sum(pr * ln(pr)) AS h, max(nleaf) AS nleaf FROM pr GROUP BY 1),
win AS (SELECT a.l_suppkey, a.pos, r.l, r.p, count(*) AS n
        FROM lr a JOIN lr r ON r.l_suppkey = a.l_suppkey AND r.pos BETWEEN a.pos - {window - 1} AND a.pos
        WHERE a.pos >= {2 * window} GROUP BY 1, 2, 3, 4)
SELECT l_suppkey, CAST(pos AS BIGINT) AS pos, round(any_value(h) - sum(pr * (ln(n + 0.5) - ln(0.5))) - ln(0.5)
       + ln({window} + any_value(h.nleaf) / 2.0), 6) AS kl
FROM win JOIN pr USING (l_suppkey, l, p) JOIN h USING (l_suppkey) GROUP BY 1, 2"""


@register("kdq_sliding_divergence", _kdq_sliding_sql(**KDQ))
def kdq_sliding_divergence_q(spark, sf):
    """D4 record by record: KL divergence of the last 100 rows of a supplier from its first 100,
    at every row, as a running sum of leaf count changes."""
    from tidewatch.operators.detect.kdq import kdq_sliding
    li = table(spark, sf, "lineitem")
    out = kdq_sliding(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, with_threshold=False, **KDQ)
    return rounded(out.select("l_suppkey", "pos", "kl"))


@register("kdq_sliding")
def kdq_sliding_q(spark, sf):
    """D4 as a record-by-record detector: bootstrap threshold, and drift once more than 5 % of a
    window's records in a row exceed it."""
    from tidewatch.operators.detect.kdq import kdq_sliding
    li = table(spark, sf, "lineitem")
    out = kdq_sliding(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, alpha=0.05, boot=500, seed=1, persistence=0.05, **KDQ)
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", "pos", "kl", "threshold", "exceeds", "run", "state"))


@register("kdq_tree")
def kdq_tree_q(spark, sf):
    """Kdq-tree divergence with a 500-resample bootstrap threshold (alpha 0.05, seed 1),
    drift state per supplier block, and the reference replaced after each drift."""
    from tidewatch.operators.detect.kdq import kdq_tree
    li = table(spark, sf, "lineitem")
    out = kdq_tree(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, alpha=0.05, boot=500, seed=1, reset=True, **KDQ)
    return rounded(out.select("l_suppkey", "block", "ref_block", "kl", "threshold", "drift", "state"))


# --- D5 PCA-CD, D6 one-class SVM -------------------------------------------------------

@register("pca_cd")
def pca_cd_q(spark, sf):
    """PCA change detection per supplier (blocks of 50 lineitem 4-vectors, KL,
    Page-Hinkley delta 0.1 over the per-block divergence, reference reset after drift)."""
    from tidewatch.operators.detect.pca import pca_cd
    out = pca_cd(table(spark, sf, "lineitem"), ["l_suppkey"], LINE_ORDER, LINE_VECTOR, window=50, delta=0.1,
                 reset=True)
    return rounded(out)


@register("one_class_svm")
def one_class_svm_q(spark, sf):
    """Linear one-class SVM (nu 0.1) per supplier on scaled lineitem 4-vectors,
    alarms above the 0.995 quantile of the supplier's scores."""
    from tidewatch.operators.detect.ocsvm import one_class_svm
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *LINE_VECTOR)
    out = one_class_svm(li, ["l_suppkey"], LINE_VECTOR, nu=0.1, q=0.995)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey", "score", "threshold", "alarm"))


@register("save_read_results", _CUSUM_BOARD_SQL)
def save_read_results_q(spark, sf):
    """The CUSUM scoreboard appended to a CSV results table and read back by schema."""
    from tidewatch.sources.points import read_results, save_results, shared_path
    import uuid
    path = shared_path(spark, f"results-{uuid.uuid4().hex[:12]}")
    save_results(_cusum_board(spark, sf), path)
    return read_results(spark, path, [i for i, _, _ in fixed.EVENT_INTERVALS])


def _nn_kl_sql(m: int = 50, bins: int = 10, limit: float = 0.5) -> str:
    return f"""
WITH p AS (SELECT *, [{', '.join(LINE_VECTOR)}] AS cur, lag([{', '.join(LINE_VECTOR)}]) OVER ({_LW}) AS prev,
                  row_number() OVER ({_LW}) AS rn FROM lineitem),
s AS (SELECT l_suppkey, rn - 1 AS pos,
             list_avg(list_transform(cur, lambda x: list_sort(list_transform(prev, lambda q: abs(x - q)))[2])) AS avg_nn
      FROM p WHERE prev IS NOT NULL),
n AS (SELECT l_suppkey, count(*) AS cnt FROM s GROUP BY 1),
b AS (SELECT s.l_suppkey, floor((pos - 1) / {m}) AS block, avg_nn FROM s JOIN n USING (l_suppkey)
      WHERE floor((pos - 1) / {m}) < floor(cnt / {m})),
r AS (SELECT l_suppkey, min(avg_nn) AS mn, max(avg_nn) AS mx FROM b GROUP BY 1),
h AS (SELECT b.l_suppkey, block,
             CAST(CASE WHEN mx - mn <= 0 THEN 0 ELSE least(greatest(floor((avg_nn - mn) / (mx - mn) * {bins}), 0), {bins - 1}) END AS INTEGER) AS bin,
             count(*) AS c
      FROM b JOIN r USING (l_suppkey) GROUP BY 1, 2, 3),
blocks AS (SELECT DISTINCT l_suppkey, block FROM b),
g AS (SELECT k.l_suppkey, k.block, u.bin FROM blocks k CROSS JOIN range(0, {bins}) u(bin) WHERE k.block > 0),
kl AS (SELECT g.l_suppkey, g.block,
              sum(((coalesce(hp.c, 0) + 0.5) / {m + bins / 2.0}) *
                  ln(((coalesce(hp.c, 0) + 0.5) / {m + bins / 2.0}) / ((coalesce(hc.c, 0) + 0.5) / {m + bins / 2.0}))) AS kl
       FROM g LEFT JOIN h hc ON hc.l_suppkey = g.l_suppkey AND hc.block = g.block AND hc.bin = g.bin
              LEFT JOIN h hp ON hp.l_suppkey = g.l_suppkey AND hp.block = g.block - 1 AND hp.bin = g.bin
       GROUP BY 1, 2)
SELECT l_suppkey, CAST(block AS BIGINT) AS block, round(kl, 6) AS kl_divergence, kl > {limit} AS drift_detected FROM kl"""


@register("nn_block_kl", _nn_kl_sql())
def nn_block_kl_q(spark, sf):
    """D8 with a non-degenerate divergence: KL between histograms of the mean
    2nd-nearest distance in consecutive blocks of 50 records per supplier."""
    li = table(spark, sf, "lineitem")
    nn = V.nn_distance(li, ["l_suppkey"], LINE_ORDER, LINE_VECTOR, 2)
    out = V.block_histogram_kl(nn, ["l_suppkey"], LINE_ORDER, "avg_nn", 50, 10, 0.5)
    return rounded(out.select("l_suppkey", F.col("block").cast("long").alias("block"), "kl_divergence",
                              "drift_detected"))
