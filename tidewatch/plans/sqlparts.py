"""Reusable DuckDB SQL fragments for the oracles."""

from __future__ import annotations

from tidewatch import fixed


def intervals_cte() -> str:
    rows = ", ".join(f"({i}, TIMESTAMP '{s}', TIMESTAMP '{e}')" for i, s, e in fixed.EVENT_INTERVALS)
    return f"iv AS (SELECT * FROM (VALUES {rows}) t(interval_id, start, \"end\"))"


def label_case(time_expr: str) -> str:
    ors = " OR ".join(f"{time_expr} BETWEEN TIMESTAMP '{s}' AND TIMESTAMP '{e}'"
                      for _, s, e in fixed.EVENT_INTERVALS)
    return f"CASE WHEN {ors} THEN '{fixed.HIT_LABEL}' ELSE '{fixed.MISS_LABEL}' END"


# events as the sensor record (k decoded from props)
SENSOR = ("SELECT event_id, ts, user_id, event_type, value, "
          "TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")


def stat_select(cols: list[str], per_hour: float = 6.0) -> str:
    parts = []
    for c in cols:
        parts += [f"count({c}) AS {c}_count", f"round(avg({c}), 6) AS {c}_mean",
                  f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
                  f"round(stddev_samp({c}), 6) AS {c}_stddev",
                  f"round(CAST(count({c}) AS DOUBLE) * {per_hour}, 6) AS {c}_rate",
                  f"round(avg({c}), 6) AS {c}_avg_10min"]
    return ", ".join(parts)


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
