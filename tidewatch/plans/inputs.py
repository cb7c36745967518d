"""Stand-in inputs built from the given tables (see FIXTURES.md §3).

sensor record := events(ts, value, k = props.k); intervals := six literal rows;
multivariate series := lineitem 4-vectors keyed by l_suppkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.records import decode_json

SENSOR_COLS = ["value", "k"]
LINE_VECTOR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the JSON property ``k`` decoded as an INT sensor."""
    ev = table(spark, sf_dir, "events")
    return decode_json(ev, "props", "k INT", keep=["event_id", "ts", "user_id", "event_type", "value"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle comparison is on rounded values)."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c, digits).alias(name) if dtype in ("double", "float") else c)
    return df.select(*out)
