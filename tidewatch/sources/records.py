"""Key/value record decoding and encoding (S2, S3, S5) and numeric cleaning of text fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def decode_json(df: DataFrame, value_col: str, schema: StructType | str,
                key_col: str | None = None, key_as: str = "timestamp",
                keep: Sequence[str] = ()) -> DataFrame:
    """Parse a JSON text column by a fixed schema and flatten its fields.

    Permissive: a field that does not fit its type becomes NULL. If ``key_col`` is
    given it is cast to string and kept as ``key_as``.
    """
    parsed = F.from_json(F.col(value_col).cast("string"), schema)
    head = [F.col(k) for k in keep]
    if key_col:
        head = [F.col(key_col).cast("string").alias(key_as)] + head
    return df.select(*head, parsed.alias("_data")).select(*[F.col(f"`{c}`") for c in
                                                           [*([key_as] if key_col else []), *keep]],
                                                         "_data.*")


def key_time(key: Column) -> Column:
    """Record time from a text key: ``yyyy-MM-dd HH:mm:ss``, with a ``T`` and a fraction
    if any (ISO forms); a zone suffix is left out of account, other text gives NULL."""
    return key.try_cast("timestamp_ntz")


def encode_json(df: DataFrame, time_col: str, cols: Sequence[str],
                time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """S3: (key, value) records; key = formatted time, value = JSON of time + ``cols``.

    NULL fields are left out of the JSON, as ``to_json`` does.
    """
    t = F.date_format(F.col(time_col), time_format)
    fields: list[Column] = [t.alias(time_col)] + [F.col(f"`{c}`") for c in cols]
    return df.select(t.alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def publish_table(df: DataFrame, time_col: str, cols: Sequence[str]) -> DataFrame:
    """One JSON record per row, key = time as text, value = JSON of the chosen columns."""
    return df.select(F.col(time_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("value"))


def clean_numeric(df: DataFrame, cols: Sequence[str], suffix: str = "_num") -> DataFrame:
    """Try-convert text columns to double; the original text stays in its column and
    the number (NULL where conversion fails) goes to ``<col><suffix>``."""
    return df.select("*", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(f"{c}{suffix}") for c in cols])
