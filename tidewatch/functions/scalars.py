"""Column-level functions (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed


def parse_time(df: DataFrame, col: str, fmt: str, out: str | None = None) -> DataFrame:
    """Text -> TIMESTAMP_NTZ by pattern; unparseable text gives NULL."""
    return df.withColumn(out or col, F.try_to_timestamp(F.col(col), F.lit(fmt)).cast("timestamp_ntz"))


def erf_expr(x: str) -> str:
    """SQL text for erf(x) by Abramowitz-Stegun 7.1.26 (|error| <= 1.5e-7); works in Spark
    higher-order lambdas and in DuckDB alike."""
    a1, a2, a3, a4, a5 = fixed.ERF_A
    t = f"(1.0 / (1.0 + {fixed.ERF_P} * abs({x})))"
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    return f"(sign({x}) * (1.0 - {poly} * exp(-({x}) * ({x}))))"


def normal_cdf_expr(x: str) -> str:
    """SQL text for the standard normal CDF."""
    return f"(0.5 * (1.0 + {erf_expr(f'(({x}) / sqrt(2.0))')}))"


def normal_cdf(c: Column | str) -> Column:
    x = c if isinstance(c, Column) else F.col(c)
    a1, a2, a3, a4, a5 = fixed.ERF_A
    z = x / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + fixed.ERF_P * F.abs(z))
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    return 0.5 * (1.0 + F.signum(z) * (1.0 - poly * F.exp(-z * z)))


def normal_cdf_py(x: float) -> float:
    """The same polynomial CDF in plain Python (for per-key stream state functions)."""
    import math
    a1, a2, a3, a4, a5 = fixed.ERF_A
    z = x / math.sqrt(2.0)
    t = 1.0 / (1.0 + fixed.ERF_P * abs(z))
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    erf = math.copysign(1.0, z) * (1.0 - poly * math.exp(-z * z)) if z != 0 else 0.0
    return 0.5 * (1.0 + erf)
