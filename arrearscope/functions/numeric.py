"""Numeric helpers that give the same doubles in Spark and in the SQL oracle."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BIG = 4503599627370496.0  # 2^52


def lit_d(x: float) -> Column:
    return F.lit(float(x))


def round_stable(c: Column, n: int) -> Column:
    """floor(x*10^n + 0.5 + 1e-7) / 10^n.

    Spark's ``round`` (BigDecimal HALF_UP) and other engines disagree at binary half-ways; this form
    uses only double multiply/add/floor/divide, so every engine returns the same double.
    """
    m = float(10 ** n)
    y = c * F.lit(m)
    # Above 2^52 a double has no fractional part left (and floor() would overflow BIGINT): pass through.
    return F.when(F.abs(y) < F.lit(BIG), (F.floor(y + F.lit(0.5) + F.lit(1e-7)) / F.lit(m)).cast("double")) \
        .otherwise(c.cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, lit_d(hi)), lit_d(lo))


def safe_ratio(num: Column, den: Column, floor_value: float) -> Column:
    """num / max(den, floor_value) as double (ANSI mode raises on /0)."""
    return num.cast("double") / F.greatest(den.cast("double"), lit_d(floor_value))


def hash_uniform(key: Column, salt: str) -> Column:
    """Repeatable U[0,1) draw per key: first 8 hex digits of md5(key || salt) / 2^32."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10)
            .cast("double") / F.lit(4294967296.0))
