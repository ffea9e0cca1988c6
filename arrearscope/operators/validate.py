"""P1 validate_accounts: range / domain / required-field rules with a reasons array."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHANNELS

REQUIRED = ["customer_id", "customer_name", "due_date"]
NON_NEGATIVE = ["income", "loan_amount", "outstanding_amount", "emi_amount", "dpd", "missed_payment_count",
                "previous_ptp_count", "previous_ptp_kept_count", "collection_attempts", "successful_contacts",
                "recent_payment_amount", "days_since_last_payment"]
RANGES = {"age": (18, 100), "credit_score": (300, 900)}


def rules() -> list[tuple[str, Column]]:
    """(reason, violated) pairs in a fixed order; a NULL or NaN field violates its rule."""
    out: list[tuple[str, Column]] = []
    for c in REQUIRED:
        out.append((f"missing {c}", F.col(c).isNull()))
    for c, (lo, hi) in RANGES.items():
        v = F.col(c)
        out.append((f"{c} not in [{lo}, {hi}]", v.isNull() | (v < lo) | (v > hi)))
    for c in NON_NEGATIVE:
        v = F.col(c)
        out.append((f"{c} < 0", v.isNull() | (v < 0) | F.isnan(v.cast("double"))))
    ch = F.col("preferred_channel")
    out.append(("preferred_channel not in (" + ", ".join(CHANNELS) + ")", ch.isNull() | ~ch.isin(CHANNELS)))
    return out


def is_valid() -> Column:
    """True when no rule fails: a plain boolean (stays inside whole-stage codegen, unlike the array)."""
    bad = F.lit(False)
    for _, b in rules():
        bad = bad | b
    return ~bad


def with_reasons(df: DataFrame) -> DataFrame:
    arr = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in rules()])
    return df.withColumn("reasons", F.filter(arr, lambda x: x.isNotNull()))


def validate_accounts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (valid, rejected). Rejected keeps every input column plus ``reasons``.

    One pass computes the reasons; callers that need both sides should persist the input first.
    """
    r = with_reasons(df)
    return (r.where(F.size("reasons") == 0).drop("reasons"), r.where(F.size("reasons") > 0))
