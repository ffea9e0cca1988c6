"""Account features (F1-F9). Every function returns a Column over the account columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import lit_d, safe_ratio

EPS = 1e-6


def ptp_kept_rate() -> Column:  # F1; may exceed 1 when kept > count
    return safe_ratio(F.col("previous_ptp_kept_count"), F.col("previous_ptp_count"), 1.0)


def contact_success_rate() -> Column:  # F2
    return safe_ratio(F.col("successful_contacts"), F.col("collection_attempts"), 1.0)


def outstanding_to_income() -> Column:  # F3
    return safe_ratio(F.col("outstanding_amount"), F.col("income") * lit_d(12), EPS)


def emi_to_income() -> Column:  # F4
    return safe_ratio(F.col("emi_amount"), F.col("income"), EPS)


def payment_to_outstanding() -> Column:  # F5
    return safe_ratio(F.col("recent_payment_amount"), F.col("outstanding_amount"), EPS)


def dpd_bucket() -> Column:  # F6
    return F.least(F.expr("dpd div 30"), F.lit(6)).cast("int")


def capped(c: str, denom: float) -> Column:
    """min(c / denom, 1) in double."""
    return F.least(F.col(c).cast("double") / lit_d(denom), lit_d(1.0))


def behavior_stress_score(kept_rate: Column | None = None, success_rate: Column | None = None) -> Column:  # F7
    kr = kept_rate if kept_rate is not None else ptp_kept_rate()
    sr = success_rate if success_rate is not None else contact_success_rate()
    return (lit_d(0.35) * capped("dpd", 180) + lit_d(0.20) * capped("missed_payment_count", 6)
            + lit_d(0.20) * capped("days_since_last_payment", 90)
            + lit_d(0.15) * (lit_d(1.0) - kr) + lit_d(0.10) * (lit_d(1.0) - sr))


def stress_basic() -> Column:  # F8
    return (lit_d(0.40) * capped("dpd", 180) + lit_d(0.20) * capped("missed_payment_count", 6)
            + lit_d(0.20) * capped("days_since_last_payment", 180)
            + lit_d(0.20) * (lit_d(1.0) - ptp_kept_rate()))


def cap_ptp_kept(df: DataFrame) -> DataFrame:  # F9, opt-in
    return df.withColumn("previous_ptp_kept_count",
                         F.least("previous_ptp_kept_count", "previous_ptp_count").cast("int"))


def with_service_features(df: DataFrame) -> DataFrame:
    """Adds the 7 derived model features (F1-F7) in one projection."""
    df = df.withColumns({
        "ptp_kept_rate": ptp_kept_rate(),
        "contact_success_rate": contact_success_rate(),
        "outstanding_to_income": outstanding_to_income(),
        "emi_to_income": emi_to_income(),
        "payment_to_outstanding": payment_to_outstanding(),
        "dpd_bucket": dpd_bucket(),
    })
    return df.withColumn("behavior_stress_score",
                         behavior_stress_score(F.col("ptp_kept_rate"), F.col("contact_success_rate")))
