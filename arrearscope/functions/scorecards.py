"""Deterministic scorecards, priority scores and bands."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import capped
from .numeric import clip, lit_d, round_stable

P_LO, P_HI = 0.02, 0.98


def service_pay(stress: Column, p2o: Column) -> Column:  # F10 pay
    return clip(lit_d(0.80) - lit_d(0.55) * stress + lit_d(0.0003) * (F.col("credit_score") - lit_d(650))
                + lit_d(0.25) * p2o, P_LO, P_HI)


def service_ptp(stress: Column, kept_rate: Column, success_rate: Column) -> Column:  # F10 ptp
    return clip(lit_d(0.20) + lit_d(0.55) * kept_rate + lit_d(0.20) * success_rate - lit_d(0.30) * stress,
                P_LO, P_HI)


def service_rec(stress: Column, p2o: Column) -> Column:  # F10 rec
    return clip(lit_d(0.65) - lit_d(0.45) * stress + lit_d(0.10) * F.least(p2o, lit_d(1.0)), P_LO, P_HI)


def basic_pay(stress: Column) -> Column:  # F11
    return clip(lit_d(0.95) - stress, P_LO, P_HI)


def basic_ptp(stress: Column) -> Column:
    return clip(lit_d(0.90) - stress * lit_d(0.9), P_LO, P_HI)


def basic_rec(stress: Column) -> Column:
    return clip(lit_d(0.85) - stress * lit_d(0.7), P_LO, P_HI)


def uplift_rule(stress: Column) -> Column:  # F31, rounded to 8 dp so exp() ulps cannot leak
    d = stress - lit_d(0.45)
    return round_stable(lit_d(0.18) * F.exp(-(d * d) / lit_d(0.06)), 8)


def income_ratio() -> Column:
    return F.col("outstanding_amount") / F.greatest(F.col("income") * lit_d(12), lit_d(1.0))


def exposure_service() -> Column:  # F12 service
    return F.least(income_ratio(), lit_d(2.0)) / lit_d(2.0)


def exposure_capped() -> Column:  # F12 basic / advanced
    return F.least(income_ratio(), lit_d(1.0))


def priority_service(pay: Column, ptp: Column) -> Column:  # F13 (unrounded inputs, rounded output)
    s = lit_d(100) * (lit_d(0.45) * (lit_d(1) - pay) + lit_d(0.25) * (lit_d(1) - ptp)
                      + lit_d(0.20) * capped("dpd", 180) + lit_d(0.10) * exposure_service())
    return round_stable(clip(s, 0.0, 100.0), 2)


def priority_basic(pay: Column, ptp: Column) -> Column:  # F14
    s = ((lit_d(1) - pay) * lit_d(40) + (lit_d(1) - ptp) * lit_d(25) + capped("dpd", 180) * lit_d(25)
         + exposure_capped() * lit_d(10))
    return clip(s, 0.0, 100.0)


def priority_advanced(pay: Column, uplift: Column) -> Column:  # F15
    s = ((lit_d(1) - pay) * lit_d(30) + F.greatest(uplift, lit_d(0.0)) * lit_d(100) * lit_d(0.35)
         + capped("dpd", 180) * lit_d(20) + exposure_capped() * lit_d(15))
    return clip(s, 0.0, 100.0)


def band(score: Column, high: float = 70.0, medium: float = 40.0) -> Column:  # F16
    return (F.when(score >= lit_d(high), F.lit("HIGH"))
            .when(score >= lit_d(medium), F.lit("MEDIUM")).otherwise(F.lit("LOW")))


def band_advanced(score: Column) -> Column:  # F17
    return band(score, 65.0, 38.0)
