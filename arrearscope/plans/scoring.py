"""Scored portfolios: service (API), basic and advanced rule sets, kept apart (different weights)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions as AC
from ..functions import features as FE
from ..functions import scorecards as SC
from ..functions.numeric import clip, round_stable


def score_service(df: DataFrame, pay: Column | None = None, ptp: Column | None = None,
                  rec: Column | None = None) -> DataFrame:
    """E1 /predict over a table: F1-F7 -> probabilities (scorecard F10, or given model columns) ->
    F13 score on unrounded probabilities -> F16 band on the rounded score -> F18 on 4-dp probabilities."""
    df = FE.with_service_features(df)
    stress, p2o = F.col("behavior_stress_score"), F.col("payment_to_outstanding")
    kr, sr = F.col("ptp_kept_rate"), F.col("contact_success_rate")
    df = df.withColumns({
        "_pay": pay if pay is not None else SC.service_pay(stress, p2o),
        "_ptp": ptp if ptp is not None else SC.service_ptp(stress, kr, sr),
        "_rec": rec if rec is not None else SC.service_rec(stress, p2o),
    })
    df = df.withColumns({
        "payment_probability_30d": round_stable(F.col("_pay"), 4),
        "ptp_probability": round_stable(F.col("_ptp"), 4),
        "recovery_probability": round_stable(F.col("_rec"), 4),
        "collection_priority_score": SC.priority_service(F.col("_pay"), F.col("_ptp")),
    })
    df = df.withColumns({
        "priority_band": SC.band(F.col("collection_priority_score")),
        "next_best_action": AC.action_struct(F.col("payment_probability_30d"), F.col("ptp_probability")),
    })
    return df.drop("_pay", "_ptp", "_rec")


def score_basic(df: DataFrame) -> DataFrame:
    """Basic report rule set: F8 -> F11 -> F14 -> F16 -> F19."""
    df = df.withColumn("stress", FE.stress_basic())
    s = F.col("stress")
    df = df.withColumns({"payment_probability": SC.basic_pay(s), "ptp_probability": SC.basic_ptp(s),
                         "recovery_probability": SC.basic_rec(s)})
    pay, ptp = F.col("payment_probability"), F.col("ptp_probability")
    df = df.withColumn("priority_score", SC.priority_basic(pay, ptp))
    return df.withColumns({"priority": SC.band(F.col("priority_score")),
                           "next_best_action": AC.nba_basic(pay, ptp)})


def score_advanced(df: DataFrame, pay: Column | None = None, ptp: Column | None = None,
                   uplift: Column | None = None, recovery: Column | None = None) -> DataFrame:
    """Advanced rule set: probabilities (F11 scorecard or model columns), uplift (F31 or T-learner),
    F15 score, F17 band, F21 compliance flag."""
    df = df.withColumn("stress", FE.stress_basic())
    s = F.col("stress")
    df = df.withColumns({
        "payment_probability": pay if pay is not None else SC.basic_pay(s),
        "ptp_probability": ptp if ptp is not None else SC.basic_ptp(s),
        "uplift_score": uplift if uplift is not None else SC.uplift_rule(s),
    })
    rec = recovery if recovery is not None else clip(
        F.col("payment_probability") + F.col("uplift_score"), 0.02, 0.99)
    df = df.withColumns({
        "recovery_probability": rec,
        "priority_score": SC.priority_advanced(F.col("payment_probability"), F.col("uplift_score")),
        "compliance_flag": AC.compliance_flag(),
    })
    return df.withColumn("priority", SC.band_advanced(F.col("priority_score")))
