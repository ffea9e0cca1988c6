"""One registered query per scalar rule of SURVEY §2.3 (F1-F8, F12-F20, F22, F24, F29, F31) and P2,
each a projection of the rule's output over the whole portfolio, with its SQL twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as AC
from ..functions import scorecards as SC
from ..schema import SERVICE_FEATURES
from ..sources.portfolio import portfolio
from . import oracle as O
from .catalog import register
from .report_queries import advanced, basic
from .scoring import score_service


def _service(spark, sf_dir):
    return score_service(portfolio(spark, sf_dir))


def _project(key, builder, cols, sql):
    """``cols``: column names, or a zero-argument callable building Columns at run time (no Spark
    context exists when this module is imported)."""
    def q(spark, sf_dir):
        c = cols() if callable(cols) else cols
        return builder(spark, sf_dir).select("customer_id", *c)
    q.__name__ = f"q_{key}"
    register(key, sql)(q)


for key in ["ptp_kept_rate", "contact_success_rate", "outstanding_to_income", "emi_to_income",
            "payment_to_outstanding", "dpd_bucket", "behavior_stress_score"]:  # F1-F7
    _project(key, _service, [key], O.service_sql(f"SELECT customer_id, {key} FROM scored_service"))

_project("feature_projection", _service, SERVICE_FEATURES,  # P2: the 21 model inputs in fixed order
         O.service_sql("SELECT customer_id, " + ", ".join(SERVICE_FEATURES) + " FROM scored_service"))
_project("stress_basic", basic, ["stress"], O.basic_sql("SELECT customer_id, stress FROM scored_basic"))  # F8
_project("priority_service", _service, ["collection_priority_score"],  # F13 (+F29 rounding)
         O.service_sql("SELECT customer_id, collection_priority_score FROM scored_service"))
_project("score_rounding", _service, ["payment_probability_30d", "ptp_probability", "recovery_probability",
                                      "collection_priority_score"],  # F29
         O.service_sql("SELECT customer_id, payment_probability_30d, ptp_probability, recovery_probability, "
                       "collection_priority_score FROM scored_service"))
_project("priority_band", _service, ["priority_band"],  # F16
         O.service_sql("SELECT customer_id, priority_band FROM scored_service"))
_project("nba_service", _service, lambda: [F.col("next_best_action.action").alias("action")],  # F18
         O.service_sql("SELECT customer_id, action FROM scored_service"))
_project("recommended_channel", _service,  # F24
         lambda: [F.col("next_best_action.recommended_channel").alias("recommended_channel")],
         O.service_sql("SELECT customer_id, preferred_channel AS recommended_channel FROM scored_service"))
_project("priority_basic", basic, ["priority_score"], O.basic_sql("SELECT customer_id, priority_score FROM scored_basic"))
_project("nba_basic", basic, ["next_best_action"], O.basic_sql("SELECT customer_id, next_best_action FROM scored_basic"))
_project("priority_advanced", advanced, ["priority_score"],  # F15
         O.advanced_sql("SELECT customer_id, priority_score FROM scored_advanced"))
_project("priority_band_advanced", advanced, ["priority"],  # F17
         O.advanced_sql("SELECT customer_id, priority FROM scored_advanced"))
_project("uplift_rule", advanced, ["uplift_score"], O.advanced_sql("SELECT customer_id, uplift_score FROM scored_advanced"))


@register("exposure", O.portfolio_sql(f"""
SELECT customer_id, least({O.INCOME_RATIO}, 2.0e0) / 2.0e0 AS exposure_service, least({O.INCOME_RATIO}, 1.0e0) AS exposure_capped
FROM portfolio"""))
def q_exposure(spark, sf_dir):  # F12
    return portfolio(spark, sf_dir).select(
        "customer_id", SC.exposure_service().alias("exposure_service"), SC.exposure_capped().alias("exposure_capped"))


BLOCK_ACC = ("CASE WHEN compliance_flag = 'OVER LIMIT' THEN printf('Contact cap reached (%d/7 in 7 days)', "
             "contacts_last_7_days) END")


@register("blocked_reason", O.advanced_sql(f"SELECT customer_id, {BLOCK_ACC} AS blocked_reason FROM scored_advanced"))
def q_blocked_reason(spark, sf_dir):  # F22 per account, outside quiet hours
    a = advanced(spark, sf_dir)
    return a.select("customer_id", AC.blocked_reason(F.col("compliance_flag"), F.col("contacts_last_7_days"),
                                                     F.lit(False)).alias("blocked_reason"))


@register("nba_advanced", O.advanced_sql(f"""
SELECT customer_id, CASE WHEN ({BLOCK_ACC}) IS NOT NULL THEN NULL WHEN dpd >= 90 THEN 'Escalate to Human Review'
  WHEN uplift_score < 0.02e0 THEN 'Light-touch reminder only (low marginal value of contact)'
  WHEN ptp_probability >= 0.6e0 THEN 'Request Promise-to-Pay' ELSE 'Repayment / Restructuring Discussion' END AS action
FROM scored_advanced"""))
def q_nba_advanced(spark, sf_dir):  # F20 per account (blocked accounts get no action)
    a = advanced(spark, sf_dir)
    why = AC.blocked_reason(F.col("compliance_flag"), F.col("contacts_last_7_days"), F.lit(False))
    return a.select("customer_id", AC.nba_advanced(why, F.col("uplift_score"), F.col("ptp_probability")).alias("action"))
