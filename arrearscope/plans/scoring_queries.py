"""Registered queries: portfolio scan, validation, feature and scorecard rules, flagship queue."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import is_valid, with_reasons
from ..schema import ACCOUNT_COLUMNS
from ..sources.portfolio import portfolio, training_portfolio
from . import oracle as O
from .catalog import register
from .scoring import score_advanced, score_basic, score_service

PORTFOLIO_COLS = ACCOUNT_COLUMNS + ["contacts_last_7_days", "treatment", "will_pay", "ptp_kept",
                                    "recovery_success", "did_pay_last_cycle", "kept_ptp_last_cycle",
                                    "segment_raw"]


def flagship(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """S1 -> P1 -> F1-F7 -> F10 -> F13 -> F16 -> F18 -> L1: the k accounts to work first."""
    valid = portfolio(spark, sf_dir).where(is_valid())
    s = score_service(valid)
    return (s.orderBy(F.col("collection_priority_score").desc(), F.col("customer_id"))
            .limit(k)
            .select("customer_id", "dpd", "outstanding_amount", "payment_probability_30d", "ptp_probability",
                    "recovery_probability", "collection_priority_score", "priority_band",
                    F.col("next_best_action.action").alias("action"), "preferred_channel"))


register("priority_queue_service", O.service_sql("""
SELECT customer_id, dpd, outstanding_amount, payment_probability_30d, ptp_probability, recovery_probability,
  collection_priority_score, priority_band, action, preferred_channel
FROM scored_service ORDER BY collection_priority_score DESC, customer_id LIMIT 50"""))(flagship)


@register("portfolio_scan", O.training_sql("SELECT " + ", ".join(PORTFOLIO_COLS) + " FROM portfolio"))
def q_portfolio_scan(spark, sf_dir):
    return training_portfolio(spark, sf_dir).select(*PORTFOLIO_COLS)


def _validate_sql() -> str:
    conds = [(f"missing {c}", f"{c} IS NULL") for c in ("customer_id", "customer_name", "due_date")]
    conds += [("age not in [18, 100]", "age IS NULL OR age < 18 OR age > 100"),
              ("credit_score not in [300, 900]", "credit_score IS NULL OR credit_score < 300 OR credit_score > 900")]
    conds += [(f"{c} < 0", f"{c} IS NULL OR {c} < 0") for c in (
        "income", "loan_amount", "outstanding_amount", "emi_amount", "dpd", "missed_payment_count",
        "previous_ptp_count", "previous_ptp_kept_count", "collection_attempts", "successful_contacts",
        "recent_payment_amount", "days_since_last_payment")]
    conds += [("preferred_channel not in (PHONE, SMS, WHATSAPP, EMAIL)",
               "preferred_channel IS NULL OR preferred_channel NOT IN ('PHONE', 'SMS', 'WHATSAPP', 'EMAIL')")]
    n = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in conds)
    txt = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in conds)
    return O.portfolio_sql(f"SELECT customer_id, CAST({n} AS BIGINT) AS n_reasons, concat_ws(';', {txt}) AS reasons,"
                           f" ({n}) = 0 AS is_valid FROM portfolio")


@register("validate_accounts", _validate_sql())
def q_validate(spark, sf_dir):
    r = with_reasons(portfolio(spark, sf_dir))
    return r.select("customer_id", F.size("reasons").cast("bigint").alias("n_reasons"),
                    F.array_join("reasons", ";").alias("reasons"),
                    (F.size("reasons") == 0).alias("is_valid"))


SERVICE_FEATURE_COLS = ["customer_id", "ptp_kept_rate", "contact_success_rate", "outstanding_to_income",
                        "emi_to_income", "payment_to_outstanding", "dpd_bucket", "behavior_stress_score"]


@register("service_features", O.service_sql("SELECT " + ", ".join(SERVICE_FEATURE_COLS) + " FROM scored_service"))
def q_service_features(spark, sf_dir):
    return score_service(portfolio(spark, sf_dir)).select(*SERVICE_FEATURE_COLS)


SERVICE_SCORE_COLS = ["customer_id", "payment_probability_30d", "ptp_probability", "recovery_probability",
                      "collection_priority_score", "priority_band"]


@register("scorecard_service", O.service_sql(
    "SELECT " + ", ".join(SERVICE_SCORE_COLS) + ", action, preferred_channel AS recommended_channel, reason"
    " FROM scored_service"))
def q_scorecard_service(spark, sf_dir):
    s = score_service(portfolio(spark, sf_dir))
    return s.select(*SERVICE_SCORE_COLS, "next_best_action.action", "next_best_action.recommended_channel",
                    "next_best_action.reason")


BASIC_COLS = ["customer_id", "stress", "payment_probability", "ptp_probability", "recovery_probability",
              "priority_score", "priority", "next_best_action"]


@register("scorecard_basic", O.basic_sql("SELECT " + ", ".join(BASIC_COLS) + " FROM scored_basic"))
def q_scorecard_basic(spark, sf_dir):
    return score_basic(portfolio(spark, sf_dir)).select(*BASIC_COLS)


ADV_COLS = ["customer_id", "stress", "payment_probability", "ptp_probability", "uplift_score",
            "recovery_probability", "priority_score", "priority", "compliance_flag"]


@register("scorecard_advanced", O.advanced_sql("SELECT " + ", ".join(ADV_COLS) + " FROM adv_r"))
def q_scorecard_advanced(spark, sf_dir):
    return score_advanced(portfolio(spark, sf_dir)).select(*ADV_COLS)
