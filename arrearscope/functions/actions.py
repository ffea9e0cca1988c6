"""Next-best-action chains, compliance tests and reason text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_CONTACTS_7_DAYS, QUIET_HOURS_END, QUIET_HOURS_START
from .numeric import lit_d, round_stable

# ---- fixed values: action strings ----
SERVICE_ACTIONS = ["SEND_STANDARD_PAYMENT_REMINDER", "REQUEST_AND_CONFIRM_PROMISE_TO_PAY",
                   "OFFER_REPAYMENT_PLAN_DISCUSSION", "ESCALATE_FOR_HUMAN_REVIEW",
                   "COLLECTION_CALL_AND_HARDSHIP_ASSESSMENT"]
ADVANCED_ACTIONS = ["Escalate to Human Review",
                    "Light-touch reminder only (low marginal value of contact)",
                    "Request Promise-to-Pay", "Repayment / Restructuring Discussion"]
CAP_REASON = "Contact cap reached (%d/%d in 7 days)"
QUIET_REASON = "Outside permitted contact hours"
# ---- end fixed values ----


def nba_service(pay4: Column, ptp4: Column) -> Column:  # F18, on probabilities rounded to 4 dp
    dpd = F.col("dpd")
    return (F.when(dpd == 0, F.lit(SERVICE_ACTIONS[0]))
            .when(ptp4 >= lit_d(0.65), F.lit(SERVICE_ACTIONS[1]))
            .when(pay4 >= lit_d(0.55), F.lit(SERVICE_ACTIONS[2]))
            .when(dpd >= 90, F.lit(SERVICE_ACTIONS[3]))
            .otherwise(F.lit(SERVICE_ACTIONS[4])))


def reason_service(pay4: Column, ptp4: Column) -> Column:  # F26 service wording
    return F.format_string("DPD=%s; payment=%s; PTP=%s.", F.col("dpd").cast("string"),
                           plain_decimal(pay4), plain_decimal(ptp4))


def plain_decimal(x4: Column) -> Column:
    """A value of 4 decimals without an exponent and trailing zeros, at least one decimal: 0.5, 1.0, 0.0005."""
    return F.regexp_replace(x4.cast("decimal(20,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def action_struct(pay4: Column, ptp4: Column) -> Column:
    return F.struct(nba_service(pay4, ptp4).alias("action"),
                    F.col("preferred_channel").alias("recommended_channel"),  # F24
                    reason_service(pay4, ptp4).alias("reason"))


def nba_basic(pay: Column, ptp: Column) -> Column:  # F19
    return (F.when(F.col("dpd") >= 90, F.lit("Human Review"))
            .when(ptp >= lit_d(0.65), F.lit("Request PTP"))
            .when(pay >= lit_d(0.60), F.lit("Repayment Discussion"))
            .otherwise(F.lit("Collection Call")))


def compliance_flag(contacts: Column | None = None) -> Column:  # F21
    c = contacts if contacts is not None else F.col("contacts_last_7_days")
    return F.when(c >= MAX_CONTACTS_7_DAYS, F.lit("OVER LIMIT")).otherwise(F.lit("OK"))


def quiet_hours(ts: Column, tz: str | None = None) -> Column:  # 21:00-08:00 wraps midnight
    local = F.from_utc_timestamp(ts, tz) if tz else ts
    h = F.hour(local)
    return (h >= QUIET_HOURS_START) | (h < QUIET_HOURS_END)


def blocked_reason(flag: Column, contacts: Column, in_quiet: Column) -> Column:  # F22
    return (F.when(flag == "OVER LIMIT",
                   F.format_string(CAP_REASON, contacts.cast("int"), F.lit(MAX_CONTACTS_7_DAYS)))
            .when(in_quiet, F.lit(QUIET_REASON)))


def nba_advanced(blocked: Column, uplift: Column, ptp: Column) -> Column:  # F20; NULL when blocked
    return (F.when(blocked.isNotNull(), F.lit(None).cast("string"))
            .when(F.col("dpd") >= 90, F.lit(ADVANCED_ACTIONS[0]))
            .when(uplift < lit_d(0.02), F.lit(ADVANCED_ACTIONS[1]))
            .when(ptp >= lit_d(0.6), F.lit(ADVANCED_ACTIONS[2]))
            .otherwise(F.lit(ADVANCED_ACTIONS[3])))


def pct0(c: Column) -> Column:
    return F.format_string("%.0f", round_stable(c * lit_d(100), 0))


def pct1(c: Column) -> Column:
    return F.format_string("%.1f", round_stable(c * lit_d(100), 1))


def signed_pts(c: Column) -> Column:
    return F.format_string("%+.1f", round_stable(c * lit_d(100), 1))


def reason_basic(pay: Column, ptp: Column) -> Column:  # F26 basic wording
    return F.format_string("DPD = %s days, Payment Probability = %s%%, PTP Probability = %s%%.",
                           F.col("dpd").cast("string"), pct1(pay), pct1(ptp))


def reason_advanced(pay: Column, ptp: Column, uplift: Column) -> Column:  # F26 advanced wording
    return F.format_string("DPD=%sd, PayProb=%s%%, PTPProb=%s%%, Uplift=%spts",
                           F.col("dpd").cast("string"), pct0(pay), pct0(ptp), signed_pts(uplift))


def severity_label(band_col: Column) -> Column:  # F27
    return (F.when(band_col == "HIGH", F.lit("error")).when(band_col == "MEDIUM", F.lit("warning"))
            .otherwise(F.lit("success")))
