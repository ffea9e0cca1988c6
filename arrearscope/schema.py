"""Typed schemas and the fixed domain values the rules depend on."""
from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the reference's for identical results) ----
CHANNELS = ["PHONE", "SMS", "WHATSAPP", "EMAIL"]
TONES = ["professional", "empathetic", "concise"]
BANDS = ["HIGH", "MEDIUM", "LOW"]
DPD_LADDER = [0, 5, 15, 30, 45, 60, 90, 120, 180]
BASIC_ACTIONS = ["Human Review", "Request PTP", "Repayment Discussion", "Collection Call"]
SEGMENT_LABELS = ["High-Value Responders", "Steady Self-Payers", "Needs Restructuring", "Hard-to-Recover"]
MAX_CONTACTS_7_DAYS = 7
QUIET_HOURS_START, QUIET_HOURS_END = 21, 8
# ---- end fixed values ----

# Service model input: 21 features in fixed order.
SERVICE_FEATURES = [
    "age", "income", "loan_amount", "outstanding_amount", "emi_amount", "credit_score",
    "dpd", "missed_payment_count", "previous_ptp_count", "previous_ptp_kept_count",
    "collection_attempts", "successful_contacts", "recent_payment_amount",
    "days_since_last_payment", "ptp_kept_rate", "contact_success_rate",
    "outstanding_to_income", "emi_to_income", "payment_to_outstanding",
    "dpd_bucket", "behavior_stress_score",
]
# Advanced models: the 14 raw columns.
RAW_FEATURES = SERVICE_FEATURES[:14]
CLUSTER_FEATURES = ["dpd", "missed_payment_count", "days_since_last_payment",
                    "outstanding_amount", "uplift_score", "payment_probability"]

INT_FIELDS = ["age", "dpd", "missed_payment_count", "previous_ptp_count", "previous_ptp_kept_count",
              "collection_attempts", "successful_contacts", "days_since_last_payment"]
DOUBLE_FIELDS = ["income", "loan_amount", "outstanding_amount", "emi_amount", "credit_score",
                 "recent_payment_amount"]

ACCOUNT = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("due_date", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("outstanding_amount", T.DoubleType()),
    T.StructField("emi_amount", T.DoubleType()),
    T.StructField("credit_score", T.DoubleType()),
    T.StructField("dpd", T.IntegerType()),
    T.StructField("missed_payment_count", T.IntegerType()),
    T.StructField("previous_ptp_count", T.IntegerType()),
    T.StructField("previous_ptp_kept_count", T.IntegerType()),
    T.StructField("collection_attempts", T.IntegerType()),
    T.StructField("successful_contacts", T.IntegerType()),
    T.StructField("recent_payment_amount", T.DoubleType()),
    T.StructField("days_since_last_payment", T.IntegerType()),
    T.StructField("preferred_channel", T.StringType()),
])
ACCOUNT_COLUMNS = [f.name for f in ACCOUNT.fields]

PORTFOLIO_EXTRA = T.StructType([
    T.StructField("contacts_last_7_days", T.IntegerType()),
    T.StructField("treatment", T.IntegerType()),
    T.StructField("will_pay", T.IntegerType()),
    T.StructField("ptp_kept", T.IntegerType()),
    T.StructField("recovery_success", T.IntegerType()),
    T.StructField("did_pay_last_cycle", T.IntegerType()),
    T.StructField("kept_ptp_last_cycle", T.IntegerType()),
    T.StructField("segment_raw", T.IntegerType()),
])

CHUNK = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

MESSAGE_REQUEST = T.StructType([
    T.StructField("customer", ACCOUNT),
    T.StructField("tone", T.StringType()),
])

CONTACT_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("segment", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("outcome", T.IntegerType()),
])
