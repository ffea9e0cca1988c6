"""Reminder text (G1-G5): prompt rendering, template fallback, tone validation, outcome routing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_stable
from ..schema import TONES

DEFAULT_TONE = "professional"
# ---- fixed values: prompt and fallback templates ----
PROMPT = ("\nWrite a short, respectful repayment reminder.\n\n"
          "Customer name: %s\nCustomer ID: %s\nOutstanding amount: INR %s\nEMI amount: INR %s\n"
          "Due date: %s\nDays past due: %s\nRecommended action: %s\nPreferred channel: %s\nTone: %s\n\n"
          "Requirements:\n- Address the customer by name.\n- Mention the correct outstanding amount.\n"
          "- Mention the due date and days past due.\n- Ask the customer to contact the authorised collection team.\n"
          "- Do not threaten or shame the customer.\n- Do not invent legal action or discounts.\n"
          "- Return only the final message.\n")
FALLBACK = ("Dear %s, this is a friendly reminder regarding your outstanding amount of INR %s. "
            "Your account is currently %s days past due. Please contact our authorised collection team "
            "to discuss your repayment options. Thank you.")
RATE_LIMIT_MARKERS = ["429", "RESOURCE_EXHAUSTED"]
# ---- end fixed values ----


def inr(c: Column) -> Column:
    """``#,##0.00`` on the 2-dp value (pre-rounded so no half-way ties reach the formatter)."""
    return F.format_number(round_stable(c, 2), 2)


def tone_validation(requested: Column) -> tuple[Column, Column]:  # G3
    """(effective tone, valid flag): missing -> professional; unknown -> invalid with NULL tone."""
    t = F.coalesce(requested, F.lit(DEFAULT_TONE))
    ok = t.isin(TONES)
    return F.when(ok, t), ok


def message_prompt(action: Column, tone: Column) -> Column:  # G1
    return F.format_string(PROMPT, F.col("customer_name"), F.col("customer_id"), inr(F.col("outstanding_amount")),
                           inr(F.col("emi_amount")), F.col("due_date"), F.col("dpd").cast("string"), action,
                           F.col("preferred_channel"), tone)


def message_fallback() -> Column:  # G2
    return F.format_string(FALLBACK, F.col("customer_name"), inr(F.col("outstanding_amount")),
                           F.col("dpd").cast("string"))


def message_outcome(text: Column, error: Column) -> tuple[Column, Column, Column]:  # G4
    """(status, source, message): usable text -> llm; rate-limit error -> template; otherwise failed."""
    has_text = text.isNotNull() & (F.trim(text) != "")
    limited = F.lit(False)
    for m in RATE_LIMIT_MARKERS:
        limited = limited | F.coalesce(error.contains(m), F.lit(False))
    status = F.when(has_text, F.lit("ok")).when(limited, F.lit("fallback")).otherwise(F.lit("failed"))
    source = F.when(has_text, F.lit("llm")).when(limited, F.lit("template"))
    message = F.when(has_text, F.trim(text)).when(limited, message_fallback())
    return status, source, message


def message_record(df: DataFrame) -> DataFrame:  # G5 (Q6: the source column tells the truth)
    return df.select("customer_id", "customer_name",
                     F.struct(F.col("next_best_action.action").alias("action"),
                              F.col("next_best_action.recommended_channel").alias("recommended_channel"),
                              F.col("next_best_action.reason").alias("reason")).alias("action"),
                     F.col("message_source"), F.col("message"))
