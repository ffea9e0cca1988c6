"""Contact-frequency cap and quiet hours (W4, F21-F23) over a contact-event log.

W4 counts, for every contact, the same customer's contacts in the trailing 7 days (RANGE frame:
current row and ties included). A ``PARTITION BY user`` window would send a customer holding a
third of all contacts to one task, so the count is rebuilt from prefix sums that split freely:

    contacts_7d(t) = #contacts with ts <= t  -  #contacts with ts <= t - 7d - 1us

Each contact also emits a zero-weight probe at t - 7d - 1us. Rows are partitioned by
(user, hour bucket); inside a bucket an inclusive RANGE running sum gives the count up to the row,
and a per-user prefix sum over bucket totals (one row per user-hour) adds everything earlier. The
event and its probe meet again on (event, user, time); copies of one event count and stay as often as
they occur. The largest task is one customer-hour.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.actions import blocked_reason, compliance_flag, quiet_hours
from ..schema import MAX_CONTACTS_7_DAYS

CONTACT_TYPES = ["view", "click", "error"]
WINDOW_DAYS = 7
BUCKET_SECONDS = 3600


def contact_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(CONTACT_TYPES)).select("event_id", "user_id", "ts")


def contacts_trailing(ev: DataFrame, days: int = WINDOW_DAYS, user: str = "user_id", ts: str = "ts",
                      bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``contacts_7d`` (BIGINT) and ``over_cap`` to each event row (exact RANGE-frame count)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = days * 86400 * 1_000_000
    base = ev.select("event_id", user, ts, us.alias("_p"))
    rows = base.select("event_id", user, ts, "_p", F.lit(1).alias("_v")) \
        .unionByName(base.select("event_id", user, ts, (F.col("_p") - span - 1).alias("_p"), F.lit(0).alias("_v")))
    rows = rows.withColumn("_b", F.floor(F.col("_p") / F.lit(bucket_seconds * 1_000_000)).cast("bigint"))
    w_in = Window.partitionBy(user, "_b").orderBy("_p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.sum("_v").over(w_in))
    sizes = rows.groupBy(user, "_b").agg(F.sum("_v").alias("_n"))
    w_off = Window.partitionBy(user).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    le = rows.join(offs, [user, "_b"]).withColumn("_le", F.col("_off") + F.col("_in"))
    # event row (_v = 1) minus its probe (_v = 0): one aggregation, no self-join; equal events have equal
    # counts, so the sum over them is a multiple of their number, and each comes out once
    both = le.groupBy("event_id", user, ts).agg(
        F.sum(F.when(F.col("_v") == 1, F.col("_le")).otherwise(-F.col("_le"))).alias("_sum"),
        F.sum("_v").cast("int").alias("_copies"))
    return (both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select("event_id", user, ts, F.expr("_sum div _copies").cast("bigint").alias("contacts_7d"))
            .withColumn("over_cap", F.col("contacts_7d") >= MAX_CONTACTS_7_DAYS))


def guardrail(ev_counted: DataFrame, tz: str | None = None) -> DataFrame:
    """F21-F23 per contact event: flag, quiet-hour test and the veto reason (NULL = allowed)."""
    flag = compliance_flag(F.col("contacts_7d"))
    q = quiet_hours(F.col("ts"), tz)
    return ev_counted.withColumns({"compliance_flag": flag, "in_quiet_hours": q}).withColumn(
        "blocked_reason", blocked_reason(F.col("compliance_flag"), F.col("contacts_7d"), F.col("in_quiet_hours")))
