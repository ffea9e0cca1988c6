"""Portfolio reports: filters, KPIs, counts, histograms, rollups, top-k queues.

Every aggregate here is a hash aggregate with map-side partial combine, so a hot value (one band or
channel holding a third of the rows) costs one bigger partial buffer, never a skewed reducer.
Aggregated doubles are passed through ``round_stable(.., 9)`` so results do not depend on the order
partial sums are merged.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lit_d, round_stable
from ..schema import BANDS, BASIC_ACTIONS, CHANNELS

AGG_DP = 9


def mean(c: str | Column) -> Column:
    return round_stable(F.avg(c), AGG_DP)


def money_sum(c: str) -> Column:
    """Exact, order-independent money total (DECIMAL inside, DOUBLE out)."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def filter_portfolio(df: DataFrame, priorities: Sequence[str] = BANDS, min_dpd: int = 0,
                     channels: Sequence[str] = CHANNELS, segments: Sequence[str] | None = None,
                     priority_col: str = "priority") -> DataFrame:  # P3 / P4
    cond = F.col(priority_col).isin(list(priorities)) & (F.col("dpd") >= min_dpd) & \
        F.col("preferred_channel").isin(list(channels))
    if segments is not None:
        cond = cond & F.col("segment").isin(list(segments))
    return df.where(cond)


def kpi_basic(df: DataFrame) -> DataFrame:  # A1
    return df.agg(F.count(F.lit(1)).alias("customers"),
                  money_sum("outstanding_amount").alias("total_outstanding"),
                  F.count_if(F.col("priority") == "HIGH").alias("high_risk"),
                  mean("payment_probability").alias("avg_payment_probability"),
                  mean("recovery_probability").alias("avg_recovery_probability"))


def kpi_advanced(df: DataFrame) -> DataFrame:  # A2
    return df.agg(F.count(F.lit(1)).alias("customers"),
                  money_sum("outstanding_amount").alias("total_outstanding"),
                  F.count_if(F.col("priority") == "HIGH").alias("high_risk"),
                  mean("payment_probability").alias("avg_payment_probability"),
                  mean("uplift_score").alias("avg_uplift"),
                  F.count_if(F.col("compliance_flag") == "OVER LIMIT").alias("compliance_violations"))


def value_counts(df: DataFrame, col: str, name: str = "customers") -> DataFrame:  # A3 / A4 / A10
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(col))


def prediction_summary(df: DataFrame) -> DataFrame:  # A5: means as (metric, probability x100) rows
    m = df.agg(F.avg("payment_probability").alias("p"), F.avg("ptp_probability").alias("t"),
               F.avg("recovery_probability").alias("r"))
    return m.select(F.expr("stack(3, 'Payment Probability', p, 'PTP Probability', t, "
                           "'Recovery Probability', r) AS (metric, mean_probability)")) \
        .select("metric", round_stable(F.col("mean_probability") * lit_d(100), AGG_DP).alias("probability_pct"))


def segment_stats(df: DataFrame) -> DataFrame:  # A6
    return (df.groupBy("segment")
            .agg(F.count(F.lit(1)).alias("customers"), mean("dpd").alias("avg_dpd"),
                 mean("outstanding_amount").alias("avg_outstanding"),
                 mean("payment_probability").alias("avg_payment_prob"), mean("uplift_score").alias("avg_uplift"))
            .orderBy(F.col("avg_uplift").desc(), "segment"))


def segment_priority_rollup(df: DataFrame) -> DataFrame:  # A7 (sunburst feed)
    return (df.rollup("segment", "priority")
            .agg(money_sum("outstanding_amount").alias("outstanding"), F.grouping_id().alias("level")))


def fixed_width_histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int,
                          by: Sequence[str] = ()) -> DataFrame:  # A8 / A9 (Q13: fixed-width bins)
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(value) - lit_d(lo)) / lit_d(width)), F.lit(0)), F.lit(bins - 1))
    return (df.select(*by, b.cast("int").alias("bin"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_start", round_stable(lit_d(lo) + F.col("bin") * lit_d(width), 6)))


def compliance_summary(df: DataFrame) -> DataFrame:  # A11 (Q12: guarded share)
    return (df.agg(F.count_if(F.col("compliance_flag") == "OVER LIMIT").alias("violations"),
                   F.count(F.lit(1)).alias("customers"))
            .withColumn("violation_share",
                        round_stable(F.try_divide(F.col("violations").cast("double"), F.col("customers")), AGG_DP)))


def filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:  # A12
    parts = [df.select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).distinct() for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("field", "value")


def domain_counts(df: DataFrame, col: str, domain: Sequence[str], value: str | None = None) -> DataFrame:
    """J6 + A14: counts (and a mean that is 0 on no rows) for a fixed label list, zeros included.

    The domain is a literal list (bounded by its length), so it is joined by broadcast.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias("m"))
    counts = df.groupBy(col).agg(*aggs)
    dom = (df.sparkSession.range(1)
           .select(F.posexplode(F.array(*[F.lit(v) for v in domain])).alias("domain_order", col)))
    out = counts.join(F.broadcast(dom), col, "right").select(
        "domain_order", col, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("customers"))
    if value:
        out = out.join(counts.select(col, "m"), col, "left").select(
            "domain_order", col, "customers", round_stable(F.coalesce(F.col("m"), lit_d(0.0)), AGG_DP)
            .alias("mean_or_zero"))
    return out.orderBy("domain_order")


def top_k(df: DataFrame, score: str, k: int, cols: Sequence[str], tie: str = "customer_id") -> DataFrame:
    """L1 / L2: orderBy + limit plans as TakeOrderedAndProject (per-partition top-k, then merge)."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k).select(*cols)


def percent_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:  # P8
    return df.withColumns({c: F.col(c) * lit_d(100) for c in cols})


def sample_accounts(df: DataFrame, n: int, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """L4: min(n, rows) rows without replacement, repeatable: the n smallest md5(key || seed)."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(str(seed)))), F.col(key)).limit(n)


def customer_360(df: DataFrame, customer_id: str, cols: Sequence[str]) -> DataFrame:  # P5 (Q9: empty if absent)
    return df.where(F.col("customer_id") == customer_id).select(*cols)


def compliance_violations(df: DataFrame) -> DataFrame:  # P6
    return (df.where(F.col("compliance_flag") == "OVER LIMIT")
            .select("customer_id", "segment", "contacts_last_7_days", "priority", "preferred_channel")
            .orderBy(F.col("contacts_last_7_days").desc(), "customer_id"))


def payload_cast(df: DataFrame) -> DataFrame:  # P7: coerce a scored row to API types
    ints = ["age", "dpd", "missed_payment_count", "previous_ptp_count", "previous_ptp_kept_count",
            "collection_attempts", "successful_contacts", "days_since_last_payment"]
    dbls = ["income", "loan_amount", "outstanding_amount", "emi_amount", "credit_score", "recent_payment_amount"]
    strs = ["customer_id", "customer_name", "due_date", "preferred_channel"]
    return df.select(*[F.col(c).cast("string").alias(c) for c in strs],
                     *[F.expr(f"try_cast({c} AS INT)").alias(c) for c in ints],
                     *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in dbls])


BASIC_ACTION_DOMAIN = BASIC_ACTIONS
