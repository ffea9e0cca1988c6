"""Registered report queries over the basic and advanced scored portfolios."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as AC
from ..functions.features import cap_ptp_kept
from ..functions.numeric import lit_d, round_stable
from ..operators import reports as R
from ..operators import segments as SG
from ..schema import BASIC_ACTIONS, BANDS, CHANNELS, CLUSTER_FEATURES
from ..sources.portfolio import portfolio
from . import oracle as O
from .catalog import register
from .scoring import score_advanced, score_basic

SCORE_W = 100.0 / 30
UP_W = 2.0 / 40


def basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_basic(portfolio(spark, sf_dir))


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advanced rule scores with segments labelled from the given clusters (segment_raw)."""
    return SG.label_segments(score_advanced(portfolio(spark, sf_dir)))


def m9(x: str) -> str:
    return O.rs(x, 9)


# ---------------- basic report ----------------
@register("kpi_basic", O.basic_sql(f"""
SELECT count(*) AS customers, CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_outstanding,
  count(*) FILTER (WHERE priority = 'HIGH') AS high_risk,
  {m9('avg(payment_probability)')} AS avg_payment_probability,
  {m9('avg(recovery_probability)')} AS avg_recovery_probability
FROM scored_basic"""))
def q_kpi_basic(spark, sf_dir):
    return R.kpi_basic(basic(spark, sf_dir))


@register("priority_counts", O.basic_sql(
    "SELECT priority, count(*) AS customers FROM scored_basic GROUP BY priority"))
def q_priority_counts(spark, sf_dir):
    return R.value_counts(basic(spark, sf_dir), "priority")


@register("action_counts", O.basic_sql(
    "SELECT next_best_action, count(*) AS customers FROM scored_basic GROUP BY next_best_action"))
def q_action_counts(spark, sf_dir):
    return R.value_counts(basic(spark, sf_dir), "next_best_action")


@register("prediction_summary", O.basic_sql(f"""
SELECT metric, {m9('m * 100.0e0')} AS probability_pct FROM (
  SELECT 'Payment Probability' AS metric, avg(payment_probability) AS m FROM scored_basic
  UNION ALL SELECT 'PTP Probability', avg(ptp_probability) FROM scored_basic
  UNION ALL SELECT 'Recovery Probability', avg(recovery_probability) FROM scored_basic)"""))
def q_prediction_summary(spark, sf_dir):
    return R.prediction_summary(basic(spark, sf_dir))


PQ_BASIC = ["customer_id", "dpd", "outstanding_amount", "payment_probability", "ptp_probability",
            "recovery_probability", "priority_score", "priority", "next_best_action", "preferred_channel"]


@register("priority_queue", O.basic_sql(f"""
SELECT customer_id, dpd, outstanding_amount, payment_probability * 100.0e0 AS payment_probability,
  ptp_probability * 100.0e0 AS ptp_probability, recovery_probability * 100.0e0 AS recovery_probability,
  priority_score, priority, next_best_action, preferred_channel
FROM scored_basic ORDER BY priority_score DESC, customer_id LIMIT 50"""))
def q_priority_queue(spark, sf_dir):  # L1 + P8
    top = R.top_k(basic(spark, sf_dir), "priority_score", 50, PQ_BASIC)
    return R.percent_scale(top, ["payment_probability", "ptp_probability", "recovery_probability"])


@register("percent_scale", O.basic_sql("""
SELECT customer_id, payment_probability * 100.0e0 AS payment_pct, ptp_probability * 100.0e0 AS ptp_pct,
  recovery_probability * 100.0e0 AS recovery_pct FROM scored_basic"""))
def q_percent_scale(spark, sf_dir):  # P8
    s = R.percent_scale(basic(spark, sf_dir), ["payment_probability", "ptp_probability", "recovery_probability"])
    return s.select("customer_id", F.col("payment_probability").alias("payment_pct"),
                    F.col("ptp_probability").alias("ptp_pct"), F.col("recovery_probability").alias("recovery_pct"))


FILTER_P3 = dict(priorities=["HIGH", "MEDIUM"], min_dpd=30, channels=["PHONE", "SMS", "EMAIL"])


@register("filter_portfolio", O.basic_sql("""
SELECT customer_id, priority, dpd, preferred_channel, priority_score FROM scored_basic
WHERE priority IN ('HIGH', 'MEDIUM') AND dpd >= 30 AND preferred_channel IN ('PHONE', 'SMS', 'EMAIL')"""))
def q_filter_portfolio(spark, sf_dir):  # P3
    return R.filter_portfolio(basic(spark, sf_dir), **FILTER_P3).select(
        "customer_id", "priority", "dpd", "preferred_channel", "priority_score")


C360_ID = "C1007"
C360_BASIC = ["customer_id", "customer_name", "age", "income", "credit_score", "loan_amount", "due_date",
              "outstanding_amount", "emi_amount", "dpd", "payment_probability", "ptp_probability",
              "recovery_probability", "priority_score", "priority", "next_best_action", "preferred_channel"]


@register("customer_360", O.basic_sql(
    "SELECT " + ", ".join(C360_BASIC) + f" FROM scored_basic WHERE customer_id = '{C360_ID}'"))
def q_customer_360(spark, sf_dir):  # P5 basic
    return R.customer_360(basic(spark, sf_dir), C360_ID, C360_BASIC)


DOMAIN_SQL_BANDS = " UNION ALL ".join(f"SELECT {i} AS domain_order, '{b}' AS priority" for i, b in enumerate(BANDS))
DOMAIN_SQL_ACTIONS = " UNION ALL ".join(
    f"SELECT {i} AS domain_order, '{b}' AS next_best_action" for i, b in enumerate(BASIC_ACTIONS))


@register("domain_completion", O.basic_sql(f"""
SELECT 'priority' AS field, d.priority AS value, CAST(count(s.customer_id) AS BIGINT) AS customers
FROM ({DOMAIN_SQL_BANDS}) d LEFT JOIN (SELECT * FROM scored_basic WHERE dpd >= 90) s ON s.priority = d.priority
GROUP BY d.priority
UNION ALL
SELECT 'next_best_action', d.next_best_action, CAST(count(s.customer_id) AS BIGINT)
FROM ({DOMAIN_SQL_ACTIONS}) d LEFT JOIN (SELECT * FROM scored_basic WHERE dpd >= 90) s
  ON s.next_best_action = d.next_best_action
GROUP BY d.next_best_action"""))
def q_domain_completion(spark, sf_dir):  # J6: fixed label lists, zeros included (dpd >= 90 leaves empty labels)
    s = basic(spark, sf_dir).where(F.col("dpd") >= 90)
    a = R.domain_counts(s, "priority", BANDS).select(F.lit("priority").alias("field"),
                                                     F.col("priority").alias("value"), "customers")
    b = R.domain_counts(s, "next_best_action", BASIC_ACTIONS).select(
        F.lit("next_best_action").alias("field"), F.col("next_best_action").alias("value"), "customers")
    return a.unionByName(b)


DOMAIN_SQL_CHANNELS = " UNION ALL ".join(
    f"SELECT {i} AS domain_order, '{c}' AS preferred_channel" for i, c in enumerate(CHANNELS))


@register("mean_or_zero", O.basic_sql(f"""
SELECT d.preferred_channel, CAST(count(s.customer_id) AS BIGINT) AS customers,
  {m9('coalesce(avg(s.payment_probability), 0.0e0)')} AS mean_or_zero
FROM ({DOMAIN_SQL_CHANNELS}) d LEFT JOIN (SELECT * FROM scored_basic WHERE priority = 'HIGH') s
  ON s.preferred_channel = d.preferred_channel
GROUP BY d.preferred_channel"""))
def q_mean_or_zero(spark, sf_dir):  # A14
    s = basic(spark, sf_dir).where(F.col("priority") == "HIGH")
    return R.domain_counts(s, "preferred_channel", CHANNELS, value="payment_probability").drop("domain_order")


@register("payload_cast", O.basic_sql("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(customer_name AS VARCHAR) AS customer_name,
  CAST(due_date AS VARCHAR) AS due_date, CAST(preferred_channel AS VARCHAR) AS preferred_channel,
  TRY_CAST(age AS INTEGER) AS age, TRY_CAST(dpd AS INTEGER) AS dpd,
  TRY_CAST(missed_payment_count AS INTEGER) AS missed_payment_count,
  TRY_CAST(previous_ptp_count AS INTEGER) AS previous_ptp_count,
  TRY_CAST(previous_ptp_kept_count AS INTEGER) AS previous_ptp_kept_count,
  TRY_CAST(collection_attempts AS INTEGER) AS collection_attempts,
  TRY_CAST(successful_contacts AS INTEGER) AS successful_contacts,
  TRY_CAST(days_since_last_payment AS INTEGER) AS days_since_last_payment,
  TRY_CAST(income AS DOUBLE) AS income, TRY_CAST(loan_amount AS DOUBLE) AS loan_amount,
  TRY_CAST(outstanding_amount AS DOUBLE) AS outstanding_amount, TRY_CAST(emi_amount AS DOUBLE) AS emi_amount,
  TRY_CAST(credit_score AS DOUBLE) AS credit_score, TRY_CAST(recent_payment_amount AS DOUBLE) AS recent_payment_amount
FROM scored_basic"""))
def q_payload_cast(spark, sf_dir):  # P7
    return R.payload_cast(basic(spark, sf_dir))


@register("severity_label", O.basic_sql("""
SELECT customer_id, priority, CASE priority WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
  ELSE 'success' END AS severity FROM scored_basic"""))
def q_severity(spark, sf_dir):  # F27
    return basic(spark, sf_dir).select("customer_id", "priority", AC.severity_label(F.col("priority")).alias("severity"))


@register("reason_text", O.advanced_sql(f"""
SELECT customer_id,
  printf('DPD = %s days, Payment Probability = %.1f%%, PTP Probability = %.1f%%.', CAST(dpd AS VARCHAR),
         {O.rs('payment_probability * 100.0e0', 1)}, {O.rs('ptp_probability * 100.0e0', 1)}) AS reason_basic,
  printf('DPD=%sd, PayProb=%.0f%%, PTPProb=%.0f%%, Uplift=%+.1fpts', CAST(dpd AS VARCHAR),
         {O.rs('payment_probability * 100.0e0', 0)}, {O.rs('ptp_probability * 100.0e0', 0)},
         {O.rs('uplift_score * 100.0e0', 1)}) AS reason_advanced
FROM scored_advanced"""))
def q_reason_text(spark, sf_dir):  # F26 basic + advanced wording (service wording is in scorecard_service)
    a = advanced(spark, sf_dir)
    pay, ptp, up = F.col("payment_probability"), F.col("ptp_probability"), F.col("uplift_score")
    return a.select("customer_id", AC.reason_basic(pay, ptp).alias("reason_basic"),
                    AC.reason_advanced(pay, ptp, up).alias("reason_advanced"))


@register("account_key", """
SELECT 'C' || CAST(1000 + c_custkey AS VARCHAR) AS customer_id,
  'Customer ' || CAST(1000 + c_custkey AS VARCHAR) AS display_name FROM customer""")
def q_account_key(spark, sf_dir):  # F30
    from ..sources.tables import table
    n = (F.lit(1000) + F.col("c_custkey")).cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), n).alias("customer_id"),
                                                   F.concat(F.lit("Customer "), n).alias("display_name"))


@register("due_date", O.portfolio_sql("SELECT customer_id, dpd, due_date FROM portfolio"))
def q_due_date(spark, sf_dir):  # F25
    return portfolio(spark, sf_dir).select("customer_id", "dpd", "due_date")


@register("ptp_kept_cap", O.portfolio_sql(
    "SELECT customer_id, CAST(least(previous_ptp_kept_count, previous_ptp_count) AS INTEGER) AS previous_ptp_kept_count"
    " FROM portfolio"))
def q_ptp_kept_cap(spark, sf_dir):  # F9
    return cap_ptp_kept(portfolio(spark, sf_dir)).select("customer_id", "previous_ptp_kept_count")


# ---------------- advanced report ----------------
@register("kpi_advanced", O.advanced_sql(f"""
SELECT count(*) AS customers, CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_outstanding,
  count(*) FILTER (WHERE priority = 'HIGH') AS high_risk, {m9('avg(payment_probability)')} AS avg_payment_probability,
  {m9('avg(uplift_score)')} AS avg_uplift, count(*) FILTER (WHERE compliance_flag = 'OVER LIMIT') AS compliance_violations
FROM scored_advanced"""))
def q_kpi_advanced(spark, sf_dir):  # A2
    return R.kpi_advanced(advanced(spark, sf_dir))


@register("report_format", O.advanced_sql(f"""
SELECT format('{{:,}}', customers) AS customers_fmt,
  '₹' || printf('%.2f', {O.rs('total_outstanding / 10000000.0e0', 2)}) || ' Cr' AS outstanding_fmt,
  printf('%.1f%%', {O.rs('avg_pay * 100.0e0', 1)}) AS avg_payment_fmt,
  printf('%+.1f pts', {O.rs('avg_uplift * 100.0e0', 1)}) AS avg_uplift_fmt,
  '₹' || format('{{:,.0f}}', {O.rs('max_outstanding', 0)}) AS max_outstanding_fmt
FROM (SELECT count(*) AS customers, CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_outstanding,
        avg(payment_probability) AS avg_pay, avg(uplift_score) AS avg_uplift, max(outstanding_amount) AS max_outstanding
      FROM scored_advanced)"""))
def q_report_format(spark, sf_dir):  # F28
    a = advanced(spark, sf_dir).agg(F.count(F.lit(1)).alias("customers"),
                                    R.money_sum("outstanding_amount").alias("total_outstanding"),
                                    F.avg("payment_probability").alias("avg_pay"), F.avg("uplift_score").alias("avg_uplift"),
                                    F.max("outstanding_amount").alias("max_outstanding"))
    return a.select(
        F.format_number("customers", 0).alias("customers_fmt"),
        F.concat(F.lit("₹"), F.format_string("%.2f", round_stable(F.col("total_outstanding") / lit_d(1e7), 2)),
                 F.lit(" Cr")).alias("outstanding_fmt"),
        F.format_string("%.1f%%", round_stable(F.col("avg_pay") * lit_d(100), 1)).alias("avg_payment_fmt"),
        F.format_string("%+.1f pts", round_stable(F.col("avg_uplift") * lit_d(100), 1)).alias("avg_uplift_fmt"),
        F.concat(F.lit("₹"), F.format_number(round_stable(F.col("max_outstanding"), 0), 0)).alias("max_outstanding_fmt"))


@register("segment_stats", O.advanced_sql(f"""
SELECT segment, count(*) AS customers, {m9('avg(dpd)')} AS avg_dpd, {m9('avg(outstanding_amount)')} AS avg_outstanding,
  {m9('avg(payment_probability)')} AS avg_payment_prob, {m9('avg(uplift_score)')} AS avg_uplift
FROM scored_advanced GROUP BY segment"""))
def q_segment_stats(spark, sf_dir):  # A6
    return R.segment_stats(advanced(spark, sf_dir))


@register("segment_priority_rollup", O.advanced_sql("""
SELECT segment, priority, CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS outstanding,
  CAST(grouping(segment, priority) AS BIGINT) AS level
FROM scored_advanced GROUP BY ROLLUP (segment, priority)"""))
def q_rollup(spark, sf_dir):  # A7
    return R.segment_priority_rollup(advanced(spark, sf_dir))


@register("score_histogram", O.advanced_sql(f"""
SELECT priority, bin, count(*) AS n, {O.rs(f'0.0e0 + bin * {O.d(SCORE_W)}', 6)} AS bin_start FROM (
  SELECT priority, CAST(least(greatest(floor((priority_score - 0.0e0) / {O.d(SCORE_W)}), 0), 29) AS INTEGER) AS bin
  FROM scored_advanced) GROUP BY priority, bin"""))
def q_score_histogram(spark, sf_dir):  # A8
    return R.fixed_width_histogram(advanced(spark, sf_dir), "priority_score", 0.0, 100.0, 30, by=["priority"])


@register("uplift_histogram", O.advanced_sql(f"""
SELECT bin, count(*) AS n, {O.rs(f'-1.0e0 + bin * {O.d(UP_W)}', 6)} AS bin_start FROM (
  SELECT CAST(least(greatest(floor((uplift_score - -1.0e0) / {O.d(UP_W)}), 0), 39) AS INTEGER) AS bin
  FROM scored_advanced) GROUP BY bin"""))
def q_uplift_histogram(spark, sf_dir):  # A9
    return R.fixed_width_histogram(advanced(spark, sf_dir), "uplift_score", -1.0, 1.0, 40)


@register("contacts_histogram", O.advanced_sql(
    "SELECT contacts_last_7_days, count(*) AS customers FROM scored_advanced GROUP BY contacts_last_7_days"))
def q_contacts_histogram(spark, sf_dir):  # A10
    return R.value_counts(advanced(spark, sf_dir), "contacts_last_7_days")


@register("compliance_summary", O.advanced_sql(f"""
SELECT count(*) FILTER (WHERE compliance_flag = 'OVER LIMIT') AS violations, count(*) AS customers,
  {m9("CAST(count(*) FILTER (WHERE compliance_flag = 'OVER LIMIT') AS DOUBLE) / NULLIF(count(*), 0)")} AS violation_share
FROM scored_advanced"""))
def q_compliance_summary(spark, sf_dir):  # A11
    return R.compliance_summary(advanced(spark, sf_dir))


@register("compliance_violations", O.advanced_sql("""
SELECT customer_id, segment, contacts_last_7_days, priority, preferred_channel FROM scored_advanced
WHERE compliance_flag = 'OVER LIMIT'"""))
def q_compliance_violations(spark, sf_dir):  # P6
    return R.compliance_violations(advanced(spark, sf_dir))


@register("compliance_flag", O.advanced_sql(
    "SELECT customer_id, contacts_last_7_days, compliance_flag FROM scored_advanced"))
def q_compliance_flag(spark, sf_dir):  # F21
    return advanced(spark, sf_dir).select("customer_id", "contacts_last_7_days", "compliance_flag")


@register("filter_options", O.advanced_sql("""
SELECT DISTINCT 'preferred_channel' AS field, preferred_channel AS value FROM scored_advanced
UNION ALL SELECT DISTINCT 'segment', segment FROM scored_advanced"""))
def q_filter_options(spark, sf_dir):  # A12
    return R.filter_options(advanced(spark, sf_dir), ["preferred_channel", "segment"])


FILTER_P4 = dict(priorities=["HIGH", "MEDIUM"], min_dpd=15, channels=["PHONE", "WHATSAPP", "EMAIL"],
                 segments=["High-Value Responders", "Needs Restructuring"])


@register("filter_portfolio_segment", O.advanced_sql("""
SELECT customer_id, segment, priority, dpd, preferred_channel FROM scored_advanced
WHERE priority IN ('HIGH', 'MEDIUM') AND dpd >= 15 AND preferred_channel IN ('PHONE', 'WHATSAPP', 'EMAIL')
  AND segment IN ('High-Value Responders', 'Needs Restructuring')"""))
def q_filter_portfolio_segment(spark, sf_dir):  # P4
    return R.filter_portfolio(advanced(spark, sf_dir), **FILTER_P4).select(
        "customer_id", "segment", "priority", "dpd", "preferred_channel")


PQ_ADV = ["customer_id", "segment", "dpd", "outstanding_amount", "payment_probability", "uplift_score",
          "priority_score", "priority", "compliance_flag", "preferred_channel"]


@register("priority_queue_advanced", O.advanced_sql("""
SELECT customer_id, segment, dpd, outstanding_amount, payment_probability * 100.0e0 AS payment_probability,
  uplift_score * 100.0e0 AS uplift_score, priority_score, priority, compliance_flag, preferred_channel
FROM scored_advanced ORDER BY priority_score DESC, customer_id LIMIT 50"""))
def q_priority_queue_advanced(spark, sf_dir):  # L2
    top = R.top_k(advanced(spark, sf_dir), "priority_score", 50, PQ_ADV)
    return R.percent_scale(top, ["payment_probability", "uplift_score"])


C360_ADV = ["customer_id", "segment", "age", "income", "credit_score", "loan_amount", "outstanding_amount",
            "emi_amount", "dpd", "contacts_last_7_days", "payment_probability", "ptp_probability", "uplift_score",
            "priority_score", "priority", "compliance_flag"]


@register("customer_360_advanced", O.advanced_sql(
    "SELECT " + ", ".join(C360_ADV) + f" FROM scored_advanced WHERE customer_id = '{C360_ID}'"))
def q_customer_360_advanced(spark, sf_dir):  # P5 advanced
    return R.customer_360(advanced(spark, sf_dir), C360_ID, C360_ADV)


@register("uplift_scatter_feed", O.advanced_sql(
    "SELECT customer_id, payment_probability, uplift_score, segment, outstanding_amount, dpd FROM scored_advanced"))
def q_uplift_scatter(spark, sf_dir):  # P10
    return advanced(spark, sf_dir).select("customer_id", "payment_probability", "uplift_score", "segment",
                                          "outstanding_amount", "dpd")


@register("sample_accounts", O.advanced_sql("""
SELECT customer_id, segment FROM scored_advanced ORDER BY md5(customer_id || '42'), customer_id LIMIT 40"""))
def q_sample_accounts(spark, sf_dir):  # L4
    return R.sample_accounts(advanced(spark, sf_dir), 40, 42).select("customer_id", "segment")


@register("cluster_profile", O.advanced_sql(f"""
SELECT segment_raw, {m9('mean_uplift')} AS mean_uplift, {m9('mean_pay')} AS mean_pay, {m9('mean_dpd')} AS mean_dpd
FROM seg_profile"""))
def q_cluster_profile(spark, sf_dir):  # A13
    p = SG.cluster_profile(score_advanced(portfolio(spark, sf_dir)))
    return p.select("segment_raw", *[round_stable(F.col(c), 9).alias(c) for c in ("mean_uplift", "mean_pay", "mean_dpd")])


@register("segment_labels", O.advanced_sql("SELECT segment_raw, pay_rank, segment FROM seg_labels"))
def q_segment_labels(spark, sf_dir):  # M12 + W3
    p = SG.cluster_profile(score_advanced(portfolio(spark, sf_dir)))
    return SG.segment_labels(p).select("segment_raw", F.col("pay_rank").cast("bigint").alias("pay_rank"), "segment")


@register("segment_label_join", O.advanced_sql("SELECT customer_id, segment_raw, segment FROM scored_advanced"))
def q_segment_label_join(spark, sf_dir):  # J1
    return advanced(spark, sf_dir).select("customer_id", "segment_raw", "segment")


@register("remaining_set", O.advanced_sql("SELECT segment_raw FROM seg_labels WHERE pay_rank <> 1"))
def q_remaining_set(spark, sf_dir):  # X3
    p = SG.segment_labels(SG.cluster_profile(score_advanced(portfolio(spark, sf_dir))))
    return SG.remaining_clusters(p).select("segment_raw")


STRATEGY_SQL = "CASE segment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SG.STRATEGY.items()) + " END"


@register("segment_strategy", O.advanced_sql(
    f"SELECT segment, count(*) AS customers, {STRATEGY_SQL} AS strategy FROM scored_advanced GROUP BY segment"))
def q_segment_strategy(spark, sf_dir):  # F32
    c = advanced(spark, sf_dir).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return SG.segment_strategy(c)


@register("standardize", O.advanced_sql(
    "SELECT customer_id, " + ", ".join(
        f"{m9(f'coalesce(({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0), 0.0e0)')} AS {c}"
        for c in CLUSTER_FEATURES) + " FROM scored_advanced"))
def q_standardize(spark, sf_dir):  # M9
    z = SG.standardize(advanced(spark, sf_dir), CLUSTER_FEATURES, keep=["customer_id"])
    return z.select("customer_id", *[round_stable(F.col(c), 9).alias(c) for c in CLUSTER_FEATURES])


@register("assign_segment", O.advanced_sql(f"""
SELECT customer_id, cluster, sq_dist FROM (
  SELECT s.customer_id, c.segment_raw AS cluster,
    {m9(' + '.join(f'(CAST(s.{x} AS DOUBLE) - c.{x}) * (CAST(s.{x} AS DOUBLE) - c.{x})' for x in CLUSTER_FEATURES))} AS sq_dist,
    row_number() OVER (PARTITION BY s.customer_id ORDER BY
      {' + '.join(f'(CAST(s.{x} AS DOUBLE) - c.{x}) * (CAST(s.{x} AS DOUBLE) - c.{x})' for x in CLUSTER_FEATURES)}, c.segment_raw) AS rn
  FROM scored_advanced s CROSS JOIN (
    SELECT segment_raw, {', '.join(f'avg(CAST({x} AS DOUBLE)) AS {x}' for x in CLUSTER_FEATURES)}
    FROM scored_advanced GROUP BY segment_raw) c)
WHERE rn = 1"""))
def q_assign_segment(spark, sf_dir):  # M11 with given centroids (per-cluster feature means)
    a = advanced(spark, sf_dir)
    cents = a.groupBy("segment_raw").agg(*[F.avg(F.col(x).cast("double")).alias(x) for x in CLUSTER_FEATURES]) \
        .withColumnRenamed("segment_raw", "cluster")
    return SG.assign_nearest(a.select("customer_id", *CLUSTER_FEATURES), cents, CLUSTER_FEATURES) \
        .select("customer_id", "cluster", "sq_dist")
