"""DuckDB-runnable SQL twins of the registered queries (the correctness oracle).

Each query is ``WITH <shared CTEs> SELECT ...`` over the driver's pre-registered views. The shared
CTEs restate the portfolio mapping and the rule sets in plain SQL, written with the same double
operations (literals as doubles, the same association order) so both engines produce equal doubles.
"""
from __future__ import annotations

def d(x: float) -> str:
    """A DuckDB DOUBLE literal (a bare 0.45 would be a DECIMAL)."""
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def rs(expr: str, n: int) -> str:
    m = d(10 ** n)
    return (f"CAST(CASE WHEN abs(({expr}) * {m}) < 4503599627370496.0e0 THEN floor(({expr}) * {m} + 0.5e0 + 1e-7) / {m}"
            f" ELSE ({expr}) END AS DOUBLE)")


def clip(expr: str, lo: float, hi: float) -> str:
    return f"greatest(least({expr}, {d(hi)}), {d(lo)})"


def u(salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(customer_id || '{salt}'), 1, 8)) AS BIGINT) / 4294967296.0e0)"


def capped(c: str, dd: float) -> str:
    return f"least(CAST({c} AS DOUBLE) / {d(dd)}, 1.0e0)"


def ratio(num: str, den: str, fl: float) -> str:
    return f"(CAST({num} AS DOUBLE) / greatest(CAST({den} AS DOUBLE), {d(fl)}))"


F1 = ratio("previous_ptp_kept_count", "previous_ptp_count", 1.0)
F2 = ratio("successful_contacts", "collection_attempts", 1.0)
F3 = ratio("outstanding_amount", "income * 12.0e0", 1e-6)
F4 = ratio("emi_amount", "income", 1e-6)
F5 = ratio("recent_payment_amount", "outstanding_amount", 1e-6)
F6 = "CAST(least(dpd // 30, 6) AS INTEGER)"


def f7(kr: str = F1, sr: str = F2) -> str:
    return (f"(0.35e0 * {capped('dpd', 180.0)} + 0.2e0 * {capped('missed_payment_count', 6.0)}"
            f" + 0.2e0 * {capped('days_since_last_payment', 90.0)} + 0.15e0 * (1.0e0 - {kr})"
            f" + 0.1e0 * (1.0e0 - {sr}))")


F8 = (f"(0.4e0 * {capped('dpd', 180.0)} + 0.2e0 * {capped('missed_payment_count', 6.0)}"
      f" + 0.2e0 * {capped('days_since_last_payment', 180.0)} + 0.2e0 * (1.0e0 - {F1}))")


def pay10(s: str, p2o: str) -> str:
    return clip(f"0.8e0 - 0.55e0 * {s} + 0.0003e0 * (credit_score - 650.0e0) + 0.25e0 * {p2o}", 0.02, 0.98)


def ptp10(s: str, kr: str, sr: str) -> str:
    return clip(f"0.2e0 + 0.55e0 * {kr} + 0.2e0 * {sr} - 0.3e0 * {s}", 0.02, 0.98)


def rec10(s: str, p2o: str) -> str:
    return clip(f"0.65e0 - 0.45e0 * {s} + 0.1e0 * least({p2o}, 1.0e0)", 0.02, 0.98)


def uplift31(s: str) -> str:
    return rs(f"0.18e0 * exp(-(({s} - 0.45e0) * ({s} - 0.45e0)) / 0.06e0)", 8)


INCOME_RATIO = "(outstanding_amount / greatest(income * 12.0e0, 1.0e0))"


def band(score: str, hi: float = 70.0, med: float = 40.0) -> str:
    return f"CASE WHEN {score} >= {d(hi)} THEN 'HIGH' WHEN {score} >= {d(med)} THEN 'MEDIUM' ELSE 'LOW' END"


def portfolio_ctes(orders_asof: str, events_asof: str) -> list[tuple[str, str]]:
    """The portfolio as known at the as-of dates, up to ``pb2``."""
    day = f"DATE '{orders_asof}'"
    return [
    ("li_agg", f"""
SELECT l_orderkey, count(*) AS n_r, count(*) FILTER (WHERE l_linestatus = 'F') AS n_rf
FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < {day} GROUP BY l_orderkey"""),
    ("hist", f"""
SELECT o_custkey,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS loan_dec,
  sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS out_dec,
  max(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END) AS last_o,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority < '4') AS n_fk,
  max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS max_f_price,
  max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS last_f,
  sum(n_r) AS n_r, sum(n_rf) AS n_rf
FROM orders LEFT JOIN li_agg ON o_orderkey = l_orderkey WHERE o_orderdate < {day} GROUP BY o_custkey"""),
    ("ev_agg", f"""
SELECT user_id, count(*) AS n_contacts FROM events
WHERE event_type IN ('view', 'click', 'error')
  AND ts >= TIMESTAMP '{events_asof} 00:00:00' - INTERVAL 7 DAY AND ts < TIMESTAMP '{events_asof} 00:00:00'
GROUP BY user_id"""),
    ("pbase", f"""
SELECT 'C' || CAST(1000 + c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_custkey,
  CAST(21 + (c_custkey * 7) % 49 AS INTEGER) AS age,
  {rs('20000.0e0 + (c_acctbal + 1000.0e0) * 11.0e0', 2)} AS income,
  CAST(coalesce(loan_dec, 0) AS DOUBLE) AS loan_amount,
  CAST(coalesce(out_dec, 0) AS DOUBLE) AS outstanding_amount,
  CAST(300 + (c_custkey * 37) % 551 AS DOUBLE) AS credit_score,
  CAST([0, 5, 15, 30, 45, 60, 90, 120, 180][((c_custkey + coalesce(date_diff('day', last_o, {day}), 0)) % 9 + 9) % 9 + 1] AS INTEGER) AS dpd,
  CAST(coalesce(n_p, 0) AS INTEGER) AS missed_payment_count,
  CAST(coalesce(n_f, 0) AS INTEGER) AS previous_ptp_count,
  CAST(coalesce(n_fk, 0) AS INTEGER) AS previous_ptp_kept_count,
  CAST(coalesce(n_r, 0) AS INTEGER) AS collection_attempts,
  CAST(coalesce(n_rf, 0) AS INTEGER) AS successful_contacts,
  coalesce({rs('0.06e0 * max_f_price', 2)}, 0.0e0) AS recent_payment_amount,
  CAST(coalesce(date_diff('day', last_f, {day}) % 180, 0) AS INTEGER) AS days_since_last_payment,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'PHONE' WHEN 'AUTOMOBILE' THEN 'SMS'
       WHEN 'MACHINERY' THEN 'WHATSAPP' ELSE 'EMAIL' END AS preferred_channel,
  CAST(coalesce(n_contacts, 0) AS INTEGER) AS contacts_last_7_days
FROM customer LEFT JOIN hist ON c_custkey = o_custkey LEFT JOIN ev_agg ON c_custkey = user_id"""),
    ("pb2", f"""
SELECT *, {rs('loan_amount * 0.03e0', 2)} AS emi_amount,
  strftime({day} - dpd, '%d-%m-%Y') AS due_date,
  CAST({u('treat')} < 0.5e0 AS INTEGER) AS treatment,
  CAST(c_custkey % 4 AS INTEGER) AS segment_raw
FROM pbase"""),
]


PORTFOLIO_CTES = [*portfolio_ctes("2001-08-02", "2024-01-31"), ("portfolio", "SELECT * FROM pb2")]

# what happened after the training cut-offs
TRAINING_CTES = [
    *portfolio_ctes("2000-08-02", "2024-01-28"),
    ("paid", """
SELECT o_custkey, max(CAST(o_orderpriority < '4' AS INTEGER)) AS ptp_kept FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2000-08-02' AND o_orderdate < DATE '2000-08-02' + INTERVAL 365 DAY GROUP BY o_custkey"""),
    ("collected", """
SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate >= DATE '2000-08-02' AND l_shipdate < DATE '2000-08-02' + INTERVAL 365 DAY"""),
    ("around", """
SELECT user_id,
  max(CAST(event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' AS INTEGER)) AS cycle,
  max(CAST(event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28 00:00:00' AND ts < TIMESTAMP '2024-01-29 00:00:00' AS INTEGER)) AS kept,
  max(CAST(event_type IN ('view', 'click', 'error') AND ts >= TIMESTAMP '2024-01-27 00:00:00' AND ts < TIMESTAMP '2024-01-28 00:00:00' AS INTEGER)) AS treated
FROM events GROUP BY user_id"""),
    ("portfolio", """
SELECT pb2.* EXCLUDE (treatment), CAST(coalesce(treated, 0) AS INTEGER) AS treatment, CAST(paid.o_custkey IS NOT NULL AS INTEGER) AS will_pay,
  coalesce(ptp_kept, 0) AS ptp_kept, CAST(collected.o_custkey IS NOT NULL AS INTEGER) AS recovery_success,
  CAST(coalesce(cycle, 0) AS INTEGER) AS did_pay_last_cycle, CAST(coalesce(kept, 0) AS INTEGER) AS kept_ptp_last_cycle
FROM pb2 LEFT JOIN paid ON c_custkey = paid.o_custkey LEFT JOIN collected ON c_custkey = collected.o_custkey
  LEFT JOIN around ON c_custkey = around.user_id"""),
]

SERVICE_CTES = [
    ("svc_f", f"""
SELECT *, {F1} AS ptp_kept_rate, {F2} AS contact_success_rate, {F3} AS outstanding_to_income,
  {F4} AS emi_to_income, {F5} AS payment_to_outstanding, {F6} AS dpd_bucket
FROM portfolio"""),
    ("svc_f2", f"""SELECT *, {f7('ptp_kept_rate', 'contact_success_rate')} AS behavior_stress_score FROM svc_f"""),
    ("svc_p", f"""
SELECT *, {pay10('behavior_stress_score', 'payment_to_outstanding')} AS p_pay,
  {ptp10('behavior_stress_score', 'ptp_kept_rate', 'contact_success_rate')} AS p_ptp,
  {rec10('behavior_stress_score', 'payment_to_outstanding')} AS p_rec
FROM svc_f2"""),
    ("svc_s", f"""
SELECT *, {rs('p_pay', 4)} AS payment_probability_30d, {rs('p_ptp', 4)} AS ptp_probability,
  {rs('p_rec', 4)} AS recovery_probability,
  {rs(clip(f"100.0e0 * (0.45e0 * (1.0e0 - p_pay) + 0.25e0 * (1.0e0 - p_ptp) + 0.2e0 * {capped('dpd', 180.0)} + 0.1e0 * (least({INCOME_RATIO}, 2.0e0) / 2.0e0))", 0.0, 100.0), 2)} AS collection_priority_score
FROM svc_p"""),
    ("scored_service", f"""
SELECT *, {band('collection_priority_score')} AS priority_band,
  CASE WHEN dpd = 0 THEN 'SEND_STANDARD_PAYMENT_REMINDER'
       WHEN ptp_probability >= 0.65e0 THEN 'REQUEST_AND_CONFIRM_PROMISE_TO_PAY'
       WHEN payment_probability_30d >= 0.55e0 THEN 'OFFER_REPAYMENT_PLAN_DISCUSSION'
       WHEN dpd >= 90 THEN 'ESCALATE_FOR_HUMAN_REVIEW'
       ELSE 'COLLECTION_CALL_AND_HARDSHIP_ASSESSMENT' END AS action,
  'DPD=' || CAST(dpd AS VARCHAR) || '; payment=' || CAST(payment_probability_30d AS VARCHAR)
    || '; PTP=' || CAST(ptp_probability AS VARCHAR) || '.' AS reason
FROM svc_s"""),
]

BASIC_CTES = [
    ("bas_s", f"SELECT *, {F8} AS stress FROM portfolio"),
    ("bas_p", f"""
SELECT *, {clip('0.95e0 - stress', 0.02, 0.98)} AS payment_probability,
  {clip('0.9e0 - stress * 0.9e0', 0.02, 0.98)} AS ptp_probability,
  {clip('0.85e0 - stress * 0.7e0', 0.02, 0.98)} AS recovery_probability
FROM bas_s"""),
    ("bas_q", f"""
SELECT *, {clip(f"(1.0e0 - payment_probability) * 40.0e0 + (1.0e0 - ptp_probability) * 25.0e0 + {capped('dpd', 180.0)} * 25.0e0 + least({INCOME_RATIO}, 1.0e0) * 10.0e0", 0.0, 100.0)} AS priority_score
FROM bas_p"""),
    ("scored_basic", f"""
SELECT *, {band('priority_score')} AS priority,
  CASE WHEN dpd >= 90 THEN 'Human Review' WHEN ptp_probability >= 0.65e0 THEN 'Request PTP'
       WHEN payment_probability >= 0.6e0 THEN 'Repayment Discussion' ELSE 'Collection Call' END AS next_best_action
FROM bas_q"""),
]

ADVANCED_CTES = [
    ("adv_s", f"SELECT *, {F8} AS stress FROM portfolio"),
    ("adv_p", f"""
SELECT *, {clip('0.95e0 - stress', 0.02, 0.98)} AS payment_probability,
  {clip('0.9e0 - stress * 0.9e0', 0.02, 0.98)} AS ptp_probability,
  {uplift31('stress')} AS uplift_score
FROM adv_s"""),
    ("adv_q", f"""
SELECT *, {clip('payment_probability + uplift_score', 0.02, 0.99)} AS recovery_probability,
  {clip(f"(1.0e0 - payment_probability) * 30.0e0 + greatest(uplift_score, 0.0e0) * 100.0e0 * 0.35e0 + {capped('dpd', 180.0)} * 20.0e0 + least({INCOME_RATIO}, 1.0e0) * 15.0e0", 0.0, 100.0)} AS priority_score,
  CASE WHEN contacts_last_7_days >= 7 THEN 'OVER LIMIT' ELSE 'OK' END AS compliance_flag
FROM adv_p"""),
    ("adv_r", f"SELECT *, {band('priority_score', 65.0, 38.0)} AS priority FROM adv_q"),
    # M12 on the given clusters: best mean pay -> Steady Self-Payers, the rest by mean uplift.
    ("seg_profile", """
SELECT segment_raw, avg(uplift_score) AS mean_uplift, avg(payment_probability) AS mean_pay, avg(dpd) AS mean_dpd
FROM adv_r GROUP BY segment_raw"""),
    ("seg_rank", """
SELECT *, row_number() OVER (ORDER BY mean_pay DESC, segment_raw) AS pay_rank FROM seg_profile"""),
    ("seg_labels", """
SELECT segment_raw, mean_uplift, mean_pay, mean_dpd, pay_rank,
  CASE WHEN pay_rank = 1 THEN 'Steady Self-Payers'
       ELSE ['High-Value Responders', 'Needs Restructuring', 'Hard-to-Recover'][
            least(row_number() OVER (PARTITION BY pay_rank = 1 ORDER BY mean_uplift DESC, segment_raw), 3)] END
    AS segment
FROM seg_rank"""),
    ("scored_advanced", """
SELECT adv_r.*, seg_labels.segment FROM adv_r JOIN seg_labels USING (segment_raw)"""),
]


def with_ctes(body: str, *groups: list[tuple[str, str]]) -> str:
    seen: dict[str, str] = {}
    for g in groups:
        for name, sql in g:
            seen.setdefault(name, sql)
    ctes = ",\n".join(f"{n} AS ({s.strip()})" for n, s in seen.items())
    return f"WITH {ctes}\n{body.strip()}"


def portfolio_sql(body: str) -> str:
    return with_ctes(body, PORTFOLIO_CTES)


def training_sql(body: str) -> str:
    return with_ctes(body, TRAINING_CTES)


def training_service_sql(body: str) -> str:
    return with_ctes(body, TRAINING_CTES, SERVICE_CTES)


def service_sql(body: str) -> str:
    return with_ctes(body, PORTFOLIO_CTES, SERVICE_CTES)


def basic_sql(body: str) -> str:
    return with_ctes(body, PORTFOLIO_CTES, BASIC_CTES)


def advanced_sql(body: str) -> str:
    return with_ctes(body, PORTFOLIO_CTES, ADVANCED_CTES)
