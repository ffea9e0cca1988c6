"""Registered compliance, bandit and split queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as AC
from ..functions.numeric import round_stable
from ..operators import bandit as B
from ..operators import compliance as C
from ..operators import pointintime as PT
from ..operators import splits as X
from ..schema import CHANNELS
from ..session import written
from ..sources.portfolio import portfolio, training_portfolio
from ..sources.tables import table
from ..streaming import streams as S
from ..streaming.tables import BatchTable
from . import oracle as O
from .catalog import register
from .report_queries import advanced
from .rule_queries import BLOCK_ACC
from .scoring import score_service

W4_SQL = """count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"""
CONTACTS = "SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click', 'error')"


@register("contacts_trailing_7d", f"""
SELECT event_id, user_id, {W4_SQL} AS contacts_7d, {W4_SQL} >= 7 AS over_cap FROM ({CONTACTS})""")
def q_contacts_trailing(spark, sf_dir):  # W4
    ev = C.contact_events(table(spark, sf_dir, "events"))
    return C.contacts_trailing(ev).select("event_id", "user_id", "contacts_7d", "over_cap")


QUIET = "(hour(ts) >= 21 OR hour(ts) < 8)"
BLOCK = f"""CASE WHEN contacts_7d >= 7 THEN printf('Contact cap reached (%d/7 in 7 days)', contacts_7d)
  WHEN {QUIET} THEN 'Outside permitted contact hours' END"""


@register("guardrail_actions", O.advanced_sql(f"""
SELECT ce.event_id, ce.user_id, ce.contacts_7d,
  CASE WHEN ce.contacts_7d >= 7 THEN 'OVER LIMIT' ELSE 'OK' END AS compliance_flag,
  {QUIET} AS in_quiet_hours, {BLOCK} AS blocked_reason,
  CASE WHEN ({BLOCK}) IS NOT NULL THEN NULL WHEN s.dpd >= 90 THEN 'Escalate to Human Review'
       WHEN s.uplift_score < 0.02e0 THEN 'Light-touch reminder only (low marginal value of contact)'
       WHEN s.ptp_probability >= 0.6e0 THEN 'Request Promise-to-Pay'
       ELSE 'Repayment / Restructuring Discussion' END AS next_action
FROM (SELECT event_id, user_id, ts, {W4_SQL} AS contacts_7d FROM ({CONTACTS})) ce
JOIN scored_advanced s ON ce.user_id = s.c_custkey"""))
def q_guardrail(spark, sf_dir):  # F20 + F22 + F23 over trailing counts
    ev = C.guardrail(C.contacts_trailing(C.contact_events(table(spark, sf_dir, "events"))))
    acc = advanced(spark, sf_dir).select(F.col("c_custkey").alias("user_id"), "dpd", "uplift_score", "ptp_probability")
    j = ev.join(acc, "user_id", "inner")
    return j.select("event_id", "user_id", "contacts_7d", "compliance_flag", "in_quiet_hours", "blocked_reason",
                    AC.nba_advanced(F.col("blocked_reason"), F.col("uplift_score"), F.col("ptp_probability"))
                    .alias("next_action"))


@register("quiet_hours", """
SELECT event_id, hour(ts) AS hour_of_day, (hour(ts) >= 21 OR hour(ts) < 8) AS in_quiet_hours FROM events""")
def q_quiet_hours(spark, sf_dir):  # F23
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.hour("ts").alias("hour_of_day"), AC.quiet_hours(F.col("ts")).alias("in_quiet_hours"))


# ---------------- bandit ----------------
CHAN_SQL = " UNION ALL ".join(f"SELECT {i} AS channel_order, '{c}' AS channel" for i, c in enumerate(CHANNELS))
OUTCOMES_SQL = """
SELECT event_id, user_id,
  ['PHONE', 'SMS', 'WHATSAPP', 'EMAIL'][((CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) + 4) % 4 + 1] AS channel,
  CAST(event_type = 'click' AS INTEGER) AS outcome, CAST(ts AS DATE) AS batch_id
FROM events WHERE event_type IN ('click', 'view')"""
BANDIT_CTES = [
    ("prior", f"SELECT DISTINCT s.segment, c.channel, c.channel_order, 1.0e0 AS alpha, 1.0e0 AS beta "
              f"FROM scored_advanced s, ({CHAN_SQL}) c"),
    ("outcomes", OUTCOMES_SQL),
    ("per_seg", """
SELECT s.segment, o.channel, sum(o.outcome) AS succ, sum(1 - o.outcome) AS fail
FROM outcomes o JOIN scored_advanced s ON o.user_id = s.c_custkey GROUP BY s.segment, o.channel"""),
    ("posterior", """
SELECT p.segment, p.channel, p.channel_order, CAST(p.alpha + coalesce(succ, 0) AS DOUBLE) AS alpha,
  CAST(p.beta + coalesce(fail, 0) AS DOUBLE) AS beta
FROM prior p LEFT JOIN per_seg x ON p.segment = x.segment AND p.channel = x.channel"""),
    ("rated", f"""
SELECT *, {O.rs('alpha / (alpha + beta)', 9)} AS estimated_success_rate, CAST(alpha + beta - 2.0e0 AS BIGINT) AS trials
FROM posterior"""),
]


def bandit_sql(body: str) -> str:
    return O.with_ctes(body, O.PORTFOLIO_CTES, O.ADVANCED_CTES, BANDIT_CTES)


def _posterior(spark, sf_dir):
    acc = advanced(spark, sf_dir)
    post = B.update(B.prior(acc), B.outcome_log(table(spark, sf_dir, "events")), acc)
    return acc, post


@register("bandit_prior", bandit_sql("SELECT segment, channel, alpha, beta FROM prior"))
def q_bandit_prior(spark, sf_dir):  # B1
    return B.prior(advanced(spark, sf_dir)).select("segment", "channel", "alpha", "beta")


@register("bandit_update", bandit_sql("SELECT segment, channel, alpha, beta FROM posterior"))
def q_bandit_update(spark, sf_dir):  # B2
    return _posterior(spark, sf_dir)[1].select("segment", "channel", "alpha", "beta")


@register("bandit_rates", bandit_sql("SELECT segment, channel, estimated_success_rate, trials FROM rated"))
def q_bandit_rates(spark, sf_dir):  # B3
    return B.rates(_posterior(spark, sf_dir)[1]).select("segment", "channel", "estimated_success_rate", "trials")


@register("best_channel_per_segment", bandit_sql("""
SELECT segment, channel AS recommended_channel, estimated_success_rate, trials FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY estimated_success_rate DESC, channel_order) AS rn FROM rated)
WHERE rn = 1"""))
def q_best_channel(spark, sf_dir):  # W1
    return B.best_channel(B.rates(_posterior(spark, sf_dir)[1]))


@register("decision_record", bandit_sql(f"""
SELECT s.customer_id, s.segment, s.compliance_flag, s.blocked_reason, s.action, b.recommended_channel,
  printf('DPD=%sd, PayProb=%.0f%%, PTPProb=%.0f%%, Uplift=%+.1fpts', CAST(s.dpd AS VARCHAR),
         {O.rs('s.payment_probability * 100.0e0', 0)}, {O.rs('s.ptp_probability * 100.0e0', 0)}, {O.rs('s.uplift_score * 100.0e0', 1)}) AS reason
FROM (SELECT *, {BLOCK_ACC} AS blocked_reason, CASE WHEN ({BLOCK_ACC}) IS NOT NULL THEN NULL WHEN dpd >= 90 THEN 'Escalate to Human Review'
  WHEN uplift_score < 0.02e0 THEN 'Light-touch reminder only (low marginal value of contact)'
  WHEN ptp_probability >= 0.6e0 THEN 'Request Promise-to-Pay' ELSE 'Repayment / Restructuring Discussion' END AS action FROM scored_advanced) s
LEFT JOIN (SELECT segment, channel AS recommended_channel FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY estimated_success_rate DESC, channel_order) AS rn FROM rated) WHERE rn = 1) b
ON s.segment = b.segment"""))
def q_decision_record(spark, sf_dir):  # the whole advanced decision: veto or action, the segment's best channel, reason
    acc, post = _posterior(spark, sf_dir)
    best = B.best_channel(B.rates(post)).select("segment", "recommended_channel")
    why = AC.blocked_reason(F.col("compliance_flag"), F.col("contacts_last_7_days"), F.lit(False))
    rows = acc.select("customer_id", "segment", "compliance_flag", why.alias("blocked_reason"),
                      AC.nba_advanced(why, F.col("uplift_score"), F.col("ptp_probability")).alias("action"),
                      AC.reason_advanced(F.col("payment_probability"), F.col("ptp_probability"), F.col("uplift_score")).alias("reason"))
    return rows.join(best, "segment", "left").select("customer_id", "segment", "compliance_flag", "blocked_reason", "action",
                                                     "recommended_channel", "reason")


@register("posterior_join", bandit_sql("""
SELECT s.customer_id, s.segment, p.channel, p.alpha, p.beta FROM scored_advanced s JOIN posterior p ON s.segment = p.segment"""))
def q_posterior_join(spark, sf_dir):  # J4
    acc, post = _posterior(spark, sf_dir)
    return B.posterior_join(acc.select("customer_id", "segment"), post.select("segment", "channel", "alpha", "beta"))


@register("rate_lookup_default", bandit_sql(f"""
SELECT s.customer_id, s.segment, s.preferred_channel, coalesce(r.rate, 0.2e0) AS rate
FROM scored_advanced s LEFT JOIN (
  SELECT segment, channel, {O.rs('CAST(succ AS DOUBLE) / (succ + fail)', 9)} AS rate FROM per_seg WHERE succ > 0) r
ON s.segment = r.segment AND s.preferred_channel = r.channel"""))
def q_rate_lookup(spark, sf_dir):  # J5: observed success rates; pairs never tried (or never won) fall back to 0.2
    acc = advanced(spark, sf_dir)
    o = B.outcome_log(table(spark, sf_dir, "events"))
    seg = acc.select(F.col("c_custkey").alias("user_id"), "segment")
    obs = (o.groupBy("user_id", "channel").agg(F.sum("outcome").alias("s"), F.count(F.lit(1)).alias("n"))
           .join(seg, "user_id").groupBy("segment", "channel").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
           .where(F.col("s") > 0)
           .select("segment", "channel",
                   round_stable(F.col("s").cast("double") / F.col("n"), 9).alias("estimated_success_rate")))
    return B.rate_lookup(acc.select("customer_id", "segment", "preferred_channel"), obs)


@register("bandit_rounds", "SELECT count(DISTINCT CAST(ts AS DATE)) AS bandit_rounds FROM events "
                           "WHERE event_type IN ('click', 'view')")
def q_bandit_rounds(spark, sf_dir):  # B5
    return B.rounds(B.outcome_log(table(spark, sf_dir, "events")))


@register("bandit_reset", bandit_sql(
    "SELECT segment, channel, 1.0e0 AS alpha, 1.0e0 AS beta, CAST(0 AS BIGINT) AS bandit_rounds FROM posterior"))
def q_bandit_reset(spark, sf_dir):  # B6: the learned posterior returned to Beta(1, 1)
    return B.reset(_posterior(spark, sf_dir)[1]).select("segment", "channel", "alpha", "beta", "bandit_rounds")


@register("thompson_pick")  # B4: random draws -> rows-only check (property tests in tests/)
def q_thompson(spark, sf_dir):
    acc, post = _posterior(spark, sf_dir)
    return B.thompson_pick(acc, post.select("segment", "channel", "channel_order", "alpha", "beta"))


@register("thompson_check", bandit_sql("""
SELECT p.segment, p.channel, count(*) AS accounts, true AS picks_largest, true AS mean_near_posterior
FROM posterior p JOIN scored_advanced s ON p.segment = s.segment GROUP BY p.segment, p.channel"""))
def q_thompson_check(spark, sf_dir):  # B4: the pick is the largest draw; draws average to the posterior mean within 5 errors
    acc, post = _posterior(spark, sf_dir)
    post = written(post, "thompson-posterior")
    picks = B.thompson_pick(acc, post)
    names = post.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("channel_order", "channel"))).alias("arms"))
    d = (picks.join(names, "segment").select("segment", "recommended_channel", "draws", F.posexplode("arms").alias("i", "arm"))
         .select("segment", "arm.channel", F.element_at("draws", F.col("i") + 1).alias("draw"),
                 ((F.col("arm.channel") != F.col("recommended_channel")) | (F.element_at("draws", F.col("i") + 1) == F.array_max("draws"))).alias("fits")))
    stats = d.groupBy("segment", "channel").agg(F.count(F.lit(1)).alias("accounts"), F.avg("draw").alias("m"), F.bool_and("fits").alias("picks_largest"))
    total = F.col("alpha") + F.col("beta")
    error = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)) / F.col("accounts"))
    return stats.join(post, ["segment", "channel"]).select("segment", "channel", "accounts", "picks_largest",
                                                           (F.abs(F.col("m") - F.col("alpha") / total) <= 5 * error).alias("mean_near_posterior"))


@register("bandit_carried", bandit_sql("SELECT segment, channel, alpha, beta FROM posterior"))
def q_bandit_carried(spark, sf_dir):  # B2 carried on: weekly batches into a ledger, one of them twice
    acc = advanced(spark, sf_dir)
    segs = written(acc.select(F.col("c_custkey").alias("user_id"), "segment"), "carried-segments")
    log = B.outcome_log(table(spark, sf_dir, "events"))
    counts = BatchTable(spark, S.POSTERIOR_COUNTS)
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    weeks = sorted(r.w for r in log.select(week.alias("w")).distinct().collect())  # names of batches
    for w in [*weeks, *weeks[:1]]:
        B.carry_on(counts, w, log.where(week == w), segs)
    return B.posterior(B.prior(segs), counts.read("counts")).select("segment", "channel", "alpha", "beta")


# ---------------- point in time ----------------
SNAPSHOT_CUTS = [f"{y}-08-02" for y in range(1996, 2001)]


@register("training_snapshots", f"""
WITH cuts AS (SELECT unnest([{", ".join(f"TIMESTAMP '{c}'" for c in SNAPSHOT_CUTS)}]) AS cut),
x AS (SELECT c_custkey, cut, o.* FROM customer, cuts LEFT JOIN orders o ON c_custkey = o_custkey)
SELECT c_custkey, CAST(CAST(cut AS DATE) AS VARCHAR) AS cut, count(o_orderkey) FILTER (WHERE o_orderdate < cut) AS orders_before,
  CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < cut), 0) AS DOUBLE) AS loan_amount,
  count(o_orderkey) FILTER (WHERE o_orderdate < cut AND o_orderstatus = 'P') AS missed,
  date_diff('day', max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderdate < cut AND o_orderstatus = 'F'), CAST(cut AS DATE)) AS days_since_paid,
  CAST(coalesce(bool_or(o_orderstatus = 'F' AND o_orderdate >= cut AND o_orderdate < cut + INTERVAL 365 DAY), false) AS INTEGER) AS will_pay,
  CAST(coalesce(bool_or(o_orderstatus = 'F' AND o_orderpriority < '4' AND o_orderdate >= cut AND o_orderdate < cut + INTERVAL 365 DAY), false) AS INTEGER) AS ptp_kept
FROM x GROUP BY c_custkey, cut""")
def q_training_snapshots(spark, sf_dir):  # features before and outcomes after each of five cut-offs, for every customer
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    st = F.col("o_orderstatus")
    before = PT.known_before(orders, "o_custkey", "o_orderdate", SNAPSHOT_CUTS,
                             {"orders_before": F.lit(1), "loan": F.col("o_totalprice").cast("decimal(18,2)"), "missed": (st == "P").cast("int")},
                             {"paid_on": F.when(st == "F", F.to_date("o_orderdate"))})
    after = PT.happened_after(orders.where(st == "F"), "o_custkey", "o_orderdate", SNAPSHOT_CUTS, 365,
                              {"will_pay": F.lit(True), "ptp_kept": F.col("o_orderpriority") < "4"})
    keys = PT.at_cuts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), SNAPSHOT_CUTS)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (keys.join(before, ["o_custkey", "cut_index"], "left").join(after, ["o_custkey", "cut_index"], "left")
            .select(F.col("o_custkey").alias("c_custkey"), F.date_format("cut", "yyyy-MM-dd").alias("cut"), zero("orders_before").cast("bigint").alias("orders_before"),
                    zero("loan").cast("double").alias("loan_amount"), zero("missed").cast("bigint").alias("missed"),
                    F.datediff(F.to_date("cut"), "paid_on").cast("bigint").alias("days_since_paid"), zero("will_pay").alias("will_pay"), zero("ptp_kept").alias("ptp_kept")))


# ---------------- splits, weights, AUC ----------------
@register("assign_treatment", O.portfolio_sql("SELECT customer_id, treatment FROM portfolio"))
def q_assign_treatment(spark, sf_dir):  # X4
    return X.assign_treatment(portfolio(spark, sf_dir)).select("customer_id", "treatment")


@register("treatment_partition", O.portfolio_sql("""
SELECT customer_id, 'treated' AS arm FROM portfolio WHERE treatment = 1
UNION ALL SELECT customer_id, 'control' FROM portfolio WHERE treatment = 0"""))
def q_treatment_partition(spark, sf_dir):  # X2
    t, c = X.treatment_partition(portfolio(spark, sf_dir))
    return t.select("customer_id", F.lit("treated").alias("arm")).unionByName(
        c.select("customer_id", F.lit("control").alias("arm")))


@register("stratified_split", O.training_sql(f"""
SELECT customer_id, will_pay,
  row_number() OVER (PARTITION BY will_pay ORDER BY {O.u('split42')}, customer_id)
    <= ceil(count(*) OVER (PARTITION BY will_pay) * 0.2e0) AS is_test
FROM portfolio"""))
def q_stratified_split(spark, sf_dir):  # X1
    p = written(training_portfolio(spark, sf_dir).select("customer_id", "will_pay"), "labels")  # narrow, read more than once
    return X.stratified_split(p, "will_pay", 0.2, 42).select("customer_id", "will_pay", "is_test")


@register("class_weights", O.training_sql(f"""
SELECT customer_id, will_pay,
  CAST(count(*) OVER () AS DOUBLE) / (2.0e0 * count(*) OVER (PARTITION BY will_pay)) AS weight FROM portfolio"""))
def q_class_weights(spark, sf_dir):  # M2
    p = written(training_portfolio(spark, sf_dir).select("customer_id", "will_pay"), "labels")  # narrow, read more than once
    return X.class_weights(p, "will_pay").select("customer_id", "will_pay", "weight")


def _auc_sql(score: str, label: str, target: str) -> str:
    return f"""
SELECT '{target}' AS target, {O.rs('num / (CAST(P AS DOUBLE) * N)', 9)} AS auc, P AS positives, N AS negatives FROM (
  SELECT sum(npos * (neg_below + 0.5e0 * nneg)) AS num, sum(npos) AS P, sum(nneg) AS N FROM (
    SELECT npos, nneg, coalesce(sum(nneg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
    FROM (SELECT {score} AS s, count(*) FILTER (WHERE {label} = 1) AS npos, count(*) FILTER (WHERE {label} <> 1) AS nneg
          FROM scored_service GROUP BY {score})))"""


@register("roc_auc", O.training_service_sql(" UNION ALL ".join([
    _auc_sql("payment_probability_30d", "will_pay", "will_pay"),
    _auc_sql("ptp_probability", "ptp_kept", "ptp_kept"),
    _auc_sql("recovery_probability", "recovery_success", "recovery_success")])))
def q_roc_auc(spark, sf_dir):  # M4: the scorecard as of the cut-off against what happened after it
    s = score_service(training_portfolio(spark, sf_dir))
    pairs = [("payment_probability_30d", "will_pay"), ("ptp_probability", "ptp_kept"),
             ("recovery_probability", "recovery_success")]
    # one pass over the scored portfolio: each row fans out to its three (target, score, label) pairs
    u = s.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(sc).alias("score"),
                                               F.col(t).alias("label")) for sc, t in pairs])).alias("p")) \
        .select("p.target", "p.score", "p.label")
    return X.roc_auc(u, "score", "label", by=["target"])
