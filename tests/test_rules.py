"""Golden row (FIXTURES §4) and edge rows (FIXTURES §5) through the rule sets."""
import pytest
from pyspark.sql import functions as F

from arrearscope.functions import actions as AC
from arrearscope.functions import features as FE
from arrearscope.functions import scorecards as SC
from arrearscope.functions.numeric import round_stable
from arrearscope.operators.validate import validate_accounts
from arrearscope.plans.scoring import score_advanced, score_basic, score_service
from conftest import account_row, accounts_df


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_golden_service(spark):
    r = one(score_service(accounts_df(spark, [account_row()])))
    assert r.ptp_kept_rate == pytest.approx(0.75)
    assert r.contact_success_rate == pytest.approx(0.625)
    assert r.outstanding_to_income == pytest.approx(0.333333, abs=1e-6)
    assert r.emi_to_income == pytest.approx(0.3)
    assert r.payment_to_outstanding == pytest.approx(0.025)
    assert r.dpd_bucket == 1
    assert r.behavior_stress_score == pytest.approx(0.295833, abs=1e-6)
    assert r.payment_probability_30d == pytest.approx(0.6585)
    assert r.ptp_probability == pytest.approx(0.6488)
    assert r.recovery_probability == pytest.approx(0.5194)
    assert r.collection_priority_score == pytest.approx(30.81)
    assert r.priority_band == "LOW"
    assert r.next_best_action.action == "OFFER_REPAYMENT_PLAN_DISCUSSION"
    assert r.next_best_action.recommended_channel == "SMS"
    assert r.next_best_action.reason == "DPD=45; payment=0.6585; PTP=0.6488."


def test_golden_basic_and_advanced(spark):
    b = one(score_basic(accounts_df(spark, [account_row()])))
    assert b.stress == pytest.approx(0.25)
    assert (b.payment_probability, b.ptp_probability, b.recovery_probability) == pytest.approx((0.70, 0.675, 0.675))
    assert b.priority_score == pytest.approx(29.708333, abs=1e-6)
    assert b.priority == "LOW" and b.next_best_action == "Request PTP"
    a = score_advanced(accounts_df(spark, [account_row()]).withColumn("contacts_last_7_days", F.lit(0)))
    a = one(a.withColumn("nba", AC.nba_advanced(F.lit(None).cast("string"), F.col("uplift_score"),
                                                F.col("ptp_probability"))))
    assert a.uplift_score == pytest.approx(0.092415, abs=1e-6)
    assert a.priority_score == pytest.approx(22.234528, abs=1e-6)
    assert a.priority == "LOW" and a.compliance_flag == "OK"
    assert a.nba == "Request Promise-to-Pay"


def test_validation_edge_rows(spark):
    rows = [account_row(customer_id="ok"), account_row(customer_id="a17", age=17), account_row(customer_id="a101", age=101),
            account_row(customer_id="c299", credit_score=299.9), account_row(customer_id="c900", credit_score=900.0),
            account_row(customer_id="neg", income=-1.0), account_row(customer_id="chan", preferred_channel="FAX"),
            account_row(customer_id="nodue", due_date=None), account_row(customer_id="zero", income=0.0,
                                                                         outstanding_amount=0.0)]
    ok, bad = validate_accounts(accounts_df(spark, rows))
    assert sorted(r.customer_id for r in ok.collect()) == ["c900", "ok", "zero"]
    reasons = {r.customer_id: r.reasons for r in bad.collect()}
    assert reasons["a17"] == ["age not in [18, 100]"]
    assert reasons["c299"] == ["credit_score not in [300, 900]"]
    assert reasons["neg"] == ["income < 0"]
    assert reasons["chan"] == ["preferred_channel not in (PHONE, SMS, WHATSAPP, EMAIL)"]
    assert reasons["nodue"] == ["missing due_date"]


def test_zero_outstanding_and_kept_over_count(spark):
    r = one(score_service(accounts_df(spark, [account_row(outstanding_amount=0.0, previous_ptp_count=1,
                                                          previous_ptp_kept_count=3)])))
    assert r.payment_to_outstanding == pytest.approx(5000.0 / 1e-6)  # Q4: explodes, then clipped
    assert r.payment_probability_30d == pytest.approx(0.98)
    assert r.ptp_kept_rate == pytest.approx(3.0)  # Q3 kept > count allowed
    capped = one(FE.cap_ptp_kept(accounts_df(spark, [account_row(previous_ptp_count=1, previous_ptp_kept_count=3)])))
    assert capped.previous_ptp_kept_count == 1


@pytest.mark.parametrize("score,band,band_adv", [(70.0, "HIGH", "HIGH"), (69.99, "MEDIUM", "HIGH"),
                                                 (65.0, "MEDIUM", "HIGH"), (40.0, "MEDIUM", "MEDIUM"),
                                                 (38.0, "LOW", "MEDIUM"), (37.99, "LOW", "LOW")])
def test_band_thresholds(spark, score, band, band_adv):
    r = one(spark.range(1).select(SC.band(F.lit(score)).alias("b"), SC.band_advanced(F.lit(score)).alias("a")))
    assert (r.b, r.a) == (band, band_adv)


@pytest.mark.parametrize("dpd,pay,ptp,expect", [
    (0, 0.9, 0.9, "SEND_STANDARD_PAYMENT_REMINDER"), (120, 0.1, 0.65, "REQUEST_AND_CONFIRM_PROMISE_TO_PAY"),
    (120, 0.55, 0.1, "OFFER_REPAYMENT_PLAN_DISCUSSION"), (90, 0.1, 0.1, "ESCALATE_FOR_HUMAN_REVIEW"),
    (89, 0.1, 0.1, "COLLECTION_CALL_AND_HARDSHIP_ASSESSMENT")])
def test_nba_service_order(spark, dpd, pay, ptp, expect):
    r = one(spark.range(1).select(F.lit(dpd).alias("dpd"))
            .select(AC.nba_service(F.lit(pay), F.lit(ptp)).alias("a")))
    assert r.a == expect


@pytest.mark.parametrize("dpd,pay,ptp,expect", [(90, 0.9, 0.9, "Human Review"), (30, 0.1, 0.65, "Request PTP"),
                                                (30, 0.60, 0.1, "Repayment Discussion"), (29, 0.59, 0.64, "Collection Call")])
def test_nba_basic_order(spark, dpd, pay, ptp, expect):
    r = one(spark.range(1).select(F.lit(dpd).alias("dpd")).select(AC.nba_basic(F.lit(pay), F.lit(ptp)).alias("a")))
    assert r.a == expect


@pytest.mark.parametrize("hhmm,quiet", [("07:59", True), ("08:00", False), ("20:59", False), ("21:00", True)])
def test_quiet_hours(spark, hhmm, quiet):
    r = one(spark.range(1).select(AC.quiet_hours(F.lit(f"2024-01-10 {hhmm}:00").cast("timestamp")).alias("q")))
    assert r.q is quiet


@pytest.mark.parametrize("contacts,flag", [(6, "OK"), (7, "OVER LIMIT")])
def test_compliance_and_block_reason(spark, contacts, flag):
    r = one(spark.range(1).select(F.lit(contacts).alias("c")).select(
        AC.compliance_flag(F.col("c")).alias("f"),
        AC.blocked_reason(AC.compliance_flag(F.col("c")), F.col("c"), F.lit(True)).alias("why")))
    assert r.f == flag
    assert r.why == ("Contact cap reached (7/7 in 7 days)" if contacts == 7 else "Outside permitted contact hours")


def test_round_stable_halfway(spark):
    r = one(spark.range(1).select(round_stable(F.lit(0.125), 2).alias("a"), round_stable(F.lit(2.675), 2).alias("b"),
                                  round_stable(F.lit(-0.004), 2).alias("c"), round_stable(F.lit(3e30), 2).alias("d")))
    assert (r.a, r.b, r.c, r.d) == (0.13, 2.68, 0.0, 3e30)


def test_tone_and_message_outcome(spark):
    from arrearscope.operators import messages as M
    df = spark.createDataFrame([("a", None, "x", None), ("b", "concise", None, "429 Too Many"),
                                ("c", "urgent", "  ", "RESOURCE_EXHAUSTED"), ("d", "empathetic", None, "boom")],
                               "id string, tone string, text string, err string")
    tone, ok = M.tone_validation(F.col("tone"))
    df = df.withColumns({"customer_name": F.lit("Ann"), "outstanding_amount": F.lit(1234567.891), "dpd": F.lit(30)})
    st, src, msg = M.message_outcome(F.col("text"), F.col("err"))
    got = {r.id: r for r in df.select("id", tone.alias("t"), ok.alias("ok"), st.alias("st"), src.alias("src"),
                                      msg.alias("msg")).collect()}
    assert (got["a"].t, got["a"].ok, got["a"].st, got["a"].src, got["a"].msg) == ("professional", True, "ok", "llm", "x")
    assert (got["b"].st, got["b"].src) == ("fallback", "template")
    assert got["b"].msg.startswith("Dear Ann, this is a friendly reminder regarding your outstanding amount of INR 1,234,567.89.")
    assert (got["c"].t, got["c"].ok, got["c"].st) == (None, False, "fallback")
    assert (got["d"].st, got["d"].src, got["d"].msg) == ("failed", None, None)


def test_nan_is_rejected(spark):
    nan = float("nan")
    ok, bad = validate_accounts(accounts_df(spark, [account_row(customer_id="i", income=nan), account_row(customer_id="o", outstanding_amount=nan),
                                                    account_row(customer_id="ok")]))
    assert [r.customer_id for r in ok.collect()] == ["ok"]
    assert {r.customer_id: r.reasons for r in bad.collect()} == {"i": ["income < 0"], "o": ["outstanding_amount < 0"]}


def test_probability_wording(spark):
    from arrearscope.functions.actions import plain_decimal
    df = spark.createDataFrame([(x,) for x in (0.0005, 0.5, 1.0, 0.0, 0.1234, 0.1)], "x double")
    assert [r.t for r in df.select(plain_decimal(F.col("x")).alias("t")).collect()] == ["0.0005", "0.5", "1.0", "0.0", "0.1234", "0.1"]
