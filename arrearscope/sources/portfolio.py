"""S1 portfolio_scan: the typed account table.

``read_accounts`` reads an account table that already has the ACCOUNT schema. ``portfolio`` derives
the same shape from the driver's customer / orders / lineitem / events tables (FIXTURES.md mapping):

  lineitem --filter R--> partial agg by l_orderkey (<= 1 row per order)
  orders LEFT JOIN that on orderkey (1:1, no skew possible) -> partial+final agg by o_custkey
  events --filter type/time--> partial+final agg by user_id
  customer LEFT JOIN both aggregates (1:1 on the key)

Every join is 1:1 after its pre-aggregation, so a customer holding a third of all orders only makes
one map-side combine bigger; no task receives that customer's raw rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform, lit_d, round_stable
from ..operators import pointintime as PT
from ..schema import ACCOUNT, DPD_LADDER
from .tables import table

ORDERS_ASOF = "2001-08-02"
EVENTS_ASOF = "2024-01-31"
# training: features from before these days, outcomes from after them
ORDERS_CUT = "2000-08-02"
EVENTS_CUT = "2024-01-28"
OUTCOME_DAYS = 365
CYCLE_DAYS = 3
LABELS = ["will_pay", "ptp_kept", "recovery_success", "did_pay_last_cycle", "kept_ptp_last_cycle"]
CONTACT_EVENT_TYPES = ["view", "click", "error"]
# ---- fixed values: market segment -> preferred channel ----
SEGMENT_CHANNEL = {"BUILDING": "PHONE", "AUTOMOBILE": "SMS", "MACHINERY": "WHATSAPP"}
DEFAULT_CHANNEL = "EMAIL"
# ---- end fixed values ----


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan of an account table written with the ACCOUNT schema (parquet)."""
    return spark.read.schema(ACCOUNT).parquet(path)


def _pmod(c: Column, m: int) -> Column:
    return ((c % m) + m) % m


def order_history(spark: SparkSession, sf_dir: str, asof: str = ORDERS_ASOF) -> DataFrame:
    """Per-customer aggregates of the orders placed and the returned lines shipped before ``asof`` (one row per o_custkey)."""
    before = F.lit(asof).cast("timestamp_ntz")
    li = (table(spark, sf_dir, "lineitem")
          .where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < before))
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_r"),
               F.count_if(F.col("l_linestatus") == "F").alias("n_rf")))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < before).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.to_date("o_orderdate").alias("odate"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    st = F.col("o_orderstatus")
    return (o.join(li, o.o_orderkey == li.l_orderkey, "left")
            .groupBy("o_custkey")
            .agg(F.sum(price).alias("loan_dec"),
                 F.sum(F.when(st == "O", price)).alias("out_dec"),
                 F.max(F.when(st == "O", F.col("odate"))).alias("last_o"),
                 F.count_if(st == "P").alias("n_p"),
                 F.count_if(st == "F").alias("n_f"),
                 F.count_if((st == "F") & (F.col("o_orderpriority") < "4")).alias("n_fk"),
                 F.max(F.when(st == "F", F.col("o_totalprice"))).alias("max_f_price"),
                 F.max(F.when(st == "F", F.col("odate"))).alias("last_f"),
                 F.sum("n_r").alias("n_r"), F.sum("n_rf").alias("n_rf")))


def contact_counts(spark: SparkSession, sf_dir: str, asof: str = EVENTS_ASOF, days: int = 7) -> DataFrame:
    """Contact-like events per user in [asof - days, asof). Filters reach the parquet scan."""
    hi = F.lit(f"{asof} 00:00:00").cast("timestamp_ntz")
    lo = F.lit(F.date_sub(F.lit(asof).cast("date"), days)).cast("timestamp_ntz")
    return (table(spark, sf_dir, "events")
            .where(F.col("event_type").isin(CONTACT_EVENT_TYPES) & (F.col("ts") >= lo) & (F.col("ts") < hi))
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_contacts")))


def portfolio(spark: SparkSession, sf_dir: str, orders_asof: str = ORDERS_ASOF,
              events_asof: str = EVENTS_ASOF) -> DataFrame:
    """The account portfolio as known at the as-of dates (ACCOUNT columns + contacts, treatment, segment_raw). ``treatment``
    is the planned assignment (X4); ``training_portfolio`` has the one that happened."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    hist = order_history(spark, sf_dir, orders_asof)
    ev = contact_counts(spark, sf_dir, events_asof)
    asof = F.lit(orders_asof).cast("date")
    k = F.col("c_custkey")
    days_o = F.coalesce(F.datediff(asof, F.col("last_o")), F.lit(0))
    dpd = F.element_at(F.array(*[F.lit(v) for v in DPD_LADDER]), (_pmod(k + days_o, 9) + 1).cast("int"))
    chan = F.lit(DEFAULT_CHANNEL)
    for seg, ch in reversed(list(SEGMENT_CHANNEL.items())):
        chan = F.when(F.col("c_mktsegment") == seg, F.lit(ch)).otherwise(chan)
    return (cust.join(hist, k == hist.o_custkey, "left")
          .join(ev, k == ev.user_id, "left")
          .select(
              F.concat(F.lit("C"), (F.lit(1000) + k).cast("string")).alias("customer_id"),
              F.col("c_name").alias("customer_name"),
              k.alias("c_custkey"),
              (F.lit(21) + (k * 7) % 49).cast("int").alias("age"),
              round_stable(lit_d(20000) + (F.col("c_acctbal") + lit_d(1000)) * lit_d(11), 2).alias("income"),
              F.coalesce(F.col("loan_dec"), F.lit(0)).cast("double").alias("loan_amount"),
              F.coalesce(F.col("out_dec"), F.lit(0)).cast("double").alias("outstanding_amount"),
              (F.lit(300) + (k * 37) % 551).cast("double").alias("credit_score"),
              dpd.cast("int").alias("dpd"),
              F.coalesce(F.col("n_p"), F.lit(0)).cast("int").alias("missed_payment_count"),
              F.coalesce(F.col("n_f"), F.lit(0)).cast("int").alias("previous_ptp_count"),
              F.coalesce(F.col("n_fk"), F.lit(0)).cast("int").alias("previous_ptp_kept_count"),
              F.coalesce(F.col("n_r"), F.lit(0)).cast("int").alias("collection_attempts"),
              F.coalesce(F.col("n_rf"), F.lit(0)).cast("int").alias("successful_contacts"),
              F.coalesce(round_stable(lit_d(0.06) * F.col("max_f_price"), 2), lit_d(0.0))
               .alias("recent_payment_amount"),
              F.coalesce(F.datediff(asof, F.col("last_f")) % 180, F.lit(0)).cast("int")
               .alias("days_since_last_payment"),
              chan.alias("preferred_channel"),
              F.coalesce(F.col("n_contacts"), F.lit(0)).cast("int").alias("contacts_last_7_days"),
          )
          .withColumn("emi_amount", round_stable(F.col("loan_amount") * lit_d(0.03), 2))
          .withColumn("due_date", F.date_format(F.date_sub(asof, F.col("dpd")), "dd-MM-yyyy"))
          .withColumn("treatment", (hash_uniform(F.col("customer_id"), "treat") < lit_d(0.5)).cast("int"))
          .withColumn("segment_raw", (k % 4).cast("int")))


def contacted(spark: SparkSession, sf_dir: str, cut: str, days: int) -> DataFrame:
    """user_id of everyone with a contact event in the ``days`` before ``cut``."""
    return contact_counts(spark, sf_dir, cut, days).select("user_id")


def training_portfolio(spark: SparkSession, sf_dir: str, orders_cut: str = ORDERS_CUT, events_cut: str = EVENTS_CUT) -> DataFrame:
    """The portfolio as known at the cut-offs, with what happened after them as labels.

    will_pay: an order was fulfilled (F) within a year of ``orders_cut``; ptp_kept: one of a priority below 4 was;
    recovery_success: a returned line was collected (R, F) within that year. treatment: the account was contacted on the day
    before ``events_cut``; did_pay_last_cycle: it purchased within three days of it; kept_ptp_last_cycle: within one.
    Orders and events run on clocks of their own, each with its own cut-off; no feature uses a fact after its cut-off.
    """
    k = F.col("c_custkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderdate", "o_orderpriority")
    paid = PT.happened_after(orders, "o_custkey", "o_orderdate", [orders_cut], OUTCOME_DAYS,
                             {"will_pay": F.lit(True), "ptp_kept": F.col("o_orderpriority") < "4"})
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    # the horizon's lines per order first: a customer with many orders meets them as one row each
    collected = PT.happened_after(lines.select("l_orderkey", "l_shipdate"), "l_orderkey", "l_shipdate", [orders_cut], OUTCOME_DAYS,
                                  {"recovery_success": F.lit(True)})
    owner = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("l_custkey"))
    collected = (collected.join(owner, collected["l_orderkey"] == owner["o_orderkey"])
                 .groupBy("l_custkey").agg(F.max("recovery_success").alias("recovery_success")))
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select("user_id", "ts")
    cycle = PT.happened_after(events, "user_id", "ts", [events_cut], CYCLE_DAYS, {"did_pay_last_cycle": F.lit(True)}).drop("cut_index")
    kept = PT.happened_after(events, "user_id", "ts", [events_cut], 1, {"kept_ptp_last_cycle": F.lit(True)}).drop("cut_index")
    treated = contacted(spark, sf_dir, events_cut, 1).select(F.col("user_id").alias("t_user"), F.lit(1).alias("t"))
    cycle, kept = cycle.withColumnRenamed("user_id", "c_user"), kept.withColumnRenamed("user_id", "k_user")
    df = (portfolio(spark, sf_dir, orders_cut, events_cut)
          .join(paid.drop("cut_index"), k == F.col("o_custkey"), "left").join(collected, k == F.col("l_custkey"), "left")
          .join(cycle, k == F.col("c_user"), "left").join(kept, k == F.col("k_user"), "left").join(treated, k == F.col("t_user"), "left")
          .withColumn("treatment", F.coalesce("t", F.lit(0))).drop("o_custkey", "l_custkey", "c_user", "k_user", "t_user", "t"))
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in LABELS})


def accounts_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in ACCOUNT.fields])
