"""Segment profiling and labelling (A13, W3, J1, M12, X3, F32), standardisation (M9) and
nearest-centroid assignment (M11).

The profile is one row per cluster (k rows), so ranking it with an unpartitioned window and looking labels up
in one map value is bounded by k, not by the data.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import lit_d, round_stable

SELF_PAYER = "Steady Self-Payers"
# ---- fixed values: labels for the remaining clusters in uplift order, and handling advice ----
OTHER_LABELS = ["High-Value Responders", "Needs Restructuring", "Hard-to-Recover"]
STRATEGY = {
    "High-Value Responders": "moderate risk, high uplift → prioritize live contact.",
    "Steady Self-Payers": "will likely pay regardless → light-touch reminders only, save capacity.",
    "Needs Restructuring": "high risk but still responsive → offer payment plans, not pressure.",
    "Hard-to-Recover": "low probability, low uplift → route to write-off review / legal, not repeated outreach.",
}
# ---- end fixed values ----


def cluster_profile(df: DataFrame, cluster: str = "segment_raw") -> DataFrame:  # A13
    return df.groupBy(cluster).agg(F.avg("uplift_score").alias("mean_uplift"),
                                   F.avg("payment_probability").alias("mean_pay"),
                                   F.avg("dpd").alias("mean_dpd"))


def segment_labels(profile: DataFrame, cluster: str = "segment_raw") -> DataFrame:  # W3 + M12
    """Best mean pay -> Steady Self-Payers; the rest by mean uplift desc -> OTHER_LABELS (last repeats)."""
    w_pay = Window.orderBy(F.col("mean_pay").desc(), F.col(cluster))
    ranked = profile.withColumn("pay_rank", F.row_number().over(w_pay))
    w_up = Window.partitionBy(F.col("pay_rank") == 1).orderBy(F.col("mean_uplift").desc(), F.col(cluster))
    others = F.array(*[F.lit(x) for x in OTHER_LABELS])
    return ranked.withColumn(
        "segment", F.when(F.col("pay_rank") == 1, F.lit(SELF_PAYER))
        .otherwise(F.element_at(others, F.least(F.row_number().over(w_up), F.lit(len(OTHER_LABELS))).cast("int"))))


def label_segments(df: DataFrame, cluster: str = "segment_raw") -> DataFrame:  # J1
    """Adds ``segment``. The k labels come as one map value from a scalar subquery over the columns that the profile
    needs; a query that doesn't read ``segment`` drops the subquery, and filters still reach the scans of ``df``."""
    labels = segment_labels(cluster_profile(df, cluster), cluster)
    by_cluster = labels.agg(F.map_from_entries(F.collect_list(F.struct(cluster, "segment"))).alias("m")).scalar()
    return df.where(F.col(cluster).isNotNull()).withColumn("segment", F.element_at(by_cluster, F.col(cluster)))


def remaining_clusters(profile_ranked: DataFrame, cluster: str = "segment_raw") -> DataFrame:  # X3
    used = profile_ranked.where(F.col("pay_rank") == 1).select(cluster)
    return profile_ranked.join(used, cluster, "left_anti")


def segment_strategy(df: DataFrame) -> DataFrame:  # F32
    m = F.create_map(*[x for kv in STRATEGY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn("strategy", F.element_at(m, F.col("segment")))


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:  # M9
    """(x - mean) / population std; a zero std maps to 0. The moments are one scalar-subquery row."""
    mom = df.agg(F.struct(*[F.avg(c).alias(f"mu_{c}") for c in cols],
                          *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).alias("m")).scalar()
    return df.select(*keep, *[F.coalesce(F.try_divide(F.col(c) - mom[f"mu_{c}"],
                                                      F.when(mom[f"sd_{c}"] != 0, mom[f"sd_{c}"])),
                                         lit_d(0.0)).alias(c) for c in cols])


def assign_nearest(df: DataFrame, centroids: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:  # M11
    """Nearest centroid by squared distance (ties -> lower cluster id).

    The k centroids are packed into one array value by a scalar subquery (evaluated once, shipped to
    every task); each account computes its k distances in-row, so there is no join and no fan-out.
    """
    packed = centroids.agg(F.collect_list(F.struct(F.col(cluster).alias("cid"),
                                                   F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))
                           .alias("cents")).scalar()
    x = F.array(*[F.col(c).cast("double") for c in cols])
    dist = F.transform("_cents", lambda c: F.struct(
        F.aggregate(F.zip_with(c["v"], x, lambda a, b: (a - b) * (a - b)), lit_d(0.0), lambda acc, y: acc + y)
        .alias("d"), c["cid"].alias("cid")))
    best = F.array_min(dist)
    return (df.withColumn("_cents", packed)
            .select(*df.columns, best["cid"].alias(cluster), round_stable(best["d"], 9).alias("sq_dist")))
