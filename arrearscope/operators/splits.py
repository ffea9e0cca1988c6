"""Repeatable splits, class weights and exact AUC.

Exact ranks without a single-partition sort: rows are cut into value buckets whose order agrees with
the sort order; a row's rank is (rows in earlier buckets) + (its row_number inside its bucket). The
per-bucket totals are a small table (labels x buckets) whose join is left to Spark, and the largest
window partition is one bucket, not a whole label.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform, lit_d, round_stable
from ..session import written


def assign_treatment(df: DataFrame, key: str = "customer_id", salt: str = "treat") -> DataFrame:  # X4
    return df.withColumn("treatment", (hash_uniform(F.col(key), salt) < lit_d(0.5)).cast("int"))


def treatment_partition(df: DataFrame) -> tuple[DataFrame, DataFrame]:  # X2
    return df.where(F.col("treatment") == 1), df.where(F.col("treatment") == 0)


def cumulative_before(df: DataFrame, parts: Sequence[str], bucket: Column, order: Sequence[Column],
                      value: Column | None = None) -> DataFrame:
    """Adds ``_before``: sum of ``value`` (default 1) over rows ordered strictly before this one within
    ``parts``, where ``bucket`` is monotone in ``order``."""
    v = value if value is not None else F.lit(1)
    d = df.withColumns({"_bkt": bucket, "_v": v.cast("bigint")})
    w_in = (Window.partitionBy(*parts, "_bkt").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(w_in), F.lit(0)))
    sizes = d.groupBy(*parts, "_bkt").agg(F.sum("_v").alias("_bn"))
    w_off = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(w_off), F.lit(0))).drop("_bn")
    return (d.join(offs, [*parts, "_bkt"], "inner")
            .withColumn("_before", F.col("_off") + F.col("_in")).drop("_off", "_in", "_v", "_bkt"))


def stratified_split(df: DataFrame, label: str, test_share: float, seed: int = 42, key: str = "customer_id",
                     buckets: int | None = None) -> DataFrame:  # X1
    """Adds ``is_test``: per label, the ceil(share x n_label) rows with the smallest md5 draw are test.

    The draw is uniform by construction, so equal-width buckets of it are equally full.
    """
    if buckets is None:
        n = df.count()
        buckets = max(1, -(-n // 200_000))
    u = hash_uniform(F.col(key), f"split{seed}")
    r = cumulative_before(df.withColumn("_u", u), [label], F.floor(F.col("_u") * buckets),
                          [F.col("_u"), F.col(key)])
    n_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return (r.join(n_label, label, "inner")
            .withColumn("is_test", (F.col("_before") + 1) <= F.ceil(F.col("_n") * lit_d(test_share)))
            .drop("_before", "_n", "_u"))


def class_weights(df: DataFrame, label: str) -> DataFrame:  # M2: n / (2 n_class), balanced
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n_classes = counts.agg(F.struct(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    w = counts.select(label, (n_classes["n"].cast("double") / (n_classes["k"].cast("double") * F.col("_nc")))
                      .alias("weight"))
    return df.join(w, label, "inner")


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
            rows_per_bucket: int = 100_000) -> DataFrame:  # M4
    """Exact tie-averaged AUC: sum over positives of (negatives below + half the tied negatives) / (P x N).

    Rows collapse to one per distinct score first (map-side combine), so a pile-up of equal scores is
    one row. The distinct scores are then cut at approximate quantiles (about ``rows_per_bucket`` distinct
    scores per bucket, as many buckets as that takes) and a bucketed prefix sum of negatives runs over
    them: no task holds more than one bucket, however the scores cluster.
    """
    from pyspark.ml.feature import Bucketizer
    # one row per distinct score: small next to the input, and read three times below
    d = written(df.groupBy(*by, score)
                .agg(F.count_if(F.col(label) == 1).alias("npos"), F.count_if(F.col(label) != 1).alias("nneg")), "auc-scores")
    buckets = max(1, -(-d.count() // rows_per_bucket))
    if buckets == 1:
        bkt = F.lit(0)
        c = cumulative_before(d, list(by), bkt, [F.col(score)], F.col("nneg"))
    else:
        cuts = d.withColumn("_x", F.col(score).cast("double")).approxQuantile("_x", [i / buckets for i in range(1, buckets)], 0.1 / buckets)
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        d = Bucketizer(splits=splits, inputCol="_x", outputCol="_cut", handleInvalid="keep").transform(
            d.withColumn("_x", F.col(score).cast("double")))
        c = cumulative_before(d, list(by), F.col("_cut"), [F.col(score)], F.col("nneg"))
    return (c.groupBy(*by)
            .agg(F.sum(F.col("npos") * (F.col("_before") + lit_d(0.5) * F.col("nneg"))).alias("num"),
                 F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
            .select(*by, round_stable(F.try_divide(F.col("num"), F.col("P").cast("double") * F.col("N")), 9)
                    .alias("auc"), F.col("P").alias("positives"), F.col("N").alias("negatives")))
