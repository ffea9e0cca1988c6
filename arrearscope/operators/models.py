"""Spark ML models (M1, M3, M5-M8, M10) and vectorisers.

Settings follow the reference (forests 250 x depth 10 x leaf 5, GBT 200 x depth 3 x 0.08, uplift forests
300 x depth 6, KMeans k=4 with 10 restarts). Fitted models are driver-side objects; the data they
train on is written once as a narrow table to the shared folder (``spark.checkpoint.dir``), so a lost executor reads files
again and nothing stays cached, and iterative fits checkpoint there every 10 iterations.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import lit_d
from ..session import shared_dir, written
from .splits import class_weights, cumulative_before, roc_auc, stratified_split

FIT_THREADS = 4  # independent fits are submitted as concurrent Spark jobs


def fit_all(fn, items, threads: int = FIT_THREADS) -> list:
    """Run independent fits concurrently from driver threads; results keep the order of ``items``."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if len(items) <= 1 or threads <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(threads, len(items))) as ex:
        return list(ex.map(fn, items))


RF = dict(numTrees=250, maxDepth=10, minInstancesPerNode=5, seed=42)
GBT = dict(maxIter=200, maxDepth=3, stepSize=0.08, seed=42)
UPLIFT_RF = dict(numTrees=300, maxDepth=6, seed=42)


def _ckpt(df: DataFrame) -> int:
    shared_dir(df.sparkSession, "ml")  # makes sure the context has a (shared) checkpoint folder
    return 10


def assembler(features: Sequence[str]) -> VectorAssembler:  # P2
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def p1(pred: DataFrame, name: str) -> DataFrame:
    """Class-1 probability as a double column (M5)."""
    return pred.withColumn(name, vector_to_array(F.col("probability"))[1])


def fit_forest(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, **kw):
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, **({**RF, **kw}),
                                maxMemoryInMB=1024, cacheNodeIds=True,
                                checkpointInterval=_ckpt(train), **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[assembler(features), rf]).fit(dealt(train, ROW_TREES_PER_TASK // rf.getNumTrees()))


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, **kw):
    gbt = GBTClassifier(featuresCol="features", labelCol=label, checkpointInterval=_ckpt(train), **({**GBT, **kw}))
    return Pipeline(stages=[assembler(features), gbt]).fit(dealt(train, ROWS_PER_BOOSTING_TASK))


ROWS_PER_TRAIN_PARTITION = 200_000
ROW_TREES_PER_TASK = 25_000_000  # a forest keeps a draw and a place per row and tree in its tasks: about 14 bytes each
ROWS_PER_BOOSTING_TASK = 50_000


def sized(df: DataFrame, n: int | None = None) -> DataFrame:
    """Repartition training data by its row count: tree learners run several jobs per iteration, so
    tiny inputs spread over many partitions pay task overhead hundreds of times, while big inputs
    still get ~200k rows per task."""
    n = df.count() if n is None else n
    return df.repartition(max(1, -(-n // ROWS_PER_TRAIN_PARTITION)))


def dealt(train: DataFrame, rows: int) -> DataFrame:
    """Training data over enough tasks for ``rows`` each. Reading packs the stored files into about as many tasks as there
    are cores, so what a task of a fit holds would grow with the input."""
    n = -(-train.count() // max(1, rows))
    return train.repartition(n) if n > 1 else train


def split_train_test(df: DataFrame, label: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, label, share, seed)
    s = written(sized(s, df.count()), f"train-{label}")
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def train_forests(df: DataFrame, features: Sequence[str], targets: Sequence[str], **kw) -> tuple[dict, DataFrame]:
    """M1 + M2 + M4: per target a balanced-weight forest on an 80/20 stratified split; test AUC."""
    def one(t):
        train, test = split_train_test(df.select("customer_id", *features, t), t, 0.2)
        m = fit_forest(class_weights(train, t).withColumnRenamed("weight", "w"), features, t, "w", **kw)
        auc = roc_auc(p1(m.transform(test), "score").select("score", F.col(t).alias("label")), "score", "label")
        return m, auc.select(F.lit(t).alias("target"), "auc", "positives", "negatives")

    fitted = fit_all(one, targets)
    models = {t: m for t, (m, _) in zip(targets, fitted)}
    out = fitted[0][1]
    for _, r in fitted[1:]:
        out = out.unionByName(r)
    return models, out


def train_gbts(df: DataFrame, features: Sequence[str], targets: Sequence[str], **kw) -> tuple[dict, dict, DataFrame]:
    """M3 + M4: per target a GBT on a 75/25 stratified split; returns models, test splits, AUC table."""
    def one(t):
        train, test = split_train_test(df.select("customer_id", *features, t), t, 0.25)
        m = fit_gbt(train, features, t, **kw)
        auc = roc_auc(p1(m.transform(test), "score").select("score", F.col(t).alias("label")), "score", "label")
        return m, test, auc.select(F.lit(t).alias("target"), "auc", "positives", "negatives")

    fitted = fit_all(one, targets)
    models = {t: f[0] for t, f in zip(targets, fitted)}
    tests = {t: f[1] for t, f in zip(targets, fitted)}
    out = fitted[0][2]
    for f in fitted[1:]:
        out = out.unionByName(f[2])
    return models, tests, out


def train_uplift(df: DataFrame, features: Sequence[str], label: str, **kw):  # M6: T-learner
    narrow = df.select(*features, label, "treatment")
    treated = written(sized(narrow.where(F.col("treatment") == 1)), "train-treated")
    control = written(sized(narrow.where(F.col("treatment") == 0)), "train-control")
    mt, mc = fit_all(lambda d: fit_forest(d, features, label, **({**UPLIFT_RF, **kw})), [treated, control])
    return mt, mc


def uplift_scores(df: DataFrame, m_treated, m_control) -> DataFrame:  # M7
    t = p1(m_treated.transform(df), "p_treated").drop("features", "rawPrediction", "probability", "prediction")
    both = p1(m_control.transform(t), "p_control").drop("features", "rawPrediction", "probability", "prediction")
    return both.withColumns({"uplift_score": F.col("p_treated") - F.col("p_control"),
                             "recovery_probability": F.col("p_treated")})


def feistel(x: Column, n: int, key: Column, rounds: int = 6) -> Column:
    """A keyed permutation of 0..n-1 as a column of ``x``: x is a pair (left of a, right of b values, a * b just above n), and
    every round adds a hash of one half to the other, which can be undone and so maps the pairs one to one. Pairs at or above
    n are walked on until they fall below it: fewer than one in sqrt(n) of them, so 64 steps are never used up."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(v):
        halves = F.struct(F.floor(v / F.lit(b)).cast("bigint").alias("l"), (v % F.lit(b)).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), halves, lambda h, r: F.struct(
            F.when(r % 2 == 0, (h["l"] + mixed(h["r"], key, r)) % F.lit(a)).otherwise(h["l"]).cast("bigint").alias("l"),
            F.when(r % 2 == 1, (h["r"] + mixed(h["l"], key, r)) % F.lit(b)).otherwise(h["r"]).cast("bigint").alias("r")),
            lambda h: h["l"] * F.lit(b) + h["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x.cast("bigint")), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def mixed(v: Column, key: Column, r: Column) -> Column:
    """Round function: products and a division of whole numbers below 2^63, so SQL can state the same."""
    key, r = key.cast("bigint"), r.cast("bigint")
    y = (v + key * F.lit(7919) + F.lit(104729) * (r + 1)) % F.lit(2147483647)
    y = (y * F.lit(48271)) % F.lit(2147483647)
    return F.floor((y * F.lit(69621)) % F.lit(2147483647) / F.lit(16)).cast("bigint")


def numbered(df: DataFrame, order: Sequence[str], n: int, rows_per_bucket: int = 200_000) -> DataFrame:
    """Adds ``row_no``, 0..n-1 in the order of a hash of the columns ``order``: numbers inside hash ranges plus the sizes of
    the ranges before, so no task numbers all rows."""
    buckets = max(1, -(-n // rows_per_bucket))
    h = df.withColumn("_h", F.xxhash64(*order))
    span = (1 << 64) // buckets + 1
    bucket = F.floor((F.col("_h").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(str(span)).cast("decimal(20,0)")).cast("int")
    return cumulative_before(h, [], bucket, [F.col("_h"), *[F.col(c) for c in order]]).withColumnRenamed("_before", "row_no").drop("_h")


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str, repeats: int = 15,
                           seed: int = 42) -> DataFrame:
    """M8: mean accuracy drop when one feature's values are shuffled across test rows.

    The test rows are numbered once and stored. In each repeat a row meets one donor, the row at the place that a keyed
    permutation of the numbers gives it: one join per repeat, in which both sides have one row per test row. The donor's
    vector then serves all features in-row: vector f is the row's own with the donor's value at f. The accuracies of a repeat
    are sums, reduced map-side; ``rows`` states how many test rows each rests on.
    """
    feats = list(features)
    n = test.count()
    vals = F.array(*[F.col(c).cast("double") for c in feats])
    t = written(numbered(test.select("customer_id", F.col(label).cast("double").alias("y"), vals.alias("x")), ["customer_id"], n), "permutation-rows")
    runs = t.select("row_no", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    runs = runs.withColumn("donor_no", feistel(F.col("row_no"), n, F.col("r") + F.lit(seed * 1000)))
    joined = runs.join(t.select(F.col("row_no").alias("donor_no"), F.col("x").alias("dx")), "donor_no")
    # vector -1 is the row as it is
    vectors = F.transform(F.sequence(F.lit(-1), F.lit(len(feats) - 1)), lambda f: F.struct(
        f.alias("f"), F.transform("x", lambda v, i: F.when(i == f, F.element_at("dx", i + 1)).otherwise(v)).alias("v")))
    swapped = joined.select("y", "r", F.explode(vectors).alias("s")).select("y", "r", "s.f", array_to_vector("s.v").alias("features"))
    scored = model.stages[-1].transform(swapped)
    acc = scored.groupBy("f", "r").agg(F.count_if(F.col("prediction") == F.col("y")).alias("right"), F.count(F.lit(1)).alias("rows"))
    base = acc.where("f = -1").select("r", (F.col("right") / F.col("rows")).alias("base"))
    drop = F.col("base") - F.col("right") / F.col("rows")
    names = F.array(*[F.lit(c) for c in feats])
    return (acc.where("f >= 0").join(base, "r").groupBy("f")
            .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std"), F.min("rows").alias("rows"))
            .select(F.element_at(names, F.col("f") + 1).alias("feature"), "importance", "importance_std", "rows"))


def importance_order(imp: DataFrame) -> DataFrame:  # L3 (features: a bounded list)
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w))


def kmeans_segments(df: DataFrame, features: Sequence[str], k: int = 4, restarts: int = 10, seed: int = 42, max_iter: int = 50,
                    tol: float = 1e-4, sample: int = 10_000):
    """M9 + M10: population-std standardisation, then ``restarts`` runs of k-means at once; the one of least cost wins.

    Every iteration is one job for all restarts: each batch of rows is assigned to the nearest centroid of every restart and
    leaves one partial sum per (restart, centroid), so what is shuffled doesn't grow with the rows. A restart whose centroids
    move less than ``tol`` stops by itself. Starts are k-means++ draws (seeds seed, seed + 1, ...) from the ``sample`` rows
    with the smallest hash of their id. Returns (centroids and costs of all restarts, least cost, assigned rows).
    """
    import numpy as np

    from .segments import standardize
    z = written(sized(standardize(df.select("customer_id", *features), features, keep=["customer_id"])
                      .select("customer_id", F.array(*[F.col(c) for c in features]).alias("x"))), "kmeans-rows")
    first = z.orderBy(F.xxhash64("customer_id", F.lit(seed)), "customer_id").limit(sample).toPandas()
    points = np.array(first["x"].tolist(), dtype=float).reshape(-1, len(features))
    centers = np.stack([plus_plus(points, k, seed + r) for r in range(restarts)])
    running, costs = np.ones(restarts, bool), np.full(restarts, np.inf)
    for _ in range(max_iter):
        sums, counts, costs_now = assigned_sums(z, centers, running)
        for r in np.flatnonzero(running):
            moved = np.where(counts[r][:, None] > 0, sums[r] / np.maximum(counts[r], 1)[:, None], centers[r])
            shift = ((moved - centers[r]) ** 2).sum(axis=1).max()
            centers[r], costs[r] = moved, costs_now[r]
            running[r] = shift > tol * tol
        if not running.any():
            break
    _, _, costs = assigned_sums(z, centers, np.ones(restarts, bool))
    best = int(np.argmin(np.round(costs, 9)))
    spark = df.sparkSession
    runs = spark.createDataFrame([(r, c, [float(v) for v in centers[r, c]], float(costs[r])) for r in range(restarts) for c in range(k)],
                                 "restart int, segment_raw int, center array<double>, cost double")
    packed = F.array(*[F.struct(F.lit(c).alias("cid"), F.array(*[lit_d(v) for v in centers[best, c]]).alias("v")) for c in range(k)])
    near = F.array_min(F.transform(packed, lambda c: F.struct(sq_distance(F.col("x"), c["v"]).alias("d"), c["cid"].alias("cid"))))
    pred = z.select("customer_id", near["cid"].alias("segment_raw"), "x", near["d"].alias("sq_dist"))
    return runs, float(costs[best]), pred


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit_d(0.0), lambda s, v: s + v)


def plus_plus(points, k: int, seed: int):
    """k starting centroids by k-means++ draws."""
    import numpy as np
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    for _ in range(k - 1):
        d = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(points[rng.choice(len(points), p=d / d.sum())] if d.sum() > 0 else points[rng.integers(len(points))])
    return np.array(chosen)


def assigned_sums(rows: DataFrame, centers, running):
    """(sums, counts, costs) of the running restarts' centroids over all rows: one job, one partial per batch and centroid."""
    import numpy as np
    restarts, k, dims = centers.shape

    def run(batches):
        import pyarrow as pa
        total, count, cost = np.zeros((restarts, k, dims)), np.zeros((restarts, k), np.int64), np.zeros(restarts)
        for batch in batches:
            n = batch.num_rows
            x = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, dims).T)
            for r in np.flatnonzero(running):
                d = np.stack([sum((x[f] - c[f]) ** 2 for f in range(dims)) for c in centers[r]])
                near = d.argmin(axis=0)
                cost[r] += d[near, np.arange(n)].sum()
                count[r] += np.bincount(near, minlength=k)
                for f in range(dims):
                    total[r, :, f] += np.bincount(near, weights=x[f], minlength=k)
        yield pa.RecordBatch.from_pydict({"r": pa.array(np.repeat(np.arange(restarts), k), pa.int32()), "c": pa.array(np.tile(np.arange(k), restarts), pa.int32()),
                                          "n": pa.array(count.ravel()), "s": pa.array(total.reshape(-1, dims).tolist(), pa.list_(pa.float64())),
                                          "cost": pa.array(np.repeat(cost / k, k))})

    parts = rows.select("x").mapInArrow(run, "r int, c int, n long, s array<double>, cost double")
    found = parts.groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                        F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(dims)]).alias("s")).collect()
    sums, counts, costs = np.zeros((restarts, k, dims)), np.zeros((restarts, k), np.int64), np.zeros(restarts)
    for row in found:  # restarts x k rows
        sums[row.r, row.c], counts[row.r, row.c] = row.s, row.n
        costs[row.r] += row.cost
    return sums, counts, costs


def embed_chunks(chunks: DataFrame, num_features: int = 1 << 18):  # R2 (lexical vectoriser, not semantic)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="embedding_vec", p=2.0)])
    model = pipe.fit(chunks)
    return model, model.transform(chunks).drop("tokens", "tf", "tfidf")


def lsh_topk(corpus: DataFrame, queries: DataFrame, k: int = 4, bucket_length: float = 0.5,
             num_tables: int = 4, max_dist: float = 2.1, seed: int = 42) -> DataFrame:
    """Approximate R4 with random-projection LSH on unit vectors (Euclidean distance; cosine =
    1 - d^2 / 2). Candidate pairs come only from shared hash buckets, so recall < 1 by design; ``max_dist`` cuts none of them
    by default (unit vectors are at most 2 apart). ``ivf.search`` always finds k."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    c = corpus.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    q = queries.select("query_id", array_to_vector("qvec").alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed).fit(c)
    pairs = lsh.approxSimilarityJoin(q, c, max_dist, distCol="dist").select(
        F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"),
        (F.lit(1.0) - F.col("dist") * F.col("dist") / F.lit(2.0)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
