"""Channel bandit over an outcome log.

Posteriors are Beta(1 + successes, 1 + failures) per (segment, channel), so the posterior table is
bounded by segments x channels and is the only side ever broadcast. Outcomes are pre-aggregated per
(user, channel) before meeting the account table, so a customer with a third of all outcomes becomes
at most one row per channel before any shuffle join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import lit_d, round_stable
from ..schema import CHANNELS

DEFAULT_RATE = 0.2
LARGE_COUNT = 1000.0  # posteriors with both counts from here on have their distribution integrated
QUADRATURE_POINTS = 40


def channel_array():
    return F.array(*[F.lit(c) for c in CHANNELS])


def outcome_log(events: DataFrame) -> DataFrame:
    """Outcome log from the event table: click = success, view = failure; channel = k mod 4."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (events.where(F.col("event_type").isin("click", "view"))
            .select("event_id", "ts", "user_id",
                    F.element_at(channel_array(), (F.pmod(k, F.lit(4)) + 1)).alias("channel"),
                    (F.col("event_type") == "click").cast("int").alias("outcome"),
                    F.to_date("ts").alias("batch_id")))


def prior(segments: DataFrame) -> DataFrame:  # B1: Beta(1,1) for every segment x channel
    return (segments.select("segment").distinct()
            .select("segment", F.posexplode(channel_array()).alias("channel_order", "channel"))
            .withColumns({"alpha": lit_d(1.0), "beta": lit_d(1.0)}))


def update(prior_df: DataFrame, outcomes: DataFrame, accounts: DataFrame,
           user: str = "user_id", key: str = "c_custkey") -> DataFrame:  # B2
    per_user = outcomes.groupBy(user, "channel").agg(F.sum("outcome").alias("s"),
                                                     F.sum(F.lit(1) - F.col("outcome")).alias("f"))
    seg = accounts.select(F.col(key).alias(user), "segment")
    per_seg = (per_user.join(seg, user, "inner")
               .groupBy("segment", "channel").agg(F.sum("s").alias("s"), F.sum("f").alias("f")))
    return posterior(prior_df, per_seg)


def posterior(prior_df: DataFrame, counts: DataFrame) -> DataFrame:
    """The prior plus successes ``s`` and failures ``f`` per (segment, channel)."""
    return (prior_df.join(counts, ["segment", "channel"], "left")
            .select("segment", "channel", "channel_order",
                    (F.col("alpha") + F.coalesce(F.col("s"), F.lit(0))).cast("double").alias("alpha"),
                    (F.col("beta") + F.coalesce(F.col("f"), F.lit(0))).cast("double").alias("beta")))


def rates(post: DataFrame) -> DataFrame:  # B3
    return post.withColumns({
        "estimated_success_rate": round_stable(F.col("alpha") / (F.col("alpha") + F.col("beta")), 9),
        "trials": (F.col("alpha") + F.col("beta") - lit_d(2)).cast("bigint"),
    })


def best_channel(rated: DataFrame) -> DataFrame:  # W1: first channel in fixed order on ties
    w = Window.partitionBy("segment").orderBy(F.col("estimated_success_rate").desc(), F.col("channel_order"))
    return (rated.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("segment", F.col("channel").alias("recommended_channel"), "estimated_success_rate", "trials"))


def posterior_join(accounts: DataFrame, post: DataFrame) -> DataFrame:  # J4: account -> its 4 posteriors
    return accounts.join(post, "segment", "inner")


def rate_lookup(accounts: DataFrame, rated: DataFrame, channel_col: str = "preferred_channel") -> DataFrame:  # J5
    r = rated.select("segment", F.col("channel").alias(channel_col), "estimated_success_rate")
    return (accounts.join((r), ["segment", channel_col], "left")
            .withColumn("rate", F.coalesce(F.col("estimated_success_rate"), lit_d(DEFAULT_RATE)))
            .drop("estimated_success_rate"))


def rounds(outcomes: DataFrame) -> DataFrame:  # B5
    return outcomes.agg(F.countDistinct("batch_id").alias("bandit_rounds"))


PICK_SCHEMA = T.StructType([T.StructField("customer_id", T.StringType()),
                            T.StructField("segment", T.StringType()),
                            T.StructField("recommended_channel", T.StringType()),
                            T.StructField("draws", T.ArrayType(T.DoubleType()))])


def reset(post: DataFrame) -> DataFrame:  # B6: forget every outcome; same (segment, channel) rows
    return post.select("segment", "channel", "channel_order").distinct() \
        .withColumns({"alpha": lit_d(1.0), "beta": lit_d(1.0), "bandit_rounds": F.lit(0).cast("bigint")})


def log_beta(a, b):
    """ln B(a, b) of arrays with few distinct values."""
    import math

    import numpy as np
    pairs, at = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
    return np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in pairs])[at.reshape(-1)]


def beta_cdf(x, a, b, ln):
    """Regularised incomplete beta function for 0 < x < 1; ln = log_beta(a, b): by its continued fraction, whose steps grow
    with the root of a and b, and where both are large by a quadrature of fixed cost."""
    import numpy as np
    out, large = np.empty_like(x), np.minimum(a, b) >= LARGE_COUNT
    for part, rule in ((large, _cdf_quadrature), (~large, _cdf_fraction)):
        if part.any():
            out[part] = rule(x[part], a[part], b[part], ln[part])
    return out


def _cdf_quadrature(x, a, b, ln):
    """The tail that begins at x and leads away from the mean, to where nothing is left of it, by Gauss-Legendre points."""
    import numpy as np
    points, weights = np.polynomial.legendre.leggauss(QUADRATURE_POINTS)
    mean = a / (a + b)
    sd = np.sqrt(mean * (1.0 - mean) / (a + b + 1.0))
    up = x > mean
    width = np.where(up, np.minimum(1.0 - x, np.maximum(mean + 10.0 * sd - x, 5.0 * sd)),
                     -np.minimum(x, np.maximum(x - mean + 10.0 * sd, 5.0 * sd)))
    area = np.zeros_like(x)
    for p, w in zip(points, weights):
        t = width * (0.5 * (p + 1.0))
        area += 0.5 * w * np.exp((a - 1.0) * np.log1p(t / x) + (b - 1.0) * np.log1p(-t / (1.0 - x)))
    tail = area * np.abs(width) * np.exp((a - 1.0) * np.log(x) + (b - 1.0) * np.log1p(-x) - ln)
    return np.where(up, 1.0 - tail, tail)


def _cdf_fraction(x, a, b, ln):
    """Modified Lentz evaluation of the continued fraction."""
    import numpy as np
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - ln) / p
    tiny = 1e-300

    def safe(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c, d = np.ones_like(y), 1.0 / safe(1.0 - (p + q) * y / (p + 1.0))
    h = d.copy()
    todo = np.arange(len(y))
    for m in range(1, 1000):
        pm, qm, ym, cm, dm = p[todo], q[todo], y[todo], c[todo], d[todo]
        for num in (m * (qm - m) * ym / ((pm + 2 * m - 1) * (pm + 2 * m)), -(pm + m) * (pm + qm + m) * ym / ((pm + 2 * m) * (pm + 2 * m + 1))):
            dm, cm = 1.0 / safe(1.0 + num * dm), safe(1.0 + num / cm)
            h[todo] *= dm * cm
        c[todo], d[todo] = cm, dm
        todo = todo[np.abs(dm * cm - 1.0) > 1e-14]
        if not len(todo):
            break
    tail = front * h
    return np.where(swap, 1.0 - tail, tail)


def beta_quantile(u, a, b):
    """x with beta_cdf(x; a, b) = u for arrays: Newton steps inside a bracket that every step narrows."""
    import numpy as np
    u, a, b = (np.asarray(v, dtype=float) for v in (u, a, b))
    ln = log_beta(a, b)
    lo, hi, mean = np.zeros_like(u), np.ones_like(u), a / (a + b)
    z = (u ** 0.135 - (1.0 - u) ** 0.135) / 0.1975  # about the normal quantile: a start near the answer
    x = mean + z * np.sqrt(mean * (1.0 - mean) / (a + b + 1.0))
    x = np.where((x > 0.0) & (x < 1.0), x, mean)
    left = np.arange(len(u))
    for _ in range(100):
        if not len(left):
            break
        xs, al, bl, ll = x[left], a[left], b[left], ln[left]
        off = beta_cdf(xs, al, bl, ll) - u[left]
        hi[left] = np.where(off > 0, xs, hi[left])
        lo[left] = np.where(off > 0, lo[left], xs)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            slope = np.exp((al - 1.0) * np.log(xs) + (bl - 1.0) * np.log1p(-xs) - ll)
            step = xs - off / slope
        new = np.where((step > lo[left]) & (step < hi[left]), step, (lo[left] + hi[left]) / 2.0)
        x[left] = new
        left = left[(np.abs(new - xs) > 1e-12 * np.minimum(new, 1.0 - new)) & (hi[left] - lo[left] > 1e-16)]
    return x


def thompson_pick(accounts: DataFrame, post: DataFrame, seed: int = 42) -> DataFrame:  # B4
    """One Beta draw per channel per account; the channel of the largest draw (ties: the first) and the draws.

    A draw is the posterior's quantile at a uniform number hashed from seed, account and channel, so it doesn't depend on
    how rows are partitioned or batched, and a whole batch is drawn by a few vector operations. The posteriors are a
    table of segments that meets the accounts in an equi-join. Accounts are few bytes and much arithmetic, so they are dealt
    over all shuffle partitions, which Spark would otherwise merge by their bytes.
    """
    tasks = int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = post.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("channel_order", "channel", "alpha", "beta"))).alias("arms"))
    u = F.transform("arms", lambda x: hash_uniform_of(F.concat_ws(":", F.lit(str(seed)), "customer_id", x["channel"])))
    rows = (accounts.select("customer_id", "segment").join(packed, "segment", "inner").repartition(tasks)
            .select("customer_id", "segment", F.transform("arms", lambda x: x["channel"]).alias("channels"),
                    F.transform("arms", lambda x: x["alpha"]).alias("a"), F.transform("arms", lambda x: x["beta"]).alias("b"), u.alias("u")))

    def draw(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["u"].map(len).to_numpy()
            flat = [np.concatenate(pdf[c].to_list()).astype(float) for c in ("u", "a", "b")]
            cuts = np.cumsum(size)[:-1]
            draws = np.split(beta_quantile(*flat), cuts)
            yield pd.DataFrame({"customer_id": pdf["customer_id"], "segment": pdf["segment"],
                                "recommended_channel": [c[int(np.argmax(d))] for c, d in zip(pdf["channels"], draws)],
                                "draws": [d.tolist() for d in draws]})

    return rows.mapInPandas(draw, PICK_SCHEMA)


def hash_uniform_of(text):
    """A number strictly between 0 and 1 from the text's hash."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + lit_d(0.5)) / lit_d(4294967296.0)


def carry_on(table, batch: object, outcomes: DataFrame, segments: DataFrame) -> bool:
    """B2 over time: add one batch of the outcome log to a table of counts (``streaming.streams.POSTERIOR_COUNTS``). A batch
    that is there already changes nothing; only the new batch is read. False if it was there."""
    per_user = outcomes.groupBy("user_id", "channel").agg(F.sum("outcome").alias("s"), F.sum(F.lit(1) - F.col("outcome")).alias("f"))
    counts = per_user.join(segments.select("user_id", "segment"), "user_id").groupBy("segment", "channel").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))
    return table.add(batch, {"counts": counts})
