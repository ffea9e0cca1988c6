"""As-of features and outcomes against a plain version; nothing after a cut-off reaches a feature."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arrearscope.operators import pointintime as PT
from arrearscope.sources import portfolio as P
from conftest import SF_SMALL

CUTS = ["2024-01-01", "2024-02-01", "2024-02-10", "2024-06-01"]


def facts():
    rng = random.Random(2)
    edge = [dt.datetime.fromisoformat(c) + dt.timedelta(microseconds=d) for c in CUTS for d in (-1, 0, 1)]
    edge += [dt.datetime.fromisoformat(c) + dt.timedelta(days=20, microseconds=d) for c in CUTS for d in (-1, 0)]
    # key 0 holds a third of all facts; some have no time or no value
    rows = [(rng.choice([0, 0, rng.randrange(9)]), t, rng.randrange(100)) for t in edge * 4]
    rows += [(rng.choice([0, 0, rng.randrange(9)]), dt.datetime(2023, 11, 1) + dt.timedelta(hours=rng.randrange(6000)), rng.choice([None, rng.randrange(100)])) for _ in range(300)]
    return rows + [(1, None, 5), (None, dt.datetime(2024, 1, 15), 7)]


def test_equals_plain_version(spark):
    rows = facts()
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, v long").repartition(5)
    got = {(r.k, r.cut_index): (r.n, r.s, r.m) for r in PT.known_before(df, "k", "t", CUTS, {"n": F.lit(1), "s": F.col("v")}, {"m": F.col("v")}).collect()}
    want = {}
    for i, c in enumerate(map(dt.datetime.fromisoformat, CUTS)):
        for k in {r[0] for r in rows}:
            mine = [v for kk, t, v in rows if kk == k and t is not None and t < c]
            if mine:
                known = [v for v in mine if v is not None]
                want[k, i] = (len(mine), sum(known) if known else None, max(known, default=None))
    assert got == want
    got = {(r.k, r.cut_index): (r.any, r.high) for r in PT.happened_after(df, "k", "t", CUTS, 20, {"any": F.lit(True), "high": F.col("v") > 90}).collect()}
    want = {}
    for i, c in enumerate(map(dt.datetime.fromisoformat, CUTS)):
        for k in {r[0] for r in rows}:
            mine = [v for kk, t, v in rows if kk == k and t is not None and c <= t < c + dt.timedelta(days=20)]
            if mine:
                want[k, i] = (1, int(any(v is not None and v > 90 for v in mine)))
    assert got == want


def test_cut_offs_ascend(spark):
    df = spark.createDataFrame([], "k long, t timestamp_ntz")
    with pytest.raises(ValueError):
        PT.known_before(df, "k", "t", CUTS[::-1])
    assert PT.known_before(df, "k", "t", CUTS, {"n": F.lit(1)}).count() == 0
    assert PT.at_cuts(spark.range(3), CUTS).count() == 12


def test_later_facts_do_not_reach_features(spark, tmp_path):
    """Taking away every fact after the cut-offs changes labels only."""
    for t in ("customer", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        time, cut = {"orders": ("o_orderdate", P.ORDERS_CUT), "lineitem": ("l_shipdate", P.ORDERS_CUT), "events": ("ts", P.EVENTS_CUT)}.get(t, (None, None))
        (df if time is None else df.where(F.col(time) < F.lit(cut).cast("timestamp_ntz"))).write.parquet(str(tmp_path / f"{t}.parquet"))
    full, cut = P.training_portfolio(spark, SF_SMALL), P.training_portfolio(spark, str(tmp_path))
    features = [c for c in full.columns if c not in P.LABELS]
    assert sorted(map(str, full.select(features).collect())) == sorted(map(str, cut.select(features).collect()))
    assert cut.agg(*[F.max(c).alias(c) for c in P.LABELS]).collect()[0] == (0, 0, 0, 0, 0)
    rates = full.agg(*[F.avg(c).alias(c) for c in P.LABELS]).collect()[0].asDict()
    assert all(0 < v < 1 for v in rates.values()), rates
    assert full.groupBy("treatment").agg(F.countDistinct("did_pay_last_cycle").alias("n")).where("n = 2").count() == 2
