"""Point-in-time (as-of) features and outcomes: what was known before a cut-off, and what happened after it.

Facts are dated rows of a key (a customer's orders, lines, events). For every key and every cut-off of a short list,
``known_before`` gives aggregates over the facts strictly before the cut-off, ``happened_after`` over those in the horizon
that begins at it, so no feature can see its own outcome.

A fact isn't copied per cut-off: it is put into the interval between two cut-offs in which it falls, and intervals are
reduced map-side to one row per (key, interval), so a key with a third of all facts is spread over all tasks first. Only
those rows, at most one per cut-off and key, are carried on to the later cut-offs.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_array(cuts: Sequence[str]) -> Column:
    return F.array(*[F.lit(c).cast("timestamp_ntz") for c in cuts])


def known_before(facts: DataFrame, key: str, time: str, cuts: Sequence[str], sums: Mapping[str, Column] | None = None,
                 maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, cut_index, the sums and maxima) over facts before each cut-off; cut-offs ascend. Keys without facts before a
    cut-off have no row for it."""
    if list(cuts) != sorted(cuts):
        raise ValueError("cut-offs must ascend")
    sums, maxima = dict(sums or {}), dict(maxima or {})
    last = len(cuts) - 1
    ts = F.col(time).cast("timestamp_ntz")
    # the first cut-off after the fact: from there on it is known
    since = F.size(F.filter(cut_array(cuts), lambda c: c <= ts))
    partial = (facts.where(ts < F.lit(cuts[last]).cast("timestamp_ntz")).groupBy(F.col(key).alias(key), since.alias("since"))
               .agg(*[F.sum(v).alias(n) for n, v in sums.items()], *[F.max(v).alias(n) for n, v in maxima.items()]))
    carried = partial.withColumn("cut_index", F.explode(F.sequence(F.col("since"), F.lit(last))))
    return carried.groupBy(key, "cut_index").agg(*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima])


def happened_after(facts: DataFrame, key: str, time: str, cuts: Sequence[str], days: int, flags: Mapping[str, Column]) -> DataFrame:
    """(key, cut_index, one 0/1 column per flag): whether a fact in [cut-off, cut-off + days) has it. Keys without a fact in
    a horizon have no row for it."""
    ts = F.col(time).cast("timestamp_ntz")
    horizon = F.expr(f"INTERVAL {int(days)} DAYS")
    inside = F.filter(F.transform(cut_array(cuts), lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
                      lambda x: (x["c"] <= ts) & (ts < x["c"] + horizon))
    # horizons may overlap: a fact then counts in each that holds it
    within = (ts >= F.lit(min(cuts)).cast("timestamp_ntz")) & (ts < F.lit(max(cuts)).cast("timestamp_ntz") + horizon)
    hit = facts.where(within).select(F.col(key).alias(key), F.explode(F.transform(inside, lambda x: x["i"])).alias("cut_index"), *[v.cast("int").alias(n) for n, v in flags.items()])
    return hit.groupBy(key, "cut_index").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in flags])


def at_cuts(keys: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """Every key at every cut-off: cut_index and cut (the time)."""
    return keys.select("*", F.posexplode(cut_array(cuts)).alias("cut_index", "cut"))
