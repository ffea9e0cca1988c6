"""Sharding by Karmarkar-Karp differencing: indivisible groups, byte-balanced shards.

Method. A partial partition is a vector of part sums. Differencing repeatedly takes the two partial
partitions with the largest spread (largest minus smallest part) and adds them in opposite order, so the
large part of one meets the small part of the other; the last vector left is the partition.

Scale. Groups (equal texts) are hashed into blocks of bounded size. Let the bar be the total weight / ``heavy``. In a block every
group above the bar stays an item of its own (there are at most ``heavy`` of them in the whole table); the others are
differenced into bundles of about the bar's weight, which are the items of the next level, and ``change``
groups of the block, evenly spread over its weights, go up unbundled: small change for the last differencing steps. Levels repeat until at most ``block``
items are left; these are differenced into the shards.
No task ever holds more than about ``block`` items, and nothing is sent to the driver but counts.

Edge cases. Null text counts as the empty text (size 1); repeated rows form one group and share a shard;
ties are broken by group key, so results repeat; an empty table gives an empty result; further columns are
ignored.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import no_text, stored


def difference(weights, parts: int) -> np.ndarray:
    """Part (0 .. parts-1) of each weight by largest-spread-first differencing."""
    n = len(weights)
    label = np.zeros(n, dtype=np.int64)
    if n == 0 or parts == 1:
        return label
    # A node is a leaf (one weight) or a merge: parts of the left child in falling order of their sums meet
    # the parts of the right child in rising order. ``order`` sorts the merged sums, falling.
    sums: list = [None] * (2 * n - 1)
    kids: list = [None] * (2 * n - 1)
    heap = []
    for i, w in enumerate(weights):
        sums[i] = np.zeros(parts, dtype=np.int64)
        sums[i][0] = w
        heap.append((-int(w), i))
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        sums[node] = merged[order]
        kids[node] = (a, b, order.astype(np.int32))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[node][0] - sums[node][-1]), node))
    # place[node][p]: final part of the node's p-th part
    place: list = [None] * (2 * n - 1)
    place[2 * n - 2] = np.arange(parts)
    for node in range(2 * n - 2, n - 1, -1):
        a, b, order = kids[node]
        here = np.empty(parts, dtype=np.int64)
        here[order] = place[node]
        place[a], place[b] = here, here[::-1]
        place[node] = None
    for i in range(n):
        label[i] = place[i][0]
    return label


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, h: all that sharding needs of a document, without its text."""
    text = no_text("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"))


def assign_groups(groups: DataFrame, shards: int, block: int = 4096, heavy: int = 1024, change: int = 64) -> DataFrame:
    """(key, weight) -> (key, shard): every item of ``groups`` in the shard that differencing gives it.

    ``key`` is a long that names the item; ``weight`` a long. Levels of bundles are joined back top-down.
    """
    items = groups.select("key", "weight")
    n, total = items.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard"))
    bar = total // heavy
    levels = []
    depth = 0

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        loose = np.zeros(len(pdf), dtype=bool)
        if len(pdf) > 2 * change:
            loose[np.linspace(0, len(pdf) - 1, change).astype(int)] = True
        weight = pdf["weight"].to_numpy()
        bundles = min(int((~loose).sum()), -(-int(weight[~loose].sum()) // max(bar, 1)))
        label = np.empty(len(pdf), dtype=np.int64)
        label[~loose] = difference(weight[~loose], bundles)
        label[loose] = bundles + np.arange(loose.sum())
        # a bundle's name: its block and its number; negative, so that it never meets a group's hash of the same level
        pdf["parent"] = -(pdf["block"].astype("int64") * 2 * block + label + 1)
        return pdf[["key", "parent", "weight"]]

    while n > block:
        blocks = math.ceil(n / block)
        light = items.filter(F.col("weight") <= bar).withColumn("block", F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(blocks)))
        level = stored(light.groupBy("block").applyInPandas(bundle, "key long, parent long, weight long"), f"shard-level{depth}")
        alone = items.filter(F.col("weight") > bar)
        # heavy items keep their key at the next level; light ones are replaced by their bundle
        nxt = (level.groupBy(F.col("parent").alias("key")).agg(F.sum("weight").alias("weight"))
               .withColumn("key", F.xxhash64("key", F.lit(depth + 1))))
        levels.append(level.select("key", F.xxhash64("parent", F.lit(depth + 1)).alias("parent")))
        items = stored(alone.select("key", "weight").unionByName(nxt), f"shard-items{depth}")
        now = items.count()
        depth += 1
        if now >= n:  # all items are at the bar: they are few
            break
        n = now

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pdf["shard"] = difference(pdf["weight"].to_numpy(), shards).astype("int32")
        return pdf[["key", "shard"]]

    done = stored(items.groupBy(F.lit(0).alias("all")).applyInPandas(last, "key long, shard int"), "shard-top")
    # top-down: an item's shard is its bundle's; heavy items met the shard under their own key
    for level in reversed(levels):
        below = level.join(done.withColumnRenamed("key", "parent"), "parent").select("key", "shard")
        done = below.unionByName(done)
    return done


def shard_by_bytes(docs: DataFrame, shards: int = 8, slot_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (see the module text).

    A shard's slots run over hash buckets of at most about ``slot_rows`` rows: a bucket's offset is the count of
    the shard's rows in earlier buckets, so no task sorts a whole shard.
    """
    rows = stored(digest(docs), "shard-digest")
    group = F.xxhash64("h", "crc", "size", F.lit("group"))
    keyed = rows.withColumn("key", group)
    groups = stored(keyed.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "shard-groups")
    # the buckets of one shard's slots
    buckets = max(1, math.ceil(rows.count() / slot_rows))
    placed = stored(keyed.join(assign_groups(groups, shards), "key")
                    .select("doc_id", "size", "crc", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")),
                    "shard-placed")
    by_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "crc", "size")
    return (placed.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
