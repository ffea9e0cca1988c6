"""Filter interaction audit: what each filter removes in every order of five filters, per part of the corpus.

Method. A document's failures are a mask of five bits; all counts follow from the number of documents (and of good and
toxic ones) in the 32 mask cells of each part. A Gray-code walk visits the 32 sets of active filters by toggling one
filter at a time. Each cell keeps a counter of its active failures; when a toggle takes a counter from or to zero, the
cell leaves or joins the running survivors. The survivors of all 32 states are stored, and every step of every order is
the difference of two of them.

Filters. A: under 200 words; B: fewer than half of the words distinct; C: more than 2 capitals A-Z in 100 code points;
D: any of ``#$%&*|``; E: the text of a document with a smaller doc_id, in the whole table.

Scale. One pass over the texts leaves a narrow row per document (mask, SHA-256 of the text), written to the shared
folder. The smallest doc_id of each text is combined map-side, so a large group of copies is reduced before the
shuffle; the first documents are met again by text and doc_id together, so copies are spread over all tasks. Rows
without doc_id skip the joins. Parts are reduced to 32 cells map-side; the walk takes one row per part.

Edge cases. A null text is the empty text, a null source the part ''. A row without doc_id is neither a copy nor
labelled, and makes no other row a copy; rows that repeat a doc_id and its text are all first. Several labels of one
document count as their maximum. An empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_text, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STATES = 1 << len(FILTERS)
#: Limits and characters of the filters.
MIN_WORDS = 200
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))

RESULT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """Bits of A to D for one text; ``bytes.split`` cuts at exactly the white space of the contract."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    # translate deletes at C speed: what is missing afterwards are the characters looked for
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (n < MIN_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * len(text)) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D) and text_hash of every document."""

    def run(batches):
        for batch in batches:
            masks, names = [], []
            for text in batch.column(2):
                text = text.as_py()
                masks.append(failures(text))
                names.append(hashlib.sha256(text.encode()).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(names, pa.binary())],
                                  names=["doc_id", "part", "mask", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       no_text("text").alias("text")).mapInArrow(run, "doc_id long, part string, mask int, text_hash binary")


def cells(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic from stored profiles."""
    named = profiles.filter("doc_id IS NOT NULL")
    first = named.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = (named.join(first, ["text_hash", "doc_id"], "left").join(marks, "doc_id", "left")
            .select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    rows = rows.unionByName(profiles.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every set of active filters: counts and result have the mask, or set, as last axis."""
    bits = np.arange(STATES)
    failing = np.zeros(STATES, np.int64)  # active failures of each mask cell
    running = counts.sum(axis=-1)
    states = np.empty_like(counts)
    states[..., 0] = running
    active = 0
    for i in range(1, STATES):
        f = (i & -i).bit_length() - 1  # the filter that the Gray code toggles
        hit = (bits >> f & 1).astype(bool)
        active ^= 1 << f
        if active >> f & 1:
            running = running - counts[..., hit & (failing == 0)].sum(axis=-1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[..., hit & (failing == 0)].sum(axis=-1)
        states[..., active] = running
    return states


def steps() -> pd.DataFrame:
    """The 600 steps of all orders with the state before and after each."""
    rows = []
    for order in ORDERS:
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << FILTERS.index(f)
            rows.append((order, k + 1, FILTERS.index(f), before, after))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "f", "before", "after"])


def differences(parts: list[str], states: np.ndarray) -> pd.DataFrame:
    """All steps of ``parts``; states is part x (all, good, toxic) x set."""
    table = steps()
    f, before, after = (table[c].to_numpy() for c in ("f", "before", "after"))
    lost = states[:, :, before] - states[:, :, after]
    everyone, alone = states[:, 0, :1], 1 << np.arange(len(FILTERS))
    failing = everyone - states[:, 0, alone]
    unique = states[:, 0, STATES - 1 - alone] - states[:, 0, STATES - 1:]
    shapley = np.zeros_like(failing)
    for i, bit in enumerate(alone):
        for s in range(STATES):
            if not s & bit:
                k = s.bit_count()
                shapley[:, i] += factorial(k) * factorial(len(FILTERS) - 1 - k) * (states[:, 0, s] - states[:, 0, s | bit])
    n = len(parts)
    return pd.DataFrame({
        "part": np.repeat(np.array(parts, dtype=object), len(table)), "filter_order": np.tile(table["filter_order"].to_numpy(), n),
        "step": np.tile(table["step"].to_numpy().astype("int32"), n), "filter": np.tile(np.array(list(FILTERS), dtype=object)[f], n),
        "kept": states[:, 0, after].ravel(), "removed": lost[:, 0].ravel(), "redundant": (failing[:, f] - lost[:, 0]).ravel(),
        "unique_fails": unique[:, f].ravel(), "good_lost": lost[:, 1].ravel(), "toxic_lost": lost[:, 2].ravel(), "shapley": shapley[:, f].ravel()})


def audit(docs: DataFrame, labels: DataFrame, parts_at_once: int = 100) -> DataFrame:
    """One row per part, order and step; see the module."""
    found = cells(stored(profile(docs), "audit-profile"), labels)
    # at most 32 cells a part
    per_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), parts_at_once):
                some = pdf.iloc[lo:lo + parts_at_once]
                counts = np.zeros((len(some), 3, STATES), np.int64)
                for i, row in enumerate(some["cells"]):
                    for c in row:
                        counts[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield differences(some["part"].tolist(), gray_walk(counts))

    return per_part.mapInPandas(run, RESULT)


def oracle_sql() -> str:
    """DuckDB SQL for ``audit`` over ``documents`` and ``labels``: every step counted from the masks."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    orders = "".join(f", f{i}.l AS l{i}, f{i}.b AS b{i}" for i in range(1, 6))[2:]
    tables = ", ".join(f"{letters} f{i}(l, b)" for i in range(1, 6))
    apart = " AND ".join(f"f{i}.b <> f{j}.b" for i in range(1, 6) for j in range(1, i))
    walk = " UNION ALL ".join(f"SELECT l1 || l2 || l3 || l4 || l5 AS filter_order, {k} AS step, l{k} AS filter, b{k} AS bit, "
                              + " + ".join(["0", *[f"b{j}" for j in range(1, k)]]) + " AS before FROM orders" for k in range(1, 6))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(ws) < {MIN_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
        + 4 * CAST(100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * len(text) AS INTEGER)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(w.doc_id > low, false) AS INTEGER) AS mask
      FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
orders AS (SELECT {orders} FROM {tables} WHERE {apart}),
steps AS ({walk}),
x AS (SELECT part, filter_order, step, filter, bit,
        sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept,
        sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS redundant,
        sum(n) FILTER (WHERE mask = bit) AS unique_fails,
        sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS good_lost,
        sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS toxic_lost
      FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM x
"""
