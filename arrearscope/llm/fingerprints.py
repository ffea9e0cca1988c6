"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

Method. A text's paragraphs (lines, cut further after sentence and clause marks) are hashed to 64-bit digests; the n-th repeat of a
digest gets a digest of its own, so the digests are a set. The sketch has three rows of cells; a digest falls into one
cell of each row and adds 1 to its count, the digest to its key sum and a check hash to its check sum. Sketches
subtract cell by cell; what two texts share vanishes, and peeling recovers the rest: a cell with count 1 or -1 whose
check fits holds one digest, which is then taken out of its other cells. If cells remain, both texts are sketched
again with four times the cells, until peeling ends. A sketch larger than ``WIDEST`` times the digests that still
fails (two digests in the same three cells) is settled by the digest sets themselves.

Likeness = shared / all digests of both texts, from the counts and the recovered differences.

Scale. "The next document" needs only neighbours in doc_id order: rows are cut into ranges of doc_id (quantiles; as
many as four per shuffle partition), and each range's largest document is also sent to the range above, and to the
lowest one for the wrap. The texts are shuffled once. Sketches are built for many documents at a time in numpy.

Edge cases. Null is the empty text, which has no digests; two texts without digests are alike (1.0). Equal doc_ids
are ordered by text hash; a null doc_id is the smallest; a lone document is its own next; an empty table gives an
empty result; further columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import no_text

PARAGRAPH = re.compile(r"\n+|(?<=[.!?,;:|]) +")
#: Cells of a fingerprint (three rows of them together), how much wider a retry is, and where the sets decide.
CELLS, WIDER, WIDEST = 24, 4, 16
CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")])

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_paragraphs long, edited_lost long, edited_added long")


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests:
    """Paragraph digests of several texts: ``doc`` (0 .. n-1) and ``key``, distinct within a text."""

    def __init__(self, texts: list[str]):
        import xxhash
        h = xxhash.xxh3_64_intdigest
        per = [[h(p) for p in PARAGRAPH.split(t) if p] for t in texts]
        n = np.fromiter(map(len, per), np.int64, len(per))
        doc = np.repeat(np.arange(len(per)), n)
        key = np.fromiter((k for p in per for k in p), np.uint64, int(n.sum()))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        if len(key):
            same = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]
            at = np.arange(len(key))
            repeat = at - np.maximum.accumulate(np.where(same, 0, at))
            again = repeat > 0
            key[again] = mixed(key[again] + repeat[again].astype(np.uint64), 7)
        self.n, self.doc, self.key = n, doc, key

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``docs``, key) of the digests of some texts."""
        where = np.full(len(self.n), -1)
        where[docs] = np.arange(len(docs))
        at = where[self.doc]
        keep = at >= 0
        return at[keep], self.key[keep]


def cells_of(key: np.ndarray, cells: int) -> np.ndarray:
    """3 x len(key): the cell of each row."""
    row = cells // 3
    return np.stack([(mixed(key, 11 + r) % np.uint64(row)).astype(np.int64) + r * row for r in range(3)])


class Sketches:
    """``texts`` sketches of ``cells`` cells each, kept flat."""

    def __init__(self, texts: int, cells: int):
        self.cells = cells
        self.count = np.zeros(texts * cells, np.int64)
        self.key = np.zeros(texts * cells, np.uint64)
        self.check = np.zeros(texts * cells, np.uint64)

    def add(self, at: np.ndarray, key: np.ndarray, sign) -> None:
        """Add (sign 1) or subtract (-1) digests; sums wrap."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        signed = np.where(sign > 0, key, -key)
        check = mixed(key, 3)
        check = np.where(sign > 0, check, -check)
        for c in cells_of(key, self.cells):
            place = at * self.cells + c
            np.add.at(self.count, place, sign)
            np.add.at(self.key, place, signed)
            np.add.at(self.check, place, check)

    def strings(self) -> list[str]:
        out = np.empty(len(self.count), CELL)
        out["count"], out["key"], out["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        raw, size = out.tobytes(), self.cells * CELL.itemsize
        return [base64.b64encode(raw[i:i + size]).decode() for i in range(0, len(raw), size)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out all it can. (differences found per text with sign 1, with -1, and whether nothing is left)."""
        texts = len(self.count) // self.cells
        plus, minus = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        near = np.flatnonzero(np.abs(self.count) == 1)
        while len(near):
            sign = self.count[near]
            key = np.where(sign > 0, self.key[near], -self.key[near])
            check = np.where(sign > 0, self.check[near], -self.check[near])
            pure = mixed(key, 3) == check
            at, key, sign = near[pure] // self.cells, key[pure], sign[pure]
            if not len(at):
                break
            order = np.lexsort((key, at))
            at, key, sign = at[order], key[order], sign[order]
            first = np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])]
            at, key, sign = at[first], key[first], sign[first]
            np.add.at(plus, at[sign > 0], 1)
            np.add.at(minus, at[sign < 0], 1)
            self.add(at, key, -sign)
            touched = np.unique((at * self.cells + cells_of(key, self.cells)).ravel())
            near = touched[np.abs(self.count[touched]) == 1]
        full = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(texts, self.cells).any(axis=1)
        return plus, minus, ~full


def differences(a: Digests, b: Digests) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a's and only in b's i-th text, recovered from subtracted sketches."""
    texts = len(a.n)
    only_a, only_b = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    todo, cells = np.arange(texts), CELLS
    while len(todo):
        # fewer cells than the counts differ by can't be enough: those wait for a wider sketch
        gap = np.abs(a.n[todo] - b.n[todo])
        now, later = todo[gap < cells], todo[gap >= cells]
        wide = cells > WIDEST * (a.n[now] + b.n[now] + 8)
        settled, now = now[wide], now[~wide]
        failed = now
        if len(now):
            s = Sketches(len(now), cells)
            s.add(*a.of(now), 1)
            s.add(*b.of(now), -1)
            plus, minus, done = s.peel()
            only_a[now[done]], only_b[now[done]] = plus[done], minus[done]
            failed = now[~done]
        for i in settled:
            x, y = a.key[a.doc == i], b.key[b.doc == i]
            only_a[i], only_b[i] = len(np.setdiff1d(x, y)), len(np.setdiff1d(y, x))
        todo, cells = np.sort(np.concatenate([failed, later])), cells * WIDER
    return only_a, only_b


def likeness(a: Digests, b: Digests, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    n, d = a.n + b.n, only_a + only_b
    return np.where(n + d > 0, (n - d) / np.maximum(n + d, 1), 1.0)


def fingerprints(texts: list[str]) -> list[str]:
    d = Digests(texts)
    s = Sketches(len(texts), CELLS)
    s.add(d.doc, d.key, 1)
    return s.strings()


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text and the text of the next document in falling doc_id order (after the last: the first)."""
    from pyspark.ml.feature import Bucketizer
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").alias("text"))
    rows = rows.withColumn("rank", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cuts = rows.filter("doc_id is not null").approxQuantile("rank", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = (Bucketizer(splits=splits, inputCol="rank", outputCol="bucket").transform(rows) if len(splits) > 2
            else rows.withColumn("bucket", F.lit(0.0))).withColumn("bucket", F.col("bucket").cast("int")).withColumn("h", F.xxhash64("text"))
    # one row per range, at most len(splits) of them
    top = sorted(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect(), key=lambda r: r["bucket"])
    if not top:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    to = [(r["bucket"], r["top"]["doc_id"], r["top"]["h"], top[(i + 1) % len(top)]["bucket"]) for i, r in enumerate(top)]
    spark = docs.sparkSession
    halo = spark.createDataFrame(to, "b int, d long, g long, also int")
    both = (rows.join(F.broadcast(halo), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
            .withColumn("copy", F.explode(F.when(F.col("also").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
            .select("doc_id", "text", "h", "copy", F.when(F.col("copy") == 1, F.col("also")).otherwise(F.col("bucket")).alias("bucket")))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return both.withColumn("next", F.lead("text").over(order)).filter("copy = 0").select("doc_id", "text", "next")


def fingerprint_documents(docs: DataFrame, chars: int = 2_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (see RESULT)."""
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.strip().split(" ")[0] for c in RESULT.split(",")]

    def run(batches):
        for batch in batches:
            ids, texts, nexts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            at = 0
            while at < len(ids):
                text, after, size = [], [], 0
                while at + len(text) < len(ids) and (not text or size < chars):
                    i = at + len(text)
                    text.append(texts[i].as_py())
                    after.append(nexts[i].as_py())
                    size += len(text[-1]) + len(after[-1])
                edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(text, after)]
                a, b, c = Digests(text), Digests(edited), Digests(after)
                prints = []
                for d in (a, b):
                    s = Sketches(len(text), CELLS)
                    s.add(d.doc, d.key, 1)
                    prints.append(s.strings())
                lost, added = differences(a, b)
                yield pa.record_batch([
                    pa.array(ids[at:at + len(text)], pa.int64()), pa.array([len(t) for t in text], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(prints[0]), pa.array(prints[1]),
                    pa.array(likeness(a, b, lost, added)), pa.array(likeness(a, c, *differences(a, c))),
                    pa.array(a.n), pa.array(lost), pa.array(added)], names=names)
                at += len(text)

    return with_next(docs, ranges).mapInArrow(run, RESULT)
