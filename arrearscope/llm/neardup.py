"""MinHash near-duplicates by ProbMinHash over weighted word shingles.

Signature. A text's shingles (five lower-case words; all words of a shorter text) have the weight 1 + ln(count). Every shingle
draws its own Poisson process of arrivals at a rate equal to its weight, seeded by its hash; an arrival names a register
and takes it if it is the earliest there. A shingle stops as soon as its next arrival is later than every register
of its text, so long texts end after a few arrivals per shingle. Two texts agree in a register with probability J_P,
the probability Jaccard similarity of their weighted shingles.

Search. Registers are banded; texts that share a band are candidates. In every bucket each text is first compared with
the bucket's smallest one, which settles the copies; candidates are verified by the exact J_P of their shingle sets,
and a distributed union-find joins the links. In buckets that still hold several components, texts outside the main one are
compared with one of its members, another in each bucket; what is left then is searched whole, in blocks: every text outside
the bucket's main component meets all others, exact bounds on shared mass leave out pairs, the exact J_P decides, and
only links that join components leave a block. No class misses a link between candidates, and copies never form all their pairs.

Equal texts are one node from the start. Classes are the connected components; the class id is the smallest doc_id.

Edge cases. Null is the empty text. Texts without a word share no shingle: they join their equals only. A null doc_id sorts after
all others as a class id. Repeated rows fall into one class; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_record, no_text, one_per_content, stored
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: Registers per band and bands: a pair at 0.8 shares a band with probability 0.9998.
ROWS, BANDS = 6, 28
ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(seed: np.ndarray, k) -> np.ndarray:
    """The k-th 64-bit draw of each seed."""
    with np.errstate(over="ignore"):
        return mixed(seed + np.asarray(k, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Weighted shingles of texts, with a bounded cache of word hashes."""

    def __init__(self, words: int = WORDS, cache: int = 1_000_000):
        import xxhash
        self.words, self.cache, self.h, self.known = words, cache, xxhash.xxh3_64_intdigest, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known, h = self.known, self.h
        new = set(words).difference(known)
        if new:
            if len(known) > self.cache:  # bounded: start again
                known.clear()
                new = set(words)
            for w in new:
                known[w] = h(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, count), sorted by text and shingle."""
        split = [t.lower().split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = self.hashes([w for words in split for w in words])
        k = self.words
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        start = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(texts)), count)
        first = np.repeat(start, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        width = np.minimum(np.repeat(n, count), k)
        s = width.astype(np.uint64)
        for j in range(k):
            inside = j < width
            at = np.where(inside, first + j, 0)
            word = flat[at] if len(flat) else np.zeros(len(doc), np.uint64)
            s = np.where(inside, draw(s ^ word, j + 1), s)
        order = np.lexsort((s, doc))
        doc, s = doc[order], s[order]
        if not len(s):
            return doc, s, np.zeros(0, np.int64)
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
        return doc[head], s[head], np.diff(np.r_[head, len(s)])


def weight_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def signatures(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle (mixed) that took each register; 0 for texts without shingles."""
    time = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    t = np.zeros(len(s))
    alive = np.arange(len(s))
    k = 0
    while len(alive):
        step = 1 if k < 3 else 4  # few shingles are left after some arrivals: take several at once
        at, key = doc[alive], s[alive]
        num = np.arange(k, k + step)
        u = draw(key[:, None], 2 * num + 1)
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / weight[alive][:, None]
        when = t[alive][:, None] + np.cumsum(gap, axis=1)
        where = at[:, None] * registers + ((draw(key[:, None], 2 * num + 2) >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        early = when < latest[at][:, None]
        w, place = when[early], where[early]
        who = np.broadcast_to(key[:, None], when.shape)[early]
        np.minimum.at(time, place, w)
        won = time[place] == w
        owner[place[won]] = who[won]
        t[alive] = when[:, -1]
        docs = np.unique(at)
        latest[docs] = time.reshape(texts, registers)[docs].max(axis=1)
        alive = alive[t[alive] < latest[doc[alive]]]
        k += step
    return mixed(owner).reshape(texts, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets, given as sorted distinct keys and weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ra, rb = wa[i], wb[j]
    only_a, only_b = wa.sum() - ra.sum(), wb.sum() - rb.sum()
    # for a shared key with ratio r = its weight in b / in a: sum over keys of max(a / a_key, b / b_key)
    r = rb / ra
    total = 0.0
    for ratio in np.unique(r):
        here = r == ratio
        rest = only_a + only_b / ratio + np.maximum(ra, rb / ratio).sum()
        total += (ra[here] / rest).sum()
    return float(total)


def pack_set(s: np.ndarray, count: np.ndarray) -> bytes:
    """Distinct 32-bit shingles with their counts, sorted."""
    key = (s >> np.uint64(32)).astype(np.uint32)
    uniq, inv = np.unique(key, return_inverse=True)
    total = np.bincount(inv, weights=count, minlength=len(uniq)).astype(np.uint32) if len(uniq) else np.zeros(0, np.uint32)
    if (total == 1).all():
        return uniq.astype("<u4").tobytes()
    # a leading byte, and the counts after the keys
    return b"\0" + uniq.astype("<u4").tobytes() + total.astype("<u4").tobytes()


def unpack_set(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) % 4:
        both = np.frombuffer(raw, "<u4", offset=1)
        half = len(both) // 2
        return both[:half], weight_of(both[half:].astype(float))
    keys = np.frombuffer(raw, "<u4")
    return keys, np.ones(len(keys))


NODES = "doc_id long, h long, g long, chars int, bands array<long>, shingles binary"


def signed_documents(docs: DataFrame, chars: int = 3_000_000, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Band keys of the signature and packed shingles of every document, with its text's identity."""
    registers = rows * bands

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < chars):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                n = len(part)
                doc, s, count = shingler.shingles(part)
                sig = signatures(doc, s, weight_of(count), n, registers)
                keys = draw(np.arange(bands, dtype=np.uint64), 1)[None, :].repeat(n, 0)
                for r in range(rows):
                    keys = draw(keys ^ sig[:, r::rows], r + 2)
                keys = keys.view(np.int64)
                cut = np.searchsorted(doc, np.arange(n + 1))
                some = np.diff(cut) > 0
                sets = [pack_set(s[i:j], count[i:j]) for i, j in zip(cut, cut[1:])]
                yield pa.record_batch([
                    ids.slice(at, n), batch.column(2).slice(at, n), batch.column(3).slice(at, n), batch.column(4).slice(at, n),
                    pa.array([k.tolist() if ok else [] for k, ok in zip(keys, some)], pa.list_(pa.int64())),
                    pa.array(sets, pa.binary())], names=[c.split(" ")[0] for c in NODES.split(", ")])
                at += n

    text = no_text("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.crc32(text).alias("g"), F.length(text).alias("chars")).mapInArrow(run, NODES)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact J_P reaches the threshold, with it."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            j = np.fromiter((probability_jaccard(*unpack_set(x.as_py()), *unpack_set(y.as_py())) for x, y in zip(a, b)), float, batch.num_rows)
            keep = pa.array(j >= threshold - 1e-12)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(j)], names=["a", "b", "j"]).filter(keep)

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, j double")


class Forest:
    """Union-find over the components that one task meets."""

    def __init__(self):
        self.up = {}

    def top(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def cell_links(comp, left, sets, threshold: float, forest: Forest):
    """(i, j, J_P) of texts in one cell that join two components, as exact J_P finds them.

    A text outside the main component meets all others at once, by a table of shingle numbers. In J_P's term of a shared key i,
    the sum over j of max(x_j / x_i, y_j / y_i) is at least the sum of max(x_j, y_j), divided by max(x_i, y_i); so J_P is at most
    the sum of max(x, y) over the shared keys, divided by that over all keys (equal to it where all counts are 1). Only pairs
    whose bound reaches the threshold go on to the exact J_P.
    """
    right = np.flatnonzero(~left)
    some = right[[len(sets[j][0]) > 0 for j in right]]
    if not len(some):
        return
    size = np.fromiter((len(sets[j][0]) for j in some), np.int64, len(some))
    keys, number = np.unique(np.concatenate([sets[j][0] for j in some]), return_inverse=True)
    number = number.astype(np.int32)
    weight = np.concatenate([sets[j][1] for j in some]).astype(np.float32)
    least = threshold - 1e-4  # well above the rounding of the sums
    start = np.cumsum(size) - size
    mass = np.zeros(len(keys), np.float32)
    for i in np.flatnonzero(left):
        a, wa = sets[i]
        at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
        here = keys[at] == a
        if wa[here].sum() < least * wa.sum():
            continue
        mass[at[here]] = wa[here]
        held = mass[number]
        mass[at[here]] = 0
        total, shared = np.maximum(held, weight), held > 0
        most = np.add.reduceat(total * shared, start) / (np.add.reduceat(total - held, start) + wa.sum())
        near = np.flatnonzero((most >= least) & (comp[some] != comp[i]))
        # the likeliest first: later pairs of components that are joined by then need no test
        for j in some[near[np.argsort(-most[near], kind="stable")]]:
            if forest.top(comp[i]) != forest.top(comp[j]):
                value = probability_jaccard(a, wa, *sets[j])
                if value >= threshold - 1e-12:
                    forest.join(comp[i], comp[j])
                    yield i, j, value


def block_links(mixed_members: DataFrame, sets: DataFrame, threshold: float, few: int = 1 << 20, many: int = 1 << 20, task: int = 1 << 22) -> DataFrame:
    """Links (a, b, j) that join the components left in one bucket; every pair of different components is looked at.

    ``mixed_members``: (key, node, comp, main) with main the bucket's main component. Texts outside it, in blocks of about
    ``few`` bytes of shingles, meet all texts of the bucket, in blocks of about ``many``; cells of about ``task`` bytes share
    a task. Pairs are verified in their cell, and of its links a task lets out a spanning forest of the components it
    has met: at most one row for every component, however many pairs there are.
    """
    chosen = one_per_content(mixed_members, "node")
    m = mixed_members.join(chosen, "key").join(sets.select("node", "shingles"), "node")
    m = stored(m.withColumn("bytes", F.length("shingles") + 64), "near-cells")
    blocks = lambda total, each: F.ceil(F.coalesce(total, F.lit(0)) / each).cast("int")
    sizes = stored(m.groupBy("key").agg(blocks(F.sum(F.when(F.col("comp") != F.col("main"), F.col("bytes"))), few).alias("ni"),
                                        blocks(F.sum("bytes"), many).alias("nj"), F.sum("bytes").alias("all")), "near-sizes")
    total = sizes.agg(F.sum(F.col("all") * (F.col("ni") + F.col("nj")))).first()[0] or 0
    groups = max(1, math.ceil(total / task))
    m = m.join(sizes.drop("all"), "key")
    side = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    left = m.filter("comp <> main").withColumn("i", side("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("left", F.lit(True))
    right = m.withColumn("j", side("nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("left", F.lit(False))
    cells = left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("cell"), "node", "comp", "shingles", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", kind="stable")
        cell, node, comp, left = (pdf[c].to_numpy() for c in ("cell", "node", "comp", "left"))
        head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        forest, out = Forest(), []
        for lo, hi in zip(head, np.r_[head[1:], len(cell)]):
            sets = [unpack_set(x) for x in pdf["shingles"].iloc[lo:hi]]
            for i, j, value in cell_links(comp[lo:hi], left[lo:hi], sets, threshold, forest):
                out.append((min(node[lo + i], node[lo + j]), max(node[lo + i], node[lo + j]), value))
        return pd.DataFrame(out, columns=["a", "b", "j"]).astype({"a": "int64", "b": "int64", "j": "float64"})

    return cells.groupBy(F.pmod("cell", F.lit(groups)).alias("task")).applyInPandas(run, "a long, b long, j double").dropDuplicates(["a", "b"])


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, n_links, keep of every document (n_links: links of its text among those that join its class)."""
    return _classes(docs, threshold).drop("h")


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of every class, in the table's own columns: the one with the smallest doc_id."""
    name = lambda h: F.xxhash64(F.col("doc_id").cast("long"), h)
    keepers = _classes(docs, threshold).filter("keep").select(name(F.col("h")).alias("name"))
    rows = docs.select(as_record(docs).alias("record"), name(F.xxhash64(no_text("text"))).alias("name")).join(keepers, "name", "left_semi")
    # rows equal in doc_id and text have one name; one of them stays
    first = Window.partitionBy("name").orderBy("name")
    return rows.withColumn("copy", F.row_number().over(first)).filter("copy = 1").select("record.*")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    signed = stored(signed_documents(docs).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    same = ["h", "g", "chars"]
    exact = stored(signed.groupBy(*same).agg(F.min("row").alias("node")), "near-exact")
    signed_nodes = signed.withColumnRenamed("row", "node")
    held = stored(signed_nodes.select("node", "bands").join(exact.select("node"), "node", "left_semi")
                  .select("node", F.explode("bands").alias("key")), "near-bands")
    shared = held.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("top")).filter("rep <> top").select("key", "rep")
    members = stored(held.join(shared, "key"), "near-members")
    sets = stored(signed_nodes.select("node", "shingles").join(members.select("node").distinct(), "node", "left_semi"), "near-sets")

    # every text against its buckets' smallest ones
    stars = stored(members.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")
    links = stored(verified(stars, sets, threshold), "near-links")
    roots = components(links)

    # what is left in buckets of several components: texts outside the main one against one of its members per bucket,
    # a different one in each, then against the whole bucket
    for last in (False, True):
        where = members.select("key", "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        several = where.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        left = stored(where.join(several, "key"), "near-mixed")
        sizes = left.groupBy("key", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
        left = left.join(main, "key")
        if last:
            more = block_links(left, sets, threshold)
        else:
            one = left.filter("comp = main").groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("one"))
            pairs = (left.filter("comp <> main").join(one, "key")
                     .select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct())
            more = verified(stored(pairs.join(stars, ["a", "b"], "left_anti"), "near-more"), sets, threshold)
        links = links.unionByName(stored(more, "near-links"))
        roots = components(links)

    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count("*").alias("n_links")))
    texts = (exact.join(roots, "node", "left").join(degree, "node", "left")
             .select(*same, F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    rows = stored(signed.select("doc_id", "row", *same).join(texts, same).select("doc_id", "row", "root", "n_links", "h"), "near-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("class_size"))
    return (rows.join(first, "root")
            .select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("keep"), "h"))
