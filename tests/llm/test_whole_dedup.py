"""Line dedup over every character's shingles, the recall of its keys, and the block search of near-dedup over true band keys."""
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearscope.llm import linededup, neardup
from conftest import SF_SMALL
from llm.conftest import ODD


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def every_character(rows):
    """doc_id and text -> text left, by all pairs of lines and all shingles of eight characters."""
    def norm(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(" \t\n\x0b\f\r")).lower()

    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    places = [(d, i, norm(x)) for d in docs for i, x in enumerate((d[1] or "").split("\n")) if norm(x)]
    sets = {n: shingles(n) for _, _, n in places}
    holders = {}
    for n, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(n)
    links = {n: set() for n in sets}
    for a, b in {p for v in holders.values() for p in itertools.combinations(v, 2)}:
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    seen, kept = set(), {d: set() for d in docs}
    for d, i, n in places:
        if n not in seen:
            kept[d].add(i)
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    out = {}
    for d in docs:
        lines = (d[1] or "").split("\n")
        full = {i for i, x in enumerate(lines) if norm(x)}
        out[d] = d[1] if kept[d] == full else "" if not kept[d] else "\n".join(x for i, x in enumerate(lines) if i in kept[d] or i not in full)
    return out


def one_letter_changed():
    line = "payment plans are reviewed every month and the customer is told about each change in time"
    rows = [(0, line)]
    rows += [(i + 1, line[:i] + "#" + line[i + 1:]) for i in range(len(line)) if line[i] != " "]
    # long runs without spaces, with one character put in near the start
    run = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(120))
    code = "".join(f"{i * 7919 % 1296:03x}" for i in range(60))
    return rows + [(500, run), (501, run[:9] + "x" + run[9:]), (502, code), (503, code[:11] + "z" + code[11:])]


@pytest.mark.parametrize("kind", ["edits", "small", "odd"])
def test_lines_equal_every_character(spark, documents, kind):
    df = {"edits": lambda: documents(one_letter_changed()), "small": lambda: spark.read.parquet(f"{SF_SMALL}/documents.parquet"),
          "odd": lambda: documents(ODD, True)}[kind]()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = every_character(rows)
    if kind == "edits":
        assert [d for (d, t), x in want.items() if x] == [0, 500, 502]
    got = [(r.doc_id, r.text) for r in linededup.dedup_documents(df).collect()]
    assert sorted(got, key=str) == sorted(((d, want[(d, t)]) for d, t in rows), key=str)


def test_keys_have_recall_at_the_threshold(documents):
    """Pairs of lines at just 0.8, of every length: at most one in a hundred shares no key."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    rows, names = [], []
    for union in (15, 20, 30, 45, 60, 100, 200):
        for k in range(600):
            line = "".join(rng.choice(letters, union + 7))
            # the shorter one lacks a fifth of the shingles
            rows += [(len(names) * 2, line), (len(names) * 2 + 1, line[:len(line) - union // 5])]
            names.append(union)
    got = {r.doc_id: set(r.bands) - {None} for r in linededup.occurrences(documents(rows)).select("doc_id", "bands").collect()}
    hit = {u: np.mean([bool(got[2 * i] & got[2 * i + 1]) for i, n in enumerate(names) if n == u]) for u in set(names)}
    assert min(hit.values()) >= 0.99, hit


def edited(rng, line, share):
    """The line with about this share of its words replaced."""
    return " ".join("".join(rng.choice(list("abcdefghij"), len(w))) if rng.random() < share else w for w in line.split(" "))


def test_pairs_below_the_threshold_never_become_rows(spark):
    """Lines around a common one, in two buckets: the pairs made hold every pair that reaches 0.8, each once, and few others below 1,500 shingles."""
    rng = np.random.default_rng(5)
    found, below, norms = set(), set(), []
    for words in (4, 14, 80, 400):
        line = " ".join("".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(words))
        norms += [line, *[edited(rng, line, share) for share in (0.01, 0.02, 0.04, 0.06) for _ in range(12)], line + " " + line[:20]]
    norms += ["z" * 300, "z" * 300 + "y", "zz zz zz zz", ""]
    norms = [x for x in dict.fromkeys(norms) if x]
    table = spark.createDataFrame([(i, x, len(shingles(x))) for i, x in enumerate(norms)], "line long, norm string, n int")
    main = 3  # in a component with two more lines
    comp = F.when(F.col("line").isin(3, 4, 5), main).otherwise(F.col("line")).cast("long")
    left = table.select(F.explode(F.array(F.expr("7L"), F.when(F.col("line") % 2 == 0, F.expr("9L")))).alias("key"), "line", comp.alias("comp"),
                        F.lit(main).cast("long").alias("main")).filter("key is not null")
    pairs = [(r.a, r.b) for r in linededup.bucket_pairs(left, table).collect()]
    sets = [shingles(x) for x in norms]
    for a, b in itertools.combinations(range(len(norms)), 2):
        if not {a, b} <= {3, 4, 5}:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                found.add((a, b))
            elif max(len(sets[a]), len(sets[b])) < 1500 and 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])):
                below.add((a, b))
    assert len(pairs) == len(set(pairs)) and found <= set(pairs) and len(found) > 100
    assert len(below & set(pairs)) < len(below) // 10 and len(below) > 500, (len(below & set(pairs)), len(below))


def weighted_sets(n, rng):
    """Sets around a few centres: copies with changes of many sizes, some of them with counts above one."""
    out = []
    for k in range(n):
        base = np.arange(100) + 1000 * (k % 4)
        base[rng.choice(100, rng.integers(0, 25), replace=False)] = 100_000 + rng.integers(0, 10**6, 1)[0] + k * 1000
        keys = np.unique(base).astype(np.uint64) << np.uint64(32)
        out.append(neardup.pack_set(keys, rng.integers(1, 3, len(keys)) if k % 3 else np.ones(len(keys), int)))
    return out


@pytest.mark.parametrize("few,many,task", [(1 << 20, 1 << 20, 1 << 22), (900, 2000, 4000)])
def test_block_links_join_what_all_pairs_join(spark, few, many, task):
    """One mixed bucket, stored under two keys: its forest has the components of all pairs, in every block size."""
    sets = weighted_sets(90, np.random.default_rng(3))
    want = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if neardup.probability_jaccard(*neardup.unpack_set(sets[a]), *neardup.unpack_set(sets[b])) >= 0.8 - 1e-12:
            want = [want[a] if c == want[b] else c for c in want]
    table = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(sets)], "node long, shingles binary")
    members = table.select(F.explode(F.array(F.expr("5L"), F.expr("6L"))).alias("key"), "node", F.col("node").alias("comp"), F.lit(0).cast("long").alias("main"))
    got = list(range(len(sets)))
    rows = neardup.block_links(members, table, 0.8, few, many, task).collect()
    for r in rows:
        assert want[r.a] == want[r.b] and r.j >= 0.8 - 1e-12
        got = [got[r.a] if c == got[r.b] else c for c in got]
    groups = lambda c: sorted(tuple(np.flatnonzero(np.array(c) == x)) for x in set(c))
    assert groups(got) == groups(want) and 4 < len(set(want)) < len(sets) - 20
    if task > 10**6:  # one task: a forest
        assert len(rows) == len(sets) - len(set(want))


def paths(rng):
    """Edges of a path, a hub, a cycle, loops and random graphs, with repeats, in any order."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(450, 560)] + [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    edges += [tuple(int(x) for x in rng.integers(2000, 2300, 2)) for _ in range(170)] + [(-5, 2 ** 40), (2 ** 40, 160), (3, 4), (4, 3)]
    return [edges[i] for i in rng.permutation(len(edges))] + edges[:20]


def smallest(edges):
    """node -> smallest node of its component, for nodes on an edge with two ends."""
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    while True:
        old = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if old == root:
            return root


def test_components_stop_at_stars(spark, monkeypatch):
    """Roots are the smallest nodes, and no round is written once all components are stars."""
    from arrearscope.llm import components as cc

    written = []
    monkeypatch.setattr(cc, "stored", lambda df, purpose, f=cc.stored: written.append(purpose) or f(df, purpose))
    edges = paths(np.random.default_rng(3))
    got = [(r.node, r.root) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted(smallest(edges).items()) and "cc-round" in written
    written.clear()
    star = spark.createDataFrame([(1, i) for i in range(2, 50)] + [(60, 61)], "a long, b long")
    assert cc.components(star).count() == 51 and written == ["cc-edges"]
    assert cc.components(star.limit(0)).count() == 0


def test_later_links_join_components(spark):
    """Links in three parts, one after the other, give the components of all of them."""
    from arrearscope.llm.components import components

    edges = paths(np.random.default_rng(4))
    frame = lambda part: spark.createDataFrame(part, "a long, b long").filter("a <> b")
    roots = components(frame(edges[::3])).withColumnRenamed("node", "line")
    for part in (edges[1::3], edges[2::3], [(7, 7)]):
        roots = linededup.joined(roots, frame(part))
    assert sorted((r.line, r.root) for r in roots.collect()) == sorted(smallest(edges).items())


def test_band_keys_equal_their_definition(spark, documents):
    """Band keys are hashes of the smallest shingle hashes of the 24 equal parts of the hash range, three neighbours to a key; no key is null."""
    rng = np.random.default_rng(11)
    lines = ["".join(rng.choice(list("abcdefgh ijk"), n)).strip() or "x" for n in (1, 9, 12, 30, 46, 47, 52, 56, 57, 60, 90, 400, 5000)] + ["ab" * 300, "z一" * 40 + "".join(map(chr, range(0x4E00, 0x4E40)))]
    df = documents(list(enumerate(lines)))
    got = {r.doc_id: r.bands for r in linededup.occurrences(df).select("doc_id", "bands").collect()}
    h = {r.doc_id: sorted(set(r.h)) for r in df.select("doc_id", linededup.shingle_hashes(linededup.normal_line(F.col("text"))).alias("h")).collect()}
    want = {}
    for d, hashes in h.items():
        few = hashes[:5]
        sets = [few] if len(hashes) < 4 else [list(p) for p in itertools.combinations(few, 2)] if len(hashes) < 50 else []
        if len(hashes) >= 40:
            low = {}
            for x in hashes:
                low.setdefault(((x % 2 ** 64) >> 32) * 24 >> 32, x)
            sets += [s for s in ([low[i] for i in range(3 * b, 3 * b + 3) if i in low] for b in range(8)) if s]
        want[d] = sets
    keys = spark.createDataFrame([(d, i, s) for d, sets in want.items() for i, s in enumerate(sets)], "d long, i int, s array<long>")
    expected = {}
    for r in keys.select("d", "i", F.xxhash64("s").alias("k")).orderBy("d", "i").collect():
        expected.setdefault(r.d, []).append(r.k)
    assert got == expected


def test_bins_are_found_without_a_call_per_hash(documents):
    """Only making the hashes calls a function per shingle; bins are found by their bounds, not by comparing every hash with the one before."""
    plan = linededup.occurrences(documents([(1, "a line")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position(marked" in plan and "filter(h#" not in plan
