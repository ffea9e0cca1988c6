"""Fill-in-middle and filter interaction audit against plain per-text and per-order versions."""
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arrearscope.llm import fim, interaction
from conftest import SF_SMALL
from llm.conftest import ODD

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim_reference(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(3)
    rows = list(ODD) + [(i, "a <P> b") for i in range(100, 106)] + [(i, "x<S>") for i in range(110, 116)]
    # pieces of tags at every cut, blanks at both ends, many code points
    rows += [(i, "".join(rng.choice(["<", "P>", "<P", ">", "M", " ", "\n", "é", "日", "\U0001F600", "\x85", " ", "word "]) for _ in range(rng.randrange(60)))) for i in range(200, 600)]
    return rows


@pytest.mark.parametrize("kind", ["odd", "small"])
def test_fim_equals_plain_version(spark, documents, kind):
    df = documents(odd_texts(), clashes=True) if kind == "odd" else spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted(((d, *fim_reference(d, t), t or "") for d, t in rows), key=str)
    out = fim.restore(fim.transform(df, group_bytes=5_000))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in fim.digests(df).collect()), key=str)
    assert digests == sorted(((d, n, f, p, m, sha(o), sha(t)) for d, n, f, p, m, o, t in want), key=str)


def test_fim_empty_table(documents):
    assert fim.digests(documents([])).count() == 0


def test_displacements_over_many_slices(monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 7)
    texts = ["", "one two  three four", " a", "", "é日 x\n", "b"]
    column = pa.array(texts)
    (_, _, data, offsets), = fim.groups_of(column, 1 << 20)
    ends = fim.unit_ends(data, offsets)
    assert len(ends) == sum(len(UNIT.findall(t)) for t in texts)
    start, stop = offsets[:-1], offsets[1:]
    for first, second in ((start, stop), (start, start), (stop, stop), (np.minimum(start + 3, stop), stop)):
        for form in itertools.product((1, 2), repeat=3):
            forms = np.array([0, form[0], form[1], 0, form[2], 1])
            made, out = fim.scatter(data, offsets, first, second, forms)
            for i, t in enumerate(texts):
                raw = t.encode()
                p, m, s = raw[:first[i] - start[i]], raw[first[i] - start[i]:second[i] - start[i]], raw[second[i] - start[i]:]
                want = [raw, b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][forms[i]]
                assert made[out[i]:out[i + 1]].tobytes() == want
            back, again = fim.gather(made, out, forms)
            assert back.tobytes() == data.tobytes() and (again == offsets).all()


def test_restore_reads_the_tags(documents):
    made = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError):
        fim.gather(made, np.array([0, 8]), np.array([1]))
    made = np.frombuffer(b"<P>a<S>b<M>c", np.uint8)
    assert fim.gather(made, np.array([0, 12]), np.array([1]))[0].tobytes() == b"acb"
    with pytest.raises(ValueError):
        fim.gather(made, np.array([0, 12]), np.array([2]))


# audit

def audit_reference(rows, labels):
    """rows: (doc_id, text, source); every order filtered document by document."""
    texts = {}
    for d, t, _ in rows:
        if d is not None:
            texts.setdefault(t or "", []).append(d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}

    def fails(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                            bool(re.search(r"[#$%&*|]", t)), d is not None and any(o < d for o in texts[t]))) if x}

    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(d, fails(d, t or "")) for d, t, s in rows if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, order, k + 1] = [f, len(left), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == {f} for _, x in docs),
                                           sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    for part in {k[0] for k in out}:
        for f in "ABCDE":
            total = sum(v[2] for k, v in out.items() if k[0] == part and v[0] == f)
            for k, v in out.items():
                if k[0] == part and v[0] == f:
                    v.append(total)
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_equals_plain_version(spark, documents):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [long, long + " $", long + " ABCDEFGHIJ" * 9, "x " * 300, "x # " * 300, "short", "SHORT", "", None, " \t\x0b", "a\x1cb \x85" * 250, long.upper() + " |"]
    rows = [(rng.choice([i, i, i, i - 1]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in range(300)]
    rows += [(None, "short", "a"), (None, long, None), (7, long, "z"), (7, long, "z")]
    rows += [(d, t, "odd") for d, t in ODD if d != 9] + [(1000, "twice", "one"), (999, "twice", "two")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = documents(rows, clashes=True).withColumns({c: F.lit("x") for c in ("mask", "part", "good", "first")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(interaction.audit(df, marks, parts_at_once=2)) == audit_reference(rows, labels)


def test_audit_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(documents([]), none).count() == 0
    got = audited(interaction.audit(documents([(1, None, None)]), none))
    assert len(got) == 600 and got["", "ABCDE", 1] == ["A", 0, 1, 0, 1, 0, 0, 120]


def test_walk_equals_counting():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (3, 2, 32))
    states = interaction.gray_walk(counts)
    for s in range(32):
        assert (states[..., s] == counts[..., [m for m in range(32) if not m & s]].sum(axis=-1)).all()
