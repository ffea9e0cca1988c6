"""Piece codec, license scan, fingerprints, sharding and packing against their libraries or brute force."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex

from arrearscope.llm import fingerprints, licenses, packing, pieces, sharding
from arrearscope.llm.queries import PIECE_MODEL, WORD_TOKENIZER
from conftest import SF_SMALL
from llm.conftest import ODD


def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# op1

def piece_reference(text):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    ids = lib.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("clashes", [False, True])
def test_pieces_equal_library(spark, documents, clashes):
    df = documents(ODD, clashes) if clashes else small(spark)
    want = sorted((d or -1, *piece_reference(t)) for d, t in rows_of(df))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(df, PIECE_MODEL).collect())
    assert got == want


def test_pieces_odd_texts_and_bounded_cache():
    codec = pieces.Codec(PIECE_MODEL, cache=50)
    rng = random.Random(5)
    odd = ["  a  b \n  c ", "▁x ▁", "<s> </s> <unk> <0x41>", ");\r\n});\r", "\n\n", "a" * 3000, "▁", "日本語 テキスト", "� é é"]
    odd += ["".join(rng.choice("ab \n▁é\x00;)\r日") for _ in range(rng.randrange(80))) for _ in range(400)]
    for _ in range(2):
        for i in range(0, len(odd), 40):
            for t, got in zip(odd[i:i + 40], codec.digests(odd[i:i + 40])):
                assert got[:3] == piece_reference(t), repr(t)
    assert len(codec.known) <= 50 + 40 * 80


def test_agenda_raises_on_difference(monkeypatch):
    codec = pieces.Codec(PIECE_MODEL)
    monkeypatch.setattr(codec.merges, "merge", lambda s: [0])
    with pytest.raises(ValueError):
        codec.digests(["hello"])


# op2

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_reference(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("clashes", [False, True])
def test_license_base(spark, documents, clashes):
    df = documents(ODD, True) if clashes else small(spark)
    want = sorted(((d or -1, *base_reference(t)) for d, t in rows_of(df)), key=str)
    rows = licenses.scan_documents(df).collect()
    assert sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_license_fuzzy_equals_whole_text_search():
    """Seeds lose no copy: the same spans as bounded matching over the whole text, on texts with random edits."""
    rng = random.Random(3)
    scanner = licenses.Scanner()
    hits = 0
    for _ in range(250):
        words = ["lorem", "mit", "license", "gnu", "general", "der", "éa"]
        text = " ".join(rng.choice(words) for _ in range(6))
        notice = rng.choice(list(licenses.NOTICES))
        chars = list(notice)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(chars))
            op = rng.randrange(3)
            if op == 0:
                chars[i] = rng.choice("aeé ")
            elif op == 1 and len(chars) > 3:
                del chars[i]
            else:
                chars.insert(i, rng.choice("xé"))
        text = f"{text} {''.join(chars)} {text}"
        got = {(s["label"], s["edits"]) for s in scanner.scan(text.encode())[7]}
        joined = " " + " ".join(WORD.findall(text.translate(LOWER))) + " "
        want = set()
        for label, _, _, _, pattern in scanner.fuzzy:
            best = {}
            for m in pattern.finditer(joined):
                best[m.start()] = (label, sum(m.fuzzy_counts))
            want |= {b[0] for b in best.values()}
        assert {g[0] for g in got} == want, text
        hits += bool(want)
    assert hits > 100


def test_license_clean_text_has_no_labels():
    row = licenses.Scanner().scan("Mit der Zeit lich ense. A licence fee for the general public. Apache helicopters.".encode())
    assert row[4] == row[5] == "" and row[6] == 0


def test_license_scan_of_many_places_is_linear():
    import time
    scanner = licenses.Scanner()
    for text in ("cc by " * 160_000, "é mit  license\n" * 60_000, "Apache Licence " * 20_000):
        t0 = time.process_time()
        got = scanner.scan(text.encode())
        assert time.process_time() - t0 < 20
        assert got[:5] == base_reference(text)
        assert all(a["first_word"] <= a["last_word"] for a in got[7])


# op5

@pytest.mark.parametrize("clashes", [False, True])
def test_fingerprints_equal_brute_force(spark, documents, clashes):
    df = documents([r for r in ODD if r[0] is not None and r[0] != 9] + [(12, "same text here, twice.")], True) if clashes else small(spark)
    texts = sorted(((d, t or "") for d, t in rows_of(df)), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert len(got) == len(texts)

    def digests(t):
        count = defaultdict(int)
        out = set()
        for p in fingerprints.PARAGRAPH.split(t):
            if p:
                count[p] += 1
                out.add((p, count[p]))
        return out

    same = defaultdict(set)
    for i, (d, t) in enumerate(texts):
        n = texts[(i + 1) % len(texts)][1]
        edited = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, value in ((edited, r.near_edited), (n, r.near_next)):
            a, b = digests(t), digests(other)
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        same[t].add(r.fingerprint)
        same[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_sketch_recovers_and_retries():
    a = ["\n".join(f"line {i}" for i in range(300)), "a\nb", ""]
    b = ["\n".join(f"line {i}" for i in range(0, 900, 3)), "b\nc\nc", ""]
    lost, added = fingerprints.differences(fingerprints.Digests(a), fingerprints.Digests(b))
    assert lost.tolist() == [200, 1, 0] and added.tolist() == [200, 2, 0]


def test_fingerprint_lone_document(documents):
    row = fingerprints.fingerprint_documents(documents([(5, "abc def")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in row] == [(5, 7, 1.0)]


# op7

def check_shards(rows, texts, shards=8):
    assert sorted(((r.doc_id or -1, r["size"], r.text_crc32) for r in rows)) == sorted(
        (d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    home = defaultdict(set)
    for r in rows:
        home[(r["size"], r.text_crc32)].add(r.shard)
    assert all(len(v) == 1 for v in home.values())


@pytest.mark.parametrize("clashes", [False, True])
def test_shards(spark, documents, clashes):
    df = documents(ODD, True) if clashes else small(spark)
    rows = sharding.shard_by_bytes(df).collect()
    check_shards(rows, rows_of(df))
    if not clashes:
        load = defaultdict(int)
        for r in rows:
            load[r.shard] += r["size"]
        assert max(load.values()) - min(load.values()) < 0.002 * sum(load.values())


def test_differencing_known_case_and_blocks(spark):
    label = sharding.difference([8, 7, 6, 5, 4], 2)
    sums = sorted(sum(w for w, x in zip([8, 7, 6, 5, 4], label) if x == k) for k in (0, 1))
    assert sums == [14, 16]  # the differencing result of this classic case
    rng = random.Random(1)
    weights = [(i, rng.randrange(1, 1000)) for i in range(3000)] + [(3000, 200_000)]
    groups = spark.createDataFrame(weights, "key long, weight long")
    got = {r.key: r.shard for r in sharding.assign_groups(groups, 8, block=1024, heavy=256, change=16).collect() if 0 <= r.key <= 3000}
    assert len(got) == 3001
    load = [sum(w for k, w in weights if got[k] == s) for s in range(8)]
    assert max(load) - min(load) < 200


# op9

def ids_reference(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_TOKENIZER).encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, texts, limit=2048):
    want = []
    for d, t in texts:
        ids = ids_reference(t)
        for k, i in enumerate(range(0, len(ids), limit)):
            part = ids[i:i + limit]
            want.append((d or -1, k, i, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), sum(r.length for r in rows)


@pytest.mark.parametrize("clashes", [False, True])
def test_packing(spark, documents, clashes):
    df = documents(ODD, True) if clashes else small(spark)
    rows = packing.pack(packing.token_pieces(df, WORD_TOKENIZER, 2048), 2048).collect()
    n, tokens = check_packing(rows, rows_of(df))
    if not clashes:
        assert n <= -(-tokens // 2048) + 2


def test_runs_equal_whole_texts():
    encoder = packing.RunEncoder(WORD_TOKENIZER, cache_runs=20, cache_words=10)
    rng = random.Random(2)
    odd = ["a\x1cb !\x1c! x", " á ́b", "İ Σίσυφος ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "it's 're ' s'll", "　日本 \x85 x", "é" * 50 + "x" * 500, "ﬁ ẞ ﬀ µ ª²½ 'S 'RE"]
    odd += ["".join(rng.choice("aAé'sµ²1!. \n\x1d日ẞ") for _ in range(rng.randrange(60))) for _ in range(300)]
    # whole Latin-1 texts, with every character of it, long words and the special strings' parts
    odd += ["".join(map(chr, range(256))), "A\x85b\xa0C'S' t 'Re", "< |x|> <", "z" * 300 + " É" + "Q" * 100, "don't' 'D 12½x ªºµ"]
    odd += ["".join(rng.choice("aAéÿß'sS²½1!.<|> \n\x85\xa0\x1b\x00tredm") for _ in range(rng.randrange(80))) for _ in range(600)]
    for i in range(0, len(odd), 25):
        for t, raw in zip(odd[i:i + 25], encoder.encode(odd[i:i + 25])):
            assert np.frombuffer(raw, "<u4").tolist() == ids_reference(t)[:-1], repr(t)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(0)
    size = -np.sort(-rng.integers(1, 60, 500)).astype(float)
    demands = np.stack([size, np.ones_like(size), size * size], axis=1)
    capacity = np.array([100.0, 5.0, 4000.0])
    bins, offsets = packing.best_fit(demands, capacity, np.ones(3), rule)
    for b in np.unique(bins):
        assert (demands[bins == b].sum(axis=0) <= capacity).all()
        assert sorted(offsets[bins == b]) == list(np.cumsum(np.r_[0, demands[bins == b][np.argsort(offsets[bins == b]), 0]])[:-1])
    assert bins.max() + 1 >= np.ceil(demands.sum(axis=0) / capacity).max()


@pytest.mark.parametrize("operator", ["pieces", "licenses", "fingerprints", "shards", "packing"])
def test_empty_table(documents, operator):
    empty = documents([])
    run = {"pieces": lambda: pieces.encode_documents(empty, PIECE_MODEL), "licenses": lambda: licenses.scan_documents(empty),
           "fingerprints": lambda: fingerprints.fingerprint_documents(empty), "shards": lambda: sharding.shard_by_bytes(empty),
           "packing": lambda: packing.pack(packing.token_pieces(empty, WORD_TOKENIZER, 2048), 2048)}[operator]
    assert run().count() == 0


def test_vocabulary_files_are_parameters():
    assert PIECE_MODEL == public_tokenizers.path("piece_bpe_32k.model")
