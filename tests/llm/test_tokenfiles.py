"""Token-id files: exact round trips of the coder, the library's ids, order and positions, damage."""
import struct
import zlib

import numpy as np
import pytest

from arrearscope.llm import mixcoder, tokenfiles
from arrearscope.llm.queries import QUERIES, WORD_TOKENIZER
from arrearscope.session import shared_dir
from conftest import SF_SMALL
from llm.conftest import ODD


def streams(vocabulary):
    rng = np.random.default_rng(6)
    top = vocabulary - 1
    phrase = rng.integers(0, vocabulary, 40)
    yield [np.zeros(0, np.int64), np.zeros(1, np.int64), np.full(2200, top), np.zeros(2200, np.int64)]
    yield [rng.integers(0, vocabulary, n) for n in (1, 31, 32, 33, 64, 65, 2047, 2049, 2500)]
    yield [np.tile(phrase, 50), np.minimum(rng.zipf(1.3, 2200) - 1, top), np.arange(2200) % vocabulary, np.arange(2200, 0, -1) % vocabulary]
    yield [np.where(rng.random(2200) < 0.9, np.arange(2200) % 7 % vocabulary, rng.integers(0, vocabulary, 2200)) for _ in range(20)]


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 256, 49_408, 1 << 22])
def test_round_trip(vocabulary):
    for blocks in streams(vocabulary):
        coded = mixcoder.encode(blocks, vocabulary)
        back = mixcoder.decode(coded, [len(b) for b in blocks], vocabulary)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
        # blocks don't depend on their neighbours
        for b, c in list(zip(blocks, coded))[-2:]:
            assert mixcoder.encode([b], vocabulary) == [c]


def test_coder_learns():
    rng = np.random.default_rng(8)
    uniform = [rng.integers(0, 49_408, 8192)]
    repeats = [np.tile(rng.integers(0, 49_408, 64), 128)]
    skewed = [np.minimum(rng.zipf(1.5, 8192) - 1, 49_407)]
    bits = [8 * len(mixcoder.encode(b, 49_408)[0]) / 8192 for b in (uniform, repeats, skewed)]
    assert bits[0] < 17.2 and bits[1] < 1 and bits[2] < 8, bits


def test_ids_outside_the_vocabulary():
    with pytest.raises(ValueError):
        mixcoder.encode([np.array([5])], 5)
    with pytest.raises(ValueError):
        mixcoder.encode([np.array([5])], mixcoder.LIMIT)
    assert mixcoder.encode([], 5) == [] and mixcoder.decode([], [], 5) == []


def reference(rows):
    """Sorted by doc_id: doc_id, start, ids, CRC-32. Rows of equal doc_ids may stand in any order."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(WORD_TOKENIZER)
    return [(d, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


@pytest.mark.parametrize("kind", ["odd", "small"])
def test_files_hold_the_librarys_ids(spark, documents, kind):
    df = documents(ODD, clashes=True) if kind == "odd" else spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = reference(rows)
    folder = shared_dir(spark, "token-files-test")
    # many parts, segments and blocks
    tokenfiles.write_tokens(df, WORD_TOKENIZER, folder, block=100, segment=1000, lanes=7, part_chars=20_000)
    ids = {}
    for r in tokenfiles.read_ids(spark, folder).collect():
        ids.setdefault(r.doc_id, []).append(list(r.ids))
    assert {d: sorted(x) for d, x in ids.items()} == {d: sorted(i for e, i in want if e == d) for d, _ in want}
    got = sorted((tuple(r) for r in tokenfiles.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in want]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    crc = lambda i: zlib.crc32(np.asarray(i, "<u4").tobytes())
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((d, len(i), crc(i)) for d, i in want), key=str)
    if kind == "small":
        whole = sorted((tuple(r) for r in QUERIES["op11_tokenfiles"][0](spark, SF_SMALL).collect()))
        assert whole == sorted(got)


def test_files_of_an_empty_table(spark, documents):
    folder = shared_dir(spark, "token-files-test")
    tokenfiles.write_tokens(documents([]), WORD_TOKENIZER, folder)
    assert tokenfiles.read_ids(spark, folder).count() == 0 and tokenfiles.read_digests(spark, folder).count() == 0


def test_damage_is_found():
    ids = np.arange(3000) % 50
    body, = tokenfiles.payloads([ids], 100, 1000, 8)
    assert np.array_equal(tokenfiles.ids_of([body], 2)[0], ids)
    for at in (0, 4, 6, 15, 40, len(body) - 9):
        bad = bytearray(body)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            tokenfiles.ids_of([bytes(bad)], 2)
    for short in (b"", body[:-4], body[:20]):
        with pytest.raises(ValueError):
            tokenfiles.ids_of([short], 2)
    # another block is still readable alone
    _, blocks = tokenfiles.blocks_of(body)
    n, crc, words = blocks[1]
    assert np.array_equal(mixcoder.decode([words], [n], 100)[0], ids[1000:2000]) and struct.calcsize("<I") == 4
