"""Best-fit packing of token pieces into sequences under several capacities at once (vector best-fit).

Method. Each sequence (bin) has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces come in falling order of their weighted size; a piece goes into the open bin
that can take it in every dimension and scores best, by one of two rules: ``dot`` (smallest weighted dot
product of demand and residual, both relative to capacity: the fullest bin in what the piece needs) or
``norm`` (smallest weighted norm of what would remain). With no feasible bin a new one opens. Bins that no
piece left in the block could enter are closed.

Scale. Pieces are dealt at random into blocks of bounded size and each block is packed in one task, so the
loss against one global packing is at most a part-filled bin or two per block. Full-length pieces need no
search: each is a sequence of its own.

Tokens. ``token_pieces`` tokenises whole texts in Arrow batches. The vocabulary's pre-tokeniser never joins
characters across white space, so a text is encoded run by run; a bounded cache keeps the runs' ids for all tasks of a
Python worker.

Edge cases. Null text is the empty text: one piece holding only the end id. Ties go to the lowest bin; repeated
rows are pieces of their own; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_text, per_worker, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Separators that ``str.split`` takes for white space and the tokenizer does not.
INFO_SEPARATORS = "\x1c\x1d\x1e\x1f"
RUNS = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class RunEncoder:
    """Ids (little-endian unsigned 32-bit) of texts by a ``tokenizers`` file, run of non-white-space by run.

    The vocabulary drops white space, lower-cases letter by letter and never merges across runs. A Latin-1 text is cut into
    words by the vocabulary's own pattern, and words are looked up in a bounded cache, so the library only sees each new
    word once. Other texts are cut into runs with a cache of their own; a new Latin-1 run is cut into words, any other new
    run goes to the library whole.
    """

    #: The pre-tokeniser's pattern for lower-case Latin-1 runs (fixed values: its classes and contractions).
    WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    LETTERS = re.compile(r"[a-zªºß-öø-ÿ]+")
    LATIN = re.compile(r"[\x00-\xb4\xb6-\xff]+")
    #: The same over a whole text: white space belongs to no word, so words never cross runs.
    TEXT_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾ \t\n\r\x0b\x0c\x85\xa0]+")

    def __init__(self, path: str, cache_runs: int = 500_000, cache_words: int = 500_000, longest: int = 40):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        # for words that are lower-case and composed already: the same merges without the normaliser
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for piece, i in self.whole.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.cache_runs, self.cache_words, self.longest = cache_runs, cache_words, longest
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        letters = [w for w in words if self.LETTERS.fullmatch(w)]
        other = [w for w in words if not self.LETTERS.fullmatch(w)]
        out = dict(zip(other, self._library(other)))
        for i in range(0, len(letters), 10_000):
            part = letters[i:i + 10_000]
            joined = [" ".join(part[k:k + 100]) for k in range(0, len(part), 100)]
            ids = np.concatenate([np.asarray(e.ids, dtype="<u4")
                                  for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, cuts.tolist(), strict=True):
                out[w] = raw[start:stop]
                start = stop
        return out

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        cut, strange = {}, []
        for r in runs:
            if self.LATIN.fullmatch(r) and "<|" not in r:
                cut[r] = self.WORDS.findall(r.lower())
            else:
                strange.append(r)
        out = dict(zip(strange, self._library(strange)))
        known = self.words
        new = {w for words in cut.values() for w in words if w not in known}
        if new:
            learnt = self._learn_words(new)
            if len(known) + len(new) > self.cache_words:  # bounded: keep what this batch uses
                known = {w: known[w] for words in cut.values() for w in words if w in known}
            known.update(learnt)
            self.words = known
        get = known.__getitem__
        out.update((r, b"".join(map(get, words))) for r, words in cut.items())
        return out

    def _plain(self, text: str) -> bool:
        """Latin-1 without the vocabulary's special strings, so the pattern alone cuts it."""
        return ("<|" not in text and (text.isascii() or self.LATIN.fullmatch(text) is not None)
                and not any(c in text for c in INFO_SEPARATORS))

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [self.TEXT_WORDS.findall(t.lower()) for t in texts]
        known = self.words
        new = set().union(*map(set, split)).difference(known)
        long = {}
        if new:
            learnt = self._learn_words(new)
            long = {w: learnt.pop(w) for w in [w for w in learnt if len(w) > self.longest]}
            if len(known) + len(learnt) > self.cache_words:  # bounded: keep what this batch uses
                known = {w: known[w] for words in split for w in words if w in known}
            known.update(learnt)
            self.words = known
        get = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return [b"".join(map(get, words)) for words in split]

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        split = [RUNS.findall(t) if any(c in t for c in INFO_SEPARATORS) else t.split() for t in texts]
        known = self.runs
        new = set().union(*map(set, split)).difference(known)
        if new:
            learnt = self._learn(new)
            short = {r: b for r, b in learnt.items() if len(r) <= self.longest}
            if len(known) + len(short) > self.cache_runs:  # bounded: keep what this batch uses
                known = {r: known[r] for runs in split for r in runs if r in known}
            known.update(short)
            self.runs = known
            if len(short) < len(learnt):
                known = {**known, **learnt}
        get = known.__getitem__
        return [b"".join(map(get, runs)) for runs in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        words = iter(self._by_words([t for t, p in zip(texts, plain) if p]))
        runs = iter(self._by_runs([t for t, p in zip(texts, plain) if not p]))
        return [next(words if p else runs) for p in plain]


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int = 0, chars: int = 4_000_000) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only where they exceed ``limit`` tokens."""

    def run(batches):
        encoder = per_worker(("runs", tokenizer_path), lambda: RunEncoder(tokenizer_path))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        step = 4 * limit
        for batch in batches:
            ids_col, text_col = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids_col):  # groups of documents with bounded characters
                stop, size, texts = at, 0, []
                while stop < len(ids_col) and (not texts or size < chars):
                    texts.append(text_col[stop].as_py())
                    size += len(texts[-1])
                    stop += 1
                doc, piece, start, length, crc = [], [], [], [], []
                for d, ids in zip(ids_col[at:stop], encoder.encode(texts)):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), step)):
                        part = ids[i:i + step]
                        doc.append(d)
                        piece.append(k)
                        start.append(i // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").alias("text")).mapInArrow(run, PIECES)


def best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, token offset) of each demand row; every demand fits an empty bin. Rows are taken in the given order."""
    n, dims = demands.shape
    bins = np.zeros(n, dtype=np.int64)
    offsets = np.zeros(n, dtype=np.int64)
    residual = np.empty((64, dims))
    name = np.empty(64, dtype=np.int64)
    open_bins = made = 0
    # least demand, per dimension, of the rows still to come: a bin below it in any dimension is closed
    ahead = np.minimum.accumulate(demands[::-1], axis=0)[::-1]
    scale = weights / capacity ** 2
    for i in range(n):
        d = demands[i]
        pick = -1
        if open_bins:
            r = residual[:open_bins]
            fits = (r >= d).all(axis=1)
            if fits.any():
                if rule == "dot":
                    # weighted dot product of the demand with what the bin already holds: the fullest bin in the
                    # dimensions that the piece needs
                    score = (r * (d * scale)).sum(axis=1)
                else:
                    left = r - d
                    score = (left * left * scale).sum(axis=1)
                pick = int(np.argmin(np.where(fits, score, np.inf)))
        if pick < 0:
            if open_bins == len(residual):
                residual = np.concatenate([residual, np.empty_like(residual)])
                name = np.concatenate([name, np.empty_like(name)])
            pick, open_bins = open_bins, open_bins + 1
            residual[pick] = capacity
            name[pick] = made
            made += 1
        bins[i] = name[pick]
        offsets[i] = capacity[0] - residual[pick, 0]
        residual[pick] -= d
        if i + 1 < n and (residual[pick] < ahead[i + 1]).any():
            open_bins -= 1
            if pick < open_bins:  # keep the order of the others: ties go to the lowest bin
                residual[pick:open_bins] = residual[pick + 1:open_bins + 1]
                name[pick:open_bins] = name[pick + 1:open_bins + 1]
    return bins, offsets


def pack(pieces: DataFrame, limit: int, max_docs: int | None = None, max_attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", block_rows: int = 16_384) -> DataFrame:
    """``pieces`` with sequence_id and offset. Capacities: ``limit`` tokens, ``max_docs`` pieces, ``max_attention``
    (sum of squared lengths). Their defaults, one piece per token and limit squared, never open a further sequence."""
    max_docs = limit if max_docs is None else max_docs
    max_attention = limit * limit if max_attention is None else max_attention
    pieces = stored(pieces, "pack-pieces")
    blocks = max(1, math.ceil(pieces.count() / block_rows))
    capacity = np.array([limit, max_docs, max_attention], dtype=float)
    share = np.array(weights, dtype=float)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        size = pdf["length"].to_numpy().astype(float)
        demands = np.stack([size, np.ones_like(size), size * size], axis=1)
        bins, offsets = best_fit(demands, capacity, share, rule)
        pdf["sequence_id"] = pdf["block"].to_numpy().astype("int64") * (1 << 32) + bins
        pdf["offset"] = offsets
        return pdf[cols + ["sequence_id", "offset"]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("block").applyInPandas(run, PIECES + ", sequence_id long, offset long")
