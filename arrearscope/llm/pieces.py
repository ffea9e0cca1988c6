"""SentencePiece encoding and decoding for merge-type vocabularies.

Method. A segment starts as its code points (bytes where the vocabulary lacks one). An agenda holds the adjacent
symbol pairs whose concatenation is a piece, best score first, leftmost first among equals; the top pair is merged,
its stale neighbours are dropped when they surface, and the two new pairs enter. What is left when the agenda is
empty is the encoding.

Segments. A merge across a place needs a piece that spans it, so a text is cut, without changing any id, where no
piece of the vocabulary can span: before a run of spaces, around line feeds, and between a word of letters and the
mark after it. ``Merges`` proves each from the vocabulary when it loads and cuts less, down to whole texts, where one fails. Segments repeat, so a bounded cache
keeps their ids and their decoded text.

Check. In each Arrow batch every segment that is new to the cache is also encoded and decoded by the
``sentencepiece`` library; a difference raises.

Edge cases. Null is the empty text: no ids, empty decoding. Very long unbroken segments are encoded by the same
agenda (n log n) and are not cached. Repeated rows and further columns need no care; an empty table gives an empty
result.
"""
from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_text, per_worker

SPACE = "▁"  # the vocabulary's visible space
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_segments long"


class Merges:
    """A merge-type SentencePiece vocabulary: encode and decode segments."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.byte = [i for i in range(n) if lib.is_byte(i)]
        self.raw = {i: int(self.piece[i][3:5], 16) for i in self.byte}
        self.byte_id = {b: i for i, b in self.raw.items()}
        # a piece as text; None for bytes, which only mean something together
        self.shown = [None if i in self.raw else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        if len(self.byte_id) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.name = [f",{i}" for i in range(n)]
        # normal pieces merge by score; a piece's score only needs its rank
        # (a piece of one symbol is never the result of a merge)
        self.score = {self.piece[i]: lib.get_score(i) for i in plain if len(self.piece[i]) > 1}
        self.can_cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p and len(p) > 1 for p in self.id)
        # a first segment begins with the dummy space; others with their own spaces
        self.segment = re.compile(r" *[^ \n]+| +|\n") if self.can_cut else re.compile(r"[\s\S]+")
        if self.can_cut and not any(re.search(f"[{LETTERS}][{MARKS}]", p) for p in self.id):
            self.segment = re.compile(rf" *[{LETTERS}]++(?=[{MARKS}])| *[^ \n]+| +|\n")

    def merge(self, symbols: str) -> list[int]:
        """Ids of a segment whose spaces are visible ones."""
        whole = self.id.get(symbols)
        score = self.score
        part = list(symbols)
        n = len(part)
        if n == 1 and whole is not None:
            return [whole]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i, both in enumerate(map(str.__add__, part, part[1:])):
            s = score.get(both)
            if s is not None:
                agenda.append((-s, i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = right[i]
            if part[i] is None or j >= n or part[i] + part[j] != both:
                continue  # one of the two was merged away since
            part[i], part[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                wide = both + part[k]
                s = score.get(wide)
                if s is not None:
                    heapq.heappush(agenda, (-s, i, wide))
            h = left[i]
            if h >= 0:
                wide = part[h] + both
                s = score.get(wide)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, wide))
        out = []
        for p in part:
            if p is not None:
                i = self.id.get(p)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_id[b] for b in p.encode("utf-8"))
        return out

    def text(self, ids: list[int]) -> str:
        """Decoded ids, the leading space kept: pieces with real spaces, byte runs as UTF-8.

        A byte that begins no valid character becomes one replacement character.
        """
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, held = [], bytearray()

        def flush():
            if held:
                out.append(replaced(bytes(held)))
                held.clear()

        for i in ids:
            b = self.raw.get(i)
            if b is not None:
                held.append(b)
            else:
                flush()
                out.append(self.shown[i])
        flush()
        return "".join(out)


def replaced(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):  # valid characters stay, each other byte is replaced alone
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i:i + size].decode("utf-8"))
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class Codec:
    """Whole texts through ``Merges`` with a bounded segment cache, checked against the library batch by batch."""

    def __init__(self, path: str, cache: int = 900_000, longest: int = 40, check: bool = True):
        self.merges, self.size, self.longest, self.check = Merges(path), cache, longest, check
        self.known: dict[str, tuple[str, int, str]] = {}

    def _learn(self, segments: set[str]) -> dict[str, tuple[str, int, str]]:
        m = self.merges
        names = list(segments)
        ids = [m.merge(s.replace(" ", SPACE)) for s in names]
        text = [m.text(i) for i in ids]
        if self.check and names:
            # a lone segment gets the library's dummy space only if it has none of its own: put a line feed, which
            # merges with nothing, before each and drop the two ids it gives
            lib = m.library
            theirs = [x[2:] for x in lib.encode(["\n" + s for s in names], num_threads=1)]
            back = [x[1:] for x in lib.decode([lib.encode("\n") + i for i in ids], num_threads=1)]
            for s, a, b, c, d in zip(names, ids, theirs, text, back):
                if a != b or c != d:
                    raise ValueError(f"segment {s[:80]!r}: ids {a[:20]} and the library's {b[:20]}, texts {c[:80]!r} and {d[:80]!r}")
        # (a text equal to its segment is kept once)
        name = m.name
        return {s: ("".join([name[x] for x in i]), len(i), s if t == s else t) for s, i, t in zip(names, ids, text)}

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """(ids, SHA-256 of the ids, SHA-256 of the decoded text, segments) of each text."""
        cut = self.merges.segment.findall
        # the dummy space stands before the first character, whatever it is; visible spaces are spaces
        split = [cut((" " + t).replace(SPACE, " ")) if t else [] for t in texts]
        known = self.known
        new = set().union(*split).difference(known) if split else set()
        if new:
            learnt = self._learn(new)
            short = {s: v for s, v in learnt.items() if len(s) <= self.longest}
            if len(known) + len(short) > self.size:  # bounded: keep what this batch uses
                known = {s: known[s] for segments in split for s in segments if s in known}
            known.update(short)
            self.known = known
            if len(short) < len(learnt):
                known = {**known, **learnt}
        get = known.__getitem__
        out = []
        for segments in split:
            got = list(map(get, segments))
            ids = "".join([g[0] for g in got])[1:]
            text = "".join([g[2] for g in got])
            # decoding drops the dummy space
            out.append((sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(text[1:].encode()).hexdigest(), len(got)))
        return out


def encode_documents(docs: DataFrame, model_path: str, chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_segments of every whole text."""

    def run(batches):
        codec = per_worker(("pieces", model_path), lambda: Codec(model_path))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and (not part or size < chars):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                got = list(zip(*codec.digests(part)))
                yield pa.record_batch([pa.array(ids[at:at + len(part)], pa.int64()), pa.array(got[0], pa.int64()), pa.array(got[1]),
                                       pa.array(got[2]), pa.array(got[3], pa.int64())],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_segments"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").alias("text")).mapInArrow(run, RESULT)
