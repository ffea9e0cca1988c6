"""Fuzzy search for short license notices.

Method. A text is reduced to its lower-case words, one space apart. A notice of length L may carry up to k edits,
k growing with L. By the pigeonhole principle a copy with at most k edits holds at least one of the notice's k + 1
pieces unchanged, so an exact search for the pieces finds every candidate place; there the ``regex`` library's
bounded-error matching (at most k insertions, deletions and substitutions) verifies the copy, counts its edits and
gives its span. A copy must begin and end at word bounds.

Each text is searched whole; a text is bytes until a piece is found, so clean texts cost one pass per piece.

Edge cases. Null is the empty text. Overlapping candidates of a notice are searched once; several notices may share
a span and all are reported. Ties between spans go to fewer edits, then to the earlier one. Repeated rows are judged
alone; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_text

#: Exact phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the fuzzy search adds, and their labels.
NOTICES = {
    **BASE,
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
#: Letters a notice must have per edit, so that short ones match exactly.
LETTERS_PER_EDIT = 9

#: ASCII bytes to a lower-case letter, a digit or a space; other bytes belong to words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
             for b in range(256))

SPAN = "array<struct<label: string, first_word: long, last_word: long, edits: int, text: string>>"
RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          f"score double, spans {SPAN}")


def edits_allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


def seeds(notice: str) -> list[tuple[int, str]]:
    """k + 1 pieces of the notice and their offsets."""
    k = edits_allowed(notice) + 1
    cuts = [round(i * len(notice) / k) for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def places(text: bytes, needle: bytes):
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE):
        import regex
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.fuzzy = []
        for notice, label in notices.items():
            k = edits_allowed(notice)
            bound = f"{{i<={k},d<={k},s<={k},e<={k}}}" if k else ""
            pattern = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice)}){bound}(?![^ ])")
            self.fuzzy.append((label, len(notice), k, [(a, s.encode()) for a, s in seeds(notice)], pattern))

    def windows(self, text: bytes, length: int, k: int, pieces):
        """Byte ranges that hold every copy of a notice, apart from each other and cut at word bounds."""
        # a character has up to four bytes; the edits may all be such characters
        slack = 4 * k + 1
        spans = sorted((max(0, at - a - slack), min(len(text), at - a + length + slack)) for a, s in pieces for at in places(text, s))
        out: list[list[int]] = []
        for lo, hi in spans:
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return out

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(FOLD).split()
        text = b" " + b" ".join(words) + b" "
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)  # a place's word number is its rank among them
        starts, base_labels = [], set()
        for phrase, label in self.base:
            at = list(places(text, phrase))
            if at:
                starts += np.searchsorted(blanks, at).tolist()
                base_labels.add(label)
        found = {}
        for label, length, k, pieces, pattern in self.fuzzy:
            for lo, hi in self.windows(text, length, k, pieces):
                # widen to whole words, so that the bounds are seen as they are
                lo, hi = text.rfind(b" ", 0, lo + 1), text.find(b" ", hi - 1)
                lo, hi = max(lo, 0), len(text) if hi < 0 else hi + 1
                window = text[lo:hi].decode("utf-8", "replace")
                at, seen = lo, 0  # byte place of the character ``seen`` of the window
                for m in pattern.finditer(window):
                    edits = sum(m.fuzzy_counts)
                    at, seen = at + len(window[seen:m.start()].encode()), m.start()
                    first = int(np.searchsorted(blanks, at)) - 1
                    last = first + m.group().count(" ")
                    key = (label, first)
                    if key not in found or edits < found[key][3]:
                        found[key] = (label, first, last, edits, m.group(), 1 - edits / length)
        spans = [found[k] for k in sorted(found, key=lambda k: (k[1], k[0]))]
        labels = base_labels | {s[0] for s in spans}
        score = max([s[5] for s in spans], default=0.0)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), 1.0 if starts else score,
                [dict(zip(("label", "first_word", "last_word", "edits", "text"), s)) for s in spans])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, best score (1 - edits / length) and the verified spans."""

    def run(batches):
        scanner = Scanner()
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                   ("edits", pa.int32()), ("text", pa.string())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            if batch.num_rows:
                got = list(zip(*(scanner.scan(x.as_py()) for x in batch.column(1))))
                yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(got, kinds))], names=names)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").cast("binary").alias("raw"))
    return raw.mapInArrow(run, RESULT)
