"""Fill-in-the-middle transformation by displacement scatter.

A text is cut at two word limits into prefix, middle and suffix, which come out tagged in another order: ``psm`` is
prefix, suffix, middle; ``spm`` is suffix, prefix, middle; ``plain`` is the text itself.

Method. The texts of an Arrow batch are one array of UTF-8 bytes. A scan finds the ends of all units (white space and
the word after it; white space at the end of a text is a unit of its own) and so the byte places of the cuts. Every
part of a text moves as one: a difference array holds, at each part's first byte, by how much its displacement differs
from that of the part before, so its cumulative sum is the displacement of every byte, and one scatter builds all
outputs of the batch. ``restore`` reads the tags of an output, forms the inverse displacements the same way and gathers.

Choice. The four numbers that decide form and cuts are the first 32-bit groups of SHA-256 of ``seed:doc_id``, so a
document's result depends on itself alone, not on batches, partitions or retries.

Scale. One pass without a shuffle. Texts are taken in groups of bounded bytes, and displacements are made for bounded
slices of a group, so a very long text needs a few times its own bytes only.

Edge cases. A null text is the empty text, which stays plain, as does a text that contains a tag. White space only is
one unit. A null doc_id counts as the empty string after ``seed:``. Repeated rows give repeated equal rows; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_text

#: The tags, all of three bytes.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TAG = 3
SLICE = 1 << 20

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def groups_of(column: pa.Array, limit: int):
    """(first row, last row, bytes, offsets) of a string column in groups of at most ``limit`` bytes or one text."""
    text = column.cast(pa.large_string())
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, stop, data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop


def displaced(places: np.ndarray, shifts: np.ndarray, total: int):
    """(slice start, slice stop, displaced place of every byte of the slice): part i starts at places[i] and moves by
    shifts[i]. ``places`` rises; parts without bytes share the place of the next one."""
    change = np.diff(shifts, prepend=0)
    carry = 0
    for lo in range(0, total, SLICE):
        hi = min(lo + SLICE, total)
        a, b = np.searchsorted(places, [lo, hi])
        difference = np.zeros(hi - lo, np.int64)
        np.add.at(difference, places[a:b] - lo, change[a:b])
        difference[0] += carry
        shift = np.cumsum(difference, out=difference)
        carry = int(shift[-1])
        shift += np.arange(lo, hi)
        yield lo, hi, shift


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after the last byte of every unit. White space is ASCII, so bytes decide."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    # white space before a text's first byte of another text ends nothing: a word that ends its text is marked above
    return np.flatnonzero(ends) + 1


def tag_places(data: np.ndarray) -> np.ndarray:
    """First byte of every tag. None crosses texts that don't end inside one; callers check the text's end."""
    if len(data) < TAG:
        return np.empty(0, np.int64)
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62))
    name = data[at + 1]
    return at[(name == PREFIX[1]) | (name == SUFFIX[1]) | (name == MIDDLE[1])]


def holds_tag(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = tag_places(data)
    doc = np.searchsorted(offsets, at, "right") - 1
    held = np.zeros(len(offsets) - 1, bool)
    held[doc[at + TAG <= offsets[doc + 1]]] = True
    return held


def numbers(seed: int, doc_id: int | None) -> list[int]:
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i:i + 4], "big") for i in (0, 4, 8, 12)]


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs; cuts are places in ``data``; form is 0 plain, 1 psm, 2 spm."""
    start, stop = offsets[:-1], offsets[1:]
    tagged = form > 0
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(stop - start + 3 * TAG * tagged, out=out[1:])
    o, lp, ls = out[:-1], first - start, stop - second
    psm, spm = form == 1, form == 2
    # where each part's first byte goes; a plain text is all prefix
    prefix = o + np.where(psm, TAG, np.where(spm, 2 * TAG + ls, 0))
    suffix = o + np.where(psm, 2 * TAG + lp, TAG)
    middle = o + 3 * TAG + lp + ls
    places = np.stack([start, first, second], axis=1)
    shifts = np.stack([prefix, middle, suffix], axis=1) - places
    shifts[~tagged] = (o - start)[~tagged, None]
    made = np.empty(out[-1], np.uint8)
    for lo, hi, to in displaced(places.ravel(), shifts.ravel(), len(data)):
        made[to] = data[lo:hi]
    for tag, at in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)):
        made[(at[tagged] - TAG)[:, None] + np.arange(TAG)] = np.frombuffer(tag, np.uint8)
    return made, out


def gather(made: np.ndarray, out: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts behind outputs: the inverse displacements from the tags that the outputs hold."""
    tagged = np.flatnonzero(form > 0)
    at = tag_places(made)
    doc = np.searchsorted(out, at, "right") - 1
    at = at[(form[doc] > 0) & (at + TAG <= out[doc + 1])]
    if not np.array_equal(np.searchsorted(out, at, "right") - 1, np.repeat(tagged, 3)):
        raise ValueError("an output doesn't hold exactly three tags")
    tags = at.reshape(-1, 3)
    psm = form[tagged] == 1
    names = np.where(psm[:, None], [PREFIX[1], SUFFIX[1], MIDDLE[1]], [SUFFIX[1], PREFIX[1], MIDDLE[1]])
    if not np.array_equal(made[tags + 1], names):
        raise ValueError("the tags of an output don't fit its form")
    end = out[tagged + 1]
    one, two = tags[:, 1] - tags[:, 0] - TAG, tags[:, 2] - tags[:, 1] - TAG
    lp, ls = np.where(psm, one, two), np.where(psm, two, one)
    lm = end - tags[:, 2] - TAG
    size = np.diff(out)
    size[tagged] -= 3 * TAG
    offsets = np.zeros(len(out), np.int64)
    np.cumsum(size, out=offsets[1:])
    places = np.repeat(offsets[:-1, None], 3, axis=1)
    places[tagged, 1] += lp
    places[tagged, 2] += lp + lm
    # where each part of the text comes from
    source = np.repeat(out[:-1, None], 3, axis=1)
    source[tagged] = np.stack([np.where(psm, tags[:, 0], tags[:, 1]), tags[:, 2], np.where(psm, tags[:, 1], tags[:, 0])], axis=1) + TAG
    shifts = source - places
    text = np.empty(offsets[-1], np.uint8)
    for lo, hi, to in displaced(places.ravel(), shifts.ravel(), len(text)):
        text[lo:hi] = made[to]
    return text, offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    array = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
    return array.cast(pa.string())


def code_points(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


FORMS = ["plain", "psm", "spm"]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, group_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every text. ``rate`` of 100 texts are rearranged,
    ``spm_rate`` of 100 of these with the suffix first."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in groups_of(batch.column(1), group_bytes):
                h = np.array([numbers(seed, d) for d in ids[lo:hi]], np.int64)
                ends = unit_ends(data, offsets)
                base = np.searchsorted(ends, offsets[:-1], "right")
                n = np.searchsorted(ends, offsets[1:], "right") - base
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                places = np.concatenate([ends, [0]])
                first, second = (np.where(c > 0, places[base + c - 1], offsets[:-1]) for c in cuts.T)
                plain = (n == 0) | holds_tag(data, offsets) | (h[:, 2] % 100 >= rate)
                form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_rate, 2, 1))
                made, out = scatter(data, offsets, first, second, form)
                parts = [(None, None) if f == 0 else (code_points(data[s:a]), code_points(data[a:b]))
                         for f, s, a, b in zip(form.tolist(), offsets[:-1].tolist(), first.tolist(), second.tolist())]
                yield pa.record_batch([pa.array(ids[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array([FORMS[f] for f in form.tolist()]),
                                       pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), strings(made, out)],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").alias("text")).mapInArrow(run, RESULT)


def restore(outputs: DataFrame, group_bytes: int = 4_000_000) -> DataFrame:
    """The rows of ``transform`` with ``restored``, the text rebuilt from output and form alone."""

    def run(batches):
        for batch in batches:
            forms = np.array([FORMS.index(f) for f in batch.column("form").to_pylist()], np.int64)
            for lo, hi, made, out in groups_of(batch.column("output"), group_bytes):
                text, offsets = gather(made, out, forms[lo:hi])
                rows = batch.slice(lo, hi - lo)
                yield pa.record_batch([*rows.columns, strings(text, offsets)], names=[*rows.schema.names, "restored"])

    return outputs.mapInArrow(run, RESULT + ", restored string")


def digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return restore(transform(docs, seed)).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                                 F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle_sql(seed: int = 42, rate: int = 50, spm_rate: int = 80) -> str:
    """DuckDB SQL for ``digests`` over the table ``documents``: units as lists, parts joined in their new order."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {rate} THEN 'plain'
             WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
