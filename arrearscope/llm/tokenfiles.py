"""Token-id files: documents as ids in one global order, coded by the adaptive context-mixing range coder.

Format. A folder of Parquet files whose rows are segments: consecutive documents in ascending (doc_id, hash of the text)
order, about ``segment`` tokens or one longer document. Columns: part and seq (place of the segment in the order), doc_ids
and lengths (its documents and their ids, end id included), n_tokens, and payload. The payload is little-endian binary:
``IDMX``, version, vocabulary size, number of blocks; per block its ids, bytes and CRC-32; the CRC-32 of all that; then the
blocks' coded words (see ``mixcoder``). Blocks have ``block`` ids and are reset and checked independently. Parquet is the
container because Spark commits it: a lost executor or a repeated task leaves no half-written file, any store works, and
positions are read without the payloads.

Scale. The texts are range-partitioned by document order (one shuffle of the texts), tokenised and coded where they then
lie. Start positions are prefix sums over the segments' sizes: inside a part, and over the parts in two levels. Reading
decodes segments wherever they lie. Working memory is bounded: ``lanes`` blocks at a time and one segment or document.

Edge cases. A null text is the empty text and has the end id only. Null doc_ids come first. Rows that repeat a doc_id
follow in the order of their texts' hashes; repeated rows are documents of their own. An empty table gives no segments. A
damaged header or block raises ``ValueError``. Other columns are ignored.
"""
from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mixcoder
from .common import no_text, per_worker
from .packing import RunEncoder

MAGIC, VERSION = b"IDMX", 1
HEAD, BLOCK = "<4sBII", "<III"
HEAD_SIZE, BLOCK_SIZE = struct.calcsize(HEAD), struct.calcsize(BLOCK)
SEGMENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
                        T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType())])


def payloads(segments: list[np.ndarray], vocabulary: int, block: int, lanes: int) -> list[bytes]:
    """The binary form of each segment's ids; all their blocks are coded side by side."""
    cut = [[ids[i:i + block] for i in range(0, len(ids), block)] for ids in segments]
    flat = [b for blocks in cut for b in blocks]
    coded = [c for i in range(0, len(flat), lanes) for c in mixcoder.encode(flat[i:i + lanes], vocabulary)]
    out, at = [], 0
    for blocks in cut:
        mine = coded[at:at + len(blocks)]
        at += len(blocks)
        head = struct.pack(HEAD, MAGIC, VERSION, vocabulary, len(blocks)) + b"".join(
            struct.pack(BLOCK, len(b), len(c), mixcoder.checksum(b)) for b, c in zip(blocks, mine))
        out.append(b"".join([head, struct.pack("<I", zlib.crc32(head)), *mine]))
    return out


def blocks_in(payload: bytes) -> int:
    if len(payload) < HEAD_SIZE:
        raise ValueError("a segment without a header")
    return struct.unpack_from(HEAD, payload)[3]


def blocks_of(payload: bytes) -> tuple[int, list[tuple[int, int, bytes]]]:
    """(vocabulary, (ids, CRC-32, coded words) of every block) after checking the header."""
    blocks_in(payload)
    magic, version, vocabulary, n = struct.unpack_from(HEAD, payload)
    stop = HEAD_SIZE + n * BLOCK_SIZE
    if magic != MAGIC or version != VERSION or len(payload) < stop + 4 or zlib.crc32(payload[:stop]) != struct.unpack_from("<I", payload, stop)[0]:
        raise ValueError("a segment's header is damaged")
    at, blocks = stop + 4, []
    for i in range(n):
        ids, size, crc = struct.unpack_from(BLOCK, payload, HEAD_SIZE + i * BLOCK_SIZE)
        blocks.append((ids, crc, payload[at:at + size]))
        at += size
    if at != len(payload):
        raise ValueError("a segment's length doesn't fit its header")
    return vocabulary, blocks


def ids_of(payloads_: list[bytes], lanes: int) -> list[np.ndarray]:
    """The ids of every segment; each block is checked."""
    found = [blocks_of(p) for p in payloads_]
    parts: list[list[np.ndarray]] = [[] for _ in found]
    for vocabulary in sorted({v for v, _ in found}):
        flat = [(s, b) for s, (v, blocks) in enumerate(found) if v == vocabulary for b in blocks]
        for i in range(0, len(flat), lanes):
            some = flat[i:i + lanes]
            for (s, (_, crc, _)), ids in zip(some, mixcoder.decode([b[2] for _, b in some], [b[0] for _, b in some], vocabulary)):
                if mixcoder.checksum(ids) != crc:
                    raise ValueError("a block doesn't fit its checksum")
                parts[s].append(ids)
    return [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, block: int = 8192, segment: int = 1 << 20,
                 lanes: int = 512, part_chars: int = 16_000_000, chars: int = 4_000_000) -> None:
    """Write all documents' ids, each followed by ``end_id``, in ascending doc_id order into ``folder``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_text("text").alias("text"))
    size = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = (texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, math.ceil(size / part_chars)), *order)
             .sortWithinPartitions(*order).select("doc_id", "text"))

    def documents(batches, encoder):
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(names):
                texts, held = [], 0
                while at + len(texts) < len(names) and (not texts or held < chars):
                    texts.append(column[at + len(texts)].as_py())
                    held += len(texts[-1])
                for name, ids in zip(names[at:], encoder.encode(texts)):
                    yield name, np.frombuffer(ids + end, "<u4")
                at += len(texts)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = per_worker(("runs", tokenizer_path), lambda: RunEncoder(tokenizer_path))
        vocabulary = max(encoder.whole.get_vocab_size(), end_id + 1)
        waiting, names, ids, held, seq = [], [], [], 0, 0

        def coded():
            bodies = payloads([np.concatenate(i) for _, i in waiting], vocabulary, block, lanes)
            for k, ((n, i), body) in enumerate(zip(waiting, bodies)):
                lengths = [len(x) for x in i]
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([seq - len(waiting) + k], pa.int32()), pa.array([n], pa.list_(pa.int64())),
                                       pa.array([lengths], pa.list_(pa.int64())), pa.array([sum(lengths)], pa.int64()), pa.array([body], pa.binary())],
                                      names=SEGMENT.names)

        for name, some in documents(batches, encoder):
            names.append(name)
            ids.append(some)
            held += len(some)
            if held >= segment:
                waiting.append((names, ids))
                names, ids, held, seq = [], [], 0, seq + 1
                if sum(sum(map(len, i)) for _, i in waiting) >= lanes * block:
                    yield from coded()
                    waiting = []
        if names:
            waiting.append((names, ids))
            seq += 1
        if waiting:
            yield from coded()

    dealt.mapInArrow(run, SEGMENT).write.parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(folder)


def decoded(found: DataFrame, schema: str, row, lanes: int = 512) -> DataFrame:
    """Rows made by ``row(doc_id, part, seq, local start, ids)`` of every document of the segments."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            at, bodies = 0, {}
            while at < batch.num_rows:  # a few segments at a time
                stop, blocks = at, 0
                while stop < batch.num_rows and (stop == at or blocks < lanes):
                    bodies[stop] = cols["payload"][stop].as_py()
                    blocks += blocks_in(bodies[stop])
                    stop += 1
                rows = []
                for k, ids in zip(range(at, stop), ids_of([bodies.pop(k) for k in range(at, stop)], lanes)):
                    start = 0
                    for name, n in zip(cols["doc_ids"][k].as_py(), cols["lengths"][k].as_py()):
                        rows.append(row(name, cols["part"][k].as_py(), cols["seq"][k].as_py(), start, ids[start:start + n]))
                        start += n
                    if start != len(ids):
                        raise ValueError("a segment's documents don't fit its ids")
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                at = stop

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return found.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array) of every document in the files."""
    return decoded(segments(spark, folder), "doc_id long, ids array<long>", lambda name, part, seq, start, ids: {"doc_id": name, "ids": ids})


def positions(found: DataFrame, parts_in_bucket: int = 1024) -> DataFrame:
    """(part, seq, base): ids of all segments before each one. Reads no payload."""
    before = [Window.unboundedPreceding, -1]
    sizes = found.select("part", "seq", "n_tokens").withColumn("bucket", F.floor(F.col("part") / parts_in_bucket))
    parts = sizes.groupBy("bucket", "part").agg(F.sum("n_tokens").alias("n"))
    # one row per bucket of parts in the only window without a key
    buckets = (parts.groupBy("bucket").agg(F.sum("n").alias("n"))
               .select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("bucket_base")))
    parts = parts.select("bucket", "part", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_base"))
    inside = sizes.select("bucket", "part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("bucket", "part").orderBy("seq").rowsBetween(*before)), F.lit(0)).alias("inside"))
    return (inside.join(parts, ["bucket", "part"]).join(buckets, "bucket")
            .select("part", "seq", (F.col("bucket_base") + F.col("part_base") + F.col("inside")).alias("base")))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    found = segments(spark, folder)
    rows = decoded(found, "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long",
                   lambda name, part, seq, start, ids: {"doc_id": name, "part": part, "seq": seq, "local": start, "n_tokens": len(ids),
                                                        "ids_crc32": mixcoder.checksum(ids)})
    return rows.join(positions(found), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
