"""Concatenate and cut: documents become one stream of token ids, cut into windows of fixed length.

Pass one encodes each partition, notes where each document begins within it and writes both. Sums over the partitions'
totals then say where each partition begins in the stream, and pass two cuts each document at the windows' borders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, portions, stash, task_number, task_offsets
from lodestone.llm.tokens import encoder

WINDOW = 1024
END_ID = 0


def _encode(end_id: int, path: str | None):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, at = encoder(path).encode, end_id.to_bytes(4, "little"), task_number(), 0
        for batch in portions(batches, 1):
            ids, starts = [], []
            for text in batch.column(1).to_pylist():
                ids.append(encode(text or "") + end)
                starts.append(at)
                at += len(ids[-1]) // 4
            yield pa.record_batch([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "start_in_part", "n", "ids"])

    return f


def _cut(window: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            rows, starts, lengths, crcs = [], [], [], []
            at = batch.column(1).to_pylist()
            for row, ids in enumerate(batch.column(2)):
                data, begin = ids.as_buffer(), at[row]
                n, done = data.size // 4, 0
                view = memoryview(data)
                while done < n:
                    take = min(n - done, window - (begin + done) % window)
                    rows.append(row)
                    starts.append(done)
                    lengths.append(take)
                    crcs.append(zlib.crc32(view[4 * done : 4 * (done + take)]))
                    done += take
            rows = pa.array(rows, pa.int64())
            start = pa.array(starts, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(rows), start, pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), batch.column(3).take(rows), batch.column(1).take(rows)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_begin"],
            )

    return f


def encode_stream(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, with the end id), n and begin, the document's place in the whole stream; written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), _encode(end_id, path), f"doc_id {kind}, part int, start_in_part long, n long, ids binary")
    coded = stash(coded, "packed-ids")
    # as many rows as the encoding job had tasks
    bases = F.broadcast(task_offsets(coded, "part", "n"))
    return coded.join(bases, "part").select("doc_id", "ids", "n", (F.col("base") + F.col("start_in_part")).alias("begin"))


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only the last sequence is short of `window`, and padded. A null or empty text is its end id alone. Equal rows are
    documents of their own, texts of any length are cut over as many sequences as they take, an empty table gives no rows.
    The stream's order is that of the input's partitions. Only doc_id, of any type and null if it is, and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stream = encode_stream(docs, end_id, path).select("doc_id", "begin", "ids", "n")
    pieces = map_arrow(stream, _cut(window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, doc_begin long")
    at = F.col("doc_begin") + F.col("start")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr(f"(doc_begin + start) div {window}").alias("sequence_id"), (at % window).alias("offset"))
