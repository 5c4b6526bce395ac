"""Token ids in shard files of separately compressed documents with a shared zstandard dictionary.

A shard is one block of bytes: a header with the dictionary's sha256, the documents' ids and counts, an index of offsets
and one zstandard frame a document. Blocks are stored as rows of a Parquet table, which Spark's committer makes whole or
absent and any store can hold. The table is not compressed again, its pages hold a block each, and every block has the first
and last id beside it: by the table's page index a reader fetches the one block that has a document, and by the block's own
index it decompresses that document's frame alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.common import map_arrow, settings, stash, task_number, task_offsets
from lodestone.llm.tokens import encoder

END_ID = 2
#: A shard is closed when its frames reach so many bytes.
SHARD_BYTES = 64 << 10
#: Pages of the table of shards are closed by every row that has so many bytes.
PAGES = {"parquet_page_size": str(SHARD_BYTES), "parquet_page_size_row_check_min": "1"}
#: Characters of a range of doc_ids, on average, which one task writes.
TASK_CHARS = 48 << 20
#: The dictionary is trained on the first bytes of the ids of so many documents, the smallest by hash of doc_id. What is
#: gathered for that is bounded by the number of documents and the characters of each; every document is written whole.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 4096, 64 << 10

MAGIC = b"TIDS0001"
_HEAD = struct.Struct("<8s32sBxxxI")


def narrow(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids in two bytes each if all fit, else in four; the width is stored per document."""
    if ids.size == 0 or ids.max() < 1 << 16:
        return 2, ids.astype("<u2").tobytes()
    return 4, ids.astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too few samples, their bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def build_shard(doc_ids: list[int | None] | list[str | None], widths: list[int], counts: list[int], frames: list[bytes], dictionary: bytes) -> bytes:
    """Header, then per document: known id or not, id, width, count; then n + 1 offsets into the frames, then the frames.

    Version 1 holds ids as integers. Version 2 holds them as texts: their lengths in the integers' place, and behind the
    offsets all their bytes, one after another.
    """
    n = len(frames)
    names = [d.encode() for d in doc_ids if isinstance(d, str)]
    if names:
        lengths = [len(d.encode()) if d is not None else 0 for d in doc_ids]
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    return b"".join([
        _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), 2 if names else 1, n),
        np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array(lengths if names else [d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(widths, "u1").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *names, *frames,
    ])


class Shard:
    """Reads a shard; single documents by their place in it."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        magic, digest, version, n = _HEAD.unpack_from(data)
        if magic != MAGIC or version not in (1, 2):
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        fields = []
        for kind, m in (("u1", n), ("<i8", n), ("u1", n), ("<u4", n), ("<u8", n + 1)):
            fields.append(np.frombuffer(data, kind, m, at))
            at += fields[-1].nbytes
        known, ids, self.widths, self.counts, self.offsets = fields
        self.doc_ids: list[int | None] | list[str | None] = [int(i) if k else None for k, i in zip(known, ids, strict=True)]
        if version == 2:
            ends = at + np.cumsum(ids)
            self.doc_ids = [data[e - i : e].decode() if k else None for k, i, e in zip(known, ids, ends, strict=True)]
            at = int(ends[-1])
        self._data, self._frames, self._zstd = data, at, _decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        begin, end = self._frames + int(self.offsets[i]), self._frames + int(self.offsets[i + 1])
        return np.frombuffer(self._zstd.decompress(self._data[begin:end]), f"<u{self.widths[i]}")


def _samples(path: str | None):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(encoder(path).encode(t or ""), "<u4") for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([narrow(i)[1][:SAMPLE_BYTES] for i in ids], pa.binary())], names=["sample"])

    return f


def _write(dictionary: bytes, end_id: int, path: str | None, shard_bytes: int, kind: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, compress = encoder(path).encode, np.array([end_id], "<u4").tobytes(), task_number(), _compressor(dictionary).compress
        begin = total = number = held = 0
        docs, widths, counts, frames = [], [], [], []

        def closed() -> pa.RecordBatch:
            data = build_shard(docs, widths, counts, frames, dictionary)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([begin], pa.int64()), pa.array([total - begin], pa.int64()), pa.array([docs[0]], kind), pa.array([docs[-1]], kind), pa.array([data], pa.binary())], names=["part", "number", "start_in_part", "n", "first_doc", "last_doc", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                width, raw = narrow(ids)
                docs.append(doc)
                widths.append(width)
                counts.append(len(ids))
                frames.append(compress(raw))
                total += len(ids)
                held += len(frames[-1])
                if held >= shard_bytes:
                    yield closed()
                    begin, number, held = total, number + 1, 0
                    docs, widths, counts, frames = [], [], [], []
        if docs:
            yield closed()

    return f


def _read(dictionary: bytes, kind: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data, dictionary)
                crcs, counts = [], []
                for i in range(len(shard)):
                    ids = shard.ids(i)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = start + np.cumsum([0, *counts[:-1]])
                n = len(counts)
                yield pa.record_batch([pa.array(shard.doc_ids, kind), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    return f


def write_shards(docs: DataFrame, end_id: int = END_ID, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, bytes]:
    """The written table of shards (part, number, start_in_part, n, first_doc, last_doc, data) in rising doc_id order, and the dictionary.

    Null doc_ids come first; rows of equal doc_id are ordered by text. Ids that aren't integers are kept as texts, in order of
    their bytes. A null or empty text is its end id alone, texts of any length are encoded whole, and an empty table gives
    no shard. Only doc_id and text are read.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    name, kind = ("long", pa.int64()) if whole else ("string", pa.string())
    texts = docs.select(F.col("doc_id").cast(name).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with small hashes only, a few times as many as are wanted: so what meets in one task doesn't grow with the tasks
    n, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    share = 4 * SAMPLE_DOCS / max(1, n)
    few = texts if share >= 1 else texts.filter(F.xxhash64("doc_id") < int(share * (1 << 64)) - (1 << 63))
    some = few.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_DOCS).select("text")
    samples = [bytes(r[0]) for r in map_arrow(some, _samples(path), "sample binary").collect()]
    dictionary = train_dictionary(samples)
    ordered = texts.repartitionByRange(1 + (chars or 0) // TASK_CHARS, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = map_arrow(ordered, _write(dictionary, end_id, path, shard_bytes, kind), f"part int, number int, start_in_part long, n long, first_doc {name}, last_doc {name}, data binary")
    with settings(docs.sparkSession, **PAGES):
        return stash(shards, "token-shards", "none"), dictionary


def _kind(shards: DataFrame) -> tuple[str, pa.DataType]:
    name = "long" if isinstance(shards.schema["first_doc"].dataType, IntegralType) else "string"
    return name, pa.int64() if name == "long" else pa.string()


def documents(shards: DataFrame, dictionary: bytes, wanted: list[int] | list[str]) -> DataFrame:
    """(doc_id, ids) of the wanted documents: their blocks alone are read, and of these their frames alone decompressed.

    Rows of one doc_id all come, an id that isn't there gives no row, and no ids give none. A block that begins with null
    ids, which come before all others, is read for any id up to its last one.
    """
    name, kind = _kind(shards)
    among = F.lit(False)
    for d in wanted:
        among = among | ((F.col("first_doc").isNull() | (F.col("first_doc") <= d)) & (F.col("last_doc") >= d))
    return map_arrow(shards.filter(among).select("data"), _pick(dictionary, frozenset(wanted), kind), f"doc_id {name}, ids array<long>")


def _pick(dictionary: bytes, wanted: frozenset, kind: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                shard = Shard(data, dictionary)
                at = [i for i, d in enumerate(shard.doc_ids) if d in wanted]
                yield pa.record_batch([pa.array([shard.doc_ids[i] for i in at], kind), pa.array([shard.ids(i).astype(np.int64).tolist() for i in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return f


def read_shards(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' bytes."""
    name, kind = _kind(shards)
    rows = map_arrow(shards.select("part", "start_in_part", "data"), _read(dictionary, kind), f"doc_id {name}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # as many rows as the writing job had tasks
    bases = F.broadcast(task_offsets(shards, "part", "n"))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32.

    Edge cases are those of `write_shards`; equal rows are documents of their own.
    """
    return read_shards(*write_shards(docs, end_id, path))
