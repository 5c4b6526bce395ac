"""Best-fit packing, planned over the histogram of lengths.

A first pass encodes every document, cuts what is longer than a sequence and counts the pieces of each length. There are no
more lengths than tokens in a sequence, so best fit, longest first, runs over counts: whole ranges of equally full sequences
are filled at once, and the plan has as many rows as ranges, not as documents. Every piece then has a rank among those of its
length and takes the slot that the plan holds for that length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import map_arrow, stash, task_number, utf8
from lodestone.llm.tokens import spaced_encoder

WINDOW = 2048
END_ID = 0
#: Bits of a rank in the key that a slot is found by.
RANK_BITS = 44
_PIECE = ("piece int", "start long", "length long", "ids_crc32 long")


def _encode(window: int, end_id: int, path: str | None, with_ids: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = spaced_encoder(path).encode, end_id.to_bytes(4, "little"), task_number()
        seen = [0] * (window + 1)
        for batch in batches:
            rows, pieces, lengths, crcs, nth, kept = [], [], [], [], [], []
            for row, raw in enumerate(batch.column(1)):
                ids = encode(raw.as_py()) + end
                view = memoryview(ids)
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    own = view[at : at + 4 * window]
                    length = len(own) // 4
                    rows.append(row)
                    pieces.append(piece)
                    lengths.append(length)
                    crcs.append(zlib.crc32(own))
                    nth.append(seen[length])
                    seen[length] += 1
                    if with_ids:
                        kept.append(bytes(own))
            number = pa.array(pieces, pa.int32())
            start = pa.array(np.array(pieces, np.int64) * window, pa.int64())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), number, start, pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.record_batch([*columns, pa.array(kept, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return f


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over counts of lengths; returns the segments of the plan and the number of sequences.

    A segment (length, first, sequence, per, offset) says where pieces of a length go whose rank is `first` or more: `per` of
    them into each sequence from `sequence` on, one after another from `offset`. A range of sequences that takes pieces of
    some length keeps less room than half of what it had, and a length makes at most four new ranges, so the plan has a
    bounded number of segments, however many documents there are.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    segments, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for space in [*sorted(s for s in room if s >= length and room[s]), window]:
            while left and (room[space] or space == window):
                per = space // length
                wanted = -(-left // per)
                if room[space]:
                    first, there = room[space].pop()
                else:
                    first, there, sequences = sequences, wanted, sequences + wanted
                if there > wanted:
                    room[space].append((first + wanted, there - wanted))
                take = min(left, there * per)
                segments.append((length, rank, first, per, window - space))
                full, rest = divmod(take, per)
                if full:
                    room[space - per * length].append((first, full))
                if rest:
                    room[space - rest * length].append((first + full, 1))
                left, rank = left - take, rank + take
    return np.array(sorted(segments), np.int64).reshape(-1, 5), sequences


def _slots(segments):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        keys = (table[:, 0] << RANK_BITS) | table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, "right") - 1
            _, first, sequence, per, offset = table[at].T
            nth = rank - first
            kept = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(sequence + nth // per), pa.array(offset + nth % per * length)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return f


def _packed(docs: DataFrame, window: int, end_id: int, path: str | None, with_ids: bool) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    columns = [f"doc_id {kind}", *_PIECE, "part int", "nth long", *(["ids binary"] if with_ids else [])]
    pieces = stash(map_arrow(docs.select("doc_id", utf8(F.col("text")).alias("raw")), _encode(window, end_id, path, with_ids), ", ".join(columns)), "best-fit-pieces")
    counts = stash(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "best-fit-counts")
    # a row a length: no more than tokens in a sequence
    segments, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"])
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    given = [f"doc_id {kind}", *_PIECE, *(["ids binary"] if with_ids else []), "sequence_id long", "offset long"]
    return map_arrow(ranked.select(*out, (F.col("base") + F.col("nth")).alias("rank")), _slots(spark.sparkContext.broadcast(segments)), ", ".join(given))


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id (from 0) and offset.

    A document is its ids and the end id; only one that is longer than `window` is cut. A null or empty text is its end id
    alone, texts of any length are encoded whole (a slice at a time), equal rows are documents of their own, an empty table
    gives no rows. Only doc_id, of any type and null if it is, and text are read.
    """
    return _packed(docs, window, end_id, path, False)


def sequences(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids (little-endian 32-bit, padded to `window`); edge cases as in `pack`."""
    pieces = _packed(docs, window, end_id, path, True)
    # a sequence has at most `window` tokens, and so as many pieces at most
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (window - F.col("n_tokens")).cast("int")))
    return held.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"))
