import gc
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import minhash, packing, token_output
from lodestone.llm.common import PORTION_BYTES
from lodestone.llm.tokens import Encoder, encoder, vocabulary_path
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(spark, small, rows, ids_of):
    encoder = Encoder()
    encoder.MEMO = 500
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + [r[1] for r in rows if r[1]]
    texts += ["a <|endoftext|> b", "tabs\t\tand\r\nlines  \n x", "nbsp\xa0 x  y　", "don't I'LL we've", "1²½Ⅷ 漢字かな  ", "é \U0001f600 ​ z"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)


def test_packing(docs, rows, nothing, ids_of):
    out = packing.pack(docs, 64).collect()
    left = defaultdict(list)
    for r in rows:
        left[r[0], len(ids_of(r[1])) + 1].append([*ids_of(r[1]), 0])
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 64 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert set(pieces) == set(left)
    for key, own in pieces.items():
        if len(left[key]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == crc(left[key][0][at : at + r.length])
                at += r.length
            assert at == key[1]
        else:
            assert sum(r.length for r in own) == key[1] * len(left[key])
    assert packing.pack(nothing).count() == 0


def test_token_output(docs, rows, nothing, ids_of):
    out = token_output.token_output(docs).collect()
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(r[1]), 2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda x: x[1]) == want
    assert token_output.token_output(nothing).count() == 0


def test_small_shards_and_random_access(docs, ids_of, rows):
    shards, dictionary = token_output.write_shards(docs, shard_bytes=300)
    assert shards.count() > 10
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 150}
    for row in shards.orderBy("part", "number").limit(5).collect():
        shard = token_output.Shard(bytes(row.data), dictionary)
        for i, doc in enumerate(shard.doc_ids):
            if doc in texts:
                assert shard.ids(i).tolist() == [*ids_of(texts[doc]), 2]
    with pytest.raises(ValueError):
        token_output.Shard(bytes(shards.first().data), dictionary + b"x")
    assert token_output.narrow(np.array([1, 70000], "<u4"))[0] == 4


def test_one_document_is_read_without_the_rest(spark, small, ids_of):
    """By the pages' index a lookup reads one block; by the block's index it decompresses one frame."""
    import pyarrow.parquet as pq

    table = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    shards, dictionary = token_output.write_shards(table.repartition(1), shard_bytes=2000)
    wanted = sorted(texts)[len(texts) // 2 :: 40]
    got = {r.doc_id: r.ids for r in token_output.documents(shards, dictionary, wanted).collect()}
    assert got == {d: [*ids_of(texts[d]), 2] for d in wanted}
    # what the filter on ids leaves of the table: few of its blocks
    row = shards.filter((shards.first_doc <= wanted[0]) & (shards.last_doc >= wanted[0])).collect()
    assert len(row) == 1 and len(row[0].data) < sum(len(r.data) for r in shards.select("data").collect()) / 10
    for file in shards.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert all(meta.row_group(g).column(6).compression == "UNCOMPRESSED" and meta.row_group(g).column(6).has_offset_index for g in range(meta.num_row_groups))
    shard = token_output.Shard(bytes(row[0].data), dictionary)
    i = shard.doc_ids.index(wanted[0])
    # other frames may be anything
    begin, end = shard._frames + int(shard.offsets[i]), shard._frames + int(shard.offsets[i + 1])
    spoiled = bytes(row[0].data[: shard._frames]) + b"?" * (begin - shard._frames) + bytes(row[0].data[begin:end])
    assert token_output.Shard(spoiled, dictionary).ids(i).tolist() == got[wanted[0]]


def test_lookup_with_null_and_text_ids(spark, ids_of):
    rows = [(None, "null id"), (1, "one"), (2, "two words"), (2, "two again"), (7, None)]
    shards, dictionary = token_output.write_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert shards.count() == 1 and shards.first().first_doc is None
    found = token_output.documents(shards, dictionary, [1, 2, 5]).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((d, [*ids_of(t), 2]) for d, t in rows if d in (1, 2))
    assert token_output.documents(shards, dictionary, []).count() == 0
    alone, dictionary = token_output.write_shards(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string"))
    assert token_output.documents(alone, dictionary, [0]).count() == 0

    named = [(None, "null id"), ("b", "one"), ("aé", "two words"), ("", "three"), ("b", "one"), ("z", None)]
    docs = spark.createDataFrame(named, "doc_id string, text string")
    shards, dictionary = token_output.write_shards(docs, shard_bytes=20)
    assert sorted((r.doc_id, r.ids) for r in token_output.documents(shards, dictionary, ["aé", "", "q"]).collect()) == [("", [*ids_of("three"), 2]), ("aé", [*ids_of("two words"), 2])]
    out = sorted(token_output.token_output(docs).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids_crc32) for r in out] == [(d, crc([*ids_of(t), 2])) for d, t in sorted(named, key=lambda r: (r[0] is not None, (r[0] or "").encode()))]


def test_a_worker_holds_a_portion_of_a_batch(ids_of, monkeypatch):
    """Texts of a whole batch were Python objects at once, with their ids beside them."""
    monkeypatch.setattr(packing, "task_number", lambda: 3)
    texts = [None, "", *["one two  three " * (i % 7) for i in range(3000)], "long " * 400_000, "", None, "last"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing._encode(0, None)(iter([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)])))
    want = [np.array([*ids_of(t), 0], "<u4").tobytes() for t in texts]
    table = pa.Table.from_batches(out)
    assert table["doc_id"].to_pylist() == list(range(len(texts))) and table["ids"].to_pylist() == want
    assert table["start_in_part"].to_pylist() == np.cumsum([0, *(len(x) // 4 for x in want)])[:-1].tolist()
    sized = pa.record_batch([pa.array(range(64)), pa.array(["x" * (PORTION_BYTES // 4)] * 64)], names=["doc_id", "text"])
    assert [b.num_rows for b in packing._encode(0, None)(iter([sized.slice(0, 8)]))] == [4, 4]
    monkeypatch.setattr(minhash, "task_number", lambda: 0)
    raw = sized.set_column(1, "text", sized.column(1).cast(pa.binary()))
    assert [b.num_rows for b in minhash._sets(2)(iter([raw]))] == [4] * 16
    ids = pa.record_batch([raw.column(0), pa.array(range(64)), raw.column(1), raw.column(0)], names=["doc_id", "begin", "ids", "n"])
    assert sum(1 for _ in packing._cut(1024)(iter([ids]))) == 16


def test_a_worker_remembers_for_one_step():
    """Workers are used again: what an earlier step's tasks remembered stayed for good."""
    first = weakref.ref(encoder())
    encoder().encode("some words")
    assert encoder() is first()
    assert len(minhash.shingles(b"some words here")) == 2
    gc.collect()
    assert first() is None


def test_a_forgotten_piece_is_held_once(ids_of):
    one = Encoder()
    one.MEMO = 4
    text = "zebra lion tiger bear wolf fox"
    assert np.frombuffer(one.encode(text), "<u4").tolist() == ids_of(text) and one.old and not one.new
    assert np.frombuffer(one.encode("zebra lion"), "<u4").tolist() == ids_of("zebra lion")
    assert not one.old.keys() & one.new.keys() and set(one.new) == {"zebra", " lion"}
