import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestone.llm import best_fit
from lodestone.llm.common import slices
from lodestone.llm.tokens import _CHUNK, SPACED_VOCABULARY, SpacedEncoder, vocabulary_path
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(vocabulary_path(SPACED_VOCABULARY))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(spark, small, rows, ids_of, monkeypatch):
    encoder = SpacedEncoder()
    encoder.MEMO = 300
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + [r[1] for r in rows if r[1]]
    texts += ["a <|endoftext|> b<|startoftext|>c <|StartOfText|> x", "H\u0331 h\u0331 K Å ǅ ɐʼs ŉ ß ẞ º½² ¼x \xad\x00\x7f", "can't!'s ..'re 12ab34", "tabs\t\tand\x0b\x0cvt\r\nlines \n x", "nbsp\xa0 x y　z\x85w", "don't I'LL we've ΟΔΟΣ ΣΑΣ İstanbul", "1²½Ⅷ 漢字かな \x1c a\x1cb", "é e ́ Å Å", "​ zwsp​x", "x" * 300]
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids_of(text), text[:80]
    assert encoder.pieces[1] and encoder.chunks[0]
    for text in texts:
        encoder.chunks[0].clear()
        assert np.frombuffer(encoder._ids(_CHUNK.findall(text), encoder.chunks, encoder._of_chunk), "<u4").tolist() == ids_of(text)
    monkeypatch.setattr("lodestone.llm.common.SLICE", 10)
    assert list(slices(b"one two  three fourfivesix", 5)) == [b"one two", b" three", b"fourfivesix"]
    assert b" ".join(slices(b"a b c " * 50, 7)) == b"a b c " * 50


def best_fit_decreasing(lengths, window):
    """Item by item: the fullest sequence that has room, else a new one."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(window - n)
    return Counter(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 37, 100])
    lengths = [min(window, max(1, int(rng.gammavariate(1.2, window / 4)))) for _ in range(rng.randint(1, 400))]
    counts = Counter(lengths)
    segments, sequences = best_fit.plan(counts, window)
    room, placed = [window] * sequences, defaultdict(list)
    for length, n in counts.items():
        own = segments[segments[:, 0] == length]
        for rank in range(n):
            _, first, sequence, per, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            i = rank - first
            placed[sequence + i // per].append((offset + i % per * length, length))
            room[sequence + i // per] -= length
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(placed) == sequences and Counter(room) == best_fit_decreasing(lengths, window)


def test_plan_does_not_grow_with_documents():
    few = {n: 1 + 9 * n % 97 for n in range(1, 2049)}
    many = {n: c * 10**7 for n, c in few.items()}
    a, b = best_fit.plan(few), best_fit.plan(many)
    assert len(a[0]) < 20_000 and len(b[0]) < 20_000 and b[1] < 1.01 * a[1] * 10**7
    assert best_fit.plan({})[1] == 0


def test_pack(docs, rows, nothing, ids_of):
    window = 64
    out = best_fit.pack(docs, window).collect()
    want = Counter()
    for r in rows:
        ids = [*ids_of(r[1]), 0]
        for piece, at in enumerate(range(0, len(ids), window)):
            want[r[0], piece, at, len(ids[at : at + window]), crc(ids[at : at + window])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert len(held) == sum(best_fit_decreasing([r.length for r in out], window).values())
    assert best_fit.pack(nothing).count() == 0


def test_sequences(docs, rows, ids_of):
    window = 64
    made = best_fit.sequences(docs, window, pad_id=7).collect()
    pieces = Counter()
    for r in rows:
        ids = [*ids_of(r[1]), 0]
        for at in range(0, len(ids), window):
            pieces[tuple(ids[at : at + window])] += 1
    tokens = Counter(t for ids, n in pieces.items() for t in ids for _ in range(n))
    got = Counter()
    for r in made:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == window and set(ids[r.n_tokens :]) <= {7}
        got.update(ids[: r.n_tokens])
    assert got == tokens


def test_other_columns_and_ids(spark):
    rows = [("x", "one two", 1, "a"), (None, "three", 2, "b"), ("x", None, 3, "c")] * 3
    out = best_fit.pack(spark.createDataFrame(rows, "doc_id string, text string, piece int, `part` string"), 8).collect()
    assert len(out) == 9 and Counter(r.doc_id for r in out) == {"x": 6, None: 3}
