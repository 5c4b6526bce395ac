"""Class-based bigram model: exchange clustering assigns words to classes; transitions and emissions give a smoothed score.

1. Words of all training documents are counted; those that stand LEAST times get numbers and are found by their hashes.
2. Documents are encoded: every other word stays with its count in the document and goes by a class of its ending.
3. Each turn counts the classes beside every numbered word over all training documents, and every such word is offered the
   class that raises the class bigrams' likelihood most. Words move at once; of the moves of a turn the share of greatest gain
   is taken that raises the likelihood most.
4. Class transitions are counted over all training documents, and every document is scored: its numbered words in place, the
   others by a join with the counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out_of, map_arrow, stash, task_number, utf8

#: A training word of so many tokens is exchanged between CLASSES classes; rarer ones go by their ending.
LEAST, CLASSES, ENDINGS = 5, 64, 16
#: Shares of a turn's moves, by gain, whose likelihoods are compared.
SHARES = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.008)
#: Words in a block, whose contexts meet in one task as a table of fixed size, and words that are offered classes at once.
BLOCK, WORDS = 4096, 512
#: Words that a worker remembers the codes of.
MEMO = 300_000
#: Turns at most; they end before where no share of the moves raises the likelihood, or by less than this part of what the first turn did.
ROUNDS, LEAST_GAIN = 8, 0.02
#: Smoothing of transitions (in units of the class distribution) and of emissions (added to each count).
ALPHA, BETA = 2.0, 0.5
#: Distinct words, and neighbours of words, that a task counts before it sends them on.
FLUSH, FLUSH_CONTEXTS = 400_000, 8_000_000

class _Codes(dict):
    """Codes of words. A word that isn't there gets a provisional one below PENDING, until all new words of a batch are looked up at once."""

    def __init__(self, of: tuple[int, int] = (0, 0)) -> None:
        super().__init__()
        self.of, self.new = of, []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = PENDING - len(self.new)
        self.new.append(word)
        return code


#: Codes of endings are above this.
PENDING = -1000
#: What this worker remembers, and of which numbers.
_codes = _Codes()


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() touches A-Z alone, and bytes.split() parts at exactly \\x20 and \\x09-\\x0D."""
    return (text or b"").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    docs = 0

    def out() -> pa.RecordBatch:
        # an empty word stands for the text ends
        return pa.record_batch([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), docs], pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
            docs += 1
        if len(counts) > FLUSH:
            yield out()
            counts.clear()
            docs = 0
    yield out()


def hashes(ws: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ws), np.uint64, len(ws)).view(np.int64)


class Numbers:
    """Numbers of words by their hashes; eight bytes a word, so that a task can hold millions."""

    def __init__(self, hashed: np.ndarray) -> None:
        order = np.argsort(hashed, kind="stable")
        self.sorted, self.number = hashed[order], order.astype(np.int32)

    def of(self, ws: list[bytes]) -> np.ndarray:
        """-1 for a word without a number."""
        if not ws or not len(self.sorted):
            return np.full(len(ws), -1, np.int32)
        h = hashes(ws)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.number[at], np.int32(-1))

    def codes(self, ws: list[bytes]) -> np.ndarray:
        """The number of each word, or -1 less its ending's. A word is looked up once while the worker remembers it, in whatever task."""
        global _codes
        of = (len(self.sorted), int(self.sorted.sum()))
        if of != _codes.of or len(_codes) > MEMO:
            _codes = _Codes(of)
        codes = np.fromiter(map(_codes.__getitem__, ws), np.int32, len(ws))
        new = _codes.new
        if new:
            found = np.array([i if i >= 0 else -1 - ending(w) for w, i in zip(new, self.of(new).tolist(), strict=True)], np.int32)
            _codes.update(zip(new, found.tolist(), strict=True))
            _codes.new = []
            late = codes <= PENDING
            codes[late] = found[PENDING - codes[late]]
        return codes


def _encode(numbers: Numbers):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = task_number() << 33, 0
        for batch in batches:
            texts = [words(t) for t in batch.column(2).to_pylist()]
            sizes = [len(ws) for ws in texts]
            of_all = numbers.codes(list(chain.from_iterable(texts)))
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            rest = np.flatnonzero(of_all < 0)
            rest_cuts = np.searchsorted(rest, cuts).tolist()
            ids, tails, counts = [], [], []
            for i, ws in enumerate(texts):
                begin = cuts[i]
                ids.append(of_all[begin : cuts[i + 1]].tobytes())
                c = Counter([ws[j - begin] for j in rest[rest_cuts[i] : rest_cuts[i + 1]].tolist()])
                tails.append(list(c))
                counts.append(list(c.values()))
            sizes = [n + 1 for n in sizes]
            n = len(ids)
            yield pa.record_batch(
                [pa.array(range(part + at, part + at + n), pa.int64()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))],
                names=["row", "doc_id", "held_out", "n_tokens", "ids", "tail", "tail_n"],
            )
            at += n

    return f


def _units(ids: bytes, exchange: int, endings: np.ndarray) -> np.ndarray:
    """Numbers of the exchanged words, then of endings, then of the text end; the text end stands before and after."""
    codes = np.frombuffer(ids, np.int32)
    end = exchange + ENDINGS
    out = np.full(len(codes) + 2, end, np.int64)
    by_ending = np.where(codes < 0, -1 - codes, endings[np.maximum(codes, 0)].astype(np.int64) if len(endings) else 0)
    out[1:-1] = np.where((codes >= 0) & (codes < exchange), codes, exchange + by_ending)
    return out


def _units_of_batch(column: pa.Array, exchange: int, endings: np.ndarray) -> np.ndarray:
    """The units of all texts of a batch in one row, with one text end before, between and after them: their bigrams are those of the texts."""
    texts = column.to_pylist()
    codes = np.frombuffer(b"".join(texts), np.int32)
    end = exchange + ENDINGS
    out = np.full(len(codes) + len(texts) + 1, end, np.int32)
    by_ending = np.where(codes < 0, -1 - codes, endings[np.maximum(codes, 0)].astype(np.int32) if len(endings) else 0)
    at = np.arange(1, len(codes) + 1) + np.repeat(np.arange(len(texts)), [len(t) // 4 for t in texts])
    out[at] = np.where((codes >= 0) & (codes < exchange), codes, exchange + by_ending)
    return out


def _pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes by their differences and counts, compressed byte by byte of their places."""
    both = np.concatenate([np.diff(codes, prepend=0), counts]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def _contexts(exchange: int, endings: np.ndarray, class_of: np.ndarray, k: int):
    """(block, packed): of each word of a block, tokens by class before it, by class after it, and its bigrams with itself."""
    width = 2 * k + 1

    # sorting is what this costs, and half as wide codes sort several times as fast
    kind = np.int32 if exchange * width < 1 << 31 else np.int64

    def packed(seen: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(seen), return_counts=True)
        codes = codes.astype(np.int64)
        blocks = np.arange(-(-exchange // BLOCK) + 1)
        cuts = np.searchsorted(codes, blocks * BLOCK * width)
        out = [(b, _pack(codes[lo:hi] - b * BLOCK * width, n[lo:hi])) for b, lo, hi in zip(blocks[:-1].tolist(), cuts[:-1], cuts[1:], strict=True) if hi > lo]
        return pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "packed"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            u = _units_of_batch(batch.column(0), exchange, endings)
            c = class_of[u].astype(kind)
            u = u.astype(kind)
            a, b = u[:-1], u[1:]
            moves_a, moves_b = a < exchange, b < exchange
            own = a[(a == b) & moves_a]
            seen += [b[moves_b] * width + c[:-1][moves_b], a[moves_a] * width + k + c[1:][moves_a], own * width + 2 * k]
            held += 2 * len(a)
            if held > FLUSH_CONTEXTS:
                yield packed(seen)
                seen, held = [], 0
        if seen:
            yield packed(seen)

    return f


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams: sum n log n over cells, less the same over the rows' and columns' sums."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def best_class(m: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, twice: float, classes: int) -> tuple[int, float]:
    """The class below `classes` that a word is best moved to, and what that gains.

    left[c], right[c]: bigrams of class c before, after the word; twice: bigrams of the word with itself.
    """
    k, n = classes, len(m)
    l, r = left.astype(np.float64).copy(), right.astype(np.float64).copy()
    l[own] -= twice
    r[own] -= twice
    # the table without the word, at the columns after it and the rows before it; other cells are the same wherever it goes
    after, before = np.flatnonzero(r), np.flatnonzero(l)
    columns_of = m[:, after].astype(np.float64)
    columns_of[own] -= right[after]
    columns_of[:, after == own] -= left[:, None]
    columns_of[own, after == own] += twice
    rows_of = m[before].astype(np.float64)
    rows_of[:, own] -= left[before]
    rows_of[before == own] -= right
    rows_of[before == own, own] += twice
    # wherever the word goes, rows keep what stands before it and columns what stands after it
    rows, columns = m.sum(axis=1).astype(np.float64), m.sum(axis=0).astype(np.float64)
    rows[own] -= right.sum()
    columns[own] -= left.sum()
    gain_row = (_xlogx(columns_of[:k] + r[after]) - _xlogx(columns_of[:k])).sum(axis=1)
    gain_column = (_xlogx(rows_of[:, :k] + l[before, None]) - _xlogx(rows_of[:, :k])).sum(axis=0)
    diagonal = np.arange(n)
    d = m[diagonal, diagonal].astype(np.float64)
    d[own] += twice - left[own] - right[own]
    d = d[:k]
    once = _xlogx(d + r[:k]) + _xlogx(d + l[:k]) - 2 * _xlogx(d)
    whole = _xlogx(d + r[:k] + l[:k] + twice) - _xlogx(d)
    n_right, n_left = r.sum() + twice, l.sum() + twice
    sums = _xlogx(rows[:k] + n_right) - _xlogx(rows[:k]) + _xlogx(columns[:k] + n_left) - _xlogx(columns[:k])
    score = gain_row + gain_column - once + whole - sums
    best = int(score.argmax())
    return best, float(score[best] - score[own])


def best_classes(m: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """`best_class` of many words at once: left and right (words, classes of the table), own and twice (words,)."""
    n, k = len(own), classes
    if not n:
        return own.astype(np.int64), np.zeros(0)
    at = np.arange(n)
    l, r = left.copy(), right.copy()
    l[at, own] -= twice
    r[at, own] -= twice

    def gains(others: np.ndarray, table: np.ndarray, whole: np.ndarray, back: np.ndarray) -> np.ndarray:
        """What a word's bigrams with other classes add, by class it might go to; the table without the word."""
        w, c = np.nonzero(others)
        cells = table[c, :k].astype(np.float64)
        before = _plogp(table[:, :k].astype(np.float64))[c]
        # only the own class's cells are other than the table's
        to_own = c == own[w]
        cells[to_own] -= back[w[to_own], :k]
        e = np.arange(len(w))
        cells[e, own[w]] -= whole[w, c]
        cells[e[to_own], own[w[to_own]]] += twice[w[to_own]]
        before[to_own] = _plogp(cells[to_own])
        before[e, own[w]] = _plogp(cells[e, own[w]])
        cells += others[w, c][:, None]
        each = _plogp(cells)
        each -= before
        out = np.zeros((n, k))
        some = np.flatnonzero(np.bincount(w, minlength=n))
        if len(some):
            out[some] = np.add.reduceat(each, np.searchsorted(w, some), axis=0)
        return out

    score = gains(r, m.T, right, left) + gains(l, m, left, right)
    d = np.repeat(np.diagonal(m)[None, :k].astype(np.float64), n, axis=0)
    d[at, own] += twice - left[at, own] - right[at, own]
    lk, rk = l[:, :k], r[:, :k]
    of_d = _plogp(d)
    score += 2 * of_d - _plogp(d + rk) - _plogp(d + lk) + _plogp(d + rk + lk + twice[:, None]) - of_d
    for sums, part in ((m.sum(axis=1), right.sum(axis=1)), (m.sum(axis=0), left.sum(axis=1))):
        x = np.repeat(sums[None, :k].astype(np.float64), n, axis=0)
        x[at, own] -= part
        score -= _plogp(x + part[:, None]) - _plogp(x)
    best = score.argmax(axis=1)
    return best, score[at, best] - score[at, own]


def _plogp(x: np.ndarray) -> np.ndarray:
    """x log x of whole numbers from 0."""
    return x * np.log(np.maximum(x, 1))


def _exchange(class_of: np.ndarray, m: np.ndarray, exchange: int, classes: int):
    def f(group: pd.DataFrame) -> pd.DataFrame:
        k = len(m)
        first = int(group["block"].iloc[0]) * BLOCK
        table = np.zeros(min(BLOCK, exchange - first) * (2 * k + 1))
        for packed in group["packed"]:
            codes, n = _unpack(packed)
            table[codes] += n
        table = table.reshape(-1, 2 * k + 1)
        out = []
        for lo in range(0, len(table), WORDS):
            some = table[lo : lo + WORDS]
            words = np.arange(first + lo, first + lo + len(some))
            own = class_of[words].astype(np.int64)
            to, gain = best_classes(m, own, some[:, :k], some[:, k:-1], some[:, -1], classes)
            moves = (to != own) & (gain > 1e-6)
            out.append(pd.DataFrame({"word": words[moves], "to": to[moves], "gain": gain[moves]}))
        return pd.concat(out).astype({"word": "int32", "to": "int32", "gain": "float64"})

    return f


def _tables(trained: DataFrame, exchange: int, endings: np.ndarray, classes_of: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The class bigrams of all training documents under each of the assignments."""
    out = [np.zeros((k, k)) for _ in classes_of]
    found = map_arrow(trained, _transitions(exchange, endings, classes_of, k), "which int, left int, right int, n long").groupBy("which", "left", "right").agg(F.sum("n").alias("n")).collect()
    for r in found:
        out[r["which"]][r["left"], r["right"]] = r["n"]
    return out


def cluster(trained: DataFrame, head_counts: np.ndarray, exchange: int, endings: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (below `classes` for words, then one for each ending, then one for the text end) and the class bigrams."""
    k = classes + ENDINGS + 1
    # a byte a word, as the driver and every task hold several of these
    class_of = np.concatenate([np.zeros(exchange, np.int64), np.arange(classes, k)]).astype(np.uint8 if k <= 256 else np.int32)
    class_of[np.argsort(-head_counts[:exchange], kind="stable")] = np.arange(exchange) % classes
    m = _tables(trained, exchange, endings, [class_of], k)[0]
    blocks = -(-exchange // BLOCK)
    of_first = None
    for _ in range(rounds if exchange else 0):
        around = map_arrow(trained, _contexts(exchange, endings, class_of, k), "block int, packed binary").repartition(blocks, "block")
        moves = around.groupBy("block").applyInPandas(_exchange(class_of, m, exchange, classes), "word int, to int, gain double").toArrow()
        if not moves.num_rows:
            break
        word, to, gain = (moves.column(c).to_numpy() for c in ("word", "to", "gain"))
        order = np.lexsort((word, -gain))
        word, to = word[order], to[order]
        tried = []
        for n in sorted({max(1, int(len(word) * share)) for share in SHARES}):
            moved = class_of.copy()
            moved[word[:n]] = to[:n]
            tried.append(moved)
        # words move at once, each as if alone, so that a part of the moves may be better than all
        tables = _tables(trained, exchange, endings, tried, k)
        best = max(range(len(tried)), key=lambda i: likelihood(tables[i]))
        rise = likelihood(tables[best]) - likelihood(m)
        if rise <= 0:
            break
        class_of, m = tried[best], tables[best]
        of_first = of_first or rise
        if rise < LEAST_GAIN * of_first:
            break
    return class_of, m


def _transitions(exchange: int, endings: np.ndarray, classes_of: list[np.ndarray], k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(classes_of), k * k), np.int64)
        for batch in batches:
            u = _units_of_batch(batch.column(0), exchange, endings)
            for which, class_of in enumerate(classes_of):
                c = class_of[u].astype(np.int32)
                total[which] += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        which, at = np.nonzero(total)
        yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[which, at])], names=["which", "left", "right", "n"])

    return f


def _classes_of_words(numbers: Numbers, exchange: int, class_of: np.ndarray, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k, np.int64)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            units = np.array([i if 0 <= i < exchange else exchange + ending(w) for w, i in zip(ws, numbers.of(ws).tolist(), strict=True)], np.int64)
            n += np.bincount(class_of[units], minlength=k)
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(n)], names=["cls", "n"])

    return f


def _score(head_counts: np.ndarray, endings: np.ndarray, exchange: int, class_of: np.ndarray, steps: np.ndarray, emit: np.ndarray, ends: int, bottom: float):
    """emit: log10 of the denominator of each class; the end's class always emits the end."""
    known = np.log10(head_counts + 1.0) - bottom
    units = np.where(np.arange(len(head_counts)) < exchange, np.arange(len(head_counts)), exchange + endings.astype(np.int64)) if len(head_counts) else np.empty(0, np.int64)
    of_head = np.log10(head_counts + BETA) - emit[class_of[units]] if len(head_counts) else np.empty(0)
    end_base = np.log10(ends + 1.0) - bottom

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, own, hits = [], [], []
            for ids in batch.column(3).to_pylist():
                codes = np.frombuffer(ids, np.int32)
                c = class_of[_units(ids, exchange, endings)]
                head = codes[codes >= 0]
                tail_classes = class_of[exchange + (-1 - codes[codes < 0])]
                base.append(float(known[head].sum() + end_base))
                own.append(float(steps[c[:-1], c[1:]].sum() + of_head[head].sum() - emit[tail_classes].sum()))
                hits.append(len(head) + (ends > 0))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(hits, pa.int64()), pa.array(base), pa.array(own)], names=["row", "doc_id", "held_out", "n_tokens", "known_here", "base_here", "own_here"])

    return f


def score_documents(docs: DataFrame, head: int | None = None, exchange: int | None = None, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Trains on documents whose crc32(doc_id as text) modulo 7 isn't 2; a null doc_id counts as empty text and a null text as
    empty, which is one token, the end. Texts of any length are scored whole, an empty table gives no rows, and only doc_id, of
    any type, and text are read. Equal rows are documents of their own. Scores are log10; score is that of the class
    model, whose probabilities of the next token sum to 1 over the training words, the end and one unknown word a class.
    Every training word of LEAST tokens is exchanged; `head` and `exchange` bound the numbered and the exchanged words, the most frequent first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", held_out_of(7, 2).alias("held_out"), utf8(F.col("text")).alias("text"))
    counts = stash(map_arrow(docs.filter("not held_out").select("text"), _count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0"), "brown-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (counts.filter(F.length("word") == 0).agg(F.sum("c")).first()[0]) or 0
    bottom = float(np.log10(total + 1.0 * (distinct + 1)))
    # three numbers for each word of LEAST tokens come to the driver, no text
    top = counts.filter((F.length("word") > 0) & (F.col("c") >= LEAST)).select(F.xxhash64("word").alias("h"), "c", F.expr(f"crc32(substring(word, greatest(length(word) - 2, 1), 3)) % {ENDINGS}").alias("ending")).toArrow()
    hashed, head_counts, endings = (top.column(x).to_numpy() for x in ("h", "c", "ending"))
    del top
    order = np.lexsort((hashed, -head_counts))[:head]
    exchange = len(order) if exchange is None else min(exchange, len(order))
    # exchanged words by hash, so that a block of them holds frequent and rare ones alike
    order = np.concatenate([order[:exchange][np.argsort(hashed[order[:exchange]])], order[exchange:]])
    hashed, head_counts, endings = hashed[order], head_counts[order], endings[order].astype(np.uint8)
    number = Numbers(hashed)

    coded = map_arrow(docs, _encode(number), f"row long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, tail array<binary>, tail_n array<int>")
    coded = stash(coded, "brown-coded")
    trained = coded.filter("not held_out").select("ids")
    k = classes + ENDINGS + 1
    class_of, steps = cluster(trained, head_counts, exchange, endings, classes, rounds)
    of_class = steps.sum(axis=0)
    share = (of_class + 1) / (of_class.sum() + k)
    log_steps = np.log10((steps + ALPHA * share) / (steps.sum(axis=1, keepdims=True) + ALPHA))
    n_words = np.zeros(k)
    for r in map_arrow(counts.filter(F.length("word") > 0).select("word"), _classes_of_words(number, exchange, class_of, k), "cls int, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        n_words[r["cls"]] = r["n"]
    emit = np.log10(of_class + BETA * (n_words + 1))

    here = map_arrow(coded.select("row", "doc_id", "held_out", "ids", "n_tokens"), _score(head_counts, endings, exchange, class_of, log_steps, emit, ends, bottom), f"row long, doc_id {kind}, held_out boolean, n_tokens long, known_here long, base_here double, own_here double")
    tail = coded.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    seen = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_tail = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_there"), F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - bottom)).alias("base_there"), F.sum(F.col("n") * F.log10(F.col("c") + BETA)).alias("own_there")
    )
    return here.join(of_tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_here") + F.coalesce("known_there", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_here") + F.coalesce("base_there", F.lit(0.0))).alias("base_score"), (F.col("own_here") + F.coalesce("own_there", F.lit(0.0))).alias("score"),
    )
