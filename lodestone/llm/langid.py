"""Language mixtures of documents: expectation-maximisation over n-gram likelihoods, with a penalised choice of languages.

Training counts hashed byte trigrams of each language over all labelled documents. A document's trigrams are a mixture of
the languages; EM finds the proportions. The set of languages grows from the most likely one while the log-likelihood
gains more than the penalty for another language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from lodestone.llm.common import held_out_of, map_arrow, stash, utf8, whole_row

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Added to each count.
SMOOTHING = 0.5
ROUNDS = 8
#: Log-likelihood that another language must gain, in units of log(trigrams).
PENALTY = 2.0
#: A training task sends its counts on when it has read so many bytes.
FLUSH_BYTES = 256 << 20

_letter = regex.compile(r"\p{L}")
#: Letters of ASCII in lower case, other bytes of UTF-8 letters as they are, everything else a blank.
_fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, words parted by one blank."""
    folded = b" " + b" ".join(text.translate(_fold).split()) + b" "
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    codes = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    read = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
            read += len(text)
        if read >= FLUSH_BYTES:
            yield from out()
            read = 0
    yield from out()


def train(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their log-probabilities of the buckets, from all rows with a language where `training` holds."""
    labelled = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", utf8(F.col("text")).alias("text"))
    counts = map_arrow(labelled, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row a language and bucket
    found = counts.toArrow().to_pydict()
    langs = sorted(set(found["lang"]))
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    np.add.at(table, ([place[x] for x in found["lang"]], found["bucket"]), found["n"])
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def mixture(n: np.ndarray, logs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the rows of `logs` that explain the counts `n`, and the log-likelihood."""
    top = logs.max(axis=0)
    p = np.exp(logs - top)
    share = np.full(len(logs), 1 / len(logs))
    for _ in range(rounds):
        share = share * (p @ (n / (share @ p))) / n.sum()
    return share, float(n @ (np.log(share @ p) + top))


def choose(buckets: np.ndarray, logs: np.ndarray) -> tuple[int, float, list[tuple[int, float]]]:
    """The main language, its proportion, and all chosen languages with their proportions."""
    at, n = np.unique(buckets, return_counts=True)
    n, logs = n.astype(np.float64), logs[:, at]
    single = logs @ n
    order = [int(single.argmax())]
    chosen, best = [(order[0], 1.0)], single[order[0]]
    if len(logs) > 1:
        everything, _ = mixture(n, logs)
        order += [int(i) for i in np.argsort(-everything, kind="stable") if i != order[0]]
        penalty = PENALTY * np.log(n.sum() + 1)
        for k in range(2, len(order) + 1):
            share, likelihood = mixture(n, logs[order[:k]])
            if likelihood - best <= penalty:
                break
            chosen, best = list(zip(order[:k], share.tolist(), strict=True)), likelihood
    main = max(chosen, key=lambda c: (c[1], -c[0]))
    return main[0], min(1.0, max(0.0, main[1])), chosen


def _predict(langs: list[str], logs: np.ndarray, columns: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores, mixes = [], [], []
            for text in batch.column(columns - 1).to_pylist():
                if not text or not langs or not _letter.search(text.decode("utf-8", "replace")):
                    preds.append("und")
                    scores.append(0.0)
                    mixes.append([])
                    continue
                main, score, chosen = choose(trigrams(text), logs)
                preds.append(langs[main])
                scores.append(score)
                mixes.append([(langs[i], s) for i, s in chosen])
            rest = [batch.column(i) for i in range(columns - 1)]
            yield pa.record_batch([*rest, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))], names=[*batch.schema.names[:-1], "lang_pred", "score", "mixture"])

    return f


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep` and lang_pred, score, mixture, from the text alone."""
    langs, logs = model
    rows = docs.select(*keep, utf8(F.col("text")).alias("_text"))
    found = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", MapType(StringType(), DoubleType()))]
    return map_arrow(rows, _predict(langs, logs.astype(np.float32), len(keep) + 1), StructType([*rows.schema.fields[:-1], *found]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of every document.

    Learns from documents whose crc32(doc_id as text) modulo 3 isn't 1 (a null doc_id counts as empty text) and whose lang
    isn't null. Texts that are null or without a letter are 'und' with score 0, as is everything if nothing was learned.
    Equal texts get equal results, texts of any length are read whole, an empty table gives no rows.
    """
    held = held_out_of(3, 1)
    model = train(docs, ~held)
    return predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def with_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """`docs` whose language is known with a score of at least `least`.

    Null texts and texts without a letter go, repeated rows are judged alike, texts of any length are read whole, an empty
    table stays empty, and other columns stay whatever their names.
    """
    model = train(docs, ~held_out_of(3, 1))
    tagged = predict(docs.withColumn("_keep", whole_row(docs)), model, ["_keep"])
    return tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_keep.*")


__all__ = ["choose", "identify", "mixture", "predict", "stash", "train", "trigrams", "with_language"]
