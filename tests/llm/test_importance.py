import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import importance


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(rows, target, longest, least, percent):
    s, t = Counter(), Counter()
    for texts, counts in ((rows, s), (target, t)):
        for r in texts:
            counts.update(bucket(f) for f in features(r[1], longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for doc, text in rows:
        words, own = features(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, enough[: percent * len(enough) // 100]


@pytest.mark.parametrize("longest,least,percent", [(1, 20, 10), (3, 5, 35)])
def test_resample(spark, docs, rows, longest, least, percent, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    target = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:9])] + [(99, None)], "item_id long, text string")
    known = [(r[0], r[1]) for r in rows]
    want, drawn = brute(known, [(0, r[1]) for r in rows[:9]], longest, least, percent)
    out = importance.resample(docs, target, longest=longest, least_words=least, percent=percent).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == Counter(map(tuple, want))
    ranked = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) > 3
    assert [(r.doc_id, r.score) for r in ranked] == [(d[0], d[4]) for d in drawn]


def test_slices_and_memo_do_not_matter(monkeypatch):
    raw = ("Ünï word A1b2, 漢字 x" * 500).encode()
    whole = [np.sort(np.concatenate([f for _, f in importance._features(raw, k)])) for k in (1, 3)]
    monkeypatch.setattr(importance._Buckets, "MOST", 2)
    monkeypatch.setattr(importance, "slices", lambda text: __import__("lodestone.llm.common", fromlist=["slices"]).slices(text, 11))
    for k, want in zip((1, 3), whole, strict=True):
        parts = list(importance._features(raw, k))
        assert len(parts) > 50 and (np.sort(np.concatenate([f for _, f in parts])) == want).all()


def test_counts_are_merged_over_levels(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(importance, "FAN_IN", 2)
    want = np.zeros(10_000, np.int64)
    for r in rows:
        for f in features(r[1], 1)[1]:
            want[bucket(f)] += 1
    assert (importance.bucket_counts(docs.repartition(13)) == want).all()


def test_nothing_and_ties(spark, docs, nothing):
    target = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    assert importance.resample(docs, target, least_words=10**9).filter("rank IS NOT NULL").count() == 0
    same = spark.createDataFrame([(5, "a b c", "r")] * 40 + [(None, "a b c", "r")] * 10, "doc_id long, text string, rank string")
    out = importance.resample(same, target, least_words=1, percent=90).collect()
    assert sorted(r.rank for r in out if r.rank is not None) == list(range(1, 46))


def test_drawn_documents(spark, docs):
    target = spark.createDataFrame([(1, "word")], "item_id long, text string")
    clash = docs.withColumn("rank", docs.part).withColumn("doc", docs.node).withColumn("its_doc", docs.node)
    plan = importance.resample(clash, target, least_words=3, percent=50).filter("rank IS NOT NULL").collect()
    drawn = importance.drawn_documents(clash, target, least_words=3, percent=50)
    assert drawn.columns == clash.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in plan)
