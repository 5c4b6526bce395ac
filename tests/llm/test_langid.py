import math
import zlib
from collections import Counter

import numpy as np
from lodestone.llm import langid
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out").toPandas()
    letters = out[out.lang_pred != "und"]
    assert (letters.lang_pred == letters.lang).mean() > 0.95 and len(letters) > 0.95 * len(out)
    assert out.score.between(0, 1).all()


def test_only_text_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, langid.identify(docs).select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, langid.identify(changed).select("doc_id", "lang_pred", "score").collect()))


def test_edges(docs, rows, nothing):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for doc in (200, 201, 202, 203):
        assert (by[doc].lang_pred, by[doc].score) == ("und", 0.0)
    assert by[204].lang_pred in ("en", "fr")
    assert langid.identify(nothing).count() == 0
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in out)


def test_mixture_of_two():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(langid.BUCKETS) * 0.02, 3) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    drawn = np.concatenate([rng.choice(langid.BUCKETS, 3000, p=p[0]), rng.choice(langid.BUCKETS, 1000, p=p[2])])
    main, score, chosen = langid.choose(drawn, np.log(p))
    assert main == 0 and abs(score - 0.75) < 0.05 and {c for c, _ in chosen} == {0, 2}
    assert langid.choose(rng.choice(langid.BUCKETS, 3000, p=p[1]), np.log(p))[2] == [(1, 1.0)]


def plain_trigrams(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    padded = b" " + b" ".join(folded.split()) + b" "
    found = Counter()
    for i in range(len(padded) - 2):
        code = padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]
        found[(code * 2654435761 % 2**32) >> 18] += 1
    return found


def plain_mixture(counts, tables):
    share = [1 / len(tables)] * len(tables)
    for _ in range(8):
        new = [0.0] * len(tables)
        for b, n in counts.items():
            part = [s * t[b] for s, t in zip(share, tables, strict=True)]
            for i, p in enumerate(part):
                new[i] += n * p / sum(part)
        share = [x / sum(counts.values()) for x in new]
    return share, sum(n * math.log(sum(s * t[b] for s, t in zip(share, tables, strict=True))) for b, n in counts.items())


def test_against_brute_force(spark, small):
    """Counts by dictionaries, mixtures by loops, languages added one by one while the likelihood gains enough."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(plain_trigrams(r.text))
    langs = sorted(counts)
    tables = []
    for lang in langs:
        total = sum(counts[lang].values()) + 0.5 * 2**14
        tables.append([(counts[lang][b] + 0.5) / total for b in range(2**14)])
    got = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    mixed = 0
    for r in [*docs[:40], *(d for d in docs if d.text is None or not any(c.isalpha() for c in d.text))]:
        found = got[r.doc_id]
        assert found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        own = plain_trigrams(r.text)
        single = [sum(n * math.log(t[b]) for b, n in own.items()) for t in tables]
        first = single.index(max(single))
        everything, _ = plain_mixture(own, tables)
        order = [first] + [i for i in sorted(range(len(langs)), key=lambda i: -everything[i]) if i != first]
        chosen, best = {langs[first]: 1.0}, single[first]
        for k in range(2, len(order) + 1):
            share, likelihood = plain_mixture(own, [tables[i] for i in order[:k]])
            if likelihood - best <= 2 * math.log(sum(own.values()) + 1):
                break
            chosen, best = {langs[i]: s for i, s in zip(order, share, strict=False)}, likelihood
        main = max(chosen, key=lambda c: (chosen[c], [-ord(x) for x in c]))
        assert found.lang_pred == main and abs(found.score - chosen[main]) < 1e-3
        assert found.mixture.keys() == chosen.keys()
        mixed += len(chosen) > 1
    assert len(langs) == 4
