import re

import numpy as np
from lodestone.llm import minhash
from pyspark.sql import functions as F


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(ws)} if len(ws) == 1 else set(zip(ws, ws[1:], strict=False))


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_against_brute_force(docs, rows, nothing):
    assert got(docs) == brute(rows)
    assert got(docs.repartition(1)) == brute(rows)
    assert minhash.near_duplicates(nothing).count() == 0


def test_hubs_are_dealt_to_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "RAYS", 1)
    assert got(docs) == brute(rows)


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)


def test_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    base = [words[i] for i in rng.integers(0, 5000, 100)]
    rows = []
    # a star whose rays are similar to the middle only, and a chain whose neighbours are
    for i in range(60):
        ws = list(base)
        for j in range(3):
            ws[(7 * i + 31 * j) % 100] = f"s{i}x{j}"
        rows.append((1000 - i, " ".join(ws)))
    rows.append((2000, " ".join(base)))
    ws = [words[i] for i in rng.integers(0, 5000, 100)]
    for i in range(80):
        ws = list(ws)
        ws[i] = f"c{i}"
        ws[99 - i] = f"d{i}"
        rows.append((3000 + i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_one_of_each(docs, rows):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(d, c) for d, n, c, k in brute(rows) if k and n}
    blank = sum(not shingle_set(r[1]) for r in rows)
    ids = [r.doc_id for r in kept.filter(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0).collect()]
    assert sorted(ids, key=str) == sorted((d for d, _ in want), key=str)
    assert kept.count() == len(ids) + blank


def test_one_of_each_where_rows_share_an_id(spark):
    rows = [(3, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "x y z w", "z"), (5, "X y Z w", "v"), (5, None, "n"), (5, "x y z w", "z"), (None, "p q r", "q"), (None, "P q r", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = [tuple(r) for r in minhash.one_of_each(docs).collect()]
    assert (3, "a b c d e f", "x") in kept and (5, "a b c d e f", "y") not in kept and (5, None, "n") in kept
    assert len([k for k in kept if k[0] == 5 and k[1] and k[1].lower() == "x y z w"]) == 1
    assert len([k for k in kept if k[0] is None]) == 1 and len(kept) == 4
    sets = [(r[0], frozenset(shingle_set(r[1]))) for r in kept if r[1]]
    assert len(sets) == len(set(sets))
