import hashlib
from collections import Counter

import pytest
from lodestone.llm import infill
from lodestone.llm.common import settings
from pyspark.sql import functions as F

MORE = ["a<P>b", "<S>", "x<M>", "<p> < P> <", "<<<<>>>>", "é" * 3000 + "x", "漢字" * 700, "\U0001f600" * 600 + "abc", "\x00\x01", "A" * 3000]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(b"1:" + str("" if doc_id is None else doc_id).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("text", ["", "a", "plain ascii " * 400, *MORE, "mixed é漢\U0001f600" * 900])
def test_boundaries(text):
    raw = text.encode()
    index = infill.Boundaries(infill.encode_boundaries(raw))
    assert index.n == len(text)
    for k in {*range(0, len(text) + 1, 37), len(text), len(text) // 2, *(i for i in (1023, 1024, 1025, 2047, 2048) if i <= len(text))}:
        assert index.select(k) == len(text[:k].encode())


def test_transform(spark, docs, rows, nothing):
    more = [(1000 + i, t) for i, t in enumerate(MORE * 8)] + [(2000 + i, "one hot text of many rows") for i in range(600)]
    table = docs.select("doc_id", "text", "part", "node").unionByName(spark.createDataFrame([(d, t, 1, "n") for d, t in more], "doc_id long, text string, part int, node string"))
    out = infill.transform(table).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    known = [(r[0], r[1]) for r in rows] + more
    assert Counter(tuple(r)[:6] for r in out) == Counter(brute(*r) for r in known)
    assert Counter((r.doc_id, r.again) for r in out) == Counter((d, t or "") for d, t in known)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.transform(nothing).count() == 0


def test_one_list_for_all_copies(spark):
    """Copies stand together, whatever the input's order: a text's list is made again only where its rows are dealt to groups."""
    texts = [f"text number {i} " * 20 for i in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40]) for i in range(4000)], "doc_id long, text string").repartition(7)
    grouped = infill._groups(docs).withColumn("p", F.spark_partition_id()).collect()
    changes = sum(a.text != b.text or a.p != b.p for a, b in zip(grouped, grouped[1:], strict=False)) + 1
    assert changes == 40
    hot = spark.createDataFrame([(i, "hot") for i in range(1000)] + [(-i, f"cold {i}") for i in range(100)], "doc_id long, text string")
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false"):
        parts = infill._groups(hot).filter("text = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1


def test_any_id(spark):
    docs = spark.createDataFrame([("x", "abcdef", 1), (None, "abcdef", 2), ("x", "ghi", 3), ("x", "ghi", 3)], "doc_id string, text string, n int")
    assert Counter(tuple(r) for r in infill.transform(docs).collect()) == Counter(brute(*r) for r in [("x", "abcdef"), (None, "abcdef"), ("x", "ghi"), ("x", "ghi")])
