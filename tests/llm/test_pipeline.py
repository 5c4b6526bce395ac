import corpus_pipeline
import pytest
from lodestone.llm import langid, minhash, mixing, packing
from lodestone.llm.queries import ORACLES, QUERIES


def test_stages_feed_each_other(spark, docs, small):
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, small)
        assert after.columns == at.columns, name
        path = f"{__import__('tempfile').mkdtemp()}/{name}"
        after.write.parquet(path)
        at = spark.read.parquet(path)
        counts.append(at.count())
    assert counts[1] <= counts[0] < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, small)
    assert last.agg({"length": "sum"}).first()[0] == packing.encode_stream(at).agg({"n": "sum"}).first()[0]


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = mixing.mixed_documents(minhash.one_of_each(langid.with_language(docs)))
    assert out.filter("start = 0").count() == kept.count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    # rows as they are, since data frames make numbers of nulls
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    assert columns == sorted(names)
    key = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=str)
    assert key(got.collect()) == key(want)


def test_run_by_brute_force(spark, small):
    """Every stage's decisions made anew without the operators: letters, all pairs of shingle sets, the mix's SQL, the tokenizer itself."""
    import re
    from collections import defaultdict

    import duckdb
    import pandas as pd
    import regex
    from lodestone.llm.queries import OP1_SQL
    from lodestone.llm.tokens import vocabulary_path
    from tokenizers import Tokenizer

    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [r for r in rows if r["text"] and regex.search(r"\p{L}", r["text"])]
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate({c: c + 32 for c in range(65, 91)})) for r in rows}
    sets = {d: set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} for d, w in words.items() if w}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [r for r in rows if r["doc_id"] not in sets or find(r["doc_id"]) == r["doc_id"]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    passes = {d: taken // size for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({OP1_SQL})").fetchall() if taken}
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = {r["doc_id"]: passes[r["doc_id"]] * (len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in rows if r["doc_id"] in passes}
    out = corpus_pipeline.run(spark, small).collect()
    got, of_sequence = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id] += r.length
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert dict(got) == want
    for s, pieces in of_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or s == max(of_sequence)
