"""Operators that keep whole rows, on columns of awkward names and rows that come twice."""

from collections import Counter

from lodestone.llm import langid, licenses, minhash, mixing, packing, sharding, telephony, token_output

NAMES = ["row", "ids", "size", "doc", "_keep", "a.b", "x`y", "its_doc", "unit", "taken", "part", "node"]


def awkward(spark):
    texts = ["one two three four five", "un deux trois quatre cinq", None, "", "one two three four five", "six seven eight nine ten words more", "1234"]
    rows = [(i, t, "en" if i % 2 else "fr", "s" if i % 3 else None, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts * 3)]
    rows += [rows[0], rows[0], rows[1]]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3), rows


def test_whole_rows_are_kept(spark):
    docs, rows = awkward(spark)
    every = {tuple(r) for r in rows}
    for out in (langid.with_language(docs), mixing.mixed_documents(docs), minhash.one_of_each(docs)):
        assert out.columns == docs.columns
        found = [tuple(r) for r in out.collect()]
        assert found and set(found) <= every
    assert all(r[1] and not r[1].isdigit() for r in langid.with_language(docs).collect())


def test_the_mix_is_as_long_as_the_plan(spark):
    docs, rows = awkward(spark)
    plan = mixing.mix(docs).collect()
    mixed = [tuple(r)[:2] for r in mixing.mixed_documents(docs).collect()]
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.passes_taken
    assert Counter(d for d, _ in mixed) == +want


def test_queue_is_cut_in_ranges_again(spark, monkeypatch):
    docs, _ = awkward(spark)
    whole = sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "RUN_ROWS", 2)
    monkeypatch.setattr(mixing, "MOST_PARTS", 2)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == whole


def test_others_read_what_they_name(spark):
    docs, rows = awkward(spark)
    n = len(rows)
    assert sharding.shard(docs).count() == licenses.scan_licenses(docs).count() == n
    assert telephony.store_and_inspect(docs).count() == token_output.token_output(docs).count() == n
    assert langid.identify(docs).count() == minhash.near_duplicates(docs).count() == n
    assert packing.pack(docs).count() >= n


def test_heavy_units_are_placed_alike(spark, monkeypatch):
    rows = [(i, None if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs).collect()}
    monkeypatch.setattr(sharding, "HEAVY", 1)
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs).collect()}
    assert a == b and len(a) == 3000
