import re
from collections import defaultdict

from lodestone.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= over


def test_targets_and_mix(docs, rows):
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
        longest[r[3]] = max(longest[r[3]], size(r[1]))
    want = expected_targets(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((r[0] or -1, size(r[1])) for r in rows)
    by_id = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = defaultdict(int)
    for r in out:
        assert r.size == 0 and r.taken == 0 or r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        if r.doc_id is not None:
            s = by_id[r.doc_id]
            assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s]
            taken[s] += r.taken
    for s in taken:
        assert abs(taken[s] - want[s]) <= 2 * max(longest.values())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_runs_do_not_matter(docs, monkeypatch):
    before = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == before


def test_mixed_documents(docs, nothing):
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.text_key] = plan.get((r.doc_id, r.text_key), 0) + r.passes_taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() >= sum(plan.values()) > 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
