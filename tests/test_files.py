"""Readers of a knowledge base's files, against hand-written files, and the round trip of notes."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files


@pytest.fixture()
def brain(tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text, encoding="utf-8", newline="")

    put("memory/a.md", "---\nid: a\nkind: memory\ntitle: 'Uses: the cache'\ntags: [x, \"y z\"]\ncreated: 2024-01-02\ngraduate: true\ncustom: kept\n---\n\nBody — é\n\n---\nmore\n")
    put("proj/decisions/b.md", "---\r\nid: b\r\nkind: decision\r\ntitle: B\r\ncreated: 2024-01-03\r\nrelates:\r\n  - '[[a]]'\r\n  - c\r\nstatus: accepted\r\n---\r\ntext\r\n")
    put("people/p.md", "---\nid: p\nkind: person\ntitle: P\nname: Pat\nemail: nope\ncreated: 2024-01-03\n---\n")
    put("people/q.md", "---\nid: q\nkind: person\ntitle: Q\nname: Q\ncreated: 2024-01-03\n---\n")
    put("memory/bad.md", "no fence")
    put("memory/date.md", "---\nid: d\nkind: memory\ntitle: D\ncreated: 2024-13-01\n---\n")
    put("memory/state.md", "---\nid: s\nkind: memory\ntitle: S\nstatus: odd\ncreated: 2024-01-01\n---\n")
    put("memory/INDEX.md", "---\nid: i\nkind: memory\ntitle: I\ncreated: 2024-01-01\n---\n")
    put("staging/memory/z.md", "---\nid: z\nkind: memory\ntitle: Z\ncreated: 2024-01-01\n---\n")
    put("top.md", "---\nid: t\nkind: memory\ntitle: T\ncreated: 2024-01-01\n---\n")
    return tmp_path


def test_notes_are_found_and_checked(spark, brain):
    rows = {r.path: r for r in files.parse_notes(files.note_texts(spark, str(brain))).collect()}
    assert {p: r.error for p, r in rows.items()} == {
        "memory/a.md": None, "proj/decisions/b.md": None, "people/p.md": "email", "people/q.md": None, "memory/bad.md": "no front matter", "memory/date.md": "created", "memory/state.md": "status",
    }
    a, b = rows["memory/a.md"], rows["proj/decisions/b.md"]
    assert (a.id, a.title, a.tags, a.status, a.graduate, a.extra, a.body) == ("a", "Uses: the cache", ["x", "y z"], "active", True, {"custom": "kept"}, "Body — é\n\n---\nmore")
    assert (b.relates, b.status, b.tags, b.body) == (["[[a]]", "c"], "accepted", [], "text")
    assert [r.id for r in files.read_notes(spark, str(brain), "decision").collect()] == ["b"]


def test_notes_survive_a_round_trip(spark, brain):
    notes = files.read_notes(spark, str(brain))
    again = files.parse_notes(files.render_notes(notes))
    columns = [c for c in notes.columns if c not in ("extra", "error")]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(again) == key(notes)
    assert again.filter("error IS NOT NULL").count() == 0


def test_capture_log_skips_what_is_no_entry(spark, tmp_path):
    lines = [json.dumps({"ts": 5, "outcome": "ok", "staged": 2, "verdicts": {"distinct": 1}}), "{broken", "", json.dumps({"ts": 6}), json.dumps({"outcome": 7}), "[1]", json.dumps({"outcome": "failed", "timedOut": True, "new": 1})]
    (tmp_path / "log").write_text("\n".join(lines))
    got = sorted(((r.ts, r.outcome, r.staged, r.verdicts, r.timedOut) for r in files.read_capture_log(spark, str(tmp_path / "log")).collect()), key=str)
    assert got == [(5, "ok", 2, {"distinct": 1}, None), (None, "failed", None, None, True)]


def test_maps_rules_and_tombstones(spark, tmp_path):
    text = lambda value: spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "text string")
    aliases = files.read_alias_map(text({"p": {"customer": "C", "sources": ["s", "", 1, None]}, "q": {"sources": "s"}, "r": 5, "": {"sources": []}}))
    assert sorted((r.project, r.customer, r.sources) for r in aliases.collect()) == [("p", "C", ["s"]), ("q", None, [])]
    assert files.read_alias_map(text("[1")).count() == 0
    rules = files.read_rules(text({"rules": [{"repo": "a/b", "brain": "x"}, {"brain": "x"}, {"prefix": "/p", "deny": True, "origin": "shared", "sharedFrom": "z"}, None, {"org": ""}]}))
    assert [(r.ord, r.repo, r.prefix, r.brain, r.deny, r.origin, r.shared_from) for r in rules.orderBy("ord").collect()] == [(0, "a/b", None, "x", False, "local", None), (2, None, "/p", None, True, "shared", "z")]
    for name, body in (("k1.json", '{"refs": ["a", "b"], "title": "T", "kind": "memory"}'), ("k2.json", "{}"), ("k3.json", "oops"), ("k4.txt", "{}")):
        (tmp_path / name).write_text(body)
    assert [(r.cluster_key, r.refs, r.title) for r in files.read_tombstones(spark, str(tmp_path)).collect()] == [("k1", ["a", "b"], "T")]


def test_transcripts_of_both_dialects(spark):
    one = [
        {"type": "user", "message": {"role": "user", "content": "hello"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls"}, {"type": "odd"}]}},
        {"message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "x" * 500}]}]}}, {"role": "user", "content": "[bare] [1]"}, {"type": "summary"},
    ]
    two = [
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "event_msg", "payload": {"type": "message", "role": "user", "content": "q"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "response_item", "payload": {"type": "function_call", "name": "sh"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "done"}}, {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "response_item", "payload": {"type": "message", "role": "system", "content": "no"}},
    ]
    rows = [(1, i, json.dumps(x)) for i, x in enumerate(one)] + [(1, 99, "{oops")] + [(2, i, json.dumps(x)) for i, x in enumerate(two)]
    found = files.transcript_lines(spark.createDataFrame(rows, "conv_id long, line_no long, json string")).orderBy("conv_id", "line_no", "block_no").collect()
    assert [r.line for r in found if r.conv_id == 1] == ["user: hello", "assistant: hi", "assistant [tool_use: ls]", "[tool_result] " + "x" * 400, "user: [bare] [1]"]
    assert [r.line for r in found if r.conv_id == 2 and r.dialect == "response"] == ["user: q", "assistant [tool_use: sh]", "[tool_result] done"]


def test_decision_records(spark, tmp_path):
    folder = tmp_path / "docs" / "adr"
    folder.mkdir(parents=True)
    for name, body in (("0001-a.md", "x\n# Use Spark \n\ntext"), ("0002-b.MD", "no heading"), ("README.md", "# no"), ("index.md", "# no")):
        (folder / name).write_text(body)
    got = files.read_decision_records(spark, str(tmp_path)).orderBy(F.col("file")).collect()
    assert [(r.file, r.title, r.kind) for r in got] == [("0001-a.md", "Use Spark", "decision"), ("0002-b.MD", "0002-b", "decision")]


def test_a_filter_on_errors_reads_each_field_once(spark):
    """The front matter is cut from a text once or twice, however often the conditions of `error` name its fields."""
    texts = spark.createDataFrame([("memory/a.md", "---\nid: a\nkind: memory\ntitle: t\ncreated: 2024-01-02\n---\nx\n"), ("memory/b.md", "---\nid: b\nkind: odd\n---\nx\n"), ("memory/c.md", "c")], "path string, text string")
    failed = files.parse_notes(texts).filter("error IS NOT NULL").select("path", "error")
    assert sorted(map(tuple, failed.collect())) == [("memory/b.md", "kind"), ("memory/c.md", "no front matter")]
    plan = failed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(text") <= 2 and plan.count("kind:") <= 8
