"""Notes of a folder through the data source."""

import os

import pytest
from lodestone.sources import files, note_folder

NOTE = "---\nid: {id}\nkind: {kind}\ntitle: {title}\ncreated: 2024-01-02\n{more}---\n\nbody of {id}\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")

    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())

    for i in range(30):
        put(f"memory/m{i}.md", NOTE.format(id=f"m{i}", kind="memory", title=f"t{i}", more="tags: [a, 'b, c']\n"))
    put("proj/decisions/d1.md", NOTE.format(id="d1", kind="decision", title="'it''s'", more="status: accepted\nrelates:\n- x\n- y\nscore: 07\nnested:\n  a: [1]\n"))
    put("people/p.md", NOTE.format(id="p", kind="person", title=">-\n  two\n  lines", more='name: "A \\"B\\""\n').replace("\n", "\r\n"))
    put("memory/INDEX.md", "# no note")
    put("staging/memory/s.md", NOTE.format(id="s", kind="memory", title="s", more=""))
    put("memory/bad.md", "---\nid: [\n---\nx")
    put("memory/none.md", "no front")
    put("memory/bytes.md", b"\xff\xfe")
    put("memory/date.md", NOTE.format(id="dt", kind="memory", title="x", more="updated: soon\n"))
    return str(root)


def test_rows(spark, folder):
    rows = {r.path: r for r in note_folder.read_note_folder(spark, folder).collect()}
    assert len(rows) == 36 and "staging/memory/s.md" not in rows and "memory/INDEX.md" not in rows
    m = rows["memory/m3.md"]
    assert (m.id, m.kind, m.title, m.status, m.tags, m.error, m.body) == ("m3", "memory", "t3", "active", ["a", "b, c"], None, "body of m3")
    d = rows["proj/decisions/d1.md"]
    assert (d.title, d.status, d.relates, d.extra) == ("it's", "accepted", ["x", "y"], {"score": "07", "nested": '{"a":["1"]}'})
    assert (rows["people/p.md"].title, rows["people/p.md"].name) == ("two lines", 'A "B"')
    errors = {p: r.error for p, r in rows.items() if r.error}
    assert errors == {"memory/bad.md": "front matter: quotes or brackets are open", "memory/none.md": "no front matter", "memory/bytes.md": "not read: UnicodeDecodeError", "memory/date.md": "updated"}


def test_one_kind_opens_no_other_folder(spark, folder):
    reader = note_folder.NoteReader(folder, (), 1 << 20)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    rest = list(reader.pushFilters([EqualTo(("kind_folder",), "decisions"), IsNotNull(("kind_folder",)), EqualTo(("front",), "x")]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    assert [p for part in reader.partitions() for p in part.paths] == ["proj/decisions/d1.md"]
    assert sorted(reader.listed) == ["", "proj", "proj/decisions"]
    point = note_folder.NoteReader(folder, (), 1 << 20)
    assert list(point.pushFilters([In(("path",), ("memory/m1.md", "../x/memory/y.md", "memory/INDEX.md", "memory/gone.md"))])) == []
    assert [p for part in point.partitions() for p in part.paths] == ["memory/m1.md"] and point.listed == []
    found = note_folder.read_note_folder(spark, folder).filter("kind_folder = 'decisions'")
    assert [r.id for r in found.select("id").collect()] == ["d1"]
    assert [r.id for r in note_folder.read_note_folder(spark, folder).filter("path = 'memory/m5.md'").select("id").collect()] == ["m5"]


def test_partitions_by_bytes(folder):
    parts = note_folder.NoteReader(folder, (), 5 * note_folder.OPEN_BYTES).partitions()
    assert len(parts) >= 8 and sorted(p for part in parts for p in part.paths) == sorted(set(p for part in parts for p in part.paths))


def test_as_the_plain_reader(spark, folder):
    plain = files.parse_notes(files.note_texts(spark, folder)).filter("error IS NULL AND kind = 'memory'").select("path", "id", "title", "status", "body").collect()
    assert len(plain) == 30 and os.path.isdir(folder)
    mine = note_folder.read_note_folder(spark, folder).filter("error IS NULL AND kind = 'memory'").select("path", "id", "title", "status", "body").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, mine))
