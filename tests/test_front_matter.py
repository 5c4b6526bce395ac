import pytest
from lodestone.sources.front_matter import parse

ODD = {
    "plain: a: b\nurl: http://x.y/z # note\n": {"plain": "a: b", "url": "http://x.y/z"},
    "n: 007\nd: 2024-01-02\nt: true\nf: False\nnil: ~\nnone:\nempty: ''\n": {"n": "007", "d": "2024-01-02", "t": True, "f": False, "nil": None, "none": None, "empty": ""},
    "q: 'it''s # no comment'\ndq: \"a \\\"b\\\" \\u00e9 \\n\\x41\"\n": {"q": "it's # no comment", "dq": 'a "b" é \nA'},
    "tags: [a, 'b, c', \"d\", {x: 1, y: [2, 3]}, ]\n": {"tags": ["a", "b, c", "d", {"x": "1", "y": ["2", "3"]}]},
    "tags: [a,\n  b,\n  c]\nz: 1\n": {"tags": ["a", "b", "c"], "z": "1"},
    "list:\n- a\n- b\nother:\n  - c\n  -\n    k: v\n": {"list": ["a", "b"], "other": ["c", {"k": "v"}]},
    "people:\n  - name: x\n    roles: [r]\n  - name: y\n": {"people": [{"name": "x", "roles": ["r"]}, {"name": "y"}]},
    "deep:\n  one:\n    two: [1]\n    # said\n    three:\n      - - a\n        - b\n  end: 1\n": {"deep": {"one": {"two": ["1"], "three": [["a", "b"]]}, "end": "1"}},
    "lit: |\n  a\n    b\n\n  c\nfold: >\n  a\n  b\n\n  c\n   d\nkeep: |-\n  x\n\nz: 1\n": {"lit": "a\n  b\n\nc\n", "fold": "a b\nc\n d\n", "keep": "x", "z": "1"},
    "long: one\n  two\n  three\nquoted: \"one\n  two\"\nz: 1\n": {"long": "one two three", "quoted": "one two", "z": "1"},
    "\"a b\": 1\n'c:d': 2\n# all\n\n": {"a b": "1", "c:d": "2"},
    "": {},
}
BAD = ["a: [1, 2\n", 'a: "x\n', "a: 1\na: 2\n", "- a\n- b\n", "a: &x 1\n", "a: 'x' y\n", "\ta: 1\n", "a: 1\n   b: 2\n", "just text\n", 'a: "\\q"\n', "a: >5x\n  b\n"]


@pytest.mark.parametrize("text", ODD)
def test_odd_front_matter(text):
    assert parse(text) == ODD[text]


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises(ValueError):
        parse(text)
