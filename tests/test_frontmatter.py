"""Leading blocks as real files have them, broken ones included."""

import random

import pytest

from tessella.functions.yaml_block import Day, read_block
from tessella.operators import frontmatter as FM
from tessella.operators import pages

CASES = {
    "": {}, "# only a note": {}, "a: 1\nb: two # note\nc: 'it''s'\nd: \"x\\ty\\u00e9\\\"\"": {"a": 1, "b": "two", "c": "it's", "d": 'x\tyé"'},
    "a: |\n  one\n    two\n\n  three\nb: x": {"a": "one\n  two\n\nthree\n", "b": "x"}, "a: >-\n  one\n  two\n\n  three": {"a": "one two\nthree"}, "a: |+\n  x\n\n": {"a": "x\n\n\n"},
    "a: |2\n   x": {"a": " x\n"}, "a: >": {"a": ""}, "a:\n- x\n- y: 1\n  z: 2\n-\n- - n\n  - m": {"a": ["x", {"y": 1, "z": 2}, None, ["n", "m"]]}, "a:\n  - 'x # y'\n  - [1, {b: c}]": {"a": ["x # y", [1, {"b": "c"}]]},
    "a: {b: 1, 'c d': [x, y], e}": {"a": {"b": 1, "c d": ["x", "y"], "e": None}}, "a: [x,\n  y,  # note\n  z]\nb: 1": {"a": ["x", "y", "z"], "b": 1}, "a: \"two\n  lines\"": {"a": "two lines"},
    "'a b': 1\n\"c:d\": 2\ne f: 3": {"a b": 1, "c:d": 2, "e f": 3}, "u: http://h/p#q\nt: 12:30": {"u": "http://h/p#q", "t": "12:30"}, "a: plain\n  goes on": {"a": "plain goes on"}, "a: ~\nb: null\nc:\nd: True": {"a": None, "b": None, "c": None, "d": True},
    "a: 0x1F\nb: 1_000\nc: -1.5e3\nd: .5\ne: 1.\nf: '1'": {"a": 31, "b": 1000, "c": -1500.0, "d": 0.5, "e": 1.0, "f": "1"}, "a:\r\n  b:\r\n    c: 1\r\n  d: 2": {"a": {"b": {"c": 1}, "d": 2}}, "k: -x\nl: - y": {"k": "-x", "l": "- y"},
}


@pytest.mark.parametrize("text", list(CASES))
def test_block(text):
    assert read_block(text) == (CASES[text], [])


def test_days_are_no_strings():
    data, _ = read_block("a: 2024-01-31\nb: '2024-01-31'\nc: 2024-01-31T10:00:00Z")
    assert [type(data[k]) for k in "abc"] == [Day, str, Day]


def test_what_is_not_understood_is_named_and_nothing_raises():
    for text, known in (("a: 1\na: 2", {"a": 1}), ("a: [1", {"a": None}), ("- x", {}), ("text", {}), ("a: 1\nnonsense\nb: 2", {"a": 1, "b": 2}), ("a: [x}", {"a": None}), ("a: 'x' y", {"a": "x"}), ("a: &b 1", {"a": "&b 1"}), ("[" * 5000, {}), ("a: " + "[" * 5000, {}), ("a: " + "9" * 10_000, {})):
        data, problems = read_block(text)
        assert (data, bool(problems)) == (known, True), text[:20]
    rng = random.Random(8)
    for _ in range(3000):
        read_block("".join(rng.choice("ab:- \n\n'\"[]{},|>#&?1") for _ in range(rng.randrange(40))))


def test_documents(spark):
    raws = [
        "---\ntitle: A\ntitle: B\nsidebar:\n  order: 2\norder: 9\n---\nBody\n\n", "---\r\ntitle: 42\r\nsidebar: {order: high}\r\norder: 3\r\n---\r\nX", "No block\n---\na: 1\n---", None, "", "---\n---\nempty block",
        "---\naliases: [a, 1, 'b']\nprotected: yes\nauthor: >\n  Ann\ncustom:\n  k: [1]\ndate: 2024-02-30\n---", "---\nopen: 1\n", "---\norder: 1e999\nauthor: 42\ndate: \"2024-02-29 later\"\n---\n",
    ]
    df = spark.createDataFrame([(k, r, "clash") for k, r in enumerate(raws)], "id int, raw string, title string")
    got = {r.id: r for r in FM.split_frontmatter(df, "raw").collect()}
    assert (got[0].title, got[0].order, got[0].problem, got[0].body) == ("A", 2.0, "repeated key title", "Body")
    assert (got[1].title, got[1].order, got[1].body) == (None, None, "X")
    assert (got[2].title, got[2].body, got[2].unknown) == (None, raws[2], {})
    assert (got[3].body, got[4].body) == (None, "")
    assert (got[6].aliases, got[6].protected, got[6].author, got[6].custom, got[6].date) == (["a", "b"], False, "Ann", {"k": "[1]"}, None)
    assert (got[7].body, got[7].title) == ("---\nopen: 1", None)
    assert (got[8].order, got[8].author, got[8].date) == (None, None, "2024-02-29")
    assert FM.split_frontmatter(df.limit(0), "raw").count() == 0


def test_whole_pages(spark):
    code = "```\n# not a heading [no](link.md)\n```\n"
    docs = [("guide/index.md", f"---\nkind: home\n---\n{code}\n> quote\n\n# Real #\n\nFirst [a](../b.md#c) and ![i](x.png) and [w](https://h/).\n"), ("index.mdx", "---\nkind: blog\ntitle: ''\n---\ntext"), ("index.md", ""), ("blog/my-post.md", None)]
    got = {r.path: r for r in pages.normalize_pages(spark.createDataFrame(docs, "path string, raw string"), "path", "raw").collect()}
    one = got["guide/index.md"]
    assert (one.slug, one.kind, one.title, one.description) == ("guide", "documentation", "Real", "First a and i and w.")
    assert [tuple(x) for x in one.links] == [("a", "../b.md#c", False, "b"), ("w", "https://h/", True, None)]
    assert (got["index.mdx"].kind, got["index.md"].kind, got["blog/my-post.md"].kind) == ("blog", "home", "blog")
    assert got["index.md"].description == ""
