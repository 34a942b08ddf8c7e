"""Matching against brute force over all pairs."""

import itertools
import random
import re

import pytest

from tessella.operators import matching as M


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b):
    a, b = a.lower(), b.lower()
    p, q = set(re.split("[-_]", a)), set(re.split("[-_]", b))
    return max(len(p & q) / max(len(p), len(q), 1), (1 - distance(a, b) / max(len(a), len(b), 1)) * 0.9)


@pytest.mark.parametrize("alphabet", ["ab", "abc-_", "abcdefghijklmnopqrstuvwxyzAB-"])
def test_similar_names_misses_no_pair(spark, alphabet):
    rng = random.Random(len(alphabet))
    names = lambda n: sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(13))) for _ in range(n)})
    old, new = names(90), names(90)
    new = sorted(set(new) | {x[:-1] + "z" for x in old[::3]} | {x + "-more" for x in old[::4]})
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    found = {(r.old, r.new): r.score for r in M.similar_names(df(old), df(new)).collect()}
    want = {(a, b): similarity(a, b) for a, b in itertools.product(old, new) if similarity(a, b) >= 0.6}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def greedy(pairs):
    taken, out = set(), set()
    for old in sorted({(p[1], p[0]) for p in pairs}):
        left = [p for p in pairs if p[0] == old[1] and p[2] not in taken]
        if left:
            best = max(left, key=lambda p: (p[4], -p[3]))
            taken.add(best[2])
            out.add((best[0], best[2]))
    return out


def test_matching_equals_taking_in_turn_also_on_ties(spark):
    rng = random.Random(1)
    for k in range(4):
        pairs = [(f"o{i}", i, f"n{j}", j, rng.choice([0.6, 0.7, 1.0])) for i in range(14) for j in range(12) if rng.random() < 0.5 + k / 10]
        df = spark.createDataFrame(pairs, "old string, old_at long, new string, new_at long, score double")
        assert {(r.old, r.new) for r in M.match_in_order(df).collect()} == greedy(pairs)
    chain = [(f"o{i}", i, f"n{j}", j, 1.0) for i in range(8) for j in range(8)]  # all want the same one
    df = spark.createDataFrame(chain, "old string, old_at long, new string, new_at long, score double")
    assert {(r.old, r.new) for r in M.match_in_order(df).collect()} == {(f"o{i}", f"n{i}") for i in range(8)}


def test_renames_with_repeats_and_without_names(spark):
    df = lambda xs: spark.createDataFrame([(x, k) for k, x in enumerate(xs)], "name string, at long")
    found = {tuple(r) for r in M.detect_renames(df(["getUser", "same", "getUser", "gone"]), df(["getUsers", "same", "other", "getUserz"])).collect()}
    assert found == {("renamed", "getUser", "getUsers"), ("added", None, "other"), ("added", None, "getUserz"), ("removed", "gone", None)}
    assert M.detect_renames(df([]), df([])).count() == 0
    assert [tuple(r) for r in M.detect_renames(df([]), df(["a"])).collect()] == [("added", None, "a")]


def test_contained_equals_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(k, make(rng.randrange(30))) for k in range(60)] + [(60, None), (61, ""), (62, "needle " * 500)]
    needles = [make(rng.randrange(6)) for _ in range(80)] + ["", None, "needle n", "missing"]
    found = {tuple(r) for r in M.contained(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()}
    assert found == {(k, n) for k, t in texts for n in needles if t is not None and n is not None and n in t}


def test_impact_rules(spark):
    changes = [
        ("added", ["known", "new"], None, None, None), ("removed", ["gone"], None, None, None), ("modified", [], ["src/known.ts"], None, None), ("renamed", None, None, "old", "fresh"),
        ("moved", None, None, "old", None), ("deprecated", None, None, "known", "fresh"), ("deprecated", ["lost"], None, None, None), ("nonsense", ["known"], None, None, None),
        ("configuration-changed", None, None, None, None),
    ]
    pages = [("k", ["Known", "known"], ["api"]), ("o", ["old"], None), ("f", ["fresh"], ["guide"]), ("c", None, ["configuration"]), ("n", None, None)]
    c = spark.createDataFrame(changes, "kind string, symbols array<string>, files array<string>, old_name string, new_name string")
    p = spark.createDataFrame(pages, "slug string, symbols array<string>, kinds array<string>")
    assert {tuple(r) for r in M.classify_impact(c, p).collect()} == {
        ("regenerate", "k", None), ("create", "api:new", None), ("relink", "o", None), ("regenerate", "f", None), ("rename", "old", "fresh"), ("rename", "known", "fresh"),
        ("deprecate", "k", None), ("create", "migration", None), ("regenerate", "c", None),
    }
    assert M.classify_impact(c.limit(0), p).count() == 0


def test_probes_are_dealt_to_tasks(spark, monkeypatch):
    seen, probes = [], M._probes
    monkeypatch.setattr(M, "_probes", lambda df: seen.append(df.rdd.getNumPartitions()) or probes(df))
    monkeypatch.setattr(M, "TASK_PAIRS", 10, raising=False)
    names = lambda end: spark.createDataFrame([(f"some-name-{k}{end}",) for k in range(10)], "name string").coalesce(1)
    found = M.similar_names(names("a"), names("b"))
    assert seen == [10, 10]
    assert found.count() == 100  # one letter and at most one digit apart
