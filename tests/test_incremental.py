"""Incremental compiling, versions and caches."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import incremental as I

FILES = "file string, hash string, handled boolean"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_plan_follows_dependents_over_circles_and_finds_renames(spark):
    now = files(spark, [("a", "1", True), ("b", "new", True), ("c", "3", True), ("d", "4", True), ("readme", "5", False), ("moved", "9", True), ("moved2", "9", True), ("a", "1", True)])
    units = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("old1", "9"), ("old2", "9"), ("gone", "8")], "file string, hash string")
    deps = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "c"), ("gone", "b"), ("d", "gone")], "file string, dependency string")
    got = {r.file: tuple(r)[1:] for r in I.plan_compile(now, units, deps).collect()}
    assert got == {
        "a": ("compile", "affected", None), "b": ("compile", "changed", None), "c": ("compile", "affected", None), "d": ("compile", "affected", None), "readme": ("skipped", None, None),
        "moved": ("compile", "changed", "old2"), "moved2": ("compile", "changed", None), "gone": ("removed", None, None), "old1": ("removed", None, None), "old2": ("removed", None, None),
    }
    empty = files(spark, [])
    assert I.plan_compile(empty, units.limit(0), deps).count() == 0


def test_update_compiles_only_what_it_must_and_refuses_a_stale_writer(spark, tmp_path):
    root, seen = str(tmp_path), []

    def build(df):
        seen.append(sorted(r.file for r in df.collect()))
        return df.select("file", F.upper("hash").alias("unit"))

    one = files(spark, [("a", "x", True), ("b", "y", True), ("c", "z", True)])
    deps = spark.createDataFrame([("c", "b")], "file string, dependency string")
    assert I.current_version(spark, root) == 0
    assert I.update(one, deps, root, build)[0] == 1
    two = files(spark, [("a", "x", True), ("b", "yy", True), ("c", "z", True)])
    assert I.update(two, deps, root, build)[0] == 2
    assert I.update(two, deps, root, build)[0] == 3
    assert seen == [["a", "b", "c"], ["b", "c"], []]
    assert {r.file: (r.unit, r.compiled_in) for r in I.read_version(spark, root, 3).collect()} == {"a": ("X", 1), "b": ("YY", 2), "c": ("Z", 2)}
    assert I.read_version(spark, root, 1).count() == 3
    with pytest.raises(I.StaleWriter):
        I.update(one, deps, root, build, base=2)
    assert I.current_version(spark, root) == 3
    with pytest.raises(ZeroDivisionError):  # what fails before the commit leaves no version
        I.update(one, deps, root, lambda df: 1 / 0)
    assert I.current_version(spark, root) == 3


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.choice([None, rng.randrange(9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = [tuple(r) for r in I.running(df, [F.col("k")], {"n": F.lit(1), "s": F.col("v")}).orderBy("n").collect()]
    total = 0
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    for n, (_, v, count, s) in enumerate(got, 1):
        total += v or 0
        assert (count, s) == (n, total)


def test_eviction(spark):
    rows = [("old", 1, 5, None, "x"), ("bad", 90, 5, "c", "d"), ("lost", 91, 5, None, None), ("twice", 10, 1, None, "x"), ("twice", 95, 7, None, "x"), ("new", 99, 6, "c", "c"), ("tie", 95, 4, None, "x")]
    df = spark.createDataFrame(rows, "key string, at long, size long, checksum string, actual string")
    fate = lambda **k: {r.key: r.fate for r in I.evict(df, F.lit(100), F.lit(50), **k).collect()}
    base = {"old": "expired", "bad": "corrupt", "lost": "corrupt"}
    assert fate() == base | {"twice": "kept", "new": "kept", "tie": "kept"}
    assert fate(max_entries=2) == base | {"twice": "evicted", "new": "kept", "tie": "kept"}
    assert fate(max_bytes=9) == base | {"twice": "evicted", "new": "kept", "tie": "evicted"}
    assert I.evict(df.limit(0), F.lit(1)).count() == 0


def test_keys_and_cleaning(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(I.cache_key("x", "y").alias("k")).distinct().count() == 3
    spaces = spark.createDataFrame([("cache", "/c", True), ("logs", "/l", False), ("docs", "/d", True)], "name string, path string, exists boolean")
    classes = spark.createDataFrame([("cache", "temporary"), ("logs", "temporary"), ("docs", "kept")], "name string, retention string")
    assert [tuple(r) for r in I.clean_state(spaces, classes, ["temporary"]).collect()] == [("cache", "/c", "temporary")]
