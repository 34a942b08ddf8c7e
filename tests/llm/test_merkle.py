"""The Merkle manifest against a plain tree, built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    """Root, and for each leaf what stands before and after it on each level."""
    proofs, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for leaf in own[at + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            below.append(sum(own[at : at + fanout], []))
        nodes, own = up, below
    return nodes[0], proofs


def plain_manifest(rows, fanout=2):
    """(id, leaf, subroot, root, proof) of rows (id, group, leaf)."""
    groups = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names], fanout)
    return [
        (r[3], r[2], trees[g][0], root, own + above)
        for g, above in zip(names, upper, strict=True)
        for r, own in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True)
    ]


def found(built):
    return [(r.row.doc_id, r.leaf, r.subroot, r.root, list(zip(r.before, r.after, strict=True))) for r in built.collect()]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 1), (2, 2), (3, 2), (5, 3)])
def test_superblocks_equal_a_plain_tree(spark, fanout, levels):
    rows = [(k, f"g{k % 7}" if k % 7 else None, sha(str(k))) for k in range(300)]
    rows += [(None, "g1", sha("x")), (None, None, sha("y")), (1000, "alone", sha("z")), (5, "g5", sha("5")), (5, "g5", sha("other")), (6, "é", sha("e")), (7, "z", sha("e"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5).withColumn("idx", F.lit("clash"))
    built = merkle.build(df, F.col("lang"), ["doc_id"], F.col("leaf"), ["doc_id", "idx"], fanout, levels)
    assert sorted(found(built), key=str) == sorted(plain_manifest(rows, fanout), key=str)
    assert built.filter(merkle.fold(F.col("leaf")) == F.col("root")).count() == len(rows)
    assert built.filter(merkle.fold(F.sha2("leaf", 256)) == F.col("root")).count() == 0


def test_query_equals_a_plain_manifest(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    by_id = {d.doc_id: d for d in docs}
    want = []
    for i, leaf, subroot, root, proof in plain_manifest([(d.doc_id, d.lang, plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)) for d in docs]):
        d = by_id[i]
        h = plain_leaf(d.doc_id, d.source, d.lang, d.n_chars + (zlib.crc32(str(i).encode()) % 7 == 0), d.text)
        for b, a in proof:
            h = sha(b, h, a)
        want.append((i, leaf, subroot, root, sha(*[b + a for b, a in proof]), h, h == root))
    got = QUERIES["op12_merkle"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[-1] for w in want} == {True, False}


def test_nulls_repeats_and_one_row(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "s", "en", 0), (1, "", "s", "en", 0), (7, "x" * 100_000, None, "en", None), (7, "é😀", "s", None, 2**63 - 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("leaf", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle"](spark, str(tmp_path)).collect()
    want = plain_manifest([(i, lang, plain_leaf(i, source, lang, n, text)) for i, text, source, lang, n in rows])
    proof = lambda p: sha(*[b + a for b, a in p])
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted((str(i), a, b, c, proof(p)) for i, a, b, c, p in want)
    one = merkle.build(spark.createDataFrame([(1, "en", "ab")], "doc_id long, lang string, leaf string"), F.col("lang"), ["doc_id"], F.col("leaf"), ["doc_id"]).first()
    assert (one.subroot, one.root, one.before, one.after) == ("ab", "ab", [], [])
