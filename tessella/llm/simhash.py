"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Fingerprints are linked where at most two of their 64 bits differ.

The 64 bits are cut into three segments. Two differences leave, by the pigeonhole
principle, some segment of the cycle A-B-C-A without any and its successor with
one at most. So a key is one segment as it is, together with a fuzzy hash of the
next one: the index of the binary Golay code's codeword that the segment decodes
to. As one difference may move a segment to another codeword, it gets the
indices of all codewords that it or any one-bit change of it decodes to, one to
six in number; two segments that differ in one bit always share an index. Rows
that share a key are joined and their distance verified.

A key that many different fingerprints share is not joined with itself: each of
its fingerprints is listed under the 65 points at distance 0 and 1 instead. Two
fingerprints are within two bits exactly if they share a point, and all at one
point are within two bits, so a star over each point's at most 65 members keeps
every link, in linear work. Equal fingerprints are merged before all of this.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero, linked like any other; a bit that half the shingles set, a tie, is 0; a text of
any length is read whole; extra columns are ignored or, in :func:`one_of_each`,
carried whatever their names; repeated rows and ids are kept, one output row each;
a null id is carried, and no component is named after it unless all its members
have null ids; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, join_unique, map_texts
from tessella.llm.components import connected_components

#: Distinct fingerprints of one key that are joined pair by pair.
PAIRWISE = 64
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GOLAY_POLYNOMIAL = 0b101011100011


def fingerprint_text(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    return int(fingerprint_texts([text], shingle, seed)[0])


def fingerprint_texts(texts: list[str], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of texts as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            out[i] = xxh64_intdigest(b" ".join(words), seed)
            continue
        votes, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
        for at in range(0, n, 100_000):
            part = words[at : at + 100_000 + shingle - 1]
            rows = zip(*(part[k:] for k in range(shingle)), strict=False)
            hashes = np.array([xxh64_intdigest(b" ".join(r), seed) for r in rows], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(
    docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``row`` (the ``carry`` columns) and ``res.fp`` (the fingerprint as a signed long)."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(fingerprint_texts(texts, shingle, seed).view(np.int64), pa.int64())]

        return work

    return map_texts(docs, carry, text_col, T.StructType([T.StructField("fp", T.LongType())]), make)


def golay_table() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each 12-bit message shifted by 11, error pattern of each 11-bit syndrome)."""
    remainder = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        high = (remainder >> bit) & 1
        remainder ^= high * (GOLAY_POLYNOMIAL << (bit - 11))

    one = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, dtype=np.int64), one]
    errors.append(np.array([x | y for x in one for y in one if x < y]))
    errors.append(np.array([x | y for x in errors[2] for y in one if y > x]))
    pattern = np.zeros(1 << 11, dtype=np.int64)
    for group in errors:
        pattern[(group & 0x7FF) ^ remainder[group >> 11]] = group
    return remainder, pattern


def fuzzy_indices(segment: np.ndarray, width: int, tables=None) -> np.ndarray:
    """A row for each segment: the indices that it and its one-bit changes decode to (with repeats)."""
    remainder, pattern = tables or golay_table()
    changed = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    syndrome = (changed & 0x7FF) ^ remainder[changed >> 11]
    return (changed ^ pattern[syndrome]) >> 11


def keys_of(fp: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key) pairs, without repeats, of signed 64-bit fingerprints."""
    tables = tables or golay_table()
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    where, keys = [], []
    for k in range(3):
        nxt = (k + 1) % 3
        index = np.sort(fuzzy_indices(parts[nxt], SEGMENTS[nxt][1], tables), axis=1)
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        where.append(row)
        keys.append((k << 40) | (parts[k][row] << 12) | index[row, col])
    return np.concatenate(where), np.concatenate(keys)


def _with_keys(fps: DataFrame) -> DataFrame:
    def run(batches):
        tables = golay_table()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            where, key = keys_of(fp, tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(fp[where], pa.int64())], names=["key", "fp"]
            )

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect all of ``fps.fp`` (distinct) within two bits of each other."""
    keyed = _with_keys(fps)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cold = keyed.join(sizes.filter(F.col("n") <= pairwise).select("key"), "key")
    a = cold.select("key", F.col("fp").alias("a"))
    b = cold.select("key", F.col("fp").alias("b"))
    near = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")

    crowded = keyed.join(sizes.filter(F.col("n") > pairwise).select("key"), "key").select("fp").distinct()
    points = crowded.select(
        "fp",
        F.explode(
            F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
        ).alias("point"),
    )
    stars = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    star = stars.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a <> b")
    return near.unionByName(star)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``fp`` (signed long), ``component_id``."""
    signed = cut(
        fingerprints(docs, [id_col], text_col, shingle, seed).select(
            F.col(f"row.`{id_col}`").alias("doc_id"), F.col("res.fp").alias("fp")
        )
    )
    fps = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = connected_components(links(fps), "a", "b").select(F.col("node").alias("fp"), "component")
    grouped = cut(fps.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    final = cut(join_unique(grouped, named, "component", "size", grouped.count(), ["component_id"]).select("fp", "n", "component_id"))
    return join_unique(signed, final, "fp", "n", signed.count(), ["component_id"]).select(
        "doc_id", "fp", "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id.

    Rows with a null id cannot be named as a copy and stay. An id that several
    rows have is told apart by its rows' fingerprints, and of rows equal in both
    one stays.
    """
    found = cut(near_duplicates(docs, id_col, text_col))
    best = found.filter("doc_id = component_id").select("doc_id", "fp").distinct()
    again = cut(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    key = F.col(f"`{id_col}`")
    nameless = docs.filter(key.isNull())
    if again.isEmpty():
        kept = docs.join(best.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        return kept.unionByName(nameless).select(docs.columns)
    repeated = again.select(F.col("doc_id").alias(id_col))
    kept = docs.join(
        best.join(again, "doc_id", "left_anti").select(F.col("doc_id").alias(id_col)), id_col, "left_semi"
    )
    rows = fingerprints(docs.join(repeated, id_col, "left_semi"), docs.columns, text_col)
    told = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col("res.fp").alias("fp"), "row")
    single = told.join(best, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]).select("row.*")
    return kept.unionByName(single).unionByName(nameless).select(docs.columns)
