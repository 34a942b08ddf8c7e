"""Token-id output as length-delimited binary records with a separate offset index.

A data file is a chain of frames. One frame holds one document:

====================  =====================================================
u64 little-endian     length of the payload in bytes
u32 little-endian     masked CRC-32 of those eight bytes
payload               i64 id, u8 flags, u32 number of ids, the ids
u32 little-endian     masked CRC-32 of the payload
one byte 0x0A         end of frame
====================  =====================================================

Flag 1 says that the id is null; flag 2 that ids take four bytes, else two (a
vocabulary below 65,536 needs no more). A checksum is masked by rotating it 15
bits right and adding a constant, so that a checksum of data that itself holds
checksums stays strong. Files are written and read by Spark's own writers and
readers alone, hence on any store and with its commit protocol. The index is a
Parquet table beside the data with one row for each frame: file, offset, length,
id, number of ids and the ids before it in its file.

Records are in ascending order of id, nulls first, equal ids by a hash of their
text and then the text. There are as many files as the texts' measured size needs
to keep each near ``FILE_BYTES`` of text, so readers that load whole files stay
bounded. A shuffled read permutes the index alone; tasks then seek each record.

Defined cases: a null text counts as empty, which gives a record of the end id
alone; a text that spells a special token gets that token's id, as the library
gives it; a text of any length is one record, its length counted in 64 bits and
its ids in 32; repeated ids keep one record for each row; rows equal in id and
text are interchangeable; extra columns are ignored; an empty table writes no
record and reads back as an empty table.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bound_batches

MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBI")
_TAIL = struct.Struct("<I")
#: Between a character that is no white space and one that is; no token spans such a place.
#: U+001C..U+001F are no space to the tokenizer.
_CUT = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
#: Characters that are cut to pieces at once; different pieces are looked up once in them.
STRETCH = 1 << 21
#: Bytes of text that one file is meant for.
FILE_BYTES = 128 << 20
#: Pieces that one generation of a worker's memory holds.
REMEMBERED = 200_000


def masked_crc(data: bytes) -> int:
    """CRC-32 of ``data``, rotated and shifted by a constant."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


@functools.cache
def _character_classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter or digit, 2 another character, 3 the apostrophe."""
    of = np.full(0x110000, 2, dtype=np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            of[k] = 1
        elif c.isspace() and not 0x1C <= k <= 0x1F:
            of[k] = 0
    of[ord("'")] = 3
    return of


def pieces_of(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All pieces of the texts in turn, and the number of pieces before each text and in all.

    A piece is white space and a run of letters and digits, or white space and a run of
    others; others that end with an apostrophe take the letters after it along, as in 's.
    """
    ends = np.cumsum([0, *map(len, texts)])
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    classes, step = _character_classes(), 1 << 18  # in steps, because places of eight bytes are made of the points
    of = np.concatenate([classes[:0], *[classes[points[k : k + step]] for k in range(0, len(points), step)]])
    before, after = of[:-1], of[1:]
    starts = np.zeros(len(points) + 1, dtype=bool)
    starts[1:-1] = (after == 0) & (before != 0) | (before == 1) & (after >= 2) | (before == 2) & (after == 1)
    starts[ends] = True
    places = np.flatnonzero(starts)
    raw, offsets = whole.encode(), places.astype(np.int64)
    if len(raw) > len(points):
        size = np.ones(len(points), dtype=np.uint8)
        for least in (0x80, 0x800, 0x10000):
            size += points >= least
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(size, places[:-1], dtype=np.int64))])
    found = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
    return found, np.searchsorted(places, ends)


class PieceEncoder:
    """The tokenizers library behind a bounded memory of the pieces seen.

    No token spans the end of a piece, so a text's ids are those of its pieces in
    turn. The memory has two generations: when the young one is full it becomes
    the old one, from which pieces that are met again return. Pieces that it lacks
    go to the library in one batch, joined by the special token where it has just one;
    long pieces are never remembered.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # special tokens are cut out of a text before it is split to pieces
        added = self.tokenizer.get_added_tokens_decoder()
        special = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.around = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.special = dict(zip(special, map(self._packed, self._ids_of(special)), strict=True))
        self.joint = None
        if len(added) == 1:
            ((number, token),) = added.items()
            name = token.content
            apart = not any(name.startswith(name[k:]) for k in range(1, len(name)))  # never found across its own ends
            if apart and not (token.lstrip or token.rstrip or token.single_word or token.normalized):
                self.joint = name, number
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed in ``width`` bytes each, little-endian."""
        own = [self.stretches(t) for t in texts]
        flat = [s for part in own for s in part]
        packed: list[bytes | None] = [self.special.get(s) for s in flat]
        group, size = [], 0
        for k, s in enumerate(flat):
            if packed[k] is None:
                group.append(k)
                size += len(s)
            if group and (size >= STRETCH or k == len(flat) - 1):
                for at, ids in zip(group, self._encode([flat[g] for g in group]), strict=True):
                    packed[at] = ids
                group, size = [], 0
        turn = iter(packed)
        return [b"".join(next(turn) for _ in part) for part in own]

    def stretches(self, text: str) -> list[str]:
        """A text in parts: special tokens, and what is between them, long parts cut where no piece reaches across."""
        if not any(t in text for t in self.special):
            parts = [text]
        else:
            parts = [p for p in self.around.split(text) if p]
        if len(text) <= STRETCH:
            return parts
        out = []
        for part in parts:
            start = 0
            while len(part) - start > STRETCH and (cut := _CUT.search(part, start + STRETCH)):
                out.append(part[start : cut.start()])
                start = cut.start()
            out.append(part[start:])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        pieces, ends = pieces_of(texts)
        different = pieces.dictionary_encode()
        names = different.dictionary.to_pylist()
        ids = list(map(self.young.get, names))
        missing = []
        for k, found in enumerate(ids):
            if found is None:
                found = self.old.get(names[k])
                if found is None:
                    missing.append(k)
                else:
                    self.young[names[k]] = ids[k] = found
        for k, found in zip(missing, self._learn([names[k] for k in missing]), strict=True):
            ids[k] = found
            if len(names[k]) <= 64:
                self.young[names[k]] = found
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        taken = pa.array(ids, pa.large_binary()).take(different.indices)
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library."""
        if self.joint is None:
            return list(map(self._packed, self._ids_of(pieces)))
        (name, number), out = self.joint, []
        for k in range(0, len(pieces), 1000):
            (ids,) = self._ids_of([name.join(pieces[k : k + 1000])])
            ids = np.array(ids, dtype=f"<u{self.width}")
            ends = np.flatnonzero(ids == number)
            raw, starts = ids.tobytes(), [0, *((ends + 1) * self.width).tolist()]
            out += [raw[a:b] for a, b in zip(starts, [*(ends * self.width).tolist(), len(raw)], strict=True)]
        return out

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()


@functools.lru_cache(maxsize=2)
def load_encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(tokenizer_file)


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One frame around packed ids of ``width`` bytes each."""
    flags = (doc_id is None) | (width == 4) << 1
    body = _BODY.pack(doc_id or 0, flags, len(ids) // width) + ids
    size = len(body).to_bytes(8, "little")
    return size + _TAIL.pack(masked_crc(size)) + body + _TAIL.pack(masked_crc(body)) + b"\n"


def frames(content: bytes, verify: bool = True):
    """Yields (offset, length, id, ids as u32) of each frame; raises where a checksum fails.

    Without ``verify`` the payloads are not checked, only the lengths.
    """
    at = 0
    while at < len(content):
        size, check = _HEAD.unpack_from(content, at)
        end = at + _HEAD.size + size + _TAIL.size + 1
        if masked_crc(content[at : at + 8]) != check or end > len(content):
            raise ValueError(f"damaged length at byte {at}")
        body = memoryview(content)[at + _HEAD.size : end - _TAIL.size - 1]
        if verify and masked_crc(body) != _TAIL.unpack_from(content, end - _TAIL.size - 1)[0]:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags, count = _BODY.unpack_from(body, 0)
        ids = np.frombuffer(body, "<u4" if flags & 2 else "<u2", count, _BODY.size)
        yield at, end - at, None if flags & 1 else doc_id, ids.astype("<u4") if verify else ids
        at = end


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every text, appends ``end_id`` and writes ``path``/data and ``path``/index."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = (
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        )
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(files, F.col("id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "text")
        .select("id", "text")
    )

    def run(batches):
        encoder = load_encoder(tokenizer_file)
        end = int(end_id).to_bytes(encoder.width, "little")
        names: list[int | None] = []
        texts: list[str] = []
        size = 0

        def framed() -> pa.RecordBatch:
            out = [frame(i, x + end, encoder.width) for i, x in zip(names, encoder.encode_many(texts), strict=True)]
            # a frame's last byte is the line end that the text writer adds
            return pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["value"])

        for batch in batches:
            more = batch.column(1).to_pylist()
            names += batch.column(0).to_pylist()
            texts += more
            size += sum(map(len, more))
            if size >= STRETCH:
                yield framed()
                names, texts, size = [], [], 0
        if names:
            yield framed()

    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(
        f"{path}/data"
    )
    scan_records(spark, path, verify=False).drop("ids_crc32").write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .load(f"{path}/data")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )


SCANNED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def scan_records(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """One row for each frame of the data files, checksums verified; ``ids_crc32`` is null unless ``verify``."""

    def run(batches):
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, before = [], 0
                for offset, length, doc_id, ids in frames(content, verify):
                    crc = zlib.crc32(ids.tobytes()) if verify else None
                    rows.append((file, offset, length, doc_id, len(ids), before, crc))
                    before += len(ids)
                columns = zip(*rows, strict=True) if rows else [[]] * len(SCANNED)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(c), pa.string() if f.name == "file" else pa.int64())
                        for c, f in zip(columns, SCANNED, strict=True)
                    ],
                    names=SCANNED.fieldNames(),
                )

    # a task reads files of spark.sql.files.maxPartitionBytes in all, or one file
    return _files(spark, path).mapInArrow(run, SCANNED)


def read_ids(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """The records as (doc_id, ids array), in file order or, with ``seed``, shuffled.

    Only rows of the index are ordered - by file and offset, or by a hash with the
    seed - and dealt to tasks in that order. A task then opens each record's file
    and reads its bytes at the offset that the index names.
    """
    index = spark.read.parquet(f"{path}/index")
    order = [file_number("file"), F.col("offset")] if seed is None else [F.xxhash64("file", "offset", F.lit(seed)), F.col("file"), F.col("offset")]
    places = index.orderBy(*order).select("file", "offset", "length")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    where = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(where)
        name, file = None, None
        for batch in batches:
            names, values = [], []
            for own, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, store.open_input_file(f"{root}/{own}")
                ((_, _, doc_id, ids),) = frames(file.read_at(length, offset))
                names.append(doc_id)
                values.append(ids)
                if sum(map(len, values)) > 1 << 20:
                    yield _ids_batch(names, values)
                    names, values = [], []
            yield _ids_batch(names, values)
        if file is not None:
            file.close()

    return places.mapInArrow(run, schema)


def _ids_batch(names: list, values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array([v.astype(np.int64) for v in values], pa.list_(pa.int64()))], names=["doc_id", "ids"]
    )


def file_number(file: str):
    """The number of a data file, which its name may carry in any width."""
    return F.regexp_extract(file, "part-([0-9]+)", 1).cast("long")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Every record with ``start``, the ids of all records before it.

    Only the per-file totals - one row a file, not a record - meet in one window.
    """
    totals = (
        spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("total"))
    )
    ahead = totals.select(
        "file",
        (F.sum("total").over(Window.orderBy(file_number("file")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("ahead"),
    )
    return (
        scan_records(spark, path)
        .join(ahead, "file")
        .select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
