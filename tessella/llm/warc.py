"""Web archives with a two-level capture index.

Pages are written as WARC 1.1 records, each a gzip member of its own, into files
that tasks open in the shared folder; a file counts only once a row of the table of
captures names it, and that table is committed by Spark, so what a lost task left
behind is never read. Of records with equal payloads of ``MIN_REVISIT`` bytes or
more that with the least id is the response, the others refer to it.

The index sorts captures by the URL with its host reversed (``com,example)/a?b``)
into shards. A shard is a chain of compressed blocks of CDXJ lines; beside it stands
its sparse directory, one line for each block: first key, offset, length. Shards
themselves are listed in a small table. A lookup finds the shards of a key by binary
search over their first keys, then the blocks by binary search over a shard's
directory, reads those blocks by range, and finds the lines by binary search again.
A capture is then read by its range of bytes in its archive; a revisit reads the
record that it refers to, once for all revisits of it that a task has.

Nothing is gathered by payload or host: digests are counted with partial sums, a
digest that over a thousandth of the rows share is broadcast (at most a thousand
such), keys and captures are dealt out by range and may be split anywhere.

Defined cases: a null html is an empty payload; a null URL has the key of an empty
one and a URN as target; null ids come last when the response is chosen, and a
revisit of a response with a null id refers to null; rows equal in id, URL and html
give one response, the others revisit it; payloads under ``MIN_REVISIT`` bytes are
always responses; a URL's control characters and blanks are percent-encoded; payloads
of any length are one record; extra columns are ignored; an empty table writes no
archive and reads back as an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bound_batches, cut, join_unique

#: Bytes from which an equal payload is written as a revisit.
MIN_REVISIT = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Lines and bytes of one block of the index before compression.
BLOCK_LINES = 3000
BLOCK_BYTES = 1 << 20
#: Bytes that a task reads at once where records follow each other.
READ_AHEAD = 4 << 20
GZIP_LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
STAMP = re.sub(r"\D", "", DATE)
#: Rows of repeated digests, about 200 bytes each, that may be broadcast.
BROADCAST_ROWS = 50_000

_URL = r"^(?i:[a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^#]*)"
_ENDS = b"\r\n\r\n"


def url_key(url: Column | str) -> Column:
    """Sort key of a URL: host reversed, without scheme, user, default port and fragment."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host, port, tail = (F.regexp_extract(u, _URL, k) for k in (1, 2, 3))
    reverse = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    key = F.when(F.regexp_like(u, F.lit(_URL)), F.concat(reverse, port, F.lit(")"), tail)).otherwise(u)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def _record_id(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(seed.encode()).hexdigest()[:32])}>"


def make_record(kind: str, record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple | None = None) -> bytes:
    """One WARC record; ``refers`` is (digest, page id, URL) of the response that a revisit refers to."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers[0])}"]
        if refers[1] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers[1]}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _ENDS + block + _ENDS


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and payload of one record; raises where it is damaged."""
    head, _, rest = data.partition(_ENDS)
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers.get("content-length", -1))
    if lines[0] != "WARC/1.1" or len(rest) != size + len(_ENDS) or not rest.endswith(_ENDS):
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    payload = rest[rest.index(_ENDS) + len(_ENDS) : size] if headers["warc-type"] != "warcinfo" else rest[:size]
    return headers, payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _place(spark: SparkSession, path: str) -> str:
    """``path`` as a URI that tasks open, the folder made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    return re.sub(r"^s3[an]:", "s3:", store.makeQualified(folder).toString())


def _open(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


class Writer:
    """A file in the shared folder under a name of its own, opened when first written to."""

    def __init__(self, where: str, prefix: str, suffix: str, first: bytes = b""):
        self.store, self.root = _open(where)
        self.prefix, self.suffix, self.first, self.file = prefix, suffix, first, None

    def write(self, data: bytes) -> tuple[str, int]:
        """Appends ``data``; its file's name and where it begins."""
        if self.file is None:
            self.name, self.at = f"{self.prefix}-{uuid.uuid4().hex}{self.suffix}", len(self.first)
            self.file = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.file.write(self.first)
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        """Closes the file; the next write opens another."""
        if self.file is not None:
            self.file.close()
        self.file = None


class Reader:
    """Ranges of files in the shared folder, with reading ahead."""

    def __init__(self, where: str, ahead: int = READ_AHEAD):
        self.store, self.root = _open(where)
        self.ahead, self.name, self.file, self.low, self.held = ahead, None, None, 0, b""

    def read(self, name: str, offset: int, length: int) -> bytes:
        """``length`` bytes of ``name`` from ``offset`` on."""
        if name != self.name:
            self.close()
            self.name, self.file, self.low, self.held = name, self.store.open_input_file(f"{self.root}/{name}"), 0, b""
        if not self.low <= offset <= offset + length <= self.low + len(self.held):
            self.low, self.held = offset, self.file.read_at(max(length, self.ahead), offset)
        return self.held[offset - self.low : offset - self.low + length]

    def close(self) -> None:
        """Closes the open file."""
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


_CAPTURES = "key string, page_id long, kind string, digest string, file string, offset long, length long"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes ``path``/archives and the table of their records, ``path``/captures."""
    spark = pages.sparkSession
    bound_batches(spark)
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    records = _with_kinds(rows)
    where = _place(spark, f"{path}/archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(where)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
        out = Writer(where, "pages", ".warc.gz", _gzip(info.encode()))
        for batch in batches:
            made = {c: [] for c in ("file", "offset", "length")}
            page, url, html, digest, kind, refers, refers_url = (batch.column(c) for c in ("page_id", "url", "html", "digest", "kind", "refers_to", "refers_url"))
            for k in range(batch.num_rows):
                body = html[k].as_buffer().to_pybytes() if html[k].is_valid else b""
                own, own_digest = kind[k].as_py(), digest[k].as_py()
                revisit = own == "revisit"
                # a response that can be referred to is named by its digest, of which it is the only one
                named = own_digest if not revisit and len(body) >= MIN_REVISIT else uuid.uuid4().hex
                back = (own_digest, refers[k].as_py(), refers_url[k].as_py()) if revisit else None
                data = _gzip(make_record(own, _record_id(named), page[k].as_py(), url[k].as_py(), body, own_digest, back))
                file, at = out.write(data)
                for c, v in zip(made, (file, at, len(data)), strict=True):
                    made[c].append(v)
                if out.at >= ARCHIVE_BYTES:
                    out.close()
            places = [pa.array(made["file"], pa.string()), pa.array(made["offset"], pa.int64()), pa.array(made["length"], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), page, kind, digest, *places], names=["key", "page_id", "kind", "digest", "file", "offset", "length"])
        out.close()

    written = records.withColumn("key", url_key("url")).mapInArrow(run, _CAPTURES)
    written.write.parquet(f"{path}/captures")


def _with_kinds(rows: DataFrame) -> DataFrame:
    """``rows`` with kind, refers_to and refers_url; revisits without their html."""
    none = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url")]
    columns = ["page_id", "url", "html", "digest"]
    order = lambda m: F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", *m)
    equal = rows.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest", "page_id", "url").agg(F.count("*").alias("m"))
    firsts = equal.groupBy("digest").agg(F.sum("m").alias("n"), F.min(order(["m"])).alias("first")).filter("n > 1")
    firsts = cut(firsts)
    n = firsts.count()
    if not n:
        return rows.select(*columns, F.lit("response").alias("kind"), *none)
    if n <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        total = firsts.agg(F.sum("n")).first()[0]
        met = join_unique(rows.join(firsts.select("digest"), "digest", "left_semi"), firsts, "digest", "n", total, ["first"])
        marked = rows.join(firsts.select("digest"), "digest", "left_anti").unionByName(met, allowMissingColumns=True)
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    alone = marked.filter(F.col("first").isNull() | (is_first & (F.col("first.m") == 1))).select(*columns)
    back = [F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")]
    narrow = lambda df: df.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", *back)
    others = narrow(marked.filter(F.col("first").isNotNull() & ~is_first))
    same = marked.filter(F.col("first").isNotNull() & is_first & (F.col("first.m") > 1))
    if not firsts.filter("first.m > 1").isEmpty():
        # rows equal in id, URL and html: one is the response, whichever
        held = cut(narrow(same).withColumn("row", F.monotonically_increasing_id()))
        others = others.unionByName(held.join(held.groupBy("digest").agg(F.min("row").alias("row")).select("row"), "row", "left_anti").drop("row"))
        alone = alone.unionByName(same.select(*columns).dropDuplicates(["digest"]))
    return alone.select("*", F.lit("response").alias("kind"), *none).unionByName(others.withColumn("kind", F.lit("revisit")))


_LINE = ("page_id", "kind", "digest", "file", "offset", "length", "t_file", "t_offset", "t_length")
_FOUND = "key string, page_id long, kind string, digest string, file string, offset long, length long, t_file string, t_offset long, t_length long"


def build_index(spark: SparkSession, path: str, shards: int | None = None) -> None:
    """Writes ``path``/index, shards of blocks with their directories, and ``path``/shards, one row a shard.

    There are ``shards`` of them at most, else as many as Spark's shuffle partitions come to.
    """
    captures = spark.read.parquet(f"{path}/captures")
    target = [F.col(c).alias(f"t_{c}") for c in ("file", "offset", "length")]
    revisits = captures.filter("kind = 'revisit'")
    weights = cut(revisits.groupBy("digest").agg(F.count("*").alias("n")))
    rows = captures.filter("kind = 'response'").select("*", *target)
    if total := weights.agg(F.sum("n")).first()[0]:
        # a response that revisits refer to is the only one of its digest: payloads so long are never written twice
        responses = captures.filter("kind = 'response'").join(weights, "digest").select("digest", "n", *target)
        rows = rows.unionByName(join_unique(revisits, responses, "digest", "n", total, [f"t_{c}" for c in ("file", "offset", "length")]))
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    where = _place(spark, f"{path}/index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Writer(where, "cdx", ".gz")
        sparse: list[tuple[str, int, int]] = []
        lines: list[str] = []
        held, last, first = 0, "", ""

        def flush() -> None:
            data = _gzip("\n".join(lines).encode())
            _, at = shard.write(data)
            sparse.append((lines[0].partition(" ")[0], at, len(data)))
            lines.clear()

        for batch in batches:
            rows = batch.to_pydict()
            for k, key in enumerate(rows["key"]):
                lines.append(f"{key} {STAMP} {json.dumps([rows[c][k] for c in _LINE])}")
                held, last = held + len(lines[-1]), key
                if len(lines) >= BLOCK_LINES or held >= BLOCK_BYTES:
                    flush()
                    held = 0
        if lines:
            flush()
        if sparse:
            name, first = shard.name, sparse[0][0]
            shard.close()
            directory = Writer(where, name, ".dir")
            directory.write(_gzip("\n".join(f"{k} {at} {size}" for k, at, size in sparse).encode()))
            directory.close()
            yield pa.RecordBatch.from_pylist([{"shard": name, "directory": directory.name, "first": first, "last": last, "blocks": len(sparse)}])

    sorted_rows = rows.select("key", *_LINE).repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order)
    sorted_rows.mapInArrow(run, "shard string, directory string, first string, last string, blocks long").write.parquet(f"{path}/shards")


class Shard:
    """One shard of the index: its directory in memory, its blocks read by range."""

    def __init__(self, reader: Reader, name: str, directory: str):
        self.reader, self.name = reader, name
        store, root = reader.store, reader.root
        with store.open_input_file(f"{root}/{directory}") as f:
            entries = [line.rsplit(" ", 2) for line in zlib.decompress(f.read(), 31).decode().split("\n")]
        self.firsts, self.places = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
        self.number, self.keys, self.lines = -1, [], []

    def find(self, key: str) -> Iterator[list]:
        """The captures of ``key``: its lines in the blocks that can hold it."""
        block = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while block < len(self.firsts) and self.firsts[block] <= key:
            if block != self.number:
                self.number = block
                self.lines = zlib.decompress(self.reader.read(self.name, *self.places[block]), 31).decode().split("\n")
                self.keys = [line.partition(" ")[0] for line in self.lines]
            for at in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                yield json.loads(self.lines[at].split(" ", 2)[2])
            block += 1


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Captures of the keys in the first column of ``keys``, each key once however often it is given."""
    # one row a shard, so as many as the sort by range had partitions
    shards = sorted((r["first"], r["last"], r["shard"], r["directory"]) for r in spark.read.parquet(f"{path}/shards").collect())
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]
    where = _place(spark, f"{path}/index")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [], []
            for key in batch.column(0).to_pylist():
                for number in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    numbers.append(number)
                    found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.string())], names=["number", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(where)
        number, shard = -1, None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", *_LINE])

        for batch in batches:
            for own, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != number:
                    number, shard = own, Shard(reader, *shards[own][2:])
                for capture in shard.find(key):
                    out.append((key, *capture))
                    if len(out) >= 5000:
                        yield packed()
                        out.clear()
        if out:
            yield packed()
        reader.close()

    named = keys.toDF("key", *keys.columns[1:]).select("key").filter("key is not null").distinct()
    routed = named.mapInArrow(route, "number long, key string").repartitionByRange("number", "key").sortWithinPartitions("number", "key")
    return routed.mapInArrow(search, _FOUND)


def fetch(spark: SparkSession, path: str, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``captures`` by their ranges: page_id, record_type, refers_to, payload_bytes, payload_digest and payload.

    Everything is read from the archives: id, kind and what a revisit refers to from
    its record's headers, size and digest from the payload itself, a revisit's from the
    record that it refers to. A payload that does not match its digest raises. Without
    ``payloads`` the payload is null.
    """
    where = _place(spark, f"{path}/archives")
    order = ["t_file", "t_offset", "file", "offset"]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, small = Reader(where), Reader(where, 0)
        at, headers, payload, digest = None, {}, b"", ""
        for batch in batches:
            out, held = [], 0
            for file, offset, length, t_file, t_offset, t_length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t_file, t_offset) != at:
                    at = (t_file, t_offset)
                    headers, payload = parse_record(zlib.decompress(whole.read(t_file, t_offset, t_length), 31))
                    digest = hashlib.sha256(payload).hexdigest()
                    if headers["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"damaged payload at byte {t_offset} of {t_file}")
                own = headers
                if (file, offset) != at:
                    own, _ = parse_record(zlib.decompress(small.read(file, offset, length), 31))
                    if own["warc-payload-digest"] != headers["warc-payload-digest"] or own["warc-refers-to"] != headers["warc-record-id"]:
                        raise ValueError(f"record at byte {offset} of {file} does not refer to what the index says")
                number = lambda name, own=own: int(own[name]) if name in own else None
                out.append((number("x-page-id"), own["warc-type"], number("x-refers-to-page-id"), len(payload), digest, payload if payloads else None))
                held += len(payload) if payloads else 0
                if held >= BLOCK_BYTES * 8:
                    yield _packed(out, kinds, names)
                    out, held = [], 0
            if out:
                yield _packed(out, kinds, names)
        whole.close()
        small.close()

    places = captures.select("file", "offset", "length", "t_file", "t_offset", "t_length")
    sorted_places = places.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_places.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _packed(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
