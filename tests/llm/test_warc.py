"""Web archives: records against a plain reader, the index against brute force, damage."""

import gzip
import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc
from tessella.llm.queries import QUERIES

A = "<p>" + "a" * 200
ROWS = [
    (5, "http://A.example.com:80/x#f", A), (3, "http://b.example.com/y z", A), (3, "http://b.example.com/y z", A), (9, None, A), (None, "not a url", A),
    (1, "", None), (2, "https://u@h.org:8443?q=1", "tiny"), (4, "https://u@h.org:8443?q=1", "tiny"), (7, "http://é.fr/ü", "é" * 60), (7, "http://é.fr/ü", "é" * 60),
    (None, "x\r\nWARC-Type: warcinfo", "n" * 300), (None, "x", "n" * 300), (8, "http://b.example.com/y z", "<q>\r\n\r\n" * 100_000), (10, "http://c/", "b" * 99), (11, "http://c/", "b" * 99), (12, "http://c/", "b" * 100), (13, "http://c/", "b" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    warc.write_archives(pages, path)
    warc.build_index(spark, path)
    return path


def plain_rows(rows):
    """(page_id, bytes, digest, type, refers_to), brute force."""
    data = [(i, u, (h or "").encode()) for i, u, h in rows]
    out, seen = [], set()
    for i, u, b in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        first = len(b) < 100 or b not in seen
        to = None if first else min((x[0] for x in data if x[2] == b and x[0] is not None), default=None)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if first else "revisit", to))
        seen.add(b)
    return sorted(out, key=str)


def test_read_back_equals_brute_force(spark, pages, archive):
    captures = warc.lookup(spark, archive, pages.select(warc.url_key("url")))
    found = warc.fetch(spark, archive, captures)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert sorted(rows, key=str) == plain_rows(ROWS)
    assert sorted(bytes(r.payload) for r in found.collect()) == sorted((h or "").encode() for _, _, h in ROWS)


def test_archives_are_valid_and_complete(archive):
    kinds = []
    for file in Path(archive, "archives").glob("*.warc.gz"):
        data, count = gzip.decompress(file.read_bytes()), 0
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1].decode())
            assert rest[size : size + 4] == b"\r\n\r\n"
            assert (kinds[-1] == "warcinfo") == (count == 0)
            data, count = rest[size + 4 :], count + 1
    want = [r[3] for r in plain_rows(ROWS)]
    assert kinds.count("response") == want.count("response")
    assert kinds.count("revisit") == want.count("revisit")


def test_keys_reverse_the_host(spark):
    urls = {
        "http://blog.Example.com/en/7#top": "com,example,blog)/en/7", "https://u:p@a.b:443?x=1": "b,a)/?x=1", "http://h:81": "h:81)/", "HTTP://h/a b": "h)/a%20b",
        "plain text": "plain%20text", "": "", "http://[::1]:80/": "[::1])/",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", warc.url_key("u").alias("k")).collect()} == urls


def test_lookup_finds_all_captures_of_a_key_over_blocks_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"http://h{k % 5 if k % 3 else 0}.org/{k % 4}", f"{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path))
    warc.build_index(spark, str(tmp_path), 4)
    shards = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert len(shards) > 1
    assert sum(s.blocks for s in shards) > 80
    asked = [("org,h0)/1",), ("org,h0)/1",), ("org,h4)/3",), ("org,h9)/",), ("",), ("zz",), (None,)]
    found = warc.lookup(spark, str(tmp_path), spark.createDataFrame(asked, "k string")).collect()
    want = [k for k, u, _ in rows if u in ("http://h0.org/1", "http://h4.org/3")]
    assert sorted(r.page_id for r in found) == want


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://h/", "x" * 500)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path))
    warc.build_index(spark, str(tmp_path))
    captures = warc.lookup(spark, str(tmp_path), df.select(warc.url_key("url")))
    good = captures.first()
    record = warc.make_record("response", warc._record_id("a"), 1, "http://h/", b"y" * 500, hashlib.sha256(b"x" * 500).hexdigest())
    (file,) = Path(tmp_path, "archives").glob("*.warc.gz")
    file.write_bytes(file.read_bytes()[: good.offset] + warc._gzip(record))
    moved = captures.withColumns({"length": F.lit(len(warc._gzip(record))), "t_length": F.lit(len(warc._gzip(record)))})
    with pytest.raises(Exception, match="damaged payload"):
        warc.fetch(spark, str(tmp_path), moved).collect()
    with pytest.raises(ValueError, match="damaged record"):
        warc.parse_record(record[:-5])


def test_query_on_edge_rows_and_on_an_empty_table(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/full/pages.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/empty/pages.parquet")
    got = QUERIES["op13_warc"](spark, f"{tmp_path}/full")
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(rows, key=str) == plain_rows(ROWS)
    assert QUERIES["op13_warc"](spark, f"{tmp_path}/empty").count() == 0
