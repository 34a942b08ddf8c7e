"""Text operators against brute-force versions, on real rows and on edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.llm import bpe, fm_index, html_main, pii, records, simhash
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [
    (1, "", 1), (2, None, 2), (3, " \n\t ", 3), (4, "One two three four", 4), (5, "One two three four", 5), (5, "One two three four", 5),
    (None, "null id here now", 6), (None, None, 7), (6, "x" * 50_000, 8), (7, "word " * 20_000, 9), (8, "é😀 ñandú x'll don't\x1c!", 10),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, row long").withColumn("res", F.lit("clash")).withColumn("spans", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def edge_dir(spark, edge, tmp_path_factory):
    """A folder of tables with edge cases, and one of empty tables."""
    full, empty = str(tmp_path_factory.mktemp("full")), str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        source = spark.read.parquet(f"{DATA}/{name}.parquet")
        source.limit(0).write.parquet(f"{empty}/{name}.parquet")
        if name == "documents":
            edge.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{full}/{name}.parquet")
        else:
            nulls = spark.createDataFrame([tuple([None] * len(source.columns))], source.schema)
            source.limit(30).unionByName(nulls).unionByName(nulls).write.parquet(f"{full}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", list(QUERIES))
def test_edge_cases_and_empty_tables(spark, edge_dir, name):
    full, empty = edge_dir
    assert QUERIES[name](spark, empty).count() == 0
    found = QUERIES[name](spark, full)
    n = {"op8_main_text": 32, "op10_embedding_dedup": 32, "op13_warc": 32}.get(name, len(EDGE))
    if name == "op11_conversations":
        n = spark.read.parquet(f"{full}/conversations.parquet").select("conv_id").distinct().count()
    if name == "pipeline":
        assert 0 < found.count() < n
    else:
        assert found.count() == n


def match_by_match(encoding, text):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    return [i for m in pattern.findall(text) for i in encoding.library._core_bpe.encode_single_piece(m.encode())]


def test_bpe_equals_library_and_round_trips(spark, documents, edge):
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    out = bpe.round_trip(edge, RANKS, public_tokenizers.PATTERN, ["row", "text"])
    texts = {r: t or "" for _, t, r in EDGE}
    for r in out.collect():
        text = texts[r.row.row]
        assert np.frombuffer(r.res.ids, "<u4").tolist() == encoding.library.encode_ordinary(text) and bytes(r.res.decoded) == text.encode()
    for _, text in documents[:60]:
        for size in (4, 64):
            assert bpe.encode_text(encoding, text, size).tolist() == match_by_match(encoding, text)


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \n\t", "x", "=", "\u3000", "7"])
def test_bpe_of_long_runs(run):
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    for n in (1, 63, 64, 65, 200):
        for text in (run * n, f"a{run * n}", f"{run * n}b c", f"a b{run * n} c{run * n}'s{run * n}"):
            assert bpe.encode_text(encoding, text, 16).tolist() == match_by_match(encoding, text)
    text = f"a{run * 1_000_000}b"
    ids = bpe.encode_text(encoding, text)
    assert ids.tolist() == match_by_match(encoding, text) and bpe.decode_ids(encoding, ids) == text.encode()


def test_bpe_of_five_and_twenty_million_spaces():
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    one, last = encoding.library.encode_ordinary(" "), encoding.library.encode_ordinary(" x")
    for n in (5_000_000, 20_000_000):
        ids = bpe.encode_text(encoding, " " * n + "x")
        assert len(ids) == n and (ids[:-1] == one[0]).all() and ids[-1:].tolist() == last


def test_records(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    start = 0
    found = {r.doc_id: r for r in QUERIES["op5_token_records"](spark, DATA).collect()}
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (found[doc_id].start, found[doc_id].n_tokens, found[doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    encoder = records.PieceEncoder(path)
    for text in [t or "" for _, t, _ in EDGE] + ["'s 'sx a'b's a_b__c'll 1'st \x85 y  z", "日本語。テスト'm", "a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext|", "x  <|endoftext|>  \n y"]:
        assert np.frombuffer(encoder.encode_many([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    few = spark.createDataFrame([(2, "b"), (1, "a"), (None, "n")], "doc_id long, text string")
    records.write_records(few, str(tmp_path / "r"), path)
    plain = {(r.doc_id, tuple(r.ids)) for r in records.read_ids(spark, str(tmp_path / "r")).collect()}
    assert plain == {(r.doc_id, tuple(r.ids)) for r in records.read_ids(spark, str(tmp_path / "r"), seed=3).collect()} and len(plain) == 3
    assert [r.doc_id for r in records.read_ids(spark, str(tmp_path / "r")).collect()] == [None, 1, 2]
    orders = {tuple(r.doc_id for r in records.read_ids(spark, str(tmp_path / "r"), seed=k).collect()) for k in range(8)}
    assert len(orders) > 1
    numbers = spark.createDataFrame([("part-99999-x.txt",), ("part-100000-x.txt",)], "file string").orderBy(records.file_number("file"))
    assert [r.file for r in numbers.collect()] == ["part-99999-x.txt", "part-100000-x.txt"]
    assert [r.doc_id for r in records.layout(spark, str(tmp_path / "r")).orderBy("start").collect()] == [None, 1, 2]


def test_pieces_of_texts_are_cut_at_once(monkeypatch):
    import random
    import re

    from tokenizers import Tokenizer

    space = r"[^\S\x1c-\x1f]"
    plain = re.compile(rf"{space}*[^\W_]+|{space}*(?:_|[^\w\s]|[\x1c-\x1f])+(?:(?<=')[^\W_]+)?|{space}+")
    rng, marks = random.Random(3), [*" \t\n\u3000\x1c\x1f\x85'_-.,aZ9é日①\u0301🙂", "'s", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(500)]
    found, ends = records.pieces_of(texts)
    found = found.to_pylist()
    assert [found[a:b] for a, b in zip(ends[:-1], ends[1:])] == [plain.findall(t) for t in texts]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for stretch in (1 << 23, 7):
        monkeypatch.setattr(records, "STRETCH", stretch)
        encoder = records.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
        assert encoder.joint and [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_many(texts)] == want
        encoder = records.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
        encoder.joint = None  # as with no special token, or several
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_many(texts)] == want
    assert encoder.encode_many([]) == [] and encoder.encode_many(["", ""]) == [b"", b""]


def test_damaged_record_is_found():
    whole = records.frame(7, b"\x01\x00\x02\x00", 2)
    ((at, size, doc_id, ids),) = records.frames(whole)
    assert (at, size, doc_id, ids.tolist()) == (0, len(whole), 7, [1, 2])
    for k in range(len(whole) - 1):
        broken = bytearray(whole)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))


def naive_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    rows = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    votes = [sum(xxh64_intdigest(r, 42) >> b & 1 for r in rows) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(rows))


def naive_components(fp):
    least = {k: k for k in fp}
    def root(x):
        while least[x] != x:
            x = least[x]
        return x
    keys = sorted(fp)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {k: root(k) for k in fp}


def test_simhash(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, DATA).collect()}
    fp = {i: naive_fingerprint(t) for i, t in documents}
    assert all(found[i].fingerprint == f"{f:016x}" for i, f in fp.items())
    assert {i: r.component_id for i, r in found.items()} == naive_components(fp)


@pytest.mark.parametrize("pairwise", [2, 64])
def test_simhash_links_lose_nothing(spark, pairwise):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 6)
    values = set()
    for b in base:  # balls of near fingerprints, crowded keys among them
        for _ in range(40):
            v = int(b)
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                v ^= simhash._signed(1 << int(bit))
            values.add(v)
    fp = {v: v & (2**64 - 1) for v in values}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(df, pairwise)
    assert all((fp[r.a] ^ fp[r.b]).bit_count() <= 2 for r in edges.collect())
    from tessella.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    expected = naive_components(fp)
    assert {v: found.get(v, v) for v in values} == expected


def test_golay_code_is_perfect():
    remainder, pattern = simhash.golay_table()
    assert np.bincount([int(p).bit_count() for p in pattern]).tolist() == [1, 23, 253, 1771]
    words = np.arange(0, 1 << 23, 977)
    code = words ^ pattern[(words & 0x7FF) ^ remainder[words >> 11]]
    assert (((code & 0x7FF) ^ remainder[code >> 11]) == 0).all()


def test_simhash_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "other text here"), (2, "yet another one"), (None, "a b c d"), (4, None), (5, "")],
        "doc_id long, text string",
    )
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (2, "other text here"), (2, "yet another one"), (0, "a b c d"), (4, None)], key=str)


def naive_contamination(docs, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 22, 4_000])
def test_contamination(spark, documents, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    long = " ".join(t for _, t in items[:5])
    docs = [*documents, (900, long), (901, "the the the of"), (902, None), (903, items[0][1][:40]), (904, items[3][1] + " " + items[3][1])]
    items = [*items, (500, "of the"), (501, None), (502, "the"), (503, "the the the"), (77, "of the")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = fm_index.find_contamination(d, b, ["doc_id"], block_bytes=block_bytes).select(
        "row.doc_id", "res.n_words", fm_index.hit_words().alias("n_hit"), "res.item_ids", "res.spans"
    ).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found), key=str) == naive_contamination(docs, items)
    texts = dict(docs)
    for r in found:
        inside = sum(len(fm_index.words_of(texts[r.doc_id][s.start : s.end])) for s in r.spans)
        assert inside == r.n_hit


def naive_pii(text):
    def luhn(x):
        return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, x[::-1]))) % 10 == 0
    spans = []
    for rank, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


PII = [
    "mail a.b+c@x-y.example.com, x@y, a@b@c.org, a@b.com_x@y.org ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 000001.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5", "call +1 (988) 555-2485 or +49-30-1234567. +1 2 +(5) ++44 20 7946 0958",
    "é😀 a@b.co 日本 192.168.0.1", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and DE89 3704 0044 0532 0130 01", "", None, "9" * 30_000, "a" * 30_000, "1.1." * 8_000, "a@" + "b." * 8_000 + "c",
]


def test_pii(spark, documents):
    texts = [t for _, t in documents] + PII
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = df.select("doc_id", pii.pii_spans(F.col("text")).alias("spans")).join(df, "doc_id")
    found = found.select("doc_id", "spans", pii.masked(F.col("text"), F.col("spans")).alias("masked")).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE]
        assert base == naive_pii(text)
        assert all(text[s.start : s.end] == s.text for s in r.spans)
        merged, at = "", 0
        for s in r.spans:
            if s.start >= at:
                merged += text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert (r.masked or "") == (merged + text[at:] if r.spans else text)
    assert len(found) == len(texts)
    ibans = [s.text for r in found for s in r.spans if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


def test_context_decides(spark):
    texts = ["firmware version 10.2.0.1 runs", "login from 10.2.0.1 today", "10.2.0.1", "v 1.2.3.4 at a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.pii_spans(F.col("text"))
    found = df.select("doc_id", spans.alias("s"), pii.masked(F.col("text"), pii.likely(spans)).alias("m")).orderBy("doc_id").collect()
    assert [[s.score for s in r.s] for r in found] == [[0.3], [0.7], [0.6], [0.3, 0.9]]
    assert [r.m for r in found] == [texts[0], "login from [IP] today", "[IP]", "v 1.2.3.4 at [EMAIL]"]


def test_pii_of_very_many_spans(spark):
    text = "".join(f"x{k}@example.org 10.0.0.{k % 256} " for k in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.pii_spans(F.col("text"))
    r = df.select(spans.alias("s"), pii.masked(F.col("text"), spans).alias("m")).first()
    assert [f"{s.kind}:{s.start}:{s.end}" for s in r.s] == naive_pii(text) and r.m == "[EMAIL] [IP] " * 20_000


def test_pii_is_native(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.find_pii(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), (None, ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>x &amp; y&nbsp;z</p></article><p>out</p>", "x & y z"),
        ("<body><nav>menu</nav><div class='sidebar'>s</div><div><h1>T</h1>one<br>two</div><footer>f</footer></body>", "T\none two"),
        ("<article><p>in</p><div class='comments'><p>c</p></div><script>if (a</p>b) {}</script></article>", "in"),
        ("<!-- c <p>no</p> --><main><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></main>", "1\n2\na\nb"),
        ("<article><p><b>bold<br><p>next &am</article>", "bold\nnext &am"), ("a < b <3", "a < b <3"),
    ],
)
def test_main_text(page, text):
    assert html_main.main_text(page) == text


def test_site_template_goes_and_shared_prose_stays(spark):
    pages = [(k, f"http://h.test/{k}", f"<body><div class='x'><a href='/'>Site</a> slogan</div><p>shared prose</p><p>own {k}</p></body>") for k in range(30)]
    pages += [(99, "http://other.test/1", pages[0][2]), (100, None, "<p>x</p>"), (101, "::bad", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    found = {r.page_id: r.text for r in html_main.extract(df, ["page_id"]).select("row.page_id", "res.text").collect()}
    assert found[5] == "shared prose\nown 5" and found[99] == "Site slogan\nshared prose\nown 0" and found[100] == "x" and found[101] == ""
    joined = {r.page_id: r.text for r in html_main.extract(df, ["page_id"], broadcast_rows=0).select("row.page_id", "res.text").collect()}
    assert joined == found


def test_boxes_inside_articles_go_and_linked_words_stay(spark):
    box = "<div class='x1'>Get our app</div><ul><li><a href='/a'>More</a></li><li><a href='/b'>Most</a></li></ul>"
    # the box stands on 12 of 200 pages only
    pages = [
        (k, f"http://h.test/{k}", f"<article><h1>T {k}</h1><p>About <a href='/p'>Python</a> {k}.</p>{box if k < 12 else ''}"
            f"<ul><li>See <a href='/p'>Python</a> too</li></ul><table><tr><td><a href='/p'>Python</a></td><td>{k}</td></tr></table><div><p>Shared words.</p></div></article>")
        for k in range(200)
    ]
    pages += [(1000 + k, f"http://i.test/{k}", f"<body><p>About <a href='/p'>Python</a> and <b>more</b> {k}.</p></body>") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_main.extract(df, ["page_id"]).select("row.page_id", "res.text").collect()}
    for k in range(200):
        assert found[k] == f"T {k}\nAbout Python {k}.\nSee Python too\nPython\n{k}\nShared words."
    assert found[1003] == "About Python and more 3."


def test_recurring_boxes_of_any_name_go(spark):
    def page(k, host):
        top = f"<div class='zq1'><p>Welcome to {host}</p></div><zz-bar>Sign {host}</zz-bar>"
        return f"<body>{top}<section class='k7'><p>Own words {k}.</p><p>Shared prose.</p></section><div class='qx'><span>Made by {host}</span></div></body>"

    pages = [(k, f"http://h{k % 3}.test/{k}", page(k, f"h{k % 3}")) for k in range(9)]
    pages += [(50, "http://h0.test/long", "<body><div><p>" + "long words " * 200_000 + "</p></div><div class='qx'><span>Made by h0</span></div></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = lambda **k: {r.page_id: r.text for r in html_main.extract(df, ["page_id"], **k).select("row.page_id", "res.text").collect()}
    found, off = texts(), texts(min_pages=1000)
    assert texts(broadcast_rows=0) == found and len(found[50]) == len("long words ") * 200_000 - 1
    for k in range(9):
        assert f"Own words {k}.\nShared prose." in found[k] and "Made by" not in found[k] and "Sign" not in found[k]
        assert "Made by" in off[k] and "Sign" in off[k]


def test_copies_without_an_article_keep_their_text(spark):
    words = "Plain words that stand in one block of this page alone. "
    menu = "<div class='m'><a href='/a'>One</a> <a href='/b'>Two</a></div>"
    body = f"<div>{words * 22}</div>"
    parts = "".join(f"<div>Part {k}: {words}</div>" for k in range(12))
    box = "<div class='c'>We use cookies on this site.</div>"
    pages = [(k, f"http://h.test/{k}", f"<body>{menu}{box}{body}<div>Stamp {k}</div></body>") for k in range(2)]
    pages += [(10 + k, f"http://i.test/{k}", f"<body>{menu}{parts}<div>Stamp {k}</div></body>") for k in range(5)]
    pages += [(20 + k, f"http://j.test/{k}", f"<body>{menu}{box}<div>Own story {k}. {words * (k + 1)}</div></body>") for k in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_main.extract(df, ["page_id"]).select("row.page_id", "res.text").collect()}
    for k in range(2):
        assert found[k] == f"{(words * 22).strip()}\nStamp {k}"
    for k in range(5):
        assert found[10 + k] == "\n".join([*[f"Part {n}: {words}".strip() for n in range(12)], f"Stamp {k}"])
        assert found[20 + k] == f"Own story {k}. {words * (k + 1)}".strip()


def test_most_pages_have_template_subtrees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    sites = {}
    for r in html_main.site_templates(html_main.page_marks(pages)).collect():
        sites.setdefault(r.host, set()).add(r.hash)
    rows = pages.collect()
    touched = sum(html_main.drop_template(html_main.parse(r.html), sites.get(html_main.host_of(r.url), set())) > 0 for r in rows)
    print(touched)
    assert touched > 0.5 * len(rows)


def test_pages_equal_their_articles(spark):
    import html

    for r in QUERIES["op8_main_text"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").drop("url"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|br)[^>]*>", body)]
        assert r.text == "\n".join(p for p in parts if p)


def test_digest_columns(spark, documents):
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    found = {r.doc_id: r for r in QUERIES["op9_byte_bpe"](spark, DATA).collect()}
    for i, text in documents:
        ids = np.array(match_by_match(encoding, text), dtype="<u4")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
