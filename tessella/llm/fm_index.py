"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is one Arrow batch of documents. Its words are mapped to the benchmark's
vocabulary; a run of words that cannot take part in any occurrence - a word or a
pair of neighbours that no benchmark item has, or a run shorter than the shortest
test phrase - is replaced by a separator, which loses no occurrence and keeps
the index small. Over what remains stands an FM-index: the suffix order by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions
sampled at every eighth word and at each start of a run. All test phrases are
searched backward at once by wavelet ranks, their occurrences located by walking
to the next sampled position, and the words they cover merged to removal spans.

The test phrases are every 13 consecutive words of an item; an item of fewer
words is one phrase. They reach the workers in blocks of bounded size; several
blocks are searched in turn over the same rows, without a shuffle.

Defined cases: a null or empty text has no words, hence no hits and no phrases;
items with a null id are ignored; several items with one id count as one; equal
phrases of several items count for each; repeated documents and null document
ids keep one row each; a document of any length is searched whole; extra columns
of either table are ignored or, for documents, carried; an empty table on either
side gives zero hits or no rows.

Of the registered tables some hundredths of the words get into an index; the share
is that of runs whose every pair of neighbours some benchmark item has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import pack_texts

WINDOW = 13
SAMPLE_EVERY = 8
#: Bytes of benchmark text compiled into one block of test phrases.
BLOCK_BYTES = 4 << 20

#: Every byte that is no letter, digit or part of a longer UTF-8 sequence becomes a space.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """The lower-cased words of a text as bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each ``end``."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            before_end, before_start = ones[end], ones[start]
            end = np.where(one, zeros + before_end, end - before_end)
            start = np.where(one, zeros + before_start, start - before_start)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros_like(at)
        for _, ones, zeros in self.levels:
            before = ones[at]
            one = ones[at + 1] - before
            symbol = symbol << 1 | one
            at = np.where(one == 1, zeros + before, at - before)
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose separators (0) are all different, ordered by position."""
    separator = text == 0
    rank = np.where(separator, np.cumsum(separator) - 1, text + int(separator.sum()))
    span = 1
    while True:
        following = np.zeros(len(text), dtype=np.int64)
        following[: len(text) - span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(text), dtype=np.int64)
        fresh[1:] = key[1:] != key[:-1]
        place = np.cumsum(fresh) - 1
        if place[-1] == len(text) - 1:
            return order
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = place
        span *= 2


class FMIndex:
    """Count and locate phrases in a word sequence that ends with a separator (0)."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        previous = text[order - 1]
        self.size = len(text)
        self.tree = WaveletMatrix(previous, max(1, (sigma - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # a separator cannot be stepped over, so the position after one is always sampled
        kept = (order % SAMPLE_EVERY == 0) | (previous == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases (rows of one length) that occur."""
        which = np.arange(len(phrases))
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, k]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out = np.empty(len(rows), dtype=np.int64)
        index = np.arange(len(rows))
        steps = 0
        while len(rows):
            found = self.kept[rows + 1] > self.kept[rows]
            out[index[found]] = self.sampled[self.kept[rows[found]]] + steps
            index, rows = index[~found], rows[~found]
            symbol = self.tree.access(rows)
            rows = self.before[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """Compiled test phrases of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        pairs = set()
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            pairs.update(zip(words, words[1:], strict=False))
            for k in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + window]), set()).add(item_id)
        self.sigma = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.sigma + b for a, b in pairs), dtype=np.int64)
        self.single = np.zeros(self.sigma, dtype=bool)
        self.by_length: list[tuple[np.ndarray, list[list[int]]]] = []
        for length in sorted({len(p) for p in owners}):
            chosen = [p for p in owners if len(p) == length]
            self.by_length.append((np.array(chosen, dtype=np.int64), [sorted(owners[p]) for p in chosen]))
            if length == 1:
                self.single[[p[0] for p in chosen]] = True
        self.shortest = min((len(p) for p in owners if len(p) > 1), default=0)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Which positions of ``ids`` (0: unknown word or gap) an occurrence may cover."""
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        if self.shortest and len(ids) > 1:
            both = np.nonzero((ids[:-1] > 0) & (ids[1:] > 0))[0]
            pair = ids[both] * self.sigma + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked = np.zeros(len(ids) + 1, dtype=np.int8)
            linked[both[self.pairs[at] == pair] + 1] = 1
            edge = np.diff(linked)
            first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            long = last - first + 1 >= self.shortest
            np.add.at(cover, first[long], 1)
            np.add.at(cover, last[long] + 1, -1)
        return (np.cumsum(cover)[:-1] > 0) | self.single[ids]

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[int]]]]:
        """(phrase, position in ``ids``, phrase length, items of each phrase) by an FM-index."""
        kept = np.nonzero(self.candidates(ids))[0]
        if not len(kept):
            return
        # one separator after each run of neighbouring positions
        run = np.concatenate([[0], np.cumsum(np.diff(kept) > 1)])
        place = np.arange(len(kept)) + run
        text = np.zeros(place[-1] + 2, dtype=np.int64)
        text[place] = ids[kept]
        origin = np.zeros(len(text), dtype=np.int64)
        origin[place] = kept
        index = FMIndex(text, self.sigma)
        for phrases, items in self.by_length:
            which, low, high = index.search(phrases)
            if len(which):
                count = high - low
                phrase = np.repeat(which, count)
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield phrase, origin[index.locate(rows)], phrases.shape[1], items


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs (first, last) of words, overlapping and adjacent ones merged."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def search_batch(phrases: Phrases, texts: list[str], known: list[dict] | None = None) -> list[dict]:
    """Result rows of one shard; ``known`` holds those of earlier blocks, which are extended."""
    get = phrases.vocabulary.get
    parts, start, counts = [], [], []
    total = 0
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int64))  # the gap between documents
        start.append(total)
        counts.append(len(words))
        total += len(words) + 1
    starts = np.array(start, dtype=np.int64)
    rows = known or [{"n_words": n, "hits": [], "item_ids": [], "spans": []} for n in counts]
    found: dict[int, list[tuple[int, int]]] = {}
    for phrase, at, length, items in phrases.occurrences(np.concatenate(parts)):
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
            rows[d]["item_ids"] = sorted({*rows[d]["item_ids"], *items[p]})
        for d, w in zip(doc.tolist(), (at - starts[doc]).tolist(), strict=True):
            found.setdefault(d, []).append((w, w + length - 1))
    for d, runs in found.items():
        old = [(x["first"], x["last"]) for x in rows[d]["hits"]]
        merged = merge_runs(old + runs)
        place = [m.span() for m in _WORD.finditer(texts[d])]
        rows[d]["hits"] = [{"first": a, "last": b} for a, b in merged]
        rows[d]["spans"] = [{"start": place[a][0], "end": place[b][1]} for a, b in merged]
    return rows


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[Phrases]:
    """The benchmark compiled in as many blocks as its measured size needs."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [Phrases([(r.id, r.text) for r in items.filter(part == b).collect()], window) for b in range(blocks)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (the ``carry`` columns) and ``res``: words, hit word runs, item ids, removal spans.

    Spans count code points, end exclusive.
    """
    frame, texts_of = pack_texts(docs, carry, text_col)
    shipped = frame.schema.fields
    arrow = pa.struct(
        [
            ("n_words", pa.int64()),
            ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            ("item_ids", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )
    schema = T.StructType([*shipped, T.StructField("res", RESULT)])
    for number, phrases in enumerate(phrase_blocks(benchmark, item_id, item_text, window, block_bytes)):

        def run(batches, phrases=phrases, later=number > 0):
            for batch in batches:
                if batch.num_rows:
                    known = batch.column(len(shipped)).to_pylist() if later else None
                    rows = search_batch(phrases, texts_of(batch), known)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[: len(shipped)], pa.array(rows, arrow)], names=schema.fieldNames()
                    )

        frame = frame.mapInArrow(run, schema)
    return frame.select("row", "res")


def hit_words(res: str = "res"):
    """Number of hit words of a result row."""
    return F.aggregate(f"{res}.hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def contaminated(res: str = "res"):
    """The contamination rule: a twentieth of the words, and one at least, are hit."""
    return (hit_words(res) > 0) & (hit_words(res) * 20 >= F.col(f"{res}.n_words"))
