"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is first cut at boundaries where no token of the split pattern can
span: between a non-space character and a white-space character. Such cuts
leave every match of the pattern, and so every id, as it was, while they bound
the work of one library call. Where a stretch has no such boundary, its matches
are found one by one with the ``regex`` library and encoded singly. A single
match of great length is cut once more, between two bytes that stand side by side
in no token of the rank file: no merge can cross such a place. Decoding joins raw
bytes, never text, so a token that holds part of a UTF-8 sequence is restored
exactly.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to no bytes; a text of any length is encoded whole, a run of millions of
equal characters included; a null, repeated or tied id is carried through, one
output row for each input row; extra columns, whatever their names, are only
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import map_texts

#: Python's white space without U+001C..U+001F, which the split pattern does not count as space.
_SAFE_CUT = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")
LONG_TEXT = 1 << 16


class Encoding:
    """The library's encoder with what is needed to cut long texts."""

    def __init__(self, rank_file: str, pattern: str):
        import regex
        import tiktoken

        ranks = {}
        with open(rank_file, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        #: Whether two bytes stand side by side in some token.
        self.adjacent = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            raw = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            self.adjacent[raw[:-1] << 8 | raw[1:]] = True

    def encode_match(self, match: str, size: int) -> list[int]:
        """Ids of one match of the pattern."""
        raw = match.encode("utf-8", "surrogatepass")
        out: list[int] = []
        for piece in self.apart(raw, size) if len(raw) > size else (raw,):
            out += self.library._core_bpe.encode_single_piece(piece)
        return out

    def apart(self, raw: bytes, size: int) -> Iterator[bytes]:
        """``raw`` in pieces of about ``size`` bytes, cut only where no token can reach across."""
        start = 0
        for look in range(size, len(raw), size):
            if look <= start:
                continue
            near = np.frombuffer(raw, dtype=np.uint8, offset=look - 1, count=min(size + 1, len(raw) - look + 1)).astype(np.int64)
            free = np.nonzero(~self.adjacent[near[:-1] << 8 | near[1:]])[0]
            if len(free):
                yield raw[start : look + int(free[0])]
                start = look + int(free[0])
        yield raw[start:]


@functools.lru_cache(maxsize=2)
def load_encoding(rank_file: str, pattern: str) -> Encoding:
    """The encoder over a rank file: one base64 token and its rank on each line."""
    return Encoding(rank_file, pattern)


def encode_text(encoding: Encoding, text: str, size: int = LONG_TEXT) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.array(encoding.library.encode_ordinary(text), dtype="<u4")
    parts, start = [], 0
    while start < len(text):
        cut = _SAFE_CUT.search(text, start + size, start + 2 * size) if len(text) - start > size else None
        if cut or len(text) - start <= size:
            end = cut.start() if cut else len(text)
            parts.append(np.array(encoding.library.encode_ordinary(text[start:end]), dtype="<u4"))
        else:  # a stretch without a safe cut: match by match, until well into it
            end = start
            for match in encoding.matches.finditer(text, start):
                parts.append(np.array(encoding.encode_match(match[0], size), dtype="<u4"))
                end = match.end()
                if end - start >= size:
                    break
        start = end
    return np.concatenate(parts)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (binary, little-endian u32) and ``decoded`` to the ``carry`` columns in ``row``.

    ``decoded`` holds the raw bytes that the ids stand for.
    """
    result = T.StructType(
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    )

    def make():
        encoding = load_encoding(rank_file, pattern)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [encode_text(encoding, t) for t in texts]
            return [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([decode_ids(encoding, x) for x in ids], pa.binary()),
            ]

        return work

    return map_texts(docs, carry, text_col, result, make)


def decode_ids(encoding: Encoding, ids: np.ndarray, step: int = 1 << 20) -> bytes:
    """The raw bytes of ids."""
    return b"".join(encoding.library.decode_bytes(ids[k : k + step].tolist()) for k in range(0, len(ids), step))
