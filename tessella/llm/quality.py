"""Document quality by random Fourier features, ridge scores and isotonic calibration.

A text becomes a vector of statistics: lengths, shares of character classes,
repetition of words and lines. Standardised, they are mapped to random cosine
features whose inner products approximate a Gaussian kernel. The normal equations
of the ridge scores are summed in each partition, one sum for each fold; leaving
out a fold's sum gives the weights that score that fold. Those out-of-fold scores
calibrate: pool-adjacent-violators, joined linearly between the pools' centres.

Training takes at most about ``TRAIN_ROWS`` labelled rows, chosen by the hash of
their id; every document is scored, whole.

Defined cases: a null text counts as empty, which has a vector like any other;
null labels are skipped, repeated ones of an id averaged; of several texts with
one labelled id the one whose statistics hash lowest is learnt from; equal raw
scores are pooled; with fewer than ten labelled rows, or labels of one value, the
score is their mean (0.5 without any); a text of any length is read whole; repeated
and null ids keep one row each; extra columns of either table are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_sample, cut, map_texts

TRAIN_ROWS = 40_000
COSINES = 192
RIDGE = 1.0
FOLDS = 5
SUMS = 8
SEED = 20240229

_RUN = re.compile(rb"([^0-9A-Za-z\s\x80-\xff])\1")
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "high": range(128, 256),
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|<>{}[]\\/=_~^",
    "symbol": b"#$%&*@+",
    "quote": b"'\"()-",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
STATISTICS = len(_CLASSES) + 14


def statistics(text: str) -> np.ndarray:
    """The vector of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(STATISTICS)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, counts, minlength=len(_CLASSES) + 1)[:-1] / len(raw)
    out[: len(_CLASSES)] = np.sqrt(shares)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / len(raw)
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    ends = sum(w[-1] in b".!?" for w in words)
    out[len(_CLASSES) :] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        distinct / n,
        np.log1p(n) - np.log1p(distinct),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        -(p * np.log2(p)).sum(),
        np.sqrt(len(_RUN.findall(raw)) / n),
        np.sqrt(ends / n),
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.istitle, words)) / n,
    )
    return out


def _cosines(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant."""
    draw = np.random.default_rng(SEED)
    width = np.sqrt(2 * x.shape[1])
    turn = draw.normal(size=(x.shape[1], COSINES)) / width * 2
    shift = draw.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ turn + shift), np.ones((len(x), 1))])


def pool_adjacent(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: (mean score, mean label) of each pool, both increasing."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of labels, sum of scores, rows
    for s, v in zip(scores[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, s, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    table = np.array(pools)
    return table[:, 1] / table[:, 2], table[:, 0] / table[:, 2]


class Model:
    """Weights and calibration; ``constant`` where nothing could be learnt."""

    def __init__(self, constant: float = 0.5, centre=None, scale=None, weights=None, knots=None):
        self.constant, self.centre, self.scale, self.weights, self.knots = constant, centre, scale, weights, knots

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores of rows of statistics."""
        if self.weights is None:
            return np.full(len(x), self.constant)
        raw = _cosines(x, self.centre, self.scale) @ self.weights
        at, value = self.knots
        # beyond the outer pools the score goes on towards 0 and 1, so ties stay rare
        at = np.concatenate([[at[0] - 1], at, [at[-1] + 1]])
        value = np.concatenate([[0.0], value, [1.0]])
        return np.clip(np.interp(raw, at, value), 0, 1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fits the model to ``labels`` (which must hold training rows only)."""
    labelled = cut(
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    )
    sample = bounded_sample(labelled, "id", train_rows)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    ).join(F.broadcast(sample), "id")  # train_rows rows at most

    def make():
        return lambda batch: [pa.array([statistics(t).tobytes() for t in batch], pa.binary())]

    rows_of = map_texts(texts, ["id", "y"], "text", T.StructType([T.StructField("x", T.BinaryType())]), make)
    # of an id's texts one is learnt from, so what follows is bounded by the sample
    one = rows_of.groupBy("row.id").agg(F.min(F.struct(F.xxhash64("res.x").alias("h"), F.col("row.y").alias("y"), F.col("res.x").alias("x"))).alias("s"))
    known = cut(one.select("id", "s.y", "s.x"))

    def moments(batches):
        n, one, two, y = 0, np.zeros(STATISTICS), np.zeros(STATISTICS), 0.0
        for batch in batches:
            x, t = _arrays(batch)
            n, one, two, y = n + len(x), one + x.sum(0), two + (x**2).sum(0), y + t.sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n, y], one, two]).tobytes()], pa.binary())], names=["sums"])

    spread = known.repartition(SUMS, "id")
    total = sum((np.frombuffer(r.sums) for r in spread.mapInArrow(moments, "sums binary").collect()), np.zeros(2 + 2 * STATISTICS))
    n = int(total[0])
    share = total[1] / n if n else 0.5
    if n < 10 or not 0 < share < 1:
        return Model(constant=float(share))
    centre = total[2 : 2 + STATISTICS] / n
    scale = np.sqrt(np.maximum(total[2 + STATISTICS :] / n - centre**2, 0)) + 1e-9

    size = COSINES + 1

    def equations(batches):
        sums = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            x, t = _arrays(batch)
            z = _cosines(x, centre, scale)
            fold = np.array(batch.column(0).to_pylist()) % FOLDS
            for f in range(FOLDS):
                own = z[fold == f]
                sums[f] += own.T @ np.hstack([own, t[fold == f, None]])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = sum(np.frombuffer(r.sums) for r in spread.mapInArrow(equations, "sums binary").toLocalIterator())
    sums = sums.reshape(FOLDS, size, size + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :size] + RIDGE * np.eye(size), s[:, size])

    per_fold = [solve(sums.sum(0) - sums[f]) for f in range(FOLDS)]

    def left_out(batches):
        for batch in batches:
            x, t = _arrays(batch)
            fold = np.array(batch.column(0).to_pylist()) % FOLDS
            z = _cosines(x, centre, scale)
            raw = np.einsum("ij,ij->i", z, np.array(per_fold)[fold]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(t)], names=["raw", "y"])

    pairs = spread.mapInArrow(left_out, "raw double, y double").orderBy("raw", "y").collect()
    knots = pool_adjacent(np.array([r.raw for r in pairs]), np.array([r.y for r in pairs]))
    return Model(float(share), centre, scale, solve(sums.sum(0)), knots)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(2).to_pylist()
    x = np.array([np.frombuffer(r) for r in raw]).reshape(len(raw), STATISTICS)
    return x, np.array(batch.column(1).to_pylist(), dtype=float)


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the ``carry`` columns) and ``res.score``."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(model.predict(np.array([statistics(t) for t in texts])), pa.float64())]

        return work

    return map_texts(docs, carry, text_col, T.StructType([T.StructField("score", T.DoubleType())]), make)
