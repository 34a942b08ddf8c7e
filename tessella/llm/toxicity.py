"""Toxicity by a classifier chain over hashed words and word beginnings.

The categories are predicted in a fixed order. Each has a linear (logistic) model
over the text's features and the probabilities of all categories before it.
While training, those earlier probabilities are out of fold - each row's comes
from models that never saw the row - so a later model learns from the errors that
an earlier one really makes. Scoring runs the chain with the final models.

Features are the presence of each word and, for words over five letters, of its
first five letters, hashed to 2**20 slots. Of these, the slots that separate some
category best (signed root of chi-square over the training rows) are kept.

Training takes at most about ``TRAIN_ROWS`` labelled rows, chosen by the hash of
their id; every document is scored.

Defined cases: a null text counts as empty and gets the probabilities of the
constant term; labels that are null are skipped, repeated ones of an id merged to
their maximum; of several texts with one labelled id the one whose slots hash
lowest is learnt from; ties between slots go to the lower slot; a category with
fewer than five rows of either value predicts its share of ones (0 without
labels); a text of any length is read whole; repeated and null ids keep one row
each; extra columns of either table are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_sample, cut, map_texts

TRAIN_ROWS = 20_000
SLOTS = 1 << 20
FEATURES = 4_096
#: A kept slot's count lies so many standard deviations from what chance would give.
STRENGTH = 4.0
FOLDS = 3
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose slots a worker remembers, and the letters of the longest of them.
REMEMBERED = 100_000
REMEMBERED_LETTERS = 40


class SlotHasher:
    """Feature slots of texts, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def slots(self, text: str) -> np.ndarray:
        """Sorted distinct slots of a text."""
        from xxhash import xxh32_intdigest

        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            slots = self.known.get(word)
            if slots is None:
                names = [word, f"{word[:5]}*"] if len(word) > 5 else [word]
                slots = tuple(xxh32_intdigest(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names)
                if len(word) <= REMEMBERED_LETTERS:
                    self.known[word] = slots
            out.update(slots)
        return np.array(sorted(out), dtype=np.int32)


class SparseRows:
    """Binary rows as (row, column) pairs, with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(rows), width, dense
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """The rows times ``weights`` (sparse columns, then dense ones)."""
        sparse = np.bincount(self.row, weights[self.col], minlength=self.n)
        return sparse + self.dense @ weights[self.width :]

    def back(self, values: np.ndarray) -> np.ndarray:
        """The transposed rows times ``values``."""
        sparse = np.bincount(self.col, values[self.row], minlength=self.width)
        return np.concatenate([sparse, self.dense.T @ values])


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function without overflow."""
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    """Its inverse, bounded."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(x: SparseRows, y: np.ndarray, used: np.ndarray, ridge: float = 1.0, rounds: int = 200, rate: float = 0.2) -> np.ndarray:
    """Ridge-penalised logistic weights of the ``used`` rows, by Adam on the full gradient."""
    weights = np.zeros(x.width + x.dense.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = max(1, int(used.sum()))
    for step in range(1, rounds + 1):
        error = np.where(used, sigmoid(x.dot(weights)) - y, 0.0)
        slope = x.back(error) / n + ridge * weights / n
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


class Chain:
    """A trained chain: the kept slots and one weight vector or constant for each category."""

    def __init__(self, categories: list[str], slots: np.ndarray, models: list[np.ndarray | float]):
        self.categories, self.slots, self.models = categories, slots, models

    def columns(self, slots: np.ndarray) -> np.ndarray:
        """Positions of a text's slots among the kept ones."""
        if not len(self.slots):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        return at[self.slots[at] == slots]

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        dense = np.ones((len(rows), 1))
        out = np.zeros((len(rows), len(self.models)))
        for k, model in enumerate(self.models):
            if isinstance(model, float):
                out[:, k] = model
            else:
                out[:, k] = sigmoid(SparseRows(rows, len(self.slots), dense).dot(model))
            dense = np.hstack([dense, logit(out[:, k : k + 1])])
        return out


def fit_chain(categories: list[str], slots: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """Trains each category on out-of-fold probabilities of those before it; NaN labels are skipped."""
    models: list[np.ndarray | float] = []
    dense = np.ones((len(rows), 1))
    for k in range(len(categories)):
        y = np.nan_to_num(labels[:, k])
        known = ~np.isnan(labels[:, k])
        share = float(y[known].mean()) if known.any() else 0.0
        if min((y[known] == 1).sum(), (y[known] == 0).sum()) < 5:
            models.append(share)
            earlier = np.full(len(rows), share)
        else:
            x = SparseRows(rows, len(slots), dense)
            models.append(fit_logistic(x, y, known))
            earlier = np.zeros(len(rows))
            for f in range(folds):
                weights = fit_logistic(x, y, known & (fold != f))
                earlier[fold == f] = sigmoid(x.dot(weights))[fold == f]
        dense = np.hstack([dense, logit(earlier)[:, None]])
    return Chain(categories, slots, models)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
    features: int = FEATURES,
) -> Chain:
    """Fits a chain; ``categories`` gives each label, in chain order, as an expression over ``labels``."""
    names = list(categories)
    merged = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    labelled = cut(merged.agg(*[F.max(e.cast("double")).alias(f"y{k}") for k, e in enumerate(categories.values())]))
    sample = bounded_sample(labelled, "id", train_rows)
    texts = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(sample), "id")  # train_rows rows at most
    )
    y = [f"y{k}" for k in range(len(names))]

    def make():
        hasher = SlotHasher()
        return lambda batch: [pa.array([hasher.slots(t).tobytes() for t in batch], pa.binary())]

    rows_of = map_texts(texts, ["id", *y], "text", T.StructType([T.StructField("slots", T.BinaryType())]), make)
    # of an id's texts one is learnt from, so what follows is bounded by the sample
    one = rows_of.groupBy("row.id").agg(F.min(F.struct(F.xxhash64("res.slots").alias("h"), "row", "res")).alias("x"))
    found = cut(one.select("x.row", "x.res"))

    def count(batches):
        total = np.zeros((1 + 2 * len(names), SLOTS), dtype=np.int32)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for row, raw in zip(rows, batch.column(1).field("slots").to_pylist(), strict=True):
                slots = np.frombuffer(raw, dtype=np.int32)
                total[0, slots] += 1
                for k in range(len(names)):
                    if row[f"y{k}"] is not None:
                        total[1 + 2 * k, slots] += 1
                        total[2 + 2 * k, slots] += row[f"y{k}"] == 1
        seen = np.nonzero(total[0])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), *[pa.array(t[seen], pa.int64()) for t in total[1:]]],
            names=["slot", *[f"{c}{k}" for k in range(len(names)) for c in ("n", "p")]],
        )

    counted = found.coalesce(16).mapInArrow(
        count, "slot long, " + ", ".join(f"n{k} long, p{k} long" for k in range(len(names)))
    )
    sums = counted.groupBy("slot").agg(*[F.sum(c).alias(c) for k in range(len(names)) for c in (f"n{k}", f"p{k}")])
    totals = sample.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in y for f in (F.count, F.sum)]).first()
    kept: set[int] = set()
    for k, c in enumerate(y):
        n, p = totals[f"count_{c}"] or 0, totals[f"sum_{c}"] or 0.0
        if not 0 < p < n:
            continue
        expected = F.col(f"n{k}") * F.lit(p / n)
        strength = F.abs(F.col(f"p{k}") - expected) / F.sqrt(expected * (1 - p / n))
        best = sums.filter((F.col(f"n{k}") >= 5) & (strength >= STRENGTH)).orderBy(strength.desc(), "slot").limit(features // len(names))
        kept.update(r.slot for r in best.select("slot").collect())
    chain = Chain(names, np.array(sorted(kept), dtype=np.int32), [])
    slots = chain.slots

    def select(batches):
        for batch in batches:
            cut_rows = [
                chain.columns(np.frombuffer(raw, dtype=np.int32)).astype(np.int32).tobytes()
                for raw in batch.column(1).field("slots").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut_rows, pa.binary())], names=["row", "cols"])

    schema = T.StructType([found.schema["row"], T.StructField("cols", T.BinaryType())])
    table = found.mapInArrow(select, schema).select("row.id", *[f"row.{c}" for c in y], "cols").orderBy("id", "cols").collect()
    rows = [np.frombuffer(r.cols, dtype=np.int32) for r in table]
    target = np.array([[np.nan if r[c] is None else r[c] for c in y] for r in table], dtype=float).reshape(len(rows), len(names))
    fold = np.arange(len(rows)) % FOLDS
    return fit_chain(names, slots, rows, target, fold)


def score(docs: DataFrame, chain: Chain, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the ``carry`` columns) and ``res``: a probability for each category."""
    result = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories])

    def make():
        hasher = SlotHasher()

        def work(texts: list[str]) -> list[pa.Array]:
            p = chain.predict([chain.columns(hasher.slots(t)) for t in texts])
            return [pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])]

        return work

    return map_texts(docs, carry, text_col, result, make)


def categories_of_labels() -> dict[str, Column]:
    """The chain over the labels table: low quality first, toxic given it."""
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
