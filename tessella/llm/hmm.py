"""Language-model scores by a hidden Markov model over words.

Each token of a text - its words, then one end - is emitted by a latent state.
A state emits one of the ``HEAD`` commonest words, the end, or a class of rarer
words (by the word's last two bytes); within a class a word has its smoothed
corpus share, unseen words together that of half an occurrence. So the model is
a distribution over all texts and the likelihood of a text is exact.

Word counts come from the whole training corpus in one shuffle, pre-aggregated in
each task. Baum-Welch starts from corpus shares shaken at random; each of ``ROUNDS``
passes over the whole training corpus sums the expected counts inside the tasks,
the tasks' sums ``FAN`` at a time on as many levels as it takes, and re-estimates
the model. Texts are trained on and scored whole: a long one goes through the
recursions in parts side by side, with the exact messages at their borders, so memory
stays bounded and no transition is lost. What is kept in memory or sent to the driver is bounded
by the model's size. Counts of rare words never leave the cluster: the rare words
of the texts are joined with them.

Defined cases: a null text counts as empty, whose only token is the end; a null
id counts as training and is carried; repeated rows are trained on and scored one
by one; words of one count are told apart by their hash where not all find room
among the common ones; extra columns are ignored; without training rows every word
is unseen and the emissions stay uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bound_batches, crc_bucket, cut, scratch_path

STATES = 8
HEAD = 65_000
CLASSES = 64
#: Baum-Welch passes over the corpus.
ROUNDS = 8
#: Texts longer than this go through the recursions alone, in parts of STRETCH tokens side by side.
LONG = 16_384
STRETCH = 512
#: Sums of tasks that are added at a time.
FAN = 32
SMOOTHING = 30.0
#: Symbols of a model: the end, the classes of rarer words, the common words.
END, FIRST_CLASS, FIRST_WORD = 0, 1, 1 + CLASSES
BLOCK = 4096
CHUNK_TOKENS = 1_000_000
#: Rows of word counts after which a task adds those of equal words.
MERGED = 1_000_000
#: Sequences up to two to this power in length go together, longer ones with those up to the next power of two.
LEAST = 7


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, as bytes, and for each the place of its text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty words
    return words.filter(real).cast(pa.binary()), owner[real.to_numpy(zero_copy_only=False)]


def class_of(word: bytes) -> int:
    """Class of a rarer word."""
    return zlib.crc32(word[-2:]) % CLASSES


@cache
def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes by a word's only byte, and by its last two."""
    one = np.array([class_of(bytes([b])) for b in range(256)])
    return one, np.array([class_of(bytes([a, b])) for a in range(256) for b in range(256)])


def classes_of(words: pa.Array) -> np.ndarray:
    """:func:`class_of` every word of a binary array without nulls, none empty."""
    one, two = _class_tables()
    ends = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.empty(0, np.uint8)
    last, before = data[ends[1:] - 1], data[ends[1:] - 2].astype(np.int64)
    return np.where(np.diff(ends) > 1, two[before * 256 + last], one[last])


class Model:
    """Start, transition and emission (symbols x states) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def fresh(share: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Sticky states whose emissions are the corpus shares, each shaken at random."""
        shaken = share[:, None] * np.random.default_rng(seed).gamma(4.0, size=(len(share), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        return Model(np.full(states, 1 / states), move, shaken / shaken.sum(0))


def _stacked(sequences: list[np.ndarray]):
    """Sequences by falling length, as flat time-major symbols with the number alive at each step."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    offset = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(int(offset[-1]), dtype=np.int64)
    for place, i in enumerate(order):
        flat[offset[: sizes[place]] + place] = sequences[i]
    return order, alive, offset, flat


def _emitted(model: Model, flat: np.ndarray) -> np.ndarray:
    """Emission probabilities, states x symbols of ``flat``, gathered a cache-sized piece at a time."""
    out = np.empty((len(model.start), len(flat)), dtype=model.emit.dtype)
    for k in range(0, len(flat), 1 << 14):
        out[:, k : k + (1 << 14)] = model.emit.take(flat[k : k + (1 << 14)], axis=0).T
    return out


def _scores(model: Model, sequences: list[np.ndarray], prior: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihood of each sequence, whose first state has the distribution in its column of ``prior``."""
    order, alive, offset, flat = _stacked(sequences)
    emitted, step = _emitted(model, flat), np.ascontiguousarray(model.move.T)
    total = np.zeros(len(sequences))
    alpha = np.tile(model.start[:, None], len(sequences)) if prior is None else prior[:, order]
    for t, n in enumerate(alive):
        alpha = (step @ alpha[:, :n] if t else alpha) * emitted[:, offset[t] : offset[t + 1]]
        scale = alpha.sum(0)
        alpha /= scale
        total[:n] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def _carried(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    """For each part, up to a factor, the probability of its symbols and last state given its first: last x part x first."""
    order, alive, offset, flat = _stacked(parts)
    emitted, step = _emitted(model, flat), np.ascontiguousarray(model.move.T)
    states = len(model.start)
    done = np.empty((states, len(parts), states))
    now = np.repeat(np.eye(states)[:, None, :], len(parts), axis=1)
    for t, n in enumerate(alive):
        if t:
            done[:, n : now.shape[1]] = now[:, n:]
            now = (step @ now[:, :n].reshape(states, -1)).reshape(states, n, states)
        now = now * emitted[:, offset[t] : offset[t + 1], None]
        now /= now.sum(0).sum(1)[:, None]
    done[:, : now.shape[1]] = now
    out = np.empty_like(done)
    out[:, order] = done
    return out


class Messages:
    """What the recursions carry over the borders of a long sequence's parts, exactly.

    The parts are run through side by side, once from each state; the products
    of the resulting matrices give the messages at every border. ``prior``: the
    first state's distribution in each part; ``entry``: the forward message at
    the end of the part before, zero for the first; ``after``: the backward
    message behind each part, up to a factor.
    """

    def __init__(self, model: Model, parts: list[np.ndarray], room: int):
        states = len(model.start)
        whole = Model(*(x.astype(np.float64) for x in (model.start, model.move, model.emit)))
        over = np.concatenate([_carried(whole, parts[k : k + room]) for k in range(0, len(parts), room)], axis=1)
        self.prior, self.entry = np.empty((states, len(parts))), np.zeros((states, len(parts)))
        self.after = np.ones((states, len(parts)))
        self.prior[:, 0] = whole.start
        for k in range(len(parts) - 1):
            end = over[:, k] @ self.prior[:, k]
            self.entry[:, k + 1] = end / end.sum()
            self.prior[:, k + 1] = self.entry[:, k + 1] @ whole.move
        for k in range(len(parts) - 1, 0, -1):
            back = whole.move @ (self.after[:, k] @ over[:, k])
            self.after[:, k - 1] = back / back.sum()


def _parts(ids: np.ndarray, stretch: int) -> tuple[list[np.ndarray], int]:
    """A long sequence in parts of ``stretch`` symbols, and how many go together."""
    return [ids[k : k + stretch] for k in range(0, len(ids), stretch)], max(1, CHUNK_TOKENS // stretch)


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence of symbols, none empty."""
    out = np.empty(len(sequences))
    short = [k for k, s in enumerate(sequences) if len(s) <= LONG]
    if short:
        out[short] = _scores(model, [sequences[k] for k in short])
    for k, s in enumerate(sequences):
        if len(s) > LONG:
            parts, room = _parts(s, STRETCH)
            prior = Messages(model, parts, room).prior
            out[k] = sum(_scores(model, parts[j : j + room], prior[:, j : j + room]).sum() for j in range(0, len(parts), room))
    return out


def chunks(sequences: Iterator[np.ndarray], tokens: int = CHUNK_TOKENS) -> Iterator[list[np.ndarray]]:
    """Sequences in lists of about ``tokens`` symbols, each of like lengths, so that few steps run over few; long ones alone.

    What is left of every length at the end goes together again, longest first.
    """
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    for s in sequences:
        if len(s) > LONG:
            yield [s]
            continue
        k = max(LEAST, (len(s) - 1).bit_length())
        held.setdefault(k, []).append(s)
        size[k] = size.get(k, 0) + len(s)
        if size[k] >= tokens:
            yield held.pop(k)
            size[k] = 0
    rest, total = [], 0
    for s in sorted((s for group in held.values() for s in group), key=len, reverse=True):
        rest.append(s)
        total += len(s)
        if total >= tokens:
            yield rest
            rest, total = [], 0
    if rest:
        yield rest


class Counts:
    """Expected counts of a Baum-Welch pass."""

    def __init__(self, symbols: int, states: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((symbols, states))

    def add(self, model: Model, sequences: list[np.ndarray], borders: tuple[np.ndarray, ...] | None = None) -> None:
        """Adds the expected counts of sequences under ``model``.

        ``borders`` are prior, entry and after (see :class:`Messages`) of
        sequences that are parts of longer ones.
        """
        order, alive, offset, flat = _stacked(sequences)
        states, kind = len(model.start), model.emit.dtype
        emitted, step = _emitted(model, flat), np.ascontiguousarray(model.move.T)
        prior, entry, after = (x[:, order].astype(kind) for x in borders) if borders else (None, None, None)
        alphas = np.empty_like(emitted)
        alpha = prior if borders else np.tile(model.start[:, None], len(sequences))
        for t, n in enumerate(alive):
            at = slice(offset[t], offset[t + 1])
            alpha = np.multiply(step @ alpha[:, :n] if t else alpha, emitted[:, at], out=alphas[:, at])
            scale = alpha.sum(0)
            alpha /= scale
            emitted[:, at] /= scale
        beta = np.ones((states, len(sequences)), dtype=kind)
        if borders:
            ends = offset[[len(sequences[i]) - 1 for i in order]] + np.arange(len(order))
            beta = after / (alphas[:, ends] * after).sum(0)
        moved, later = np.zeros((states, states)), None  # later: scaled emission times beta of the next step
        for t in range(len(alive) - 1, -1, -1):
            a, n = offset[t], alive[t]
            if later is not None:
                m = later.shape[1]
                moved += alphas[:, a : a + m] @ later.T
                beta[:, :m] = model.move @ later
            later = emitted[:, a : a + n] * beta[:, :n]
            alphas[:, a : a + n] *= beta[:, :n]
        first = alphas[:, : alive[0]]
        if borders:
            moved += entry @ later.T
            first = first[:, ~entry.any(0)]
        self.start += first.sum(1)
        self.move += model.move * moved
        for k in range(states):
            self.emit[:, k] += np.bincount(flat, alphas[k], minlength=len(self.emit))

    def add_long(self, model: Model, ids: np.ndarray, stretch: int = STRETCH) -> None:
        """Adds the expected counts of one long sequence, whose parts go side by side."""
        parts, room = _parts(ids, stretch)
        held = Messages(model, parts, room)
        for k in range(0, len(parts), room):
            at = slice(k, k + room)
            self.add(model, parts[at], (held.prior[:, at], held.entry[:, at], held.after[:, at]))

    def model(self, share: np.ndarray) -> Model:
        """The re-estimated model; corpus shares smooth each state's emissions."""
        start, move = self.start + 1, self.move + 1
        emit = self.emit + SMOOTHING * share[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _added(tables: list[pa.Table]) -> pa.Table:
    """``word``, ``c`` with the counts of equal words added."""
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (binary), ``c`` over all texts; the empty word counts the ends."""

    def run(batches):
        held, rows, ends = [], 0, 0
        for batch in batches:
            words, _ = words_of(batch.column(0))
            found = words.value_counts()
            held.append(pa.table({"word": found.field(0), "c": found.field(1)}))
            rows += len(found)
            ends += batch.num_rows
            if rows > MERGED:
                merged = _added(held)
                if len(merged) > MERGED // 2:
                    yield from merged.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [merged], len(merged)
        if held:
            yield from _added([*held, pa.table({"word": pa.array([b""], pa.binary()), "c": pa.array([ends], pa.int64())})]).to_batches()
        elif ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.coalesce(crc_bucket(F.col(f"`{id_col}`"), folds) == held_fold, F.lit(False)).alias("held_out"),
    )
    counts = cut(count_words(docs.filter(~F.col("held_out"))))
    rare_class = (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int")
    head = {bytes(r.word): (FIRST_WORD + k, r.c) for k, r in enumerate(_head(counts))}
    sums = counts.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("ends")
    ).first()
    tokens, distinct, ends = sums.n or 0, sums.v or 0, sums.ends or 0
    common = spark.createDataFrame([(bytearray(w),) for w in head] or [(bytearray(b""),)], "word binary")
    rare = counts.filter(F.length("word") > 0).join(F.broadcast(common), "word", "left_anti")  # HEAD rows at most
    per_class = rare.groupBy(rare_class.alias("class")).agg(F.sum("c").alias("cn"), F.count("*").alias("cv"))
    size_of = {r["class"]: (r.cn, r.cv) for r in per_class.collect()}  # CLASSES rows at most

    # shares of the symbols in the corpus, which shake and smooth the model
    weight = np.full(FIRST_WORD + len(head), 0.5)
    weight[END] += ends
    for k, (n, _) in size_of.items():
        weight[FIRST_CLASS + k] += n
    for k, c in head.values():
        weight[k] += c
    share = weight / weight.sum()

    encoded = _encode(docs, head, ends, scratch_path(spark, "hmm"))
    model = _train(encoded.filter(~F.col("held_out")), share)
    scored = _forward(encoded, model)

    # rare words: their corpus counts, and their share within their class
    classes = spark.createDataFrame([(k, *size_of.get(k, (0, 0))) for k in range(CLASSES)], "class int, cn long, cv long")
    used = (
        encoded.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.m")
        .join(rare.select("word", "c"), "word", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .withColumn("class", rare_class)
        .join(F.broadcast(classes), "class")  # CLASSES rows
    )
    extra = used.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("rare_base"),
        F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / (F.col("cn") + 0.5 * (F.col("cv") + 1)))).alias("rare_score"),
    )
    mass = float(np.log10(tokens + 0.5 * (distinct + 1)))
    zero = F.lit(0.0)
    return scored.join(extra, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("path") + F.coalesce("rare_score", zero)).alias("score"),
    )


def _head(counts: DataFrame) -> list:
    """The commonest words, ``HEAD`` at most, commonest first.

    A histogram of the counts' logarithms, some thousand rows, tells from which
    count on the words are few enough; only those words come to the driver.
    """
    words = counts.filter(F.length("word") > 0).withColumn("size", F.floor(F.log(F.col("c").cast("double")) * 50))
    room, least, edge, share = HEAD, None, None, 0.0
    for r in sorted(words.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        if r["count"] > room:
            # of the words at the boundary, about as many as find room, told by their hash
            edge, share = r["size"], max(0.0, room - 3 * room**0.5) / r["count"]
            break
        room -= r["count"]
        least = r["size"]
    taken = F.lit(False) if least is None else F.col("size") >= least
    if edge is not None:
        taken = taken | ((F.col("size") == edge) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return sorted(words.filter(taken).select("word", "c").collect(), key=lambda r: (-r.c, r.word))[:HEAD]


def encode(texts: pa.Array, common: pa.Array, weight: np.ndarray, end_known: bool) -> list[pa.Array]:
    """For each text: its tokens, how many are known, the sum of their ``weight``, its symbols, and its rare words with how often.

    ``common`` holds the words with symbols of their own, from ``FIRST_WORD`` on.
    Rare words are neither known nor weighed here.
    """
    n = len(texts)
    words, owner = words_of(texts)
    symbol = pc.index_in(words, value_set=common)
    is_rare = symbol.is_null()
    rare, outside = words.filter(is_rare), is_rare.to_numpy(zero_copy_only=False)
    found = symbol.fill_null(0).to_numpy() + FIRST_WORD
    found[outside] = FIRST_CLASS + classes_of(rare)
    ids = np.full(len(words) + n, END, dtype="<u2")
    ids[np.arange(len(words)) + owner] = found  # an end behind the words of each text
    border = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n) + 1)])
    tokens, unknown = np.diff(border), np.bincount(owner[outside], minlength=n)
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((border * 2).astype("<i4")), pa.py_buffer(ids)])
    each = pa.table({"owner": owner[outside], "word": rare}).group_by(["owner", "word"], use_threads=False).aggregate([([], "count_all")])
    each = each.sort_by("owner").combine_chunks()
    first = np.searchsorted(each.column("owner").to_numpy(), np.arange(n + 1))
    pairs = pa.StructArray.from_arrays(
        [pa.concat_arrays(each.column(c).chunks or [pa.array([], t)]) for c, t in (("word", pa.binary()), ("count_all", pa.int64()))],
        names=["word", "m"],
    )
    return [
        pa.array(tokens, pa.int64()),
        pa.array(tokens - unknown - (not end_known), pa.int64()),
        pa.array(np.add.reduceat(weight[ids], border[:-1])),
        raw,
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs),
    ]


def _encode(docs: DataFrame, head: dict[bytes, tuple[int, int]], ends: int, path: str) -> DataFrame:
    """Texts as symbols and rare words, written to ``path`` so that each row keeps its ``uid``."""
    result = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField(
                "rare",
                T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("m", T.LongType())])),
            ),
        ]
    )
    row = F.struct("doc_id", "held_out").alias("row")
    packed = docs.select(row, "text")
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("res", result)])

    def run(batches):
        common = pa.array(list(head), pa.binary())
        weight = np.zeros(FIRST_WORD + len(head))
        weight[END] = np.log10(ends + 0.5)
        for k, c in head.values():
            weight[k] = np.log10(c + 0.5)
        for batch in batches:
            if batch.num_rows:
                res = pa.StructArray.from_arrays(encode(batch.column(1), common, weight, ends > 0), names=result.fieldNames())
                yield pa.RecordBatch.from_arrays([batch.column(0), res], names=["row", "res"])

    bound_batches(docs.sparkSession)
    rows = packed.mapInArrow(run, schema)
    rows.select(
        F.monotonically_increasing_id().alias("uid"), "row.*", "res.*"
    ).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _train(training: DataFrame, share: np.ndarray) -> Model:
    """Baum-Welch: passes over all training texts."""
    model = Model.fresh(share)
    parts = max(1, training.rdd.getNumPartitions())
    for _ in range(ROUNDS):
        model = _pass(training, model, len(share), parts).model(share)
    return model


def _pass(training: DataFrame, model: Model, symbols: int, tasks: int) -> Counts:
    """One pass: expected counts summed inside each task, then over the ``tasks``, ``FAN`` at a time."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))  # bounded by the model

    def run(batches):
        own = Model(*(x.astype(np.float32) for x in shared.value))  # expected counts are summed in double precision
        counts = Counts(symbols, STATES)
        rows = (np.frombuffer(raw, "<u2") for batch in batches for raw in batch.column(0).to_pylist())
        for sequences in chunks(rows):
            if len(sequences[0]) > LONG:
                counts.add_long(own, sequences[0])
            else:
                counts.add(own, sequences)
        blocks = [counts.emit[k : k + BLOCK].ravel().tobytes() for k in range(0, symbols, BLOCK)]
        rows = [np.concatenate([counts.start, counts.move.ravel()]).tobytes(), *blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["block", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = training.select("ids").mapInArrow(run, "block int, sums binary")
    level = parts.withColumn("part", F.spark_partition_id())
    while tasks > FAN:
        level = level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(
            lambda keys, table: add(table).append_column("part", pa.array([keys[1].as_py()], pa.int64())), "block int, sums binary, part long"
        )
        tasks = -(-tasks // FAN)
    summed = {r.block: np.frombuffer(r.sums) for r in level.select("block", "sums").groupBy("block").applyInArrow(add, "block int, sums binary").collect()}
    shared.unpersist()
    counts = Counts(symbols, STATES)
    if summed:
        counts.start, counts.move = summed[0][:STATES].copy(), summed[0][STATES:].reshape(STATES, STATES).copy()
        counts.emit = np.concatenate([summed[k] for k in range(1, len(summed))]).reshape(symbols, STATES)
    return counts


def _forward(encoded: DataFrame, model: Model) -> DataFrame:
    """The encoded rows with ``path``: log10 likelihood of the whole symbol sequence."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    keep = ["uid", "doc_id", "held_out", "n_tokens", "known", "base"]
    rows = encoded.select(F.struct(*keep).alias("row"), "ids")
    schema = T.StructType([rows.schema["row"], T.StructField("path", T.DoubleType())])

    def run(batches):
        own = Model(*shared.value)
        held, ids, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(held), pa.array(forward(own, ids), pa.float64())], names=["row", "path"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0))
                ids += [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
                size += sum(map(len, ids[-batch.num_rows :]))
                if size >= CHUNK_TOKENS:
                    yield out()
                    held, ids, size = [], [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, schema).select("row.*", "path")
