"""Embedding near-duplicates by sorted projection passes.

Each pass gives every vector a key: the concatenation of random hashes, each the
quantised projection on a random direction. The vectors are ordered by key
lexicographically, and every vector is compared with the next ``WINDOW`` ones: in
a range of the order within its task, near the ends of ranges by its rank in the
whole order, however many short ranges a window reaches over. So the pairs seen
do not depend on the number of partitions. Equal vectors are merged first, so a
common vector fills no window. Pairs with a cosine (double precision) of at least
the threshold are links; a task keeps a spanning forest of those it sees, the
forests of all passes are united, and their components found.

How many vectors stand between two near neighbours in an order grows with the
table, so the number of passes does too. About ``PROBES`` vectors of the table
are each given a planted neighbour at the threshold, the farthest that a link may
be, in a random direction. The planted vectors are ordered and compared like all
others, but their links are kept apart. Passes go on until ``RECALL`` of the
planted vectors were linked to a vector of the table - its own or, where many lie
close, one of them; where single passes see too few, the window grows too.

The links of a component's members are counted exactly, most without comparing
them. A member lies at some angle from the component's pivot, its least vector.
Two members are linked for sure if their angles add up to no more than the
threshold's, and apart for sure if they differ by more. Members are dealt to bins
of angles; only pairs of bins that the angles leave open are compared, in blocks,
as matrices, and only counts leave a task - never pairs. Groups of copies within
half the threshold's angle thus take linear work; a component with few members
near its pivot still takes quadratic work in its size.

Defined cases: a vector that is null, zero, or holds a null or non-finite
component, links with nothing and is its own component; so does one of another
length than its neighbour with that neighbour; repeated rows are vectors of their
own; vectors with equal keys are ordered by a digest of their bytes; vectors of
any length are compared whole; extra columns are ignored; the component of a null
id alone is null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bound_batches, cut, join_unique
from tessella.llm.components import connected_components, spanning_forest

THRESHOLD = 0.9
#: Passes of the first round over up to ``FEW`` vectors, more as a fifth root of their number, and the window.
PASSES = 8
FEW = 2000
WINDOW = 48
#: Share of the planted pairs to be seen, and about how many are planted.
RECALL = 0.95
PROBES = 1000
#: Where this many passes in all would not do, the window is widened instead.
MANY_PASSES = 48
HASHES = 24
#: Members of a bin that are compared as one block.
BLOCK = 1024
#: Bins of the threshold's angle.
BINS = 64
#: Angles are trusted to this.
TRUST = 1e-6
#: Links that a task thins at a time.
CHUNK = 200_000
SEED = 1469


def direction(size: int, number: int, seed: int = SEED) -> np.ndarray:
    """``HASHES`` random unit directions of one pass, a row each."""
    draw = np.random.default_rng([seed, number, size]).normal(size=(HASHES, size))
    return draw / np.linalg.norm(draw, axis=1, keepdims=True)


def keys_of(vectors: np.ndarray, number: int) -> list[bytes]:
    """Sort keys of unit vectors in a pass: one byte for each hash.

    A hash is the projection in cells as wide as two linked vectors may be apart,
    shifted at random so that different passes cut space at different places.
    """
    turn = direction(vectors.shape[1], number)
    shift = np.random.default_rng([SEED, number]).uniform(size=HASHES)
    cell = 2.0 / np.sqrt(vectors.shape[1])
    cells = np.floor(vectors @ turn.T / cell + shift) + 128
    return [row.tobytes() for row in np.clip(cells, 0, 255).astype(np.uint8)]


def unit(raw: list[bytes]) -> np.ndarray:
    """Packed double vectors of one length as unit rows."""
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    # scaled first: the square of a very large or small component must not overflow or vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def window_pairs(x: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a, b), a before b by at most ``window``, that reach the threshold."""
    out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for gap in range(1, min(window, len(x) - 1) + 1):
        at = np.nonzero(np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= threshold)[0]
        out_a.append(at)
        out_b.append(at + gap)
    return np.concatenate(out_a), np.concatenate(out_b)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(every row with its ``key``, the distinct usable vectors with ``key`` and ``n``).

    ``key`` is a 128-bit digest of the vector's bytes; unusable vectors have none.
    """
    doubles = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    good = (
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), doubles.alias("v")).withColumn(
        "v", F.when(F.coalesce(good, F.lit(False)), F.col("v"))
    )

    def pack(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            packed, keys = [], []
            for v in batch.column(1).to_pylist():
                raw = None if v is None else (np.array(v, dtype=np.float64) + 0.0).tobytes()
                packed.append(raw)
                keys.append(None if raw is None else xxh64_intdigest(raw) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "key", "raw"]
            )

    packed = rows.mapInArrow(pack, "vec_id long, key long, raw binary")
    # vectors are told apart by all their bytes; the digest is a short name for them
    named = packed.filter("raw is not null").groupBy("key", "raw").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return packed, named


FOUND = "kind int, part int, at long, turn int, a long, b long, raw binary"
#: Kinds of rows that a range gives: a link, a row near one of its ends, its number of rows.
LINK, EDGE, SIZE = 0, 1, 2


def _found(kind: int, n: int, part=None, at=None, turn=None, a=None, b=None, raw=None) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = [np.full(n, kind, dtype=np.int32), part, at, turn, a, b, raw]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=["kind", "part", "at", "turn", "a", "b", "raw"],
    )


class Thinner:
    """Links in, a spanning forest out; for planted vectors, that they met any vector of the table."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.probes: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        met = np.unique(np.where(a & 1, a, b)[((a ^ b) & 1) == 1])
        self.probes.append((met - 1, met))
        real = ((a | b) & 1) == 0
        self.held.append((a[real], b[real]))
        self.size += int(real.sum())
        if self.size > CHUNK:
            self.held = [spanning_forest(*map(np.concatenate, zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        empty = np.zeros(0, dtype=np.int64)
        held = [np.concatenate(x) for x in zip(*self.held, strict=True)] if self.held else [empty, empty]
        forest = spanning_forest(*held) if len(held[0]) else held
        probes = [np.concatenate(x) for x in zip(*self.probes, strict=True)] if self.probes else [empty, empty]
        self.held, self.probes, self.size = [], [], 0
        return np.concatenate([forest[0], probes[0]]), np.concatenate([forest[1], probes[1]])


def _alike(turns: list[int], raw: list[bytes]):
    """Runs (start, end) of rows of one pass and one vector length."""
    start = 0
    for end in range(1, len(raw) + 1):
        if end == len(raw) or turns[end] != turns[start] or len(raw[end]) != len(raw[start]):
            yield start, end
            start = end


def pass_links(nodes: DataFrame, numbers: range, threshold: float, window: int) -> DataFrame:
    """Links (a, b) that passes over ``nodes`` (node, key, raw) find, thinned to forests.

    The passes are sorted as one table, pass after pass.
    """

    def keyed(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            units = []
            for size in {len(r) for r in raw}:
                at = [k for k, r in enumerate(raw) if len(r) == size]
                units.append((size, at, unit([raw[k] for k in at])))
            ties = [k.to_bytes(8, "big", signed=True) for k in batch.column(1).to_pylist()]
            for number in numbers:
                keys: list[bytes] = [b""] * len(raw)
                for size, at, x in units:
                    for k, key in zip(at, keys_of(x, number), strict=True):
                        keys[k] = number.to_bytes(4, "big") + size.to_bytes(4, "big") + key + ties[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(keys, pa.binary())], names=["node", "raw", "sort"]
                )

    ordered = (
        nodes.select("node", "key", "raw").mapInArrow(keyed, "node long, raw binary, sort binary")
        .repartitionByRange(F.col("sort"), F.col("node")).sortWithinPartitions("sort", "node")
    )

    def compare(batches):
        """A forest of the links within a range, its first and last rows, and its size."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        thin = Thinner()
        node: list[int] = []
        raw: list[bytes] = []
        turn: list[int] = []
        seen = 0
        first = None
        for batch in batches:
            held = len(node)
            node += batch.column(0).to_pylist()
            raw += batch.column(1).to_pylist()
            turn += [int.from_bytes(k[:4], "big") for k in batch.column(2).to_pylist()]
            seen += batch.num_rows
            for start, end in _alike(turn, raw):
                if end - start > 1 and end > held:
                    name = np.array(node[start:end], dtype=np.int64)
                    a, b = window_pairs(unit(raw[start:end]), threshold, window)
                    fresh = b >= held - start
                    thin.add(name[a[fresh]], name[b[fresh]])
            if first is None or len(first[0]) < window:
                have = len(first[0]) if first else 0
                more = slice(held, held + window - have)
                first = [x + y[more] for x, y in zip(first or [[], [], []], (node, raw, turn), strict=True)]
            if len(node) > window:
                node, raw, turn = node[-window:], raw[-window:], turn[-window:]
        if seen:
            # rows near both ends of a short range go out once
            last = max(0, min(len(node), seen - len(first[0])))
            at = [*range(len(first[0])), *range(seen - last, seen)]
            rows = [x + y[len(y) - last :] for x, y in zip(first, (node, raw, turn), strict=True)]
            yield _found(EDGE, len(at), part=[part] * len(at), at=at, a=rows[0], raw=rows[1], turn=rows[2])
            yield _found(SIZE, 1, part=[part], at=[seen])
        a, b = thin.out()
        yield _found(LINK, len(a), a=a, b=b)

    found = cut(ordered.mapInArrow(compare, FOUND))
    begin, total = [], 0
    for r in sorted(found.filter(F.col("kind") == SIZE).select("part", "at").collect()):  # a row for each partition
        begin.append((r.part, total))
        total += r["at"]
    spark = nodes.sparkSession
    offsets = spark.createDataFrame(begin, "part int, begin long")
    span = 8 * window  # ranks of one block; the first of the next block are its guests
    edges = (
        found.filter(F.col("kind") == EDGE).join(F.broadcast(offsets), "part")  # a row for each partition
        .withColumn("rank", F.col("begin") + F.col("at"))
        .withColumn("own", F.floor(F.col("rank") / span))
    )
    guest = (F.col("rank") % span < window) & (F.col("own") > 0)
    placed = edges.select(
        F.explode(F.when(guest, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))).alias("block"),
        "rank", "part", "turn", F.col("a").alias("node"), "raw",
    )

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        turn, raw = table.column("turn").to_pylist(), table.column("raw").to_pylist()
        node, rank, part = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("node", "rank", "part"))
        thin = Thinner()
        for start, end in _alike(turn, raw):
            if end - start > 1:
                a, b = window_pairs(unit(raw[start:end]), threshold, window)
                a, b = a + start, b + start
                new = (rank[b] - rank[a] <= window) & (part[a] != part[b])
                thin.add(node[a[new]], node[b[new]])
        a, b = thin.out()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = placed.groupBy("block").applyInArrow(across, "a long, b long")
    return found.filter(F.col("kind") == LINK).select("a", "b").unionByName(met)


def planted(raw: bytes, key: int, threshold: float) -> bytes | None:
    """A vector whose cosine with the given one is just the threshold, None where one dimension leaves no room."""
    x = unit([raw])[0]
    if len(x) < 2 or threshold >= 1:
        return None
    side = np.random.default_rng([SEED, key & ((1 << 63) - 1)]).normal(size=len(x))
    side -= (side @ x) * x
    # a hair above, or rounding would lose half of them
    c = min(1.0, threshold + 1e-6)
    return (c * x + np.sqrt(1 - c * c) * side / np.linalg.norm(side)).tobytes()


def probes(nodes: DataFrame, size: int, threshold: float, wanted: int = PROBES) -> DataFrame:
    """(node, key, raw) of planted neighbours of about ``wanted`` of ``size`` nodes; a probe's name is its node's with the last bit set."""
    share = min(1.0, wanted / max(1, size))
    chosen = nodes.filter(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 32)) < int(share * (1 << 32))).select("node", "key", "raw")

    def plant(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            made = [(n | 1, k ^ 1, planted(r, k, threshold)) for n, k, r in rows]
            made = [m for m in made if m[2] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[c] for m in made], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["node", "key", "raw"]
            )

    return cut(chosen.mapInArrow(plant, "node long, key long, raw binary"))


def all_links(nodes: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, recall: float = RECALL) -> tuple[DataFrame, float]:
    """Links (a, b) of as many passes over ``nodes`` as the probes demand, and the share of probes seen.

    The names of ``nodes`` have the last bit clear.
    """
    size = nodes.count()
    extra = probes(nodes, size, threshold)
    there = extra.count()
    compared = nodes.select("node", "key", "raw").unionByName(extra)
    first = min(MANY_PASSES, max(passes, int(np.ceil(passes * (size / FEW) ** 0.2))))
    links, seen, done, run = None, set(), 0, first
    while True:
        found = cut(pass_links(compared, range(done, done + run), threshold, window))
        before = len(seen)
        # a thousand names or so
        seen |= {r.node for r in found.filter(F.col("a").bitwiseXOR(F.col("b")) == 1).select(F.col("a").bitwiseAND(F.lit(-2)).alias("node")).distinct().collect()}
        real = found.filter((F.col("a").bitwiseOR(F.col("b"))).bitwiseAND(F.lit(1)) == 0)
        links = real if links is None else links.unionByName(real)
        done += run
        if len(seen) >= recall * there:
            return links, len(seen) / there if there else 1.0
        # the share of those not seen before that one pass of this round saw
        left = there - before
        rate = 1 - (1 - min(len(seen) - before, left - 0.5) / left) ** (1 / run)
        need = np.log((1 - recall) * there / (there - len(seen))) / np.log(1 - rate) if rate > 0 else np.inf
        if done + need > MANY_PASSES:
            window *= 4  # in the end a window holds the whole table, so this ends
            run = passes
        else:
            run = max(1, int(np.ceil(need)))


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``node``, ``links``: to how many rows of other vectors of its component each member links.

    ``members`` has component, node, raw and n, the rows that hold the vector; a
    component is named by one of its nodes, the pivot.
    """
    limit = float(np.arccos(threshold))
    total = members.count()
    pivots = members.groupBy("component").agg(F.count("*").alias("m")).join(
        members.filter("node = component").select("component", F.col("raw").alias("pivot")), "component"
    )

    def angle(batches):
        for batch in batches:
            raw, pivot = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            out = np.zeros(len(raw))
            for size in {len(r) for r in raw}:
                at = [k for k, r in enumerate(raw) if len(r) == size]
                x, y = unit([raw[k] for k in at]), unit([pivot[k] for k in at])
                out[at] = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["component", "node", "raw", "n", "angle"])

    aside = join_unique(members.select("component", "node", "raw", "n"), pivots, "component", "m", total, ["pivot"])
    turned = cut(
        aside.select("component", "node", "raw", "n", "pivot").mapInArrow(angle, "component long, node long, raw binary, n long, angle double")
        .withColumn("bin", F.floor(F.col("angle") / (limit / BINS)).cast("int"))
    )
    bins = turned.groupBy("component", "bin").agg(
        F.count("*").alias("m"), F.sum("n").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
    ).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    other = bins.select("component", *[F.col(c).alias(f"o_{c}") for c in ("bin", "rows", "low", "high", "blocks")])
    sure = F.col("high") + F.col("o_high") <= limit - TRUST
    apart = F.greatest(F.col("low") - F.col("o_high"), F.col("o_low") - F.col("high")) > limit + TRUST
    # a component has pi / limit * BINS bins at most
    known = bins.join(other, "component").groupBy("component", "bin").agg(
        F.first("m").alias("m"),
        F.first("blocks").alias("blocks"),
        F.sum(F.when(sure, F.col("o_rows")).otherwise(0)).alias("sure"),
        F.max(sure & (F.col("bin") == F.col("o_bin"))).alias("with_self"),
        F.collect_list(F.when(~sure & ~apart, F.struct(F.col("o_bin").alias("bin"), F.col("o_blocks").alias("blocks")))).alias("open"),
    ).withColumn("at", F.struct("component", "bin"))
    rows = join_unique(
        turned.withColumn("at", F.struct("component", "bin")), known.drop("component", "bin"), "at", "m", total, ["blocks", "sure", "with_self", "open"]
    )
    rows = cut(rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int")))
    mine, theirs = F.struct(F.col("bin").alias("bin"), F.col("own").alias("block")), F.col("met")
    shipped = (
        rows.filter(F.size("open") > 0)
        .select("component", "bin", "own", "node", "raw", "n", F.explode(F.flatten(F.transform(
            "open", lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda b: F.struct(o["bin"].alias("bin"), b.alias("block")))
        ))).alias("met"))
        .select("component", F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), "bin", "own", "node", "raw", "n")
        .select("component", "low", "high", (mine == F.col("low")).alias("is_low"), "node", "raw", "n")
    )

    def count(table: pa.Table) -> pa.Table:
        low = np.array(table.column("is_low").to_pylist())
        same = table.column("low")[0] == table.column("high")[0]
        node = np.array(table.column("node").to_pylist(), dtype=np.int64)
        n = np.array(table.column("n").to_pylist(), dtype=np.int64)
        links = np.zeros(len(node), dtype=np.int64)
        x = unit(table.column("raw").to_pylist())
        left, right = np.nonzero(low)[0], np.nonzero(low if same else ~low)[0]
        for k in range(0, len(left), 512):
            part = left[k : k + 512]
            near = x[part] @ x[right].T >= threshold
            if same:
                near &= part[:, None] != right[None, :]
            links[part] += near @ n[right]
            if not same:
                links[right] += near.T @ n[part]
        return pa.table({"node": pa.array(node), "links": pa.array(links)})

    counted = shipped.groupBy("component", "low", "high").applyInArrow(count, "node long, links long")
    certain = rows.select("node", (F.col("sure") - F.when(F.col("with_self"), F.col("n")).otherwise(0)).alias("links"))
    return certain.unionByName(counted).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    bound_batches(vectors.sparkSession)
    packed, named = distinct_vectors(vectors, id_col, vector_col)
    # numbered, so no two vectors share a name; the last bit is clear: with it set, the name is that of the node's probe
    number = F.monotonically_increasing_id() * 2
    nodes = cut(named.select(number.alias("node"), "key", "raw", "n", "least"))
    links, _ = all_links(nodes, threshold, passes, window)
    component = cut(connected_components(links, "a", "b"))

    members = cut(component.join(nodes, "node"))
    degree = count_links(members, threshold, block)
    # a component's least row; then every distinct vector's figures
    least = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named_members = join_unique(members.select("component", "node", "key", "raw", "n"), least, "component", "m", members.count(), ["component_id"])
    grouped = named_members.join(degree, "node").select(
        "key", "raw", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id", "n"
    )
    # a single vector's copies are linked with each other
    alone = nodes.join(component, "node", "left_anti").select(
        "key", "raw", (F.col("n") - 1).alias("n_links"), F.col("least").alias("component_id"), "n"
    )
    return _label(packed, grouped.unionByName(alone))


def _label(packed: DataFrame, answer: DataFrame) -> DataFrame:
    """Every row with its vector's figures; hot vectors are few and broadcast, the rest joined."""
    total = answer.agg(F.sum("n")).first()[0] or 0
    bar = max(1000, total // 1000)
    hot = answer.filter(F.col("n") > bar).drop("n")  # a thousand rows at most
    cold = answer.filter(F.col("n") <= bar).drop("n")
    alone = packed.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    used = packed.filter("raw is not null")
    far = used.join(F.broadcast(hot), ["key", "raw"])
    near = used.join(F.broadcast(hot.select("key", "raw")), ["key", "raw"], "left_anti").join(cold, ["key", "raw"])
    columns = ["vec_id", "n_links", "component_id"]
    out = far.select(*columns).unionByName(near.select(*columns)).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
