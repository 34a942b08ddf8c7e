"""Repair of conversations: the cheapest edits that make roles alternate.

A row's first fault counts: blank, a repeat of an earlier role and text, or cut off
before a full stop. A repaired conversation is an optional system turn and then pairs
of user and assistant. Each row of a conversation becomes a symbol of role and fault.
All rows are sorted by range over conversation and turn, so a long conversation lies
on many tasks; its signature is cut into pieces of at most ``1 << PIECE_BITS`` symbols.

Distinct signatures are sorted and inserted into a prefix trie, whose current path
carries one layer of the dynamic programme for each node: for every state that a
piece can begin and end in the least cost, and the order of the edit strings of equal
cost. A layer is computed once for all signatures that share its prefix, and nodes that
are left are dropped, since sorted signatures never come back to them. A terminal node
gives its answer. A conversation of one piece reads its edits off; the layers of several
pieces compose like matrices, in a fold over one small row a piece.

Why comparing orders is enough: inserted turns are charged to the row they stand
before, so strings of one layer end in an edit of a row and none is the beginning of
another; which is less is settled by the first parting of their ways, hence by the
order of the layer before and then by the letters added.

Repaired conversations are made, or hashed, in a stream sorted by conversation in which
the edits of a piece precede its rows; a worker holds a batch of rows. A hash of a whole
conversation is sequential, so one task makes it, in bounded memory.

Defined cases: a null id names one conversation of its own; a null role or text is one
blank, hence blank text and a role to be replaced; null turns come first and count for
no gap; gaps beyond a long are the largest one; rows of one turn are ordered by a hash of role and text; an empty role is none,
and cannot be kept; a conversation without rows has zeros and no edits; texts of any
length are whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bound_batches, cut, join_unique, scratch_path

#: A piece has at most ``1 << PIECE_BITS`` rows; at most 33.
PIECE_BITS = 12
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_LONGEST = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, a system turn, a user turn, an assistant turn at the end.
STATES = "Esua"
START = 0
#: Symbols: a role's initial (o: another), upper case if the row is cut off; x must go.
SYMBOLS = "suaoSUAOx"
#: Turns to insert before a state is reached from another: state -> (state, how many).
_BEFORE = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
_CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}


def _next(state: int, initial: str) -> int | None:
    """The state after a turn of that initial, if it may stand there."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def _steps(symbol: str) -> list[list[tuple[int, str, int]]]:
    """For each state the edits of one row: (state after, letters, cost)."""
    out = []
    for state in range(len(STATES)):
        edits = [(state, "D", DELETE)]
        for between, inserted in _BEFORE[state] if symbol != "x" else ():
            cost = INSERT * inserted + TRUNCATED * symbol.isupper()
            letters = "I" * inserted
            if (kept := _next(between, symbol.lower())) is not None:
                edits.append((kept, letters + "K", cost))
            edits.append((3 if between == 2 else 2, letters + "R", cost + REROLE))
        out.append(edits)
    return out


_STEP = {s: _steps(s) for s in SYMBOLS}


class Layer(NamedTuple):
    """For one beginning state, by end state: cost (None: out of reach), order, state before, letters."""

    cost: list
    order: list
    back: list
    letters: list


def first_layer(start: int) -> Layer:
    """Before any row."""
    own = [0 if k == start else None for k in range(len(STATES))]
    return Layer(own, list(own), [None] * len(STATES), [""] * len(STATES))


def advance(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row."""
    best: list = [None] * len(STATES)
    for state, edits in enumerate(_STEP[symbol]):
        cost = layer.cost[state]
        if cost is not None:
            order = layer.order[state]
            for after, letters, more in edits:
                found = (cost + more, order, letters, state)
                if best[after] is None or found < best[after]:
                    best[after] = found
    ranks = {k: n for n, k in enumerate(sorted((k for k, b in enumerate(best) if b), key=lambda k: best[k][1:3]))}
    pick = lambda part: [b and b[part] for b in best]
    return Layer(pick(0), [ranks.get(k) for k in range(len(best))], pick(3), pick(2))


def closed(cost: list, order: list) -> tuple[int, int]:
    """Least cost of a whole conversation, and the state in which its rows end."""
    total, _, state = min((c + INSERT * _CLOSING[k], order[k], k) for k, c in enumerate(cost) if c is not None)
    return total, state


class PrefixTrie:
    """The path of a prefix trie to the signature inserted last, one layer (for each start) a node."""

    def __init__(self, starts: range):
        self.signature, self.made = "", 0
        self.path = [[first_layer(s) for s in starts]]

    def insert(self, signature: str) -> None:
        """Leaves the nodes that are not shared, adds those that are missing."""
        shared = 0
        for a, b in zip(self.signature, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for symbol in signature[shared:]:
            self.path.append([advance(layer, symbol) for layer in self.path[-1]])
        self.made += len(signature) - shared
        self.signature = signature

    def edits(self, start: int, end: int) -> str:
        """The edit string from a start to an end state at the terminal node."""
        out = []
        for node in reversed(self.path[1:]):
            out.append(node[start].letters[end])
            end = node[start].back[end]
        return "".join(reversed(out))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (ck, turn, role, text) with nulls as one blank, some dropped, emptied, cut off, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        text_of("conv_id").alias("ck"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"),
        (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20).alias("how"),
    ).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("ck", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "how")
    twice = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("ck", "turn", "role", "text", twice.alias("copy")).drop("copy")


class Repair(NamedTuple):
    """``summary``: one row a conversation; ``edits``: one row a piece; ``rows``: the rows in order."""

    summary: DataFrame
    edits: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """Faults, costs and cheapest edits of conversations (ck, turn, role, text).

    The summary has ck, gaps, blank, duplicate, truncated, illegal, cost and audit.
    """
    rows = _in_order(conversations)
    pieces = _pieces(rows)
    edits = _cheapest(pieces)
    distinct = F.count_distinct("turn")
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - distinct
    gaps = rows.groupBy("ck").agg(F.coalesce(F.when(span > F.lit(Decimal(_LONGEST)), _LONGEST).otherwise(span.cast("long")), F.lit(0)).alias("gaps"))
    joints = F.array_sort(F.collect_list(F.struct("piece", "first", "last")))
    counted = pieces.groupBy("ck").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], joints.alias("j")
    )
    across = F.zip_with(F.slice("j", F.lit(1), F.size("j") - 1), F.slice("j", F.lit(2), F.size("j") - 1), lambda a, b: F.concat(a["last"], b["first"]))
    counted = counted.withColumn("illegal", F.col("illegal") + F.size(F.filter(across, lambda p: ~p.isin("su", "ua", "au")))).drop("j")
    told = edits.groupBy("ck").agg(F.max("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("piece", "audit"))).alias("e"))
    told = told.select("ck", "cost", F.array_join(F.transform("e", lambda x: x["audit"]), "").alias("audit"))
    return Repair(counted.join(gaps, "ck").join(told, "ck"), edits, rows)


def _in_order(conversations: DataFrame) -> DataFrame:
    """The rows with ``o``, which ascends in every conversation, and ``piece``, written to the shared folder."""
    spark = conversations.sparkSession
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    tied = conversations.select("ck", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("o", F.monotonically_increasing_id())
    path = scratch_path(spark, "conversations")
    placed.withColumn("piece", F.shiftright("o", PIECE_BITS)).write.parquet(path)
    return spark.read.parquet(path)


def _pieces(rows: DataFrame) -> DataFrame:
    """ck, piece, whole (the only one of its conversation), signature, first, last and the counts of a piece."""
    solid = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "ck", "piece", "o", F.concat_ws("|", "ck", "digest").alias("key"), (solid == "").alias("is_blank"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    firsts = narrow.groupBy("key").agg(F.min("o").alias("met"), F.count("*").alias("n"))
    known = join_unique(narrow, firsts, "key", "n", rows.count(), ["met"])
    repeat = ~F.col("is_blank") & (F.col("o") > F.col("met"))
    bad = F.col("is_blank") | repeat
    known = known.select(
        "*", repeat.alias("repeat"), (F.col("open") & ~bad).alias("cut_off"),
        F.when(bad, "x").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial")).alias("symbol"),
    )
    # at most 1 << PIECE_BITS rows of a piece meet
    met = known.groupBy("ck", "piece").agg(
        F.array_sort(F.collect_list(F.struct("o", "symbol", "initial"))).alias("r"),
        *[F.count_if(c).alias(n) for c, n in (("is_blank", "blank"), ("repeat", "duplicate"), ("cut_off", "truncated"))],
    )
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.concat(a["initial"], b["initial"]))
    made = met.select(
        "ck", "piece", F.array_join(F.transform("r", lambda x: x["symbol"]), "").alias("signature"), "blank", "duplicate", "truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.element_at("r", 1)["initial"].alias("first"), F.element_at("r", -1)["initial"].alias("last"),
    )
    alone = F.count("*").over(Window.partitionBy("ck")) == 1
    return cut(made.withColumn("whole", alone))


_ANSWER = T.StructType(
    [
        T.StructField("skey", T.StringType()), T.StructField("n", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("orders", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
    ]
)
#: Arrow types of ``_ANSWER``.
_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]


def answers(signatures: DataFrame) -> DataFrame:
    """Terminal answers of signatures (skey, n): ``w`` and the symbols of a whole conversation, or ``p`` and those of a piece.

    A whole one has cost and audit; a piece has costs, orders and audits by start and end state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {"w": PrefixTrie(range(START, START + 1)), "p": PrefixTrie(range(len(STATES)))}
        all_ends = range(len(STATES))
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for skey, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie = tries[skey[0]]
                trie.insert(skey[1:])
                end = trie.path[-1]
                if skey[0] == "w":
                    cost, state = closed(end[START].cost, end[START].order)
                    out.append((skey, n, cost, trie.edits(START, state) + "I" * _CLOSING[state], None, None, None))
                else:
                    audits = [trie.edits(s, e) if end[s].cost[e] is not None else None for s in all_ends for e in all_ends]
                    out.append((skey, n, None, None, [c for x in end for c in x.cost], [c for x in end for c in x.order], audits))
                held += 16 * len(skey)
                if held > 8 << 20:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*out, strict=True), _ARROW, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=_ANSWER.fieldNames())

    return signatures.repartitionByRange("skey").sortWithinPartitions("skey").mapInArrow(run, _ANSWER)


def _fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Composes the layers of a conversation's pieces: start and end state of each, and the cost of all."""
    pdf = pdf.sort_values("piece")
    width = len(STATES)
    cost, order, backs = first_layer(START).cost, first_layer(START).order, []
    for costs, orders in zip(pdf["costs"], pdf["orders"], strict=True):
        best: list = [None] * width
        for s in range(width):
            for e in range(width):
                more = costs[s * width + e]
                if cost[s] is not None and more is not None and more == more:
                    found = (cost[s] + int(more), order[s], int(orders[s * width + e]), s)
                    if best[e] is None or found < best[e]:
                        best[e] = found
        ranks = {k: n for n, k in enumerate(sorted((k for k in range(width) if best[k]), key=lambda k: best[k][1:3]))}
        cost, order = [b and b[0] for b in best], [ranks.get(k) for k in range(width)]
        backs.append([b and b[3] for b in best])
    total, end = closed(cost, order)
    ends, closing, last = [], [0] * len(backs), end
    for back in reversed(backs):
        ends.append((back[last], last))
        last = back[last]
    closing[-1] = _CLOSING[end]
    starts = list(reversed(ends))
    return pd.DataFrame({"ck": key[0], "piece": pdf["piece"], "at": [s * width + e for s, e in starts], "closing": closing, "cost": total})


def _cheapest(pieces: DataFrame) -> DataFrame:
    """ck, piece, audit and, for the whole conversation, cost."""
    keyed = pieces.select("ck", "piece", F.concat(F.when(F.col("whole"), "w").otherwise("p"), "signature").alias("skey"))
    told = cut(answers(keyed.groupBy("skey").agg(F.count("*").alias("n"))))
    met = join_unique(keyed, told, "skey", "n", keyed.count(), ["cost", "audit", "costs", "orders"])
    whole = met.filter("cost is not null").select("ck", "piece", "audit", "cost")
    parts = met.filter("cost is null").select("ck", "piece", "costs", "orders")
    ways = parts.groupBy("ck").applyInPandas(_fold, "ck string, piece long, at int, closing int, cost long")
    placed = keyed.filter("skey like 'p%'").join(ways, ["ck", "piece"])
    # pieces of many conversations are rarely equal: their number by signature is that of the answers
    chosen = join_unique(placed, told, "skey", "n", keyed.count(), ["audits"])
    audit = F.concat(F.get("audits", "at"), F.repeat(F.lit("I"), F.col("closing")))
    return cut(whole.unionByName(chosen.select("ck", "piece", audit.alias("audit"), "cost")))


def repaired(done: Repair, digests: bool = False) -> DataFrame:
    """The repaired rows (ck, place, role, text), or with ``digests`` SHA-256 of their ``role:text`` lines by conversation."""
    bound_batches(done.rows.sparkSession)
    none = F.lit(None).cast("string")
    heads = done.edits.select("ck", "piece", F.lit(-1).cast("long").alias("o"), "audit", none.alias("role"), none.alias("text"))
    bodies = done.rows.select("ck", "piece", "o", none.alias("audit"), "role", "text")
    stream = heads.unionByName(bodies).repartition("ck").sortWithinPartitions("ck", "piece", "o")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
        """(ck, role, text) of each turn, and (ck, None, None) after the last of a conversation."""
        ck, audit, at, state = None, "", 0, START

        def inserted() -> Iterator[tuple[str, str, str]]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = 3 if state == 2 else 2
                at += 1
                yield ck, "assistant" if state == 3 else "user", ""

        for batch in batches:
            for own, own_audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("ck", "audit", "role", "text")), strict=True):
                if own_audit is not None:
                    yield from inserted()
                    if own != ck:
                        if ck is not None:
                            yield ck, None, None
                        ck, state = own, START
                    audit, at = own_audit, 0
                    continue
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = _next(state, role[:1])
                    yield ck, role, text
                elif edit == "R":
                    state = 3 if state == 2 else 2
                    yield ck, "assistant" if state == 3 else "user", text
        if ck is not None:
            yield from inserted()
            yield ck, None, None

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, running, first = [], hashlib.sha256(), True
        for ck, role, text in turns(batches):
            if role is None:
                out.append({"ck": ck, "repaired_sha256": running.hexdigest()})
                running, first = hashlib.sha256(), True
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out)
                    out = []
            else:
                running.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if out:
            yield pa.RecordBatch.from_pylist(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, held = [], 0, 0
        for ck, role, text in turns(batches):
            if role is None:
                place = 0
                continue
            out.append({"ck": ck, "place": place, "role": role, "text": text})
            place, held = place + 1, held + len(text)
            if len(out) >= 5000 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(out)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out)

    if digests:
        return stream.mapInArrow(hashes, "ck string, repaired_sha256 string")
    return stream.mapInArrow(rows, "ck string, place long, role string, text string")
