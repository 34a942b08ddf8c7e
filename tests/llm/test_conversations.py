"""Conversation repair against brute force: every edit script of small cases, a plain programme over real rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations as C
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def tie(row):
    return hashlib.sha256(f"{len(row[1].encode())}:{row[1]}{row[2]}".encode()).hexdigest()


def plain_damage(rows):
    """conv_id -> damaged rows (turn, role, text), in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = lambda v: " " if v is None else str(v)
        role, text = name(role), name(text)
        how = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if how:
            row = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text)
            own += [row, row] if how == 3 else [row]
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, tie(r))) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = BLANK.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def scripts(rows, bad, most):
    """All (cost, audit, turns) with at most ``most`` inserted turns in a row."""
    kinds = [("user", ""), ("assistant", "")]
    gap = [c for n in range(most + 1) for c in itertools.product(kinds, repeat=n)]
    for inserted in itertools.product(gap, repeat=len(rows) + 1):
        choices = []
        for (_, role, text), fault in zip(rows, bad, strict=True):
            more = fault == "truncated"
            own = [(3, "D", [])]
            if fault not in ("blank", "duplicate"):
                own += [(more, "K", [(role, text)]), (2 + more, "R", [("user", text)]), (2 + more, "R", [("assistant", text)])]
            choices.append(own)
        for edits in itertools.product(*choices):
            cost = sum(2 * len(g) for g in inserted) + sum(e[0] for e in edits)
            audit, turns = "", []
            for g, e in itertools.zip_longest(inserted, edits, fillvalue=(0, "", [])):
                audit, turns = audit + "I" * len(g) + e[1], turns + list(g) + e[2]
            if all(t[0] for t in turns) and GOOD.fullmatch("".join(t[0][:1] for t in turns)):
                yield cost, audit, turns


def plain_cheapest(rows, bad):
    """A plain programme over whole edit strings: best (cost, audit, turns) by state."""
    table = {"E": (0, "", [])}

    def better(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def follow(state, initial):
        return {"Es": "s", "Eu": "u", "su": "u", "au": "u", "ua": "a"}.get(state + initial)

    def insert(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                for role in ("user", "assistant"):
                    if to := follow(state, role[0]):
                        better(out, to, (cost + 2, audit + "I", [*turns, (role, "")]))
        return out

    for (_, role, text), fault in zip(rows, bad, strict=True):
        new, more = {}, fault == "truncated"
        for state, (cost, audit, turns) in insert(table).items():
            better(new, state, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                for r, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if to := follow(state, r[:1]):
                        better(new, to, (cost + price + more, audit + letter, [*turns, (r, text)]))
        table = new
    table = insert(table)
    return min((table[s] for s in "Ea" if s in table), key=lambda x: x[:2])


def plain_rows(rows, cheapest=plain_cheapest):
    out = []
    for conv, own in plain_damage(rows).items():
        bad = faults(own)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, fixed = cheapest(own, bad)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *[bad.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run_query(spark, rows, path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ck", F.lit(1)).withColumn("piece", F.lit("clash"))
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversations"](spark, str(path)).collect()), key=str)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "s", "unknown", None, ""]
    texts = ["Yes.", "No", "", " \t\n", None, "What?", "a b", "end!\n", "é…", "x.y", "\x1c"]
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(most + 1)):
            text = rng.choice(texts)
            if text is not None and rng.random() < 0.6:
                text += f"{rng.random()}."
            out.append((c or None, t if rng.random() > 0.1 else None, rng.choice(roles), text))
    return out


def test_plain_programme_equals_all_scripts():
    rng = random.Random(3)
    for _ in range(60):
        own = [(k, rng.choice(["system", "user", "assistant", "tool", "s"]), rng.choice(["a.", "b", " ", "c!"])) for k in range(rng.randrange(4))]
        bad = faults(own)
        best = min(scripts(own, bad, 2), key=lambda x: x[:2])
        assert plain_cheapest(own, bad)[:2] == best[:2]
        assert plain_cheapest(own, bad)[2] == best[2]


def test_trie_computes_a_layer_once_for_a_shared_prefix():
    trie = C.PrefixTrie(range(1))
    signatures = sorted("".join(p) for n in range(1, 5) for p in itertools.product("suaSx", repeat=n))
    for s in signatures:
        trie.insert(s)
        fresh = C.PrefixTrie(range(1))
        fresh.insert(s)
        assert trie.path == fresh.path
    assert trie.made == len(signatures)  # every prefix is a signature here


def test_query_on_real_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversations"](spark, DATA).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain_rows(rows)


@pytest.mark.parametrize("bits", [12, 1, 2])
def test_query_on_hard_rows(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    rows = random_rows(bits, 120, 14)
    assert run_query(spark, rows, tmp_path) == plain_rows(rows)


def test_one_conversation_holds_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BITS", 4)
    rng = random.Random(5)
    rows = [(1, k % 700, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", f"t{k}", f"t{k}!", ""])) for k in range(1500)]
    rows += [(None, None, None, None), (None, None, None, None), (2, 2**63 - 1, "user", "."), (2, -(2**63), "assistant", "x" * 200_000 + ".")]
    assert run_query(spark, rows, tmp_path) == plain_rows(rows)


def test_empty_table_and_conversations_without_rows(spark, tmp_path):
    gone = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run_query(spark, [], tmp_path / "empty") == []
    (row,) = run_query(spark, [(*gone, "user", "a.")], tmp_path / "gone")
    assert row == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [("1", 0, "assistant", "Hello."), ("1", 1, "assistant", "Hello."), ("1", 2, "user", "Why"), ("2", None, "system", "S."), ("2", 5, "user", "U.")]
    done = C.repair(spark.createDataFrame(rows, "ck string, turn long, role string, text string"))
    found = [tuple(r) for r in C.repaired(done).orderBy("ck", "place").collect()]
    summary = {r.ck: (r.cost, r.audit) for r in done.summary.collect()}
    assert summary["2"] == (2, "KKI")
    assert summary["1"][0] == min(x[0] for x in scripts([r[1:] for r in rows[:3]], ["", "duplicate", "truncated"], 2))
    assert [x for x in found if x[0] == "2"] == [("2", 0, "system", "S."), ("2", 1, "user", "U."), ("2", 2, "assistant", "")]
