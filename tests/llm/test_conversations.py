"""Conversation repair against a plain search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from geosift.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, n string, part string, said string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 1:
            text = ""
        elif way == 2:
            text = re.sub("[.!?]", "", text)
        elif way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def accepts(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def report(rows):
    """Plain search: the least (cost, audit) over all edits, by recursion over rows and the roles so far."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        told = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    step = lambda q, x: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[q].get(x)

    @functools.cache
    def best(i, q, inserted):
        ways = []
        if i == len(rows):
            if accepts({"": "", "s": "s", "u": "u", "a": "ua"}[q]):
                ways.append((0, ""))
        else:
            f = faults[i]
            c, a = best(i + 1, q, 0)
            ways.append((c + 3, "D" + a))
            if f not in ("blank", "duplicate"):
                for letter, cost, x in (("K", 0, rows[i][2][:1]), ("R", 2, "u"), ("R", 2, "a")):
                    if to := step(q, x):
                        c, a = best(i + 1, to, 0)
                        ways.append((c + cost + (f == "truncated"), letter + a))
        if inserted < 3:
            for x in "ua":
                if to := step(q, x):
                    c, a = best(i, to, inserted + 1)
                    ways.append((c + 2, "I" + a))
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, q, left = [], "", iter(rows)
    for letter in audit:
        if letter == "I":
            q = "a" if q == "u" else "u"
            out.append(("user" if q == "u" else "assistant") + ":")
            continue
        _, _, role, text = next(left)
        if letter == "K":
            q = role[:1]
        elif letter == "R":
            q = "a" if q == "u" else "u"
            role = "user" if q == "u" else "assistant"
        if letter != "D":
            out.append(f"{role}:{text}")
    turns = {t for _, t, _, _ in rows if t is not None}
    initials = [r[2][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def some_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", " \t", "", None, "Ends here. \n", "sure", "é.", "…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown", "assistant "]
    rows = []
    for conv in [None, *range(n)]:
        k = rng.choice([1, 2, 3, 5, 8, 13])
        for t in range(k):
            rows.append((conv, rng.choice([t, t, t, t + 5, None]), rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice(texts)))
    return rows


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("block, held", [(64, 16 << 20), (3, 250)])
def test_layers_equal_plain_search(spark, monkeypatch, block, held):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "HELD", held)
    rows = some_rows(block, 120)
    rows += [(7000, 1, "user", "Same.")] * 40 + [(7001, t, "assistant", f"Turn {t % 7}." if t % 3 else "cut") for t in range(90)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    got = result(C.repair(table))
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == {conv: report(own) for conv, own in by_conv(clean).items()}


def test_blocks_equal_whole_layers():
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(1, 40)))
        layers = C.Layers(codes, C.DONE, closing=True)
        while not layers.grow() & 1:
            pass
        want = C.base_cost(codes) + len(layers.sets) - 1, layers.trace(0, len(layers.sets) - 1)
        ways = None
        for i in range(0, len(codes), 4):
            ways = C.combine(ways, C._block(codes[i : i + 4])) if ways else C._block(codes[i : i + 4])
        assert C.close(ways) == want


def test_query_damages_and_repairs(spark, tmp_path):
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*some_rows(9, 200), (gone, 0, "user", "Its only row is dropped.")]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = result(C.op11_conversation_repair(spark, str(tmp_path)))
    kept, nothing = by_conv(damaged(rows)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {conv: report(kept[conv]) if conv in kept else nothing for conv in by_conv(rows)}
    assert nothing in got.values()


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "More?"), (1, 1, "user", "More?"), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.repaired_rows(table, C.repair(table)).orderBy("conv_id", "pos").collect()
    assert [tuple(r) for r in out if r.conv_id == 2] == [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert accepts("".join(r.role[0] for r in out if r.conv_id == 1))


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(table).collect() == []
