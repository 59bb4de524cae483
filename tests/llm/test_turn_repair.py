import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from mediarec.llm import queries, turn_repair as tr
from mediarec.llm.common import read

SHAPE = re.compile("(s?(ua)+)?")


def cheapest(rows, costs):
    """Every edit of `rows` (role, must go, truncated) up to the cost of deleting all; least cost, then ASCII-least audit."""
    best = (costs.delete * len(rows), "D" * len(rows), "")
    if not rows:
        return best

    def go(at, cost, audit, initials):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(rows) and SHAPE.fullmatch(initials):
            best = min(best, (cost, audit, initials))
        if costs.insert and cost + costs.insert <= best[0]:
            for r in "ua":
                go(at, cost + costs.insert, audit + "I", initials + r)
        if at == len(rows):
            return
        role, gone, cut = rows[at]
        go(at + 1, cost + costs.delete, audit + "D", initials)
        if not gone:
            more = costs.truncated if cut else 0
            go(at + 1, cost + costs.keep + more, audit + "K", initials + (role[:1] or "-"))
            for r in "ua":
                go(at + 1, cost + costs.rerole + more, audit + "R", initials + r)

    go(0, 0, "", "")
    return best


def blocks_of(rows, size, costs):
    pieces = [rows[i:i + size] for i in range(0, len(rows), size)]
    return [(len(p), [tr.block_weights([(r[:1], g, c) for r, g, c in p], s, costs) for s in range(tr.STATES)]) for p in pieces]


@pytest.mark.parametrize("costs", [tr.EditCosts(), tr.EditCosts(insert=1, inserts=6), tr.EditCosts(rerole=3, delete=4, insert=3, truncated=1, inserts=6)])
def test_chain_matches_every_edit(costs):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", " "]
    for trial in range(250):
        rows = [(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 5))]
        want = cheapest(rows, costs)
        for size in (1, 2, 8):
            cost, parts = tr.chain(blocks_of(rows, size, costs), costs)
            assert (cost, "".join(a for _, a in parts)) == want[:2]
            got = ""
            for i, (state, letters) in enumerate(parts):
                piece = [(r, "x", 1) for r, _, _ in rows[i * size:(i + 1) * size]]
                got += "".join(line[0] for line in tr.replay(piece, letters, state))
            assert got == want[2]


def test_one_layer_of_inserts_is_enough():
    """Where an insert costs over two deletions, more layers change nothing."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("uas"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(0, 14))]
        results = [tr.chain(blocks_of(rows, 5, costs), costs) for costs in (tr.EditCosts(inserts=n) for n in (0, 1, 4))]
        audits = [(c, "".join(a for _, a in p)) for c, p in results]
        assert audits[0] == audits[1] == audits[2] and "I" not in audits[0][1]


def brute(conversations, costs=tr.EditCosts()):
    """conversations: {conv: [(turn, role, text)]}."""
    out = {}
    for conv, rows in conversations.items():
        after = []
        for turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            words = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
        flat = [(r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(after, faults)]
        cost, parts = tr.chain([(1, b) for _, b in blocks_of(flat, 1, costs)], costs)
        if len(flat) <= 6:
            assert (cost, "".join(a for _, a in parts)) == cheapest(flat, costs)[:2]
        lines = []
        for (_, role, text), (state, letters) in zip(after, parts):
            lines += tr.replay([(role, text, 1)], letters, state)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, "".join(a for _, a in parts),
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return out


def test_query_matches_brute_force(spark, sf):
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_big_integer_repair(spark, sf).collect()}
    assert got == brute(grouped(read(spark, sf, "conversations")))


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("n", "part", "Block", "first", "digest", "code")]])


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(1)
    more = ["x"] * 6
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Turn {t} says so." if t % 7 else "Again and again.", *more) for t in range(3000)]
    rows += [(2, 5, "user", "The same row.", *more)] * 700 + [(None, 1, "user", "Hi.", *more), (None, 2, "assistant", "Hello.", *more)]
    rows += [(3, None, None, None, *more), (3, None, "user", "No turn.", *more), (3, 4, "", "No role.", *more), (3, 4, "tool", "A tool.", *more)]
    rows += [(4, 0, "user", "long " * 300_000 + "end.", *more), (4, 1, "assistant", " \t\n\x0b\x0c\r ", *more), (4, 1, "assistant", "é ü 漢字!　", *more)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", "Why?", "", "Go on."]), *more) for c in range(10, 60) for t in rng.sample(range(12), 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_awkward_rows(spark, conversations):
    got = {r.conv_id: tuple(r)[1:] for r in tr.repair(conversations).collect()}
    want = brute(grouped(conversations))
    assert got.keys() == want.keys() and {c for c in want if got[c] != want[c]} == set()
    assert got[2][2] >= 699 and len(got[2][6]) == got[2][2] + 1
    nothing = spark.createDataFrame([], SCHEMA)
    assert tr.repair(nothing).count() == 0


def test_blocks_change_nothing(conversations, monkeypatch):
    want = sorted(map(str, tr.repair(conversations).collect()))
    monkeypatch.setattr(tr, "BLOCK_ROWS", 7)
    assert sorted(map(str, tr.repair(conversations).collect())) == want


def test_all_rows_dropped(spark):
    lost = [(c, t) for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    rows = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in lost], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[1:] for r in tr.repair(rows).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * len(lost)
