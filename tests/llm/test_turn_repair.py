"""Repair against a plain search over all edits, in one piece and cut into many."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from wardline.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, n long, kinds string, fault string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """All columns of one conversation; rows are (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ",
                    x if x is not None else " ") for t, r, x in rows))
    rows = [(t if known else None, r, x) for known, t, r, x in rows]
    seen, faults = set(), []
    for _, role, text in rows:
        solid = BLANK.findall(text)
        faults.append("b" if not solid else "d" if (role, text) in seen
                      else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    def step(state, letter):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, letter))

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            for role in ("user", "assistant"):
                to = step(state, role[0])
                if to and (rest := best(i, to, inserted + 1)):
                    found.append((rest[0] + 5, "I" + rest[1], (f"{role}:", *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if faults[i] not in ("b", "d"):
                more = 5 * (faults[i] == "t")
                for to_role, paid, op in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    to = step(state, to_role[:1])
                    if to and (rest := best(i + 1, to, 0)):
                        found.append((rest[0] + paid + more, op + rest[1],
                                      (f"{to_role}:{text}", *rest[2])))
        return min(found, default=None)

    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = best(0, 0, 0)
    firsts = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": faults.count("b"), "duplicate": faults.count("d"),
            "truncated": faults.count("t"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def log(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], SCHEMA)


def check(spark, rows):
    got = {r["conv_id"]: r.asDict() for r in tr.repair(log(spark, rows)).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs:
        expected = plain([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == {"conv_id": conv, **expected}


def drawn(seed, convs, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Why?", "more. ", "a\nb."]
    return [(c, draw.choice([None, t, t, t + 1]), draw.choices(roles, [8, 8, 3, 1, 1, 1])[0],
             draw.choice(texts) if draw.random() < 0.4 else f"text {draw.random()}.")
            for c in range(convs) for t in range(draw.randint(1, longest))]


def test_drawn_conversations(spark):
    check(spark, drawn(1, 150, 14) + [(None, 1, "user", "a."), (None, 2, "assistant", "b.")])


def test_pieces_meet(spark, monkeypatch):
    rows = drawn(2, 6, 40)
    whole = {r["conv_id"]: r for r in tr.repair(log(spark, rows)).collect()}
    kinds = random.Random(3).choices(range(16), k=301)
    codes = np.array(kinds, np.uint8)
    cuts = [0, 1, 2, 40, 170, 300, 301]
    lows, highs = np.array(cuts[:-1]), np.array(cuts[1:])
    states, total = tr.chained(*tr.summed(codes, lows, highs))
    one, same = tr.chained(*tr.summed(codes, np.array([0]), np.array([301])))
    assert total == same and states[-1] == one[-1]
    assert list(tr.audits(codes, lows, highs, states[:-1], states[1:])) == list(
        tr.audits(codes, [0], [301], [0], [one[-1]]))
    assert whole[0]["audit"] == plain([r[1:] for r in rows if r[0] == 0])["audit"]


@pytest.mark.parametrize("seed", range(5))
def test_costs_of_labels(seed):
    """Hirschberg's path costs what the vectors say."""
    kinds = np.array(random.Random(seed).choices(range(16), k=97), np.uint8)
    cost, _ = tr.summed(kinds, np.array([0]), np.array([97]))
    for last in range(4):
        if cost[0, 0, last] < tr.FAR:
            labels = tr.audits(kinds, [0], [97], [0], [last])
            state, paid = 0, 0
            for kind, label in zip(kinds, labels):
                ends = np.flatnonzero((tr.LABEL[kind, state] == label)
                                      & (tr.COST[kind, state] < tr.FAR))
                assert len(ends) >= 1
                paid += tr.COST[kind, state, ends[0]]
                state = ends[0]
            assert (state, paid) == (last, cost[0, 0, last])


def test_long_conversation_and_texts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(9_001)]
    rows += [(2, 0, "user", "x" * 1_500_000 + "."), (2, 1, "assistant", "y" * 1_500_000)]
    rows += [(3, 0, "user", "same.")] * 5_000
    got = {r["conv_id"]: r for r in tr.repair(log(spark, rows)).collect()}
    assert got[1]["audit"] == "K" * 9_000 + "D" and got[1]["cost"] == 2
    body = "\n".join(f"{r}:{x}" for _, _, r, x in rows[:9_000])
    assert got[1]["repaired_sha256"] == hashlib.sha256(body.encode()).hexdigest()
    assert got[2]["cost"] == plain([r[1:] for r in rows if r[0] == 2])["cost"] == 4
    assert (got[3]["duplicate"], got[3]["audit"]) == (4_999, "D" * 5_000)


def test_empty(spark):
    assert tr.repair(log(spark, []).limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b!{t}?") for c in (1, 2, None) for t in (*range(60), None)]
    got = {(r["conv_id"], r["turn"]): r for r in tr.damaged(log(spark, rows)).collect()}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        if case == 0:
            assert (conv, turn) not in got
            continue
        row = got[conv, turn]
        assert row["role"] == ("user" if case == 4 else role)
        assert row["text"] == ("" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
        assert row["copies"] == (2 if case == 3 else 1)
