"""The trie against plain dictionaries, whole and with containers that burst."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from cases import words

from wardline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, steps string, head int, path string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def talks_of(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}


def plain(talks):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, said in talks.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(conv)
        ends[tuple(said)].append(conv)
    children = defaultdict(list)
    for said in members:
        if said:
            children[said[:-1]].append(said)
    found = set()

    def below(said):
        return [said, *(x for c in children[said] for x in below(c))]

    for said, own in members.items():
        under = below(said)
        found.add((min(own), len(said), min(members[said[:-1]]) if said else None, len(own),
                   len(children[said]), sum(not children[x] for x in under),
                   sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in under if x),
                   hashlib.sha256(",".join(map(str, sorted(ends[said]))).encode()).hexdigest()))
    return sorted(found, key=repr)


def rows_of(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def drawn(seed, convs=60, longest=9):
    draw = random.Random(seed)
    return [(draw.randrange(convs), draw.choice([None, t, t]), draw.choice(["user", "user", None]),
             draw.choice(["a b", "c", None, "d  e f"])) for t in range(longest)
            for _ in range(convs)]


@pytest.mark.parametrize("limit", [1, 7, 1 << 16])
def test_drawn_conversations(spark, limit):
    rows = [*drawn(4), (None, 1, "user", "no conversation"), (900, 1, "user", "x" * 200_000)]
    assert rows_of(pt.trie(log(spark, rows), limit=limit)) == plain(talks_of(rows))


def test_snapshots_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(c % 13 + 1)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(5)]
    assert rows_of(pt.trie(log(spark, rows), limit=20)) == plain(talks_of(rows))


def test_rebuilt(spark):
    rows = [(c, t, "user", f"{c % 3} turn {t}") for c in (0, 1, 2, 3, 7, 19, 21, 22, 23, 40, 41, 55, 64, 68, 72, 76)
            for t in range(c % 4 + 1)]
    own = talks_of(rows)
    talks = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        talks[c] = own.get(c - c % 20, [])[:h] + said[h:]
    assert any(not said for said in talks.values())
    convs = pt.rebuilt(pt.sequences(log(spark, rows), "conv_id", "turn", "role", "text"))
    assert rows_of(pt.build(convs, limit=3)) == plain(talks)


def test_empty(spark):
    assert pt.trie(log(spark, []).limit(0)).count() == 0
