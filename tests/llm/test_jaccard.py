import random
from pathlib import Path

import pytest
from cases import EDGES

from wardline.llm import common, graphs, jaccard


def plain(rows, size=3, share=90):
    """Set sizes and smallest reachable ids by comparing all pairs."""
    sets = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        sets.append({tuple(found[i:i + size]) for i in range(max(len(found) - size + 1, 1))}
                    if found else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least[find(i)] = min(id, least.get(find(i), id))
    return sorted(((id, len(s), least.get(find(i))) for i, ((id, _), s) in
                   enumerate(zip(rows, sets))), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def near_copies(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 12, 30, 90, 250, 700]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randrange(1 + len(copy) // 12))]
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("size, share, block", [(3, 90, 4 << 20), (5, 80, 4 << 20), (3, 90, 4000)])
def test_all_links_of_near_copies(spark, size, share, block):
    rows = near_copies(size + share + block, 45)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(docs, size=size, share=share, block_bytes=block)
    assert found(got) == plain(rows, size, share)


def test_chain_over_blocks(spark):
    """Neighbours in a chain are linked, its ends aren't; blocks cut it anywhere."""
    base = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 8:] + [f"d{k}" for k in range(i * 8)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.join(docs, block_bytes=9000)) == plain(rows)


def test_signatures_meet():
    """Sets that link have a signature in common, whatever their sizes."""
    import numpy as np
    rng = np.random.default_rng(3)
    for share in (80, 90):
        for n in [*range(1, 60), 130, 500, 1300]:
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            union = len(a) * 100 // share
            b = np.unique(np.concatenate([a, rng.integers(0, 1 << 62, union - len(a), dtype=np.uint64)]))
            assert jaccard.linked(a, b, share)
            left, right = jaccard.signatures(a, share), jaccard.signatures(b, share)
            met = [len(np.intersect1d(x, y)) for x, _ in left for y, _ in right]
            assert max(met) > 0
            # Each level at which both speak has as many in common as both sides need.
            assert any(len(np.intersect1d(x, y)) >= max(n, m)
                       for x, n in left for y, m in right)


def test_edges(edges, nothing):
    rows = [r[:2] for r in EDGES]
    assert found(jaccard.join(edges)) == plain(rows)
    left = jaccard.keep_one(edges)
    assert left.columns == edges.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=repr)
    # 2, 3, the second 1 and the null id are copies of 1, and 10 is one of 9; those without words stay.
    assert ids == sorted([1, 4, 5, 6, 7, 8, 9, 12, 13, 14, None], key=repr)
    assert jaccard.join(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_bundles_keep_shared_keys():
    """Of bundled keys those that two classes have come back, once each, with class and need."""
    import numpy as np
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 400, 3000, dtype=np.uint64) * np.uint64((1 << 48) // 400)
    who = rng.integers(0, 40, 3000)
    nodes = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    nodes[20:] = nodes[:20]  # copies in one task more, with the same needs
    needs = np.tile(rng.integers(1, 300, 20), 2)
    entries = {(int(k), int(nodes[w]), int(needs[w])) for k, w in zip(keys, who)}
    owners = {}
    for k, node, _ in entries:
        owners.setdefault(k, set()).add(node)
    wanted = sorted(e for e in entries if len(owners[e[0]]) > 1)
    width = -(-(1 << 48) // 7)
    got = []
    for low in (0, 1500):  # two tasks
        got += jaccard.bundle(keys[low:low + 1500], who[low:low + 1500], nodes, needs, width)
    back = []
    for number in {x[0] for x in got}:
        parts = [jaccard.unbundled(*x, width) for x in got if x[0] == number]
        back += zip(*(x.tolist() for x in jaccard.met(*(np.concatenate(p) for p in zip(*parts)))))
    assert sorted(back) == wanted and len(got) == 14
    lone = jaccard.met(np.arange(3), np.arange(3), np.arange(3))
    assert [len(x) for x in lone] == [0, 0, 0]


def test_texts_outside_families_stay(spark):
    """Only texts of rows that may link are packed and sent, not those of all documents."""
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(40))) for i in range(300)]
    rows += [(300, "z " + rows[7][1]), (301, rows[7][1] + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    whole = jaccard.packed_rows

    def watched(*args):
        sent.append(whole(*args).count())
        return whole(*args)

    jaccard.packed_rows = watched
    try:
        assert found(jaccard.join(docs)) == plain(rows)
    finally:
        jaccard.packed_rows = whole
    assert sent and sent[0] <= 10


def chained(spark, n=300):
    """Links of a chain, which takes many rounds, and the roots of its nodes."""
    rng = random.Random(11)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)]
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    return links, sorted((x, min(names)) for x in names)


def test_rounds_of_components_leave_nothing(spark, monkeypatch):
    """Each round deletes its tables and lets the driver drop what it holds of them."""
    links, wanted = chained(spark)
    made, collected = [], []
    path, free = common.shared_folder, graphs.freed

    def watched(session, *tables):
        collected.append(len(tables))
        free(session, *tables)

    monkeypatch.setattr(common, "shared_folder", lambda s: made.append(path(s)) or made[-1])
    monkeypatch.setattr(graphs, "freed", watched)
    monkeypatch.setattr(graphs, "FEW", 0)
    roots = graphs.components(links)
    assert sorted(map(tuple, roots.collect())) == wanted
    left = [p for p in made if Path(p.removeprefix("file:")).exists()]
    assert roots.stored_at in left and len(left) <= 2 and len(made) > 10
    # Two tables to begin with and five of each round.
    assert collected == [5] * ((len(made) - 2) // 5)


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Three tables are stored for few links, not five more for every round."""
    links, wanted = chained(spark)
    made = []
    path = common.shared_folder
    monkeypatch.setattr(common, "shared_folder", lambda s: made.append(path(s)) or made[-1])
    roots = graphs.components(links)
    assert sorted(map(tuple, roots.collect())) == wanted and len(made) == 3
    monkeypatch.setattr(graphs, "FEW", 400)  # a round or more, then one task
    assert sorted(map(tuple, graphs.components(links).collect())) == wanted and len(made) > 8
    none = graphs.components(links.limit(0))
    assert none.collect() == [] and none.columns == ["node", "root"]


def test_least_of_links():
    import numpy as np
    rng = np.random.default_rng(2)
    for links in (1, 30, 200):
        a, b = rng.integers(-150, 150, (2, links))
        near = {x: {x} for x in {*a.tolist(), *b.tolist()}}
        for x, y in zip(a.tolist(), b.tolist()):
            both = near[x] | near[y]
            for z in both:
                near[z] = both
        names, least = graphs.least_of(a, b)
        assert dict(zip(names.tolist(), least.tolist())) == {x: min(s) for x, s in near.items()}
