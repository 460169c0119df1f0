from wardline.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string, place string, s1 int, segment int"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def plain(rows):
    """Maximal conversations by comparing all with all."""
    talks = {}
    for conv, turn, role, text in set(rows):
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    first = {}
    for c, said in sorted(talks.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(tuple(said), c)
    return {c: said for said, c in first.items()
            if not any(len(x) > len(said) and tuple(x[:len(said)]) == said for x in talks.values())}


def check(spark, rows):
    got = {}
    for r in chats.collapse(log(spark, rows)).orderBy("conv", "place").collect():
        got.setdefault(r["conv"], []).append((r["role"], r["text"]))
    assert {c: tuple(v) for c, v in got.items()} == plain(rows)


def test_snapshots(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(n, i, *turns[i]) for n in range(1, 5) for i in range(n)]
    rows += [(9, i, *t) for i, t in enumerate([("user", "hi"), ("assistant", "other")])]
    rows += [(c, i, *t) for c in (11, 12) for i, t in enumerate(turns)]
    check(spark, rows)


def test_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, None, None, None),
            (2, None, "", ""), (None, 0, "user", "z"), (None, 1, "user", "y" * 90_000),
            (3, 5, "user", "z"), (4, 0, "ab", "c"), (5, 0, "a", "bc"), (5, 1, "a", "q")]
    check(spark, rows)
    assert chats.render(chats.collapse(log(spark, rows).limit(0))).count() == 0


def test_long_conversations_run_over_buckets(spark):
    rows = [(1, i, "user", str(i)) for i in range(700)] + [(2, i, "user", str(i)) for i in range(600)]
    rows += [(3, i, "user", str(i)) for i in range(299)] + [(3, 299, "user", "else")]
    check(spark, rows)
    parts = chats.render(chats.collapse(log(spark, rows))).orderBy("conv", "segment").collect()
    assert [(r["conv"], r["segment"]) for r in parts] == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)]
    whole = "".join(r["text"] for r in parts if r["conv"] == 1)
    assert whole == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(700))
