import json
import re

import plain
import pytest
from pyspark.sql import functions as F

from wardline.functions import patterns as P
from wardline.functions.spans import pii_spans, sums_before
from wardline.functions.text import redact_pii
from wardline.operators.free_rows import govern_free_rows, leaves, screen_free_rows
from wardline.plans.seeds import SEEDS


def plain_spans(text):
    """Kinds claim their matches one after the other, each from what is left."""
    found, left = [], text
    for name, rx in plain.PII:
        for m in list(rx.finditer(left)):
            found.append((name, m.start(), m.end()))
            left = left[:m.start()] + "[" * (m.end() - m.start()) + left[m.end():]
    return sorted(found, key=lambda s: s[1])


def test_spans_are_what_redaction_replaces(spark):
    texts = [*plain.mixed_texts(1500, 11), *SEEDS, "", "\ue000\ue001 a@b.com\ue001", "😀 a@b.com",
             "a@b.com,c@d.org 123-45-6789 " * 400, "salary" * 3, "gehalt gehalt"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = df.select("i", pii_spans(F.col("t")).alias("s"), redact_pii(F.col("t")).alias("r"))
    for i, spans, redacted in got.collect():
        text, spans = texts[i], [tuple(s) for s in spans]
        assert spans == plain_spans(text), repr(text)
        for kind, start, end in reversed(spans):
            text = f"{text[:start]}[REDACTED:{kind.upper()}]{text[end:]}"
        assert text == redacted, repr(texts[i])


def test_null_text_has_null_spans(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(pii_spans(F.col("t"))).first()[0] is None


def test_sums_before(spark):
    numbers = [list(range(n)) for n in (0, 1, 2, 3, 4, 7, 8, 9, 30)]
    df = spark.createDataFrame([(n,) for n in numbers], "n array<bigint>")
    for n, sums in df.select("n", sums_before(F.col("n"), 4)).collect():
        assert sums == [sum(n[:i]) for i in range(len(n))]


def plain_leaves(value, path=""):
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            inner = k if not path else f"{path}.{k}"
            out += plain_leaves(v, inner if re.fullmatch(r"\w+", k, re.A) else f"{path}['{k}']")
        return out
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in plain_leaves(v, f"{path}[{i}]")]
    text = value if isinstance(value, str) or value is None else json.dumps(value)
    return [(path, text, isinstance(value, str))]


ROWS = [
    {"model": "A4", "notes": SEEDS[0], "salary": 85000, "on": True, "none": None},
    {"deep": {"er": [{"mail": "a@b.com"}, ["x", {"says": SEEDS[3]}]], "empty": {}, "no": []}},
    {"odd.key": {"a b": "123-45-6789"}, "notes": "short", "ä": 1.5},
    {}, [], [SEEDS[1], 3], "just text, a@b.com", 12, None,
]


def test_leaves_of_any_shape(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)],
                               "i int, c string")
    for i, found in df.select("i", leaves(F.col("c"))).collect():
        assert sorted(map(tuple, found)) == sorted(plain_leaves(ROWS[i])), ROWS[i]


def test_content_that_is_no_json(spark):
    df = spark.createDataFrame([("{not json", ), (None,), ("",)], "c string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(leaves(F.col("c"))).collect()]
    assert got == [[("", "{not json", True)], None, [("", "", True)]]


def test_deep_content_is_one_leaf(spark):
    df = spark.createDataFrame([('{"a": {"b": {"c": "a@b.com"}}}',)], "c string")
    got = df.select(leaves(F.col("c"), 2).alias("l")).first()["l"]
    assert [tuple(x) for x in got] == [("a.b", '{"c":"a@b.com"}', False)]


@pytest.mark.parametrize("ceiling", [1, 2, 3])
def test_governed_fields_by_plain_rules(spark, ceiling):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)],
                               "i int, c string")
    masked, dropped = ["deep.er[1]", "model"], ["none"]
    for r in govern_free_rows(df, "c", ceiling, masked, dropped).collect():
        want = []
        for path, value, _ in plain_leaves(ROWS[r["i"]]):
            if path == "none":
                continue
            reason = None
            if path == "model" or path.startswith("deep.er[1]"):
                value, reason = P.MASKED, "MASKED"
            elif value is not None and plain.rank(value) > ceiling:
                reason = "PII" if plain.kinds(value) else "ABOVE_CLEARANCE"
                value = P.CELL_PII if reason == "PII" else P.CELL_ABOVE_CLEARANCE
            want.append((path, value, reason))
        assert sorted(map(str, map(tuple, r["fields"]))) == sorted(map(str, want))


def test_screened_fields_have_paths(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)],
                               "i int, c string")
    got = {(r["i"], r["path"]): r["assessment"]["triggered"]
           for r in screen_free_rows(df, "c", ["i"]).collect()}
    want = {(i, path): plain.triggered(value) for i, row in enumerate(ROWS)
            for path, value, is_text in plain_leaves(row)
            if is_text and len(value) > 10 and plain.triggered(value)}
    assert got == want and (1, "deep.er[1][1].says") in got


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "{}")], "i int, c string")
    for out in (govern_free_rows(df, "c", 1), screen_free_rows(df, "c", ["i"]),
                df.select(pii_spans(F.col("c")))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
