"""Rows that every operator must take, and plain helpers."""

import os
import re

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 900}x{i % 7}" for i in range(30_000))
PROSE = " ".join(f"word{i * 37 % 101} and{i * 11 % 23}" for i in range(60))

#: Nulls, empty and very long texts, repeated rows, ties; extra columns with names operators use.
EDGES = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE + " more", "en", "a"),
    (3, PROSE, "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \t\n ", "de", "c"),
    (7, "one", "de", "c"), (8, "one two", None, None), (9, LONG, "en", "a"),
    (10, LONG + " end", "en", "a"), (None, PROSE, "en", "a"), (None, None, None, None),
    (12, "same same same same " * 30, "fr", "d"), (13, "x" * 70_000, "fr", "d"),
    (14, "Ünï 中文 😀 <|endoftext|> \x1c \x85 a b", "fr", "d"),
]
CLASHES = ("size", "rate", "copies", "row", "node", "n_words", "kept", "score", "predicted",
           "tokens", "part", "label", "m_doc", "component_id")
BASE = "doc_id long, text string, lang string, source string, n_chars long, "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
