"""Plain restatements of the text rules, one value at a time, used only to check results."""

from __future__ import annotations

import random
import re

from wardline.functions import patterns as P
from wardline.plans.seeds import SEEDS


def compiled(p: P.Pattern) -> re.Pattern:
    return re.compile(p.regex, re.IGNORECASE if p.ignore_case else 0)


PII = [(p.name, compiled(p)) for p in P.PII_PATTERNS]
LAYERS = [(f"{layer}:{p.name}", compiled(p))
          for layer, ps in P.INJECTION_PATTERNS.items() for p in ps]
AMOUNT = compiled(P.CURRENCY)


def kinds(text: str) -> list[str]:
    found = []
    for name, rx in PII:
        hits = [m.group() for m in rx.finditer(text)]
        if name == "vin":
            hits = [h for h in hits if re.search("[0-9]", h) and re.search("[A-Z]", h)]
        if hits:
            found.append(name)
    return found


def rank(text: str) -> int:
    low, found = text.lower(), kinds(text)
    if set(found) & set(P.RESTRICTED_PII) or any(w in low for w in P.RESTRICTED_KEYWORDS):
        return 3
    if found or AMOUNT.search(text) or any(w in low for w in P.CONFIDENTIAL_KEYWORDS):
        return 2
    return 1


def redact(text: str) -> str:
    for name, rx in PII:
        text = rx.sub(f"[REDACTED:{name.upper()}]", text)
    return text


def chunks(text: str, size: int = 500, overlap: int = 64) -> list[str]:
    step = size - overlap if size > overlap else size
    out, start = [], 0
    while start < len(text):
        out.append(text[start:start + size])
        if start + size >= len(text):
            break
        start += step
    return out


def govern(text: str, ceiling: int, size: int = 500) -> tuple[int, int, str]:
    """Redactions, highest rank and text for the receiver."""
    parts, count = [], 0
    ranks = [rank(c) for c in chunks(text, size)]
    for chunk, level in zip(chunks(text, size), ranks):
        if level > ceiling:
            count += 1
            cleaned = redact(chunk)
            hidden = not kinds(chunk) or rank(cleaned) > ceiling
            chunk = P.WITHHELD if hidden else cleaned
        parts.append(chunk)
    return count, max(ranks, default=0), "\n".join(parts)


def triggered(text: str) -> list[str]:
    return [name for name, rx in LAYERS if rx.search(text)]


def mixed_texts(n: int, seed: int = 7) -> list[str]:
    """Texts of seeds, near misses, odd blanks and letters, cut and joined at random."""
    rng = random.Random(seed)
    odd = ["ſ", "ı", "İ", "K", " ", "\x1c", "\r", "\n", "\t", " ",
           "é", "ß", "中", "😀", "0", "9", "-", "+", ".", ",", "@", "<", ">", "[", "]", "_", "'"]
    words = ["instruction", "you are", "now", "act as", "helpful", "a", "an AI", "the", "email",
             "send", "1234 EUR", "99999€x", "cost", "costume", "health", "Brand_A", "2001-12-31",
             "555-123-4567", "12345678901234567", "ABCDEFGHJKLMNPRST", "90, 180.0000", "DAN",
             "from", "now on", "<!--", "ſalary", "ınstruction", "DİSREGARD", "K", "api Key"]
    texts = []
    for _ in range(n):
        parts = [rng.choice([*SEEDS, *words, *odd]) for _ in range(rng.randint(1, 9))]
        text = rng.choice(["", " ", "\n", " ", "\x1d"]).join(parts)
        if rng.random() < 0.4:
            text = text.swapcase()
        if rng.random() < 0.3:
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(odd) + text[cut:]
        texts.append(text)
    return texts
