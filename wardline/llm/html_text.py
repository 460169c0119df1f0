"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: the visible text between two block tags, with the tags and
class words of its ancestors. Features of ancestors and text give each block a score for both
labels, neighbours are tied by transition scores, and Viterbi decodes the page. The
weights are fitted on labelled pages. The tables hold none, so the pages come from a seeded
generator of page layouts (`labelled_pages`), which is no part of the result; pass others to `train`.

Defined results. A null or empty page, or one without visible text, gives an empty text. Scripts,
styles, heads, templates and comments are no text. A head ends where a tag or text comes that cannot
stand in it, a drawing where a tag of the page comes, and any silent part where an ancestor closes;
one that is closed nowhere is read as text. Unclosed and crossed tags are mended as they come; an
unclosed comment or script runs to the end of the page. Text is never cut. Repeated rows
repeat their result; other columns are not carried; empty tables give empty tables.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardline.llm.batches import slices
from wardline.llm.common import read, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head template title noscript iframe svg".split())
RAW = frozenset("script style title iframe textarea".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s "
                   "samp small span strike strong sub sup time tt u var wbr img br input object "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded "
                   "mphantom mfenced menclose msub msup msubsup munder mover munderover "
                   "mmultiscripts mprescripts none mtable mtr mtd mlabeledtr semantics annotation "
                   "annotation-xml maction".split())
#: What may stand in a head, and tags that end a drawing outside its foreign objects.
HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes "
                 "template".split())
PAGE = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head "
                 "hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub "
                 "sup table tt u ul var article section main nav aside header footer".split())
#: A tag of the key ends open tags of the value's kinds first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body article section div main nav aside".split())

MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)"
                    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    features: list[str]


class Reader:
    """Reads one page into blocks; of tag features only the `known` ones, if these are given.

    Places of open tags and counts of open features are kept, so that no tag walks the stack.
    """

    def __init__(self, known: Container[str] | None = None) -> None:
        self.known = known
        self.stack: list[tuple[str, set[str]]] = [("", set())]
        self.places: dict[str, list[int]] = {}
        self.within: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []
        self.depth_of_links = 0
        #: Places on the stack of open tags whose text is left out.
        self.silent: list[int] = []

    def flush(self) -> None:
        if not self.text:
            return
        raw = "".join(self.text)
        self.text = []
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            self.blocks.append(Block(text, [*self.within, *text_features(text, self.linked)]))
        self.linked = 0

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.depth_of_links:
            self.linked += len(text)

    def push(self, tag: str, attributes: str) -> None:
        found = {f"in:{tag}"}
        if attributes:
            for kind, *values in ATTRIBUTE.findall(attributes):
                found |= {f"as:{w}" for w in WORD.findall("".join(values).lower())}
        if self.known is not None:
            found = {f for f in found if f in self.known}
        for f in sorted(found):
            self.within[f] = self.within.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, found))
        self.depth_of_links += tag == "a"

    def last(self, *tags: str) -> int:
        """The place of the innermost open tag of these, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self) -> None:
        tag, found = self.stack.pop()
        self.places[tag].pop()
        for f in found:
            self.within[f] -= 1
            if not self.within[f]:
                del self.within[f]
        self.depth_of_links -= tag == "a"
        if self.silent and self.silent[-1] == len(self.stack):
            self.silent.pop()

    def in_silent(self) -> str:
        """The innermost open tag whose text is left out."""
        return self.stack[self.silent[-1]][0] if self.silent else ""

    def end_silent(self, place: int) -> None:
        self.flush()
        while len(self.stack) > place:
            self.pop()

    def leave_for(self, tag: str) -> None:
        """End the silent parts in which a tag cannot stand."""
        if not self.silent:
            return
        kind = self.in_silent()
        if tag == "body":
            self.end_silent(self.silent[0])
        elif kind == "head" and tag not in HEAD:
            self.end_silent(self.silent[-1])
        elif (kind == "svg" and tag in PAGE
              and self.last("foreignobject", "desc") < self.silent[-1]):
            while self.in_silent() == "svg":
                self.end_silent(self.silent[-1])
            self.leave_for(tag)

    def open(self, tag: str, attributes: str, silent: bool = False) -> None:
        if self.silent:  # nothing ends before it outside of a silent part
            if tag not in VOID:
                self.push(tag, attributes)
                if silent:
                    self.silent.append(len(self.stack) - 1)
            return
        if tag not in INLINE:
            self.flush()
            if self.last("p") and tag not in ("option", "source", "param"):
                self.close("p")
            if tag in ENDS:
                place = self.last(*ENDS[tag])
                if place > self.last(*SCOPES):
                    self.close(self.stack[place][0])
        elif tag == "br":
            self.add(" ")
        if tag not in VOID:
            self.push(tag, attributes)
            if silent:
                self.silent.append(len(self.stack) - 1)

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        place = self.last(tag)
        while place and len(self.stack) > place:
            self.pop()


def closing(page: str, tag: str, start: int) -> int:
    found = re.compile(f"</{tag}", re.I).search(page, start)
    return found.start() if found else len(page)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order."""
    reader, at = Reader(known), 0
    ends: dict[str, int] = {}

    def end(tag: str) -> int:
        if ends.get(tag, -1) < at:
            ends[tag] = closing(page, tag, at)
        return ends[tag]

    def add(text: str) -> None:
        if reader.in_silent() == "head" and text.strip():
            reader.end_silent(reader.silent[-1])
        if not reader.silent:
            reader.add(text)

    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            mark = len(page)
        if mark > at:
            add(page[at:mark])
        if mark == len(page):
            break
        found = MARKUP.match(page, mark)
        if found is None:  # a lone "<" is text
            add("<")
            at = mark + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            reader.close(tag)
        elif tag in SILENT and found[3].rstrip().endswith("/"):
            continue
        else:
            reader.leave_for(tag)
            raw = tag in RAW or tag == "noscript" and end(tag) < len(page)
            reader.open(tag, found[3], tag in SILENT and (
                raw or tag == "head" or end(tag) < len(page)))
            if raw:
                at = end(tag)
    reader.flush()
    return reader.blocks


def text_features(text: str, linked: int) -> list[str]:
    """Length, links, sentence ends and signs, each in a few bins."""
    words = text.count(" ") + 1
    found = ["bias", f"words:{min(words.bit_length(), 7)}",
             f"links:{min(3, 4 * linked // max(len(text), 1))}"]
    if text[-1] in ".!?\"'”»":
        found.append("sentence")
    if "©" in text:
        found.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        found.append("bars")
    return found


class Field:
    """Emission weights per feature, transitions, and scores of the first and last label."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray,
                 first: np.ndarray, last: np.ndarray) -> None:
        self.emit = dict(zip(names, emit.tolist()))
        self.move, self.first, self.last = move.tolist(), first.tolist(), last.tolist()

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels by Viterbi; equal paths prefer to leave a block out."""
        if not page:
            return []
        rows = []
        for block in page:
            a = b = 0.0
            for name in block.features:
                pair = self.emit.get(name)
                if pair:
                    a += pair[0]
                    b += pair[1]
            rows.append((a, b))
        (m00, m01), (m10, m11) = self.move
        out, main = self.first[0] + rows[0][0], self.first[1] + rows[0][1]
        back = []
        for a, b in rows[1:]:
            stay, come = out + m00, main + m10
            go, keep = out + m01, main + m11
            back.append((int(come > stay), int(keep > go)))
            out, main = max(stay, come) + a, max(go, keep) + b
        label = int(main + self.last[1] > out + self.last[0])
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def train(pages: Iterable[tuple[list[Block], list[int]]], rounds: int = 200,
          rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a small penalty, by gradient steps over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    index = {f: i for i, f in enumerate(names)}
    n, steps = len(pages), max(len(page) for page, _ in pages)
    cells, owners = [], []
    gold = np.zeros((n, steps), dtype=np.int64)
    live = np.zeros((n, steps), dtype=bool)
    for i, (page, labels) in enumerate(pages):
        gold[i, :len(page)] = labels
        live[i, :len(page)] = True
        for t, block in enumerate(page):
            ids = [index[f] for f in block.features]
            cells += ids
            owners += [i * steps + t] * len(ids)
    cells, owners = np.array(cells), np.array(owners)
    last_place = live.sum(1) - 1
    rows = np.arange(n)
    weights = np.zeros(2 * len(names) + 8)
    moment, square = np.zeros_like(weights), np.zeros_like(weights)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(rounds):
        emit = weights[:-8].reshape(-1, 2)
        move, first, last = weights[-8:-4].reshape(2, 2), weights[-4:-2], weights[-2:]
        score = np.zeros((n * steps, 2))
        for label in (0, 1):
            score[:, label] = np.bincount(owners, emit[cells, label], n * steps)
        score = score.reshape(n, steps, 2)
        ahead = np.zeros((n, steps, 2))
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, steps):
            ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
        behind = np.zeros((n, steps, 2))
        behind[rows, last_place] = last
        for t in range(steps - 2, -1, -1):
            later = log_sum(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < last_place)[:, None], later, behind[:, t])
        whole = log_sum(ahead[rows, last_place] + last, 1)
        seen = np.exp(ahead + behind - whole[:, None, None]) * live[..., None]
        gap = seen - (np.eye(2)[gold] * live[..., None])
        flat = gap.reshape(-1, 2)
        slope = np.zeros_like(weights)
        for label in (0, 1):
            slope[label:-8:2] = np.bincount(cells, flat[owners, label], len(names))
        pairs = live[:, 1:, None, None] * np.exp(
            ahead[:, :-1, :, None] + move + (score + behind)[:, 1:, None, :]
            - whole[:, None, None, None])
        moved = np.zeros((2, 2))
        np.add.at(moved, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        slope[-8:-4] = (pairs.sum((0, 1)) - moved).ravel()
        slope[-4:-2] = gap[:, 0].sum(0)
        slope[-2:] = gap[rows, last_place].sum(0)
        slope = slope / n + decay * weights
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        weights = weights - rate * (moment / (1 - 0.9 ** (k + 1))) / (
            np.sqrt(square / (1 - 0.99 ** (k + 1))) + 1e-8)
    return Field(names, weights[:-8].reshape(-1, 2), weights[-8:-4].reshape(2, 2),
                 weights[-4:-2], weights[-2:])


#: Names that page layouts use for parts that are not the article, and for the article.
ASIDE = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "navigation"],
    "header": ["header", "masthead", "topbar", "banner"],
    "footer": ["footer", "colophon", "copyright"],
    "aside": ["sidebar", "widget", "related", "trending", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo"],
    "notice": ["cookie", "consent", "notice", "newsletter", "subscribe", "alert", "popup", "modal"],
    "comments": ["comments", "comment", "replies", "discussion", "responses"],
    "share": ["share", "social", "tags", "meta", "byline"],
    "form": ["form", "search", "login", "signup"],
}
MAIN = ["content", "article", "post", "entry", "story", "text", "body", "main"]


def labelled_pages(n: int = 600, seed: int = 7) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages of random layouts with a label per block: 1 for the article."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        count = rng.randint(low, high)
        found = ["".join(rng.choice("aeioustrnld") for _ in range(rng.randint(2, 9)))
                 for _ in range(count)]
        return " ".join(found).capitalize()

    def prose(low: int = 1, high: int = 120) -> str:
        return words(low, high) + rng.choice([".", ".", ".", "", "!"])

    def name(part: str) -> str:
        kind = rng.choice(["class", "id"])
        return f'{kind}="{rng.choice(ASIDE[part])}{rng.choice(["", "-box", " wide", "-1"])}"'

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>'
                                    for _ in range(rng.randint(2, 8))) + f"</{tag}>"

    def part(kind: str) -> str:
        if kind == "nav":
            inner = links()
            return f"<nav>{inner}</nav>" if rng.random() < .7 else f"<div {name(kind)}>{inner}</div>"
        if kind in ("header", "footer"):
            inner = rng.choice([f"<p>{prose(2, 15)}</p>", f"&copy; {words(1, 3)} &middot; {prose(2, 15)}",
                                links(), f"<h1>{words(1, 4)}</h1>"])
            return (f"<{kind}>{inner}</{kind}>" if rng.random() < .7
                    else f"<div {name(kind)}>{inner}</div>")
        if kind == "aside":
            inner = f"<h3>{words(1, 4)}</h3>" + rng.choice([links(), f"<p>{prose(3, 30)}</p>"])
            return f"<aside>{inner}</aside>" if rng.random() < .6 else f"<div {name(kind)}>{inner}</div>"
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>"
            return f"<form>{inner}<p>{prose(2, 12)}</p></form>"
        if kind == "comments":
            one = "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{prose(3, 60)}</p></div>'
                          for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div"]))} {name(kind)}>{one}</{t}>'
        tag = rng.choice(["div", "div", "section", "p"])
        inner = prose(2, 30) if tag == "p" or rng.random() < .6 else f"<p>{prose(2, 30)}</p>"
        return f"<{tag} {name(kind)}>{inner}</{tag}>"

    for _ in range(n):
        before = [part(k) for k in ("nav", "header", "ad", "notice", "form", "aside")
                  if rng.random() < .5]
        after = [part(k) for k in ("aside", "ad", "comments", "share", "form", "nav", "footer")
                 if rng.random() < .5]
        rng.shuffle(before)
        body = [("1", f"<h1>{words(2, 12)}</h1>")] if rng.random() < .9 else []
        for _ in range(rng.randint(1, 14)):
            body.append(("1", rng.choices([
                f"<p>{prose()}</p>", f"<p><b>{prose(1, 40)}<br>", f"<h2>{words(1, 8)}</h2>",
                f"<ul><li>{prose(1, 20)}</li><li>{prose(1, 20)}</li></ul>",
                f"<blockquote>{prose(3, 60)}</blockquote>", f"<p>{prose(2, 40)} <a href=x>{words(1, 3)}</a></p>",
                f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>",
                f"<pre>{prose(3, 30)}</pre>"], [30, 4, 3, 2, 2, 4, 1, 1])[0]))
            if rng.random() < .08:
                body.append(("0", part(rng.choice(["ad", "share", "notice", "form", "aside"]))))
        if rng.random() < .15:
            body.append(("0", part("comments")))
        if rng.random() < .1:  # a page with nothing but its article
            before, after = [], []
            if rng.random() < .5:
                body = [("1", f"<p>{prose(1, 4)}</p>") for _ in range(rng.randint(1, 3))]
        wrap = rng.choice(["article", "article", "article", "main", "div", "section"])
        mark = "" if wrap in ("article", "main") and rng.random() < .7 else \
            f' {rng.choice(["class", "id"])}="{rng.choice(MAIN)}"'
        page, labels = Reader(), []

        def feed(source: str, label: int) -> None:
            # The parts are read into one tree, so that the labels follow the blocks.
            known = len(page.blocks)
            for piece in re.split(r"(<[^>]*>)", source):
                found = MARKUP.match(piece) if piece.startswith("<") else None
                if found is None:
                    if piece:
                        page.add(piece)
                elif found[1]:
                    page.close(found[2].lower())
                else:
                    page.open(found[2].lower(), found[3])
            page.flush()
            labels.extend([label] * (len(page.blocks) - known))

        feed("<html><body>", 0)
        for x in before:
            feed(x, 0)
        feed(f"<{wrap}{mark}>", 0)
        for label, x in body:
            feed(x, int(label))
        feed(f"</{wrap}>", 0)
        for x in after:
            feed(x, 0)
        yield page.blocks, labels


def main_text(page: str, field: Field) -> str:
    found = blocks(page, field.emit)
    return "\n".join(b.text for b, keep in zip(found, field.decode(found)) if keep)


def extract(pages: DataFrame, field: Field | None = None, id: str = "page_id",
            url: str = "url", page: str = "html") -> DataFrame:
    """Per page: its id and url, the main text, and its code points."""
    ship(pages.sparkSession)
    field = field or train(labelled_pages())
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in slices(batches, "page"):
            texts = [main_text(s, field) for s in sources]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[id, url, "text", "n_chars"])

    return pages.select(id, url, pages[page].cast("string").alias("page")).mapInArrow(
        run, ", ".join([*kinds, "text string", "n_chars long"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
