import html
import re
import time

import pytest

from wardline.llm import html_text as ht


@pytest.fixture(scope="module")
def field():
    return ht.train(ht.labelled_pages())


def test_held_out_layouts(field):
    right = total = 0
    for page, labels in ht.labelled_pages(120, seed=99):
        right += sum(a == b for a, b in zip(field.decode(page), labels))
        total += len(labels)
    assert right / total > 0.99


def test_articles_of_the_pages(spark, sf_dir, field):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        lines = re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", "\n", body)).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)
        assert ht.main_text(r["html"], field) == want


@pytest.mark.parametrize("source, want", [
    ("<p>a <b>b</b>  c<i>d</i></p><p>e", ["a b cd", "e"]),
    ("<!-- <p>x</p> --><p>y<!-- z", ["y"]),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p>", ["yes"]),
    ("<title>no</title><p>1 &lt; 2 &amp; 3&nbsp;4 &#65;</p>", ["1 < 2 & 3 4 A"]),
    ("<p>2 < 3 and <4", ["2 < 3 and <4"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
    ("<div title='a > b'>x</div>", ["x"]),
    ("<div a=\"unclosed>x</div><p>y</p>", ["x", "y"]),
    ("</p></div>lone", ["lone"]), ("", []), ("   \n", []), ("<p></p>", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<script>endless <p>a</p>", [])])
def test_blocks(source, want):
    assert [b.text for b in ht.blocks(source)] == want


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><p>article<p>more", ["article", "more"]),
    ("<head><meta charset=utf-8><style>x{}</style>words <b>bold</b>", ["words bold"]),
    ("<head><noscript><p>no</p></noscript><title>t</title></head><p>a", ["a"]),
    ("<head><title>t</title><template><p>no</p></template><link href=x><h1>a</h1>", ["a"]),
    ("<div><noscript>a<p>b</p></div><p>c", ["a", "b", "c"]),
    ("<div><template>no</div><p>a</p><template>no</template>b", ["a", "b"]),
    ("<div><svg><text>no</div><p>a</p><svg><text>no</text></svg>", ["a"]),
    ("<svg><path d='x'><p>a</p><svg></svg>b", ["a", "b"]),
    ("<svg><foreignObject><p>no</p></foreignObject></svg><p>a", ["a"]),
    ("<p>a<noscript><div>no</div></noscript>b<svg><text>no</text></svg>c</p>", ["a", "b", "c"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", ["so x=2 holds"]),
    ("<object data=x><p>a</p></object><p>b", ["a", "b"]), ("<object>a<p>b", ["a", "b"])])
def test_optional_tags_and_silent_parts(source, want):
    assert [b.text for b in ht.blocks(source)] == want


def test_an_article_without_head_end_and_body(field):
    page = ("<html><head><title>t</title><article><p>One sentence of the article with a formula "
            "<math><mi>a</mi><mo>+</mo><mi>b</mi></math> in it.</p></article>")
    assert ht.main_text(page, field) == "One sentence of the article with a formula a+b in it."


def test_viterbi_is_the_best_path(field):
    from itertools import product
    for page, _ in ht.labelled_pages(30, seed=5):
        page = page[:8]

        def total(labels):
            at = [sum(field.emit.get(f, (0, 0))[y] for f in b.features) for b, y in zip(page, labels)]
            moves = [field.move[a][b] for a, b in zip(labels, labels[1:])]
            return sum(at) + sum(moves) + field.first[labels[0]] + field.last[labels[-1]]

        if page:
            best = max(total(x) for x in product((0, 1), repeat=len(page)))
            assert total(field.decode(page)) == pytest.approx(best)


def test_edges(spark, field):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>x</p></article>"),
            (3, "u", "<article>" + "<p>" + "word " * 60_000 + "</p></article>"),
            (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<" * 5000), (6, "u", '<a "' * 3000)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows],
                                  "page_id long, url string, html string, text string, page string")
    got = {r["page_id"]: r["text"] for r in ht.extract(pages, field).collect()}
    assert got[1] == got[2] == "" and got[None] == "x" and len(got[3]) == 5 * 60_000 - 1
    assert ht.extract(pages.limit(0), field).count() == 0


def test_deep_and_unclosed_tags_are_linear():
    for page in ("<div>" * 100_000 + "text", "<b>" * 100_000 + "</i>" * 100_000 + "text",
                 "<ul>" + "<p><b>" * 50_000 + "<li>" * 50_000 + "text",
                 "".join(f"<div class=c{i}>" for i in range(50_000)) + "text"):
        start = time.perf_counter()
        found = ht.blocks(page, {"in:div"})
        assert [b.text for b in found] == ["text"] and time.perf_counter() - start < 10


def test_features_of_closed_tags_end():
    first, second, third = ht.blocks("<div class=a>x<p id=b>y</p></div><ul><li>z</ul>")
    assert {"in:div", "as:a"} <= set(first.features) and "as:b" not in first.features
    assert {"in:div", "in:p", "as:b"} <= set(second.features)
    assert "in:div" not in third.features and {"in:ul", "in:li"} <= set(third.features)
