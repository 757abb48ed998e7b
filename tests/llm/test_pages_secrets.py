"""Page text on made-up hosts whose stories are known, and secrets in texts with very many hits."""

import random
import re
from html import escape
from html.parser import HTMLParser

import pytest

from scriptoria.llm import pages, secrets

WORDS = "river stone letter window garden mountain paper candle bridge orchard winter copper silver harbour meadow lantern".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n)).capitalize() + "."


class Plain(HTMLParser):
    """All text of a piece of markup, by a parser of its own, one block a line."""

    def __init__(self, markup):
        super().__init__()
        self.lines, self.open = [""], 0
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "li", "div", "article", "ul", "blockquote"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "div", "article", "ul", "blockquote"):
            self.lines.append("")

    def handle_data(self, data):
        self.lines[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(y.split()) for y in self.lines) if x)


def teasers(r, tag):
    return f"<{tag}>" + "".join(f'<article class="card"><h2>{prose(r, 4)}</h2><p>{prose(r, 12)}</p></article>' for _ in range(3)) + f"</{tag}>"


def comments(r, style):
    bodies = [f"<p>{prose(r, r.randint(5, 60))}</p>" for _ in range(4)]
    if style == 0:
        return '<div class="comments-area"><ol class="comment-list">' + "".join(f'<li id="comment-{k}"><article class="comment-body"><footer>by {k}</footer>{b}</article></li>' for k, b in enumerate(bodies)) + "</ol></div>"
    if style == 1:
        return '<section class="comments"><h2>Comments</h2>' + "".join(f"<article>{b}</article>" for b in bodies) + "</section>"
    return "".join(f"<article>{b}</article>" for b in bodies)  # bare, within the story


def page(r, kind):
    inside = f'<h1>{prose(r, 5)}</h1><p>{prose(r, 40)}</p><ul><li>{prose(r, 6)}</li><li>{prose(r, 6)}</li></ul><p>{prose(r, 30)} &amp; <b>more</b><br>{escape(prose(r, 20))}</p>'
    own = Plain(inside).text()
    story = {
        0: f"<article>{inside}{comments(r, 1)}</article>{comments(r, 0)}",
        1: f'<div class="layout has-sidebar"><article class="post comments-open">{inside}</article>{teasers(r, "aside")}</div><footer>{teasers(r, "div")}</footer>',
        2: f'{teasers(r, "aside")}<main><div class="teasers">{teasers(r, "div")}</div><article>{inside}{comments(r, 2)}</article></main>{comments(r, 0)}',
        3: f'<form id="all"><div class="sidebar-layout"><article>{inside}<aside>{teasers(r, "div")}</aside></article></div></form>',
        4: f'<div class="post">{inside}</div>{comments(r, 0)}',
    }[kind]
    html = f'<!doctype html><html><head><title>x</title></head><body class="comments-open"><nav><ul><li>Home</li></ul></nav><p>Site wide slogan of the paper.</p>{story}<div class="ad">Buy {prose(r, 3)}</div><p>All rights kept by the paper.</p></body></html>'
    return html, own


def test_stories_without_comments_and_teasers(spark):
    r = random.Random(4)
    made = [(k, f"https://h{k % 2}.example/{k}", *page(r, k % 5)) for k in range(120)]
    rows = [(k, u, h, "x", 1) for k, u, h, _ in made] + [(200, "https://h0.example/n", None, "x", 1), (201, None, "", "x", 1), (None, "x", "<article>" * 500 + "deep", "x", 1)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, hash int"))
    by = {x.page_id: x.text for x in got.collect()}
    assert len(by) == 123 and by[200] == by[201] == "" and by[None] == "deep"
    for k, _, _, own in made:
        assert by[k] == own, (k % 5, by[k], own)


@pytest.mark.parametrize(
    "html",
    [
        '<div class="post"><p>The story.</p></div><div class="comments-area"><li><article class="comment-body"><p>I differ at length, and with many words.</p></article></li></div>',
        "<article><p>The story.</p></article><aside><article><p>Read this longer teaser as well, please.</p></article></aside>",
        "<article><p>The story.</p></article><footer><article><p>Read this longer teaser as well, please.</p></article></footer>",
        '<article><p>The story.</p><section class="comments"><article><p>I differ at length, and with many words.</p></article></section></article>',
    ],
)
def test_containers_beat_their_articles(spark, html):
    assert pages.extract(spark.createDataFrame([(1, "http://a.b/", html)], "page_id long, url string, html string")).collect()[0].text == "The story."


def test_very_many_secrets_in_a_text(spark):
    """Work is linear in the hits, and spans and redaction stay exact."""
    r = random.Random(7)
    hexes = ["%040x" % r.getrandbits(160) for _ in range(100_000)]
    text = "é " + " ".join(f"token={h}" if k % 50 == 0 else h for k, h in enumerate(hexes)) + " the end"
    docs = spark.createDataFrame([(1, text), (2, "plain words"), (3, None), (4, "word, " * 600 + "password: hunter2hunter2 " + "y z " * 2000)], "doc_id long, text string")
    got = {x.doc_id: x for x in secrets.scan(docs).collect()}
    base = sorted([(m.start(), 0, m.end()) for m in re.finditer("token=([0-9a-f]+)", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)])
    assert [tuple(x) for x in got[1].base] == base and len(base) == 102_000
    assert set(base) <= {tuple(x) for x in got[1].all}
    clean = {x.doc_id: x.text for x in secrets.redact_all(docs).collect()}
    assert clean[1] == "é " + " ".join(["[SECRET]"] * 100_000) + " the end" and clean[2] == "plain words" and clean[3] is None
    assert clean[4] == "word, " * 600 + "[SECRET] " + "y z " * 2000
