"""Main text of pages: variants of templates, broken markup, odd inputs."""

import html
import itertools
import math
import random
import re

import pytest
from llm_fixtures import CLASHES, collected, table
from pyspark.sql import functions as F

from colorway.llm import html_text as ht
from colorway.llm.labelled_pages import labelled_pages
from colorway.llm.queries import op6_html_tree_model

LONG = "Some long text of the article, that goes on and on for a good while."
WANT = f"Title here\n{LONG}\nEnd."


@pytest.fixture(scope="module")
def model():
    return ht.fit()


def page(inside="", before="", tag="article", attributes=""):
    return (f'<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>{before}<{tag} {attributes}>'
            f"<h1>Title here</h1><p>{LONG}</p>{inside}<p>End.</p></{tag}><footer>&copy; x</footer></body></html>")


@pytest.mark.parametrize("side", [
    '<div class="ad">Buy this now, only today for you.</div>', '<div class="advert"><p>Buy this now, only today.</p></div>',
    '<aside><h3>Related</h3><ul><li><a href="x">Foo bar</a></li></ul></aside>', "<script>x='<p>no</p>'</script>",
    '<div class="cookie-notice">We use cookies. <button>OK</button></div>', "<form><label>Your mail</label><input><button>Go</button></form>",
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>I think this is a really wonderful text.</p></div></section>',
    '<section id="comments"><h3>3 comments</h3><p><b>Ann:</b> I do not agree with what is said here at all.</p><p>Bob: but I do.</p></section>',
    '<div id="sidebar"><p>About us: we are a small site about towns and rivers.</p></div>', '<header><div class="logo">Site</div></header>',
    '<div class="newsletter">Sign up for our letter</div>', "<noscript>Enable</noscript><style>p{}</style><!-- <p>no</p> -->",
])
def test_sides_go(model, side):
    for tag, attributes in (("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"')):
        assert ht.main_text(page(side, "", tag, attributes), model) == WANT
        assert ht.main_text(page("", side, tag, attributes), model) == WANT


def test_named_plain_content_stays(model):
    more = '<p class="lead">First words of it.</p><h2 id="s1">Part</h2><div class="row"><p class="x-9">Nested <span class="hl">words</span> here.</p></div>'
    more += "<section><h2>Own</h2><p>A section of the article itself.</p></section>"
    for tag, attributes in (("article", ""), ("main", ""), ("div", 'class="content"')):
        got = ht.main_text(page(more + '<p class="ad">Buy now!</p>', "", tag, attributes), model)
        assert got == f"Title here\n{LONG}\nFirst words of it.\nPart\nNested words here.\nOwn\nA section of the article itself.\nEnd."


def test_blocks_and_references(model):
    body = "<p>a&amp;b &lt;i&gt; &#233;&nbsp;&copy\n  x<br>y <b>bo</b>ld</p><p> </p><ul><li>one<li>two</ul><p>open<p>last &am"
    assert ht.main_text(page(body), model) == f"Title here\n{LONG}\na&b <i> é © x y bold\none\ntwo\nopen\nlast &am\nEnd."


def test_labelled_pages_not_learned_from(model):
    """At least 99 % of the text runs of other generated pages are right."""
    wrong = total = 0
    for text in labelled_pages(1, seed=77):
        tree = ht.parse(text)
        state = [0] * len(tree.tag)
        odds = model.marginals(tree)
        for i in range(1, len(tree.tag)):
            mark = ht._LABEL.search(ht._QUOTED.sub("", tree.attributes[i]))
            state[i] = int(mark[1] == "main") if mark else state[tree.parent[i]]
            if tree.text[i].strip():
                total += 1
                wrong += (odds[i] >= 0) != bool(state[i])
    assert total > 1000 and wrong < 0.01 * total


def test_messages_give_the_exact_marginals(model):
    """Sum-product equals the sum over all labellings of a small page."""
    tree = ht.parse('<div class="ad"><p>x</p></div><article><h1>t</h1>run</article>')
    n = len(tree.tag)
    kinds, features = ht.shown(tree)
    phi = [sum(model.emission.get(f, 0.0) for f in names) for names in features]
    phi[0] += model.prior
    mass = [[0.0, 0.0] for _ in range(n)]
    for states in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(p for p, s in zip(phi, states) if s))
        for i in range(1, n):
            p1 = model.follows[kinds[i]][states[tree.parent[i]]]
            w *= p1 if states[i] else 1 - p1
        for i, s in enumerate(states):
            mass[i][s] += w
    for odds, (no, yes) in zip(model.marginals(tree), mass, strict=True):
        assert math.isclose(odds, math.log(yes / no), abs_tol=1e-6)


def test_hostile_markup_is_read_in_linear_time(model):
    for text in ("<div>" * 20_000 + "x", "<p" * 50_000, "<b>" * 30_000 + "</i>" * 30_000, '<p "' * 20_000 + ">", "<" * 50_000,
                 "<b>" * 20_000 + "<hr>" * 20_000, "&" * 50_000, "<!--" * 20_000):
        ht.main_text(text, model)


def test_edges(spark, model):
    rng = random.Random(1)
    many = "".join(f"<p>{'word ' * rng.randint(1, 50)}</p>" for _ in range(2000))
    rows = [(1, "u", page()), (2, None, None), (3, "u", ""), (None, "u", page()), (1, "u", page()), (4, "v", page(many)), (5, "w", "no markup")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in [*CLASHES, "text"]])
    got = {(r["page_id"], r["url"]): r for r in collected(ht.extract(df))}
    assert ht.extract(df).count() == len(rows)
    assert got[1, "u"]["text"] == got[None, "u"]["text"] == WANT
    assert got[2, None]["text"] == got[3, "u"]["text"] == ""
    assert got[4, "v"]["text"].count("\n") == 2002 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert ht.extract(df.limit(0)).count() == 0


def test_query(spark):
    """Against a direct reading of the tables' one template."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in collected(op6_html_tree_model(spark, sf))}
    rows = table(spark, "pages", sf).collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<(p|/p|h1|/h1)>", "\0", article.replace("<br>", " "))).split("\0")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r.page_id]["text"] == want and got[r.page_id]["n_chars"] == len(want)
