"""Labelled pages for the HTML extractor. An element with ``main`` is
main text, with all it holds, up to an element with ``side``, which is not. Some are
written by hand; the others put together parts that sites commonly have."""

import random

_WORDS = "The river rose again in spring, and the old bridge was closed for weeks while the town waited for news. "


def _p(n: int) -> str:
    return f"<p>{_WORDS * n}</p>"


def _links(n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">Topic {i}</a></{tag}>' for i in range(n))


_HEAD = "<head><title>The river rose again</title><style>p{margin:0}</style><script>var a=1;</script></head>"

_WRITTEN = (
    f"""<html>{_HEAD}<body><nav><ul>{_links(6)}</ul></nav><div class="ad">Buy new boots today, at half the price.</div>
    <article main><h1>The river rose again</h1>{_p(3)}<p><b>{_WORDS}<br></p>{_p(1)}<p>Yes.</p><ul><li>One thing</li>
    <li>Another</li></ul><blockquote>{_WORDS}</blockquote></article><footer>&copy; town.example &middot; All rights.</footer></body></html>""",
    f"""<html>{_HEAD}<body><header class="site-header masthead"><a href="/">Town news</a><form class="search"><input>
    <button>Search</button></form></header><div class="breadcrumb breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div>
    <main main><h1>Floods</h1><h2>What we know</h2>{_p(2)}<figure><img src="a.png"><figcaption>The bridge in May.</figcaption></figure>
    {_p(4)}<h2>What comes next</h2>{_p(1)}<table><tr><th>Year</th><td>1990</td></tr><tr><th>Level</th><td>7 m</td></tr></table>
    <aside side class="related recommended more"><h3>Read more</h3><ul>{_links(4)}</ul></aside>{_p(2)}
    <div side class="share social"><a href="/f">Share</a> <a href="/t">Send</a></div></main>
    <section id="comments" class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>{_WORDS}</p></div>
    <div class="comment reply"><b>Bob</b><p>I was there and saw it all happen, what a day that was for us.</p></div>
    <form class="respond"><textarea>Say something</textarea><button>Send</button></form></section>
    <footer class="footer site-footer"><p>Contact us by letter. All rights reserved.</p><ul>{_links(5)}</ul></footer></body></html>""",
    f"""<html>{_HEAD}<body><div id="cookie" class="cookie consent notice banner"><p>We use cookies to make this site better for you.</p>
    <button>Accept</button></div><div class="topbar menu navbar"><ul class="menu">{_links(8)}</ul></div>
    <div class="container wrapper"><div class="content post entry" main><h1>Old bridges</h1>{_p(2)}{_p(5)}<pre>level = 7</pre>
    <div class="ad ads advert advertisement sponsored" side>Sponsored: the best boots, with free shipping to every town in the land.</div>
    {_p(1)}<p>Short end.</p><ol><li>{_WORDS}</li><li>Second point</li></ol></div>
    <div id="sidebar" class="sidebar widget"><h3>Latest</h3><ul>{_links(6)}</ul><p>About this site: a blog on rivers and towns.</p></div></div>
    <div class="newsletter subscribe signup promo"><h3>Stay in touch</h3><p>Get our letter once a week, no spam.</p>
    <form><input><button>Sign up</button></form></div><div id="footer" class="footer copyright">Copyright 1999 Town</div></body></html>""",
    f"""<html>{_HEAD}<body><header><h1><a href="/">My pages</a></h1><nav>{_links(5, "span")}</nav></header>
    <section class="article story text body main" main><h2>Spring</h2>{_p(1)}{_p(1)}<h3>Later</h3>{_p(3)}<p><i>{_WORDS}</i> <a href="/x">a link</a> {_WORDS}</p>
    <dl><dt>Level</dt><dd>{_WORDS}</dd></dl></section><div class="pagination pager"><a href="/1">1</a> <a href="/2">next</a></div>
    <aside class="sidebar"><p>{_WORDS}</p><ul>{_links(3)}</ul></aside>
    <div class="disclaimer notice warning alert"><p>This site is in test. Please tell us what you think of it.</p></div>
    <div class="discussion thread comments"><ul><li class="comment"><p>{_WORDS * 2}</p></li><li class="comment"><p>Nice.</p></li></ul></div>
    <div class="popup modal overlay login"><form><label>Name</label><input><button>Log in</button></form></div>
    <footer><nav>{_links(4, "span")}</nav><small>Town 2001</small></footer></body></html>""",
    f"""<html>{_HEAD}<body><div class="nav links">{_links(4, "span")}</div><div id="main" main><h1>Plain page</h1>{_p(2)}
    <div><p>{_WORDS}</p><div>{_WORDS * 2}</div></div>{_p(1)}</div><div class="banner promo">Win a boat now! Click here.</div>
    <div id="bottom" class="legal copyright">Terms apply. <a href="/p">Privacy</a></div></body></html>""",
    f"""<html><body main><h1>Bare page</h1>{_WORDS}<br>{_WORDS * 2}<p>{_WORDS}</p><p>End.</p></body></html>""",
    f"""<html>{_HEAD}<body><header role="banner"><div class="logo brand"><a href="/">Town</a></div><nav role="navigation"><ul>{_links(5)}</ul></nav></header>
    <div role="main"><article class="post" main><header><h1>Boats</h1></header>{_p(2)}<p>{_WORDS}</p><h2>Ropes</h2>{_p(1)}
    <footer side class="meta tags byline"><p>Filed under <a href="/b">boats</a></p></footer></article>
    <article class="post" main><h2>Sails</h2>{_p(2)}</article></div>
    <aside role="complementary"><h3>Popular</h3><ul>{_links(5)}</ul></aside>
    <section class="reviews responses feedback comments" id="responses"><article class="comment" side><p>{_WORDS}</p></article></section>
    <footer role="contentinfo"><p>Made by us in town.</p></footer></body></html>""",
)


# Names that sites commonly give to parts of a page.
SIDE_NAMES = ("ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
               "gdpr notice alert warning disclaimer popup modal overlay newsletter subscribe signup login search menu nav navbar "
               "navigation breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended trending "
               "popular share social follow toolbar topbar masthead header footer copyright legal comment comments "
               "discussion thread reply respond responses reviews disqus feedback form meta tags byline").split()
_PLAIN_NAMES = "lead intro row column para wrap inner box block quote first last large".split()
MAIN_NAMES = "content article post entry story text body main".split()
_SIDE_TAGS = "nav aside footer header form".split()
_MAIN_TAGS = "article main section div".split()


def _sentences(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(_WORDS.split()) for _ in range(words)) + "."


def _side(rng: random.Random, name: str) -> str:
    """A part that is not main text: named, or of a tag that says so."""
    inner = rng.choice((
        _sentences(rng, rng.randint(2, 60)), _p(rng.randint(1, 3)), f"<p>{_sentences(rng, rng.randint(2, 30))}</p>",
        f"<ul>{_links(rng.randint(2, 9))}</ul>", f"<h3>{_sentences(rng, 2)}</h3><ul>{_links(4)}</ul>",
        f"<h2>{_sentences(rng, 2)}</h2><div><p>{_sentences(rng, 20)}</p></div><div><p>{_sentences(rng, 30)}</p></div>",
        f"<h3>{_sentences(rng, 2)}</h3><p><b>Ann:</b> {_sentences(rng, 25)}</p><p>Bob: {_sentences(rng, 5)}</p>",
        f"<p>{_sentences(rng, 8)}</p><form><input><button>Send</button></form>"))
    if rng.random() < 0.3:
        tag = rng.choice(_SIDE_TAGS)
        return f"<{tag} side>{inner}</{tag}>"
    tag = rng.choice(("div", "div", "section") if "<" in inner else ("div", "section", "p"))
    return f'<{tag} {rng.choice(("class", "id"))}="{name}" side>{inner}</{tag}>'


def _made(rng: random.Random, side: str) -> str:
    part = lambda: _side(rng, rng.choice((side, rng.choice(SIDE_NAMES))))
    blocks = []
    for _ in range(rng.randint(1, 14)):
        blocks.append(rng.choice((
            _p(rng.randint(1, 5)), _p(rng.randint(1, 3)), f"<p>{_sentences(rng, rng.randint(1, 40))}</p>",
            f"<p><b>{_sentences(rng, 9)}<br>", f"<h2>{_sentences(rng, 3)}</h2>", f"<ul><li>{_sentences(rng, 9)}</li><li>{_sentences(rng, 2)}</li></ul>",
            f"<p>{_sentences(rng, 20)} <a href='/x'>{_sentences(rng, 2)}</a> <i>{_sentences(rng, 3)}</i></p>",
            f"<div>{_sentences(rng, 30)}</div>", f"<section><h2>{_sentences(rng, 3)}</h2>{_p(rng.randint(1, 3))}</section>", f'<div class="{rng.choice(_PLAIN_NAMES)}">{_p(2)}</div>',
            f'<p class="{rng.choice(_PLAIN_NAMES)}">{_sentences(rng, 20)}</p>')))
        if rng.random() < 0.12:
            blocks.append(part())
    tag = rng.choice(_MAIN_TAGS)
    name = "" if tag in ("article", "main") and rng.random() < 0.7 else f'class="{rng.choice(MAIN_NAMES)}"'
    heading = f"<h1>{_sentences(rng, 5)}</h1>"
    title = rng.choice(("", heading, heading, f"<header>{heading}</header>"))
    before, after = ("".join(part() for _ in range(rng.randint(0, 3))) for _ in (0, 1))
    end = "<footer side>&copy; Town</footer>" if rng.random() < 0.5 else ""
    body = f"{before}<{tag} {name} main>{title}{''.join(blocks)}</{tag}>{after}{end}"
    return f"<html>{_HEAD}<body>{f'<div class=wrapper>{body}</div>' if rng.random() < 0.3 else body}</body></html>"


def labelled_pages(times: int = 6, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [*_WRITTEN * times, *(_made(rng, side) for _ in range(times) for side in SIDE_NAMES)]
