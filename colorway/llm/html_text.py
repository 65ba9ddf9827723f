"""Main text of web pages: a graphical model on the tree of the page.

A page becomes a tree of elements and text runs. Each node has a hidden state,
main text or not. The model is a Markov tree: the root's prior, a parent-child
potential per kind of child (a part of the page, a wrapper, a plain block, inline, a
text run), and emission potentials of what parts show (tag, words of class, id and
role, size and share of links of their text, title, paragraphs, buttons). All of them are learned from labelled pages
(``labelled_pages``, or the caller's own). Sum-product messages
go up from the leaves and down from the root; they give each node's marginal
probability exactly. Text runs with a marginal of at least one half are kept.

A block is what lies between starts and ends of block elements. Character
references are decoded, white space (also a line break element) inside a block
becomes one space, blocks without text go, and blocks are joined by one line
feed in page order. Nothing else is dropped or cut; all of the page is read.

Defined results: a null or empty page, or one without main text, gives an
empty text. Broken markup is read as browsers roughly do: an open paragraph
ends at the next block, unknown end tags are skipped, what is open at the end
is closed. Rows are independent, so repeated rows and null ids are kept. Only
the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, slices, texts
from colorway.llm.labelled_pages import MAIN_NAMES, SIDE_NAMES, labelled_pages

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noframes title textarea svg select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark "
                    "q ruby rt s samp small span strike strong sub sup time tt u var wbr br".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_FORM = frozenset("button input".split())
_KINDS = ("part", "wrap", "plain", "inline", "text")
# Elements that may be parts of a page whatever their name; others are if they
# have a name that sites give to side parts.
_PARTS = frozenset("#root html head body div main article section aside nav header footer form center dialog fieldset".split())
_HOLDS = frozenset("ul ol dl table tbody thead tfoot div section article main body".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_SIDE, _MAIN = frozenset(SIDE_NAMES), frozenset(MAIN_NAMES)
_WRAPS = frozenset("div center fieldset".split())  # parts only if their name says so
_LABEL = re.compile(r"\b(main|side)\b")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


@dataclass
class Tree:
    """Nodes in page order; a node's parent comes before it. A text run has
    the tag "#text". ``block`` numbers the block a text run belongs to."""

    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str = "", text: str = "", block: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    tree = Tree()
    open_ = [tree.add("#root", -1)]
    count: dict[str, int] = defaultdict(int)  # open elements by tag
    block, at, end, last, quotes = 0, 0, len(page), page.rfind(">"), True

    def close(k: int) -> bool:
        """Ends the elements from the k-th open one on; whether one is a block."""
        for n in open_[k:]:
            count[tree.tag[n]] -= 1
        blocks = any(tree.tag[n] not in _INLINE for n in open_[k:])
        del open_[k:]
        return blocks

    while at < end:
        if page[at] != "<":
            to = page.find("<", at)
            to = end if to < 0 else to
            tree.add("#text", open_[-1], text=page[at:to], block=block)
            at = to
            continue
        if page.startswith(("<!", "<?"), at):
            close_with = "-->" if page.startswith("<!--", at) else ">"
            to = page.find(close_with, at)
            at = end if to < 0 else to + len(close_with)
            continue
        m = _NAME.match(page, at)
        if m is None:
            tree.add("#text", open_[-1], text="<", block=block)
            at += 1
            continue
        if m.end() > last:  # a tag that is never closed
            break
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:  # quotes do not pair on this page: from here on a tag ends at its first ">"
            quotes, to = False, page.index(">", m.end())
            attributes, at = page[m.end():to], to + 1
        else:
            attributes, at = rest[1], rest.end()
        tag = m[2].lower()
        if m[1]:  # an end tag
            if count[tag]:
                k = next(k for k in range(len(open_) - 1, 0, -1) if tree.tag[open_[k]] == tag)
                block += close(k)
            continue
        if tag == "br":
            tree.add("#text", open_[-1], text=" ", block=block)
            continue
        if tag not in _INLINE:
            block += 1
            ends = _ENDED_BY.get(tag, ())
            if count["p"] or any(count[t] for t in ends):
                k = _ended(tree, open_, tag, ends)
                if k:
                    close(k)
        node = tree.add(tag, open_[-1], attributes)
        if tag in _RAW and not attributes.endswith("/"):  # its content is no text of the page
            raw_end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = raw_end.end() if raw_end else end
        elif tag not in _VOID and not attributes.endswith("/"):
            open_.append(node)
            count[tag] += 1
    return tree


def _ended(tree: Tree, open_: list[int], tag: str, ends: Iterable[str]) -> int:
    """The open element that a block's start ends: a paragraph, or the item
    before; 0 if none."""
    for k in range(len(open_) - 1, 0, -1):
        t = tree.tag[open_[k]]
        if t == "p" or t in ends:
            return k
        if t in _HOLDS or t not in _INLINE and not ends:
            return 0
    return 0


def shown(tree: Tree) -> tuple[list[str], list[list[str]]]:
    """Each node's kind, and what the nodes that may be parts of the page
    show. The plain content of a part is seen through the part: its size, its
    share of links, and whether it has a title, paragraphs or a button."""
    n = len(tree.tag)
    kinds, names, part, link = [], [], [0] * n, [False] * n
    for i, tag in enumerate(tree.tag):
        found = {w for m in _NAMES.finditer(tree.attributes[i]) for w in _WORD.findall(m[2].lower())} \
            if tree.attributes[i] else ()
        told = not _SIDE.isdisjoint(found) or tag in _PARTS and not _MAIN.isdisjoint(found)
        kinds.append("text" if tag == "#text" else "part" if told or tag in _PARTS and tag not in _WRAPS else
                     "wrap" if tag in _WRAPS else "inline" if tag in _INLINE else "plain")
        names.append(found)
        part[i] = i if kinds[i] in ("part", "wrap") else part[tree.parent[i]]
        link[i] = tag == "a" or i > 0 and link[tree.parent[i]]
    size, linked, paragraphs, title, button = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for i, tag in enumerate(tree.tag):
        k = part[i]
        if tag == "#text":
            chars = len(tree.text[i].strip())
            size[k] += chars
            linked[k] += chars if link[i] else 0
        elif tag == "p":
            paragraphs[k] += 1
        elif tag == "h1":
            title[k] = True
        elif tag in _FORM:
            button[k] = True
    out: list[list[str]] = []
    for i, tag in enumerate(tree.tag):
        if kinds[i] not in ("part", "wrap"):
            out.append([])
            continue
        features = ["tag:" + tag, f"paragraphs:{min(3, paragraphs[i])}", f"title:{title[i]}", f"button:{button[i]}"]
        features += ["name:" + w for w in sorted(names[i])]
        if size[i]:
            features += [f"size:{min(5, int(math.log(size[i], 4)))}", f"links:{int(4 * linked[i] / size[i])}"]
        out.append(features)
    return kinds, out


@dataclass(frozen=True)
class Model:
    """Log-odds of the root and of each feature, and for each kind of child
    the probability of main text given the parent's state."""

    prior: float
    emission: dict[str, float]
    follows: dict[str, tuple[float, float]]

    def marginals(self, tree: Tree, seen: tuple[list[str], list[list[str]]] | None = None) -> list[float]:
        """Log-odds of "main text" of each node: messages up, then down."""
        n, known = len(tree.tag), self.emission.get
        kinds, features = seen or shown(tree)
        odds = [sum([known(f, 0.0) for f in names]) for names in features]
        follows = [self.follows[k] for k in kinds]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parent
            r = math.exp(min(max(odds[i], -60.0), 60.0))
            p0, p1 = follows[i]
            up[i] = math.log((p1 * r + 1 - p1) / (p0 * r + 1 - p0))
            odds[tree.parent[i]] += up[i]
        odds[0] += self.prior
        for i in range(1, n):
            q = math.exp(min(max(odds[tree.parent[i]] - up[i], -60.0), 60.0))
            p0, p1 = follows[i]
            odds[i] += math.log((p1 * q + p0) / ((1 - p1) * q + 1 - p0))
        return odds


def fit(pages: Iterable[str] = (), rounds: int = 40, step: float = 0.2, decay: float = 0.0005) -> Model:
    """Learns from labelled pages: a ``main`` attribute marks an element as
    main text, ``side`` as not. Parent-child potentials are counted; emission
    potentials climb the conditional likelihood of the labels, whose gradient
    is, for each feature, the states seen less the marginals of sum-product."""
    pairs: dict[str, list[list[float]]] = {k: [[1.0, 1.0], [1.0, 1.0]] for k in _KINDS}
    data = []
    for page in pages or labelled_pages():
        tree = parse(page)
        state = [0] * len(tree.tag)
        kinds, features = shown(tree)
        for i in range(1, len(tree.tag)):
            mark = _LABEL.search(_QUOTED.sub("", tree.attributes[i]))
            state[i] = int(mark[1] == "main") if mark else state[tree.parent[i]]
            pairs[kinds[i]][state[tree.parent[i]]][state[i]] += 1
        data.append((tree, kinds, features, state))
    model = Model(-4.0, {}, {k: tuple(row[1] / (row[0] + row[1]) for row in table) for k, table in pairs.items()})
    for k in range(rounds):
        rate = step / (1 + 4 * k / rounds)
        for tree, kinds, features, state in data:
            for names, y, odds in zip(features, state, model.marginals(tree, (kinds, features)), strict=True):
                error = y - 1 / (1 + math.exp(min(max(-odds, -60.0), 60.0)))
                if abs(error) > 0.01:
                    for f in names:
                        w = model.emission.get(f, 0.0)
                        model.emission[f] = w + rate * error - decay * w
    return model


def main_text(page: str, model: Model) -> str:
    tree = parse(page)
    odds = model.marginals(tree)
    blocks: dict[int, list[str]] = {}
    for i, t in enumerate(tree.text):
        if t and odds[i] >= 0:
            blocks.setdefault(tree.block[i], []).append(t)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    importable(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    fitted = model or fit()
    kind_ = rows.schema["page_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [main_text(t, fitted) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, f"page_id {kind_.simpleString()}, url string, text string, n_chars long")
