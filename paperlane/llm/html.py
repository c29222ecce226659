"""Main text of web pages by minimum-cut labelling.

A page's text is cut into blocks at block-level tags. Each block has a price as content and as
boilerplate: the log-odds of a text classifier (length, links, sentence ends, place in the page),
which is fitted on pages that mark their article, and fixed log-odds for what the mark-up says
(article and main elements, navigation, forms, hidden parts, telling names of class, id and role).
The prices become capacities from the source and to the sink. Blocks that follow each other in the
page and blocks whose containers share a parent are joined by smoothness edges, the stronger the
nearer their containers lie in the DOM. The blocks on the source's side of the minimum cut are the
content. Where the mark-up says nothing, a short line between paragraphs goes with them.

A null or empty page gives an empty text, as does one without content. Character references are
decoded, white space inside a block becomes one space, and nothing is capped. One row comes out for
each row, repeated rows and null ids included; other columns are ignored; an empty table gives an
empty one. Tags that are never closed end with their parent. A tag whose quote is never closed ends
at its first ">". Time is linear in the page for parsing.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Elements whose content is never text.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas video audio head select textarea button map".split())
OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])", re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What is left of a tag behind its name; quotes may hold ">".
REST = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOXES = frozenset("article main section div nav header footer aside form menu dialog ul ol dl table body figure details fieldset".split())
#: Elements that hold boilerplate wherever they stand.
HARD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: Words in class, id or role that name boilerplate wherever it stands, and those that do so outside the article only.
HARD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr banner notice popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars widget nav navbar navigation menu breadcrumb breadcrumbs footer pagination pager comment comments disqus respond replies reply discussion "
    "related recommended share sharing social toolbar login search complementary contentinfo alertdialog dialog paywall copyright skip".split()
)
SOFT_WORDS = frozenset("header masthead topbar top hero logo brand alert meta byline tags".split())
MAIN_WORDS = frozenset("article main content entry post story body text".split())
#: Words of names that say nothing about what is inside.
NEUTRAL_WORDS = frozenset(
    "site page container wrapper wrap inner outer box block list item items section area panel bar row col column left right bottom center primary secondary global user reader readers posts "
    "thread slot unit form link links button buttons title heading small large big mobile desktop js is has no new the of and for to s 1 2 3 4 5 6 7 8 9 0".split()
)
#: Features of a block's text, and the weights that stand where a fit has nothing to say.
TEXT = ("one", "length", "links", "sentence", "item", "first", "last")
PRIOR = (-2.0, 5.0, -5.0, 1.5, -0.5, -0.5, -0.5)
#: The text's log-odds lie within LIMIT; what mark-up says outweighs them: log-odds of a block inside the article, outside it, and in boilerplate by tag or name.
LIMIT, INSIDE, OUTSIDE, HARD = 4.0, 6.0, -6.0, -12.0
#: Capacity of one log-odd; edges between blocks of one container, of neighbouring ones, and of those two steps apart.
UNIT, SMOOTH = 10, (25, 10, 4, 2)


class Block:
    """A stretch of text between block-level tags."""

    __slots__ = ("box", "text", "link_chars", "item", "named", "article")

    def __init__(self, box: int, text: str, link_chars: int, item: bool, named: float, article: bool):
        self.box, self.text, self.link_chars, self.item, self.named, self.article = box, text, link_chars, item, named, article


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """How surely an element is boilerplate by its tag and attributes, 0 to 1, and whether it holds the article."""
    named, main = float(tag in HARD_TAGS or tag == "header" and not in_article), tag in ("article", "main")
    if attributes.strip() and tag not in ("article", "main", "body", "html"):
        words: list[str] = []
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                named = 1.0
            elif name in ("class", "id", "role"):
                # Each name is judged alone: all its telling words must say so, or it counts for little.
                for one in value.split():
                    telling = [w for w in (w.lower() for w in TOKEN.findall(one)) if w not in NEUTRAL_WORDS]
                    bad = sum(w in HARD_WORDS or not in_article and w in SOFT_WORDS for w in telling)
                    if bad:
                        named = max(named, 1.0 if bad == len(telling) else 0.2 * bad / len(telling))
                    words += telling
        main = main or tag in ("div", "section", "td") and named == 0 and not MAIN_WORDS.isdisjoint(words)
    return named, main


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The page's text in order, and for each container the one around it."""
    out: list[Block] = []
    # An open element: tag, container, boilerplate, article
    open_: list[tuple] = [("", 0, 0.0, False)]
    names, parent, links, raw, linked = Counter(), [0], 0, [], 0
    quotes = True  # until a quote is found open at the end of the page

    def flush() -> None:
        nonlocal raw, linked
        text = " ".join("".join(raw).split())
        if text:
            tag, box, named, article = open_[-1]
            out.append(Block(box, text, min(linked, len(text)), tag == "li", named, article))
        raw, linked = [], 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece)
            raw.append(piece)
            if links:
                linked += len(piece.strip())

    at, end = 0, len(html)
    while m := OPEN.search(html, at):
        say(html[at : m.start()])
        at = m.start()
        if m[0] == "<!--":
            stop = html.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if m[0][:3] == "<![":
            stop = html.find("]]>", at)
            say(html[at + 9 : end if stop < 0 else stop])
            at = end if stop < 0 else stop + 3
            continue
        if m[0][1] in "!?":
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        tag = NAME.match(html, at)
        rest = REST.match(html, tag.end()) if quotes else None
        if rest:
            attributes, at = html[tag.end() : rest.end() - 1], rest.end()
        else:
            quotes, stop = False, html.find(">", tag.end())
            if stop < 0:  # the tag is never closed: what is left up to the next one is no text
                stop = html.find("<", tag.end())
                at = end if stop < 0 else stop
                continue
            attributes, at = html[tag.end() : stop], stop + 1
        name, closing = tag[1].lower(), html[tag.start() + 1] == "/"
        if name in SKIPPED:
            if not closing:
                stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            if name in ("img", "input"):
                raw.append(" ")
            if closing and not names[name] or not closing and (not attributes.strip() or name in VOID or _marks(name, attributes, open_[-1][3])[0] < 1):
                continue
        elif name == "br":
            raw.append(" ")
            continue
        flush()
        links = 0 if name != "li" else links
        if name in VOID:
            continue
        if closing:
            while names[name]:
                gone = open_.pop()[0]
                names[gone] -= 1
                if gone == name:
                    break
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_[-1][0] == name:
            open_.pop()
            names[name] -= 1
        _, box, named, article = open_[-1]
        own, main = _marks(name, attributes, article)
        if name in BOXES or own or main:
            parent.append(box)
            box = len(parent) - 1
        open_.append((name, box, max(named, own), article or main))
        names[name] += 1
    say(html[at:])
    flush()
    return out, parent


def features(found: list[Block]) -> np.ndarray:
    """The text features of each block, in the order of TEXT."""
    out = np.zeros((len(found), len(TEXT)))
    for i, b in enumerate(found):
        n = len(b.text)
        out[i] = 1, np.log1p(n) / 8, b.link_chars / n, b.text[-1] in ".!?…”\"", b.item, i == 0, i == len(found) - 1
    return out


def marked(found: list[Block]) -> bool:
    """Whether the page marks its article."""
    return any(b.article and b.named < 1 for b in found)


def log_odds(found: list[Block], weights: tuple = PRIOR) -> np.ndarray:
    """How much more likely each block is content than boilerplate."""
    out = np.clip(features(found) @ np.array(weights), -LIMIT, LIMIT)
    has = marked(found)
    return out + np.array([HARD * b.named + (INSIDE if b.article else OUTSIDE if has else 0) for b in found])


def prices(odds: np.ndarray) -> list[tuple[int, int]]:
    """For each block what it costs to call it boilerplate, and content."""
    cost = np.rint(UNIT * odds).astype(int)
    return list(zip(np.maximum(cost, 0).tolist(), np.maximum(-cost, 0).tolist(), strict=True))


def steps(a: int, b: int, parent: list[int]) -> int:
    """Steps in the DOM between two containers, as far as SMOOTH goes. A container's number is above that of the one around it."""
    n = 0
    while a != b and n < len(SMOOTH):
        a, b = (parent[a], b) if a > b else (a, parent[b])
        n += 1
    return n if a == b else len(SMOOTH)


def edges(found: list[Block], parent: list[int]) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, block, capacity): neighbours in the page, and the last earlier block of the container and of the one around it."""
    out, last = [], {}
    for i, b in enumerate(found):
        near = {i - 1} if i else set()
        for key in ((b.box, 0), (parent[b.box], 1)):
            if key in last:
                near.add(last[key])
            last[key] = i
        for j in sorted(near):
            n = steps(found[j].box, b.box, parent)
            if n < len(SMOOTH):
                out.append((j, i, SMOOTH[n]))
    return out


def content_side(price: list[tuple[int, int]], smooth: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes on the source's side of the minimum cut, by augmenting along shortest paths in levels."""
    n = len(price)
    source, sink = n, n + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + 2)]  # [to, capacity, index of the reverse edge]

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, (content, boiler) in enumerate(price):
        through = min(content, boiler)  # flows at once
        join(source, i, content - through, 0)
        join(i, sink, boiler - through, 0)
    for a, b, c in smooth:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c, _ in graph[a]:
                if c > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[list[int]] = []
        at = source
        while True:
            if at == sink:
                push = min(e[1] for e in path)
                for e in path:
                    e[1] -= push
                    graph[e[0]][e[2]][1] += push
                path, at = [], source
                continue
            while turn[at] < len(graph[at]):
                e = graph[at][turn[at]]
                if e[1] > 0 and level[e[0]] == level[at] + 1:
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                back = path.pop()
                at = graph[back[0]][back[2]][0]
                turn[at] += 1
                continue
            path.append(e)
            at = e[0]


def main_text(html: str | None, weights: tuple = PRIOR) -> str:
    """The page's main text."""
    found, parent = blocks(html or "")
    if not found:
        return ""
    side = content_side(prices(log_odds(found, weights)), edges(found, parent))
    return " ".join(b.text for b, keep in zip(found, side, strict=True) if keep)


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 2000, strength: float = 10.0) -> tuple:
    """Weights of the text features, fitted to the marked articles of about `sample` pages, chosen by hash.

    A block inside the article and outside named boilerplate is content. The fit is logistic
    regression drawn to PRIOR with the given strength; without a marked page it is PRIOR. At most
    100 blocks a page train, evenly spread, so what the driver gets is bounded.
    """
    n = pages.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list = []
            for html in b.column(0).to_pylist():
                found, _ = blocks(html or "")
                if marked(found):
                    some = range(0, len(found), -(-len(found) // 100))
                    f = features(found).round(4)
                    rows += [[*f[i].tolist(), float(found[i].article and found[i].named < 1)] for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["row"])

    few = pages.where(F.pmod(F.xxhash64(id_col, url_col), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, n))) + 1))
    got = sorted(tuple(r.row) for r in few.select(html_col).mapInArrow(work, "row array<double>").collect())
    w, prior = np.array(PRIOR), np.array(PRIOR)
    if got:
        data = np.array(got)
        x, y = data[:, :-1], data[:, -1]
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - prior))
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
    return tuple(w.round(3).tolist())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple | None = None) -> DataFrame:
    """Per row the id, the url, text and n_chars. Without given weights the text classifier is fitted first."""
    small_batches(pages.sparkSession, 500)
    weights = weights or fit(pages, id_col, url_col, html_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(h, weights) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["id", "link", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("link"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(work, "id long, link string, text string")
    return out.select(F.col("id").alias(id_col), F.col("link").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
