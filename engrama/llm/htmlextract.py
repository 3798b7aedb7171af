"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Words score by the elements they stand in: tag names, the words of class, id and role attributes, and whether their block is
all links; a header or footer outside of all sections counts by its role, as a banner is. Each such feature weighs as the log-odds of content among the words under it in labelled pages; one that speaks
clearly against content (an advert's class) decides alone, else the sum does. Tags score negative, by how much more often they
stand outside content. One scan finds the contiguous region of the largest sum; what scores negative inside it is left out.
That a block is all links counts in finding the region only: inside it, such a block stays or goes by its other features, and one
next to the region joins it if the two share an element that speaks for content, or if it is the heading before it.

Blocks are what block-level tags bound; white space inside one becomes one space; blocks are joined by a newline.

A page is read once, in time and memory that go with its length: what is missing once (a closing quote, an end tag) is not looked for again.
A tag without ``>`` ends the page, as does an open comment or script; where a quote is never closed, this and all later
tags end at their first ``>``. End tags that close nothing are passed over, and those of inline elements close no block.

Defined results: null html is empty and gives empty text; html of a single unclosed tag, comment or script gives
empty text; repeated rows are extracted alike; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
#: Elements whose content is no text of the page. The first three are never read as markup; of the others an end tag must follow.
RAW = frozenset("script style iframe template svg math object noscript".split())
NO_MARKUP = frozenset("script style iframe".split())
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{9,});?")
_NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a start tag closes if it is open, the outermost first.
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that may end without an end tag: they do not keep others from being closed.
SOFT = frozenset(("p", *CLOSES_SELF))

#: Labelled pages: markup with the main text inside ``{{`` and ``}}``. Invented, in the shapes that pages commonly have.
LABELLED = (
    "<html><head><title>On gardens</title><meta name=d></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav><div class=ad>Buy one get one free today</div><article>{{<h1>On gardens</h1><p>A garden is made of <b>soil</b> and time.</p><p>It asks for water and patience each day.</p>}}</article><footer>&copy; 2020 The garden site. All rights reserved</footer></body></html>",
    "<html><head><title>t</title></head><body><header class=site-header><div class=logo>Site name</div><form class=search><label>Search</label><input><button>Go</button></form></header><main>{{<h2>Rivers</h2><p>Rivers run to the sea.</p><ul><li>First the spring in the hills</li><li>then the slow plain below</li></ul><blockquote>All is water, said the old one.</blockquote><p>That is the way of them.</p>}}</main><aside class=sidebar><h3>Related</h3><ul><li><a>Lakes</a></li><li><a>Seas</a></li></ul></aside><footer><p>Contact and imprint</p></footer></body></html>",
    "<body><div id=cookie-notice class=banner>We use cookies. <button>Accept</button></div><div id=menu class=menu><a>One</a> <a>Two</a></div><div id=content class=content>{{<h1>Bread</h1><p>Flour, salt and water make the dough.</p><table><tr><th>Part</th><td>Weight of it</td></tr></table><h2>Baking</h2><p>The oven is hot before the loaf goes in, as <a>bakers</a> know.</p>}}<div class=share><a>Share this</a></div></div><section id=comments class=comments><h3>Comments</h3><p>Nice loaf, said a reader who tried it.</p><p>Mine burned.</p></section><div class=footer>Imprint</div></body>",
    "<body><div class=breadcrumb><a>Home</a> / <a>News</a></div><div class=sponsored><p>Sponsored: a new car for you</p></div><div class=post>{{<div class=entry><p>The council met on Monday and spoke of roads.</p><p>No vote was held, so they meet again.</p></div>}}</div><div class=newsletter><form><p>Subscribe to our letter</p><input></form></div><div class=related><ul><li><a>Older story</a></li></ul></div><div class=widget><h4>Popular</h4><p>Ten things you missed</p></div></body>",
    "<body><header role=banner><h1>The Daily</h1><p>News each day</p></header><article>{{<h1>Storm</h1><p>Wind came up at night and took the old roof.</p>}}<aside class=promo><p>Get the app now</p></aside>{{<p>By dawn the street was full of leaves and tiles.</p><figure><figcaption>The street at dawn</figcaption></figure>}}<div class=comment><p>We saw it too, wrote a neighbour.</p></div></article><div class=notice role=alert><p>This site will be down on Sunday</p></div><footer role=contentinfo><ul><li><a>Terms</a></li></ul></footer></body>",
    "<body><nav class=pagination><a>Next</a></nav><section>{{<h1>Clay</h1><p>Clay is wet earth that keeps a shape.</p><h2>Firing</h2><p>Heat makes it stone.</p><ol><li>Dry the pot for a week.</li><li>Fire it slowly.</li></ol><pre>heat and hold</pre>}}</section><div class=advert><p>Kilns at half price</p></div><div id=sidebar><p>About the author</p></div><div class=popup><p>Sign up for more</p><form><select><option>Weekly</option></select><textarea>Your mail</textarea></form></div><ul class=tags><li>pots</li><li>craft</li></ul></body>",
    "<body><div class=ads><p>Click here to win</p></div><div class=article>{{<p>Letters were once the only way to speak across the sea.</p><p>They took weeks, and some never came.</p><dl><dt>Post</dt><dd>carried by ship and rider</dd></dl>}}</div><div class=social><a>Follow</a></div><div id=reviews class=reviews><p>Five stars from me</p></div><div class=disclaimer><p>Views are the writer's own</p></div><div id=footer><p>Made by hand</p></div></body>",
    "<body><div id=page><div class=wrapper><div class=header><a>Site</a></div><div class=nav><a>Start</a> <a>Archive</a></div><div><div class=ad>Half price on all shoes</div><div>{{<h1>Wool</h1><div><p>Sheep give wool, and <a>spinners</a> turn it to <a>yarn</a>, as <a href=/x>the old books tell us</a>.</p></div><p>Then come the <i>needles</i>.</p><div>A row of knots holds the whole cloth together.</div>}}</div></div><div class=footer><a>Legal</a></div></div></div></body>",
    "<body><div class=container><div class=row><div class=top><a>Home</a></div>{{<p>The mill stands by the weir and <a>grinds</a> for three villages.</p><p>Its <a>wheel</a> is of oak.</p><div><div><p>In dry years it rests, and <a>the miller fishes</a>.</p></div></div>}}<div class=cookie><p>Cookies help us</p></div><div class=login><form><div><label>Name</label></div></form></div></div></div></body>",
    "<body><div class=masthead><p>The Weekly Post</p></div><div class=navbar><a>News</a><a>Sport</a></div><div class=announcement><p>New opening hours from May</p></div><div class=advertisement><p>Shoes for every foot</p></div><div class=story><article class=post><header class=entry>{{<h1>Of bees</h1><p>A hive holds thousands, and one queen rules them.</p></header><section><p>They <em>dance</em> to tell the way to the <a>lime trees</a>.</p><ul><li><a>How they see</a> the sun</li><li>What honey is</li></ul></section>}}<div class=subscribe><p>Join our list today</p></div><ol class=commentlist><li class=comment><p>Lovely read</p></li><li class=reply><p>Indeed it was</p></li></ol><div class=discussion><p>Join the talk</p></div><div class=responses><p>Three answers so far</p></div></article></div><div class=modal><p>Stay a while</p></div><div class=consent><p>We value your choice</p></div><div class=alert><p>Old browser in use</p></div><div class=signup><p>Open an account</p></div><div class=copyright><p>All rights are kept</p></div><div class=pager><a>Next page</a></div><div class=toolbar><a>Print</a></div></body>",
    "<body>{{<h1>Salt</h1><p>Salt was once worth its weight in silver, <a>or so they say</a>.</p><div>It came over <a>the northern road</a>.</div><p>It keeps meat for a winter.</p>}}<div class=recommended><p>Read next</p></div><footer><div><p>Imprint and terms</p></div></footer></body>",
)


#: Elements that only build the page or mark words: no feature.
PLAIN = frozenset("html body div span section b i em strong small u s sub sup font mark abbr cite code q time wbr br img a".split())
LINKS = "l:links"
#: The role of a page's own header and footer: those outside of its sections.
ROLES = {"header": "banner", "footer": "contentinfo"}
SECTIONS = ("article", "main", "section", "aside", "nav")
HEADINGS = frozenset(f"t:h{i}" for i in range(1, 7))


NONE: frozenset[str] = frozenset()


@dataclass
class Weights:
    """``context``: log-odds of content by feature; ``veto``: a feature at or below it decides alone; ``tag``: the (negative) score of a tag."""

    bias: float
    context: dict[str, float]
    tag: dict[str, float]
    other_tag: float
    veto: float = -1.2
    against: float = -0.1  # score of a word that a veto speaks against: an advert inside an article does not cut it in two

    def of(self, features) -> float:
        """Score of a word, from -1 to 1."""
        found = [self.context.get(f, 0.0) for f in features]
        if found and min(found) <= self.veto:
            return self.against
        return max(-1.0, min(1.0, self.bias + sum(found)))


def _features(tag: str, attr: str, role: str, cache: dict[tuple[str, str, str], tuple[str, ...]], known: frozenset[str] | dict | None) -> tuple[str, ...]:
    """Features of an element; of ``known`` ones only, if given."""
    key = (tag, attr, role)
    if (found := cache.get(key)) is not None:
        return found
    names = ["c:" + role] if role else [] if tag in PLAIN else ["t:" + tag]
    if attr:
        for values in _NAMES.findall(attr):
            names += ["c:" + p for p in _PARTS.findall("".join(values).lower())]
        if re.search(r"(?:\s|^)hidden(?:\s|=|$)|display\s*:\s*none", attr, re.I):
            names.append("a:hidden")
    found = tuple(dict.fromkeys(n for n in names if known is None or n in known))
    if len(attr) <= 500:
        if len(cache) > 10_000:
            cache.clear()
        cache[key] = found
    return found


class _Stack:
    """Open elements. Each element is pushed and popped once; what a tag closes is found by its name."""

    def __init__(self):
        self.items: list[list] = []  # name, features, state
        self.open: dict[str, list[int]] = {}  # places by name
        self.blocks: list[int] = []  # places of elements that are not inline
        self.walls: list[int] = []  # of these, the ones that are not SOFT
        self.link = -1  # least number of open elements while a link is open, or -1

    def push(self, name: str, features: tuple[str, ...]) -> None:
        at = len(self.items)
        self.items.append([name, features, None])
        self.open.setdefault(name, []).append(at)
        if name not in INLINE:
            self.blocks.append(at)
            if name not in SOFT:
                self.walls.append(at)

    def cut(self, to: int) -> None:
        while len(self.items) > to:
            name = self.items.pop()[0]
            self.open[name].pop()
            if name not in INLINE:
                self.blocks.pop()
                if name not in SOFT:
                    self.walls.pop()
        if len(self.items) < self.link:
            self.link = -1

    def last(self, name: str) -> int:
        places = self.open.get(name)
        return places[-1] if places else -1

    def start(self, name: str) -> None:
        """Close what the start tag ``name`` closes."""
        wall = self.walls[-1] if self.walls else -1
        if name in CLOSES_P:
            if (at := self.last("p")) > wall:
                self.cut(at)
        elif name in CLOSES_SELF:
            for closed in CLOSES_SELF[name]:
                if (at := self.last(closed)) > wall:
                    self.cut(at)
                    wall = min(wall, at - 1)

    def end(self, name: str) -> None:
        if (at := self.last(name)) >= 0 and not (name in INLINE and self.blocks and self.blocks[-1] > at):
            self.cut(at)


def scan(page: str, tagged, said, cache: dict, known=None) -> None:
    """Call ``tagged(name)`` for each tag and ``said(stack, text, block)`` for each text."""
    stack = _Stack()
    block = at = 0
    size, quotes, unclosed = len(page), True, set()
    while at < size:
        found = _MARKUP.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            said(stack, page[at:begin], block)
        if begin == size:
            return
        if m := _TAG.match(page, begin):
            closing, tag, attr = m.groups()
            at = m.end()
        elif m := _NAME.match(page, begin):
            closing, tag = m.groups()
            at = m.end()
            end = page.find(">", at)
            if end < 0:
                return
            if quotes:
                stop = _ATTRIBUTES.match(page, at).end()
                if stop < size and page[stop] == ">":
                    end = stop
                else:
                    quotes = False
            attr, at = page[at:end], end + 1
        else:
            comment = page.startswith("<!--", begin)
            end = page.find("-->", begin + 4) if comment else page.find(">", begin)
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        tag = tag.lower()
        if tag in RAW and not closing and not (attr.endswith("/") and tag in ("svg", "math")):
            close = None if tag in unclosed else _ENDS[tag].search(page, at)
            if close:
                at = close.end()
                continue
            if tag in NO_MARKUP:
                return
            unclosed.add(tag)
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            said(stack, " ", block)
        tagged(tag)
        if closing:
            if tag == "a":
                stack.link = -1
            stack.end(tag)
            continue
        stack.start(tag)
        if tag not in VOID:
            role = ROLES[tag] if tag in ROLES and not any(stack.open.get(x) for x in SECTIONS) else ""
            stack.push(tag, _features(tag, attr, role, cache, known))
            if tag == "a":
                stack.link = len(stack.items)


class _Page:
    """Tags and texts of a page in order; each text with the features around it, each block with its share of link words."""

    def __init__(self, page: str, cache: dict, known=None):
        self.kinds: list[tuple[str, str, int, frozenset[str]]] = []  # tag, text, block, features
        self.words: dict[int, list[int]] = {}  # of a block: all, in links
        self.tags: dict[str, tuple[str, str, int, frozenset[str]]] = {}  # a tag's block is not asked for
        scan(page, self.tagged, self.said, cache, known)

    def tagged(self, name: str) -> None:
        if name not in self.tags:
            self.tags[name] = (name, "", 0, NONE)
        self.kinds.append(self.tags[name])

    def said(self, stack: _Stack, text: str, block: int) -> None:
        features = NONE
        items = stack.items
        if items:
            if items[-1][2] is None:  # outwards to the innermost element that is known
                at = len(items) - 1
                while at and items[at - 1][2] is None:
                    at -= 1
                for i in range(at, len(items)):
                    above = items[i - 1][2] if i else NONE
                    items[i][2] = above.union(items[i][1]) if items[i][1] else above
            features = items[-1][2]
            n = len(text.split())
            counts = self.words.setdefault(block, [0, 0])
            counts[0] += n
            counts[1] += n * (stack.link >= 0)
        self.kinds.append(("", text, block, features))

    def links_only(self, block: int) -> bool:
        n, linked = self.words.get(block, (0, 0))
        return n > 0 and linked >= 0.8 * n


def learn(pages=LABELLED) -> Weights:
    """Weights from labelled pages, by counting."""
    under: dict[str, list[int]] = {}
    tags: dict[str, list[int]] = {}
    words = [0, 0]
    for page in pages:
        found, inside = _Page(page, {}), 0
        for tag, text, block, features in found.kinds:
            if tag:
                tags.setdefault(tag, [0, 0])[inside] += 1
            for part in re.split(r"(\{\{|\}\})", text):
                if part in ("{{", "}}"):
                    inside = int(part == "{{")
                    continue
                n = len(part.split())
                words[inside] += n
                for f in features | {LINKS} if found.links_only(block) else features:
                    under.setdefault(f, [0, 0])[inside] += n
    odds = lambda n: math.log((n[1] + 0.5) / (n[0] + 0.5))
    total = [sum(t[i] for t in tags.values()) for i in (0, 1)]
    score = {t: math.log((n[1] + 1) / (total[1] + 2)) - math.log((n[0] + 1) / (total[0] + 2)) for t, n in tags.items()}
    return Weights(odds(words), {f: odds(n) for f, n in under.items()}, {t: min(-0.05, max(-0.15, s)) for t, s in score.items()}, -0.1)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[a, b) of the largest sum, the first such; empty if no sum is positive."""
    best, a, b, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, a, b = total, start, i + 1
    return a, b


def with_linked(kinds: list, linked: list[bool], signs: list[bool], a: int, b: int, weights: Weights) -> tuple[int, int]:
    """The region [a, b) with the linked blocks at its edges."""
    inside = [i for i in range(a, b) if signs[i] and kinds[i][1].strip()]
    if not inside:
        return a, b

    def shares(i: int, edge: int) -> bool:
        return sum(weights.context.get(f, 0.0) for f in kinds[i][3] & kinds[edge][3]) > 0

    def opposed(i: int, edge: int) -> bool:
        """Whether a class of its own speaks against it."""
        return any(f[:2] != "t:" and weights.context.get(f, 0.0) < 0 for f in kinds[i][3] - kinds[edge][3])

    heading = None
    for i in range(a - 1, -1, -1):
        if kinds[i][0] or not kinds[i][1].strip():
            continue
        if heading is None and kinds[i][3] & HEADINGS:
            heading = kinds[i][2]
        heading = heading or 0
        if not linked[i] or opposed(i, inside[0]) or not (kinds[i][2] == heading or shares(i, inside[0])):
            break
        a = i
    for i in range(b, len(kinds)):
        if kinds[i][0] or not kinds[i][1].strip():
            continue
        if not linked[i] or opposed(i, inside[-1]) or not shares(i, inside[-1]):
            break
        b = i + 1
    return a, b


def decoded(text: str) -> str:
    """Character references resolved; numbers beyond all characters, however long, give the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("&#1114112;", text) if "&#" in text else text)


def extract(page: str, weights: Weights, cache: dict | None = None) -> str:
    """The main text of a page."""
    collecting = gc.isenabled()
    gc.disable()  # a page makes many small objects and no cycles
    try:
        return _extract(page, weights, cache)
    finally:
        if collecting:
            gc.enable()


def _extract(page: str, weights: Weights, cache: dict | None) -> str:
    found = _Page(page, {} if cache is None else cache, weights.context)
    known: dict[tuple[frozenset[str], bool], float] = {}
    scores: list[float] = []
    signs: list[bool] = []
    linked: list[bool] = []  # and not against content otherwise
    of_tag = weights.tag.get
    for tag, text, block, features in found.kinds:
        if tag:
            scores.append(of_tag(tag, weights.other_tag))
            signs.append(False)
            linked.append(False)
            continue
        key = features, found.links_only(block)
        for k in (key, (features, False)):
            if k not in known:
                known[k] = weights.of(features | {LINKS} if k[1] else features)
        scores.append(known[key] * len(text.split()))
        signs.append(known[features, False] > 0)
        linked.append(key[1] and signs[-1])
    a, b = best_region(scores)
    a, b = with_linked(found.kinds, linked, signs, a, b, weights)
    blocks: list[tuple[int, list[str]]] = []
    for (_, text, block, _), positive in zip(found.kinds[a:b], signs[a:b], strict=True):
        if positive:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    lines = (" ".join("".join(map(decoded, parts)).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", labelled=LABELLED) -> DataFrame:
    """(key, url, text) of every row. The weights are a few hundred numbers."""
    shared = pages.sparkSession.sparkContext.broadcast(learn(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = [extract(t or "", shared.value, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    return pages.select(key, url, F.col(markup).cast("string").alias("html")).mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string")
