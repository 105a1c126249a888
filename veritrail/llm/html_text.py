"""Main-text extraction from HTML by flat blocks and a decision tree (operator 8).

A page becomes a flat list of text blocks.  Each has its word count and link
density, those of the blocks before and after it, how its enclosing tags and
class names speak for or against it, and how the words of its container
compare with those of the page's largest.  A decision tree, grown here from a
small labelled table, tells article blocks from the rest.

Tables of blocks to learn from are labelled rows of the same features; the one
built in is derived from ``training_pages``, short pages whose article blocks
are marked, whatever their tags and names say.

Defined results: a null or empty page, or one without article blocks, gives
empty text.  Broken markup (unclosed or stray tags, cut references, an open
comment, script or style) is read as far as it goes; the rest of a page inside
an open script, style or comment is not text.  Repeated pages are extracted
alike.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: HTML element names by what they do to text.
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas select option datalist textarea audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Elements that a new one of their kind ends: an open ``p`` ends at any block, ``li`` at ``li``, and so on.
ENDS_SELF = frozenset("li dt dd tr td th option p".split())
#: Elements that hold other blocks and no text of their own, as a rule.
CONTAINERS = frozenset("div section article main body aside nav header footer form center fieldset menu dialog details".split())
#: Parts of class, id and role names: sure furniture, likely furniture, article, and words that say nothing.
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer comment comments commentlist disqus replies pagination pager popup modal overlay login signup social sharing copyright contentinfo complementary masthead toolbar topbar".split())
LIKELY_NAMES = frozenset("side aside notice alert header foot respond reply share related recommended recommendations trending popular tags tagcloud search legal disclaimer form register follow more".split())
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
PLAIN_NAMES = frozenset("site page box wrap wrapper container list block area section inner outer left right top bottom item items link links the global primary secondary bar panel row col column group unit slot space module posts articles stories js id".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_NAMING = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    named: int
    content: bool
    heading: bool
    container: int
    marked: bool


#: What hides an element, and a heading that belongs to an article.
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_OWN_HEADING = re.compile(r"\b(?:article|post|entry|story|content|section|page)[-_]*header\b", re.I)
_HEADING = re.compile(r"h[1-6]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _class_cues(attributes: str) -> tuple[int, bool]:
    """How surely an element's names are those of furniture (0 to 2), and whether some name an article.

    A name counts if all its parts are known: ``related-posts`` does, ``popular-science`` does not.
    """
    if not attributes.strip():
        return 0, False
    sure, content = 0, False
    for found in _NAMING.findall(attributes):
        for name in _OWN_HEADING.sub("entry", " ".join(found)).split():
            parts = {x.lower() for x in _PART.findall(name)} - PLAIN_NAMES
            if parts & SURE_NAMES and parts <= SURE_NAMES | LIKELY_NAMES | CONTENT_NAMES:
                sure = 2
            elif parts and parts <= LIKELY_NAMES:
                sure = max(sure, 1)
            elif parts and parts <= CONTENT_NAMES:
                content = True
    return sure, content


@dataclass(slots=True)
class _Open:
    """An open element with what holds inside it."""

    name: str
    furniture: bool = False
    named: int = 0
    content: bool = False
    container: int = 0
    marked: bool = False


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """A page's text blocks in order, white space turned into one space and references decoded; and the parent of each container (0: the page)."""
    out: list[Block] = []
    top = _Open("")
    stack: list[_Open] = []
    parents = [0]
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = 0, 0

    def inside() -> _Open:
        return stack[-1] if stack else top

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                links = _SPACE.sub(" ", html_lib.unescape(" ".join(linked))).strip()
                x = inside()
                out.append(Block(text, text.count(" ") + 1, links.count(" ") + 1 if links else 0, x.furniture, x.named, x.content, any(_HEADING.fullmatch(e.name) for e in stack[-2:]), x.container, x.marked))
            parts.clear()
            linked.clear()

    def pop_to(index: int) -> None:
        nonlocal in_link
        for x in stack[index:]:
            in_link -= x.name == "a"
        del stack[index:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk:
            parts.append(chunk)
            if in_link > 0:
                linked.append(chunk)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name not in INLINE:
                flush()
            elif name == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break
            continue
        attributes = m[3] or ""
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/") and name != "head":
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            if name not in INLINE:
                flush()
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                parts.append(" " if name == "br" else "")
            else:
                in_link += name == "a"
                x = inside()
                stack.append(_Open(name, x.furniture, x.named, x.content, x.container, x.marked))
            continue
        flush()
        if name in VOID:
            continue
        # Block elements end what they cannot stand in: open inline elements and an open element of their own kind.
        cut = len(stack)
        while cut and (stack[cut - 1].name in INLINE or stack[cut - 1].name == "p" or (name in ENDS_SELF and stack[cut - 1].name == name)):
            cut -= 1
        pop_to(cut)
        x = inside()
        sure, named_content = _class_cues(attributes)
        whole = name in ("body", "html")
        hidden = bool(_HIDDEN.search(attributes))
        furniture = x.furniture or hidden or (name in FURNITURE_TAGS and not (name == "header" and x.content))
        new = _Open(name, furniture, x.named if whole else max(x.named, sure), x.content or name in CONTENT_TAGS or (named_content and not sure), x.container, x.marked or "data-label" in attributes)
        if name in CONTAINERS and not whole:
            parents.append(x.container)
            new.container = len(parents) - 1
        stack.append(new)
    flush()
    return out, parents


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "furniture", "named", "content", "content on page", "heading", "share", "outer share")


def features(found: list[Block], parents: list[int]) -> list[tuple[float, ...]]:
    """One row of ``FEATURES`` a block.

    share        words outside links of the block's container, and half of
                 those in the containers directly inside it, against the
                 page's largest; the page itself is not one.  Furniture, sure
                 names and, where some blocks stand in article containers,
                 blocks outside those don't count.
    outer share  the same of the container around that.

    The first and the last block are their own neighbours.
    """
    any_content = any(b.content and not b.furniture and b.named < 2 for b in found)
    own = [0.0] * len(parents)
    for b in found:
        if not b.furniture and b.named < 2 and b.content >= any_content:
            own[b.container] += b.words - b.linked
    weight = list(own)
    for k in range(1, len(parents)):
        weight[parents[k]] += own[k] / 2
    # Blocks outside all containers share the page, so it counts with its own words only.
    weight[0] = own[0]
    most = max(weight, default=0.0) or 1.0
    outer = [0.0 if parents[k] == 0 else weight[parents[k]] / most for k in range(len(parents))]
    flat = [(float(b.words), min(1.0, b.linked / b.words)) for b in found]
    flat = [*flat[:1], *flat, *flat[-1:]]
    return [(*flat[i + 1], *flat[i], *flat[i + 2], float(b.furniture), float(b.named), float(b.content), float(any_content), float(b.heading), weight[b.container] / most, outer[b.container]) for i, b in enumerate(found)]


def _line(n: int, k: int) -> str:
    """A made-up sentence of ``n`` words."""
    stems = ("ra", "ve", "lo", "min", "tar", "so", "pel", "du")
    return (" ".join(stems[(7 * i + 3 * k) % 8] + stems[(5 * i + k) % 8] for i in range(n)) + ".").capitalize()


def _links(n: int, k: int, tag: str = "li") -> str:
    inner = "".join(f'<{tag}><a href="/{i}">{_line(1 + (i + k) % 2, k + i)[:-1]}</a></{tag}>' for i in range(n))
    return f"<ul>{inner}</ul>" if tag == "li" else inner


def _story(k: int, paragraphs: int = 4) -> str:
    """Marked blocks of an article: heading (linked in every third), paragraphs long and short, a list, a heading inside, and in every second a list of sources."""
    mark = 'data-label="1"'
    head = f'<a href="/own">{_line(5, k)[:-1]}</a>' if k % 3 == 0 else _line(5, k)[:-1]
    body = "".join(f"<p {mark}>{_line((42, 3, 25, 60, 9)[(i + k) % 5], k + i)}</p>" for i in range(paragraphs))
    more = f'<h2 {mark}>{_line(2, k)[:-1]}</h2><p {mark}>{_line(30, k + 9)} See <a href="/map">{_line(3, k)}</a></p><ul><li {mark}>{_line(4, k)}</li><li {mark}>{_line(2, k + 1)}</li></ul>'
    sources = f'<p {mark}>{_line(2, k)} <a href="/s">{_line(4, k + 2)}</a></p>' if k % 2 else ""
    return f"<h1 {mark}>{head}</h1>{body}{more}{sources}<p {mark}>{_line(2, k + 5)}</p>"


def _each_in_a_div(story: str) -> str:
    return re.sub(r"(<(?:p|h1|h2) .*?</(?:p|h1|h2)>)", r"<div>\1</div>", story)


def training_pages() -> list[str]:
    """Small labelled pages: ways in which sites lay out articles (marked) and furniture, each with articles of several lengths."""
    pages = []
    for k in range(4):
        menu, story, short, long = _links(5, k), _story(k, 3 + k), _story(k, 1), _line(150 + 40 * k, k)
        talk = "".join(f"<p>{_line(n, k + n)}</p>" for n in (22, 4, 35))
        much = "".join(f"<p>{_line(n, k + n)}</p>" for n in (80, 14, 95, 60, 120, 7))
        vague = ("popular", "tags", "legal", "share")[k]
        pages += [
            f'<body><nav>{menu}</nav><div class="ad">{_line(9, k)}</div><article>{story}</article><footer>{_line(8, k)}</footer></body>',
            f'<body><header><a href="/">{_line(2, k)}</a> <p>{_line(7, k)}</p></header><div><p>{_line(16, k)}</p></div><main>{short}</main><aside><h3>{_line(1, k)}</h3><p>{long}</p></aside><footer><p>{_line(6, k)}</p></footer></body>',
            f'<body><div id="menu">{menu}</div><div id="content">{short}<div class="comments">{much}</div></div><div class="sidebar"><p>{long}</p></div><form><p>{_line(14, k)}</p></form></body>',
            f'<body><div>{menu}</div><div>{_line(11, k)}</div><div>{story}</div><div><a href="/a">{_line(2, k)}</a> <a href="/c">{_line(1, k)}</a></div><div>{_line(12, k)}</div></body>',
            f'<body><table><tr><td><a href="/">{_line(1, k)}</a> <a href="/x">{_line(1, k)}</a></td></tr></table>{story}<p><a href="/next">{_line(6, k)}</a></p></body>',
            f'<body><div class="banner">{_line(8, k)}</div><div class="{vague}">{story}</div><div class="footer"><p>{_line(17, k)}</p></div></body>',
            f'<body><div class="page"><div class="top">{menu}</div><div>{_each_in_a_div(story)}</div><div class="notice"><p>{_line(13, k)}</p></div><div class="related">{_links(4, k, "p")}</div></div></body>',
            f'<body><div class="wrapper"><div><p>{_line(15, k)}</p></div><section>{story}</section><div class="comments">{talk}</div><div><p>{_line(10, k)}</p></div></div></body>',
            f'<body><article><section>{story}</section><section>{short}</section><aside><p>{_line(30, k)}</p></aside><div class="newsletter"><p>{_line(12, k)}</p></div></article></body>',
            f"<body>{short}</body>",
            f'<body><div>{story}</div></body>',
            f'<body><p><a href="/">{_line(2, k)}</a> <a href="/b">{_line(1, k)}</a></p><div>{story}</div><p><a href="/z">{_line(3, k)}</a></p></body>',
            f'<body><main><article>{_each_in_a_div(short)}<ul>{"".join(f'<li data-label="1"><a href="/r{i}">{_line(6, i)}</a></li>' for i in range(3))}</ul></article><div class="{vague}">{_links(4, k, "p")}</div><section class="comments">{much}</section></main><footer>{menu}</footer></body>',
            f'<body><div class="header">{menu}</div><div class="post"><div class="share">{_line(2, k)}</div>{short}<div class="promo"><p>{_line(26, k)}</p></div></div><div class="side"><p>{long}</p></div></body>',
            f'<body><header>{menu}</header><article><header><h1 data-label="1">{_line(6, k)}</h1><p data-label="1">{_line(4, k)}</p></header><div>{story}</div><footer>{_line(7, k)}</footer></article></body>',
            f'<body><article><div><h1 data-label="1">{_line(7, k)}</h1></div><div>{story}</div></article><div><p>{_line(12, k)}</p></div></body>',
            f'<body><table><tr><td><a href="/">{_line(2, k)}</a></td><td>{_line(3, k)}</td><td><a href="/y">{_line(2, k)}</a></td></tr></table>{story}<p><a href="/p">{_line(3, k)}</a></p><p>{_line(5, k)}</p><p><a href="/q">{_line(2, k)}</a></p><p>{_line(4, k)}</p><p><a href="/v">{_line(2, k)}</a></p></body>',
            f'<body><p><a href="/">{_line(2, k)}</a></p><p>{_line(6, k)}</p><p><a href="/i">{_line(3, k)}</a></p>{short}{_line(40, k).join(('<p data-label="1">', "</p>"))}</body>',
            f'<body><div>{_line(6 + 7 * k, k)}</div><div class="{vague}">{short}</div><div><p>{_line(9 + 5 * k, k)}</p></div></body>',
            f'<body><div><h1 data-label="1">{_line(6, k)}</h1></div><div>{story}</div><div>{_line(8 + 9 * k, k)}</div></body>',
            f'<body><section><p>{_line(8 + 3 * k, k)}</p></section><section>{short}</section><section><p>{_line(11 + 4 * k, k)}</p></section></body>',
            f'<body><div class="cookie"><p>{_line(33, k)}</p></div><div><div><div>{story}</div><div>{_line(20, k)}</div></div></div></body>',
        ]
    return pages


@cache
def labelled_table() -> tuple[tuple[tuple[float, ...], int], ...]:
    """(features, 1 for article) of each block of the labelled pages."""
    rows = []
    for page in training_pages():
        found, parents = blocks(page)
        rows += [(x, int(b.marked)) for b, x in zip(found, features(found, parents), strict=True)]
    return tuple(rows)


def grow_tree(rows: tuple[tuple[tuple[float, ...], int], ...], depth: int = 9, least: int = 2):
    """A binary tree by Gini impurity: (feature, bound, at most, above) or a share of article blocks."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * least:
        return share
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            left = [y for x, y in rows if x[f] <= bound]
            right = [y for x, y in rows if x[f] > bound]
            if min(len(left), len(right)) >= least:
                impurity = sum(2 * sum(part) * (1 - sum(part) / len(part)) for part in (left, right))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, bound)
    if best is None:
        return share
    _, f, bound = best
    return (f, bound, grow_tree(tuple(r for r in rows if r[0][f] <= bound), depth - 1, least), grow_tree(tuple(r for r in rows if r[0][f] > bound), depth - 1, least))


@cache
def trained_tree():
    return grow_tree(labelled_table())


def is_article(x: tuple[float, ...], tree) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def extract(page: str | None, tree) -> str:
    """The article's blocks joined by blank lines."""
    if not page:
        return ""
    found, parents = blocks(page)
    return "\n\n".join(b.text for b, x in zip(found, features(found, parents), strict=True) if is_article(x, tree))


def extract_text(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars of each page.  ``tree``: from ``grow_tree``; by default that of the built-in table."""
    tree = tree or trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
