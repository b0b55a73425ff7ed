"""Main text of web pages by scoring the element tree.

Each page is parsed into a tree that tolerates unclosed tags. Blocks (paragraph-like runs of text) give points for their
length and commas to their parent and, less with each step, to its ancestors; a container's points are discounted by
its link density. The best container is kept together with siblings that score like it, and its text is told block by
block. Scripts, styles and the like are never told. Elements that seldom hold main text (menus, headers, footers, sidebars,
forms, hidden elements, notices, adverts, reader comments) are left out of scoring and telling alike, by tag or by the words
of class, id and role. Such a word says nothing in a name that tells a state of a page ("has-sidebar", "comments-open",
"ad-free") or a part of an article ("entry-header"). An element so left out that holds most of the page's text is taken
back, at half its points, where the page's article is inside it: see restore().

Null and empty pages have an empty text; repeated pages get equal rows; extra columns aren't read; a very long page is
parsed whole, without recursion and in time that grows with its length, however deep it nests; an empty table gives an empty
result. Row-local: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
#: Elements that never hold main text, and those that seldom do.
DROPPED = frozenset("script style noscript iframe template svg math head title button select textarea input object canvas audio video xmp noembed noframes".split())
SELDOM = frozenset("nav footer aside form dialog menu".split())
#: Elements that make blocks.
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br caption".split())
#: Words of class, id or role that name what isn't main text, whatever it holds.
UNWANTED = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr newsletter subscribe signup comment comments respond disqus replies discussion related recommend recommended recommendation recommendations".split())
#: Words that name a part of the page's layout.
LAYOUT = frozenset("banner notice notices popup modal overlay sidebar widget widgets share sharing social breadcrumb breadcrumbs nav navigation navbar menu menus footer header masthead pagination pager toolbar skip hidden login search complementary contentinfo".split())
#: Words beside them that tell a state, and words of an article's own parts.
STATES = frozenset("has with no without is not show js on off open opened closed enabled disabled allowed free".split())
ARTICLE_PARTS = frozenset("entry article post story content title headline section body text main".split())
#: Of UNWANTED, what holds prose of its own.
PROSE = frozenset("cookie cookies consent gdpr newsletter subscribe signup comment comments respond disqus replies discussion".split())
#: Elements that show where the article is, and a block that is prose rather than a label.
HEADS = frozenset("h1 article main".split())
PROSE_CHARS = 60
#: Text outside an element that is little against the text inside.
LITTLE = 0.1
#: An element with more than this share of the page's text may hold its article.
MOST_TEXT = 0.5
DISCOUNT = 0.5
_PARTS = re.compile(r"[-_]+")
#: Elements whose end an opening block implies.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = frozenset("table ul ol dl article section div body html main aside nav footer header form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute: a value in quotes that end, or up to white space or the tag's end; quotes inside a bare value are part of it.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>|[\s/]*$")
#: Where markup goes on after a raw element that isn't closed.
MARKUP = re.compile(r"</?(?:p|div|article|section|main|body|html|h[1-6]|ul|ol|table|nav|footer|header|aside|form|blockquote)\b", re.I)

#: Points of a block: one, one a comma, one for each 100 characters up to three; shares by steps up.
CHARS_PER_POINT, MOST_LENGTH_POINTS = 100, 3
STEPS_UP = (1.0, 0.5, 1 / 3, 0.25, 0.2)
SIBLING_SHARE = 0.2


#: Why an element is left out: it never holds main text; its tag or state; a word; a word of what holds prose; a layout word.
NEVER, SELDOM_TOLD, WORD, PROSE_WORD, LAYOUT_WORD = range(1, 6)


class Node:
    """near: of the elements whose end another one implies, the innermost open ones, by NEAR; scope: depth of the innermost element
    of SCOPE; article: inside an article or main element. They are carried down, so nothing walks up a deep tree."""

    __slots__ = ("tag", "parent", "children", "drop", "halved", "score", "chars", "link_chars", "depth", "scope", "near", "article")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.link_chars, self.halved = 0.0, 0, 0, False
        if parent is None:
            self.depth = self.scope = self.drop = 0
            self.near, self.article = _NONE, False
            return
        self.depth = parent.depth + 1
        self.scope = self.depth if tag in SCOPE else parent.scope
        self.near = _NONE if tag in SCOPE else parent.near
        if tag in NEAR:
            self.near = tuple(self if k == NEAR[tag] else x for k, x in enumerate(self.near))
        self.article = parent.article or parent.tag in ("article", "main")
        self.drop = unwanted(tag, attributes, self.article)


#: Groups of elements of which one ends another.
NEAR = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_NONE = (None,) * 6


def names_of(value: str, words: frozenset[str]) -> set[str]:
    """The words that the names in an attribute's value tell."""
    told: set[str] = set()
    for name in value.split():
        parts = _PARTS.split(name)
        found = words.intersection(parts)
        if found and not STATES.intersection(parts) and not (found <= {"header", "title"} and ARTICLE_PARTS.intersection(parts)):
            told |= found
    return told


def unwanted(tag: str, attributes: dict[str, str], inside_article: bool) -> int:
    """Why an element is left out, or 0."""
    if tag in DROPPED:
        return NEVER
    if tag in SELDOM or tag == "header" and not inside_article:  # an article's own header holds its headline
        return SELDOM_TOLD
    if tag == "header" or not attributes or tag in ("html", "body", "article", "main"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return SELDOM_TOLD
    values = " ".join(attributes[k] for k in ("class", "id", "role") if k in attributes)
    told = names_of(values, UNWANTED)
    if told:
        return PROSE_WORD if told & PROSE else WORD
    return LAYOUT_WORD if names_of(values, LAYOUT) else 0


def read_tag(html: str, pos: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, where it ends) of a tag whose name ends at pos."""
    attributes: dict[str, str] = {}
    while True:
        m = TAG_END.match(html, pos)
        if m:
            return attributes, "/" in m[0], m.end()
        m = ATTRIBUTE.match(html, pos)
        if m is None:  # nothing but slashes and an odd character
            return attributes, False, len(html)
        attributes.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        pos = m.end()


def parse(html: str) -> Node:
    root = at = Node("#root", None, {})
    last = 0
    pos, end = 0, len(html)
    open_by_tag: dict[str, list[Node]] = {}
    ends: dict[str, re.Match | None] = {}  # the next end of each raw element, and the next markup

    def close(upto: Node) -> Node:
        """Close all from `at` to `upto`; each element is closed once."""
        x = at
        while True:
            open_by_tag[x.tag].pop()
            if x is upto:
                return x.parent
            x = x.parent

    def after(name: str, pattern: str | re.Pattern) -> re.Match | None:
        """The first match from pos on; looked for anew only when the last one lies behind."""
        if name not in ends or ends[name] is not None and ends[name].start() < pos:
            ends[name] = (re.compile(pattern, re.I) if isinstance(pattern, str) else pattern).search(html, pos)
        return ends[name]

    while pos < end:
        m = TOKEN.search(html, pos)
        if m is None:
            break
        if m.start() > last:
            at.children.append(html[last : m.start()])
        last = pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        attributes, closed, pos = read_tag(html, pos)
        last = pos
        if m[1]:  # an end tag closes up to its element; one that matches nothing is ignored
            opened = open_by_tag.get(tag)
            if opened and (tag in SCOPE or tag in BLOCK or opened[-1].depth > at.scope):
                at = close(opened[-1])
            continue
        if tag in CLOSES_P and at.near[0]:
            at = close(at.near[0])
        if tag in SELF_CLOSING:
            nearest = max((x for k in {NEAR[t] for t in SELF_CLOSING[tag].split()} if (x := at.near[k])), key=lambda x: x.depth, default=None)
            while nearest:  # a row ends the cell in it and then the row before
                at = close(nearest)
                nearest = max((x for k in {NEAR[t] for t in SELF_CLOSING[tag].split()} if (x := at.near[k])), key=lambda x: x.depth, default=None)
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in RAW:
            if not (closed and tag in ("svg", "math")):
                found = after(tag, f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?")
                if found is None:  # never closed: only up to where markup goes on
                    found = after("", MARKUP)
                    last = pos = found.start() if found else end
                else:
                    last = pos = found.end()
        elif tag not in VOID and not closed:
            at = node
            open_by_tag.setdefault(tag, []).append(node)
    if last < end:
        at.children.append(html[last:])
    return root


class Share:
    """Of one element: characters of all its text and of what isn't left out, elements of HEADS with text in both, longest run of
    text without links."""

    __slots__ = ("all", "kept", "heads", "kept_heads", "prose")

    def __init__(self) -> None:
        self.all = self.kept = self.heads = self.kept_heads = self.prose = 0


def restore(root: Node) -> None:
    """Take back elements that hold the page's article, the largest first. A layout word alone doesn't outweigh most of the page's text.
    Any other element is taken back if it outweighs what isn't left out and holds a heading, article or main element where that
    holds none; or if it holds prose and hardly any text is outside of what is left out. A name that speaks of what has prose of
    its own (comments, cookies) is judged last, and must hold most of the page's text and such an element."""
    order, stack = [], [(root, False)]
    while stack:
        n, linked = stack.pop()
        order.append((n, linked))
        stack += [(c, linked or c.tag == "a") for c in n.children if not isinstance(c, str) and c.drop != NEVER]
    shares: dict[int, Share] = {}
    for n, linked in reversed(order):  # children before parents
        s = shares[id(n)] = Share()
        run = 0
        for c in n.children:
            if isinstance(c, str):
                chars = len(c) - c.count(" ")
                s.all, s.kept = s.all + chars, s.kept + chars
                run += 0 if linked else chars
            elif (own := shares.get(id(c))) is not None:
                s.all, s.heads, s.prose = s.all + own.all, s.heads + own.heads, max(s.prose, own.prose)
                if not c.drop:
                    s.kept, s.kept_heads = s.kept + own.kept, s.kept_heads + own.kept_heads
                if c.tag in BLOCK:
                    s.prose, run = max(s.prose, run), 0
        s.prose = max(s.prose, run)
        if n.tag in HEADS and s.all and not s.heads:
            s.heads = 1
            s.kept_heads = 1 if s.kept else 0
    total, kept, heads = shares[id(root)].all, shares[id(root)].kept, shares[id(root)].kept_heads
    for n, _ in sorted((x for x in order if x[0].drop), key=lambda x: (x[0].drop == PROSE_WORD, -shares[id(x[0])].all, x[0].depth)):
        s = shares[id(n)]
        most = s.all > MOST_TEXT * total
        article = s.heads and not heads and s.all > kept and (most or n.drop != PROSE_WORD)
        only = s.prose >= PROSE_CHARS and kept <= LITTLE * s.all and not heads and n.drop != PROSE_WORD and n.tag not in ("nav", "menu")
        if article or only or most and n.drop == LAYOUT_WORD:
            n.drop, n.halved = 0, True
            kept, heads = kept + s.kept, heads + s.kept_heads


def _blocks(node: Node, out: list, linked: bool, owner: Node) -> None:
    """(owner of the block, text, characters within links) of every block below node, in page order. Iterative: pages nest deep."""
    stack: list = [(node, linked, owner, iter(node.children))]
    words: list[str] = []
    links = 0
    own = owner

    def flush(of: Node) -> None:
        nonlocal links
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                out.append((of, text, links))
            words.clear()
        links = 0

    while stack:
        n, inside, own, it = stack[-1]
        child = next(it, None)
        if child is None:
            stack.pop()
            if n.tag in BLOCK:
                flush(own)
            continue
        if isinstance(child, str):
            words.append(child)
            if inside:
                links += len(child)
            continue
        if child.drop:
            if child.tag in BLOCK:
                flush(own)
            continue
        block = child.tag in BLOCK
        if block:
            flush(own)
        stack.append((child, inside or child.tag == "a", child if block else own, iter(child.children)))
    flush(owner)


def add_up(root: Node) -> None:
    """Characters of blocks and of links in them, from the blocks' owners up to the root in one pass."""
    order = [root]
    for n in order:
        order += [c for c in n.children if not isinstance(c, str)]
    for n in reversed(order[1:]):
        n.parent.chars += n.chars
        n.parent.link_chars += n.link_chars


def main_text(html: str) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    restore(root)
    found: list[tuple[Node, str, int]] = []
    _blocks(root, found, False, root)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for owner, text, links in found:
        owner.chars += len(text)
        owner.link_chars += min(links, len(text))
        points = 1 + text.count(",") + text.count("，") + min(len(text) // CHARS_PER_POINT, MOST_LENGTH_POINTS)
        points *= 1 - min(links, len(text)) / len(text)
        up = owner.parent if owner.tag in ("p", "pre", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "dd", "dt") and owner.parent else owner
        for share in STEPS_UP:
            if up is None:
                break
            up.score += points * share
            scored[id(up)] = up
            up = up.parent
    for n in scored.values():
        if n.halved:
            n.score *= DISCOUNT
    add_up(root)
    density = lambda n: n.link_chars / n.chars if n.chars else 0.0
    # nested paragraphs of broken pages: inline and paragraph elements are no containers
    holders = [n for n in scored.values() if n.tag not in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "li", "br", "#root")] or list(scored.values())
    best = max(holders, key=lambda n: n.score * (1 - density(n)))
    while best.parent is not None and best.tag not in ("article", "main", "body", "html", "#root"):
        # an article or main element that holds little else is the container itself
        up = best.parent
        if up.tag in ("article", "main") or up.chars == best.chars and up.tag not in ("body", "html", "#root"):
            best = up
        else:
            break
    kept, least = [best], max(3.0, SIBLING_SHARE * best.score * (1 - density(best)))
    if best.parent is not None:
        kept = []
        for x in best.parent.children:
            if isinstance(x, str):
                continue
            if x is best or not x.drop and (x.score * (1 - density(x)) >= least or x.tag == best.tag == "article" and x.chars or x.tag in ("p", "h1") and x.chars > 80 and density(x) < 0.25):
                kept.append(x)
    out: list[tuple[Node, str, int]] = []
    for x in kept:
        _blocks(x, out, False, x)
    return " ".join(t for _, t, _ in out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# The generated pages hold one <article> each, so plain text functions tell its text there; the extractor doesn't rely on it.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a),
u AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM u
"""
