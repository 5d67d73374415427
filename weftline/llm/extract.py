"""Main text of web pages by paths that a host's pages agree on.

Pages of one site share a template. Each page's containers are scored by the text of their
paragraphs, less links and boilerplate. From the best one, which may be a list or a part of the
article, one goes up to its article or main element, or else as far as only paragraphs, headings
and the like are added; the element reached votes for its generalised path, the tags and
classes from the body down without numbers. Votes are counted per host in Spark, and every page
of the host is then read along the winning path. A page without an element on that path falls
back to its own best container.

Within the main container, elements that aren't article text are left out whole: menus, headers,
footers, sidebars, forms, scripts and styles by tag, and adverts, notices, comments, sharing and
related links by class, id or role: by whole names, not by parts of layout modifiers such as
``has-sidebar``, and never the body, main or article element itself, nor an element that wraps the
article (a form around the whole page, a header with the article's title in it). Character references are decoded; white space in a block,
line breaks included, becomes one space; blocks are joined by one space in page order. Markup that
isn't closed is closed where HTML does so; a link counts as one where it is closed, and no link that holds most of the
page's text does; drawings may close themselves.
A discussion that holds several entries of one kind is reader comments, one that doesn't is a chapter of the article.

Defined results: null or empty html gives an empty text and no vote; a page without text gives an
empty text; pages of any length are read whole, in time that grows with them; pages whose url has no host
form one group; repeated rows vote each; of paths with equal votes the first by name wins, of equally good
containers the first on the page; extra columns pass through, but ``text``, ``n_chars`` and ``path`` are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.session import reachable

from .common import looked_up, staged, unused

#: Hosts whose winning paths may be broadcast: about 200 bytes each.
BROADCAST_HOSTS = 100_000

#: Elements whose content is no markup and no text of the page.
RAW = re.compile(r"(script|style|noscript|template|textarea|svg|iframe|title)(?=[\s/>])", re.I)
#: Of these, those that hold markup, so that without an end only their tag is skipped.
WITHOUT_END = frozenset(("svg", "noscript", "template"))
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea svg iframe title".split()}
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that hold blocks of text or other such elements; others are part of the text.
CONTAINERS = frozenset("html body main article section div header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption p pre h1 h2 h3 h4 h5 h6 address details summary dialog menu select option button hr center".split())
LEFT_OUT = frozenset("nav header footer aside form fieldset menu select option button dialog head".split())
#: Words in a class, id or role that mark what isn't article text.
MARKS = re.compile(r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|comments?|replies|respond|disqus|sidebar|side|widget|menu|nav\w*|breadcrumbs?|footer|header|share|sharing|social|related|recommended|pagination|pager|toolbar|search|contentinfo|complementary|navigation)", re.I)
#: Parts that a marking name may have besides its mark: ``comment-list`` is furniture, ``with-nav`` and ``has-sidebar`` aren't.
PLAIN = re.compile(r"(?:main|site|page|post|top|bottom|left|right|primary|secondary|global|sub|article|entry|author|block|area|box|bar|wrap|wrapper|container|content|section|list|item|items|inner|outer|links?|buttons?|form|title|text|body|group|row|unit|slot|panel|posts|articles|stories|thread|div|gpt|google|\d+)", re.I)
#: Names of what holds reader comments if it holds several entries of one kind.
TALK = re.compile(r"(?:discussions?|threads?|conversations?|reactions?|feedback|guestbook|remarks|opinions)", re.I)
#: Elements that hold the page or the article, whatever they're called.
NEVER_OUT = frozenset("html body main article".split())
NEVER_WRAPS = frozenset("nav footer menu select option button dialog head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SPACES = re.compile(r"\s+")


class Element:
    __slots__ = ("step", "key", "tag", "parent", "marked", "talk", "out", "score")

    def __init__(self, step: str, key: int, tag: str, parent: int, marked: bool, talk: bool = False):
        self.step, self.key, self.tag, self.parent, self.marked, self.talk, self.out, self.score = step, key, tag, parent, marked, talk, False, 0.0


def _key(above: int, step: str) -> int:
    """A number that stands for a path, so that deep ones cost no more than shallow ones."""
    return xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), above)


def path_key(path: str) -> int:
    key = 0  # the root's, whose path is empty
    for step in path.split(">") if path else ():
        key = _key(key, step)
    return key


def path_of(elements: list[Element], k: int) -> str:
    steps = []
    while k > 0:
        steps.append(elements[k].step)
        k = -1 if elements[k].tag in ("html", "body") else elements[k].parent
    return ">".join(reversed(steps))


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of each tag; without a tag for what holds no text, comments and scripts with their content.

    Looks at each character a bounded number of times: once a quoted value has no end, quotes no
    longer count, and once there is no ``>``, there are no more tags.
    """
    at, size, quotes = 0, len(page), True
    ended: dict[str, re.Match | None] = {}  # None once an element has no further end
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        raw = RAW.match(page, at)
        name = None if raw else NAME.match(page, at)
        if raw is None and name is None and page[at : at + 1] not in ("!", "?"):
            continue
        k = name.end() if name else raw.end() if raw else at
        body, end = k, -1
        while quotes and name and (m := QUOTE_OR_END.search(page, k)):
            if m[0] == ">":
                end = m.start()
                break
            k = page.find(m[0], m.end()) + 1
            if not k:
                quotes = False
        if end < 0:
            end = page.find(">", body)
            if end < 0:
                return
        at = end + 1
        if raw:
            kind = raw[1].lower()
            if not (kind == "svg" and page[end - 1] == "/"):
                if kind not in ended or ended[kind] is not None:
                    ended[kind] = RAW_ENDS[kind].search(page, at)
                close = ended[kind]
                at = close.end() if close else at if kind in WITHOUT_END else size
            yield start, at, "", "", ""
        elif name:
            yield start, at, name[1], name[2].lower(), page[name.end() : end]
        else:
            yield start, at, "", "", ""


@functools.lru_cache(10_000)
def _marks(value: str) -> bool:
    """Whether a name in ``value`` says that an element isn't article text: all its parts are marks or plain, one is a mark."""
    for name in value.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        marked = [bool(MARKS.fullmatch(p)) for p in parts]
        if any(marked) and all(m or PLAIN.fullmatch(p) for m, p in zip(marked, parts, strict=True)):
            return True
    return False


@functools.lru_cache(10_000)
def _talks(value: str) -> bool:
    """Whether a name in ``value`` says that an element may hold comments: all its parts are such names or plain, one is such."""
    for name in value.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        talk = [bool(TALK.fullmatch(p)) for p in parts]
        if any(talk) and all(t or PLAIN.fullmatch(p) for t, p in zip(talk, parts, strict=True)):
            return True
    return False


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised step of an element, whether its marks say that it isn't article text, and whether it may hold comments."""
    step, out, talk = tag, False, False
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            if name.lower() == "class":
                kinds = sorted({re.sub(r"[\d>]+", "", k) for k in value.lower().split()} - {""})
                step += "".join("." + k for k in kinds)
            out = out or (tag not in NEVER_OUT and _marks(value))
            talk = talk or (tag not in NEVER_OUT and _talks(value))
    return step, out, talk


def blocks(page: str | None) -> tuple[list[Element], list[tuple[int, str, int]]]:
    """(elements, blocks): blocks are (element, text, characters of it in links) in page order."""
    elements, opened = [Element("", 0, "", -1, False)], Counter()
    found: list[tuple[int, str, int]] = []
    now, parts, linked = 0, [], 0
    pending, link_from = 0, None  # characters since a link opened in this block, and how many blocks were there when it did
    wide: list[tuple[int, int]] = []  # links over whole blocks
    page = page or ""

    def flush() -> None:
        nonlocal linked, pending
        pending = 0  # a link over several blocks is looked at when it ends
        if parts:
            text = SPACES.sub(" ", htmllib.unescape("".join(parts))).strip()
            if text:
                found.append((now, text, linked))
            parts.clear()
        linked = 0

    at = 0
    for start, end, slash, tag, attributes in tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            pending += len(piece)
        at = end
        if not tag:
            continue
        if tag not in CONTAINERS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                if slash and link_from is not None:
                    if link_from == len(found):
                        linked += pending
                    else:
                        flush()
                        wide.append((link_from, len(found)))
                pending, link_from = 0, None if slash else len(found)
            continue
        flush()
        if slash:
            if opened[tag]:
                while elements[now].tag != tag:
                    opened[elements[now].tag] -= 1
                    now = elements[now].parent
                opened[tag] -= 1
                now = elements[now].parent
            continue
        if tag == "hr":
            continue
        # an open paragraph ends where another block begins; list items, rows and cells end likewise
        while elements[now].tag == "p" or elements[now].tag in CLOSES.get(tag, ()):
            opened[elements[now].tag] -= 1
            now = elements[now].parent
        step, marked, talk = _named(tag, attributes)
        step = "body" if tag == "body" else step
        key = _key(0 if tag in ("html", "body") else elements[now].key, step)
        elements.append(Element(step, key, tag, now, marked or tag in LEFT_OUT, talk))
        opened[tag] += 1
        now = len(elements) - 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    total = sum(len(text) for _, text, _ in found)
    for a, b in wide:
        if 2 * sum(len(text) for _, text, _ in found[a:b]) <= total:
            found[a:b] = [(k, text, len(text)) for k, text, _ in found[a:b]]
    _leave_out(elements, found)
    return elements, found


def _leave_out(elements: list[Element], found: list[tuple[int, str, int]]) -> None:
    """Settles which elements are out: the marked ones and all in them, but for wrappers of the article.

    A form that holds most of the page's paragraph text wraps the page, and so does an element of
    marking name if the heading of the first rank or the main element is in it too. A header in an
    article belongs to it if it holds a heading.
    """
    prose, holds, heads, within = [0] * len(elements), [False] * len(elements), [False] * len(elements), [False] * len(elements)
    for k, text, linked in found:
        if elements[k].tag in TEXT_STEPS:
            prose[k] += max(0, len(text) - 2 * linked)
    for k in range(len(elements) - 1, 0, -1):
        e = elements[k]
        prose[e.parent] += prose[k]
        own = e.tag in HEADINGS
        heads[e.parent] |= heads[k] or own
        holds[e.parent] |= holds[k] or e.tag in ("h1", "main")
    entries: dict[int, Counter] = {}
    for e in elements[1:]:
        above = elements[e.parent]
        for k in (e.parent, above.parent):
            if k > 0 and elements[k].talk and ("." in e.step or e.tag in ("li", "article")):
                entries.setdefault(k, Counter())[e.step] += 1
    for k, kinds in entries.items():
        elements[k].marked |= max(kinds.values()) > 1
    for k in range(1, len(elements)):
        e = elements[k]
        wraps = (holds[k] or e.tag in ("form", "fieldset")) and 2 * prose[k] > prose[0] and e.tag not in NEVER_WRAPS
        title = e.tag == "header" and heads[k] and within[e.parent]
        within[k] = within[e.parent] or e.tag == "article"
        e.out = elements[e.parent].out or (e.marked and not wraps and not title)


TEXT_STEPS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th".split())


def best_container(elements: list[Element], found: list[tuple[int, str, int]]) -> int | None:
    """The whole article around the element whose paragraphs have most text: each gives its length to its parent and half of it further up."""
    for e in elements:
        e.score = 0.0
    for k, text, linked in found:
        e = elements[k]
        if e.out:
            continue
        value = max(0, len(text) - 2 * linked)
        holder = e.parent if e.tag in TEXT_STEPS and e.parent >= 0 else k
        elements[holder].score += value
        if elements[holder].parent >= 0:
            elements[elements[holder].parent].score += value / 2
    best = max(range(len(elements)), key=lambda k: (elements[k].score, -k))
    return whole_article(elements, found, best) if elements[best].score > 0 else None


#: Parts of an article that are never all of it while they have an element around them.
INNER = frozenset("p li ul ol dl dd dt table thead tbody tfoot tr td th caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 details summary".split())
#: Elements whose own text is the article's; text that stands loose in others ends the way up.
PROSE = TEXT_STEPS | frozenset("section article main figcaption caption summary details".split())


def whole_article(elements: list[Element], found: list[tuple[int, str, int]], best: int) -> int:
    """``best`` or the element above it that holds the whole article."""
    up, k = [], best
    while k > 0 and elements[k].tag not in ("body", "html"):
        k = elements[k].parent
        up.append(k)
    for tag in ("article", "main"):
        for k in [best, *up]:
            if elements[k].tag == tag:
                return k
    texts, strange = [0] * len(elements), [0] * len(elements)
    for k, text, linked in found:
        if not elements[k].out:
            texts[k] += 1
            strange[k] += 2 * linked > len(text) or elements[k].tag not in PROSE
    for k in range(len(elements) - 1, 0, -1):
        texts[elements[k].parent] += texts[k]
        strange[elements[k].parent] += strange[k]
    now = reached = best
    for k in up:
        if elements[now].tag not in INNER and strange[k] > strange[now]:
            break
        if texts[k] > texts[now] or elements[now].tag in INNER:
            reached = k
        now = k
    return reached


def _on_path(elements: list[Element], found: list[tuple[int, str, int]], path: str, best: int | None = None) -> str:
    """The text on ``path``: of all elements there if a class names them, else of ``best`` or the one with most text."""
    wanted = path_key(path)
    top = [-1] * len(elements)  # the outermost element on the path that an element is in
    for k, e in enumerate(elements):
        if not e.out:
            above = top[e.parent] if e.parent >= 0 else -1
            top[k] = above if above >= 0 else k if e.key == wanted else -1
    if "." not in path.rpartition(">")[2] and path.rpartition(">")[2] not in ("article", "main", "body"):
        sizes = dict.fromkeys(sorted({k for k in top if k >= 0}), 0)
        for k, text, linked in found:
            if top[k] >= 0:
                sizes[top[k]] += max(0, len(text) - 2 * linked)
        only = best if best is not None else max(sizes, key=sizes.__getitem__, default=-1)
        return " ".join(t for k, t, _ in found if top[k] == only >= 0)
    return " ".join(t for k, t, _ in found if top[k] >= 0)


def main_text(page: str | None, path: str | None) -> str:
    """The text on ``path``, or on the path of the page's own best container if nothing is there."""
    elements, found = blocks(page)
    text = _on_path(elements, found, path) if path is not None else ""
    if text:
        return text
    best = best_container(elements, found)
    return "" if best is None else _on_path(elements, found, path_of(elements, best), best)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes): the path that most pages of a host vote for; of equals, the first by name."""

    def vote(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            hosts, paths = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                elements, texts = blocks(page)
                best = best_container(elements, texts)
                if best is not None:
                    hosts.append(host)
                    paths.append(path_of(elements, best))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(vote, "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    won = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("won"))
    return won.select("host", F.col("won.path").alias("path"), (-F.col("won.less")).alias("votes"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without ``html``, with ``text``, ``n_chars`` and the ``path`` of its host."""
    reachable(pages.sparkSession)
    keep = [c for c in pages.columns if c not in {html, "text", "n_chars", "path"}]
    body, host, path, votes = (unused(pages.columns, c) for c in ("_html", "_host", "_path", "_votes"))
    paths = staged(host_paths(pages, html, url).select(F.col("host").alias(host), F.col("path").alias(path), F.col("votes").alias(votes)), "host-paths")
    rows = pages.select(*keep, F.col(html).cast("string").alias(body), host_of(F.col(url)).alias(host))
    rows = looked_up(rows, paths, [host], votes, BROADCAST_HOSTS).select(*keep, F.col(path).alias("path"), body)
    schema = T.StructType([*[rows.schema[c] for c in [*keep, "path"]], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            paths, texts = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            out = [main_text(t, p) for t, p in zip(texts, paths, strict=True)]
            more = [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [f.name for f in schema.fields])

    return rows.mapInArrow(read, schema)
