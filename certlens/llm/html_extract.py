"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. For each
path the text length and the punctuation per node are aggregated, smoothed over
similar paths of the page (a Gaussian of the number of differing tags), and fused
into one score; paths whose score reaches a part of the page's best are content.
Text in links counts against a path, and so does standing outside the element that
the page marks as its article. An article with content is content as a whole; where
the page marks none, the element around most text of the best path is. Containers
that by their tag, role, class or id are menus, headers, footers, sidebars, notices,
adverts, forms or reader comments take no part, nor do scripts, styles and the
page's head. A container around the article stays whatever it is called, and one
with such a word as a part of its class or id only (or a form) also where it holds
the best path; in an article, or that element, only whole names count.

The parser is a small tolerant tokenizer: implied ends of paragraphs, list items
and table cells, void elements, raw text elements, unclosed and stray tags.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import free_name

#: A path is content from this part of the page's best score on.
THRESHOLD = 0.08
SIGMA = 1.5
#: Paths that differ in more elements (weight below 1e-13) don't smooth each other.
FAR = 12
#: Elements nested deeper are not elements of a path, as browsers limit it too: their
#: text is their ancestor's.
DEPTH = 512
#: Weight of paths outside a marked article.
OUTSIDE = 0.05

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea title canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("nav footer aside form menu dialog button search head fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
DROPPED_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget related recommended recommendations promo promotion sponsor sponsored advert adverts advertisement ad ads adsense cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments discussion disqus replies reply pagination pager copyright skip toolbar form".split())
#: Start tags that end an open element of the first kind, up to one of the second.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟।]")
_SPACE = re.compile(r"\s+")


# Dropped elements: HIDDEN ones always; NAMED ones unless they hold the article;
# LIKELY ones unless they hold the article, the best path or a part of its place.
LIKELY, NAMED, HIDDEN = 1, 2, 3


def _dropped(tag: str, attributes: str, inside_article: bool) -> int:
    """How surely an element holds no content, by tag, role, class and id (0: it may)."""
    kind = 0
    if tag in DROPPED or tag == "header" and not inside_article:
        kind = LIKELY if tag == "form" else NAMED
    if not attributes or tag in ("html", "body", "article", "main"):
        return kind
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role":
            if value.strip().lower() in DROPPED_ROLES:
                kind = max(kind, NAMED)
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" and not value or value.lower() in ("true", "hidden"):
                return HIDDEN
        elif any(w in DROPPED_WORDS for w in value.lower().split()):
            kind = max(kind, NAMED)
        elif not inside_article and any(w.lower() in DROPPED_WORDS for w in _WORDS.findall(value)):
            kind = max(kind, LIKELY)
    return kind


#: Path, numbers of its elements, block number, text, in a link.
Node = tuple[tuple[str, ...], tuple[int, ...], int, str, bool]


def text_nodes(page: str) -> tuple[list[Node], dict[int, int]]:
    """Every text node outside hidden elements, and the elements that may be dropped
    with their kind; a new block number starts at every block element's border."""
    nodes: list[Node] = []
    drops: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    deeper: dict[str, int] = {}
    block, at, dropped, links, articles, count = 0, 0, 0, 0, 0, 0

    def pop() -> None:
        nonlocal dropped, links, articles
        tag, number = stack.pop()
        deeper.clear()
        dropped -= drops.get(number) == HIDDEN
        links -= tag == "a"
        articles -= tag in ("article", "main")

    def put(text: str) -> None:
        nodes.append((tuple(t for t, _ in stack), tuple(k for _, k in stack), block, text, links > 0))

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not dropped:
            put(entities.unescape(text))
        if not m:
            return nodes, drops
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCK:
            block += 1
        if closing:
            if deeper.get(tag):
                deeper[tag] -= 1
            elif any(t == tag for t, _ in stack):
                while stack:
                    same = stack[-1][0] == tag
                    pop()
                    if same:
                        break
            continue
        if tag in BLOCK:  # a paragraph ends where another block begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
                    break
        if tag == "body":  # whatever was left open in the head ends here
            while stack and stack[-1][0] != "html":
                pop()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            if tag == "br" and not dropped:
                put(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if len(stack) >= DEPTH:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        count += 1
        off = _dropped(tag, attributes, articles > 0)
        if off:
            drops[count] = off
        stack.append((tag, count))
        dropped += off == HIDDEN
        links += tag == "a"
        articles += tag in ("article", "main")
    return nodes, drops


def _differing(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return max(len(a), len(b)) - same


def _scores(nodes: list[Node]) -> dict[tuple[str, ...], float]:
    """The smoothed, fused ratio of every path with text."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for path, _, _, text, link in nodes:
        size = len(text.strip())
        if size:
            own = sums.setdefault(path, [0.0, 0.0, 0.0])
            own[0] += 1
            own[1] += 0 if link else size
            own[2] += 0 if link else len(_PUNCTUATION.findall(text))
    ratios = {p: (length / n, marks / n) for p, (n, length, marks) in sums.items()}
    fused: dict[tuple[str, ...], float] = {}
    for p in ratios:
        weight = length = marks = 0.0
        for q, (a, b) in ratios.items():
            same = max(len(p), len(q)) - FAR
            if min(len(p), len(q)) < same or same > 0 and p[:same] != q[:same]:
                continue
            w = math.exp(-_differing(p, q) ** 2 / (2 * SIGMA * SIGMA)) * sums[q][0] ** 0.5
            weight, length, marks = weight + w, length + w * a, marks + w * b
        own = ratios[p][0] > 0
        fused[p] = math.sqrt(length / weight * (1 + marks / weight)) if own else 0.0
    for holder in ("article", "main"):  # where the page marks its article, the rest must do far better
        if any(holder in p and x for p, x in fused.items()):
            fused = {p: x if holder in p else x * OUTSIDE for p, x in fused.items()}
            break
    return fused


def _without(nodes: list[Node], off: set[int]) -> list[Node]:
    return [x for x in nodes if off.isdisjoint(x[1])] if off else nodes


def _holders(nodes: list[Node]) -> tuple[str, dict[int, tuple[int, tuple[int, ...]]]]:
    """The tag that marks the page's article, and of each such element that is in
    no other the size of its text outside links and the elements around it."""
    for holder in ("article", "main"):
        found: dict[int, tuple[int, tuple[int, ...]]] = {}
        for path, numbers, _, text, link in nodes:
            if holder in path and not link and (size := len(text.strip())):
                k = path.index(holder)
                found[numbers[k]] = (found.get(numbers[k], (0,))[0] + size, numbers[:k])
        if found:
            return holder, found
    return "", {}


def _place(nodes: list[Node], scores: dict[tuple[str, ...], float]) -> tuple[int, ...]:
    """The elements down to the one around the block with most text of the best path."""
    best = max(scores, key=scores.get, default=())
    deep = max((k for k, t in enumerate(best) if t in BLOCK), default=0)
    sizes: dict[tuple[int, ...], int] = {}
    for path, numbers, _, text, _ in nodes:
        if path == best:
            sizes[numbers[:deep]] = sizes.get(numbers[:deep], 0) + len(text.strip())
    place = max(sizes, key=sizes.get, default=())
    return place if place and best[deep - 1] not in ("html", "body") else ()


def extract(page: str) -> str:
    """The main text: content nodes, one line per block, in page order."""
    nodes, drops = text_nodes(page)
    firm = {e for e, kind in drops.items() if kind == NAMED}
    whole = sum(len(text.strip()) for _, _, _, text, link in nodes if not link)
    _, marked = _holders(_without(nodes, firm))
    if not marked:  # an article in a dropped container is the page's if it has most text
        marked = {k: x for k, x in _holders(nodes)[1].items() if 2 * x[0] > whole}
    if marked:
        drops = {e: kind for e, kind in drops.items() if e not in max(marked.values())[1]}
    elif len(firm) < len(drops):
        left = _without(nodes, firm)
        place = _place(left, _scores(left))
        stay = set(place)
        for path, numbers, *_ in left:  # within the place only whole names count, as in an article
            if place and place[-1] in numbers:
                stay.update(e for t, e in zip(path, numbers) if t != "form")
        drops = {e: kind for e, kind in drops.items() if kind == NAMED or e not in stay}
    nodes = _without(nodes, set(drops))
    scores = _scores(nodes)
    best = max(scores.values(), default=0.0)
    paths = {p for p, x in scores.items() if best and x >= THRESHOLD * best}
    holder, marked = _holders(nodes)
    if marked:
        roots = {numbers[path.index(holder)] for path, numbers, _, text, _ in nodes if path in paths and holder in path and text.strip()}
    else:
        roots = set(_place(nodes, scores)[-1:]) if best else set()
    # inside a block with content, inline nodes (links, emphasis, spaces) belong to it
    content = {block for path, numbers, block, text, _ in nodes if text.strip() and (path in paths or not roots.isdisjoint(numbers))}
    blocks: dict[int, list[str]] = {}
    for _, _, block, text, _ in nodes:
        if block in content:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, plus text and n_chars (code
    points). A null or empty page, and one without content, has the empty text.
    Repeated pages each get their result; new column names that ``pages`` has
    already get an underscore at the end."""
    place = pages.columns.index(html)
    rest = [c for c in pages.columns if c != html]
    slim = pages.select(*rest)
    name = free_name(slim, "text")
    schema = slim.limit(0).withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [extract(x or "") for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != place), pa.array(texts, pa.string())], names=[*rest, name])

    out = pages.mapInArrow(run, schema)
    return out.withColumn(free_name(out, "n_chars"), F.length(name).cast("long"))
