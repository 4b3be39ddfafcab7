"""Main text of web pages with site template removal.

The main content of a page is its ``article`` or ``main`` elements, or else the whole page.
Every subtree in it is hashed, and Spark counts, for each host, over how many different pages
(different in what remains without the subtree) a hash recurs; subtrees that recur on ``MANY``
pages or more are the site's template and are deleted. In an ``article`` or ``main``, the element
itself, whatever holds most of its text, and plain lines (paragraphs without class or id), words,
cells and headings are never a template, and nothing is deleted where the template would take
most of the text. Markup is an aid: elements
whose tag or class names them as menu, header, footer, sidebar, notice, advert, form, comment or
code are left out too, unless only a name says so and they hold the article; inside an article only
classes of such boxes count, no ids.

Defined cases: elements nested more than ``MOST_DEPTH`` deep belong to the element at that depth,
blocks stay blocks there; a null or empty page has an empty text; a null url has an empty host; repeated
rows stay repeated; a truncated page is read as far as it goes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, read, saved
from tracelake.llm.url_rules import host_of

#: Open elements beyond which an element is read as part of the one that holds it.
MOST_DEPTH = 200
#: Different pages of a host from which a recurring subtree is its template.
MANY = 5
#: Least length of a text, against the longest, that tells pages apart.
MINOR = 0.1
#: Least length of such a text in characters.
FEW = 20
#: Template hashes that may be sent to every task; more are joined to their pages by a shuffle.
MOST_SENT = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head".split())
#: Elements left out by their name.
OUTSIDE = frozenset("nav header footer aside form button select textarea input dialog menu fieldset label option".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that may be a template inside main content; lines, words, cells and headings recur in any prose.
UNITS = frozenset("address aside center details div dl figure footer header nav ol section table ul".split())
#: Those that may be one where a class or an id marks them as no plain line.
MARKED = frozenset("blockquote p pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that tell an element that isn't the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side|aside|nav\w*|menu|breadcrumbs?|header|masthead|topbar|footer|foot|comments?|reply|replies|discussion|disqus|respond|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|tags|meta|byline|login|search|form|hidden|skip|copyright|contentinfo|navigation|complementary)(?:$|[\s_-])",
    re.I,
)
#: Inside main content a class or role takes an element out only where all parts of one of its names are words of these; ids, headings and paragraphs never do.
_BOX = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments share sharing social widget toolbar pagination footer form".split())
#: Words that may stand beside those in such a name; a notice alone is a box only where it recurs.
_BESIDE = frozenset("area bar block box button buttons container inline inner js left links list main notice notices outer panel post right section signup site slot thread top unit wrap wrapper".split())
_PART = re.compile(r"[\s_-]+")
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "title"}
_SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

#: A comment (its ends are as browsers see them), a declaration, or a tag with its attributes; a quote opens a value after = only, and one that never closes is a plain character.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "outside", "boxed", "parts", "digest", "size", "main", "first", "end", "unit")

    def __init__(self, tag: str, outside: int):
        self.tag, self.outside, self.boxed = tag, outside, False
        self.parts: list[str | Element] = []
        self.digest = self.size = self.first = self.end = 0
        self.main = tag in ("article", "main")
        self.unit = tag in UNITS


def _named_outside(tag: str, attributes: str) -> int:
    """2 for elements that never hold the article, 1 where only a name says so, 0 for others."""
    found = 0 if tag not in OUTSIDE else 1 if tag == "form" else 2
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return 2
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and _NAMES.search(value):
            found = found or 1
    return found


def _is_box(names: str) -> bool:
    """Whether one of the names, such as ``share-buttons``, is that of a box."""
    for name in names.lower().split():
        parts = [x for x in _PART.split(name) if x]
        if any(x in _BOX for x in parts) and all(x in _BOX or x in _BESIDE for x in parts):
            return True
    return False


def parse(page: str) -> Element:
    """The tree of a page; whatever isn't closed ends with the page.

    The stack of open elements is ``MOST_DEPTH`` deep and one more for an element that is left out;
    those beyond are counted by name only, so that an end tag costs the same however deep a page is.
    """
    root = Element("#root", False)
    stack, at, n = [root], 0, len(page)
    beyond: dict[str, int] = {}
    opened: dict[str, int] = {}

    def close(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        deep = len(stack) > MOST_DEPTH
        if deep and tag in BLOCK:
            stack[-1].parts.append(Element("hr", 0))
        if m[1]:  # an end tag closes the nearest open element of its name
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            if len(stack) <= MOST_DEPTH:
                beyond.clear()
            continue
        if tag in RAW and tag != "head":
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1) if opened.get("p") else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _SAME_LEVEL:
            for i in range(len(stack) - 1, 0, -1) if any(map(opened.get, _SAME_LEVEL[tag])) else ():
                if stack[i].tag in _SAME_LEVEL[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        e = Element(tag, _named_outside(tag, m[3] or ""))
        e.unit = e.unit or (tag in MARKED and any(a[1].lower() in ("class", "id") for a in _ATTRIBUTE.finditer(m[3] or "")))
        if e.outside == 1:
            boxes = (a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3] or "") if a[1].lower() in ("class", "role"))
            e.boxed = tag == "form" or (tag not in MARKED and tag not in HEADINGS and any(map(_is_box, boxes)))
        deep = len(stack) > MOST_DEPTH
        if not deep:
            stack[-1].parts.append(e)
        if tag in VOID:  # a slash at the end of a tag means nothing in HTML
            continue
        if not deep or (e.outside and len(stack) == MOST_DEPTH + 1):  # what is left out there takes its parts along
            stack.append(e)
            opened[tag] = opened.get(tag, 0) + 1
        else:
            beyond[tag] = 1 if tag == "p" or tag in _SAME_LEVEL else beyond.get(tag, 0) + 1
    return root


def _hash_subtrees(e: Element) -> bytes:
    """Bytes that stand for the subtree; sets the digest and the length of text of every element."""
    h, size = xxhash.xxh3_64(e.tag.encode()), 0
    for p in e.parts:
        if isinstance(p, str):
            text = _SPACE.sub(" ", p).strip()
            if text:
                h.update(b"\x01" + text.encode("utf-8", "replace"))
                size += len(text)
        else:
            h.update(b"\x02" + _hash_subtrees(p))
            size += p.size
    e.digest, e.size = h.intdigest(), size
    return h.digest() if size else b""


def read_page(page: str | None) -> tuple[Element, list[Element]]:
    """The hashed tree of a page and its main elements."""
    root = parse(page or "")
    _hash_subtrees(root)
    mains = _outermost_main(root)
    if mains:
        _spare_named(mains)
    else:
        _spare_holder(root)
    return root, mains


def _spare_named(mains: list[Element]) -> None:
    """Inside main content a name alone takes out boxes that are no part of an article, and nothing else."""
    work = list(mains)
    while work:
        for p in work.pop().parts:
            if isinstance(p, Element):
                if p.outside == 1 and not p.boxed:
                    p.outside = 0
                work.append(p)


def _spare_holder(root: Element) -> None:
    """On pages without a main element, no name removes the elements that hold the first h1 and most of the text."""
    path: list[Element] = []

    def find(e: Element) -> bool:
        path.append(e)
        if e.tag == "h1" or any(isinstance(p, Element) and p.outside < 2 and find(p) for p in e.parts):
            return True
        path.pop()
        return False

    if find(root):
        for e in path:
            if e.outside == 1 and e.size * 2 > root.size:
                e.outside = 0


def page_units(root: Element, mains: list[Element]) -> dict[int, int]:
    """hash -> key of the page without that subtree, for the subtrees that may be a template.

    The key sums the hashes of the remaining texts; those shorter than ``FEW`` or ``MINOR`` of the
    longest don't count, so that a date or a counter doesn't make a copied article another page.
    """
    sizes: list[int] = []
    hashes: list[int] = []
    units: list[Element] = []

    def walk(e: Element, unit: bool, inside: bool) -> None:
        if e.tag in RAW or e.tag == "title" or e.outside:
            return
        e.first = len(sizes)
        alone = not any(isinstance(p, str) and p.strip() for p in e.parts)
        for p in e.parts:
            if isinstance(p, str):
                text = _SPACE.sub(" ", p).strip()
                if text:
                    sizes.append(len(text))
                    hashes.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")))
            else:
                walk(p, p.unit if inside else alone or p.tag in BLOCK, inside)
        e.end = len(sizes)
        if unit and e.end > e.first and e.tag not in ("#root", "html", "body"):
            units.append(e)

    bounds = []
    for e in mains or [root]:
        at = len(units)
        walk(e, False, bool(mains))
        bounds.append((e, at, len(units)))
    if mains:
        kept = []
        for main, a, b in bounds:
            whole = sum(sizes[main.first : main.end])
            kept += [e for e in units[a:b] if sum(sizes[e.first : e.end]) * 2 <= whole]
        units = kept
    if not units:
        return {}
    longest = max(sizes)
    top = [i for i, n in enumerate(sizes) if n == longest]
    sums = [0]
    for n, h in zip(sizes, hashes, strict=True):
        sums.append(sums[-1] + (h if n >= max(FEW, longest * MINOR) else 0))
    out: dict[int, int] = {}
    for e in units:
        if e.first <= top[0] and top[-1] < e.end:  # the longest goes with the subtree
            rest = [*range(e.first), *range(e.end, len(sizes))]
            least = max(FEW, max((sizes[i] for i in rest), default=0) * MINOR)
            key = sum(hashes[i] for i in rest if sizes[i] >= least)
        else:
            key = sums[-1] - sums[e.end] + sums[e.first]
        out.setdefault(e.digest, key & 0xFFFFFFFFFFFFFFFF)
    return out


def blocks_of(root: Element, mains: list[Element], template: frozenset[int] | set[int]) -> list[str]:
    """Blocks of the main text in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    def walk(e: Element, inside: bool, unit: bool, known: frozenset[int] | set[int]) -> None:
        if e.tag in RAW or e.tag == "title":
            return
        if e.outside:
            if inside and e.tag == "header":  # an article's own heading stays
                for p in e.parts:
                    if isinstance(p, Element) and p.tag in HEADINGS:
                        walk(p, inside, False, known)
            return
        if unit and e.digest in known:
            return
        block = e.tag in BLOCK
        if block:
            flush()
        elif e.tag == "br":
            now.append(" ")
        alone = not any(isinstance(p, str) and p.strip() for p in e.parts)
        for p in e.parts:
            if isinstance(p, str):
                now.append(p)
            else:
                walk(p, inside, p.unit if inside else alone or p.tag in BLOCK, known)
        if block:
            flush()

    for e in mains or [root]:
        walk(e, bool(mains), False, _harmless(e, template) if mains else template)
        flush()
    return out


def _harmless(main: Element, template: frozenset[int] | set[int]) -> frozenset[int] | set[int]:
    """The template, or nothing where it would take most of a main element: that is an edited copy, not an article with boxes."""
    taken = whole = 0

    def walk(e: Element, gone: bool, unit: bool) -> None:
        nonlocal taken, whole
        if e.tag in RAW or e.tag == "title" or e.outside:
            return
        gone = gone or (unit and e.digest in template)
        for p in e.parts:
            if isinstance(p, str):
                n = len(_SPACE.sub(" ", p).strip())
                whole += n
                taken += n if gone else 0
            else:
                walk(p, gone, p.unit)

    if template:
        walk(main, False, False)
    return template if taken * 2 <= whole else frozenset()


def _outermost_main(root: Element) -> list[Element]:
    """The articles of a page, or its main elements where no article stands in one.

    Those in elements that a name leaves out count where the page has no others, or where they
    hold more text than its main elements do.
    """

    def search(tag: str, most: int) -> list[Element]:
        found: list[Element] = []

        def walk(e: Element) -> None:
            for p in e.parts:
                if isinstance(p, Element) and p.outside <= most:
                    if p.tag == tag:
                        found.append(p)
                    else:
                        walk(p)

        walk(root)
        return found

    def text(e: Element) -> int:
        return e.size - sum(_left_out(p) for p in e.parts if isinstance(p, Element))

    def _left_out(e: Element) -> int:
        return e.size if e.outside else sum(_left_out(p) for p in e.parts if isinstance(p, Element))

    if found := search("article", 0):
        return found
    mains, named = search("main", 0), search("article", 1)
    if sum(map(text, named)) > sum(map(text, mains)):
        return named
    return mains or search("main", 1)


def page_hashes(pages: DataFrame) -> DataFrame:
    """host, hash, page (by its text without the subtree) and doc (the page's own hash) for the subtrees of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, docs, hashes, keys = [], [], [], []
            for host, doc, page in zip(b.column("host").to_pylist(), b.column("doc").to_pylist(), b.column("html"), strict=True):
                for h, key in page_units(*read_page(page.as_py())).items():
                    hosts.append(host)
                    docs.append(doc)
                    hashes.append(h)
                    keys.append(key)
            signed = [pa.array(x, pa.uint64()).view(pa.int64()) for x in (hashes, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *signed, pa.array(docs, pa.int64())], ["host", "hash", "page", "doc"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("doc"), "html")
    return map_arrow(rows, run, "host string, hash long, page long, doc long")


def templates(seen: DataFrame, many: int = MANY) -> DataFrame:
    """host and hash of the subtrees that stand on ``many`` different pages of their host, from ``page_hashes``."""
    return seen.select("host", "hash", "page").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= many).select("host", "hash")


def extract(pages: DataFrame, many: int = MANY, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    seen = saved(page_hashes(pages))
    known = saved(templates(seen, many))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("doc"))
    if known.count() <= most_sent:
        rows = rows.join(F.broadcast(known.groupBy("host").agg(F.collect_set("hash").alias("template"))), "host", "left")
    else:  # a page has few of its host's templates
        rows = rows.join(seen.join(known, ["host", "hash"]).groupBy("host", "doc").agg(F.collect_set("hash").alias("template")), ["host", "doc"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, template in zip(b.column("html"), b.column("template"), strict=True):
                known = {h & 0xFFFFFFFFFFFFFFFF for h in template.as_py() or ()}
                texts.append("\n\n".join(blocks_of(*read_page(page.as_py()), known)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(rows.select("page_id", "url", "html", "template"), run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
