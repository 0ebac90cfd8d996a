"""Main text of HTML pages by composite text density (operator 1).

Each page is parsed into a DOM of all its elements in an Arrow task. For every node the link-adjusted characters per tag

    d = C/T * log(C/LC * T/LT) / log(ln(C/NC * LC + LCb/Cb * C + e))

is computed (C, T characters and tags, LC, LT those of links, at least 1, NC characters outside of links, b the body; the second logarithm's
argument is e at least). The node with the largest sum of its children's densities is the content (characters directly in a node count as a child of
one tag); if that is a paragraph or inline markup, the element around it. The smallest density on its path from the body is the
threshold that further subtrees beside the path must reach; blocks of prose there (paragraphs, headings, lists, tables that aren't mostly links) and
articles need not.

Parts that a page marks as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments of readers are left out of all this. Elements and roles decide alone; words of class names and ids are weighed. Words that only hint (widget, related): where a
tenth of the page's text or less lies outside of such parts, they are let in, and only those that don't hold the content go. Words that name such a part (notice, comments): they are
let in likewise where besides there is no block of running text outside of them, so an article isn't lost to its wrapper's name, nor given up for its comments. A marked part ends
where its element does: at its end tag, where HTML implies
the end, or at its parent's end tag. One that has no end tag at all also ends where a new section begins (an inline one or
a form control: where any block begins).
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements whose content is text up to their end tag (or up to the page's end), whatever it looks like
RAW_TEXT = frozenset("script style textarea title xmp".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW_TEXT}
SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])[^>]*>", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# menus, headers, footers, sidebars, forms and their controls, scripts (with what stands in for them) and styles; a header is one outside of articles
SKIP = frozenset("head title nav menu footer aside form fieldset input textarea select button script noscript template style".split())
# written as <.../> they have no content, though HTML asks for an end tag
EMPTY = frozenset("script style textarea title iframe xmp noembed noframes svg math canvas object select button noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROWS = frozenset("tr td th".split())
GROUPS = frozenset("thead tbody tfoot".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": ROWS, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | dict.fromkeys(GROUPS, ROWS | GROUPS)
# li, dt and dd don't end across a block other than address, div and p
ITEMS = CLOSES_P - {"address", "div", "p"} | {"td", "th", "button", "object", "select", "template", "noscript"}
SCOPE = {"li": ITEMS, "dt": ITEMS, "dd": ITEMS, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}} | dict.fromkeys(GROUPS, {"table"})
END_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"button", "table", "td", "th", "object"}} | dict.fromkeys(ROWS | GROUPS, {"table"})
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
# what ends a dropped element that has no end tag
SECTION = frozenset("article aside footer h1 header main nav section".split())
BLOCK_START = CLOSES_P | SECTION | GROUPS | ROWS | {"li", "dt", "dd"}
CONTROLS = frozenset("button select noscript object canvas svg math audio video iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# words of class names and ids that name what isn't the article
MARKS = re.compile(
    r"^(ad|ads|adv|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|sidebar|side-bar|menu|nav|navbar|navigation|topbar|"
    r"breadcrumbs?|footer|site-?header|page-?header|masthead|comments?|comment-?list|comments-area|replies|disqus\w*|respond|"
    r"(ad|ads|comments?|cookies?|sidebar|menu|nav)-(\d+|area|author|banner|bar|block|body|bottom|box|consent|container|content|count|footer|form|header|inner|items?|left|links?|list|main|menu|meta|notice|outer|"
    r"popup|primary|reply|right|secondary|section|side|slot|text|thread|toggle|top|unit|widget|wrap|wrapper))$"
)
# those that hint at it
HINTS = re.compile(r"^(promo\w*|banner|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|toolbar)$")
KEEP = frozenset("html body main article".split())
# what stays beside the content unless it is mostly links
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure details".split())
# what isn't a whole content by itself
PART = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption".split())
HINT, WORD, MARK = 1, 2, 3
#: characters of a block of running text
RUNNING = 80


def _boilerplate(tag: str, attrs: str) -> int:
    """MARK, WORD, HINT or 0, by the attributes."""
    if tag in KEEP or not attrs:
        return 0
    found = 0
    for name, a, b, c in ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return MARK
        if name == "style" and "display:none" in value.replace(" ", ""):
            return MARK
        if name in ("class", "id"):
            for w in value.replace("_", "-").split():
                if MARKS.match(w):
                    found = WORD
                elif HINTS.match(w):
                    found = max(found, HINT)
    return found


def _raw_end(page: str, tag: str, at: int) -> tuple[int, int]:
    """Where a raw text element's content and its end tag end."""
    if tag != "script":
        m = RAW_END[tag].search(page, at)
        return (m.start(), m.end()) if m else (len(page), len(page))
    escaped = 0  # 1: after <!--, 2: in a script named there
    for m in SCRIPT.finditer(page, at):
        if m[1] is None:
            escaped = max(1, escaped) if m[0] == "<!--" else 0
        elif m[1] and escaped < 2:
            return m.start(), m.end()
        elif escaped:
            escaped = 1 if m[1] else 2
    return len(page), len(page)


def _tokens(page: str) -> tuple[list[tuple[int, int, str, str, str]], set[int]]:
    """Tags and comments as (position, end, / of an end tag, name, attributes), and which start tags have an end tag of their own."""
    out: list[tuple[int, int, str, str, str]] = []
    ended: set[int] = set()
    opened: dict[str, list[int]] = {}
    at = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if close:
            if opened.get(tag):
                ended.add(opened[tag].pop())
        elif tag in RAW_TEXT and not attrs.endswith("/"):
            stop, at = _raw_end(page, tag, at)
            if tag not in SKIP:  # its text is shown as it is written
                out += [(m.start(), m.end(), "", tag, attrs), (stop, at, "/", tag, "")]
                continue
        elif tag and tag not in VOID:
            opened.setdefault(tag, []).append(len(out))
        out.append((m.start(), at, close or "", tag, attrs or ""))
    out.append((len(page), len(page), "", "", ""))
    return out, ended


def extract(page: str) -> str:
    """The main text: blocks joined by an empty line, white space within a block as one space."""
    tags, parents, marks, runs = ["html"], [-1], [0], []  # runs: (node, text, in a link, break number)
    stack, names = [0], ["html"]
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack elements of a name are open
    boxes = [0]  # and where elements that aren't inline are
    in_link, block_no, at = 0, 0, 0
    dropped, has_end = 0, False  # where on the stack a marked subtree begins, and whether that element has an end tag

    def pop_to(i: int) -> None:
        nonlocal in_link, block_no, dropped
        for tag in names[i:]:
            places[tag].pop()
            if tag not in INLINE:
                boxes.pop()
            if tag == "a":
                in_link -= 1
            elif tag not in INLINE:
                block_no += 1
        del stack[i:], names[i:]
        if i <= dropped:
            dropped = 0

    def push(tag: str, mark: int) -> None:
        tags.append(tag)
        parents.append(stack[-1])
        marks.append(mark)
        places[tag].append(len(names))
        if tag not in INLINE:
            boxes.append(len(names))
        stack.append(len(tags) - 1)
        names.append(tag)

    def last(kinds: Iterable[str]) -> int:
        """Where the innermost open element of these names is; 0 for none."""
        return max((places[t][-1] for t in kinds if places[t]), default=0)

    tokens, ended = _tokens(page)
    for number, (start, end, close, tag, attrs) in enumerate(tokens):
        if start > at:
            text = page[at:start]
            if names[-1] == "head" and not text.isspace():
                pop_to(len(names) - 1)
            runs.append((stack[-1], htmllib.unescape(text) if "&" in text and names[-1] not in RAW_TEXT else text, in_link > 0, block_no))
        at = end
        if not tag:
            continue
        if close:
            if tag in VOID:
                if tag == "br":
                    runs.append((stack[-1], " ", False, block_no))
                continue
            # an inline end tag doesn't close blocks
            if places[tag] and (i := places[tag][-1]) > last(END_SCOPE.get(tag, ())) and not (tag in INLINE and boxes[-1] > i):
                pop_to(i)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not places["body"]:
                if dropped:
                    pop_to(dropped)
                push("body", 0)
            continue
        if names[-1] == "head" and tag not in IN_HEAD:
            pop_to(len(names) - 1)
        if dropped and not has_end:
            root = names[dropped]
            inline = root in INLINE or root in CONTROLS
            if root != "head" and (tag in SECTION or inline and (tag in BLOCK_START or tag == root)):
                pop_to(dropped)
        if tag == "br":
            runs.append((stack[-1], " ", False, block_no))
            continue
        if tag in CLOSES_P and places["p"] and (i := places["p"][-1]) > last(END_SCOPE["p"]):
            pop_to(i)
        if tag in SAME:
            stop = last(SCOPE[tag])
            like = [x[bisect_right(x, stop)] for x in (places[t] for t in SAME[tag]) if x and x[-1] > stop]
            if like:
                pop_to(min(like))
        if tag in VOID or tag in RAW_TEXT and tag in SKIP or attrs.endswith("/") and (tag in EMPTY or places["svg"] or places["math"]):
            if tag not in INLINE:
                block_no += 1
            continue
        mark = MARK if tag in SKIP or tag == "header" and not (places["article"] or places["main"]) else _boilerplate(tag, attrs)
        if mark and not dropped:
            dropped, has_end = len(names), number in ended
        if tag == "a":
            in_link += 1
        block_no += tag not in INLINE
        push(tag, mark)
    return _select(tags, parents, marks, runs)


def densities(tags: list[str], parents: list[int], left_out: list[bool], runs: list[tuple[int, str, bool, int]]) -> tuple[list[float], list[float], list[int], list[int]]:
    """(density, sum of the children's densities, characters, characters in links) of every node, without the nodes left out."""
    k = len(tags)
    chars, lchars, own = [0] * k, [0] * k, [0] * k
    count = [0 if out else 1 for out in left_out]
    lcount = [int(t == "a" and not out) for t, out in zip(tags, left_out)]
    for node, text, linked, _ in runs:
        if not left_out[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if linked:
                lchars[node] += size
            else:
                own[node] += size
    for i in range(k - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        lchars[p] += lchars[i]
        count[p] += count[i]
        lcount[p] += lcount[i]
    body = tags.index("body") if "body" in tags else 0
    ratio = lchars[body] / max(1, chars[body])

    def density(c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + ratio * c + math.e))
        return c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / math.log(base)

    dense = [density(*x) for x in zip(chars, lchars, count, lcount)]
    total = [density(n, 0, 1, 0) for n in own]
    for i in range(1, k):
        total[parents[i]] += dense[i]
    return dense, total, chars, lchars


def _select(tags: list[str], parents: list[int], marks: list[int], runs: list[tuple[int, str, bool, int]]) -> str:
    k = len(tags)
    level = list(marks)  # with what is above
    for i in range(1, k):
        level[i] = max(level[i], level[parents[i]])
    sizes = [0, 0, 0, 0]
    running: dict[int, int] = defaultdict(int)  # characters of blocks outside of links and of named parts
    for node, text, linked, number in runs:
        n = len("".join(text.split()))
        sizes[level[node]] += n
        if level[node] < WORD and not linked:
            running[number] += n
    seen = sum(sizes[:MARK])
    if not seen:
        return ""
    most = 0 if sizes[0] * 10 >= seen - sizes[WORD] and sizes[0] else HINT
    if (sizes[0] + sizes[HINT]) * 10 < seen and max(running.values(), default=0) < RUNNING:
        most = WORD
    dense, total, chars, lchars = densities(tags, parents, [x > most for x in level], runs)
    best = max(range(k), key=lambda i: (total[i], -i))
    path = [best]
    while parents[path[-1]] >= 0 and tags[path[-1]] != "body":
        path.append(parents[path[-1]])
    threshold = min(dense[i] for i in path)
    while len(path) > 1 and (tags[path[0]] in PART or tags[path[0]] in INLINE):
        path.pop(0)
    on_path = set(path)

    def beside(i: int) -> bool:
        if tags[i] in PROSE and 2 * lchars[i] <= chars[i] or tags[i] == "article":
            return True
        return dense[i] >= threshold and dense[i] > 0

    inside, out = [False] * k, [False] * k
    for i in range(k):
        p = parents[i]
        out[i] = p >= 0 and out[p] or marks[i] > most or marks[i] > 0 and i not in on_path
        inside[i] = i == path[0] or p >= 0 and (inside[p] or p in on_path and i not in on_path and beside(i))
    own = [0] * k  # text directly in the elements around the content
    for node, text, linked, _ in runs:
        if node in on_path and not inside[node] and not linked:
            own[node] += len("".join(text.split()))
    blocks: list[str] = []
    last, held = None, []
    for node, text, _, number in runs:
        if out[node] or not inside[node] and not (own[node] and own[node] * math.log(max(1, own[node])) >= threshold):
            continue
        if number != last and held:
            blocks.append(" ".join("".join(held).split()))
            held = []
        last = number
        held.append(text)
    blocks.append(" ".join("".join(held).split()))
    return "\n\n".join(b for b in blocks if b)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2)
        for s in range(0, len(pages), 200):
            texts = [extract(p) if p else "" for p in pages.slice(s, 200).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, 200), batch.column(1).slice(s, 200), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars (code points), a row for each row.

    A null or empty html, or one without text, gives an empty text. Null ids and addresses are passed on; repeated rows
    are each extracted; other columns don't matter.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
