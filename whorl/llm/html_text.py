"""Main text of web pages by tree scoring.

The page becomes a tree of elements (unclosed tags are closed as browsers do).
Boilerplate subtrees are set aside: by tag (navigation, forms, scripts, ...),
by role or hidden state, and by class names and ids: a name that is a
boilerplate word, one that begins or ends with such a word, and one with a word
for reader comments anywhere, unless it only says what a layout has or lacks. A
name that is no such word itself does not count where it holds most of the
page's text, nor does any where it holds an article with a fair part of it; a form with
most of the text or with an article is a container like others. If all text
went that way, names and then forms are not judged at all. Of a header inside
an article the headings stay. Paragraph-like blocks then pass points to their
parent, and half of them to the grandparent: one point, one for each comma and
one for each 100 characters up to three. A container's points are multiplied by
one minus its link density. The best container is kept with those siblings
that score a fifth of it or that are long paragraphs with few links.

Inside the kept nodes, every block is written with its white space joined to
one space, and blocks are joined by one space in page order.

Pages are scanned in time linear in their length, whatever their markup.

Defined results: null, empty and text-free pages give an empty text; tags
without an end run to the end of their container; a comment or tag that never
ends takes the rest of the page, as in browsers; marked sections and other
declarations are skipped; very deep trees are walked without recursion; long
pages are read whole; an empty table gives no rows; repeated rows are extracted row by row; other columns are
dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and common class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template nav header footer aside form button select option textarea input label fieldset iframe embed svg canvas head title menu dialog audio video map datalist output progress meter".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
UNWANTED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead comment comments commentlist disqus replies respond discussion reactions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommend recommended recommendations widget toolbar pagination pager tags legal copyright disclaimer skip search".split())
COMMENTS = frozenset("comment comments commentlist commenting disqus replies respond discussion discussions reactions".split())
LAYOUT = frozenset("has no with without free hide show layout is not enable enabled disabled open closed off".split())
#: Tags whose text never counts as text of the page.
SILENT = frozenset("script style noscript template head title iframe svg canvas select option textarea button".split())
#: Share of the page's text from which a container is not judged by a compound name, and by any name if it holds an article.
MOST, FAIR = 0.5, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "holds", "kids", "out", "parent", "points", "share", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.points, self.holds = tag, attrs, parent, [], 0.0, False
        self.out, self.share = False, 0.0


# Linear scanning: every pattern is possessive or ends at one character.
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTR = re.compile(r"""[\s/]*+(?:(>)|(\Z)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}


def _tag(html: str, at: int) -> tuple[str, dict, int]:
    """Name, attributes and end of the tag whose name starts at ``at``."""
    name = _NAME.match(html, at)
    attrs: dict = {}
    at = name.end()
    while m := _ATTR.match(html, at):
        at = m.end()
        if m[1] or m[2] is not None:
            break
        attrs.setdefault(m[3].lower(), unescape(m[4] or m[5] or m[6] or ""))
    return name[0].lower(), attrs, at


def tokens(html: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, value, attributes): kind is ``start``, ``end`` or ``text``; comments and declarations are left out."""
    at = 0
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            yield "text", unescape(html[at:]), {}
            return
        if mark > at:
            yield "text", unescape(html[at:mark]), {}
        after = html[mark + 1 : mark + 2]
        if after.isascii() and after.isalpha():
            name, attrs, at = _tag(html, mark + 1)
            yield "start", name, attrs
            if name in _RAW:
                end = _RAW[name].search(html, at)
                if end is None:
                    return
                yield "text", html[at : end.start()], {}
                at = end.start()
        elif after == "/" and html[mark + 2 : mark + 3].isascii() and html[mark + 2 : mark + 3].isalpha():
            name, _, at = _tag(html, mark + 2)
            yield "end", name, {}
        elif html.startswith("<!--", mark):
            if html.startswith((">", "->"), mark + 4):
                at = html.index(">", mark + 4) + 1
            else:
                ends = [e + n for e, n in ((html.find("-->", mark + 4), 3), (html.find("--!>", mark + 4), 4)) if e >= 0]
                at = min(ends, default=len(html))
        elif after in ("!", "?", "/"):
            at = html.find(">", mark) + 1 or len(html)
        else:
            yield "text", "<", {}
            at = mark + 1


class Tree:
    """Builds the tree; data are strings among a node's kids.

    ``depths`` holds the open elements of each name, so the nearest one is
    found without walking up.
    """

    # Open elements that a new one ends, up to the nearest container.
    ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
    SCOPE = frozenset("html body table td th article section div main aside header footer nav form ul ol li dl blockquote".split())

    def __init__(self, html: str):
        self.root = Node("html", {}, None)
        self.path, self.depths = [self.root], {}
        for kind, value, attrs in tokens(html):
            if kind == "text":
                self.path[-1].kids.append(value)
            elif kind == "start":
                self._start(value, attrs)
            else:
                # Inline elements stay inside the block that holds them.
                self._leave(self._nearest({value}, () if value in BLOCKS or value in DROPPED else self.SCOPE | {"p"}))

    def _leave(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on; 0 closes none."""
        while 0 < depth < len(self.path):
            self.depths[self.path.pop().tag].pop()

    def _nearest(self, tags, stop=()) -> int:
        """Depth of the nearest open element among ``tags``, 0 if there is none inside the nearest of ``stop``."""
        last = lambda names: max((self.depths[t][-1] for t in names if self.depths.get(t)), default=0)
        found = last(tags)
        return found if found and found >= last(stop) else 0

    def _start(self, tag: str, attrs: dict) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._leave(self._nearest({"p"}, self.SCOPE))
        if tag in self.ENDS:
            self._leave(self._nearest(*self.ENDS[tag]))
        if self.depths.get("head") and tag not in DROPPED and tag not in ("meta", "link", "base"):
            self._leave(self._nearest({"head"}))
        node = Node(tag, attrs, self.path[-1])
        self.path[-1].kids.append(node)
        if tag in ("article", "main") and _named(node) != "comments":
            for above in reversed(self.path):
                if above.holds:
                    break
                above.holds = True
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.path))
            self.path.append(node)


_PART = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


def _named(node: Node) -> str:
    """How a class or the id names boilerplate: ``comments``, ``whole``, ``compound`` or not at all."""
    found = ""
    for key in ("class", "id"):
        for name in node.attrs.get(key, "").split():
            parts = [p.lower() for p in _PART.split(name) if p and not p.isdigit()]
            if not parts:
                continue
            if not LAYOUT.intersection(parts) and COMMENTS.intersection(parts):
                return "comments"
            if len(parts) == 1 and parts[0] in UNWANTED:
                found = "whole"
            elif not found and (parts[0] in UNWANTED or parts[-1] in UNWANTED):
                found = "compound"
    return found


def _hidden(node: Node) -> bool:
    a = node.attrs
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or ("style" in a and HIDDEN.search(a["style"]) is not None)


def _every(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """All nodes in page order; True on leaving a node."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving and isinstance(node, Node):
            stack.append((node, True))
            stack += [(kid, False) for kid in reversed(node.kids)]


def measure(root: Node) -> None:
    """Sets the share of each node in the page's visible text outside links and reader comments."""
    counts, open_, quiet = {root: 0}, [], 0
    silent = lambda n: n.tag in SILENT or n.tag in ("a", "nav", "footer") or _hidden(n) or _named(n) == "comments"
    for node, leaving in _every(root):
        if isinstance(node, str):
            counts[open_[-1]] += 0 if quiet else len(node.strip())
        elif leaving:
            open_.pop()
            quiet -= silent(node)
            if open_:
                counts[open_[-1]] += counts[node]
        else:
            open_.append(node)
            quiet += silent(node)
            counts[node] = 0
    for node, n in counts.items():
        node.share = n / max(1, counts[root])


def mark(root: Node, level: int = 0) -> None:
    """Sets ``out`` of every node: what is boilerplate. From level 1 on compound names, from 2 on all names, at 3 forms do not count."""
    for node, leaving in _every(root):
        if not leaving and isinstance(node, Node):
            node.out = _out(node, level)


def _out(node: Node, level: int) -> bool:
    """Boilerplate by tag, role, hidden state and by class and id; of a header in an article the headings stay."""
    up = node.parent
    if up is None:
        return False
    if up.tag == "header" and node.tag not in HEADINGS:
        return True
    header = node.tag == "header" and up.tag in ("article", "main")
    form = node.tag == "form" or node.attrs.get("role", "").lower() == "form"
    wide = form and (node.share >= MOST or node.holds or level > 2)
    if (node.tag in DROPPED or node.attrs.get("role", "").lower() in ROLES) and not header and not wide or _hidden(node):
        return True
    named = _named(node)
    if node.tag in ("article", "main", "p") or header:
        return named == "comments" and node.tag == "article" and level < 2
    if not named or level > 1 or (node.holds and node.share >= FAIR):
        return False
    return named != "compound" or (level < 1 and node.share < MOST)


def walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes in page order without unwanted subtrees; True on leaving a node."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving and isinstance(node, Node):
            stack.append((node, True))
            loose = node.tag == "header"  # text beside an article's headings
            stack += [(kid, False) for kid in reversed(node.kids) if (not loose if isinstance(kid, str) else not kid.out)]


def _sizes(root: Node) -> tuple[dict, dict, dict]:
    """Characters, commas and linked characters below each node."""
    chars: dict = {}
    commas: dict = {}
    linked: dict = {}
    links = 0
    stack = []
    for node, leaving in walk(root):
        if isinstance(node, str):
            n = len(_SPACE.sub(" ", node).strip())
            top = stack[-1]
            chars[top] += n
            commas[top] += node.count(",") + node.count("،") + node.count("、") + node.count("，")
            linked[top] += n if links else 0
        elif leaving:
            stack.pop()
            links -= node.tag == "a"
            if stack:
                for count in (chars, commas, linked):
                    count[stack[-1]] += count[node]
        else:
            stack.append(node)
            links += node.tag == "a"
            chars[node] = commas[node] = linked[node] = 0
    return chars, commas, linked


def _score(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it."""
    chars, commas, linked = _sizes(root)
    density = lambda n: linked[n] / max(1, chars[n])
    scored: list[Node] = []
    for node, leaving in walk(root):
        if leaving or isinstance(node, str) or node.parent is None or not chars[node]:
            continue
        leaf = node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
        if not leaf and not (node.tag in ("div", "section", "td", "blockquote", "li", "dd") and not any(isinstance(k, Node) and k.tag in BLOCKS - {"br"} for k in node.kids)):
            continue
        points = (1 + commas[node] + min(3, chars[node] // 100)) * (1 - density(node))
        for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
            if up is not None:
                if not up.points:
                    scored.append(up)
                up.points += points * share
    if not scored:
        return [root] if chars[root] else []
    value = lambda n: n.points * (1 - density(n))
    best = max(scored, key=value)
    # Lists and parts of an article belong to the article around them.
    up = best
    while up.parent is not None:
        up = up.parent
        if up.tag in ("article", "main") and chars[up] and density(up) < 0.5:
            best = up
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * value(best))
    kept = []
    for kid in best.parent.kids:
        if isinstance(kid, Node) and not kid.out:
            long = kid.tag == "p" and (chars[kid] > 80 and density(kid) < 0.25)
            if kid is best or value(kid) >= least or long:
                kept.append(kid)
    return kept


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = Tree(html).root
    measure(root)
    for level in range(4):
        mark(root, level)
        if text := _text(root):
            return text
        for node, leaving in _every(root):
            if leaving:
                node.points = 0.0
    return ""


def _text(root: Node) -> str:
    blocks, now = [], []

    def end() -> None:
        if line := _SPACE.sub(" ", "".join(now)).strip():
            blocks.append(line)
        now.clear()

    for top in _score(root):
        for node, _ in walk(top):
            if isinstance(node, str):
                now.append(node)
            elif node.tag in BLOCKS:
                end()
        end()
    return " ".join(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of every row."""
    out = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h.as_py()).encode("utf-8", "replace").decode() for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string())], schema=out)

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found = source.mapInArrow(run, "id bigint, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
