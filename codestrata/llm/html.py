"""Layout-aware rendering of HTML: a tree builder with implied tags, visibility rules, and block, list and table layout.

``parse`` builds a tree from a single forward pass over tags, which never looks at a stretch twice: void elements, implied end tags (p, li, dt/dd, tr, td/th, option, sections of a
table), raw text elements (script, style, ...), end tags that match no open element (ignored) and elements left open (closed at the
end). ``settle`` takes out of the tree what is not seen: head matter, scripts, templates, fallback content of media, elements that are not displayed
(by the ``hidden`` and ``popover`` attributes, dialogs that are not open, inline style, and rules of style elements for one tag, class, id, or tag
with class or id; the winner is found by importance, specificity and order), the body of details that are not open, and the text of hidden
elements. ``visibility`` is inherited, so a visible element below a hidden one is shown, and a hidden cell keeps its column. Other selectors,
linked sheets and sheets for other media than the screen are not regarded (aria-hidden hides from screen readers only, so such elements stay; the
copies of formulas that KaTeX and MathJax add for screen readers go). ``render`` emits all text that is left: formulas give their symbols without
annotations, drawings their text elements, text areas their lines, fields and buttons their value, selections the chosen option, list boxes all
options; blocks stand on their own lines, paragraphs and headings get a blank line, list items a bullet or number with
indentation by depth, table rows one line with cells aligned in columns (spans over columns and rows included), ``pre`` its own white space, images
their alternative text.

Edge cases: null gives null, an empty page or one without visible text gives ''; malformed markup never fails: a tag that never ends is text, a
quote that never ends goes up to the tag's first ``>``; nesting is held in an explicit stack, so depth is bounded by memory alone, and time is
linear in the page whatever its markup and style sheets; a broken style rule is skipped; indentation stops growing at INDENTS levels, alignment to row spans at OPEN_SPANS open ones; repeated rows
each get their text; a column of the output's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from html import unescape
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist meta link base annotation annotation-xml mphantom mjx-assistive-mml".split())
#: Classes of copies of formulas that their own style sheets hide from view.
UNSEEN_CLASSES = frozenset(("katex-mathml", "MJX_Assistive_MathML"))
BLOCK = frozenset("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split())
#: Parts of a formula that stand apart without white space between them.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot msqrt mmultiscripts mtable mtr mlabeledtr mtd".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: An opening tag closes these open elements, up to the nearest of the listed bounds.
IMPLIED = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "caption", "legend", "summary", "figcaption"} | {"li", "dt", "dd"}
#: Elements past which an implied end tag or a stray end tag does not look.
SCOPE = frozenset("html table td th caption template button object".split())

TABLE_DEPTH, INDENTS, OPEN_SPANS = 30, 50, 200

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s=/>]*)(?:\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_NO_ATTRIBUTES: dict[str, str] = {}
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?([.#][\w-]+)?", re.I)
#: Weights of selectors by what they name; inline style comes above all, and what is important above all that is not.
BY_TAG, BY_CLASS, BY_ID, INLINE, IMPORTANT = 1, 10, 100, 1000, 10000
#: Kinds of input whose value is not seen as text.
UNSEEN_INPUTS = frozenset("hidden password checkbox radio file color range image".split())
SCREEN = frozenset(("", "all", "screen", "only screen"))
CELLS = frozenset(("td", "th"))
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Scanner:
    """Tags of a page, from left to right; knows where the last ``>`` and quotes are, so it never searches for what does not follow."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """(name, attributes, whether it closes itself, end) of the tag whose name starts at ``at``; None if it never ends."""
        html = self.html
        if at > self.last[">"]:
            return None
        name = _NAME.match(html, at)
        at, attributes, slash = name.end(), _NO_ATTRIBUTES, False
        while True:
            gap = _GAP.match(html, at).end()
            slash, at = gap > at and html[gap - 1] == "/", gap
            if html[at : at + 1] == ">":
                return name[0].lower(), attributes, slash, at + 1
            if at > self.last[">"]:
                return None
            m = _ATTRIBUTE.match(html, at)
            at, value = m.end(), ""
            if at > m.end(1):
                quote = html[at : at + 1]
                if quote in ('"', "'") and at < self.last[quote]:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    end = _BARE.match(html, at).end()
                    value, at = html[at:end].lstrip("\"'"), end
            if attributes is _NO_ATTRIBUTES:
                attributes = {}
            attributes.setdefault(m[1].lower(), unescape(value))


class Stack:
    """Open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]

    def top(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element among ``tags``, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Ends the outermost open element among ``tags`` that no element of ``bounds`` shields."""
        if not any(self.places.get(t) for t in tags):
            return
        shield = self.top(bounds)
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, shield)) < len(p)]
        if found:
            self.cut(min(found))


_FOR_P = frozenset(("p",))
_UNSHIELDED = frozenset("table tr tbody thead tfoot html body template".split())
_SHIELDS = SCOPE - {"html"}


def parse(html: str) -> Node:
    """The tree of a page, from which what is not seen has been taken."""
    root, sheets = Node("#root", {}), []
    scanner, stack, at, n = Scanner(html), Stack(root), 0, len(html)
    text_from = 0
    while True:
        at = html.find("<", at)
        at = n if at < 0 else at
        mark = html[at : at + 2]
        plain = at < n and not (len(mark) == 2 and (mark[1] in "!?" or mark[1] == "/" and html[at + 2 : at + 3].isalpha() and html[at + 2].isascii() or mark[1].isalpha() and mark[1].isascii()))
        if plain:
            at += 1
            continue
        if at < n and mark[1] not in "!?" and (found := scanner.tag(at + 1 + (mark[1] == "/"))) is None:
            at = n  # no tag ends any more, so the rest is text
        if at > text_from:
            stack.nodes[-1].children.append(unescape(html[text_from:at]))
        if at >= n:
            settle(root, Rules(sheets))
            return root
        if mark[1] in "!?":
            if html.startswith("<!--", at):
                end, skip = html.find("-->", at + 4), 3
                # An empty comment may be closed in a shorter way.
                end, skip = (at + 4, 1) if html.startswith("<!-->", at) else (end, skip)
            elif html.startswith("<![CDATA[", at):
                end, skip = html.find("]]>", at + 9), 3
                stack.nodes[-1].children.append(html[at + 9 : end if end >= 0 else n])
            else:
                end, skip = html.find(">", at), 1
            at = text_from = n if end < 0 else end + skip
            continue
        tag, attributes, slash, at = found
        text_from = at
        if mark[1] == "/":
            if places := stack.places.get(tag):
                if tag in _UNSHIELDED or places[-1] >= stack.top(_SHIELDS):
                    stack.cut(places[-1])
            continue
        if tag in CLOSES_P:
            stack.close(_FOR_P, SCOPE)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag == "select" and stack.places.get("select"):
            stack.cut(stack.places["select"][-1])  # selections do not nest: the tag ends the open one
            continue
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in VOID or slash and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            inner = html[at : end.start() if end else n]
            node.children.append(unescape(inner) if tag == "textarea" else inner)
            if tag == "style" and attributes.get("media", "").strip().lower() in SCREEN:
                sheets.append(inner)
            at = text_from = end.end() if end else n
            continue
        stack.push(node)


class Rules:
    """What style sheets say of display and visibility, by simple selectors."""

    def __init__(self, sheets: list[str]):
        #: (tag or '', '.class', '#id' or '') to the winning (weight, number of the rule, value) of each property.
        self.of: dict[tuple[str, str], dict[str, tuple[int, int, str]]] = {}
        self.rules = 0
        for sheet in sheets:
            self._read(sheet)

    def _read(self, sheet: str) -> None:
        parts, at = [], 0
        while (start := sheet.find("/*", at)) >= 0:
            parts.append(sheet[at:start])
            end = sheet.find("*/", start + 2)
            at = len(sheet) if end < 0 else end + 2
        sheet = " ".join([*parts, sheet[at:]]).replace("<!--", " ").replace("-->", " ")
        at = skipped = 0  # skipped: open groups (@media and the like) from the first that does not count
        for m in re.finditer(r"[{}]", sheet):
            if m.start() < at:
                continue
            head, at = sheet[at : m.start()].rpartition(";")[2].strip(), m.end()
            if m[0] == "}":
                skipped = max(0, skipped - 1)
            elif head.startswith("@") and head[1:].split("(")[0].strip().lower() not in ("font-face", "page"):
                words = head[1:].lower().split(None, 1)
                counts = words[:1] == ["media"] and words[1:] and words[1].strip() in SCREEN
                skipped += bool(skipped or not counts)
            else:
                end = sheet.find("}", at)
                body = sheet[at : len(sheet) if end < 0 else end]
                at = len(sheet) if end < 0 else end + 1
                if not skipped and not head.startswith("@"):
                    self._add(head, body)

    def _add(self, head: str, body: str) -> None:
        if not (said := declared(body, 0)):
            return
        self.rules += 1
        for selector in head.split(","):
            if not (m := _SELECTOR.fullmatch(selector.strip())) or not m[0]:
                continue
            tag, name = (m[1] or "").lower().replace("*", ""), m[2] or ""
            weight = BY_TAG * bool(tag) + (BY_ID if name[:1] == "#" else BY_CLASS if name else 0)
            known = self.of.setdefault((tag, name), {})
            for prop, (extra, _, value) in said.items():
                known[prop] = max(known.get(prop, _LEAST), (weight + extra, self.rules, value), key=_RANK)

    def said(self, node: Node) -> dict[str, tuple[int, int, str]]:
        """The winning declarations for an element."""
        a = node.attributes
        found = declared(a["style"], INLINE) if "style" in a else {}
        if self.of:
            names = ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if "id" in a else [])]
            for key in ((t, name) for name in names for t in ("", node.tag)):
                for prop, x in self.of.get(key, _NOTHING).items():
                    found[prop] = max(found.get(prop, _LEAST), x, key=_RANK)
        return found


_NOTHING: dict[str, tuple[int, int, str]] = {}
_LEAST = (-1, -1, "")
_RANK = itemgetter(0, 1)
_UNSEEN_VALUES = frozenset(("none", "hidden", "collapse"))


def declared(style: str, weight: int) -> dict[str, tuple[int, int, str]]:
    """{property: (weight, place, value)} of the declarations of display and visibility in a style."""
    out: dict[str, tuple[int, int, str]] = {}
    for m in _DECLARED.finditer(style):
        prop = m[1].lower()
        out[prop] = max(out.get(prop, _LEAST), (weight + IMPORTANT * bool(m[3]), m.start(), m[2].lower()), key=_RANK)
    return out


def settle(root: Node, rules: Rules) -> None:
    """Takes all elements out of a tree that are not displayed, and the text of hidden ones."""
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, hidden = todo.pop()
        order.append((node, hidden))
        children = node.children
        if node.tag == "details" and "open" not in node.attributes:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        kept = []
        for x in children:
            if isinstance(x, str):
                if not hidden:
                    kept.append(x)
                continue
            if x.tag in UNSEEN:
                continue
            a, unseen = x.attributes, hidden
            if a or rules.of or x.tag == "dialog":
                said = rules.said(x)
                by_itself = "hidden" in a or "popover" in a or x.tag == "dialog" and "open" not in a
                if said["display"][-1] == "none" if "display" in said else by_itself:
                    continue
                if not UNSEEN_CLASSES.isdisjoint(a.get("class", "").split()):
                    continue
                if "visibility" in said and said["visibility"][-1] != "inherit":
                    unseen = said["visibility"][-1] in _UNSEEN_VALUES
            if unseen and x.tag in ("select", "textarea"):
                continue
            kept.append(x)
            todo.append((x, unseen))
        node.children = kept
    if not any(hidden for _, hidden in order):
        return
    blank: set[int] = set()
    for node, hidden in reversed(order):  # children come before their parents
        node.children = [x for x in node.children if isinstance(x, str) or id(x) not in blank]
        if hidden and not node.children and node.tag not in CELLS and node.tag != "br":
            blank.add(id(node))
        elif hidden and node.tag == "li":
            node.tag = "div"  # its mark is hidden


def drawn(svg: Node) -> list:
    """The text elements and embedded markup of a drawing, in order."""
    out: list = []
    todo = list(reversed(svg.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.tag in UNDRAWN or x.attributes.get("display") == "none" or x.attributes.get("visibility") in ("hidden", "collapse"):
            continue
        if x.tag in ("text", "foreignobject"):
            out += [" ", x, " "]
        else:
            todo += reversed(x.children)
    return out


def chosen(select: Node) -> list:
    """What a selection shows: its last option marked as selected, else the first that is not disabled; a list box shows all, with labels."""
    size = select.attributes.get("size", "").strip()
    box = "multiple" in select.attributes or size.isdecimal() and int(size) > 1
    shown: list[tuple[Node, bool, str]] = []
    todo = [(x, False) for x in reversed(select.children)]
    while todo:
        x, disabled = todo.pop()
        if isinstance(x, str):
            continue
        label = x.attributes.get("label", "").strip()
        if x.tag == "option":
            shown.append((x, disabled or "disabled" in x.attributes, label or "".join(_flat(x))))
        else:
            if x.tag == "optgroup" and box and label:
                shown.append((x, True, label))
            todo += [(c, disabled or x.tag == "optgroup" and "disabled" in x.attributes) for c in reversed(x.children)]
    if not box:
        shown = [x for x in shown if "selected" in x[0].attributes][-1:] or [x for x in shown if not x[1]][:1]
    return [f" {text} " for *_, text in shown]


def value_of(field: Node) -> str:
    """The text in a field or on a button; a picture as a button gives its alternative text."""
    kind = field.attributes.get("type", "").strip().lower()
    value = field.attributes.get("alt" if kind == "image" else "value", "").strip()
    return f" {value} " if value and (kind == "image" or kind not in UNSEEN_INPUTS) else ""


class Lines:
    """Collects inline text into lines; asks for breaks and blank lines are held until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed
        self.prefix = ""  # of the next line: indentation and marker
        self.indent = ""
        self.spaced = True  # the line ends in white space, or has none yet

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if self.spaced:
            s = s.lstrip(" ")
        if s:
            self.line.append(s)
            self.spaced = s[-1] == " "

    def end(self, gap: int = 0, force: bool = False) -> None:
        s = "".join(self.line).rstrip(" ")
        if s or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append((self.prefix or self.indent) + s if s else "")
            self.prefix, self.gap = "", 0
        self.line, self.spaced = [], True
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str], gap: int = 1) -> None:
        self.end(gap)
        for s in lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.lines.append((self.prefix or self.indent) + s if s else "")
            self.prefix = ""
        self.gap = max(self.gap, gap)


def _rows(table: Node) -> list[list[Node]]:
    """Rows of cells of a table, sections in order, without those of nested tables."""
    rows, todo = [], list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and c.tag in CELLS])
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(x.children)
    return [r for r in rows if r]


def _loose(table: Node) -> list[Node]:
    """What a table holds outside its cells: captions and misplaced text, which is shown before the rows."""
    out = Node("div", {})
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                out.children.append(x)
        elif x.tag in ("thead", "tbody", "tfoot", "tr"):
            todo += reversed([c for c in x.children if isinstance(c, str) or c.tag not in CELLS])
        elif x.tag not in ("td", "th", "colgroup", "col"):
            out.children.append(x)
    return [out] if out.children else []


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "").strip()
    return min(most, max(1, int(value))) if re.fullmatch(r"[0-9]{1,6}", value) else 1


def placed(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """(first column, column after the last) of each cell; cells that span rows push later rows' cells aside."""
    out, open_ = [], []  # open_: (first, after, rows left)
    for row in rows:
        taken, i, at, new, cells = sorted(open_), 0, 0, [], []
        for cell in row:
            while i < len(taken) and taken[i][0] <= at:
                at = max(at, taken[i][1])
                i += 1
            after = at + _span(cell, "colspan", 1000)
            cells.append((at, after))
            if (n := _span(cell, "rowspan", 65534)) > 1:
                new.append((at, after, n))
            at = after
        out.append(cells)
        open_ = [(a, b, n - 1) for a, b, n in (open_ + new)[:OPEN_SPANS] if n > 1]
    return out


def table_lines(table: Node, depth: int) -> list[str]:
    """One line for each row of one-line cells, columns aligned; cells of several lines take as many lines of the row."""
    rows = _rows(table)
    places = placed(rows)
    # Columns in which no cell starts take no room.
    starts = sorted({a for row in places for a, _ in row})
    number = {a: i for i, a in enumerate(starts)}
    grid = [[(number[a], bisect_left(starts, b) - 1, render(c, depth + 1).split("\n")) for c, (a, b) in zip(row, spans, strict=True)] for row, spans in zip(rows, places, strict=True)]
    widths = [0] * len(starts)
    for row in grid:
        for first, last, lines in row:
            if first == last:
                # Alignment stops at 40 characters, so that one long cell does not pad all others.
                widths[first] = min(40, max(widths[first], *(len(s) for s in lines)))
    left = [0, *accumulate(w + 3 for w in widths)]
    out = []
    for row in grid:
        k, cells = 0, row
        while cells:
            parts, at = [], 0
            for first, _, lines in cells:
                if first:
                    pad = max(0, left[first] - 3 - at)
                    parts.append(" " * pad + " | ")
                    at += pad + 3
                parts.append(lines[k])
                at += len(lines[k])
            if any(lines[k].strip() for *_, lines in cells):
                out.append("".join(parts).rstrip())
            k += 1
            cells = [c for c in cells if len(c[2]) > k]
    return out


def render(root: Node, depth: int = 0) -> str:
    """All visible text below ``root``, laid out; tables nested more than TABLE_DEPTH deep are shown as plain blocks."""
    out = Lines()
    todo: list = [(root, 0)]
    lists: list[list] = []  # open lists: [ordered, next number]
    quotes = 0
    while todo:
        node, step = todo.pop()
        if isinstance(node, str):
            out.text(node)
            continue
        tag = node.tag
        if step:  # the element ends
            if tag in LISTS:
                lists.pop()
                out.end(0 if lists else 1)
                out.indent = "  " * min(INDENTS, len(lists) + quotes)
            elif tag == "li":
                out.end()
                out.prefix = ""
            elif tag in BLOCK:
                out.end(1 if tag in SPACED else 0)
                if tag == "blockquote":
                    quotes -= 1
                    out.indent = "  " * min(INDENTS, len(lists) + quotes)
            continue
        if tag == "br":
            out.end(force=bool(out.line))
            continue
        if tag == "img":
            if alt := node.attributes.get("alt", "").strip():
                out.text(f" {alt} ")
            continue
        if tag == "input":
            out.text(value_of(node))
            continue
        if tag == "table" and node is not root and depth < TABLE_DEPTH:
            out.end(1)
            if loose := _loose(node):
                todo.append((Node("#rows", {"of": node}), 0))  # type: ignore[dict-item]
                todo += [(x, 0) for x in loose]
            else:
                out.whole(table_lines(node, depth))
            continue
        if tag == "#rows":
            out.whole(table_lines(node.attributes["of"], depth))  # type: ignore[arg-type]
            continue
        if tag in ("pre", "textarea"):
            inner = "".join(_flat(node)).strip("\n")
            out.whole([s.rstrip() for s in inner.split("\n")] if inner.strip() else [], 1 if tag == "pre" else 0)
            continue
        if tag in LISTS:
            out.end(0 if lists else 1)
            start = node.attributes.get("start", "")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            out.indent = "  " * min(INDENTS, len(lists) + quotes)
        elif tag == "li":
            out.end()
            level = min(INDENTS, max(0, len(lists) - 1) + quotes)
            if lists and lists[-1][0]:
                value = node.attributes.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][1] = int(value)
                out.prefix = f"{'  ' * level}{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                out.prefix = f"{'  ' * level}- "
        elif tag in BLOCK:
            out.end(1 if tag in SPACED else 0)
            if tag == "blockquote":
                quotes += 1
                out.indent = "  " * min(INDENTS, len(lists) + quotes)
        todo.append((node, 1))
        todo += [(x, 0) for x in reversed(_inner(node))]
    out.end()
    return "\n".join(out.lines).strip("\n")


def _inner(node: Node) -> list:
    """The children of a visible element that are shown."""
    if node.tag == "svg":
        return drawn(node)
    if node.tag == "select":
        return chosen(node)
    return [y for x in node.children for y in (" ", x, " ")] if node.tag in APART else node.children


def _flat(node: Node) -> Iterator[str]:
    todo: list = list(reversed(_inner(node)))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag == "br":
            yield "\n"
        elif x.tag == "input":
            yield value_of(x)
        else:
            todo += reversed(_inner(x))


def to_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def rendered(html: Column) -> Column:
    """The laid-out visible text of a column of pages."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([to_text(x.as_py()) for x in pages], pa.string())

    return run(html)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` plus ``out``, the visible text. No shuffle."""
    bound_batches(pages.sparkSession)
    return pages.withColumn(out, rendered(F.col(html)))
