"""Visible text of web pages, laid out: implied tags, visibility, block spacing, lists and aligned tables.

Tags are read by state, so that quotes count only where a value begins. A stack of open elements follows the standard
rules for implied and misnested tags; where an element of each name lies in it is held, so that no tag walks the
stack, and visibility is a count of open hiding elements. Text goes into the nearest frame (the page or a table cell)
line by line, as it comes. So nothing recurses, nothing is cut at a depth, and time is in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import beside
from babelshelf.llm.styles import NAMES, Styles

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/(?![a-zA-Z])|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
#: What follows a tag's name: names, and values, which may be quoted only right after the equals sign.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>))"
_REST = re.compile(rf"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^\s>]*+)))?+")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
# Names of elements as the HTML standard groups them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object video audio canvas datalist rp annotation annotation-xml".split())
#: Elements that leave an open head open; any other start tag ends it, and so does text.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes script style title template noscript".split())
#: Elements of a drawing that are not shown where they stand.
_UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
_SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select
    source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp foreignobject desc""".split()
)
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc annotation-xml".split())
_LIST_SCOPE, _BUTTON_SCOPE, _TABLE_SCOPE = _SCOPE | {"ol", "ul"}, _SCOPE | {"button"}, frozenset(("html", "table", "template"))
#: HTML in a drawing or formula stands below these; any other of these start tags ends the drawing or formula.
_INTO_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_OUT_OF_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_SECTIONS = frozenset(("tbody", "thead", "tfoot"))
_TABLE_PARTS = _SECTIONS | {"caption", "colgroup", "col", "tr", "td", "th"}
_TABLE_TOPS = _SECTIONS | {"table", "tr", "colgroup"}
#: Blank line around these, a new line around the others.
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset listing xmp".split())
_BLOCK = _SPACED | frozenset("html body div section article aside header footer main nav address form li dt dd details summary figcaption center caption legend option optgroup menu dir hgroup search dialog".split())
#: Start tags that end an open p.
_ENDS_P = (_SPACED | frozenset("address article aside details dialog div footer form header main menu nav section center dir hgroup search figcaption summary dd dt li".split())) - {"caption"}
_LISTS = ("ul", "ol", "menu", "dir")
#: Inputs that show their value as a label.
_LABELLED = ("submit", "reset", "button")
#: The standard's limits of spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
#: Lists further in than this are set at this column.
MAX_INDENT = 80
#: Tables nested deeper than this have their cells one below the other.
MAX_TABLES = 64
#: Blanks that align the columns of a page's tables, and steps to place their cells, at most: so many for each of its
#: characters, and so many more. Tables beyond it have the cells of a row side by side, without columns.
ALIGN_FACTOR, ALIGN_FLOOR = 16, 1_000_000


class Frame:
    """Finished lines, the line at hand, the break due before the next one, and the open list items."""

    __slots__ = ("lines", "line", "gap", "base", "marks")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.base = 0
        self.marks: list[str] = []

    def put(self, text: str) -> None:
        """One finished line, behind the marks of the list items that begin with it."""
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        lead = " " * min(self.base, MAX_INDENT) + "".join(self.marks)
        self.base += sum(map(len, self.marks))
        self.marks.clear()
        self.lines.append(lead + text.replace("\xa0", " "))

    def flush(self) -> None:
        if self.line:
            text = _BLANKS.sub(" ", "".join(self.line)).strip(" ")
            self.line.clear()
            if text:
                self.put(text)

    def space(self, lines: int) -> None:
        """At least so many line ends before what follows."""
        self.flush()
        self.gap = max(self.gap, lines)

    def line_end(self) -> None:
        held = any(map(str.strip, self.line))
        self.flush()
        self.gap = 1 if held else min(self.gap + 1, 2)

    def layout(self) -> list[str]:
        self.flush()
        return self.lines


class Element:
    __slots__ = ("tag", "foreign", "hides", "seen", "drawn", "shut", "frame", "rows", "group", "number", "step", "kind", "mark", "columns", "n_rows", "gone", "sheet")

    def __init__(self, tag: str, drawn: bool, foreign: bool = False):
        self.tag, self.drawn, self.foreign = tag, drawn, foreign
        self.hides, self.shut, self.gone, self.sheet = 0, False, False, False
        self.seen = self.frame = self.rows = self.number = self.mark = self.kind = None
        self.step = 1
        self.columns = self.n_rows = 1
        self.group = 0


def aligned(rows: list[tuple[int, list[tuple[list[str], int, int]]]], budget: int) -> tuple[list[str], int]:
    """Lines of a table, and what is left of ``budget``. A row is (group, cells), a cell (lines, columns, rows).

    Cells that begin in a column begin at the same place in all rows; a cell that spans rows keeps its columns free in
    those of its group. The place of a column is the least that leaves two blanks behind each cell that ends before it.
    """
    held: list[tuple[int, int, int]] = []  # (column, end, last row) of the cells that reach down, by column
    last_of = {group: i for i, (group, _) in enumerate(rows)}
    placed: list[list[tuple[int, int, list[str]]]] = []
    for i, (group, cells) in enumerate(rows):
        held = [x for x in held if x[2] >= i]
        budget -= len(held) + len(cells)
        if budget < 0:
            break
        at, k, row, new = 0, 0, [], []
        for lines, columns, n_rows in cells:
            while k < len(held) and held[k][0] <= at:
                at, k = max(at, held[k][1]), k + 1
            row.append((at, at + columns, lines))
            last = last_of[group] if n_rows == 0 else min(last_of[group], i + n_rows - 1)
            if last > i:
                new.append((at, at + columns, last))
            at += columns
        placed.append(row)
        held = sorted(held + new) if new else held
    if budget >= 0:
        begins = sorted({a for row in placed for a, _, _ in row})
        before = defaultdict(list)  # column: (column, width) of the cells that end there and aren't the last of their row
        for row in placed:
            for a, b, lines in row[:-1]:
                before[begins[bisect_left(begins, b)]].append((a, max(map(len, lines), default=0)))
        place, least = {}, -2
        for column in begins:
            least = max([least + 2, *(place[a] + width + 2 for a, width in before[column])]) if place else 0
            place[column] = least
        budget -= sum(place[row[-1][0]] * max(len(lines) for *_, lines in row) for row in placed if row)
    out = []
    for i, (_, cells) in enumerate(rows):
        if budget < 0:
            texts = [x for x, _, _ in cells if x]
            out += ["  ".join(x[0] for x in texts)] if texts and max(map(len, texts)) == 1 else [y for x in texts for y in x]
            continue
        for k in range(max((len(lines) for *_, lines in placed[i]), default=0)):
            text = ""
            for column, _, lines in placed[i]:
                if k < len(lines) and lines[k]:
                    text = text.ljust(place[column]) + lines[k]
            out.append(text)
    return out, max(budget, -1)


def letters(n: int) -> str:
    """a to z, aa and so on; a number that has none stays as it is."""
    found, rest = "", n
    while rest > 0:
        rest, k = divmod(rest - 1, 26)
        found = chr(97 + k) + found
    return found or str(n)


def roman(n: int) -> str:
    if not 0 < n < 4000:
        return str(n)
    digits = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    found = ""
    for value, text in digits:
        found += text * (n // value)
        n %= value
    return found


#: How the items of an ordered list are numbered, by its type.
NUMBERS = {"a": letters, "A": lambda n: letters(n).upper(), "i": roman, "I": lambda n: roman(n).upper()}


class Renderer:
    """Builds the open elements of one page and collects its text.

    ``styles`` are those of the whole page, ``items`` the numbers of items of its ordered lists; both come from an earlier
    pass over it, if it needs them.
    """

    def __init__(self, size: int, styles: Styles | None = None, items: list[int] | None = None):
        self.styles, self.items = styles or Styles([]), items
        #: What this pass finds: the texts of style elements, and each ordered list's number of items.
        self.sheets: list[str] = []
        self.counted: list[int] = []
        self.page = Frame()
        self.stack = [Element("", True)]
        #: Places in the stack of the open elements by name, of those that bound an implied end, and of all that are special.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = [0]
        self.specials: list[int] = [0]
        self.frames = [self.page]
        self.tables: list[Element] = []
        self.hiding = self.pre = 0
        self.stack[0].seen = True
        #: Open elements that set their own visibility.
        self.seen = [self.stack[0]]
        self.budget = ALIGN_FLOOR + ALIGN_FACTOR * size

    def shown(self) -> bool:
        return not self.hiding and self.stack[-1].drawn and self.seen[-1].seen

    def foreign(self) -> bool:
        """Whether the innermost element belongs to a drawing or a formula."""
        inside = max((self.at[x][-1] for x in ("svg", "math") if self.at[x]), default=0)
        return inside > max((self.at[x][-1] for x in _INTO_HTML if self.at[x]), default=0)

    def last(self, tags: frozenset) -> int:
        """Place of the innermost open element of ``tags``, 0 for none."""
        return max((self.at[x][-1] for x in tags if self.at[x]), default=0)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and raw.strip(" \t\n\r\f"):
            self.close()
            top = self.stack[-1]
        if not self.shown():
            return
        text = unescape(raw)
        if top.tag in _TABLE_TOPS and not text.strip():
            return
        if not self.pre:
            self.frames[-1].line.append(text)
            return
        for k, x in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.frames[-1].line_end()
            self.frames[-1].line.append(x.replace(" ", "\xa0").replace("\t", "\xa0" * 4))

    def push(self, e: Element) -> None:
        place = len(self.stack)
        self.stack.append(e)
        self.at[e.tag].append(place)
        if e.tag in _SPECIAL:
            self.specials.append(place)
            if e.tag not in ("address", "div", "p"):
                self.bounds.append(place)

    def leave(self, e: Element) -> None:
        """Ends the effect that an element has on those below it."""
        self.hiding -= e.hides + e.shut
        if e.seen is not None:
            del self.seen[max(k for k, x in enumerate(self.seen) if x is e) if self.seen[-1] is not e else -1]

    def close(self) -> None:
        e = self.stack.pop()
        place = len(self.stack)
        while self.stack[-1].gone:
            self.stack.pop()
        self.at[e.tag].pop()
        for held in (self.specials, self.bounds):
            if held[-1] == place:
                held.pop()
        up, shown, frame = self.stack[-1], self.hiding == e.shut and e.drawn, self.frames[-1]
        self.leave(e)
        if e.tag == "pre" and not e.foreign:
            self.pre -= 1
        if e.frame is not None:
            self.frames.pop()
            if e.rows is None and self.tables:
                self.tables[-1].rows[-1][1].append((e.frame.layout(), e.columns, e.n_rows))
        elif e.rows is not None:
            self.tables.pop()
            lines, self.budget = aligned(e.rows, self.budget)
            frame.space(2)
            for line in lines:
                if line:
                    frame.put(line)
                else:
                    frame.gap = 2
            frame.space(2)
        elif shown and (e.tag in _BLOCK or not up.drawn):
            self.space(e.tag)
        elif e.tag in _TABLE_PARTS and shown:
            frame.space(1)
        if e.mark is not None:
            if frame.marks:
                frame.marks.pop()
            else:
                frame.base -= len(e.mark)

    def space(self, tag: str) -> None:
        inner = tag in ("ul", "ol") and self.stack[-1].tag == "li"
        self.frames[-1].space(2 if tag in _SPACED and not inner else 1)

    def close_to(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        while len(self.stack) > place > 0:
            self.close()

    def end_within(self, tags: frozenset, bounds: frozenset) -> bool:
        """Closes the innermost open element of ``tags`` unless one of ``bounds`` lies in it."""
        place = self.last(tags)
        if not place or self.last(bounds) > place:
            return False
        self.close_to(place)
        return True

    def into_table(self, tag: str) -> bool:
        """Closes what a part of a table ends; False if there is no table."""
        table = self.last(frozenset(("table",)))
        if not table or self.last(frozenset(("template", "svg", "math"))) > table:
            return False
        section, row = max(table, self.last(_SECTIONS)), self.last(frozenset(("tr",)))
        if tag not in ("td", "th"):
            self.close_to((section if tag == "tr" else table) + 1)
        elif row > table:
            self.close_to(row + 1)
        else:
            self.close_to(section + 1)
            self.start("tr", "")
        return True

    def implied(self, tag: str) -> None:
        """Closes the elements that a start tag ends."""
        top = self.stack[-1].tag
        if tag in _ENDS_P and self.at["p"]:
            self.end_within(frozenset(("p",)), _BUTTON_SCOPE)
        if tag == "li" or tag in ("dt", "dd"):
            place = self.bounds[-1]
            if self.stack[place].tag in (("li",) if tag == "li" else ("dt", "dd")):
                self.close_to(place)
                if self.at["p"]:
                    self.end_within(frozenset(("p",)), _BUTTON_SCOPE)
        elif tag in _HEADINGS and self.stack[-1].tag in _HEADINGS or tag == top == "option":
            self.close()
        elif tag == "optgroup" and top in ("option", "optgroup"):
            if top == "option":
                self.close()
            if self.at["select"] and self.stack[-1].tag == "optgroup":
                self.close()
        elif tag == "table" and top in _TABLE_TOPS:
            self.close_to(self.at["table"][-1])
        elif tag in ("a", "nobr") and self.at[tag]:
            self.end(tag)
        elif tag == "button" and self.at["button"]:
            self.end_within(frozenset(("button",)), _SCOPE)

    def leave_foreign(self) -> None:
        inside = self.last(_INTO_HTML)
        self.close_to(min(x for kind in ("svg", "math") for x in self.at[kind][bisect_right(self.at[kind], inside) :]))

    def start(self, tag: str, attributes: str) -> None:
        foreign = bool(self.at["svg"] or self.at["math"]) and self.foreign()
        if foreign and tag in _OUT_OF_FOREIGN:
            self.leave_foreign()
            foreign = False
        if not foreign:
            if tag == "body" and self.at["head"]:
                self.close_to(self.at["head"][0])
            elif self.stack[-1].tag == "head" and tag not in _IN_HEAD:
                self.close()
            if tag in ("html", "head", "body", "frame", "frameset") and (tag[:5] == "frame" or len(self.stack) > 1 + (tag != "html" and len(self.at["html"]))):
                return
            if tag in _TABLE_PARTS:
                if not self.into_table(tag):
                    return
            else:
                self.implied(tag)
        up = self.stack[-1]
        found: dict[str, str] = {}
        end = 0
        if "=" in attributes or attributes.strip("/ "):
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
                end = m.end()
        e = Element(tag, tag != "svg" and (up.drawn or tag in ("text", "foreignobject")), foreign)
        looks = {k: unescape(found[k]) for k in ("style", "class", "id") if k in found}
        style = self.styles.of(tag, looks) if looks or self.styles.by_key else {}
        # Of a drawing, only text elements and embedded HTML show their text, each on a line of its own.
        e.hides = int("hidden" in found or style.get("display") == "none" or tag in _HIDDEN or tag == "dialog" and "open" not in found or tag in _UNDRAWN and bool(self.at["svg"]))
        # What closed details hold is hidden, but for their summary.
        e.hides -= up.shut and tag == "summary"
        if (foreign or tag in ("svg", "math")) and attributes.endswith("/") and end < len(attributes):
            return
        shown, frame = not self.hiding + e.hides and e.drawn, self.frames[-1]
        seen = self.seen[-1].seen if style.get("visibility", "inherit") == "inherit" else style["visibility"] not in ("hidden", "collapse")
        if tag in _VOID:
            if shown and tag == "br":
                frame.line_end()
            elif shown and tag == "hr":
                frame.space(2)
            elif shown and seen and tag == "input" and found.get("type", "").strip().lower() in _LABELLED:
                frame.line.append(f" {unescape(found.get('value', ''))} ")
            return
        if style.get("visibility", "inherit") != "inherit":
            e.seen = seen
            self.seen.append(e)
        self.hiding += e.hides
        if foreign:
            pass
        elif tag in ("td", "th"):
            if self.tables and self.tables[-1].rows and shown and self.tables[-1] is self.stack[self.at["table"][-1]]:
                e.frame = Frame()
                e.columns, e.n_rows = (min(most, max(least, int(x))) if (x := found.get(k, "").strip()).isascii() and x.isdigit() and len(x) < 10 else 1 for k, least, most in (("colspan", 1, MOST_COLUMNS), ("rowspan", 0, MOST_ROWS)))
            elif shown:
                frame.space(1)
        elif tag == "table":
            if shown and len(self.tables) < MAX_TABLES:
                e.rows = []
        elif tag == "tr" or tag in _SECTIONS:
            table = self.tables[-1] if self.tables and self.tables[-1] is self.stack[self.at["table"][-1]] else None
            if table is not None:
                table.group += tag != "tr"
                if tag == "tr" and shown:
                    table.rows.append((table.group, []))
        elif tag == "ol":
            e.step = -1 if "reversed" in found else 1
            first = int(found["start"]) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", found.get("start", "")) else None
            if first is None:
                first = self.items[len(self.counted)] if "reversed" in found and self.items else 1
            e.number = first - e.step
            e.kind, e.group = found.get("type", "").strip(), len(self.counted)
            self.counted.append(0)
        elif tag == "details":
            e.shut = "open" not in found
            self.hiding += e.shut
        elif tag == "pre":
            self.pre += 1
        elif tag == "style":
            e.sheet = found.get("media", "").strip().lower() in ("", "all", "screen") and found.get("type", "").strip().lower() in ("", "text/css")
        if shown and (tag in _BLOCK or not up.drawn) and e.rows is None:
            self.space(tag)
        if tag == "li" and shown and not foreign and self.seen[-1].seen:
            parent = self.stack[max((self.at[x][-1] for x in _LISTS if self.at[x]), default=0)]
            if parent.tag == "ol":
                value = found.get("value", "").strip()
                parent.number = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else parent.number + parent.step
                self.counted[parent.group] += 1
                number = NUMBERS.get(found.get("type", "").strip() or parent.kind, str)(parent.number)
            e.mark = f"{number}. " if parent.tag == "ol" else "- "
            frame.marks.append(e.mark)
        elif tag == "optgroup" and shown and not foreign and self.seen[-1].seen:
            frame.line.append(unescape(found.get("label", "")))
            frame.space(1)
        self.push(e)
        if e.frame is not None:
            self.frames.append(e.frame)
        if e.rows is not None:
            self.tables.append(e)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p":
            if (self.at["svg"] or self.at["math"]) and self.foreign():
                self.leave_foreign()
            if not self.end_within(frozenset(("p",)), _BUTTON_SCOPE) and self.shown():
                self.frames[-1].space(2)
        elif tag in ("html", "body") or not self.at[tag] and tag not in _HEADINGS:
            return
        elif tag in _FORMATTING:
            self.end_formatting(tag)
        elif tag in _HEADINGS:
            self.end_within(_HEADINGS, _SCOPE)
        elif tag in _TABLE_PARTS or tag == "table":
            self.end_within(frozenset((tag,)), _TABLE_SCOPE)
        elif tag in ("head", "template"):
            self.close_to(self.at[tag][-1])
        elif tag in _SPECIAL:
            self.end_within(frozenset((tag,)), _LIST_SCOPE if tag == "li" else _SCOPE)
        elif self.at[tag][-1] >= self.specials[-1] or tag in ("svg", "math"):
            self.close_to(self.at[tag][-1])

    def end_formatting(self, tag: str) -> None:
        """Ends an element but leaves the blocks in it open."""
        place = self.at[tag][-1]
        if self.last(_SCOPE) > place:
            return
        if self.specials[-1] < place:
            self.close_to(place)
            return
        e = self.stack[place]
        self.at[tag].pop()
        self.leave(e)
        e.gone = True

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.close()
        return "\n".join(self.page.layout())


def visible_text(html: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty string.

    Hidden are elements that a browser with scripts hides by default, by ``hidden`` or by ``display`` and ``visibility`` in a
    style attribute or in the page's own style elements (see ``styles``). A closed ``select`` shows all its options and
    the labels of their groups, a button-like input its value. A tag that the page's end cuts off ends at its first ``>``;
    without any it is text. Pages with style elements that may hide something, or with lists that count down, are read twice.
    """
    html = (html or "").replace("\0", "")
    styles = items = None
    if any(_HIDES.search(m[0]) for m in _SHEET.finditer(html)):
        styles = Styles(rendered(html, Renderer(len(html))).sheets)
    if _REVERSED.search(html):
        items = rendered(html, Renderer(len(html), styles)).counted
    return rendered(html, Renderer(len(html), styles, items)).finish()


#: What may be a style element, what it must hold to hide something, and what lists that count down hold.
_SHEET = re.compile(r"<style[\s/>].*?(?:</style|\Z)", re.I | re.S)
_HIDES = re.compile("|".join(NAMES), re.I)
_REVERSED = re.compile(r"\breversed\b", re.I)


def rendered(html: str, page: Renderer) -> Renderer:
    """Reads a page into ``page``."""
    at, begin, cut_off = 0, 0, False
    while m := _OPEN.search(html, at):
        at, rest = m.start(), None
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), m.end()):
                stop = html.index(">", m.end()) + 1
            else:
                close = _COMMENT_END.search(html, m.end())
                stop = close.end() if close else len(html)
        elif html.startswith("<![CDATA[", at) and (page.at["svg"] or page.at["math"]) and page.foreign():
            stop = html.find("]]>", m.end())
            inner = html[m.end() : stop if stop >= 0 else len(html)]
            if at > begin:
                page.text(html[begin:at])
            page.text(inner.replace("&", "&amp;"))
            begin = at = stop + 3 if stop >= 0 else len(html)
            continue
        else:
            if m[2] and not cut_off:
                rest = _REST.match(html, m.end())
                cut_off = rest is None  # all up to the page's end is in the tag
            stop = rest.end() if rest else html.find(">", m.end()) + 1
            if not stop:
                if not m[2]:
                    if at > begin:
                        page.text(html[begin:at])
                    begin = len(html)
                break
        if at > begin:
            page.text(html[begin:at])
        begin = at = stop
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, rest[1] if rest else html[m.end() : stop - 1])
        if tag == "plaintext":
            break
        if tag in _RAW and page.stack[-1].tag == tag and not page.stack[-1].foreign:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else len(html)
            if tag == "style" and page.stack[-1].sheet:
                page.sheets.append(html[at:stop])
            page.text(html[at:stop])
            begin = at = stop
    if begin < len(html):
        page.text(html[begin:])
    return page


@F.pandas_udf(T.StringType())
def layout_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([visible_text(x) for x in part], dtype=object)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(*keep, text) of each row's whole ``html``.

    Rows are independent: repeated ones and null ids give a row each, a null page has an empty text, an empty table an
    empty result. A kept column named ``text`` is returned as ``text_in``; other columns are ignored.
    """
    return pages.select(*(F.col(f"`{c}`").alias(name) for c, name in beside(("text",), keep).items()), layout_text("html").alias("text"))


def op10_layout_text(spark, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ("page_id", "url"))
