"""Visible words against a plain reading of the standard: characters one by one, a list of open elements walked for each tag."""

import random
import re
import time
from collections import Counter
from html import unescape

import pytest

from babelshelf.llm import html

BLANK = " \t\n\r\f"
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style xmp iframe noembed noframes textarea title".split()
HIDDEN = "head script style template noscript title iframe noembed noframes object video audio canvas datalist rp annotation annotation-xml".split()
SPECIAL = """address area article aside blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html
iframe img input li link main menu meta nav noembed noframes noscript object ol p param pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp foreignobject""".split()
SCOPE = "caption html table td th object template foreignobject".split()
ENDS_P = """address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp""".split()
BREAKS_OUT = "b blockquote body br center div dl dd dt em h1 h2 h3 head hr i img li menu meta ol p pre s small span strong table ul u".split()


class Tree:
    def __init__(self, page, sheets=None):
        self.page, self.i, self.stack, self.words, self.found, self.sheets = page, 0, [], Counter(), [], sheets or []
        self.read()
        if sheets is None and self.found:  # sheets hold for what stands before them, too
            self.words = Tree(page, self.found).words

    def read(self):
        page, text = self.page, ""
        while self.i < len(page):
            after = page[self.i + 1 : self.i + 3]
            letter = after[after[:1] == "/" :][:1]
            if page[self.i] != "<" or not (after[:1] in ("!", "?", "/") or letter.isascii() and letter.isalpha()):
                text += page[self.i]
                self.i += 1
                continue
            self.text(text)
            text = ""
            if page.startswith("<!--", self.i):
                self.comment()
            elif after[:1] in ("!", "?") or not (letter.isascii() and letter.isalpha()):
                end = page.find(">", self.i)
                self.i = end + 1 if end >= 0 else len(page)
            else:
                self.tag()
        self.text(text)

    def comment(self):
        self.i += 4
        for short in (">", "->"):
            if self.page.startswith(short, self.i):
                self.i += len(short)
                return
        while self.i < len(self.page):
            for end in ("-->", "--!>"):
                if self.page.startswith(end, self.i):
                    self.i += len(end)
                    return
            self.i += 1

    def take(self, stops):
        begin = self.i
        while self.page[self.i] not in stops:
            self.i += 1
        return self.page[begin : self.i]

    def tag(self):
        page, attributes, closed = self.page, {}, False
        self.i += 1
        ends = page[self.i] == "/"
        self.i += ends
        name = self.take(BLANK + "/>").lower()
        while page[self.i] != ">":
            if page[self.i] in BLANK + "/":
                closed = page[self.i] == "/" and page[self.i + 1] == ">"
                self.i += 1
                continue
            first = page[self.i]
            self.i += 1
            key, value = (first + self.take(BLANK + "/>=")).lower(), ""
            at = self.i
            while page[at] in BLANK:
                at += 1
            if page[at] == "=":
                self.i = at + 1
                while page[self.i] in BLANK:
                    self.i += 1
                if page[self.i] in "\"'":
                    quote = page[self.i]
                    self.i += 1
                    value = self.take(quote)
                    self.i += 1
                elif page[self.i] != ">":
                    value = self.take(BLANK + ">")
            attributes.setdefault(key, unescape(value))
        self.i += 1
        if ends:
            self.end(name)
            return
        before = len(self.stack)
        self.start(name, attributes, closed)
        if name in RAW and len(self.stack) and self.stack[-1]["tag"] == name and not self.stack[-1]["foreign"] and (len(self.stack) > before or name == "title"):
            m = re.compile(rf"</{name}[\s/>]", re.I).search(page, self.i)
            stop = m.start() if m else len(page)
            if name == "style" and attributes.get("media", "all") == "all":
                self.found.append(page[self.i : stop])
            self.text(page[self.i : stop])
            self.i = stop

    def top(self):
        return self.stack[-1]["tag"] if self.stack else ""

    def place(self, tags, bounds=()):
        """Place of the innermost of ``tags``, None beyond one of ``bounds``."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] in tags:
                return k
            if self.stack[k]["tag"] in bounds:
                return None
        return None

    def cut(self, place):
        if place is not None:
            del self.stack[place:]

    def foreign(self):
        for e in reversed(self.stack):
            if e["tag"] in ("svg", "math"):
                return True
            if e["tag"] in ("foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"):
                return False
        return False

    def text(self, raw):
        if self.top() == "head" and raw.strip(BLANK):
            self.stack.pop()
        for w in re.findall(r"\w+", unescape(raw)):
            if self.visible():
                self.words[w] += 1

    def visible(self):
        seen = next((e["seen"] for e in reversed(self.stack) if e["seen"] is not None), True)
        drawn = next((e["tag"] != "svg" for e in reversed(self.stack) if e["tag"] in ("svg", "text", "foreignobject")), True)
        return seen and drawn and not sum(e["hides"] + e["shut"] for e in self.stack)

    def start(self, tag, attributes, closed):
        foreign = self.foreign()
        if foreign and tag in BREAKS_OUT:
            while self.foreign():
                self.stack.pop()
            foreign = False
        if not foreign:
            if tag == "body":
                self.cut(self.place(("head",)))
            elif self.top() == "head" and tag not in "html head base link meta noframes script style title template noscript".split():
                self.stack.pop()
            inside = [e["tag"] for e in self.stack]
            if tag == "html" and inside or tag in ("head", "body") and inside not in ([], ["html"]):
                return
            if tag in "caption colgroup col tbody thead tfoot tr td th".split():
                if self.place(("table",), ("template", "svg", "math")) is None:
                    return
                stop = {"tr": ("table", "tbody", "thead", "tfoot"), "td": ("table", "tbody", "thead", "tfoot", "tr"), "th": ("table", "tbody", "thead", "tfoot", "tr")}.get(tag, ("table",))
                while self.top() not in stop:
                    self.stack.pop()
                if tag in ("td", "th") and self.top() != "tr":
                    self.start("tr", {}, False)
            else:
                if tag in ENDS_P:
                    self.cut(self.place(("p",), SCOPE + ["button"]))
                if tag in ("li", "dd", "dt"):
                    same = ("li",) if tag == "li" else ("dd", "dt")
                    self.cut(self.place(same, [x for x in SPECIAL if x not in ("address", "div", "p", *same)]))
                    self.cut(self.place(("p",), SCOPE + ["button"]))
                if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.top()) or tag == self.top() == "option":
                    self.stack.pop()
                if tag == "optgroup" and self.top() == "option":
                    self.stack.pop()
                if tag == "optgroup" and self.top() == "optgroup" and "select" in [e["tag"] for e in self.stack]:
                    self.stack.pop()
                if tag == "table" and self.top() in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
                    self.cut(self.place(("table",)))
                if tag == "a":
                    self.end("a")
                if tag == "button":
                    self.cut(self.place(("button",), SCOPE))
        style = self.style(tag, attributes)
        hides = (
            "hidden" in attributes or style.get("display") == "none" or tag in HIDDEN
            or tag == "dialog" and "open" not in attributes or tag in ("desc", "defs") and any(e["tag"] == "svg" for e in self.stack)
        )
        hides -= bool(self.stack) and self.stack[-1]["shut"] and tag == "summary"
        seen = style.get("visibility")
        if tag == "input" and attributes.get("type") in ("submit", "button"):
            self.stack.append({"tag": tag, "hides": hides, "seen": None if seen is None else seen == "visible", "shut": False, "foreign": False})
            self.text(attributes.get("value", ""))
            self.stack.pop()
        if (foreign or tag in ("svg", "math")) and closed or tag in VOID:
            return
        self.stack.append({"tag": tag, "hides": hides, "seen": None if seen is None else seen == "visible", "shut": tag == "details" and "open" not in attributes and not foreign, "foreign": foreign})

        if tag == "optgroup" and not foreign:
            self.text(attributes.get("label", ""))

    def style(self, tag, attributes):
        """All declarations that hold, in a list, from which the strongest of each property is taken."""
        held = []
        for sheet in self.sheets:
            text = re.sub(r"/\*.*?\*/", " ", re.sub(r"@(?:media print|supports)[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", " ", sheet))
            text = re.sub(r"@media all\s*\{((?:[^{}]*\{[^{}]*\})*)\s*\}", r"\1", re.sub("@import[^;]*;", " ", text)) + "}" * (text.count("{") - text.count("}"))
            for selectors, block in re.findall(r"([^{}]*)\{([^{}]*)\}", text):
                for selector in selectors.split(","):
                    parts = re.findall(r"[.#]?[\w-]+|\*", selector)
                    if "".join(parts) != selector.strip() or not parts:
                        continue
                    fits = all(
                        x == "*" or (x[0] == "." and x[1:] in attributes.get("class", "").split()) or (x[0] == "#" and x[1:] == attributes.get("id")) or x == tag
                        for x in parts
                    )
                    if fits:
                        weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), sum(x[0] not in ".#*" for x in parts))
                        held += [((0, *weight), *x) for x in self.declarations(block)]
        held += [((1, 0, 0, 0), *x) for x in self.declarations(attributes.get("style", ""))]
        out = {}
        for _, _, name, value in sorted(((important, weight), k, name, value) for k, (weight, important, name, value) in enumerate(held)):
            out[name] = value
        return out

    def declarations(self, block):
        for part in block.lower().split(";"):
            if ":" in part:
                name, value = part.split(":")[:2]
                yield "!" in value, name.strip(), value.split("!")[0].strip()

    def end(self, tag):
        if tag in ("br", "p"):
            while self.foreign():
                self.stack.pop()
        if tag in ("html", "body", "br"):
            return
        if tag in ("a", "b", "i", "em"):
            place = self.place((tag,), SCOPE)
            if place is not None:
                if any(e["tag"] in SPECIAL for e in self.stack[place:]):
                    del self.stack[place]
                else:
                    self.cut(place)
        elif re.fullmatch("h[1-6]", tag):
            self.cut(self.place(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE))
        elif tag in "table caption colgroup tbody thead tfoot tr td th".split():
            self.cut(self.place((tag,), [x for x in ("html", "table", "template") if x != tag]))
        elif tag in ("head", "template", "svg", "math"):
            self.cut(self.place((tag,)))
        elif tag in SPECIAL:
            self.cut(self.place((tag,), [x for x in SCOPE + (["button"] if tag == "p" else ["ol", "ul"] if tag == "li" else []) if x != tag]))
        else:
            self.cut(self.place((tag,), SPECIAL))


def words_of(page):
    text = re.sub(r"(?m)^((?: |-  ?|\d+\. )*)(- |\d+\. )", r"\1", html.visible_text(page))
    return Counter(re.findall(r"\w+", text))


def test_all_pages(spark, sf):
    """Every page of the table, whatever it holds; list numbers are left out on both sides."""
    digits = re.compile(r"\d+")
    for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet").collect():
        got, want = words_of(r.html), Tree(r.html or "").words
        assert {w: n for w, n in got.items() if not digits.fullmatch(w)} == {w: n for w, n in want.items() if not digits.fullmatch(w)}


TAGS = "html head body title style script noscript template p div span section h1 h2 ul ol li dl dt dd table caption colgroup tbody thead tr td th a b i em button form select option optgroup details summary dialog pre textarea br img hr svg g text defs foreignobject math mi object".split()
SHEETS = [
    ".x{display:none}", "p#z, b{visibility:hidden}", ".y.x{display:block!important} .x { display : none }", "@media print{b{display:none}} i{display:none}", "i > b{display:none} .y{visibility:visible}", "/* p{display:none} */ #z{display:none;}", "@media all{li{display:none}}",
    "*{visibility:hidden} .x{visibility:visible!important}", "div{display:none !important}", "span.y{color:red;display:none", "@import 'a'; em{display:none}", "p{display:none}p{display:block}", ".x, b > i, .y { visibility: hidden }",
]
ATTRIBUTES = [
    " class=x", " class='x y'", " class=y id=z", " id=z", " class=y style='display:block'", " id=z style='visibility:visible!important'",
    "", "", "", "", "", " hidden", " class=x", " style='display:none'", ' style="color:red; display : none"', " style=visibility:hidden", " style='visibility:visible'", " open", " title=don't", " title='a>b'", ' title="it\'s"', " =x", " a=\"'\" b",
    " data-x=a/", " hidden=no hidden", " colspan=2", " rowspan=2", " style=display&#58;none", " Title = 'x' HIDDEN", " a='x'hidden", " /", "/",
]
OTHERS = ["<!-->", "<!--->", "<!-- c -->", "<!-- c --!>", "<!-- <p hidden> -->", "<!doctype html>", "<?x>", "</>", "</ x>", " < ", " &lt;p&gt; ", "<!x y>"]


def odd_page(dice):
    parts, n, svg = [], 0, 0
    for _ in range(dice.randrange(3, 40)):
        kind = dice.random()
        if kind < 0.4:
            n += 1
            parts.append(f" w{n} ")
        elif kind < 0.5:
            parts.append(dice.choice(OTHERS))
        else:
            tag = dice.choice(TAGS)
            if dice.random() < 0.12:
                n += 1
                sheet = dice.choice(SHEETS)
                parts.append(dice.choice([f"<optgroup label=w{n}>", f"<input type=submit value='w{n}'>", f"<input type=text value=w{n}>", f"<style>{sheet}</style>", f"<style media=print>{sheet}</style>", f"<input type=button class=x value=w{n}>"]))
                continue
            if tag in ("title", "style", "script", "textarea") and dice.random() < 0.9:
                n += 1
                parts.append(f"<{tag}> w{n} <b> </{tag.upper()}\n>")
            else:
                parts.append(f"<{dice.choice([tag, tag, tag.upper()])}{dice.choice(ATTRIBUTES)}>" if dice.random() < 0.6 else f"</{tag}>")
    return "".join(parts)


def test_generated_pages():
    dice = random.Random(5)
    shown = 0
    for _ in range(20_000):
        page = odd_page(dice)
        got = {w for w in words_of(page) if re.fullmatch(r"w\d+", w)}
        want = {w for w in Tree(page).words if re.fullmatch(r"w\d+", w)}
        assert got == want, page
        shown += len(want)
    assert shown > 20_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!-- x --!>b<p>c", "ab\n\nc"), ("<p title=don't>Hello</p><p>it's</p>z", "Hello\n\nit's\n\nz"), ("<a href=x/>y</a>", "y"),
        ("<div>" * 511 + "<div style='display:none'><b>x</b> secret", ""), ("<div>" * 5000 + "<div hidden>x</div>y", "y"),
        ("<span hidden><div>a</span>b</div>c", ""), ("<b><div hidden>a</b>b</div>c", "c"), ("<b hidden><div>a</b>b</div>c", "b\nc"), ("<table><div hidden>x<tr><td>y</table>", "y"), ("<svg><p>Hi", "Hi"),
        ("<p style='display:none;display:block'>x", "x"), ("<p style='display:none!important;display:block'>x", ""), ("<dialog>x</dialog><dialog open>y</dialog>", "y"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"), ("<table><tr><td>A<td rowspan=2>B<td>C<tr><td>Dd<td>E</table>", "A   B  C\nDd     E"),
        ("<table><tr><td rowspan=0>A<td>1<tr><td>2<tbody><tr><td>3<td>4</table>", "A  1\n   2\n3  4"), ("<table><tr><td rowspan=9 colspan=2>A<td>1<tr><td>2<tr><td>3</table>", "A  1\n   2\n   3"),
        ("<table><tr><td>" + "w" * 70 + "<td>x<tr><td>a<td>y</table>", "w" * 70 + "  x\na" + " " * 71 + "y"), ("<table><tr><td colspan=900>a<td>b<tr><td>c<td colspan=899>d<td>e</table>", "a     b\nc  d  e"),
        ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"), ("<ul><li><ul><li>x</ul>y</ul>", "- - x\n  y"), ("<ul><li>a<table><tr><td>b<td>c<tr><td>dd<td>e</table></ul>", "- a\n\n  b   c\n  dd  e"),
        ("<select><optgroup label='One &amp; two'><option>a<option>b</optgroup><optgroup label=Three><option>c</select>", "One & two\na\nb\nThree\nc"), ("<p>x<input type=submit value=Send><input value=no><input type=RESET value=Clear></p>", "x Send Clear"), ("<p hidden><input type=submit value=x></p><input type=submit style='visibility:hidden' value=y>z", "z"),
        ("<ol type=A><li>a<li value=28>b<li>c</ol>", "A. a\nAB. b\nAC. c"), ("<ol type=i start=3><li>a<li type=I>b<li type=1>c</ol>", "iii. a\nIV. b\n5. c"), ("<ol reversed><li>a<li hidden>x<li>b<ol reversed start=9><li>c<li>d</ol></ol>", "2. a\n1. b\n   9. c\n   8. d"), ("<ol type=a start=-1><li>a<li>b<li>c</ol>", "-1. a\n0. b\na. c"),
        ("<ol reversed><li>a<li value=7>b<li>c</ol><ol><li>d</ol>", "3. a\n7. b\n6. c\n\n1. d"), ("<p class=h>x</p><p>y</p><style>.h{display:none}</style>", "y"), ("<style>.h{display:none}</style><p class='h g' style='display:block'>x", "x"), ("<style>.h{display:none!important}</style><p class='h g' style='display:block'>x</p>y", "y"),
        ("<style>a::before{content:'}'} .h{display:none}</style><p class=h>x</p>y", "y"), ("<style>.a{color:red; .h{display:none}} .a{display:none}</style><b class=h>x</b><b class=a>y</b>", "x"), ("<style type=text/x>.h{display:none}</style><b class=h>x</b>", "x"), ("<style>B, .É\n{DISPLAY:NONE}</style><b>x</b><i class=É>y</i>z", "z"),
        ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"), ("a<plaintext></p>b", "a</p>b"), ("x <b", "x <b"),
    ],
)
def test_shapes(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<b><div>" * 20_000 + "</b>" * 20_000 + "x", "<table><td>x" * 5000, "<table>" + "<tr><td rowspan=60000>x" * 8000, "<table><tr>" + "<td colspan=1000>x" * 20_000, "<ul>" + "<li>x<ul>" * 20_000, '<i b=">"' * 20_000 + "x", "<b style=visibility:hidden>" * 5000 + "</b>" * 5000 + "x", "<style>" + "".join(f".a{k},.b.a{k}{{display:none}}" for k in range(20_000)) + "</style>" + "<i class='b c'>x" * 20_000, "<ol reversed>" + "<li>x" * 50_000, "<style>" + "{" * 100_000 + "</style>x", "<style>" + "/*" * 100_000 + "</style>x"],
)
def test_time_and_text_of_large_pages(page):
    began = time.perf_counter()
    text = html.visible_text(page)
    assert time.perf_counter() - began < 10 and text.count("x") == page.count("x") and len(text) < 20 * len(page) + 2_000_000


def test_kept_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (None, None, None)], "page_id long, html string, text string")
    found = html.extract_text(rows, ("page_id", "text"))
    assert found.columns == ["page_id", "text_in", "text"] and Counter(map(tuple, found.collect())) == {(1, "u", "a"): 2, (None, None, ""): 1}
