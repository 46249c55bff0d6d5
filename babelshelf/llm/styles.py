"""Which elements the style sheets in a page hide: rules with simple selectors that set ``display`` or ``visibility``.

A selector is read if it is made of an element's name, classes and an id, or a ``*``; those that look at other elements,
at attributes or at states are not, and neither are rules that a condition guards, but for ``@media`` of all media or
screens. Of the declarations for an element the important ones win, then the style attribute's, then those of the more specific
selector, then the last.
"""

from __future__ import annotations

import re
from collections import defaultdict

_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[{};]|[^{};\"']++", re.S)
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SIMPLE = re.compile(r"([.#])([\w-]+)")
_MEDIA = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*", re.I)
NAMES = ("display", "visibility")
#: How strongly a declaration holds: important or not, of a style attribute or not, ids, classes and names in its selector, place.
Strength = tuple[bool, bool, int, int, int, int]


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of ``NAMES`` in a block or a style attribute; the last holds, unless an earlier one is important."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style.lower()).split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        if name in NAMES and value and (important or not found.get(name, (False, ""))[0]):
            found[name] = (important, value)
    return found


def rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of a sheet in order, without those that are guarded or nested in others."""
    found, prelude, block = [], "", ""
    open_: list[str] = []  # of the blocks that are open: "media", "rule" or "skip"
    for m in _TOKEN.finditer(_COMMENT.sub(" ", sheet)):
        token, inside = m[0], open_[-1] if open_ else "media"
        if token == "{":
            head = prelude.strip()
            kind = "skip" if inside != "media" else "media" if _MEDIA.fullmatch(head) else "skip" if head.startswith("@") else "rule"
            open_.append(kind)
            if kind == "rule":
                selectors, block = head, ""
            prelude = ""
        elif token == "}":
            if open_ and open_.pop() == "rule":
                found.append((selectors, block))
            prelude = ""
        elif inside == "rule":
            block += token
        elif token == ";":
            prelude = ""
        elif inside == "media":
            prelude += token
    if "rule" in open_:
        found.append((selectors, block))
    return found


class Styles:
    """The rules of all sheets of a page."""

    def __init__(self, sheets: list[str]):
        #: By an id, else a class, else the name of a selector: (name, id, classes, strength without importance, declarations).
        self.by_key: defaultdict[tuple[str, str], list[tuple]] = defaultdict(list)
        self.known: dict[tuple[str, str, str], dict[str, tuple[Strength, str]]] = {}
        place = 0
        for sheet in sheets:
            for selectors, block in rules(sheet):
                declarations = declared(block)
                if not declarations:
                    continue
                for selector in selectors.split(","):
                    m = _SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    place += 1
                    name = "" if m[1] in (None, "*") else m[1].lower()
                    ids = [x for kind, x in _SIMPLE.findall(m[2]) if kind == "#"]
                    classes = [x for kind, x in _SIMPLE.findall(m[2]) if kind == "."]
                    key = ("#", ids[0]) if ids else (".", classes[0]) if classes else ("", name)
                    self.by_key[key].append((name, set(ids), set(classes), (len(ids), len(classes), int(bool(name)), place), declarations))

    def of(self, tag: str, attributes: dict[str, str]) -> dict[str, str]:
        """The values of ``NAMES`` that hold for an element."""
        best = dict(self.matching(tag, attributes.get("id", ""), attributes.get("class", "")))
        for name, (important, value) in declared(attributes.get("style", "")).items():
            strength = (important, True, 0, 0, 0, 0)
            if name not in best or strength > best[name][0]:
                best[name] = strength, value
        return {name: value for name, (_, value) in best.items()}

    def matching(self, tag: str, own_id: str, class_list: str) -> dict[str, tuple[Strength, str]]:
        if not self.by_key:
            return {}
        looks = tag, own_id, class_list
        if looks not in self.known:
            classes, best = set(class_list.split()), {}
            for key in [("#", own_id), *((".", x) for x in classes), ("", tag), ("", "")]:
                for name, ids, needed, strength, declarations in self.by_key.get(key, ()):
                    if (not name or name == tag) and ids <= {own_id} and needed <= classes:
                        for what, (important, value) in declarations.items():
                            if what not in best or (important, False, *strength) > best[what][0]:
                                best[what] = (important, False, *strength), value
            self.known[looks] = best
        return self.known[looks]
