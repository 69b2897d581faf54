"""What style sheets and style attributes say about display and visibility.

Rules are kept in order with their specificity and cascade as in a browser:
important declarations, then style attributes, then specificity, then order.
Selectors are compounds of a tag, classes and an id, joined by descendant and
child combinators; a selector with anything else is left out, the others of its
rule count.  Of conditional blocks those for all media and for screens without
further conditions count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# Keywords of the standard; a declaration with another one is no declaration.
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item run-in ruby table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption".split()
)
VISIBILITIES = frozenset("visible hidden collapse".split())
#: Longer selectors are left out.
LONGEST = 32

_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|url\([^)]*\)", re.I)
_MARK = re.compile(r"[{};]")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#]-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*)*)").fullmatch
_PART = re.compile(r"([.#])([^.#]+)")
_MEDIA = re.compile(r"(?:only\s+)?(?:all|screen)").fullmatch

Declarations = dict[str, tuple[bool, str]]


def _uncommented(text: str) -> str:
    """Text without comments; one that never ends takes the rest."""
    parts = text.split("/*")
    out = [parts[0]]
    for x in parts[1:]:
        _, end, rest = x.partition("*/")
        # "/*" inside a comment does not begin another one.
        if end:
            out.append(rest)
    return " ".join(out)


def declarations(text: str) -> Declarations:
    """display and visibility of a block of declarations, each with whether it is important; the last valid one counts."""
    found: Declarations = {}
    for one in text.split(";"):
        name, colon, value = one.partition(":")
        name = name.strip().lower()
        if not colon or name not in ("display", "visibility"):
            continue
        value = value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        words = value.split()
        good = len(words) == 1 and value in VISIBILITIES if name == "visibility" else bool(words) and all(w in DISPLAYS or w == "flow" for w in words)
        if good and (important or not found.get(name, (False, ""))[0]):
            found[name] = (important, "none" if value == "none" else value)
    return found


def inline(text: str) -> Declarations:
    """A style attribute's declarations."""
    return declarations(_STRING.sub("", _uncommented(text)))


def _compound(text: str) -> tuple[str, frozenset, frozenset] | None:
    """Tag (empty: any), classes and ids."""
    m = _COMPOUND(text)
    if not m or not text:
        return None
    parts = _PART.findall(m[2])
    return (m[1] or "*").lower().replace("*", ""), frozenset(x for k, x in parts if k == "."), frozenset(x for k, x in parts if k == "#")


def selector(text: str) -> tuple[list[list[tuple]], tuple[int, int, int]] | None:
    """Groups of compounds from right to left, each a chain of children from right to left, and the specificity."""
    words = text.replace(">", " > ").split()
    if not words or len(words) > LONGEST or words[0] == ">" or words[-1] == ">":
        return None
    groups, child, n = [[]], True, [0, 0, 0]
    for w in words:
        if w == ">":
            if child:
                return None
            child = True
            continue
        one = _compound(w)
        if one is None:
            return None
        if not child:
            groups.append([])
        groups[-1].append(one)
        n[0] += len(one[2])
        n[1] += len(one[1])
        n[2] += bool(one[0])
        child = False
    return [g[::-1] for g in reversed(groups)], (n[0], n[1], n[2])


def _applies(prelude: str) -> bool:
    name, _, media = prelude.partition(" ")
    return name.lower() == "@media" and any(_MEDIA(x.strip().lower()) for x in media.split(","))


def rules(sheet: str) -> Iterable[tuple[str, Declarations]]:
    """Selector list and declarations of each rule that counts, in order."""
    text = _STRING.sub("", _uncommented(sheet))
    applies, in_rule, nested, prelude, body, at = [], False, 0, "", "", 0
    for m in _MARK.finditer(text):
        mark, piece = m[0], text[at : m.start()]
        at = m.end()
        if in_rule:
            if mark == "{":
                nested += 1  # rules in rules are not followed
            elif nested:
                nested -= mark == "}"
            else:
                body += piece + ";"
                if mark == "}":
                    in_rule = False
                    if all(applies):
                        yield prelude, declarations(body)
        elif mark == "{":
            prelude = piece.strip()
            if prelude.startswith("@"):
                applies.append(_applies(prelude))
            else:
                in_rule, nested, body = True, 0, ""
        elif mark == "}" and applies:
            applies.pop()
    if in_rule and not nested and all(applies):
        yield prelude, declarations(body + text[at:])


class Sheets:
    """Rules by what their last compound asks for first."""

    def __init__(self, sheets: Iterable[str]):
        self.by: dict[tuple[str, str], list] = {}
        order = 0
        for sheet in sheets:
            for names, said in rules(sheet):
                order += 1
                for one in names.split(",") if said else ():
                    parsed = selector(one)
                    if parsed:
                        groups, weight = parsed
                        tag, classes, ids = groups[0][0]
                        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
                        self.by.setdefault(key, []).append((groups, weight, order, said))

    def __bool__(self) -> bool:
        return bool(self.by)

    def said(self, node, path: list) -> Declarations | None:
        """What the sheets and the node's own style say of it; path has its ancestors from the root."""
        own = node.attrs.get("class", "").split()
        keys = [("#", node.attrs.get("id", "")), *((".", c) for c in own), ("", node.tag), ("", "")]
        best: dict[str, tuple] = {}
        for key in dict.fromkeys(keys):
            for groups, weight, order, said in self.by.get(key, ()):
                if _matches(groups, node, path):
                    for name, (important, value) in said.items():
                        rank = (important, False, weight, order)
                        if name not in best or rank > best[name][0]:
                            best[name] = (rank, value)
        if not best:
            return None
        for name, (important, value) in node.own.items():
            rank = (important, True, (0, 0, 0), 0)
            if name not in best or rank > best[name][0]:
                best[name] = (rank, value)
        return {name: (rank[0], value) for name, (rank, value) in best.items()}


def _is(node, compound: tuple[str, frozenset, frozenset]) -> bool:
    tag, classes, ids = compound
    return (not tag or node.tag == tag) and (not ids or ids == {node.attrs.get("id")}) and (not classes or classes.issubset(node.attrs.get("class", "").split()))


def _matches(groups: list[list[tuple]], node, path: list) -> bool:
    """Whether the node ends a chain that the groups describe; of each group the nearest ancestors that fit leave most to the next."""
    chain = [*path, node]
    end = len(chain)
    for g, group in enumerate(groups):
        last = end - 1
        while True:
            if last - len(group) + 1 < 0:
                return False
            if all(_is(chain[last - i], c) for i, c in enumerate(group)):
                break
            if g == 0:
                return False
            last -= 1
        end = last - len(group) + 1
    return True


def sheets_of(root, tag: str, is_text: Callable) -> list[str]:
    """The texts of all elements of a tag, in the order of the page."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if is_text(x):
            continue
        if x.tag == tag:
            out.append("".join(c for c in x.children if is_text(c)))
        stack.extend(reversed(x.children))
    return out


def styled(root, is_text: Callable) -> None:
    """Sets said of every node of a tree to what its page's style sheets and its own style say."""
    sheets = Sheets(sheets_of(root, "style", is_text))
    if not sheets:
        return
    path: list = []
    stack = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        if leaving:
            path.pop()
            continue
        if is_text(node):
            continue
        said = sheets.said(node, path)
        if said is not None:
            node.said = said
        path.append(node)
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
