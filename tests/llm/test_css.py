"""The style cascade against a second, recursive resolver, and rules that real pages have."""

import random
import re

import pytest

from tidegrain.llm import css
from tidegrain.llm.html_text import visible_text


def shown(sheet, body):
    return re.findall(r"\w+", visible_text(f"<style>{sheet}</style>{body}"))


@pytest.mark.parametrize(
    ("sheet", "body", "want"),
    [
        ("p{display:none} p.s{display:block}", "<p>a<p class=s>b", "b"),
        (".menu{display:none} .menu.open{display:block}", "<div class=menu>a</div><div class='menu open'>b</div>", "b"),
        (".menu.open{display:block} .menu{display:none}", "<div class='menu open'>b</div>", "b"),
        ("p{display:none}</style><style>p{display:block}", "<p>a", "a"),
        ("", "<p style='display:none;display:block'>a<p style='display:block;display:none'>b", "a"),
        ("div p{display:none}", "<div><b><p>a</p></b></div><p>b", "b"),
        ("div > p{display:none}", "<div><b><p>a</p></b></div><div><p>b</div>", "a"),
        ("@media screen{p{display:none}} @media print{b{display:none}} @media screen and (max-width: 3px){i{display:none}}", "<p>a</p><b>b</b> <i>c</i>", "b c"),
        ("@media all, print{p{display:none}} @supports (x){b{display:none}} @font-face{a:b} i{display:none}", "<p>a</p><b>b</b><i>c</i>", "b"),
        ("p{visibility:hidden} .v{visibility:visible}", "<p>a <b class=v>b</b> c", "b"),
        ("p{display:none!important}", "<p style='display:block'>a<p style='display:block ! important'>b", "b"),
        ("[hidden]{display:block} p:hover, u{display:none}", "<p>a</p><u>b</u>", "a"),
        (".x{display:block}", "<p hidden class=x>a<p hidden>b", "a"),
        ("p{display:nonesense} b{display:none;display:wrong}", "<p>a</p><b>b</b>", "a"),
        ("p{content:'}b{display:none}'} /* i{display:none} */ u{display:none", "<p>a</p><b>b</b> <i>c</i> <u>d</u>", "a b c"),
        ("p{color:red; .q{display:none} } b{display:none}", "<p>a <i class=q>q</i></p><b>b</b>", "a q"),
        ("#a#b{display:none} #a{display:none}", "<p id=a>a<p id=b>b", "b"),
        ("*{display:none}", "<p>a", ""),
        ("div *{display:none} div *.k{display:inline}", "<div>a <b>b</b> <i class=k>c</i></div>", "a c"),
        ("p,{display:none} b{display:none}", "<p>a</p><b>b</b>", ""),
        ("dialog{display:block}", "<dialog>a</dialog>", "a"),
    ],
)
def test_rules(sheet, body, want):
    assert shown(sheet, body) == want.split()


def test_scripts_and_the_head_never_show():
    assert shown("script, title{display:block}", "<title>t</title><script>s</script>a") == ["a"]


def test_lists_and_rows():
    assert visible_text("<ol type=a start=26><li>x<li>y</ol>") == "z. x\naa. y"
    assert visible_text("<ol type=I reversed><li>x<li value=9>y<li>z</ol>") == "III. x\nIX. y\nVIII. z"
    assert visible_text("<ol start=0 type=A><li>x<li>y</ol>") == "0. x\nA. y"
    assert visible_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


def test_hostile_sheets_take_no_time():
    import time

    began = time.time()
    for sheet in ("/*" * 100_000, "{" * 100_000, "a{" * 50_000, "div " * 50_000 + "{display:none}", "a," * 50_000 + "a{display:none}", "'" * 100_001, "@media screen{" * 50_000, "url(" * 50_000, "p{display:" + "none " * 50_000):
        shown(sheet, "<p>a")
    deep = "<div class=a>" * 500 + "x"
    shown(" ".join(f"{'.a ' * 30}.b{i}{{display:none}} .a > .a .c > .a{{display:none}}" for i in range(200)), deep)
    assert time.time() - began < 20


TAGS, CLASSES, IDS = ["div", "span", "b", "section"], ["x", "y", "z"], ["i", "j"]


def test_random_sheets_cascade_as_a_recursive_resolver_has_it():
    r = random.Random(23)

    def compound():
        return (r.choice([*TAGS, "", ""]), frozenset(c for c in CLASSES if r.random() < 0.3), r.choice([None, None, None, *IDS]))

    def text_of(c):
        return (c[0] + "".join(f".{x}" for x in sorted(c[1])) + (f"#{c[2]}" if c[2] else "")) or "*"

    def said():
        return [(name, r.choice(values), r.random() < 0.15) for name, values in (("display", ["none", "block", "inline"]), ("visibility", ["hidden", "visible"])) if r.random() < 0.7]

    def block(d):
        return ";".join(f"{n}: {v}{' !important' if i else ''}" for n, v, i in d)

    def tree(depth):
        if depth == 0 or r.random() < 0.25:
            return f"w{r.randrange(10**6)}"
        return (r.choice(TAGS), frozenset(c for c in CLASSES if r.random() < 0.35), r.choice([None, None, *IDS]), said() if r.random() < 0.2 else [], r.random() < 0.1, [tree(depth - 1) for _ in range(r.randint(1, 4))])

    def page(n):
        if isinstance(n, str):
            return f" {n} "
        tag, classes, name, style, hidden, inside = n
        marks = (f" class='{' '.join(sorted(classes))}'" if classes else "") + (f" id={name}" if name else "") + (f" style='{block(style)}'" if style else "") + (" hidden" if hidden else "")
        return f"<{tag}{marks}>{''.join(map(page, inside))}</{tag}>"

    def fits(c, n):
        return (not c[0] or c[0] == n[0]) and c[1] <= n[1] and (c[2] is None or c[2] == n[2])

    def match(parts, chain):
        """parts: compounds with the combinator before each; every way of choosing ancestors is tried."""
        if not chain or not fits(parts[-1][1], chain[-1]):
            return False
        if len(parts) == 1:
            return True
        if parts[-1][0] == ">":
            return match(parts[:-1], chain[:-1])
        return any(match(parts[:-1], chain[:k]) for k in range(len(chain) - 1, 0, -1))

    def weight(parts):
        return (sum(c[2] is not None for _, c in parts), sum(len(c[1]) for _, c in parts), sum(bool(c[0]) for _, c in parts))

    def words(n, chain, sheet, seen):
        if isinstance(n, str):
            return [n] if seen else []
        chain = [*chain, n]
        value = {}
        for name in ("display", "visibility"):
            found = [(imp, 0, weight(parts), k, i, v) for k, (parts, d) in enumerate(sheet) if match(parts, chain) for i, (p, v, imp) in enumerate(d) if p == name]
            found += [(imp, 1, (0, 0, 0), 0, i, v) for i, (p, v, imp) in enumerate(n[3]) if p == name]
            value[name] = max(found)[-1] if found else None
        if value["display"] == "none" or value["display"] is None and n[4]:
            return []
        seen = value["visibility"] == "visible" if value["visibility"] else seen
        return [w for c in n[5] for w in words(c, chain, sheet, seen)]

    for _ in range(300):
        rules, text = [], ""
        for _ in range(r.randint(1, 6)):
            d, names = said(), []
            for _ in range(r.randint(1, 2)):
                parts = [("", compound())] + [(r.choice([" ", ">"]), compound()) for _ in range(r.randint(0, 3))]
                rules.append((parts, d))
                names.append("".join((f" {k} " if k == ">" else k) + text_of(c) for k, c in parts))
            text += ", ".join(names) + "{" + block(d) + "}\n"
        # The root element and the style element are there for both.
        t = ("div", frozenset(), None, [], False, [tree(5) for _ in range(3)])
        if any(match(p, [("html", frozenset(), None)]) for p, d in rules):
            continue
        assert re.findall(r"w\d+", visible_text(f"<style>{text}</style>{page(t)}")) == words(t, [("html", frozenset(), None)], rules, True), text


def test_specificity():
    assert css.selector("div > p.a.b #c *")[1] == (1, 2, 2)
    assert css.selector("p + b") is None and css.selector("a:hover") is None and css.selector("> p") is None and css.selector("") is None and css.selector("a > > b") is None
