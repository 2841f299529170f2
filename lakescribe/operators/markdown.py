"""Units of Markdown, in time that grows with the text: no pattern here looks at a character more than a few times.

Tags, links and emphasis are found by their delimiters: where the end of one is missing once, it is missing for all that
come later, so it isn't looked for again.
"""

from __future__ import annotations

import re

# Elements that are taken out whole, and what stands in their place.
UNSAFE_ELEMENTS = re.compile(r"<(script|style|iframe|form|object|embed)(?![\w-])", re.I)
REMOVED = "[unsafe embedded HTML removed]"
MARKERS = ("**", "__", "*", "`")

_LIST_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
_FENCE = re.compile(r"\s{0,3}(```+|~~~+)\s*([\w+-]*)")
_ATX = re.compile(r"\s{0,3}(#{1,6})(?=\s)")
_RULE = re.compile(r"\s{0,3}(=+|-{2,})\s*")
_CELL_RULE = re.compile(r":?-+:?")


def without_unsafe(text: str) -> str:
    """The text without elements that act: from the start tag to the end tag of its kind, or the tag alone where that is missing."""
    out, at, low, gone = [], 0, text.lower(), set()
    while (m := UNSAFE_ELEMENTS.search(text, at)) is not None:
        end = text.find(">", m.end())
        if end < 0:
            break
        tag, close = m[1].lower(), -1
        if tag not in gone and text[end - 1] != "/":
            close = _end_tag(low, tag, end + 1)
            if close < 0:
                gone.add(tag)  # no end tag from here on
        out += [text[at : m.start()], f"\n{REMOVED}\n" if close > 0 else REMOVED]
        at = close if close > 0 else end + 1
    return "".join(out) + text[at:] if out else text


def _end_tag(low: str, tag: str, at: int) -> int:
    """Where the next end tag of a kind ends, -1 if there is none."""
    while (k := low.find(f"</{tag}", at)) >= 0:
        end = low.find(">", k)
        if end < 0:
            return -1
        if not low[k + len(tag) + 2 : end].strip():
            return end + 1
        at = k + 1
    return -1


def without_tags(text: str) -> str:
    """The text without <...> of a character or more."""
    out, at = [], 0
    while (a := text.find("<", at)) >= 0:
        b = text.find(">", a + 1)
        if b < 0:
            break
        if b == a + 1:  # <> is no tag
            out.append(text[at : a + 1])
            at = a + 1
            continue
        out.append(text[at:a])
        at = b + 1
    return "".join(out) + text[at:] if out else text


def without_links(text: str) -> str:
    """[label](target) and ![label](target) by their labels."""
    out, at, look = [], 0, 0
    while (a := text.find("[", look)) >= 0:
        b = text.find("]", a + 1)
        if b < 0:
            break
        if text[b + 1 : b + 2] != "(":
            look = b + 1  # every bracket before b ends at b
            continue
        c = text.find(")", b + 2)
        if c < 0:
            break
        start = a - 1 if a > at and text[a - 1] == "!" else a
        out += [text[at:start], text[a + 1 : b]]
        at = look = c + 1
    return "".join(out) + text[at:] if out else text


def without_emphasis(text: str) -> str:
    """What stands between two equal markers without them; of markers at a place the longer is tried first."""
    out, at, look = [], 0, 0
    place = {m: text.find(m) for m in MARKERS}  # of each marker the next from look on; -1: there is none, or none that ends
    while True:
        for m, k in place.items():
            if 0 <= k < look:
                place[m] = text.find(m, look)
        open_ = [k for k in place.values() if k >= 0]
        if not open_:
            break
        first = look = min(open_)
        for m in MARKERS:
            if place[m] == first:
                end = text.find(m, first + len(m) + 1)
                if end >= 0:
                    out += [text[at:first], text[first + len(m) : end]]
                    at = look = end + len(m)
                    break
                place[m] = -1
    return "".join(out) + text[at:] if out else text


def plain(text: str) -> str:
    """A line without tags, links, images and emphasis."""
    if "<" in text:
        text = without_tags(text)
    if "[" in text:
        text = without_links(text)
    return without_emphasis(text).strip()


def _heading(line: str) -> tuple[int, str] | None:
    m = _ATX.match(line)
    if m is None:
        return None
    said = line[m.end() :].strip()
    bare = said.rstrip("#").rstrip()
    return len(m[1]), bare


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _table_rule(line: str) -> bool:
    """Whether a line parts a table's columns from its rows."""
    if "|" not in line or "-" not in line:
        return False
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") else body
    return all(_CELL_RULE.fullmatch(c.strip()) for c in body.split("|"))


def markdown_units(text: str | None) -> list[tuple]:
    """Headings, fenced code with its language, table rows with their columns, list items, quotes and paragraphs, as
    (kind, text, headings above, source location, code language, columns, line). Elements that act are taken out first."""
    units: list[tuple] = []
    headings: list[tuple[int, str]] = []
    held: list[str] = []
    source = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = without_unsafe(source).split("\n")

    def put(kind: str, value: str, at: int, language: str | None = None, columns: str | None = None) -> None:
        if value.strip():
            units.append((kind, value.strip() if kind != "code" else value, [h for _, h in headings], f"line {at + 1}", language, columns, at + 1))

    def flush(at: int) -> None:
        if held:
            put("paragraph", plain(" ".join(held)), at - len(held))
            held.clear()

    def heading(level: int, value: str, at: int) -> None:
        while headings and headings[-1][0] >= level:
            headings.pop()
        headings.append((level, value))
        put("heading", value, at)

    k = 0
    while k < len(lines):
        line = lines[k]
        bare = line.strip()
        under = lines[k + 1] if k + 1 < len(lines) else ""
        if not bare:
            flush(k)
        elif (fence := _FENCE.match(line)) is not None:
            flush(k)
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
            put("code", "\n".join(lines[k + 1 : end]), k, fence[2] or None)
            k = end
        elif (atx := _heading(line)) is not None:
            flush(k)
            heading(atx[0], plain(atx[1]), k)
        elif not held and "|" not in line and (rule := _RULE.fullmatch(under)) is not None:
            heading(1 if rule[1][0] == "=" else 2, plain(line), k)
            k += 1
        elif "|" in line and _table_rule(under):
            flush(k)
            columns, k = _cells(line), k + 2
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                row = _cells(lines[k])
                put("table_row", "; ".join(f"{c}: {plain(v)}" for c, v in zip(columns, row, strict=False)), k, None, " | ".join(columns))
                k += 1
            continue
        elif (item := _LIST_ITEM.match(line)) is not None:
            flush(k)
            put("list_item", plain(line[item.end() :]), k)
        elif bare.startswith(">"):
            flush(k)
            put("quote", plain(bare[1:]), k)
        else:
            held.append(bare)
        k += 1
    flush(len(lines))
    return units
