"""Units of HTML documents by a tag automaton on Arrow batches; units of the other kinds under the same names."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import units
from .delimited import parse_csv  # noqa: F401
from .markdown import markdown_units

UNIT = T.ArrayType(
    T.StructType([T.StructField("block_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("source_location", T.StringType()), T.StructField("code_language", T.StringType()), T.StructField("table_context", T.StringType()), T.StructField("title", T.StringType())])
)
# Elements whose content is never text, and what kind of unit an element is.
SKIPPED = frozenset("script style noscript template form iframe frame object embed canvas svg math link meta img picture video audio source track".split())
BLOCKS = {"blockquote": "blockquote", "code": "code", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list_item", "p": "paragraph", "pre": "code", "title": "title", "tr": "table_row"}
HIDDEN_STYLES = ("display:none", "visibility:hidden", "opacity:0")
TRACKERS = re.compile(r"\b(?:tracking-pixel|tracker|analytics-pixel)\b")
UNSAFE = re.compile(r"<!ENTITY\b|<!DOCTYPE\s+[^>]+\b(?:SYSTEM|PUBLIC)\b", re.I)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that a start tag closes, if they are open above any of the stops.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CELLS, SECTIONS = {"td", "th"}, {"thead", "tbody", "tfoot"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"})} | {x: (SECTIONS, {"table"}) for x in SECTIONS}
OF_HEAD = frozenset("base link meta noscript script style template title".split())
DEPTH = 512
#: Characters that a page may declare itself written in, and what they are read as.
CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decode_html(data: bytes | None) -> str:
    """By byte-order mark, then by what the first 1024 bytes declare, then UTF-8; what can't be read is replaced."""
    data = data or b""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    said = CHARSET.search(data[:1024])
    try:
        return data.decode(said[1].decode() if said else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


class _Element:
    __slots__ = ("tag", "path", "hidden", "children", "text_last", "parts", "unit")

    def __init__(self, tag: str, path: str, hidden: bool, unit: dict | None):
        self.tag, self.path, self.hidden, self.unit = tag, path, hidden, unit
        self.children, self.text_last = 0, False
        self.parts: list[str] = []  # texts of its children


def _block(text: str) -> str:
    """As functions.text.normalize_block."""
    lines = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\u00a0]+", " ", re.sub(r"\r\n?", "\n", text)))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


class _Units(HTMLParser):
    """Elements as they open and close; the outermost of a unit's kind collects the texts of all within."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units: list[dict] = []
        self.title: str | None = None
        self.open = [_Element("#document", "", False, None)]
        self.headings: list[tuple[int, str]] = []
        self.state = "before"  # then html, head, after, body

    def _put(self, tag: str, attrs: dict, void: bool = False) -> None:
        above = self.open[-1]
        above.children += 1
        above.text_last = False
        path = f"{above.path}/{tag}[{above.children}]"
        style = re.sub(r"\s+", "", attrs.get("style") or "").lower()
        named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        hidden = above.hidden or tag in SKIPPED or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or any(x in style for x in HIDDEN_STYLES) or TRACKERS.search(named) is not None
        if void or len(self.open) >= DEPTH + (64 if tag in BLOCKS else 0):
            return
        unit = above.unit
        if unit is None and not hidden and tag in BLOCKS:
            language = (attrs.get("class") or "").removeprefix("language-") if BLOCKS[tag] == "code" else ""
            unit = {"of": len(self.open), "kind": BLOCKS[tag], "path": path, "language": language or None, "tag": tag}
        self.open.append(_Element(tag, path, hidden, unit))

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            e = self.open.pop()
            text = ("\n" if e.tag in ("br", "td", "th") else " ").join(e.parts)
            if e.unit and e.unit["of"] == len(self.open):
                self._finish(e.unit, _block(text))
            elif e.unit and text and not e.hidden:
                self.open[-1].parts.append(text)

    def _finish(self, unit: dict, text: str) -> None:
        flat = re.sub(r"\s+", " ", text).strip()
        if unit["kind"] == "table_row":
            text = " | ".join(x for x in (re.sub(r"\s+", " ", c).strip() for c in text.split("\n")) if x)
        if not text:
            return
        if unit["kind"] == "title":
            self.title = flat
            return
        if unit["kind"] == "heading":
            level = int(unit["tag"][1])
            self.headings = [h for h in self.headings if h[0] < level] + [(level, flat)]
        self.units.append({"kind": unit["kind"], "text": text, "headings": [h for _, h in self.headings], "path": unit["path"], "language": unit["language"], "table": "HTML table" if unit["kind"] == "table_row" else None})

    def _within(self, state: str) -> None:
        """Opens what a page may leave out: html, head and body."""
        order = ("before", "html", "head", "after", "body")
        while order.index(self.state) < order.index(state):
            if self.state == "before":
                self._put("html", {})
                self.state = "html"
            elif self.state == "html":
                self._put("head", {})
                self.state = "head"
            elif self.state == "head":
                self._close(2)
                self.state = "after"
            else:
                self._put("body", {})
                self.state = "body"

    def handle_decl(self, decl: str) -> None:
        if self.state == "before":
            self.open[0].children += 1

    def handle_comment(self, data: str) -> None:
        self.open[-1].children += 1
        self.open[-1].text_last = False

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(reversed(attrs))  # of attributes that repeat the first counts
        if tag in ("html", "head", "body"):
            state = tag if tag != "head" else "head"
            order = ("before", "html", "head", "after", "body")
            if order.index(self.state) < order.index(state):
                self._within({"html": "before", "head": "html", "body": "after"}[tag])
                self._put(tag, a)
                self.state = state
            return
        if self.state != "body":
            self._within("head" if tag in OF_HEAD and self.state != "after" else "body")
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "button", "caption", "object", "template"})
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        self._put(tag, a, tag in VOID)
        if tag in ("title", "textarea"):  # no tags within, but character references
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def _end(self, tags: set[str], stops: set[str]) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._close(k)
                return True
            if self.open[k].tag in stops:
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.state == "head":
            self._within("after")
        elif tag not in ("html", "head", "body") and tag not in VOID:
            self._end({tag}, {"body", "head"} | ({"table"} if tag in ("p", "li") else set()))

    def handle_data(self, data: str) -> None:
        if self.state != "body" and not (self.state == "head" and len(self.open) > 3):
            if data.isspace():
                if self.state in ("head", "after") and not self.open[-1].text_last:
                    self.open[-1].children += 1
                    self.open[-1].text_last = True
                return
            self._within("body")
        e = self.open[-1]
        if e.tag in ("title", "textarea"):
            data = html.unescape(data)
        if not e.text_last:
            e.children += 1
            e.text_last = True
        elif e.parts and e.unit and not e.hidden:
            e.parts[-1] += data
            return
        if e.unit and not e.hidden:
            e.parts.append(data)


def html_units(page: str | None) -> list[tuple]:
    """Units of a page in order. A page that declares entities or an external type is refused: it has none."""
    if not page or UNSAFE.search(page):
        return []
    p = _Units()
    p.feed(page)
    p.close()
    p._close(1)
    return [(u["kind"], u["text"], u["headings"], u["path"], u["language"], u["table"], p.title) for u in p.units]


def _exploded(docs: DataFrame, keys: list[str], column: str, make: Callable) -> DataFrame:
    @F.pandas_udf(UNIT)
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(make)

    return docs.where(F.col(column).isNotNull()).select(*keys, F.posexplode(units(F.col(column))).alias("unit_index", "u")).select(*keys, "unit_index", "u.*")


def from_html(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """keys, unit_index, block_type, text, heading_path, source_location, code_language, table_context, title (of the page)."""
    return _exploded(pages, keys, column, html_units)


def from_html_bytes(pages: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return _exploded(pages, keys, column, lambda x: html_units(decode_html(x)))


def from_markdown(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """As from_html, of Markdown."""
    return _exploded(docs, keys, column, lambda x: [(*u[:6], None) for u in markdown_units(x)])


def from_csv(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, unit_index, block_type, text, row_start, row_end, table_context: whole rows under their columns' names."""
    from . import extraction

    return _registered(extraction.extracted(docs.select(*keys, F.lit("csv").alias("_kind"), F.col(column).cast("binary").alias("_content")), kind="_kind", content="_content"), keys)


def from_text(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, unit_index, block_type, text, line_start, line_end: lines, as units.from_text."""
    return units.from_text(docs, keys, column).withColumn("block_type", F.lit("text"))


def _registered(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, F.posexplode("units").alias("unit_index", "u")).select(*keys, "unit_index", "u.block_type", "u.text", "u.source_location", "u.row_start", "u.row_end", "u.table_context")


#: kind of file -> what makes its units; users may add their own.
EXTRACTORS: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {"html": from_html, "markdown": from_markdown, "text": from_text, "csv": from_csv}


def extract(docs: DataFrame, keys: list[str], kind: str = "kind", column: str = "text", extractors: dict[str, Callable] | None = None) -> DataFrame:
    """Units of all documents, each kind by its extractor (EXTRACTORS, or the caller's), a scan of docs for each; kinds without
    one give none. extraction.extracted() makes one pass for all kinds and says of each document why it has no units."""
    out = None
    for name, make in (extractors or EXTRACTORS).items():
        own = make(docs.where(F.col(kind) == name), keys, column)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
