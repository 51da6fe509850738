"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder turns tags into opened and closed elements, with the end tags that HTML lets authors leave out; a renderer
follows it with a stack of contexts. Hidden elements emit nothing, of svg its text is shown; blocks stand on lines of their own, paragraphs,
headings, lists and tables apart by an empty line; list items have a mark and an indent by depth; cells of a table are
aligned in columns; white space is collapsed except in preformatted text.

Defined results: null or empty html gives an empty text; unclosed, misnested or unknown tags never fail; nesting may be of
any depth (nothing recurses); rows with equal page_id are separate rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ship

# Element names by their part in layout.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noembed noframes xmp".split())
HIDDEN = (RAW - {"xmp"}) | set("head title object video audio canvas datalist".split())
#: Hidden within svg and math; what draws text within svg; start tags that end svg and math, unless in one of INNER.
UNDRAWN = set("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
DRAWN = ("text", "foreignobject")
INNER = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
OUTER = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Start tags that don't end the head.
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure hr".split())
BLOCK = SPACED | set("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = BLOCK - set("body html option optgroup tr caption thead tbody tfoot legend".split())
#: What an opening tag ends if it is open, and the elements that shield it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Elements that an end tag of another name doesn't reach through.
WALLS = {"table", "td", "th", "caption", "html"}
#: Columns wider than this aren't padded.
MAX_PAD = 80

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile("hidden|style", re.I)
_SELF_CLOSED = re.compile(r"""(?<!=)(?:\A|[\s"']|(?:\A|\s)[^\s"'=]+)/\Z""")
_START = re.compile(r"""\bstart\s*=\s*["']?(-?\d+)""", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), "".join(values))
    return out


def _hides(attrs: str) -> bool:
    """Whether a hidden attribute or the style hides the element."""
    if not _MAY_HIDE.search(attrs):
        return False
    found = _attributes(attrs)
    style = {k.strip(): v.split("!")[0].strip() for k, _, v in (x.partition(":") for x in found.get("style", "").lower().split(";"))}
    return "hidden" in found or style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")


class _Text:
    """Lines of one context: the page, or one cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space = 0, False
        self.lead = ""  # list mark of the line to come

    def flush(self, gap: int, indent: int) -> None:
        if self.parts:
            line = "".join(self.parts)
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.lines.append(" " * max(0, indent - 2) + self.lead + line if self.lead else " " * indent + line)
            self.parts, self.gap, self.lead = [], 0, ""
        self.gap, self.space = max(self.gap, gap), False

    def write(self, text: str) -> None:
        collapsed = _SPACE.sub(" ", text)
        bare = collapsed.strip(" ")
        if not bare:
            self.space = self.space or bool(collapsed)
            return
        if self.parts and (self.space or collapsed[0] == " "):
            self.parts.append(" ")
        self.parts.append(bare)
        self.space = collapsed[-1] == " "

    def verbatim(self, text: str, indent: int) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts += [first] if first else []
        for line in rest:
            if self.parts:
                self.flush(0, indent)
            elif self.lines:
                self.lines.append("")
            self.parts += [line] if line else []

    def done(self, indent: int) -> list[str]:
        self.flush(0, indent)
        return self.lines


class _Table:
    def __init__(self, out: _Text, indent: int):
        self.out, self.indent, self.rows = out, indent, []

    def lay(self) -> list[str]:
        width: list[int] = []
        for row in self.rows:
            for i, cell in enumerate(row):
                width += [0] * (i + 1 - len(width))
                width[i] = max(width[i], min(MAX_PAD, max(map(len, cell), default=0)))
        lines = []
        for row in self.rows:
            for k in range(max(map(len, row), default=0)):
                lines.append("  ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)).rstrip())
        return lines


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.out, self.tables, self.lists = _Text(), [], []
        self.hidden_from: int | None = None
        self.outer: list[tuple[_Text, list]] = []

    @property
    def indent(self) -> int:
        return 2 * len(self.lists)

    def _foreign(self) -> bool:
        return bool(self.count.get("svg") or self.count.get("math"))

    def _any(self, names: tuple[str, ...]) -> bool:
        return any(self.count.get(x) for x in names)

    def start(self, tag: str, attrs: str) -> None:
        if self.count.get("head"):
            if tag == "head":
                return
            if tag not in IN_HEAD:
                self._close_through("head", set())
        if tag in OUTER and self._foreign() and not self._any(INNER):
            while self._foreign():
                self._pop()
        if tag in VOID:
            if self.hidden_from is None and tag in ("br", "hr"):
                if tag == "br" and not self.out.parts and not self.out.gap and self.out.lines:
                    self.out.gap = 2
                self.out.flush(1 if tag == "br" else 2, self.indent)
            return
        if tag in CLOSES_P and self.count.get("p"):
            self._close_through("p", WALLS | {"button"})
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open and self.open[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop()
        if tag in IMPLIED:
            ends, shields = IMPLIED[tag]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at] in shields:
                    break
                if self.open[at] in ends:
                    last = at
                    while last and self.open[last - 1] in ends and tag in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                        last -= 1
                    while len(self.open) > last:
                        self._pop()
                    break
        if tag in ("td", "th") and self.count.get("table") and not self._in_row():
            self.start("tr", "")
        self._push(tag, attrs)

    def _in_row(self) -> bool:
        for name in reversed(self.open):
            if name in ("tr", "table"):
                return name == "tr"
        return False

    def _push(self, tag: str, attrs: str) -> None:
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        if self.hidden_from is not None:
            return
        if tag in HIDDEN or (tag in UNDRAWN and self._foreign()) or (tag == "dialog" and "open" not in _attributes(attrs)) or (attrs and _hides(attrs)):
            self.hidden_from = len(self.open) - 1
            return
        if tag == "text":
            self.out.space = True
        if tag in BLOCK:
            self.out.flush(2 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 1, self.indent)
        if tag in ("ul", "ol", "menu", "dir"):
            begin = _START.search(attrs)
            self.lists.append(None if tag != "ol" else int(begin[1]) - 1 if begin else 0)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.out.lead = "- " if not self.lists or self.lists[-1] is None else f"{self.lists[-1]}. "
        elif tag == "table":
            self.tables.append(_Table(self.out, self.indent))
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            self.outer.append((self.out, self.lists))
            self.out, self.lists = _Text(), []

    def _pop(self) -> None:
        tag = self.open.pop()
        self.count[tag] -= 1
        if self.hidden_from is not None:
            if len(self.open) == self.hidden_from:
                self.hidden_from = None
            return
        if tag == "text":
            self.out.space = True
        if tag in BLOCK:
            self.out.flush(2 if tag in SPACED and not (tag in ("ul", "ol") and len(self.lists) > 1) else 1, self.indent)
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag == "li":
            self.out.lead = ""
        elif tag in ("td", "th") and self.outer and self.tables:
            lines = self.out.done(self.indent)
            self.out, self.lists = self.outer.pop()
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(lines)
        elif tag == "table" and self.tables:
            table = self.tables.pop()
            lines = table.lay()
            if lines:
                if self.out.lines:
                    self.out.lines.append("")
                self.out.lines += [" " * self.indent + x if x else x for x in lines]
                self.out.gap = 2

    def _close_through(self, tag: str, walls: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] == tag:
                while len(self.open) > at:
                    self._pop()
                return
            if self.open[at] in walls:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.count.get("p"):
            self.start("p", "")
            self._pop()
        elif self.count.get(tag):
            self._close_through(tag, WALLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {tag})

    def text(self, raw: str) -> None:
        if self.open and self.open[-1] == "head" and raw.strip(" \t\n\r\f"):
            self._close_through("head", set())
        if self.hidden_from is not None or not raw or (self.count.get("svg") and not self._any(DRAWN)):
            return
        text = html.unescape(raw) if "&" in raw and not self.count.get("xmp") else raw
        if self.count.get("xmp") or self.count.get("pre") or self.count.get("textarea"):
            self.out.verbatim(text, self.indent)
        else:
            self.out.write(text)

    def close(self) -> str:
        while self.open:
            self._pop()
        return "\n".join(self.out.done(0))


def render(source: str | None) -> str:
    """The visible text of one page."""
    if not source:
        return ""
    page, at, low = Page(), 0, None
    while True:
        m = _TOKEN.search(source, at)
        if not m:
            page.text(source[at:])
            return page.close()
        page.text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3])
        if tag not in VOID and page.open and page.open[-1] == tag and page._foreign() and not page.count.get("foreignobject") and _SELF_CLOSED.search(m[3]):
            page._pop()
            continue
        if tag in RAW or tag in ("title", "textarea"):
            low = source.lower() if low is None else low
            if len(low) != len(source):  # lower-casing may lengthen some letters
                low = re.sub("[A-Z]", lambda c: c[0].lower(), source)
            stop = low.find(f"</{tag}", at)
            stop = len(source) if stop < 0 else stop
            page.text(source[at:stop])
            at = stop
            if stop == len(source):
                return page.close()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, n_chars, text for every row of pages (page_id, html)."""
    ship(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], ["page_id", "n_chars", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(work, "page_id long, n_chars long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
