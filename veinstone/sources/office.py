"""Per-file readers for container formats Spark cannot read: DOCX, XLSX, HTML, CSV.

Each takes the bytes (or text) of one file and returns ``(units, warnings)``;
a unit is a tuple in the order of the chunker's unit schema.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from veinstone import fixed_values as fv

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADINGS = {f"h{n}" for n in range(1, 7)}
_BLOCKS = {"p", "li", "dt", "dd", "aside", "pre", "blockquote"}
_HIDDEN = {"script", "style", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}


def unit(text, heading=None, sheet=None, cells=None, table=False):
    return (text, heading, None, sheet, cells, table)


class Outline:
    """The current heading path; a skipped level does not pad it."""

    def __init__(self):
        self.path: list[str] = []

    def enter(self, level: int, title: str) -> None:
        self.path = [*self.path[:level - 1], title]

    def __str__(self) -> str:
        return " > ".join(self.path)


#: Open elements that a start tag ends, and the elements that this does not reach out of.
_ENDS = {**dict.fromkeys(_HEADINGS | _BLOCKS | {"table", "ul", "ol", "dl", "div", "section", "article", "hr", "form"}, {"p"}),
         "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
         "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
_KEEPS = {"table", "ul", "ol", "dl", "div", "section", "article", "aside", "blockquote", "form"}


class _Page(HTMLParser):
    """Document-order list of the wanted elements, each with the text that is its own.

    A text belongs to one element: the cell around it, else the innermost block or heading. Paragraphs,
    list items and the parts of tables end where HTML lets their end tags be left out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []      # [tag, record or None]
        self.count: dict[str, int] = {}
        self.found: list[dict] = []
        self.cells: list[dict] = []
        self.blocks: list[dict] = []

    def handle_starttag(self, tag, attrs):
        self._end_before(tag)
        record = None
        if tag in _HEADINGS | _BLOCKS | {"table", "tr", "td", "th"}:
            record = {"tag": tag, "text": [], "rows": []}
            if tag in _HEADINGS | _BLOCKS | {"table"}:
                record["in_cell"] = bool(self.cells)
                self.found.append(record)
            else:
                around = self._innermost("table" if tag == "tr" else "tr")
                if around is not None:
                    around["rows"].append(record)
        if tag not in _VOID:
            self.open.append([tag, record])
            self.count[tag] = self.count.get(tag, 0) + 1
            if tag in ("td", "th"):
                self.cells.append(record)
            elif tag in _HEADINGS | _BLOCKS:
                self.blocks.append(record)

    def _innermost(self, tag):
        return next((r for t, r in reversed(self.open) if t == tag), None) if self.count.get(tag) else None

    def _end_before(self, tag):
        ended = _ENDS.get(tag, ())
        if not any(map(self.count.get, ended)):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ended:
                self._close(i)
                if not any(map(self.count.get, ended)):
                    return
            elif self.open[i][0] in _KEEPS:
                return

    def _close(self, i):
        for tag, record in reversed(self.open[i:]):
            self.count[tag] -= 1
            if tag in ("td", "th"):
                self.cells.pop()
            elif tag in _HEADINGS | _BLOCKS:
                self.blocks.pop()
        del self.open[i:]

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._close(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag))

    def handle_data(self, data):
        piece = data.strip()
        owner = self.cells[-1] if self.cells else self.blocks[-1] if self.blocks else None
        if piece and owner is not None and not any(map(self.count.get, _HIDDEN)):
            owner["text"].append(piece)


def read_html(text: str):
    page = _Page()
    page.feed(text)
    page.close()
    units, outline, lines = [], Outline(), []

    def flush():
        joined = "\n".join(lines).strip()
        if joined:
            units.append(unit(html.unescape(joined), str(outline)))
        lines.clear()

    for element in page.found:
        words = " ".join(element["text"])
        if element["tag"] == "table":
            flush()
            if element["rows"]:
                units.append(unit("\n".join(" | ".join(" ".join(c["text"]) for c in row["rows"]) for row in element["rows"]),
                                  str(outline), table=True))
        elif element["tag"] in _HEADINGS and not element["in_cell"]:
            flush()
            outline.enter(int(element["tag"][1]), words)
        elif element["tag"] in _BLOCKS and words:
            lines.append(words)
    flush()
    return units, []


def read_docx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        body = ElementTree.fromstring(box.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in box.namelist():
            for style in ElementTree.fromstring(box.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = "" if name is None else name.get(f"{_W}val")

    def text_of(node):
        return "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or ""
                       for t in node.iter() if t.tag in {f"{_W}t", f"{_W}tab", f"{_W}br"})

    units, outline, lines, n_tables = [], Outline(), [], 0

    def flush():
        if lines:
            units.append(unit("\n".join(lines), str(outline)))
            lines.clear()

    for block in body:
        if block.tag == f"{_W}p":
            text = text_of(block).strip()
            style = block.find(f"{_W}pPr/{_W}pStyle")
            style_id = "" if style is None else style.get(f"{_W}val", "")
            name = names.get(style_id, style_id).lower()
            if text and name.startswith("heading"):
                flush()
                level = re.search(r"(\d+)$", name)
                outline.enter(int(level[1]) if level else 1, text)
            elif text:
                lines.append(text)
        elif block.tag == f"{_W}tbl":
            flush()
            n_tables += 1
            rows = [[" ".join("\n".join(text_of(p) for p in cell.iter(f"{_W}p")).strip().split("\n"))
                     for cell in row.findall(f"{_W}tc")] for row in block.findall(f"{_W}tr")]
            if rows:
                heading = f"{outline} > Table {n_tables}".strip(" >")
                units.append(unit("\n".join(" | ".join(r) for r in rows), heading, table=True))
    flush()
    return units, []


def _column(index: int) -> str:
    name = ""
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number


def _groups(rows: list, header: str, render):
    """25-row groups; every group but the first repeats the header line."""
    step = fv.ROWS_PER_TABLE_UNIT
    for start in range(0, len(rows), step):
        group = rows[start:start + step]
        lines = ([header] if start else []) + [render(r) for r in group]
        yield start, group, "\n".join(lines)


def read_xlsx(data: bytes):
    units, warnings = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        def tree(name):
            return ElementTree.fromstring(box.read(name))

        shared = []
        if "xl/sharedStrings.xml" in box.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t"))
                      for item in tree("xl/sharedStrings.xml").findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").iter(f"{_S}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            title, target = sheet.get("name"), targets[sheet.get(f"{_R}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            rows, widest = [], 0
            for row in tree(path).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for cell in row.findall(f"{_S}c"):
                    shown = _cell_text(cell, shared)
                    if cell.find(f"{_S}f") is not None and cell.find(f"{_S}v") is None:
                        warnings.append(f"{title}!{cell.get('r')} has no cached formula value")
                    if shown:
                        cells[_column_number(cell.get("r"))] = shown
                if cells:
                    widest = max(widest, max(cells))
                    rows.append((int(row.get("r")), [cells.get(i, "") for i in range(1, max(cells) + 1)]))
            header = " | ".join(rows[0][1]) if rows else ""
            for _, group, text in _groups(rows, header, lambda r: " | ".join(r[1])):
                area = f"A{group[0][0]}:{_column(widest)}{group[-1][0]}"
                units.append(unit(text, f"Worksheet: {title}", title, area, True))
    return units, list(dict.fromkeys(warnings))


def _cell_text(cell, shared: list[str]) -> str:
    kind, value, formula = cell.get("t"), cell.find(f"{_S}v"), cell.find(f"{_S}f")
    raw = None if value is None else value.text
    if kind == "s" and raw is not None:
        raw = shared[int(raw)]
    elif kind == "inlineStr":
        raw = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    elif kind == "b" and raw is not None:
        raw = "True" if raw == "1" else "False"
    if formula is not None:
        return f"{'[no cached value]' if raw is None else raw} (={formula.text or ''})"
    return raw or ""


def read_csv(text: str):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    header = " | ".join(rows[0]) if rows else ""
    units = [unit(body, None, None, f"row {start + 1}-{start + len(group)}", True)
             for start, group, body in _groups(rows, header, " | ".join)]
    return units, []
