"""HTML pages to typed blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text, elements that end a block, and kinds by element.
DROPPED = frozenset("head script style svg noscript template".split())
SPACES = frozenset(["br", "hr"])
BREAKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_HEADING = re.compile(r"h([1-6])$")


class _Blocks(HTMLParser):
    """Collects one block per run of text between separators; the outermost quote or code wins over lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str]] = []
        self.open: list[str] = []
        self.notes = 0
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        head = next((m for t in reversed(self.open) if (m := _HEADING.match(t))), None)
        if "aside-note" in self.open:
            kind = "footnote"
        elif head:
            kind = "heading"
        elif "blockquote" in self.open:
            kind = "quote"
        elif "pre" in self.open:
            kind = "code"
        elif "li" in self.open:
            kind = "list_item"
        else:
            kind = "paragraph"
        self.out.append((kind, int(head[1]) if kind == "heading" else None, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        types = dict(attrs).get("epub:type") or dict(attrs).get("role") or ""
        if tag in SPACES:
            self.text.append(" ")
            return
        if tag in BREAKS:
            self.flush()
        if tag in {"img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed", "track"}:
            return
        if "noteref" in types:
            tag = "noteref"
        elif "footnote" in types or "endnote" in types:
            self.flush()
            self.open.append("aside-note")
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in SPACES:
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.flush()
        if tag not in self.open and not (tag == "a" and "noteref" in self.open):
            return
        while self.open:
            top = self.open.pop()
            if top == tag or (top == "noteref" and tag == "a"):
                break
        if self.open and self.open[-1] == "aside-note":
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not DROPPED.intersection(self.open) and "noteref" not in self.open:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self.text.append(data[6:])


def parse(page: str) -> list[tuple[str, int | None, str]]:
    """Kind, heading level and text of a page's blocks, in order."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            keys, rows = [], []
            for i, page in enumerate(batch.column(1).slice(a, 256).to_pylist()):
                for pos, block in enumerate(parse(page or "")):
                    keys.append(a + i)
                    rows.append((pos, *block))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, type=pa.int64())), pa.array(cols[0], type=pa.int32()), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.int32()), pa.array(cols[3], type=pa.string())],
                names=["page_id", "pos", "kind", "level", "text"],
            )


def html_blocks(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """``page_id, pos, kind, level, text`` of every page; a null page has no blocks."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(body).cast("string")).mapInArrow(_run, f"{key} {kind}, pos int, kind string, level int, text string")


def clean_text(value: str) -> str:
    return " ".join(html.unescape(value).split())
