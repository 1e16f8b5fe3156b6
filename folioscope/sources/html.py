"""HTML source: raw pages to blocks with roles by tag; one pass over Arrow batches, nothing shuffled."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Role by block tag.
ROLES = {"h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list_item", "td": "table_cell", "th": "table_cell", "figcaption": "caption", "pre": "code", "blockquote": "quote", "p": "body", "div": "body", "section": "body", "article": "body", "body": "body"}
SKIPPED = {"script", "style", "head", "template", "noscript"}


class Blocks(HTMLParser):
    """Blocks in document order: text goes to the innermost open block tag; ``br`` breaks the line; images give captions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.skip = 0
        self.captions: set[str] = set()

    def flush(self) -> None:
        t = "\n".join(x for x in (" ".join(part.split()) for part in "".join(self.text).split("\x01")) if x)
        if t:
            tag = self.open[-1] if self.open else "body"
            self.out.append((tag, ROLES[tag], t))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.text.append("\x01")
        elif tag == "img":
            for _, v in sorted((k, v) for k, v in attrs if k in ("alt", "title") and v and v.strip()):
                if v.strip() not in self.captions:
                    self.captions.add(v.strip())
                    self.flush()
                    self.out.append(("img", "caption", " ".join(v.split())))
        elif tag in ROLES:
            self.flush()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open:
            self.flush()
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str, str]]:
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag, role, text."""

    def run(batches):
        for batch in batches:
            rows = [(i, k, *b) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, b in enumerate(blocks_of(h))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], ["page_id", "ord", "tag", "role", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, ord int, tag string, role string, text string")
