"""Textbook pages: HTML to sections, small ones merged forward (exercises stand alone)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of fewer tokens are merged with the next.
LEAST_TOKENS = 100

_CHUNK = "page string, place int, section_title string, section_path array<string>, anchor_id string, text string, code_blocks array<string>, token_count int"
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Sections(HTMLParser):
    """Collects sections: headings h1 to h4 of class 'section', prose of class 'doc', code of class 'code'."""

    def __init__(self, chapter: str) -> None:
        super().__init__(convert_charrefs=True)
        self.titles, self.sections = {0: chapter}, []
        self.open: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.heading = self.anchor = None
        self.start(chapter, None)

    def start(self, title: str, anchor: str | None) -> None:
        self.current = {"title": title, "path": [self.titles[k] for k in sorted(self.titles)], "anchor": anchor, "prose": [], "code": []}
        self.sections.append(self.current)

    def inside(self, kind: str) -> bool:
        return any(k == kind for _, k in self.open)

    def flush(self, kind: str) -> None:
        text, self.text = "".join(self.text), []
        if kind == "code":
            lines = [x.rstrip() for x in text.split("\n")]
            text = "\n".join(lines).strip("\n")
            if text.strip():
                self.current["code"].append(text)
                self.current["prose"].append(text)
        elif text.strip():
            self.current["prose"].append(text.strip())

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            return
        values = dict(attrs)
        classes, kind = (values.get("class") or "").split(), ""
        if tag == "a" and (values.get("id") or values.get("name") or "").startswith("lab"):
            self.anchor = values.get("id") or values.get("name")
        if tag in ("h1", "h2", "h3", "h4") and "section" in classes:
            self.flush("doc")
            kind, self.heading = "heading", int(tag[1])
        elif tag == "div" and "code" in classes:
            kind = "code"
        elif tag == "div" and "doc" in classes:
            kind = "doc"
        elif tag in ("script", "style", "nav"):
            kind = "skip"
        self.open.append((tag, kind))

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            name, kind = self.open.pop()
            if kind == "heading":
                title, self.text = " ".join("".join(self.text).split()), []
                self.titles = {k: v for k, v in self.titles.items() if k < self.heading} | {self.heading: title}
                self.start(title, self.anchor)
                self.anchor = None
            elif kind in ("doc", "code"):
                self.flush(kind)
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.inside("skip") and (self.inside("doc") or self.inside("code") or self.inside("heading")):
            self.text.append(data)


def sections(html: str | None, chapter: str) -> list[dict]:
    """Sections of one page with their text; blank ones are left out."""
    parser = _Sections(chapter)
    parser.feed(html or "")
    parser.close()
    out = []
    for s in parser.sections:
        text = "\n\n".join(s["prose"])
        if text.strip():
            out.append({"section_title": s["title"], "section_path": s["path"], "anchor_id": s["anchor"], "text": text, "code_blocks": s["code"], "token_count": len(text.split())})
    return out


def merge_small(parts: list[dict], least: int = LEAST_TOKENS) -> list[dict]:
    """Sections of fewer than ``least`` tokens joined with the one behind, under the first one's title;
    exercises neither take nor are taken."""
    out, held = [], None
    for part in parts:
        exercise = "Exercise" in part["section_title"]
        if held is not None:
            if exercise:
                out.append(held)
                held = None
            else:
                text = f"{held['text']}\n\n{part['text']}"
                part = held | {"text": text, "code_blocks": held["code_blocks"] + part["code_blocks"], "token_count": len(text.split())}
                held = None
        if not exercise and part["token_count"] < least:
            held = part
        else:
            out.append(part)
    return out + ([held] if held else [])


def chunk_pages(pages: DataFrame, page: str = "page", html: str = "html", chapter: str = "chapter") -> DataFrame:
    """Chunks of each page (page, html, chapter), numbered by ``place``. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
        names = ["page", "place", "section_title", "section_path", "anchor_id", "text", "code_blocks", "token_count"]
        for batch in batches:
            rows = []
            for p, h, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [{"page": p, "place": k, **part} for k, part in enumerate(merge_small(sections(h, c or "")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return pages.select(F.col(page).cast("string"), html, chapter).mapInArrow(run, _CHUNK)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, html, chapter) of the HTML files under ``path``; the chapter is the file's stem."""
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("html"), F.regexp_extract("_metadata.file_name", r"^(.*)\.html$", 1).alias("chapter"))
