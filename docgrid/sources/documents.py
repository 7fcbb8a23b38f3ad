"""Parsers of documents into content blocks: web archives, DOCX, HTML pages, and a registry for remote parsers."""

from __future__ import annotations

import email
import email.policy
import html
import html.entities
import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import parser_kind

BLOCK = pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("page_num", pa.int32()), ("content", pa.string()), ("table_html", pa.string())])
SCHEMA = "blocks array<struct<ordinal:int,type:string,page_num:int,content:string,table_html:string>>, metadata map<string,string>, error string"

# Elements of web pages, their containers in order of preference, and header fields.
SKIPPED = frozenset(("script", "style", "noscript", "nav", "footer"))
TEXTS = frozenset(("p", "li", "h1", "h2", "h3"))
CONTAINERS = (("class", "key-content"), ("tag", "article"), ("tag", "main"), ("class", "info-content"), ("tag", "body"))
FIELDS = (("issuer", "发布机构"), ("doc_number", "文号"))
FIELD_END = r"(?=\s*(?:发布机构|文号|发布日期|发布时间)\s*[：:]|$)"
BOXES = frozenset(("", "div", "td", "th", "li", "article", "section", "main", "body"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class Node:
    def __init__(self, tag: str, classes: tuple[str, ...] = (), parent: Node | None = None):
        self.tag, self.classes, self.parent, self.children = tag, classes, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    yield " ".join(n.split())
            elif n.tag not in SKIPPED:
                stack += reversed(n.children)

    def text(self) -> str:
        return " ".join(self.strings())

    def find(self, kind: str, name: str) -> Node | None:
        return next((n for n in self.walk() if (n.tag == name if kind == "tag" else name in n.classes)), None)


class Tree(HTMLParser):
    """The element tree of a page; an open paragraph ends where the next block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in TEXTS | {"div", "table", "ul", "ol", "section", "article"}:
            n = self.now
            while n is not None and n.tag not in BOXES and n.tag != "p":
                n = n.parent
            if n is not None and n.tag == "p":
                self.now = n.parent
        n = Node(tag, tuple((dict(attrs).get("class") or "").split()), self.now)
        self.now.children.append(n)
        if tag not in VOID:
            self.now = n

    def handle_endtag(self, tag):
        n = self.now
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.now = n.parent

    def handle_data(self, data):
        self.now.children.append(data)


def table_html(node: Node) -> str:
    rows = ["".join(f"<{c.tag}>{html.escape(c.text())}</{c.tag}>" for c in r.walk() if c.tag in ("td", "th")) for r in node.walk() if r.tag == "tr"]
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"


def terminated(source: str) -> str:
    """The page with only those character references that end with their semicolon; of others the ampersand is a character."""
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z0-9]*;?)", lambda m: m[0] if m[1].startswith("#") or (m[1].endswith(";") and m[1] in html.entities.html5) else f"&amp;{m[1]}", source)


def html_blocks(source: str) -> tuple[list[dict], dict[str, str]]:
    """Blocks and header fields of a page: paragraphs, items, headings and tables of its content container."""
    t = Tree()
    t.feed(source or "")
    meta = {}
    if title := t.root.find("class", "info-title"):
        meta["title"] = title.text()
    if intro := t.root.find("class", "info-intro"):
        for field, label in FIELDS:
            if m := re.search(rf"{label}\s*[：:]\s*(.+?){FIELD_END}", intro.text()):
                meta[field] = m[1].strip()
    box = next((found for kind, name in CONTAINERS if (found := t.root.find(kind, name))), None)
    out: list[dict] = []
    some = False
    if box:
        stack = [box]
        while stack:
            n = stack.pop()
            if n.tag in SKIPPED:
                continue
            if n.tag == "table":
                some = True
                grid = table_html(n)
                out.append({"type": "table", "content": grid, "table_html": grid})
                continue
            if n.tag in TEXTS:
                some = True
                if text := n.text():
                    out.append({"type": "text", "content": text, "table_html": ""})
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        if not some:
            out = [{"type": "text", "content": s, "table_html": ""} for s in box.strings()]
    return [{"ordinal": k, "page_num": 0, **b} for k, b in enumerate(out)], meta


def parse_mhtml(data: bytes) -> tuple[list[dict], dict[str, str]]:
    message = email.message_from_bytes(data.lstrip(b"\xef\xbb\xbf\x00\r\n \t"), policy=email.policy.default)
    part = next((p for p in message.walk() if p.get_content_type() == "text/html"), None)
    if part is None:
        raise ValueError("the archive has no HTML part")
    try:
        text = part.get_content()
    except LookupError:  # a charset that nobody knows
        text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    return html_blocks(text)


def parse_docx(data: bytes) -> tuple[list[dict], dict[str, str]]:
    """Paragraphs and tables of a DOCX body, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ValueError("not a DOCX file") from e
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{WORD}p" and said(e):
            out.append({"type": "text", "content": said(e), "table_html": ""})
        elif e.tag == f"{WORD}tbl":
            rows = [[" ".join(filter(None, map(said, c.iter(f"{WORD}p")))) for c in r.findall(f"{WORD}tc")] for r in e.findall(f"{WORD}tr")]
            grid = "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
            if rows:
                out.append({"type": "table", "content": grid, "table_html": grid})
    return [{"ordinal": k, "page_num": 0, **b} for k, b in enumerate(out)], {}


Parser = Callable[[bytes], tuple[list[dict], dict[str, str]]]
PARSERS: dict[str, Parser] = {"mhtml": parse_mhtml, "docx": parse_docx}


def polled(submit: Callable[[bytes], str], status: Callable[[str], str], fetch: Callable[[str], tuple[list[dict], dict[str, str]]], pages: Callable[[bytes], int | None] = lambda data: None, every: float = 2.0, wait: Callable[[float], None] = time.sleep) -> Parser:
    """A parser out of a service that takes a file, is asked until it is done, and gives the blocks.

    It is waited for three seconds a page and a minute at least, five minutes where the pages aren't known.  A task that
    fails, or isn't done by then, raises ValueError, so that the file has an error.
    """

    def parse(data: bytes) -> tuple[list[dict], dict[str, str]]:
        task, n = submit(data), pages(data)
        left = 300.0 if n is None else max(60.0, 3.0 * n)
        while (now := status(task)) not in ("done", "failed"):
            if left <= 0:
                raise ValueError("the remote parser isn't done in time")
            wait(every)
            left -= every
        if now == "failed":
            raise ValueError("the remote parser failed")
        return fetch(task)

    return parse


def read_pdf(data: bytes) -> tuple[list[dict], dict[str, str]]:
    """Texts of PDF files that have any; to be given as ``remote`` where there is no better parser."""
    from .pdf import parse_pdf

    return parse_pdf(data)


def parse_files(files: DataFrame, remote: Parser | None = None) -> DataFrame:
    """``files`` (file_id, file_name, content) with blocks, metadata and error; ``remote`` takes what isn't parsed here.

    A file that can't be parsed, or has no text, has an error and no blocks.
    """
    parsers = PARSERS | ({"remote": remote} if remote else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, metas, errors = [], [], []
            for kind, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for {kind} files")
                    got, meta = parsers[kind](data or b"")
                    error = None if got else "the document is empty"
                except Exception as e:  # noqa: BLE001 - a damaged or encrypted file can fail in any way, and others go on
                    got, meta, error = [], {}, str(e) if isinstance(e, ValueError) else f"the file is damaged ({type(e).__name__}: {e})"
                blocks.append(got)
                metas.append(list(meta.items()))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blocks, pa.list_(BLOCK)), pa.array(metas, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], ["file_id", "file_name", "blocks", "metadata", "error"])

    rows = files.select("file_id", "file_name", parser_kind(F.col("file_name"), F.col("content")).alias("kind"), "content")
    return rows.mapInArrow(run, f"file_id string, file_name string, {SCHEMA}")


def page_blocks(pages: DataFrame, key: str = "page_id", source: str = "html", strict: bool = False) -> DataFrame:
    """key, ordinal, type, content of the blocks of HTML pages.

    As in browsers ``&amp`` without its semicolon is a reference too; with ``strict`` it is text.
    """
    read = (lambda t: html_blocks(terminated(t or ""))) if strict else html_blocks
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(t)[0] for t in b.column(1).to_pylist()], pa.list_(BLOCK))], [key, "blocks"])

    parsed = pages.select(key, source).mapInArrow(run, f"`{key}` {kind}, blocks array<struct<ordinal:int,type:string,page_num:int,content:string,table_html:string>>")
    return parsed.select(key, F.explode("blocks").alias("b")).select(key, "b.ordinal", "b.type", "b.content")


def read_artifacts(files: DataFrame, preferred: tuple[str, ...] = ("full.md", "auto.md")) -> DataFrame:
    """ZIP results of remote parsers: file_id, markdown, content_list (JSON text), images, error.

    The Markdown file is the first of the preferred names, else the first in the archive.
    """

    def open_one(data: bytes) -> tuple:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = z.namelist()
                marked = [n for n in names if n.lower().endswith(".md")]
                chosen = next((n for p in preferred for n in marked if n.rsplit("/", 1)[-1] == p), marked[0] if marked else None)
                lists = [n for n in names if n.endswith("content_list.json")]
                images = [n for n in names if n.lower().rsplit(".", 1)[-1] in ("png", "jpg", "jpeg", "gif", "webp")]
                text = z.read(chosen).decode("utf-8", "replace") if chosen else None
                return text, z.read(lists[0]).decode("utf-8", "replace") if lists else None, images, None if chosen else "no Markdown in the archive"
        except zipfile.BadZipFile:
            return None, None, [], "not a ZIP archive"
        except Exception as e:  # noqa: BLE001 - a damaged or encrypted member can fail in any way, and others go on
            return None, None, [], f"the archive is damaged ({type(e).__name__}: {e})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        for b in batches:
            got = list(zip(*map(open_one, b.column(1).to_pylist()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(got, kinds, strict=True)]], ["file_id", "markdown", "content_list", "images", "error"])

    return files.select("file_id", "content").mapInArrow(run, "file_id string, markdown string, content_list string, images array<string>, error string")
