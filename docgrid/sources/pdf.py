"""Texts of PDF files by page: objects, streams, fonts' character maps and text operators, with the standard library.

Reads classic and compressed object tables by scanning, Flate streams, and fonts that have a ``ToUnicode`` map or a
single-byte Latin encoding.  Encrypted files and other filters raise ValueError or give no text; pages that are pictures
have none.  Remote parsers are there for those.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
STREAM = re.compile(rb"stream\r?\n")
TOKEN = re.compile(rb"\s*(?:(\()|<([0-9A-Fa-f\s]*)>|(/[^\s/<>\[\]()%]*)|([-+]?\d*\.?\d+)|(\[)|(\])|(<<|>>)|([A-Za-z'\"*0-9]+)|(%[^\r\n]*)|(.))", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOST_STREAM = 64 << 20


class Pdf:
    """Objects of a file by number: (dictionary bytes, stream bytes or None)."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the PDF file is encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        starts = [(m.start(), m.end(), int(m[1])) for m in OBJECT.finditer(data)]
        for k, (_, begin, number) in enumerate(starts):
            stop = starts[k + 1][0] if k + 1 < len(starts) else len(data)
            body = data[begin:stop]
            found = STREAM.search(body)
            end = body.rfind(b"endstream") if found else -1
            if found and end > 0:
                self.objects[number] = (body[: found.start()], body[found.end() : end])
            else:
                self.objects[number] = (body.split(b"endobj")[0], None)
        for head, _ in list(self.objects.values()):
            if b"/ObjStm" in head:
                self._unpack(head)

    def _unpack(self, head: bytes) -> None:
        """Objects that are kept in a stream."""
        stream = next(s for h, s in self.objects.values() if h is head)
        text, first, n = inflated(head, stream), number_of(head, b"First"), number_of(head, b"N")
        index = [int(x) for x in text[:first].split()[: 2 * n]]
        places = list(zip(index[::2], index[1::2], strict=True))
        for k, (number, at) in enumerate(places):
            end = first + places[k + 1][1] if k + 1 < len(places) else len(text)
            self.objects.setdefault(number, (text[first + at : end], None))

    def entry(self, head: bytes, key: bytes) -> bytes:
        """The value of a key, followed if it is a reference; empty without one."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(?:(\d+)\s+\d+\s+R|(<<|\[|[^\s/<>\[\]]+|/[^\s/<>\[\]]+))", head)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), (b"", None))[0]
        if m[2] in (b"<<", b"["):
            return balanced(head, m.start(2))
        return m[2]

    def pages(self) -> list[bytes]:
        """Dictionaries of the pages in reading order, with what they inherit appended."""
        kinds = {n: h for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Page(?![A-Za-z])", h)}
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages(?![A-Za-z])", h) and b"/Parent" not in h]
        out, seen = [], set()
        todo = [(n, b"") for n in reversed(roots)]
        while todo:
            number, inherited = todo.pop()
            if number in seen or number not in self.objects:
                continue
            seen.add(number)
            head = self.objects[number][0]
            if number in kinds:
                out.append(head + inherited)
                continue
            kids = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", self.entry(head, b"Kids"))]
            above = self.entry(head, b"Resources")
            todo += [(k, b"/Resources " + above + inherited if above else inherited) for k in reversed(kids)]
        return out or [kinds[n] for n in sorted(kinds)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """Character maps of a page's fonts by name; None for a single-byte one."""
        listed = self.entry(self.entry(page, b"Resources") or page, b"Font")
        out: dict[bytes, dict[int, str] | None] = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            head = self.objects.get(int(number), (b"", None))[0]
            m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", head)
            out[name] = character_map(inflated(*self.objects[int(m[1])])) if m and int(m[1]) in self.objects else None
        return out

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        numbers = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
        return b"\n".join(inflated(*self.objects[n]) for n in numbers if n in self.objects)


def balanced(data: bytes, at: int) -> bytes:
    """A dictionary or array with all that is nested in it."""
    depth = 0
    for m in re.compile(rb"<<|>>|\[|\]").finditer(data, at):
        depth += 1 if m[0] in (b"<<", b"[") else -1
        if not depth:
            return data[at : m.end()]
    return data[at:]


def number_of(head: bytes, key: bytes) -> int:
    m = re.search(rb"/" + key + rb"\s+(\d+)", head)
    return int(m[1]) if m else 0


def inflated(head: bytes, stream: bytes | None) -> bytes:
    if stream is None:
        return b""
    if b"/Filter" not in head:
        return stream
    if b"FlateDecode" not in head or b"/Predictor" in head:
        return b""
    try:
        return zlib.decompressobj().decompress(stream, MOST_STREAM)
    except zlib.error:
        return b""


def _hex(text: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", text)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def character_map(text: bytes) -> dict[int, str]:
    """Codes and their characters from a ``ToUnicode`` map."""
    out: dict[int, str] = {}
    said = lambda h: _hex(h).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for code, to in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block):
            out[int.from_bytes(_hex(code))] = said(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for low, high, to, several in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[(.*?)\])", block, re.S):
            first, last = int.from_bytes(_hex(low)), int.from_bytes(_hex(high))
            if several:
                out |= {first + k: said(h) for k, h in enumerate(re.findall(rb"<([^>]*)>", several))}
            elif said(to):
                start = said(to)
                out |= {c: start[:-1] + chr(ord(start[-1]) + c - first) for c in range(first, min(last, first + 0xFFFF) + 1)}
    return out


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, from behind the first one, and where it ends."""
    out, depth, i = bytearray(), 1, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                i += 1 + len(octal[0])
                continue
            nxt = data[i + 1 : i + 2]
            out += b"" if nxt in b"\r\n" else ESCAPES.get(nxt, nxt)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), i + 1
        out += c
        i += 1
    return bytes(out), i


def page_text(content: bytes, fonts: dict[bytes, dict[int, str] | None]) -> str:
    """The text that a page shows, a line for each step downwards."""
    out: list[str] = []
    stack: list = []
    wide: dict[int, str] | None = None
    at, row = 0, 0.0

    def show(data: bytes) -> None:
        if wide is None:
            out.append(data.decode("cp1252", "replace"))
        else:
            step = 2 if wide and max(wide) > 255 else 1
            out.append("".join(wide.get(int.from_bytes(data[k : k + step]), "") for k in range(0, len(data), step)))

    while at < len(content):
        m = TOKEN.match(content, at)
        if not m:
            break
        at = m.end()
        if m[1]:
            data, at = _literal(content, at)
            stack.append(data)
        elif m[2] is not None:
            stack.append(_hex(m[2]))
        elif m[3]:
            stack.append(m[3])
        elif m[4]:
            stack.append(float(m[4]))
        elif m[8]:
            operator, numbers = m[8], [x for x in stack if isinstance(x, float)]
            if operator == b"Tf":
                wide = next((fonts.get(x[1:]) for x in stack if isinstance(x, bytes) and x[:1] == b"/"), None)
            elif operator in (b"Tj", b"'", b'"', b"TJ"):
                if operator in (b"'", b'"'):
                    out.append("\n")
                for x in stack:
                    if isinstance(x, float) and operator == b"TJ" and x < -200:
                        out.append(" ")
                    elif isinstance(x, bytes):
                        show(x)
            elif operator in (b"Td", b"TD") and len(numbers) >= 2:
                out.append("\n" if numbers[-1] else " ")
            elif operator == b"Tm" and len(numbers) >= 6:
                out.append("\n" if numbers[-1] != row else " ")
                row = numbers[-1]
            elif operator in (b"T*", b"ET"):
                out.append("\n")
            stack = []
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def parse_pdf(data: bytes) -> tuple[list[dict], dict[str, str]]:
    """Text blocks of a PDF file, one for each page that has text, and its information as metadata."""
    pdf = Pdf(data)
    pages = pdf.pages()
    texts = [page_text(pdf.content(p), pdf.fonts(p)) for p in pages]
    out = [{"ordinal": k, "page_num": n, "type": "text", "content": t, "table_html": ""} for k, (n, t) in enumerate((n, t) for n, t in enumerate(texts) if t)]
    meta = {"pages": str(len(pages))}
    if m := re.search(rb"/Title\s*\(", data):
        raw = _literal(data, m.end())[0]
        meta["title"] = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    return out, meta
