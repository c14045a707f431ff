"""Text of PDFs, page by page, with nothing but the standard library.

Reads objects, object streams and Flate streams, walks the page tree, and shows
what text operators draw, through a font's ToUnicode table where it has one.
Encrypted files and scanned pages have no text here.  Where ``pypdf`` is
installed on the workers it is used instead.
"""

from __future__ import annotations

import importlib.util
import io
import re
import zlib

#: Objects that a page's tree is deep, at most.
DEEPEST = 64

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\w'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class UnreadablePdf(ValueError):
    """Not a PDF, or one that can't be read."""


def _stream(body: bytes) -> bytes:
    start = re.search(rb"\bstream\r?\n", body)
    if not start:
        return b""
    data = body[start.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" in body[: start.start()]:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error as error:
            raise UnreadablePdf(f"a stream can't be unpacked: {error}") from error
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            count, first = (re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"N", b"First"))
            inner = _stream(body)
            if count and first:
                heads = [int(x) for x in inner[: int(first[1])].split()[: 2 * int(count[1])]]
                starts = [int(first[1]) + at for at in heads[1::2]]
                for number, start, end in zip(heads[::2], starts, [*starts[1:], len(inner)], strict=True):
                    found.setdefault(number, inner[start:end])
    return found


def _value(objects: dict[int, bytes], body: bytes, name: bytes) -> bytes:
    """What stands behind a name of a dictionary: followed if it is a reference, else up to its end."""
    at = re.search(rb"/%s\s*(?=[\[<(/\d])" % name, body)
    if not at:
        return b""
    rest = body[at.end() :]
    ref = _REF.match(rest)
    if ref:
        return objects.get(int(ref[1]), b"")
    closing = {b"<": b"<>", b"[": b"[]"}.get(rest[:1])
    if not closing:
        return rest.split(b"/")[0]
    depth = 0
    for k, c in enumerate(rest):
        depth += (c == closing[0]) - (c == closing[1])
        if not depth:
            return rest[: k + 1]
    return rest


def _pages(objects: dict[int, bytes], body: bytes, inherited: bytes = b"", deep: int = 0) -> list[tuple[bytes, bytes]]:
    """(page, resources) in order."""
    if deep > DEEPEST:
        raise UnreadablePdf("the tree of pages has no end")
    resources = _value(objects, body, b"Resources") or inherited
    kids = _value(objects, body, b"Kids")
    if not kids:
        return [(body, resources)]
    return [p for ref in _REF.finditer(kids) for p in _pages(objects, objects.get(int(ref[1]), b""), resources, deep + 1)]


def _unicode_table(objects: dict[int, bytes], font: bytes) -> dict[int, str]:
    table: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    cmap = _stream(_value(objects, font, b"ToUnicode"))
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        table |= {int(a, 16): text(b) for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, b in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", block):
            start = text(b)
            table |= {int(a, 16) + k: start[:-1] + chr(ord(start[-1]) + k) for k in range(min(int(z, 16) - int(a, 16) + 1, 65536))}
    return table


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].isspace() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _shown(objects: dict[int, bytes], content: bytes, resources: bytes) -> str:
    """What the text operators of a page draw; an operator that moves to another line ends one."""
    fonts = _value(objects, resources, b"Font")
    tables = {name: _unicode_table(objects, objects.get(int(ref), b"")) for name, ref in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts)}
    wide = {name for name, ref in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts) if b"/Type0" in objects.get(int(ref), b"")}
    out, held, font = [], [], b""

    def say(token: bytes) -> str:
        raw, table = _bytes_of(token), tables.get(font)
        codes = [int.from_bytes(raw[k : k + 2]) for k in range(0, len(raw), 2)] if font in wide else list(raw)
        return "".join(table.get(c, "") for c in codes) if table else raw.decode("cp1252", "replace")

    for m in _TOKEN.finditer(content):
        token = m[0]
        if token in (b"Tj", b"'", b'"'):
            out += ["\n"] * (token != b"Tj") + [say(t) for t in held[-1:] if t[:1] in b"(<"]
        elif token == b"TJ":
            for t in held:
                if t[:1] in b"(<":
                    out.append(say(t))
                elif re.fullmatch(rb"-\d+(\.\d+)?", t) and float(t) < -200:
                    out.append(" ")
        elif token in (b"T*", b"TD", b"Td", b"Tm", b"ET"):
            moved = token not in (b"TD", b"Td") or held[-1:] not in ([b"0"], [b"0.0"])
            out.append("\n" if moved else " ")
        elif token == b"Tf" and len(held) > 1:
            font = held[-2][1:]
        else:
            held.append(token)
            continue
        held = []
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def page_texts(data: bytes) -> list[str]:
    """The text of every page."""
    if data[:4] != b"%PDF":
        raise UnreadablePdf("not a PDF")
    if importlib.util.find_spec("pypdf") is not None:
        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    if b"/Encrypt" in data:
        raise UnreadablePdf("the file is encrypted")
    objects = _objects(data)
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    tree = _value(objects, root, b"Pages") if root is not None else b""
    if not tree:
        raise UnreadablePdf("the file has no pages")
    texts = []
    for page, resources in _pages(objects, tree):
        whole = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(_stream(objects.get(int(r[1]), b"")) for r in _REF.finditer(whole[1])) if whole else b""
        texts.append(_shown(objects, content, resources))
    return texts
