"""Bounded readers of document formats: from an open file to a record of metadata.

A record is a dict: title, contributors, language, identifiers (name -> value), extra (name -> values). Each reader
takes what it needs from the file's ends and directories and never the whole file. Trouble is a ParseError with one
of five codes.
"""

from __future__ import annotations

import io
import lzma
import os
import re
import struct
import time
import zipfile
import zlib
from xml.etree import ElementTree

#: Fixed limits.
MOST_SOURCE = 4 << 30
MOST_READ = 64 << 20
MOST_XML = 4 << 20
MOST_ENTRIES = 10_000
MOST_SCALAR = 64 << 10
MOST_DEPTH = 128
MOST_SECONDS = 30.0

DC = "{http://purl.org/dc/elements/1.1/}"


class ParseError(ValueError):
    """code: MALFORMED, ENCRYPTED, UNSAFE, LIMIT or UNSUPPORTED."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


class BoundedFile(io.RawIOBase):
    """A file that counts what is read from it, and stops at its budget of bytes or time."""

    def __init__(self, path: str, most: int = MOST_READ, seconds: float = MOST_SECONDS):
        self.file = open(path, "rb", buffering=0)
        self.size = os.fstat(self.file.fileno()).st_size
        self.left, self.until, self.read_bytes = most, time.monotonic() + seconds, 0
        if self.size > MOST_SOURCE:
            self.file.close()
            raise ParseError("LIMIT", "the file is too large")

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def tell(self):
        return self.file.tell()

    def readinto(self, buffer):
        if time.monotonic() > self.until:
            raise ParseError("LIMIT", "reading takes too long")
        n = self.file.readinto(memoryview(buffer)[: self.left]) if self.left else 0
        if not n and len(buffer) and self.file.tell() < self.size:
            raise ParseError("LIMIT", "too much was read")
        self.left -= n
        self.read_bytes += n
        return n

    def at(self, offset: int, n: int) -> bytes:
        self.seek(offset)
        data = self.read(n)
        if len(data) < n:
            raise ParseError("MALFORMED", "the file ends early")
        return data

    def close(self):
        if hasattr(self, "file"):
            self.file.close()
        super().close()


#: What damaged entries of an archive raise, by their packing.
_DAMAGED = (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, RuntimeError, zlib.error, lzma.LZMAError)


def _record(title=None, contributors=(), language=None, identifiers=None, extra=None) -> dict:
    return {"title": title, "contributors": list(contributors), "language": language, "identifiers": identifiers or {}, "extra": extra or {}}


def _scalar(text: str | None) -> str | None:
    """Collapsed, None if nothing is left."""
    if text is None:
        return None
    if len(text.encode("utf-8", "replace")) > MOST_SCALAR:
        raise ParseError("LIMIT", "a value is too long")
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ") or None


def _xml(data: bytes) -> ElementTree.Element:
    """A small document without a document type or entities."""
    if len(data) > MOST_XML:
        raise ParseError("LIMIT", "an XML part is too large")
    if re.search(rb"<!(DOCTYPE|ENTITY)", data.replace(b"\0", b""), re.I):
        raise ParseError("UNSAFE", "a document type isn't allowed")
    depth, events = 0, ElementTree.XMLPullParser(("start", "end"))
    try:
        events.feed(data)
        events.close()
        root = None
        for kind, node in events.read_events():
            root = node if root is None else root
            depth += 1 if kind == "start" else -1
            if depth > MOST_DEPTH:
                raise ParseError("LIMIT", "XML is nested too deeply")
    except ElementTree.ParseError as e:
        raise ParseError("MALFORMED", str(e)) from None
    return root


def _zip(file: BoundedFile) -> zipfile.ZipFile:
    if file.at(0, min(8, file.size)) == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ParseError("ENCRYPTED", "a compound file holds the package")
    try:
        z = zipfile.ZipFile(file)
    except zipfile.BadZipFile as e:
        raise ParseError("MALFORMED", str(e)) from None
    names = [i.filename for i in z.infolist()]
    if len(names) > MOST_ENTRIES:
        raise ParseError("LIMIT", "too many entries")
    if len(set(names)) < len(names):
        raise ParseError("UNSAFE", "two entries have one name")
    for i in z.infolist():
        if i.flag_bits & 1:
            raise ParseError("ENCRYPTED", "an entry is encrypted")
        if i.filename.startswith("/") or "\\" in i.filename or ".." in i.filename.split("/"):
            raise ParseError("UNSAFE", "an entry leaves the archive")
    return z


def _entry(z: zipfile.ZipFile, name: str, most: int = MOST_XML) -> bytes:
    try:
        with z.open(name) as f:
            data = f.read(most + 1)
    except KeyError:
        raise ParseError("MALFORMED", f"{name} is missing") from None
    except _DAMAGED as e:
        raise ParseError("MALFORMED", str(e)) from None
    if len(data) > most:
        raise ParseError("LIMIT", f"{name} is too large")
    return data


def epub(file: BoundedFile) -> dict:
    z = _zip(file)
    if _entry(z, "mimetype", 256).strip() != b"application/epub+zip":
        raise ParseError("MALFORMED", "the media type differs")
    container = _xml(_entry(z, "META-INF/container.xml"))
    root = next((e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile")), None)
    if not root:
        raise ParseError("MALFORMED", "no package document is named")
    package = _xml(_entry(z, root))

    def values(name: str) -> list[str]:
        return [v for e in package.iter(DC + name) if (v := _scalar("".join(e.itertext())))]

    return _record(
        next(iter(values("title")), None),
        values("creator"),
        next(iter(values("language")), None),
        {f"identifier-{i}": v for i, v in enumerate(values("identifier"), 1)},
    )


def fb2(file: BoundedFile) -> dict:
    """Reads to the end of the description only."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    names, ns, title, language, people, ids, carry = [], "", None, None, [], {}, b""
    file.seek(0)
    while True:
        data = file.read(8192)
        if not data:
            raise ParseError("MALFORMED", "the description doesn't end")
        if re.search(rb"<!(DOCTYPE|ENTITY)", (carry + data).replace(b"\0", b""), re.I):
            raise ParseError("UNSAFE", "a document type isn't allowed")
        carry = data[-16:]
        try:
            parser.feed(data)
        except ElementTree.ParseError as e:
            raise ParseError("MALFORMED", str(e)) from None
        for kind, node in parser.read_events():
            name = node.tag.rpartition("}")[2]
            if kind == "start":
                names.append(name)
                if len(names) > MOST_DEPTH:
                    raise ParseError("LIMIT", "XML is nested too deeply")
                if len(names) == 1 and name != "FictionBook":
                    raise ParseError("MALFORMED", "no FictionBook")
                ns = node.tag[: -len(name)]
                continue
            path = "/".join(names[1:])
            if path == "description/title-info/book-title":
                title = _scalar("".join(node.itertext())) or title
            elif path == "description/title-info/lang":
                language = _scalar(node.text) or language
            elif path == "description/title-info/author":
                parts = [_scalar("".join(p.itertext())) for k in ("first-name", "middle-name", "last-name", "nickname") for p in node.findall(ns + k)]
                if whole := " ".join(filter(None, parts)):
                    people.append(whole)
            elif path == "description/document-info/id" and (v := _scalar(node.text)):
                ids.setdefault("fb2-document-id", v)
            elif path == "description/publish-info/isbn" and (v := _scalar(node.text)):
                ids.setdefault("isbn", v)
            names.pop()
            if path == "description":
                return _record(title, people, language, ids)


#: Fixed record types of a MOBI header.
EXTH = {100: "author", 104: "isbn", 113: "asin", 503: "title", 524: "language"}


def mobi(file: BoundedFile) -> dict:
    """Reads the directory, the first record's header and its EXTH records."""
    head = file.at(0, 78)
    if head[60:68] != b"BOOKMOBI":
        raise ParseError("UNSUPPORTED", "no MOBI database")
    if not (records := struct.unpack(">H", head[76:78])[0]):
        raise ParseError("MALFORMED", "no records")
    first = struct.unpack(">I", file.at(78, 4))[0]
    end = struct.unpack(">I", file.at(86, 4))[0] if records > 1 else file.size
    if not 78 + 8 * records <= first < end <= file.size:
        raise ParseError("MALFORMED", "the record directory is wrong")
    h = file.at(first, min(end - first, 132))
    if len(h) < 132 or h[16:20] != b"MOBI":
        raise ParseError("MALFORMED", "no MOBI header")
    if struct.unpack(">H", h[12:14])[0]:
        raise ParseError("ENCRYPTED", "the text is encrypted")
    size, codepage = struct.unpack(">I", h[20:24])[0], struct.unpack(">I", h[28:32])[0]
    encoding = {1252: "cp1252", 65001: "utf-8"}.get(codepage)
    if encoding is None:
        raise ParseError("UNSUPPORTED", "an unknown code page")
    at, n = struct.unpack(">II", h[84:92])
    if n > MOST_SCALAR:
        raise ParseError("LIMIT", "the name is too long")
    found: dict[str, list[str]] = {}
    name = _scalar(file.at(first + at, n).decode(encoding, "replace")) if n and first + at + n <= end else None
    if struct.unpack(">I", h[128:132])[0] & 0x40:
        at = first + 16 + size
        magic, total, count = struct.unpack(">4sII", file.at(at, 12))
        if magic != b"EXTH" or count > MOST_ENTRIES or at + total > end:
            raise ParseError("MALFORMED", "EXTH is wrong")
        stop, at = at + total, at + 12
        for _ in range(count):
            kind, n = struct.unpack(">II", file.at(at, 8))
            if n < 8 or at + n > stop:
                raise ParseError("MALFORMED", "an EXTH record is wrong")
            if kind in EXTH and (v := _scalar(file.at(at + 8, min(n - 8, MOST_SCALAR + 1)).decode(encoding, "replace"))):
                found.setdefault(EXTH[kind], []).append(v)
            at += n
    one = {k: v[0] for k, v in found.items()}
    return _record(one.get("title", name), found.get("author", ()), one.get("language"), {k: one[k] for k in ("isbn", "asin") if k in one})


#: Fixed names of a package's core properties, and what they are observed as.
DOCX_CORE = {k: k for k in ("title", "creator", "language", "identifier", "subject", "description", "keywords", "category")} | {"lastModifiedBy": "last-modified-by"}


def docx(file: BoundedFile) -> dict:
    z = _zip(file)
    names = set(z.namelist())
    types = _entry(z, "[Content_Types].xml")
    if any(n.lower().endswith("vbaproject.bin") for n in names) or b"macroEnabled" in types:
        raise ParseError("UNSAFE", "macros aren't allowed")
    if any("/embeddings/" in f"/{n}" or "oleobject" in n.lower() for n in names):
        raise ParseError("UNSAFE", "embedded objects aren't allowed")
    if "word/document.xml" not in names:
        raise ParseError("MALFORMED", "no document part")
    for n in names:
        if n.endswith(".rels") and any(e.get("TargetMode") == "External" for e in _xml(_entry(z, n)).iter()):
            raise ParseError("UNSAFE", "external relations aren't allowed")
    core: dict[str, str] = {}
    if "docProps/core.xml" in names:
        for e in _xml(_entry(z, "docProps/core.xml")):
            if (own := DOCX_CORE.get(e.tag.rpartition("}")[2])) and (v := _scalar("".join(e.itertext()))):
                core.setdefault(own, v)
    extra = {f"docx:core:{k}": [v] for k, v in core.items()}
    if "docProps/custom.xml" in names:
        pairs = ((_scalar(e.get("name")), _scalar("".join(e.itertext()))) for e in _xml(_entry(z, "docProps/custom.xml")))
        if custom := [f"{k}={v}" for k, v in pairs if k and v]:
            extra["docx:custom"] = custom
    ids = {"docx-core": core["identifier"]} if "identifier" in core else {}
    return _record(core.get("title"), [core["creator"]] if "creator" in core else (), core.get("language"), ids, extra)


def djvu(file: BoundedFile) -> dict:
    """Walks the chunks' headers; of their contents only the first page's measures and plain annotations."""
    if file.at(0, 8)[:8] != b"AT&TFORM":
        raise ParseError("UNSUPPORTED", "no DjVu file")
    pages, components, info, notes, walked, packed = 0, 0, None, {}, 0, False

    def walk(at: int, end: int, depth: int) -> None:
        nonlocal pages, components, info, walked, packed
        while at + 8 <= end:
            walked += 1
            if walked > MOST_ENTRIES or depth > MOST_DEPTH:
                raise ParseError("LIMIT", "too many chunks")
            name, n = struct.unpack(">4sI", file.at(at, 8))
            body = at + 8
            if body + n > end:
                raise ParseError("MALFORMED", "a chunk ends after its form")
            if name == b"FORM":
                kind = file.at(body, 4)
                pages += kind == b"DJVU"
                if kind in (b"DJVU", b"DJVM", b"DJVI"):
                    walk(body + 4, body + n, depth + 1)
            elif name == b"INFO" and info is None:
                w, h, _, dpi = struct.unpack(">HHH", file.at(body, 6)) + struct.unpack("<H", file.at(body + 6, 2))
                info = (w, h, dpi)
            elif name == b"ANTa":
                if n > MOST_SCALAR:
                    raise ParseError("LIMIT", "an annotation is too long")
                for k, v in re.findall(r'\(\s*([A-Za-z]+)\s+"((?:[^"\\]|\\.)*)"\s*\)', file.at(body, n).decode("utf-8", "replace")):
                    if v := _scalar(re.sub(r"\\(.)", r"\1", v)):
                        notes.setdefault(k.lower(), []).append(v)
            elif name == b"DIRM":
                components = components or struct.unpack(">H", file.at(body + 1, 2))[0]
            packed |= name in (b"ANTz", b"TXTa", b"TXTz")
            at = body + n + (n & 1)

    walk(4, file.size, 0)
    if not pages:
        raise ParseError("MALFORMED", "no page")
    extra = {"djvu:page-count": [str(pages)]}
    if components:
        extra["djvu:component-count"] = [str(components)]
    if info:
        extra |= {f"djvu:first-page-{k}": [str(v)] for k, v in zip(("width", "height", "dpi"), info, strict=True)}
    if packed:
        extra["djvu:compressed-metadata"] = ["present-not-decoded"]
    extra |= {f"djvu:metadata:{k}": v for k, v in notes.items()}
    one = {k: v[0] for k, v in notes.items()}
    return _record(one.get("title"), [one["author"]] if "author" in one else (), one.get("language"), {"isbn": one["isbn"]} if "isbn" in one else {}, extra)


from .pdf import pdf  # noqa: E402  it builds on what stands above

PARSERS = {"EPUB": epub, "FB2": fb2, "MOBI": mobi, "DOCX": docx, "DJVU": djvu, "PDF": pdf}
VERSIONS = {k: "1" for k in PARSERS}


def parse(path: str, fmt: str) -> tuple[dict | None, str | None, str | None, int]:
    """(record, error code, diagnostic, bytes read)."""
    if fmt not in PARSERS:
        return None, "UNSUPPORTED", "no reader for this format", 0
    try:
        file = BoundedFile(path)
    except OSError as e:
        return None, "MALFORMED", str(e)[:200], 0
    except ParseError as e:
        return None, e.code, str(e)[:200], 0
    with file:
        try:
            return PARSERS[fmt](file), None, None, file.read_bytes
        except ParseError as e:
            return None, e.code, str(e)[:200], file.read_bytes
        except (struct.error, UnicodeError, *_DAMAGED) as e:
            return None, "MALFORMED", str(e)[:200], file.read_bytes


def epub_violations(path: str) -> list[str]:
    """What keeps a converted EPUB from being published; empty if nothing does."""
    found = []
    try:
        with open(path, "rb") as f, zipfile.ZipFile(f) as z:
            entries = z.infolist()
            if not entries or entries[0].filename != "mimetype" or entries[0].compress_type != zipfile.ZIP_STORED:
                found.append("mimetype isn't the first entry and stored")
            if len(entries) > MOST_ENTRIES:
                found.append("too many entries")
            if sum(e.file_size for e in entries) > 1 << 30:
                found.append("too large")
            if any(e.file_size > 100 * max(1, e.compress_size) for e in entries):
                found.append("packed too tightly")
            if any(e.flag_bits & 1 for e in entries):
                found.append("encrypted")
            names = {e.filename for e in entries}
            container = _xml(_entry(z, "META-INF/container.xml"))
            root = next((e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile")), None)
            if root not in names:
                found.append("the package document is missing")
            else:
                _xml(_entry(z, root))
    except (ParseError, *_DAMAGED) as e:
        found.append(str(e)[:200])
    return found
