"""Metadata of PDF files: the Info dictionary, the XMP packet and the number of pages.

Only what leads there is read: the file's end, cross-reference tables and streams of all its revisions, the objects on the way
and the object streams they are packed in. All reads count against the file's budget, and what is unpacked is bounded.
An encrypted file is refused whatever its password. A file whose cross-references don't lead to its objects is
MALFORMED; none is rebuilt by searching for objects.
"""

from __future__ import annotations

import re
import zlib
from datetime import UTC, datetime, timedelta, timezone
from typing import NamedTuple

from .parsers import DC, MOST_DEPTH, MOST_ENTRIES, MOST_SCALAR, MOST_XML, BoundedFile, ParseError, _record, _xml

MOST_PAGES = 100_000
MOST_INFO_FIELDS = 256
#: Bytes of one object without its stream, bytes of a packed stream, bytes it may be unpacked to, revisions, objects of a file.
MOST_OBJECT, MOST_PACKED, MOST_UNPACKED, MOST_REVISIONS, MOST_OBJECTS = 1 << 20, 16 << 20, 64 << 20, 1024, 1 << 22
HEADER, TAIL = 1024, 2048

_BLANK = b"\0\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_regular = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_number = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_escapes = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
#: The characters of PDFDocEncoding that aren't those of Latin-1, by code. Fixed values.
_DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(
    zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)
)
_DOC[0xA0] = "€"


class Name(str):
    pass


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    entries: dict
    at: int


class Keyword(bytes):
    pass


class _Short(Exception):
    """The bytes at hand end within an object."""


class _Scanner:
    """Objects from bytes that may end too early."""

    def __init__(self, data: bytes, whole: bool):
        self.data, self.at, self.whole = data, 0, whole

    def _skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _BLANK:
                self.at += 1
            elif d[self.at] == 0x25:  # a comment
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return
        self._short()

    def _short(self):
        raise ParseError("MALFORMED", "an object isn't complete") if self.whole else _Short

    def value(self, depth: int = 0):
        if depth > MOST_DEPTH:
            raise ParseError("LIMIT", "objects are nested too deeply")
        self._skip()
        d, at = self.data, self.at
        if d[at : at + 2] == b"<<":
            self.at += 2
            return self._dict(depth)
        first = d[at : at + 1]
        if first == b"(":
            return self._literal()
        if first == b"<":
            end = d.find(b">", at)
            if end < 0:
                self._short()
            self.at = end + 1
            digits = re.sub(rb"[\0\t\n\x0c\r ]", b"", d[at + 1 : end])
            if re.search(rb"[^0-9A-Fa-f]", digits):
                raise ParseError("MALFORMED", "a string isn't hexadecimal")
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if first == b"[":
            self.at += 1
            found = []
            while True:
                self._skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return found
                self._put(found, self.value(depth + 1))
        if first == b"/":
            match = _regular.match(d, at + 1)
            self.at = match.end() if match else at + 1
            if self.at == len(d) and not self.whole:
                raise _Short
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), match[0] if match else b"")
            return Name(raw.decode("utf-8", "replace"))
        match = _regular.match(d, at)
        if not match:
            raise ParseError("MALFORMED", "an object begins with a stray delimiter")
        self.at = match.end()
        if self.at == len(d) and not self.whole:
            raise _Short
        word = match[0]
        if _number.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Keyword(word))

    @staticmethod
    def _put(found: list, value) -> None:
        """Adds a value; `n g R` becomes a reference."""
        if value == b"R" and isinstance(value, Keyword) and len(found) > 1 and all(type(x) is int for x in found[-2:]):
            found[-2:] = [Ref(*found[-2:])]
        elif isinstance(value, Keyword):
            raise ParseError("MALFORMED", "a word stands for an object")
        else:
            found.append(value)

    def _dict(self, depth: int) -> dict:
        found: list = []
        while True:
            self._skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            if len(self.data) - self.at < 2 and not self.whole:
                raise _Short
            self._put(found, self.value(depth + 1))
        if len(found) % 2 or not all(isinstance(k, Name) for k in found[::2]):
            raise ParseError("MALFORMED", "a dictionary isn't made of pairs")
        return dict(zip(found[::2], found[1::2], strict=True))

    def _literal(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at]
            at += 1
            if c == 0x5C:  # a backslash
                if at >= len(d):
                    break
                c = d[at]
                if 0x30 <= c <= 0x37:
                    digits = re.compile(rb"[0-7]{1,3}").match(d, at)
                    out.append(int(digits[0], 8) & 255)
                    at = digits.end()
                    continue
                at += 1
                if c == 13:  # a line that goes on
                    at += d[at : at + 1] == b"\n"
                elif c != 10:
                    out += _escapes.get(c, bytes([c]))
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at
                    return bytes(out)
            elif c == 13:
                at += d[at : at + 1] == b"\n"
                c = 10
            out.append(c)
        self._short()


class _Document:
    def __init__(self, file: BoundedFile):
        self.file = file
        head = file.at(0, min(file.size, HEADER))
        self.base = head.find(b"%PDF-")
        if self.base < 0:
            raise ParseError("MALFORMED", "no PDF header")
        tail = file.at(max(0, file.size - TAIL), min(file.size, TAIL))
        found = re.findall(rb"startxref[\0\t\n\x0c\r ]+(\d+)", tail)
        if not found:
            raise ParseError("MALFORMED", "the end names no cross-references")
        #: Of each object the offset, or (object stream, index); newer revisions come first.
        self.places: dict[int, int | tuple[int, int] | None] = {}
        self.trailer: dict = {}
        self.packed: dict[int, list] = {}
        self._revisions(int(found[-1]))
        if "Encrypt" in self.trailer:
            raise ParseError("ENCRYPTED", "the file is encrypted")

    def _revisions(self, at: int) -> None:
        waiting, seen = [at], set()
        while waiting:
            at = waiting.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if len(seen) > MOST_REVISIONS:
                raise ParseError("LIMIT", "too many revisions")
            whole = self.base + at
            mark = self.file.at(whole, min(4, max(0, self.file.size - whole)))
            entries = self._table(whole) if mark == b"xref" else self._table_stream(whole)
            for k, v in entries.items():
                self.trailer.setdefault(k, v)
            # a hybrid file's stream counts before the older revision
            waiting += [entries[k] for k in ("XRefStm", "Prev") if type(entries.get(k)) is int]

    def _known(self, number: int, place) -> None:
        if len(self.places) > MOST_OBJECTS:
            raise ParseError("LIMIT", "too many objects")
        self.places.setdefault(number, place)

    def _table(self, at: int) -> dict:
        at += 4
        while True:
            line = re.match(rb"[\0\t\n\x0c\r ]*(?:(\d+) +(\d+)[\t\x0c ]*(?:\r\n|\r|\n)|(trailer))", self.file.at(at, min(64, self.file.size - at)))
            if not line:
                raise ParseError("MALFORMED", "a cross-reference section has no heading")
            at += line.end()
            if line[3]:
                entries, _ = self._parsed(at)
                if not isinstance(entries, dict):
                    raise ParseError("MALFORMED", "a trailer isn't a dictionary")
                return entries
            first, n = int(line[1]), int(line[2])
            if n > MOST_OBJECTS:
                raise ParseError("LIMIT", "too many objects")
            rows = self.file.at(at, 20 * n)
            for k in range(n):
                row = re.fullmatch(rb"(\d{10}) (\d{5}) ([nf])[\r\n ]{1,2}", rows[20 * k : 20 * k + 20])
                if not row:
                    raise ParseError("MALFORMED", "a cross-reference isn't 20 bytes long")
                self._known(first + k, int(row[1]) if row[3] == b"n" else None)
            at += 20 * n

    def _table_stream(self, at: int) -> dict:
        stream = self._object_at(at)
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise ParseError("MALFORMED", "the end leads to no cross-references")
        entries = stream.entries
        widths, size = entries.get("W"), entries.get("Size")
        if not (isinstance(widths, list) and len(widths) == 3 and all(type(w) is int and 0 <= w <= 8 for w in widths) and type(size) is int):
            raise ParseError("MALFORMED", "a cross-reference stream lacks its widths")
        sections = entries.get("Index", [0, size])
        if not (isinstance(sections, list) and len(sections) % 2 == 0 and all(type(x) is int and x >= 0 for x in sections)):
            raise ParseError("MALFORMED", "a cross-reference stream's sections aren't pairs")
        data, step, at = self.unpacked(stream), sum(widths), 0
        for first, n in zip(sections[::2], sections[1::2], strict=True):
            if step == 0 or len(data) < at + n * step:
                raise ParseError("MALFORMED", "a cross-reference stream ends early")
            for k in range(n):
                row, fields, x = data[at : at + step], [], 0
                for i, w in enumerate(widths):
                    fields.append(int.from_bytes(row[x : x + w], "big") if w else (1, 0, 0)[i])
                    x += w
                self._known(first + k, fields[1] if fields[0] == 1 else (fields[1], fields[2]) if fields[0] == 2 else None)
                at += step
        return entries

    def _parsed(self, at: int):
        """(the value at a place, where it ends)."""
        size = 4096
        while True:
            data = self.file.at(at, max(0, min(size, self.file.size - at)))
            scanner = _Scanner(data, at + len(data) >= self.file.size)
            try:
                value = scanner.value()
                return value, at + scanner.at
            except _Short:
                if size >= MOST_OBJECT:
                    raise ParseError("LIMIT", "an object is too long") from None
                size *= 4

    def _object_at(self, at: int, number: int | None = None):
        start = self.file.at(at, min(80, max(0, self.file.size - at)))
        head = re.match(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj", start)
        if not head or number is not None and int(head[1]) != number:
            raise ParseError("MALFORMED", "a cross-reference leads to another place than its object")
        other = re.match(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R", start[head.end() :])
        if other:
            return Ref(int(other[1]), int(other[2]))
        value, n = self._parsed(at + head.end())
        if isinstance(value, dict):
            after = self.file.at(n, min(32, self.file.size - n))
            opened = re.match(rb"[\0\t\n\x0c\r ]*stream(?:\r\n|\n|\r)", after)
            if opened:
                return Stream(value, n + opened.end())
        return value

    def of(self, value, depth: int = 0):
        """What a value refers to."""
        if not isinstance(value, Ref):
            return value
        if depth > MOST_DEPTH:
            raise ParseError("MALFORMED", "references go in a circle")
        place = self.places.get(value.number)
        if place is None:
            return None
        if isinstance(place, tuple):
            found = self._packed(place[0])
            if place[1] >= len(found) or found[place[1]][0] != value.number:
                raise ParseError("MALFORMED", "an object isn't in its stream")
            return self.of(found[place[1]][1], depth + 1)
        return self.of(self._object_at(self.base + place, value.number), depth + 1)

    def _packed(self, number: int) -> list:
        """(number, value) of the objects in an object stream."""
        if number not in self.packed:
            place = self.places.get(number)
            if type(place) is not int:
                raise ParseError("MALFORMED", "an object stream is missing")
            stream = self._object_at(self.base + place, number)
            n, first = (stream.entries.get(k) for k in ("N", "First")) if isinstance(stream, Stream) else (None, None)
            if type(n) is not int or type(first) is not int or not 0 <= n <= MOST_ENTRIES * 100:
                raise ParseError("MALFORMED", "an object stream lacks its numbers")
            data = self.unpacked(stream)
            heads = data[:first].split()
            if len(heads) < 2 * n or not all(x.isdigit() for x in heads[: 2 * n]):
                raise ParseError("MALFORMED", "an object stream's heads aren't numbers")
            pairs = list(zip(map(int, heads[: 2 * n : 2]), map(int, heads[1 : 2 * n : 2]), strict=True))
            found = []
            for own, offset in pairs:
                scanner = _Scanner(data, True)
                scanner.at = first + offset
                found.append((own, scanner.value()))
            self.packed[number] = found
        return self.packed[number]

    def unpacked(self, stream: Stream, most: int = MOST_UNPACKED) -> bytes:
        length = self.of(stream.entries.get("Length"))
        if type(length) is not int or length < 0:
            raise ParseError("MALFORMED", "a stream has no length")
        if length > MOST_PACKED:
            raise ParseError("LIMIT", "a stream is too long")
        data = self.file.at(stream.at, length)
        filters, parameters = (self.of(stream.entries.get(k)) for k in ("Filter", "DecodeParms"))
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        parameters = parameters if isinstance(parameters, list) else [parameters] * len(filters)
        for name, own in zip(filters, [*parameters, *[None] * len(filters)], strict=False):
            data = self._filtered(data, self.of(name), self.of(own) or {}, most)
        if len(data) > most:
            raise ParseError("LIMIT", "a stream unpacks to too much")
        return data

    def _filtered(self, data: bytes, name, parameters: dict, most: int) -> bytes:
        if name in ("FlateDecode", "Fl"):
            stream = zlib.decompressobj()
            data = stream.decompress(data, most + 1)
            if len(data) > most:
                raise ParseError("LIMIT", "a stream unpacks to too much")
            return _unpredicted(data, parameters)
        if name in ("ASCIIHexDecode", "AHx"):
            digits = re.sub(rb"[\0\t\n\x0c\r ]", b"", data.split(b">")[0])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
        raise ParseError("UNSUPPORTED", f"no reader for the filter {name}")


def _unpredicted(data: bytes, parameters: dict) -> bytes:
    """Undoes the predictors of PNG and TIFF on samples of 8 bits."""
    kind = parameters.get("Predictor", 1)
    if kind == 1:
        return data
    colors, bits, columns = (parameters.get(k, v) for k, v in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not all(type(x) is int and 0 < x < 1 << 20 for x in (colors, bits, columns)) or bits != 8:
        raise ParseError("UNSUPPORTED", "a predictor for other samples than bytes")
    width = colors * columns
    if kind == 2:
        out = bytearray(data)
        for at in range(0, len(out), width):
            for i in range(at + colors, min(at + width, len(out))):
                out[i] = out[i] + out[i - colors] & 255
        return bytes(out)
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left = row[i - colors] if i >= colors else 0
            up, corner = before[i], before[i - colors] if i >= colors else 0
            if how == 1:
                row[i] = row[i] + left & 255
            elif how == 2:
                row[i] = row[i] + up & 255
            elif how == 3:
                row[i] = row[i] + (left + up >> 1) & 255
            elif how == 4:
                row[i] = row[i] + min((left, up, corner), key=lambda x: abs(left + up - corner - x)) & 255
            elif how:
                raise ParseError("MALFORMED", "a row has no known predictor")
        out += row
        before = row + bytearray(width - len(row))
    return bytes(out)


def text(value: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, or else PDFDocEncoding."""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value[2:].decode("utf-16-be" if value[0] == 0xFE else "utf-16-le", "replace")
    if value[:3] == b"\xef\xbb\xbf":
        return value[3:].decode("utf-8", "replace")
    return "".join(_DOC.get(c, chr(c)) for c in value)


def instant(value: str) -> str | None:
    """A date `D:YYYYMMDDHHmmSS+hh'mm'`, of which all after the year may be missing, as an instant in UTC."""
    found = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([Zz])|([+-])(\d\d)'?(\d\d)?'?)?", value.strip())
    if not found:
        return None
    y, mo, d, h, mi, s = (int(x) if x else v for x, v in zip(found.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True))
    offset = timedelta(hours=int(found[9]), minutes=int(found[10] or 0)) * (-1 if found[8] == "-" else 1) if found[8] else timedelta()
    try:
        return datetime(y, mo, d, h, mi, s, tzinfo=timezone(offset)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, OverflowError):
        return None


def _selected(value: str | None) -> str | None:
    if value is None or not value.strip():
        return None
    value = value.strip()
    if len(value.encode("utf-8", "replace")) > MOST_SCALAR:
        raise ParseError("LIMIT", "a value is too long")
    return value


def pdf(file: BoundedFile) -> dict:
    """The record of a PDF: XMP's title, language and identifier, or else Info's title; XMP's creators, then Info's author."""
    document = _Document(file)
    root = document.of(document.trailer.get("Root"))
    pages = document.of(root.get("Pages")) if isinstance(root, dict) else None
    count = document.of(pages.get("Count")) if isinstance(pages, dict) else None
    if type(count) is not int:
        raise ParseError("MALFORMED", "the catalog names no pages")
    if not 1 <= count <= MOST_PAGES:
        raise ParseError("LIMIT", "the number of pages is out of bounds")
    extra: dict[str, list[str]] = {}

    def add(found: dict, prefix: str, key: str, value: str | None) -> None:
        if value := _selected(value):
            found.setdefault(key, []).append(value)
            extra.setdefault(f"{prefix}:{key}", []).append(value)

    info, own = document.of(document.trailer.get("Info")), {}
    info = info if isinstance(info, dict) else {}

    def string(key: str) -> str | None:
        value = document.of(info.get(key))
        return text(value) if type(value) is bytes else None

    for key in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer"):
        add(own, "pdf:info", key.lower(), string(key))
    trapped = document.of(info.get("Trapped"))
    add(own, "pdf:info", "trapped", trapped if isinstance(trapped, Name) else string("Trapped"))
    for key, name in (("CreationDate", "creation-date"), ("ModDate", "modification-date")):
        add(own, "pdf:info", name, instant(string(key) or ""))
    if len(info) > MOST_INFO_FIELDS:
        raise ParseError("LIMIT", "too many fields of information")
    for key in sorted(info):
        if _selected(key):
            add({}, "pdf:info", key.strip().lower(), string(key))

    packet, xmp = document.of(root.get("Metadata")), {}
    if isinstance(packet, Stream):
        tree = _xml(document.unpacked(packet, MOST_XML).strip(b"\0\t\n\r "))
        for key in ("title", "creator", "language", "identifier", "subject", "description"):
            for node in tree.iter(f"{DC}{key}"):
                leaves = [n for n in node.iter() if n is not node and isinstance(n.tag, str) and n.tag.rsplit("}", 1)[-1] == "li"]
                for leaf in leaves or [node]:
                    add(xmp, "pdf:xmp", key, "".join(leaf.itertext()))
    extra["pdf:page-count"] = [str(count)]
    first = {k: v[0] for k, v in (own | xmp).items()}
    creators = dict.fromkeys([*xmp.get("creator", ()), *own.get("author", ())])
    return _record(xmp.get("title", own.get("title", [None]))[0], creators, xmp.get("language", [None])[0], {"xmp": first["identifier"]} if "identifier" in xmp else {}, extra)
