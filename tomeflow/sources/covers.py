"""Cover candidates: which image of a file would become its cover, and what size it would get.

The image is found by the format's own declarations, and its kind and size are read from its header; nothing is decoded. An
image in an archive, a record or base64 is read as a bounded stream for its digest. A page that would have to be rendered
(PDF, DjVu) is a candidate by its measures. Resampling needs an image library and isn't done here.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import os
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from .parsers import _DAMAGED, MOST_ENTRIES, BoundedFile, ParseError, _entry, _xml, _zip
from .pdf import Ref, _Document

#: Fixed limits: of sources, encoded images, pixels as they are decoded and as they are put out.
MOST_SOURCE, MOST_ENCODED = 256 << 20, 32 << 20
MOST_PIXELS, MOST_DECODED, MOST_OUT = 40_000_000, 128 << 20, 8_000_000
WIDTH, HEIGHT = 1600, 2400
MOST_UNPACKED = 512 << 20
#: How far a header is looked at for an image's size.
HEADER = 1 << 20


class Candidate(NamedTuple):
    """kind: how it was chosen; locator: where it stands; size, digest and media type are of the encoded image, null for a page."""

    kind: str
    locator: str
    width: int
    height: int
    media_type: str | None = None
    byte_size: int | None = None
    sha256: str | None = None


class Measured:
    """An encoded image as it streams by: its digest, its length and the beginning that holds its size."""

    def __init__(self):
        self.head, self.size, self.digest = bytearray(), 0, hashlib.sha256()

    def feed(self, data: bytes) -> None:
        self.size += len(data)
        if self.size > MOST_ENCODED:
            raise ParseError("LIMIT", "the cover is too large")
        self.digest.update(data)
        if len(self.head) < HEADER:
            self.head += data[: HEADER - len(self.head)]

    def candidate(self, kind: str, locator: str) -> Candidate:
        if not self.size:
            raise ParseError("LIMIT", "the cover is empty")
        width, height, media = measured(bytes(self.head))
        return Candidate(kind, locator, width, height, media, self.size, self.digest.hexdigest())


def measured(head: bytes) -> tuple[int, int, str]:
    """(width, height, media type) from the beginning of an image."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        if head[12:16] != b"IHDR" or len(head) < 24:
            raise ParseError("MALFORMED", "a PNG without a header")
        return (*struct.unpack(">II", head[16:24]), "image/png")
    if head[:6] in (b"GIF87a", b"GIF89a"):
        if len(head) < 10:
            raise ParseError("MALFORMED", "a GIF ends early")
        return (*struct.unpack("<HH", head[6:10]), "image/gif")
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height), "image/bmp"
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(head):
            if head[at] != 0xFF:
                raise ParseError("MALFORMED", "a JPEG marker is missing")
            kind = head[at + 1]
            if kind == 0xFF:  # fill
                at += 1
            elif kind == 1 or 0xD0 <= kind <= 0xD8:
                at += 2
            elif kind in (0xD9, 0xDA):
                break
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                if at + 9 > len(head):
                    break
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                return width, height, "image/jpeg"
            else:
                at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
        raise ParseError("MALFORMED", "a JPEG without a frame")
    raise ParseError("UNSUPPORTED", "no known image format")


def output_size(width: int, height: int) -> tuple[int, int]:
    """What an image is scaled down to; raises if it is too large to be decoded."""
    pixels = width * height
    if width <= 0 or height <= 0 or pixels > MOST_PIXELS or pixels * 4 > MOST_DECODED:
        raise ParseError("LIMIT", "the cover has too many pixels")
    scale = min(1.0, WIDTH / width, HEIGHT / height)
    if math.ceil(width * scale) * math.ceil(height * scale) > MOST_OUT:
        scale = math.sqrt(MOST_OUT / pixels)
    return max(1, math.floor(width * scale)), max(1, math.floor(height * scale))


def _checked_zip(file: BoundedFile) -> zipfile.ZipFile:
    z = _zip(file)
    if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
        raise ParseError("LIMIT", "the archive unpacks to too much")
    return z


def _of_entry(z: zipfile.ZipFile, name: str, kind: str) -> Candidate:
    image = Measured()
    try:
        with z.open(name) as f:
            while data := f.read(1 << 16):
                image.feed(data)
    except KeyError:
        raise ParseError("MALFORMED", f"{name} is missing") from None
    return image.candidate(kind, name)


def epub(file: BoundedFile) -> Candidate | None:
    z = _checked_zip(file)
    roots = [e for e in _xml(_entry(z, "META-INF/container.xml", 1 << 20)).iter() if e.tag.rpartition("}")[2] == "rootfile"]
    if len(roots) != 1 or not roots[0].get("full-path"):
        raise ParseError("MALFORMED", "the container doesn't name one package document")
    path = _inside(roots[0].get("full-path"))
    package = _xml(_entry(z, path))
    named = next((e.get("content") for e in package.iter() if e.tag.rpartition("}")[2] == "meta" and e.get("name") == "cover"), None)
    for item in package.iter():
        if item.tag.rpartition("}")[2] == "item" and (named is not None and item.get("id") == named or "cover-image" in (item.get("properties") or "").split()):
            if item.get("media-type") not in ("image/jpeg", "image/png"):
                raise ParseError("UNSAFE", "a cover of this kind isn't allowed")
            href = item.get("href") or ""
            return _of_entry(z, _inside(posixpath.join(posixpath.dirname(path), href)), "DECLARED") if href.strip() else None
    return None


def _inside(name: str) -> str:
    """The name of an entry; raises if it leaves the archive."""
    whole = posixpath.normpath(name)
    if whole.startswith(("/", "../")) or whole in ("..", ".") or "\\" in whole or ":" in whole.split("/")[0]:
        raise ParseError("UNSAFE", "an entry leaves the archive")
    return whole


def docx(file: BoundedFile) -> Candidate | None:
    z = _checked_zip(file)
    for name in z.namelist():
        own = name.lower()
        if "vbaproject.bin" in own or own.startswith(("word/activex/", "word/embeddings/")):
            raise ParseError("UNSAFE", "active content isn't allowed")
    held = set(z.namelist())
    return next((_of_entry(z, n, "DOCX") for n in ("docProps/thumbnail.jpeg", "docProps/thumbnail.jpg", "docProps/thumbnail.png") if n in held), None)


def fb2(file: BoundedFile) -> Candidate | None:
    """Streams the file once: the cover page names a binary, whose base64 is decoded as it comes."""
    wanted, depth_of_cover, carry, image, base = None, 0, b"", None, b""
    parser = ElementTree.XMLPullParser(("start", "end"))
    before: dict[str, Candidate] = {}  # binaries that stand before the cover page: their measures
    current, names = None, []
    file.seek(0)
    while True:
        data = file.read(1 << 14)
        if not data:
            try:
                parser.close()
            except ElementTree.ParseError as e:
                raise ParseError("MALFORMED", str(e)) from None
            return before.get(wanted) if wanted else None
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
                if len(names) > MOST_ENTRIES:
                    raise ParseError("LIMIT", "XML is nested too deeply")
                depth_of_cover += name == "coverpage"
                if name == "image" and depth_of_cover and wanted is None:
                    wanted = next((v.lstrip("#") for k, v in node.attrib.items() if k.rpartition("}")[2] == "href"), None)
                if name == "binary":
                    current, image, base = node, Measured(), b""
                continue
            names.pop()
            depth_of_cover -= name == "coverpage"
            if name == "binary":
                base = _decoded(image, base + (node.text or "").encode("ascii", "ignore"), True)
                if wanted is None or node.get("id") == wanted:
                    if image.size:
                        before.setdefault(node.get("id"), image.candidate("DECLARED", f"binary#{node.get('id')}"))
                    if wanted is not None and node.get("id") == wanted:
                        return before.get(wanted)
                current = None
                node.clear()
            elif name != "coverpage" and not depth_of_cover and len(names) > 1:
                node.clear()  # nothing of the text is kept
        if current is not None and current.text and (wanted is None or current.get("id") == wanted):
            base, current.text = _decoded(image, base + current.text.encode("ascii", "ignore"), False), None
        elif current is not None:
            current.text = None


def _decoded(image: Measured, text: bytes, last: bool) -> bytes:
    """Feeds what whole groups of base64 give; returns the rest."""
    text = re.sub(rb"[^A-Za-z0-9+/]", b"", text)
    whole = len(text) // 4 * 4
    try:
        image.feed(base64.b64decode(text[:whole]))
        if last and len(text) > whole:
            image.feed(base64.b64decode(text[whole:] + b"=" * (whole + 4 - len(text))))
    except binascii.Error as e:
        raise ParseError("MALFORMED", str(e)) from None
    return b"" if last else text[whole:]


def mobi(file: BoundedFile) -> Candidate | None:
    if file.size < 100:
        raise ParseError("MALFORMED", "the file ends early")
    n = struct.unpack(">H", file.at(76, 2))[0]
    if n < 2:
        raise ParseError("LIMIT", "too few records")
    starts = [struct.unpack(">I", file.at(78 + 8 * k, 4))[0] for k in (0, 1)]
    first = starts[0]
    if file.at(first + 16, 4) != b"MOBI":
        return None
    length = struct.unpack(">I", file.at(first + 20, 4))[0]
    if length < 116 or first + 16 + length > starts[1]:
        raise ParseError("MALFORMED", "the header is wrong")
    images = struct.unpack(">I", file.at(first + 16 + 92, 4))[0]
    if not struct.unpack(">I", file.at(first + 16 + 112, 4))[0] & 0x40:
        return None
    at = first + 16 + length
    magic, total, count = struct.unpack(">4sII", file.at(at, 12))
    if magic != b"EXTH":
        raise ParseError("MALFORMED", "EXTH is wrong")
    if total > 1 << 20 or count > 1024:
        raise ParseError("LIMIT", "EXTH is too long")
    offset, end, at = None, at + total, at + 12
    for _ in range(count):
        kind, size = struct.unpack(">II", file.at(at, 8))
        if size < 8 or at + size > end:
            raise ParseError("MALFORMED", "an EXTH record is wrong")
        if kind == 201 and size >= 12:
            offset = struct.unpack(">I", file.at(at + 8, 4))[0]
        at += size
    if offset is None:
        return None
    record = images + offset
    if record >= n:
        raise ParseError("MALFORMED", "the cover's record is missing")
    start = struct.unpack(">I", file.at(78 + 8 * record, 4))[0]
    stop = struct.unpack(">I", file.at(78 + 8 * (record + 1), 4))[0] if record + 1 < n else file.size
    if not 0 < stop - start <= MOST_ENCODED:
        raise ParseError("LIMIT", "the cover is too large")
    image = Measured()
    for k in range(start, stop, 1 << 16):
        image.feed(file.at(k, min(1 << 16, stop - k)))
    return image.candidate("DECLARED", f"palm-record:{record}")


def pdf(file: BoundedFile) -> Candidate | None:
    """The first page, at twice its size in points at most."""
    try:
        document = _Document(file)
    except ParseError as e:
        if e.code == "ENCRYPTED":
            return None
        raise
    root = document.of(document.trailer.get("Root"))
    node, box = document.of(root.get("Pages")) if isinstance(root, dict) else None, {}
    for _ in range(128):
        if not isinstance(node, dict):
            return None
        box |= {k: document.of(node[k]) for k in ("MediaBox", "CropBox") if k in node}
        kids = document.of(node.get("Kids"))
        if not isinstance(kids, list):
            break
        node = next((x for k in kids if isinstance(k, Ref | dict) and isinstance(x := document.of(k), dict)), None)
    corners = [document.of(v) for v in box.get("CropBox") or box.get("MediaBox") or (0, 0, 612, 792)]
    if len(corners) != 4 or not all(isinstance(v, int | float) for v in corners):
        raise ParseError("MALFORMED", "a page has no box")
    width, height = abs(corners[2] - corners[0]), abs(corners[3] - corners[1])
    if not width or not height:
        raise ParseError("MALFORMED", "a page has no size")
    scale = min(WIDTH / width, HEIGHT / height, 2.0)
    return Candidate("PDF", "page:1", max(1, math.floor(width * scale + 0.5)), max(1, math.floor(height * scale + 0.5)))


def djvu(file: BoundedFile) -> Candidate | None:
    from .parsers import djvu as parsed

    extra = parsed(file)["extra"]
    size = [int(extra[f"djvu:first-page-{k}"][0]) for k in ("width", "height") if f"djvu:first-page-{k}" in extra]
    if len(size) < 2 or not all(size):
        raise ParseError("MALFORMED", "the first page has no size")
    scale = min(WIDTH / size[0], HEIGHT / size[1])
    return Candidate("DJVU", "page:1", *(max(1, math.floor(v * scale)) for v in size))


FORMATS = {"EPUB": epub, "FB2": fb2, "MOBI": mobi, "DOCX": docx, "PDF": pdf, "DJVU": djvu}
CANDIDATES = "path string, format string, state string, origin string, locator string, width int, height int, media_type string, byte_size long, sha256 string, output_width int, output_height int, code string"


def found(path: str, fmt: str) -> tuple:
    """The columns of CANDIDATES after the format: READY with the candidate, UNAVAILABLE without one, FAILED with a code."""
    nothing = (None,) * 9
    try:
        if fmt not in FORMATS:
            raise ParseError("UNSUPPORTED", "no reader for this format")
        with BoundedFile(path, MOST_SOURCE) as file:
            if not 0 < file.size <= MOST_SOURCE:
                raise ParseError("LIMIT", "the source is too large")
            best = FORMATS[fmt](file)
        if best is None:
            return ("UNAVAILABLE", *nothing, None)
        return ("READY", *best, *(output_size(best.width, best.height)), None)
    except ParseError as e:
        return ("FAILED", *nothing, e.code)
    except (struct.error, UnicodeError, *_DAMAGED):
        return ("FAILED", *nothing, "MALFORMED")


def cover_candidates(files: DataFrame, root: str) -> DataFrame:
    """The cover candidate of each file (path, format) below root: CANDIDATES' columns. chosen_covers() ranks them by origin."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(CANDIDATES))

    def work(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(path, fmt, *found(os.path.join(root, path), fmt)) for path, fmt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return files.select("path", "format").mapInArrow(work, CANDIDATES)
