"""PDF metadata of hand-made files: each kind of cross-references, revisions, strings, packets, and files that are refused."""

import random
import zlib

import pytest

from tomeflow.sources import parsers, pdf

CATALOG = "<< /Type /Catalog /Pages 2 0 R %s >>"
PAGES = "<< /Type /Pages /Kids [3 0 R] /Count 1 >>"
PACKET = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">
<r:Description><dc:title><r:Alt><r:li xml:lang="x-default"> XMP title </r:li></r:Alt></dc:title><dc:creator><r:Seq><r:li>Ann</r:li><r:li>Bob</r:li></r:Seq></dc:creator>
<dc:language><r:Bag><r:li>de</r:li></r:Bag></dc:language><dc:identifier>urn:x:1</dc:identifier><dc:subject><r:Bag><r:li>a</r:li><r:li>b</r:li></r:Bag></dc:subject></r:Description></r:RDF></x:xmpmeta><?xpacket end="w"?>"""


def raw(x):
    return x if isinstance(x, bytes) else x.encode("latin-1")


def stream(entries, data):
    return raw(f"<< {entries} /Length {len(data)} >>\nstream\n") + data + b"\nendstream"


def body(objects, start=b"%PDF-1.5\n%\xe2\xe3\n"):
    """(bytes, offsets) of numbered objects."""
    out, at = bytearray(start), {}
    for number, value in objects.items():
        at[number] = len(out)
        out += raw(f"{number} 0 obj\n") + raw(value) + b"\nendobj\n"
    return out, at


def table(out, at, trailer, free=True):
    place = len(out)
    rows = [(0, b"0000000000 65535 f \n")] * free + [(n, b"%010d 00000 n \n" % a) for n, a in at.items()]
    out += b"xref\n"
    for n, row in rows:
        out += b"%d 1\n" % n + row
    out += raw(f"trailer\n<< {trailer} >>\nstartxref\n{place}\n%%EOF\n")
    return place


def classic(info="", root="", more=None, trailer=""):
    objects = {1: CATALOG % root, 2: PAGES, 3: "<< /Type /Page /Parent 2 0 R >>", 4: f"<< {info} >>", **(more or {})}
    out, at = body(objects)
    table(out, at, f"/Size {max(objects) + 1} /Root 1 0 R /Info 4 0 R {trailer}")
    return bytes(out)


def predicted(rows, width):
    out, before = bytearray(), bytes(width)
    for row in rows:
        out += b"\2" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True))
        before = row
    return bytes(out)


def packed(info, root="", predictor=True):
    """Objects 1, 2 and 4 in an object stream, cross-references in a stream."""
    inner = {1: CATALOG % root, 2: PAGES, 4: f"<< {info} >>"}
    parts = [raw(v) for v in inner.values()]
    offsets = [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
    heads = " ".join(f"{n} {o}" for n, o in zip(inner, offsets, strict=True)).encode() + b" "
    data = zlib.compress(heads + b" ".join(parts))
    out, at = body({3: "<< /Type /Page /Parent 2 0 R >>", 5: stream(f"/Type /ObjStm /N 3 /First {len(heads)} /Filter /FlateDecode", data)})
    place = len(out)
    rows = [(0, 0, 65535), (2, 5, 0), (2, 5, 1), (1, at[3], 0), (2, 5, 2), (1, at[5], 0), (1, place, 0)]
    rows = [a.to_bytes(1, "big") + b.to_bytes(3, "big") + c.to_bytes(2, "big") for a, b, c in rows]
    table_data = predicted(rows, 6) if predictor else b"".join(rows)
    how = "/DecodeParms << /Predictor 12 /Columns 6 >>" if predictor else ""
    out += b"6 0 obj\n" + stream(f"/Type /XRef /Size 7 /W [1 3 2] /Root 1 0 R /Info 4 0 R /Filter /FlateDecode {how}", zlib.compress(table_data)) + b"\nendobj\n"
    out += raw(f"startxref\n{place}\n%%EOF")
    return bytes(out)


@pytest.fixture
def parsed(tmp_path):
    def parse(data):
        at = tmp_path / "a.pdf"
        at.write_bytes(data)
        return parsers.parse(str(at), "PDF")

    return parse


def test_info(parsed):
    strings = r"/Title (A \(nested (one)\) \101\n) /Author <FEFF00C4006E006E> /Subject <EFBBBFC3A9> /Keywords (\200 x\240) /Trapped /True"
    record, code, text, _ = parsed(classic(f"{strings} /CreationDate (D:20240131235959-05'30') /ModDate (20240201) /Shelf#20Mark (B 7) /Empty ( )"))
    assert code is None, text
    assert (record["title"], record["contributors"], record["language"], record["identifiers"]) == ("A (nested (one)) A", ["Änn"], None, {})
    assert record["extra"] == {
        "pdf:info:title": ["A (nested (one)) A"] * 2, "pdf:info:author": ["Änn"] * 2, "pdf:info:subject": ["é"] * 2, "pdf:info:keywords": ["• x€"] * 2, "pdf:info:trapped": ["True"],
        "pdf:info:creation-date": ["2024-02-01T05:29:59Z"], "pdf:info:modification-date": ["2024-02-01T00:00:00Z"], "pdf:info:creationdate": ["D:20240131235959-05'30'"], "pdf:info:moddate": ["20240201"],
        "pdf:info:shelf mark": ["B 7"], "pdf:page-count": ["1"],
    }


@pytest.mark.parametrize("filtered", [False, True])
def test_xmp_comes_first(parsed, filtered):
    data = zlib.compress(PACKET.encode()) if filtered else PACKET.encode()
    more = {5: stream("/Type /Metadata /Subtype /XML" + " /Filter [/FlateDecode]" * filtered, data)}
    record, code, text, _ = parsed(classic("/Title (Info title) /Author (Cid)", "/Metadata 5 0 R", more))
    assert code is None, text
    assert (record["title"], record["contributors"], record["language"], record["identifiers"]) == ("XMP title", ["Ann", "Bob", "Cid"], "de", {"xmp": "urn:x:1"})
    assert record["extra"]["pdf:xmp:subject"] == ["a", "b"] and record["extra"]["pdf:info:title"] == ["Info title"] * 2


@pytest.mark.parametrize("predictor", [True, False])
def test_cross_reference_streams(parsed, predictor):
    record, code, text, _ = parsed(packed("/Title (Packed) /Author (Ann)", predictor=predictor))
    assert code is None, text
    assert (record["title"], record["contributors"]) == ("Packed", ["Ann"])


def test_the_last_revision_counts(parsed):
    data = bytearray(classic("/Title (First)"))
    before = int(bytes(data).rsplit(b"startxref\n", 1)[1].split()[0])
    for title in ("Second", "Third"):
        at = len(data)
        data += raw(f"4 0 obj\n<< /Title ({title}) >>\nendobj\n")
        before = table(data, {4: at}, f"/Size 5 /Root 1 0 R /Info 4 0 R /Prev {before}", free=False)
    assert parsed(bytes(data))[0]["title"] == "Third"


def test_hybrid_file(parsed):
    """The table hides object 4, the stream beside it has it."""
    out, at = body({1: CATALOG % "", 2: PAGES, 3: "<< /Type /Page >>", 4: "<< /Title (Hidden) >>"})
    place, hidden = len(out), at.pop(4)
    out += b"5 0 obj\n" + stream("/Type /XRef /Size 6 /W [1 4 2] /Index [4 1]", b"\1" + hidden.to_bytes(4, "big") + b"\0\0") + b"\nendobj\n"
    table(out, at, f"/Size 6 /Root 1 0 R /Info 4 0 R /XRefStm {place}")
    assert parsed(bytes(out))[0]["title"] == "Hidden"


def test_a_large_file_is_read_at_its_ends(parsed):
    data = classic("/Title (Large)", more={6: stream("", bytes(8 << 20))})
    record, _, _, read = parsed(data)
    assert record["title"] == "Large" and read < 64 << 10


@pytest.mark.parametrize("data, code", [
    (classic(trailer="/Encrypt 9 0 R"), "ENCRYPTED"),
    (b"no pdf at all" * 99, "MALFORMED"),
    (classic("/Title (x)")[:-60], "MALFORMED"),
    (classic("/Title (x)").replace(b"4 0 obj", b"7 0 obj"), "MALFORMED"),
    (classic("/Title (x"), "MALFORMED"),
    (classic("/Title (" + "x" * 70_000 + ")"), "LIMIT"),
    (classic(" ".join(f"/K{i} (x)" for i in range(300))), "LIMIT"),
    (classic("/Title " + "[" * 200 + "]" * 200), "LIMIT"),
    (classic().replace(b"/Count 1", b"/Count 0"), "LIMIT"),
    (classic().replace(b"/Pages 2 0 R", b"/Nopes 2 0 R"), "MALFORMED"),
    (classic(root="/Metadata 5 0 R", more={5: stream("/Type /Metadata", b"<a><b></a>")}), "MALFORMED"),
    (classic(root="/Metadata 5 0 R", more={5: stream("/Type /Metadata", b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")}), "UNSAFE"),
    (classic(root="/Metadata 5 0 R", more={5: stream("/Filter /FlateDecode", zlib.compress(b"<a>" + b" " * (5 << 20) + b"</a>"))}), "LIMIT"),
    (classic(root="/Metadata 5 0 R", more={5: stream("/Filter /FlateDecode", b"damaged")}), "MALFORMED"),
    (classic(root="/Metadata 5 0 R", more={5: stream("/Filter /Crypt", b"x")}), "UNSUPPORTED"),
    (classic("/Title 5 0 R", more={5: "5 0 R"}), "MALFORMED"),
])
def test_files_that_are_refused(parsed, data, code):
    record, found, text, _ = parsed(data)
    assert record is None and found == code and text


def test_damaged_bytes_never_crash(parsed):
    r = random.Random(5)
    for good in (classic("/Title (A) /Author (B)", "/Metadata 5 0 R", {5: stream("/Type /Metadata", PACKET.encode())}), packed("/Title (P)")):
        for _ in range(150):
            data = bytearray(good)
            for _ in range(r.randrange(1, 6)):
                data[r.randrange(len(data))] = r.randrange(256)
            record, code, _, _ = parsed(bytes(data[: r.randrange(1, len(data) + 1)] if r.random() < 0.3 else data))
            assert (record is None) == (code is not None)


def test_predictors():
    rows = [bytes(random.Random(k).randrange(256) for _ in range(6)) for k in range(5)]
    assert pdf._unpredicted(predicted(rows, 6), {"Predictor": 12, "Columns": 6}) == b"".join(rows)
    left = b"".join(b"\1" + bytes((a - b) & 255 for a, b in zip(r, b"\0" + r[:-1], strict=True)) for r in rows)
    assert pdf._unpredicted(left, {"Predictor": 11, "Columns": 6}) == b"".join(rows)
    tiff = b"".join(bytes((a - b) & 255 for a, b in zip(r, b"\0" + r[:-1], strict=True)) for r in rows)
    assert pdf._unpredicted(tiff, {"Predictor": 2, "Columns": 6}) == b"".join(rows)
