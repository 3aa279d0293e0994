"""Files: cover candidates of each format, facts that are checked before reading, manifests, publishing, MOBI, EPUB rules, files that change."""

import base64
import hashlib
import os
import struct
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import ops
from tomeflow.sources import covers, files, parsers

from .test_operators import chunk
from .test_pdf import body, table


def png(width, height):
    ihdr = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + ihdr + struct.pack(">I", zlib.crc32(ihdr)) + b"rest of it"


def jpeg(width, height):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    table_ = b"\xff\xc4" + struct.pack(">H", 5) + b"abc"
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8" + app + b"\xff" + table_ + frame + b"\xff\xda"


def epub(at, image, href="img/c.png", kind="image/png", how='properties="cover-image"', meta="", entry="OPS/img/c.png"):
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfiles><rootfile full-path="OPS/o.opf"/></rootfiles></c>')
        z.writestr("OPS/o.opf", f'<package xmlns="p"><metadata>{meta}</metadata><manifest><item id="t" href="t.xhtml" media-type="a/b"/><item id="c" href="{href}" media-type="{kind}" {how}/></manifest></package>')
        z.writestr(entry, image)


def mobi(at, records, cover=0, exth=True, title=b"Title", extra=()):
    """records: those after the first; the first image is record 1."""
    header = bytearray(16 + 116)
    header[16:20], header[20:24], header[28:32] = b"MOBI", struct.pack(">I", 116), struct.pack(">I", 65001)
    header[16 + 92 : 16 + 96] = struct.pack(">I", 1)
    own = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in [*extra, *([(201, struct.pack(">I", cover))] if cover is not None else [])])
    block = b"EXTH" + struct.pack(">II", 12 + len(own), len(extra) + (cover is not None)) + own if exth else b""
    header[128:132] = struct.pack(">I", 0x40 if exth else 0)
    header[84:92] = struct.pack(">II", len(header) + len(block), len(title))
    first = bytes(header) + block + title
    parts = [first, *records]
    offset, table_ = 78 + 8 * len(parts), b""
    for p in parts:
        table_ += struct.pack(">II", offset, 0)
        offset += len(p)
    at.write_bytes(bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(parts)) + table_ + b"".join(parts))


def ready(found, kind, locator, size, out, image):
    media = None if image is None else "image/png" if image[:1] == b"\x89" else "image/jpeg"
    assert found == ("READY", kind, locator, *size, media, image and len(image), image and hashlib.sha256(image).hexdigest(), *out, None)


def test_epub_covers(tmp_path):
    at = tmp_path / "a.epub"
    epub(at, png(3200, 2400))
    ready(covers.found(at, "EPUB"), "DECLARED", "OPS/img/c.png", (3200, 2400), (1600, 1200), png(3200, 2400))
    epub(at, jpeg(100, 50), "../x.jpg", "image/jpeg", "", '<meta name="cover" content="c"/>', "x.jpg")
    ready(covers.found(at, "EPUB"), "DECLARED", "x.jpg", (100, 50), (100, 50), jpeg(100, 50))
    for options, state, code in (
        ({"kind": "image/svg+xml"}, "FAILED", "UNSAFE"), ({"how": ""}, "UNAVAILABLE", None), ({"href": "../../x"}, "FAILED", "UNSAFE"), ({"href": "no.png"}, "FAILED", "MALFORMED"),
    ):
        epub(at, png(1, 1), **options)
        found = covers.found(at, "EPUB")
        assert (found[0], found[-1]) == (state, code)
    epub(at, png(10_000, 10_000))
    assert covers.found(at, "EPUB")[-1] == "LIMIT"
    epub(at, b"not an image")
    assert covers.found(at, "EPUB")[-1] == "UNSUPPORTED"


def test_fb2_covers(tmp_path):
    at, image = tmp_path / "a.fb2", png(90, 120) + bytes(range(256)) * 300
    lines = base64.encodebytes(image).decode()
    text = '<FictionBook xmlns="f" xmlns:l="x"><description><title-info><coverpage><image l:href="#c.png"/></coverpage></title-info></description><body><p>%s</p></body><binary id="other">AAAA</binary><binary id="c.png">%s</binary></FictionBook>'
    at.write_text(text % ("words " * 20_000, lines))
    ready(covers.found(at, "FB2"), "DECLARED", "binary#c.png", (90, 120), (90, 120), image)
    at.write_text(text.replace("#c.png", "#none") % ("x", lines))
    assert covers.found(at, "FB2")[0] == "UNAVAILABLE"
    at.write_text("<!DOCTYPE x><FictionBook/>")
    assert covers.found(at, "FB2")[-1] == "UNSAFE"


def test_mobi_covers_and_names(tmp_path):
    at = tmp_path / "a.mobi"
    mobi(at, [png(5, 7), jpeg(9, 11)], 1, extra=[(100, b"Ann"), (100, b"Bob"), (104, b"978"), (524, b"de"), (503, b"Better title")])
    ready(covers.found(at, "MOBI"), "DECLARED", "palm-record:2", (9, 11), (9, 11), jpeg(9, 11))
    record = parsers.parse(str(at), "MOBI")[0]
    assert (record["title"], record["contributors"], record["language"], record["identifiers"]) == ("Better title", ["Ann", "Bob"], "de", {"isbn": "978"})
    mobi(at, [png(5, 7)], None)
    assert covers.found(at, "MOBI")[0] == "UNAVAILABLE" and parsers.parse(str(at), "MOBI")[0]["title"] == "Title"
    mobi(at, [png(5, 7)], 5)
    assert covers.found(at, "MOBI")[-1] == "MALFORMED"
    mobi(at, [png(5, 7)])
    data = bytearray(at.read_bytes())
    for place, value, code in ((12, b"\0\1", "ENCRYPTED"), (28, struct.pack(">I", 77), "UNSUPPORTED"), (16, b"XXXX", "MALFORMED")):
        changed, first = bytearray(data), struct.unpack(">I", data[78:82])[0]
        changed[first + place : first + place + len(value)] = value
        at.write_bytes(changed)
        assert parsers.parse(str(at), "MOBI")[1] == code


def test_covers_of_pages_and_thumbnails(tmp_path):
    at = tmp_path / "a.docx"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("docProps/thumbnail.png", png(4, 4))
        z.writestr("docProps/thumbnail.jpeg", jpeg(8, 8))
    ready(covers.found(at, "DOCX"), "DOCX", "docProps/thumbnail.jpeg", (8, 8), (8, 8), jpeg(8, 8))
    with zipfile.ZipFile(at, "a") as z:
        z.writestr("word/vbaProject.bin", "x")
    assert covers.found(at, "DOCX")[-1] == "UNSAFE"
    at = tmp_path / "a.pdf"
    out, places = body({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 1000.5] >>", 3: "<< /Type /Page /CropBox [100 100 500 4 0 R] >>", 4: "700"})
    table(out, places, "/Size 5 /Root 1 0 R")
    at.write_bytes(out)
    ready(covers.found(at, "PDF"), "PDF", "page:1", (800, 1200), (800, 1200), None)
    at = tmp_path / "a.djvu"
    info = struct.pack(">HH", 2550, 3300) + b"\0\0" + struct.pack("<H", 300) + b"\0\0"
    at.write_bytes(b"AT&T" + chunk(b"FORM", b"DJVU" + chunk(b"INFO", info)))
    ready(covers.found(at, "DJVU"), "DJVU", "page:1", (1600, 2070), (1600, 2070), None)


def test_candidates_are_ranked(spark, tmp_path):
    epub(tmp_path / "a.epub", png(5, 5))
    mobi(tmp_path / "b.mobi", [png(5, 7)], None)
    (tmp_path / "c.fb2").write_bytes(b"damaged")
    given = files.discovered(spark, str(tmp_path))
    found = {r.path: r for r in covers.cover_candidates(given, str(tmp_path)).collect()}
    assert {k: (r.state, r.code) for k, r in found.items()} == {"a.epub": ("READY", None), "b.mobi": ("UNAVAILABLE", None), "c.fb2": ("FAILED", "MALFORMED")}
    rows = spark.createDataFrame([(1, "x", "PDF", 1), (1, "y", "DECLARED", 2), (2, "z", "DJVU", 1)], "work_id long, cover_id string, origin string, created_at long")
    assert {r.work_id: r.cover_id for r in ops.chosen_covers(rows).collect()} == {1: "y", 2: "z"}


def test_facts_are_checked_on_what_is_opened(spark, tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    for name in ("ok", "d/deep", "sized", "timed", "other", "gone"):
        (root / name).write_bytes(b"12345")
    os.symlink(root / "ok", root / "link")
    os.symlink(root / "d", root / "linked")
    os.symlink("/etc", root / "out")
    os.mkfifo(root / "pipe")
    known = {}
    for name in ("ok", "d/deep", "sized", "timed", "other", "gone", "link", "linked/deep", "out/passwd", "d", "../root/ok", "d/../ok", "/ok", "pipe", "ok/under"):
        s = os.stat(root / "ok")
        known[name] = [5, s.st_mtime_ns // 1000, None]
    for name in ("ok", "d/deep", "timed", "other", "sized"):
        s = os.stat(root / name)
        known[name] = [5, s.st_mtime_ns // 1000, f"{s.st_dev}:{s.st_ino}"]
    (root / "sized").write_bytes(b"123456")
    known["timed"][1] += 2
    known["other"][2] = "0:0"
    (root / "gone").unlink()
    rows = spark.createDataFrame([(k, *v) for k, v in known.items()], "path string, byte_size long, us long, file_key string").withColumn("modified_at", F.timestamp_micros("us"))
    found = {r.path: r.fact for r in files.checked_facts(rows, str(root)).collect()}
    escapes = {"link", "linked/deep", "out/passwd", "../root/ok", "d/../ok", "/ok"}
    assert found == {k: "PATH_ESCAPE" if k in escapes else "OK" if k in ("ok", "d/deep") else "UNSTABLE" if k in ("sized", "timed", "other") else "UNAVAILABLE" for k in known}


def test_a_file_that_changes_is_deferred(spark, tmp_path):
    at = tmp_path / "a.epub"
    epub(at, png(1, 1))

    def meanwhile(path, fmt):
        result = parsers.parse(path, fmt)
        at.write_bytes(at.read_bytes() + b" ")
        return result

    assert files.read_stable(str(at), "EPUB")[0] == "EXTRACTED"
    assert files.read_stable(str(at), "EPUB", meanwhile)[:3] == ("DEFERRED", None, "FILE_UNSTABLE")
    assert files.read_stable(str(tmp_path / "none"), "EPUB")[0] == "DEFERRED"


def test_manifest_reads_in_slices(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 10_000_000)
    (tmp_path / "b").write_bytes(b"")
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    found = {r.path: (r.byte_size, r.sha256) for r in ops.manifest(paths, str(tmp_path)).collect()}
    assert found == {"a": (10_000_000, hashlib.sha256(b"x" * 10_000_000).hexdigest()), "b": (0, hashlib.sha256(b"").hexdigest()), "c": (None, None)}
    before = ops.manifest(paths.where("path <> 'c'"), str(tmp_path)).collect()
    (tmp_path / "b").write_bytes(b"!")
    after = ops.manifest(paths.where("path <> 'c'"), str(tmp_path))
    schema = "path string, byte_size long, sha256 string"
    assert [tuple(r) for r in ops.manifest_differences(spark.createDataFrame(before, schema), after).collect()] == [("b", "CHANGED")]


def test_publishing_twice_and_over_other_content(spark, tmp_path):
    items = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (b"",)], "content binary").repartition(3)
    folder = str(tmp_path / "out")
    first, again = (sorted(map(tuple, ops.published(items, folder, "covers", "jpg").collect())) for _ in range(2))
    assert first == again and len(first) == 3
    assert {(r.path, r.sha256) for r in ops.manifest(spark.createDataFrame([(p,) for _, p, _ in first], "path string"), folder).collect()} == {(p, sha) for sha, p, _ in first}
    one = os.path.join(folder, next(p for _, p, n in first if n == 3))
    with ThreadPoolExecutor(8) as pool:  # as speculative tasks do
        list(pool.map(lambda _: ops.publish(one, open(one, "rb").read()), range(40)))
    assert not [f for _, _, names in os.walk(folder) for f in names if f.endswith(".part")]
    with pytest.raises(ValueError, match="other content"):
        ops.publish(one, b"another")
    with pytest.raises(ValueError, match="other content"):
        ops.publish(one, open(one, "rb").read() + b"more")
    with open(one, "wb") as f:
        f.write(b"damaged")
    with pytest.raises(Exception, match="other content"):
        ops.published(items, folder, "covers", "jpg").collect()


def test_exported_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text', None), (2, "", "x")]
    ops.exported_csv(spark.createDataFrame(rows, "k long, a string, b string"), str(tmp_path / "csv"))
    found = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert found.columns == ["k", "a", "b"] and found.where("k = 1").first().a == rows[0][1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        ops.exported_csv(spark.range(1), str(tmp_path / "csv"))


def test_root_marker(tmp_path):
    (tmp_path / ".marker").write_text("token\n")
    files.verified_root(str(tmp_path), ".marker", hashlib.sha256(b"token").hexdigest())
    with pytest.raises(ValueError, match="isn't the one"):
        files.verified_root(str(tmp_path), ".marker", hashlib.sha256(b"other").hexdigest())


def test_epub_rules(spark, tmp_path):
    def write(name, *entries, first=("mimetype", "application/epub+zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for n, data, how in ([first] if first else []) + list(entries):
                z.writestr(n, data, how)

    box = ("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="o.opf"/></c>', zipfile.ZIP_DEFLATED)
    package = ("o.opf", "<package/>", zipfile.ZIP_DEFLATED)
    write("good.epub", box, package)
    write("late.epub", package, box, first=None)
    write("packed.epub", box, package, ("x", "0" * 1_000_000, zipfile.ZIP_DEFLATED))
    write("alone.epub", box)
    write("broken.epub", box, ("o.opf", "<package>", zipfile.ZIP_DEFLATED))
    write("many.epub", box, package, *((f"n{i}", "", zipfile.ZIP_STORED) for i in range(10_001)))
    (tmp_path / "none.epub").write_bytes(b"no archive")
    given = spark.createDataFrame([(f.name,) for f in tmp_path.iterdir()], "path string")
    found = {}
    for r in files.validated_epubs(given, str(tmp_path)).collect():
        found.setdefault(r.path.split(".")[0], []).append(r.problem)
    assert set(found) == {"late", "packed", "alone", "broken", "many", "none"}
    assert found["late"] == ["mimetype isn't the first entry and stored"] and found["packed"] == ["packed too tightly"]
    assert found["alone"] == ["the package document is missing"] and "too many entries" in found["many"]
