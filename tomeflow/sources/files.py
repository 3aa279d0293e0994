"""Files as tables: discovery below a root, and extraction of metadata from what was discovered.

The root must be mounted at the same path on all executors, as a library's root is.
"""

from __future__ import annotations

import errno
import hashlib
import os
import stat
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.primitives import union_all, written
from ..schemas import path_is_clean

SUFFIXES = {".epub": "EPUB", ".fb2": "FB2", ".mobi": "MOBI", ".pdf": "PDF", ".docx": "DOCX", ".djvu": "DJVU", ".djv": "DJVU"}
DISCOVERED = "path string, format string, byte_size long, modified_at timestamp, file_key string, problem string"


def _listed(root: str, folder: str) -> Iterator[tuple]:
    """What stands in one folder below root: (path, folder, format, byte_size, modified_at, file_key, problem); folder: whether it is one."""
    import datetime

    try:
        entries = list(os.scandir(os.path.join(root, folder)))
    except OSError:
        yield folder, False, None, None, None, None, "UNREADABLE"
        return
    for entry in sorted(entries, key=lambda e: e.name):
        path, fmt = os.path.join(folder, entry.name), SUFFIXES.get(os.path.splitext(entry.name)[1].lower())
        try:
            if entry.is_symlink():
                yield path, False, fmt, None, None, None, "PATH_ESCAPE"
            elif entry.is_dir():
                yield path, True, None, None, None, None, None
            elif fmt:
                s = os.stat(entry.path)
                at = datetime.datetime.fromtimestamp(s.st_mtime_ns // 1000 / 1e6, datetime.UTC)
                yield path, False, fmt, s.st_size, at, f"{s.st_dev}:{s.st_ino}", None
        except OSError:
            yield path, False, fmt, None, None, None, "UNREADABLE"


def discovered(spark: SparkSession, root: str, parallelism: int = 8, most_depth: int = 256) -> DataFrame:
    """Every file below root with a known suffix, whatever its case: (path, format, byte_size, modified_at, file_key, problem).

    Hidden names are read, symbolic links aren't followed but reported as PATH_ESCAPE, and what can't be read is
    UNREADABLE. Folders are listed level by level: those of one level are rows that are dealt anew, so a root with one large
    folder keeps all tasks busy; each level is written, so no folder is listed twice.
    """

    def work(batches):
        import pyarrow as pa

        types = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
        names = ["path", "folder", "format", "byte_size", "modified_at", "file_key", "problem"]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_listed(root, folder))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], t) for k, t in enumerate(types)], names=names)

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    for _ in range(most_depth):
        level = written(folders.repartition(parallelism).mapInArrow(work, f"path string, folder boolean, {DISCOVERED.split(', ', 1)[1]}"), "listed")
        levels.append(level.where("not folder").drop("folder"))
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return union_all(*levels)
    raise ValueError(f"folders are nested more than {most_depth} deep")


def contained_paths(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests (alias, path) with `whole`, the place below the mount that goes by the alias, or a `problem`. aliases: (alias, mount).

    A path is relative and has no empty, `.` or `..` segment, so it can't leave its mount.
    """
    mounts = aliases.select("alias", "mount", F.lit(True).alias("_known"))
    both = requests.join(mounts, "alias", "left")
    problem = F.when(F.col("_known").isNull(), "UNKNOWN_ROOT").when(~F.coalesce(path_is_clean(F.col("path")), F.lit(False)), "PATH_ESCAPE")
    return both.withColumn("problem", problem).withColumn("whole", F.when(F.col("problem").isNull(), F.concat_ws("/", "mount", "path"))).drop("mount", "_known")


def verified_root(root: str, marker: str, digest: str) -> None:
    """Raises unless the root's marker file holds the token with this SHA-256."""
    with open(os.path.join(root, marker), "rb") as f:
        if hashlib.sha256(f.read(4096).strip()).hexdigest() != digest:
            raise ValueError("the root isn't the one that was registered")


def coverage_complete(files: DataFrame) -> Column:
    """Whether a scan saw everything; aggregate of discovered()."""
    return ~F.bool_or(F.coalesce(F.col("problem") == "UNREADABLE", F.lit(False)))


EXTRACTED = "path string, format string, state string, title string, contributors array<string>, language string, identifiers map<string,string>, extra map<string,array<string>>, error_code string, diagnostic string, bytes_read long"


def _facts(path: str) -> tuple | None:
    try:
        s = os.stat(path)
        return s.st_size, s.st_mtime_ns, s.st_ino
    except OSError:
        return None


def read_stable(whole: str, fmt: str, read: Callable | None = None) -> tuple:
    """(state, record, error code, diagnostic, bytes read): EXTRACTED, FAILED, or DEFERRED if the file isn't after reading what it was before."""
    from .parsers import parse

    before = _facts(whole)
    record, code, text, n = (read or parse)(whole, fmt)
    if before is None or before != _facts(whole):
        return "DEFERRED", None, "FILE_UNSTABLE", "the file changed while it was read", n
    return ("EXTRACTED" if record else "FAILED"), record, code, text, n


def extracted(files: DataFrame, root: str) -> DataFrame:
    """The metadata of files (path, format, byte_size, modified_at): state EXTRACTED, FAILED, or DEFERRED if the file changed meanwhile."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, fmt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state, record, code, text, n = read_stable(os.path.join(root, path), fmt)
                r = record or {}
                rows.append((path, fmt, state, r.get("title"), r.get("contributors"), r.get("language"), list(r["identifiers"].items()) if record else None, list(r["extra"].items()) if record else None, code, text, n))
            text_list = pa.list_(pa.string())
            types = [pa.string(), pa.string(), pa.string(), pa.string(), text_list, pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), text_list), pa.string(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in EXTRACTED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.where("problem is null").select("path", "format").mapInArrow(work, EXTRACTED)


def opened(root: str, path: str) -> int:
    """A descriptor of a file below root. Each component is opened in the one before, and none is a link; so what is checked is what is read.

    Raises PermissionError for a link or a path that leaves the root, and another OSError for what isn't there.
    """
    parts = path.split("/")
    if any(p in ("", ".", "..") for p in parts) or "\0" in path:
        raise PermissionError(errno.EPERM, "the path leaves its root")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for k, name in enumerate(parts):
            last = k == len(parts) - 1
            try:
                below = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | (os.O_NONBLOCK if last else os.O_DIRECTORY), dir_fd=at)
            except OSError as e:
                if stat.S_ISLNK(os.lstat(name, dir_fd=at).st_mode):
                    raise PermissionError(errno.EPERM, "a link isn't followed") from e
                raise
            os.close(at)
            at = below
        return at
    except BaseException:
        os.close(at)
        raise


def checked_fact(root: str, path: str, byte_size: int, modified_us: int, file_key: str | None) -> str:
    """OK, PATH_ESCAPE, UNAVAILABLE, or UNSTABLE if size, time (by more than a microsecond) or file key aren't those that were recorded."""
    try:
        at = opened(root, path)
    except PermissionError as e:
        return "PATH_ESCAPE" if e.errno == errno.EPERM else "UNAVAILABLE"
    except (OSError, ValueError):
        return "UNAVAILABLE"
    try:
        s = os.fstat(at)
        if not stat.S_ISREG(s.st_mode):
            return "UNAVAILABLE"
        same = s.st_size == byte_size and abs(s.st_mtime_ns - modified_us * 1000) <= 1000 and (file_key is None or file_key == f"{s.st_dev}:{s.st_ino}")
        return "OK" if same else "UNSTABLE"
    finally:
        os.close(at)


def checked_facts(locations: DataFrame, root: str) -> DataFrame:
    """(path, fact) of locations (path, byte_size, modified_at, file_key): whether each may be read as what was catalogued."""
    source = locations.select("path", F.col("byte_size").cast("long"), F.unix_micros(F.col("modified_at").cast("timestamp")).alias("modified"), "file_key")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            facts = ["UNAVAILABLE" if path is None or size is None or at is None else checked_fact(root, path, size, at, key) for path, size, at, key in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(facts, pa.string())], names=["path", "fact"])

    return source.mapInArrow(work, "path string, fact string")


def validated_epubs(files: DataFrame, root: str) -> DataFrame:
    """(path, problem): a row for each reason not to publish a converted EPUB."""

    def work(batches):
        import pyarrow as pa

        from .parsers import epub_violations

        for batch in batches:
            rows = [(p, v) for p in batch.column(0).to_pylist() for v in epub_violations(os.path.join(root, p))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["path", "problem"])

    return files.select("path").mapInArrow(work, "path string, problem string")
