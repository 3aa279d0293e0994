"""Operations: exports, manifests and their verification, state after a restore, content-addressed publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes that are read and hashed at once.
_SLICE = 1 << 22


def _digest(path: str) -> tuple[int, str]:
    import hashlib

    digest, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while data := f.read(_SLICE):
            digest.update(data)
            n += len(data)
    return n, digest.hexdigest()


def manifest(files: DataFrame, root: str) -> DataFrame:
    """(path, byte_size, sha256) of files (path) below root, which all executors share: each is read in slices, however large it is. One that can't be read has nulls."""

    def work(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append((path, *_digest(os.path.join(root, path))))
                except OSError:
                    rows.append((path, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "byte_size", "sha256"])

    return files.select("path").mapInArrow(work, "path string, byte_size long, sha256 string")


def manifest_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): MISSING, EXTRA or CHANGED; empty if the two manifests (path, byte_size, sha256) agree."""
    a = expected.select("path", F.struct("byte_size", "sha256").alias("_a"))
    b = found.select("path", F.struct("byte_size", "sha256").alias("_b"))
    both = a.join(b, "path", "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").otherwise("CHANGED").alias("problem"))


def jobs_after_restore(jobs: DataFrame, at: Column, state: str = "CANCELLED") -> DataFrame:
    """jobs or tasks after a restore: what was queued or under way ends, without its lease.

    state: CANCELLED for scans and their tasks, FAILED_SAFE for the jobs of workers, whose staged files aren't in a backup.
    """
    ends = F.col("state").isin("QUEUED", "RUNNING")
    gone = {c: F.when(~ends, F.col(c)) for c in ("lease_token", "lease_until", "heartbeat_at") if c in jobs.columns}
    return jobs.withColumns(gone | {"code": F.when(ends, "RESTORE_INTERRUPTED").otherwise(F.col("code")), "finished_at": F.when(ends, at).otherwise(F.col("finished_at")), "state": F.when(ends, state).otherwise(F.col("state"))})


def locations_after_restore(locations: DataFrame, roots: DataFrame) -> DataFrame:
    """Whatever stands on a read-only source is unavailable until it is scanned again; managed roots were verified. roots: (root_id, mode)."""
    sources = roots.where("mode = 'READ_ONLY_SOURCE'").select("root_id", F.lit(True).alias("_source"))
    return locations.join(sources, "root_id", "left").withColumn("availability", F.when(F.col("_source"), "UNAVAILABLE").otherwise(F.col("availability"))).drop("_source")


def exported_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def content_path(kind: str, sha: Column, extension: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(f".{extension}"))


def publish(whole: str, content: bytes) -> None:
    """Puts the content at its place: written beside it, then linked, which never replaces what is there. The same content there is fine, other content raises."""
    import os
    import uuid

    os.makedirs(os.path.dirname(whole), exist_ok=True)
    part = f"{whole}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, whole)
        except FileExistsError:
            at = 0
            with open(whole, "rb") as f:
                while data := f.read(_SLICE):
                    if content[at : at + len(data)] != data:
                        break
                    at += len(data)
                else:
                    if at == len(content):
                        return
            raise ValueError(f"other content at {whole}") from None
    finally:
        os.unlink(part)


def published(items: DataFrame, folder: str, kind: str, extension: str) -> DataFrame:
    """Puts the distinct contents (content) at their content-addressed places below folder; (sha256, path, byte_size).

    Tasks that run twice, one after the other or at once, leave one file and no part of one. folder must be one that all
    executors share.
    """
    named = items.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).withColumn("path", content_path(kind, F.col("sha256"), extension))

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            out = []
            for sha, content, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                publish(os.path.join(folder, path), content)
                out.append((sha, path, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["sha256", "path", "byte_size"])

    return named.mapInArrow(write, "sha256 string, path string, byte_size long")


def route_key(source_sha: Column, route_version: str, settings: Column) -> Column:
    """Identifies a conversion, so that one asked for twice is made once."""
    return F.sha2(F.concat_ws("|", source_sha, F.lit(route_version), settings), 256)


#: Fixed order of cover sources.
COVER_RANK = {"PREFERRED": 0, "DECLARED": 1, "DOCX": 2, "PDF": 3}


def chosen_covers(covers: DataFrame) -> DataFrame:
    """The cover of each work (work_id, cover_id, origin, created_at): preferred, declared, DOCX, PDF, other; then the oldest."""
    from .primitives import first_per_group

    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COVER_RANK.items() for x in kv]), F.col("origin")), F.lit(len(COVER_RANK)))
    return first_per_group(covers, ["work_id"], [rank, F.col("created_at"), F.col("cover_id")])
