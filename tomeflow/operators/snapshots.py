"""Tables that only grow, and tables of which one version at a time is current.

Data are written to folders of their own first. They become part of a table by one small record, which names the folders of
a whole version and is moved to its place, `versions/version=N`, without overwriting: readers see the old version or the
new one, of all tables in the folder at once, and what a failed writer left is seen by none. Of two writers of one version
the second gets a VersionConflict. Where the file system moves folders atomically, as HDFS does, this holds for any
writers; a store that copies instead needs one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .primitives import first_per_group, insert_absent, written

_RECORD = "name string, folder string"
#: The one table of replaced(), and of appended().
_ONLY = "data"


class VersionConflict(RuntimeError):
    """Another writer has published this version."""


def versions(spark: SparkSession, at: str) -> DataFrame:
    """(name, folder, version) of all versions at `at`, none if there is none yet."""
    try:
        return spark.read.schema(f"{_RECORD}, version long").parquet(f"{at}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{_RECORD}, version long")
        raise


def folders(spark: SparkSession, at: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """(the current version, or the one asked for; the folders of its tables). 0 and none before the first one."""
    known = versions(spark, at)
    chosen = known.where(F.col("version") == version) if version is not None else known.join(known.agg(F.max("version").alias("version")), "version", "left_semi")
    rows = chosen.collect()  # a row a table
    if version is not None and not rows:
        raise LookupError(f"no version {version} at {at}")
    return (rows[0].version if rows else 0), {r["name"]: r.folder for r in rows}


def published(spark: SparkSession, at: str, version: int, names: dict[str, str]) -> None:
    """Makes the folders (name -> folder below `at`) version `version` of the tables at `at`; raises VersionConflict if there is one."""
    staged, final = f"{at}/staged-{uuid.uuid4().hex}", f"{at}/versions/version={version}"
    spark.createDataFrame(sorted(names.items()), _RECORD).coalesce(1).write.parquet(staged)
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(staged), fs.Path(final)
    context = fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    context.mkdir(target.getParent(), fs.permission.FsPermission.getDirDefault(), True)
    try:
        # without the option OVERWRITE a folder that is there isn't replaced
        context.rename(source, target, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise VersionConflict(f"version {version} at {at} is another writer's") from None
        raise


def replaced_all(tables: dict[str, DataFrame], at: str, expected: int | None = None) -> int:
    """Writes the tables as the next version, which takes over the tables that aren't named; returns the version.

    All become current together. expected: the version that was read; if another is current by now, VersionConflict.
    """
    spark = next(iter(tables.values())).sparkSession
    version, known = folders(spark, at)
    if expected is not None and version != expected:
        raise VersionConflict(f"version {version} at {at} is current, not {expected}")
    fresh = {}
    for name, df in tables.items():
        fresh[name] = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{at}/{fresh[name]}")
    published(spark, at, version + 1, known | fresh)
    return version + 1


def current_all(spark: SparkSession, at: str, version: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables) that are current, or were at an older version."""
    version, names = folders(spark, at, version)
    return version, {name: spark.read.parquet(f"{at}/{folder}") for name, folder in names.items()}


def changed_once(spark: SparkSession, at: str, change: Callable[[dict[str, DataFrame]], DataFrame], results: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Changes several tables at `at` by one set of rows, and returns it.

    change(tables) says what changes. It is computed once and stored, so that however uncertain it is (a random token, the
    time), results[name](table, changed) see the same rows; the tables become current together.
    """
    version, tables = current_all(spark, at)
    changed = written(change(tables), "changed")
    replaced_all({name: after(tables[name], changed) for name, after in results.items()}, at, expected=version)
    return changed


def replaced(df: DataFrame, at: str) -> int:
    """Writes df as the next version of the only table at `at` and makes it current; returns the version."""
    return replaced_all({_ONLY: df}, at)


def current(spark: SparkSession, at: str, version: int | None = None) -> DataFrame:
    """The current version of the only table at `at`, or an older one."""
    _, tables = current_all(spark, at, version)
    if _ONLY not in tables:
        raise LookupError(f"no version at {at}")
    return tables[_ONLY]


def appended(rows: DataFrame, at: str, keys: list[str], order: list[Column], tries: int = 10) -> DataFrame:
    """Appends the rows whose keys the table at `at` lacks, the first of each key, and returns it. Rows that come again change nothing.

    Each call adds a version. If another writer adds one meanwhile, what is new is found again.
    """
    spark = rows.sparkSession
    for _ in range(tries):
        version, known = folders(spark, at)
        fresh = insert_absent(grown(spark, at, rows), rows, keys, order) if known else first_per_group(rows, keys, order)
        name = f"{_ONLY}-{uuid.uuid4().hex}"
        fresh.write.parquet(f"{at}/{name}")
        try:
            published(spark, at, version + 1, {f"batch-{version + 1}": name})
            return grown(spark, at, rows)
        except VersionConflict:
            continue
    raise VersionConflict(f"{tries} tries to append to {at} met other writers")


def grown(spark: SparkSession, at: str, like: DataFrame, after: int = 0, until: int | None = None) -> DataFrame:
    """The rows that appended() has added to the table at `at` since version `after`, up to `until`."""
    known = versions(spark, at).where(F.col("version") > after)
    rows = (known if until is None else known.where(F.col("version") <= until)).collect()  # a row a batch
    return spark.read.schema(like.schema).parquet(*sorted(f"{at}/{r.folder}" for r in rows)) if rows else like.where("false")
