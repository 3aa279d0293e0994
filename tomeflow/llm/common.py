"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8. On bytes, lower() and split() know ASCII only, as asked."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a new one; a cluster can't do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tomeflow-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tomeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing needs any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of these names, however others are named: names that differ in case only are ambiguous to Spark."""
    return df.toDF(*(c if c in columns else f"__{i}" for i, c in enumerate(df.columns))).select(*columns)


#: Ranges that range_of() tells apart at most.
MOST_RANGES = 1 << 14


def range_of(row: Column, kinds: str, bounds: list) -> Column:
    """A struct (number, bound): how many of the sorted bounds are no greater than the row, a struct, and whether it is one of them.

    kinds: the struct's fields as DDL. bounds: rows with those fields, MOST_RANGES at most. They become constants of the
    plan, in two levels, and structs compare as Spark sorts them, nulls first.
    """
    import json

    if not bounds:
        return F.struct(F.lit(0).alias("number"), F.lit(False).alias("bound"))
    if len(bounds) > MOST_RANGES:
        raise ValueError(f"{len(bounds)} bounds, more than {MOST_RANGES}")
    width = int(len(bounds) ** 0.5) + 1
    groups = [[b.asDict() for b in bounds[i : i + width]] for i in range(0, len(bounds), width)]

    def literal(values, depth: int) -> Column:
        return F.from_json(F.lit(json.dumps(values, default=str)), "array<" * depth + f"struct<{kinds}>" + ">" * depth)

    def bind(value: Column, then) -> Column:
        """then(value) with the value computed once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def placed(x: Column, group: Column) -> Column:
        inside = F.element_at(literal(groups, 2), F.greatest(group, F.lit(1)))
        number = F.when(group == 0, 0).otherwise((group - 1) * width + F.size(F.filter(inside, lambda b: b <= x)))
        return F.struct(number.alias("number"), ((group > 0) & F.exists(inside, lambda b: b == x)).alias("bound"))

    return bind(row.cast(f"struct<{kinds}>"), lambda x: bind(F.size(F.filter(literal([g[0] for g in groups], 1), lambda b: b <= x)), lambda group: placed(x, group)))


def held_out(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 3 = 1: rows whose labels are never learned from. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, the same ones on every run: those whose hashed key lies below a share. All, if there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7919), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def mix64(x):
    """splitmix64's finaliser over a numpy array of uint64."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes, most: int):
    """Ranges (i, j) of consecutive items whose sizes sum to about `most`; one item at least."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if len(sizes) > i:
        yield i, len(sizes)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def map_texts(df: DataFrame, keep: list[str], fn, fields: str, text: str = "text", most_chars: int = 1 << 21) -> DataFrame:
    """The columns `keep` of df beside those that fn makes of each text.

    fn gets a list of texts (None where null) and returns a list of columns, in the order of `fields`, a DDL
    string. Texts are handed over in slices of about `most_chars` characters, so memory follows the longest text
    and not the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = df.select(*keep, F.col(text).alias("__text"))
    schema = StructType([source.schema[c] for c in keep] + list(StructType.fromDDL(fields).fields))
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column(len(keep))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for i, j in slices(sizes, most_chars):
                made = fn(column.slice(i, j - i).to_pylist())
                kept = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(kept, arrow, strict=False)] + [pa.array(m, type=f.type) for m, f in zip(made, list(arrow)[len(keep) :], strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def rows_and_texts(docs: DataFrame) -> DataFrame:
    """(row, text): each row whole, as a struct, beside its text."""
    return whole_rows(docs, "text")


def whole_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as a struct, `row`, beside the columns of these names."""
    names = [f"__{i}" for i in range(len(df.columns))]
    row = F.struct(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True))).alias("row")
    return df.toDF(*names).select(row, *(F.col(names[df.columns.index(c)]).alias(c) for c in columns))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most about `most` documents whose labels may be learned from.

    The sampled labels are few, so documents meet them by broadcast and no text is shuffled. Rows that repeat id and
    text count once, and if ids repeat so often that there are more than `most` all the same, they are sampled again.
    """
    docs, labels = only(docs, "doc_id", "text"), only(labels, "doc_id", label)
    may = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    found = written(docs.select("doc_id", "text").join(F.broadcast(bounded_sample(may, "doc_id", most)), "doc_id").withColumn("row_key", F.xxhash64("doc_id", "text")), "labelled")
    once = found
    if found.select("row_key").distinct().count() < found.count():
        once = written(found.dropDuplicates(["row_key"]), "labelled-once")
    return bounded_sample(once, "row_key", 2 * most).select("doc_id", "text", "label")


def code_points(texts: list[str]):
    """All texts' code points one after the other, and the offsets at which each begins, with the end."""
    import numpy as np

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    return codes, at


_classes = None
#: Beyond these code points, the ideographs' last block, no letters are.
_CODES = 0x33500

SPACE, LOWER, UPPER, DIGIT, SYMBOL, NEWLINE = range(6)


def char_classes(codes):
    """The class of each code point; letters without case count as lower."""
    import numpy as np

    global _classes
    if _classes is None:
        of = [LOWER if (c := chr(i)).isalpha() and not c.isupper() else UPPER if c.isupper() else DIGIT if c.isdigit() else SPACE if c.isspace() else SYMBOL for i in range(_CODES)]
        _classes = np.array(of, np.uint8)
        _classes[10] = NEWLINE
    return _classes[np.minimum(codes, _CODES - 1)]
