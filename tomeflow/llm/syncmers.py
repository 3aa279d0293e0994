"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its s-mers is its first or last: whether it is one
depends on the k-mer alone, so an edit moves no anchor that it doesn't touch. Of a document's anchors, those with a hash
below 1/`SAMPLED` of all, and the `KEPT` with the smallest hashes at least, are its fingerprint, written in the order
of their first places in the text: it grows with the text, and all anchors of a text with few are in it. Two
fingerprints are alike by the share of the hashes below the bound of both that both have, in the same order (the longest
common run of places that grows in both).

A text of fewer than `RUNS_BELOW` code points has few anchors or none, so its fingerprint also holds all of its runs of `SHORT`
code points. Two such texts are compared by their runs, any other two by their anchors, always the same on both sides.

next_texts() gives each document the one that follows it by id without sorting the table in one place: rows are cut
into ranges by id and hash of the text, each range's rows meet in one task, and the first row of a range also goes to the
range before it. So rows with one id, or none, are dealt over many ranges unless their texts are equal, too.

Defined results: a null text is an empty one; an empty text's fingerprint is empty, and two empty ones are alike
by 1; a text of fewer than 4 code points is a run itself; ids of any type that can be sorted will do; null ids come first;
rows with one id are ordered by their texts' hashes; a single row follows itself; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_RANGES, code_points, mix64, only, range_of

K = 12
S = 5
#: Texts of fewer than RUNS_BELOW code points are also compared by their runs of SHORT code points.
SHORT = 4
RUNS_BELOW = 4 * K
KEPT = 128
SAMPLED = 16
_B = 0x9E3779B97F4A7C15
#: Rows are cut into at most MOST_RANGES ranges of about RANGE rows or more.
RANGE = 2000
_CHARS = 1 << 20


def _mers(codes: np.ndarray, n: int) -> np.ndarray:
    """The polynomial hash of the n code points from each place on."""
    h, have, out, done = codes, 1, None, 0
    while True:
        if n >> (have.bit_length() - 1) & 1:  # append a block of `have` code points
            if out is None:
                out, done = h, have
            else:
                m = len(codes) - done - have + 1
                out = out[:m] * np.uint64(pow(_B, have, 1 << 64)) + h[done : done + m]
                done += have
        if have * 2 > n:
            return out
        h = h[:-have] * np.uint64(pow(_B, have, 1 << 64)) + h[have:]
        have *= 2


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1])


class Fingerprint(NamedTuple):
    """Distinct 32-bit hashes of anchors, and of a short text's runs, each in the order of their first places."""

    anchors: np.ndarray
    runs: np.ndarray | None


def _runs(text: str) -> np.ndarray:
    runs = dict.fromkeys(text[j : j + SHORT] for j in range(max(1, len(text) - SHORT + 1))) if text else ()
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") for x in runs], np.uint32)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    """Each text's fingerprint."""
    codes, at = code_points(texts)
    codes = codes.astype(np.uint64) + np.uint64(1)
    if len(codes) >= K:
        inner = mix64(_mers(codes, S))
        least = _window_min(inner, K - S + 1)
        n = len(codes) - K + 1
        anchors = np.flatnonzero((least == inner[:n]) | (least == inner[K - S : K - S + n]))
        hashes = (mix64(_mers(codes, K)[anchors]) >> np.uint64(32)).astype(np.uint32)
    else:
        anchors, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    first = np.searchsorted(anchors, at[:-1])
    last = np.searchsorted(anchors, np.maximum(at[1:] - K + 1, at[:-1]))
    out = []
    for i, text in enumerate(texts):
        own, place = np.unique(hashes[first[i] : last[i]], return_index=True)
        kept = max(KEPT, int(np.searchsorted(own, (1 << 32) // SAMPLED)))
        out.append(Fingerprint(own[:kept][np.argsort(place[:kept])], _runs(text) if len(text) < RUNS_BELOW else None))
    return out


def as_string(fingerprint: Fingerprint) -> str:
    """The anchors in hex; a short text's runs follow a hyphen."""
    anchors, runs = (None if x is None else x.astype(">u4").tobytes().hex() for x in fingerprint)
    return anchors if not runs else f"{anchors}-{runs}"


def from_string(fingerprint: str) -> Fingerprint:
    anchors, short, runs = fingerprint.partition("-")
    return Fingerprint(*(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) if x or short or not fingerprint else None for x in (anchors, runs)))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: the share of the hashes below the bound of both that both have in the same order."""
    short = a.runs is not None and b.runs is not None
    x, y = ((f.runs if short else f.anchors).tolist() for f in (a, b))
    if not x or not y:
        return float(short and len(x) == len(y))
    place = {h: i for i, h in enumerate(y)}
    below = min(_bound(x), _bound(y))
    union = {h for h in x if h < below} | {h for h in y if h < below}
    ends: list[int] = []
    for h in x:
        i = place.get(h)
        if i is not None and h in union:
            at = bisect_left(ends, i)
            ends[at : at + 1] = [i]
    return len(ends) / len(union)


def _bound(fingerprint: list[int]) -> int:
    """Below it a fingerprint has all hashes that its text has."""
    return 1 << 32 if len(fingerprint) < KEPT else max((1 << 32) // SAMPLED, max(fingerprint) + 1)


def next_texts(docs: DataFrame) -> DataFrame:
    """(bucket, helper, doc_id, text), each bucket's rows together in one task, in order.

    A bucket's rows by id, then helper rows, of which the first is what follows the bucket's last row.
    """
    docs = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.struct(F.col("doc_id").alias("d"), F.col("hash").alias("h"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE))
    dealt = docs.select("doc_id", "hash").repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "hash")
    starts = sorted((r.least for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(row).alias("least")).collect()), key=lambda x: (x.d is not None, *(v for v in x if v is not None)))  # a row a range
    least, bounds = starts[:1], starts[1:]
    fields = f"d:{kind},h:bigint"
    at = F.struct(range_of(row, fields, bounds).alias("own"), range_of(row, fields, least)["bound"].alias("first"))
    bucket, is_bound, is_first = F.col("at.own.number").cast("int"), F.col("at.own.bound"), F.col("at.first")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("helper"))
    places = F.array_compact(
        F.array(
            own,
            F.when(is_bound, F.struct((bucket - 1).alias("bucket"), F.lit(True).alias("helper"))),
            F.when(is_first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("helper"))),
        )
    )
    placed = docs.withColumn("at", at).select(F.inline(places), "doc_id", "text", "hash")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "helper", F.col("doc_id").asc_nulls_first(), "hash", "text").drop("hash")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    source = next_texts(docs)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def work(rows):
        """rows: (doc_id, index of its text, index of the next one's), texts -> columns."""
        chosen, texts = rows
        edited = []
        for _, i, j in chosen:
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[j][:cut])
        own, other = fingerprints(texts), fingerprints(edited)
        return [
            [d for d, _, _ in chosen],
            [len(texts[i]) for _, i, _ in chosen],
            [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
            [as_string(own[i]) for _, i, _ in chosen],
            [as_string(x) for x in other],
            [likeness(own[i], x) for (_, i, _), x in zip(chosen, other, strict=True)],
            [likeness(own[i], own[j]) for _, i, j in chosen],
        ]

    fields = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):
        import pyarrow as pa

        chosen, texts, waiting, chars = [], [], None, 0  # waiting: (bucket, doc_id, index) of the row whose next isn't known yet

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(work((chosen, texts)), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for bucket, helper, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if helper and waiting is None:
                    continue
                texts.append(text)
                chars += len(text)
                if waiting is not None:
                    chosen.append((waiting[1], waiting[2], len(texts) - 1))
                waiting = None if helper else (bucket, doc_id, len(texts) - 1)
                if chars > _CHARS and chosen:
                    yield flushed()
                    chosen, chars = [], 0
                    if waiting is not None:
                        texts, waiting = [texts[-1]], (waiting[0], waiting[1], 0)
                        chars = len(texts[0])
                    else:
                        texts = []
        if chosen:
            yield flushed()

    return source.mapInArrow(run, fields)
