"""Removal of byte strings that occurred before, by bucket-pointer refinement of sampled suffixes.

A window is a string of `length` bytes of one text. Sorting all suffixes would move every byte of the corpus several
times, so suffixes are sampled where their first q bytes have the least identifier among a window's q-grams: every window
has one such anchor, and equal windows have equal anchors at equal offsets. The windows of one anchor are consecutive, a
segment.

1.  Identifiers of q-grams are made from those of 1, 2, 4 ... bytes: a string's is that of the pair (its first half's, that
    of the later offset where its last half begins).
2.  Segments are dealt by their anchor's q-gram, the initial buckets, and refined by what stands around it: the bucket's
    segments whose bytes are all alike are one class, of which the first, by document and place, is kept and all others
    are repeats. A bucket with one class is settled: its windows occur there for the first time.
3.  The first segments of buckets with several classes are refined to single windows: the q-gram's identifier is
    carried on through later offsets to 2q, 4q ... and the whole window. Windows of one bucket and identifier are
    equal; all but the first are repeats.

Hashes stand for strings throughout, always two independent ones of 64 bits: bucket and class, bucket and window. Rows of
a class that meet in a map task are settled there, so a passage that stands in a third of all documents sends a row for
each task and not for each document. Buckets are dealt by ranges of identifiers whose sizes are counted over the
whole corpus first; a crowded range is dealt again by class (by window, in step 3), and then all its first segments
go on to step 3, as its buckets aren't in one place.

Defined results: a null text is an empty one; texts shorter than `length` keep all bytes; rows with one id come in
the order of their texts' hashes and null ids after all others, so of repeated rows the first keeps its bytes and the others
lose them if they are long enough; ids of any type that can be sorted will do; a text of any length is taken whole; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, only, slices, written
from .jaccard import Sift
from .syncmers import _window_min

LENGTH = 100
#: About so many segments or windows make a range of buckets; there are 2^MOST_BITS ranges at most, and larger ones then.
PER_RANGE = 1 << 17
MOST_BITS = 18
#: A range is dealt again if it has so many times that, or the mean.
CROWDED = 4
MOST_PARTITIONS = 4096
#: Bytes whose identifiers are made at once, windows of one text among them, and rows that a task settles at once.
_BLOCK, _CHUNK, _HELD = 1 << 17, 1 << 17, 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
#: Below it in a dealt row's key stands the part of a crowded range.
_PART = 20


def gram_of(length: int) -> int:
    """The q of the initial buckets."""
    return max(1, length * 24 // 100)


def refined(ids: np.ndarray, have: int, want: int) -> np.ndarray:
    """From the identifiers of the strings of `have` bytes at each place, those of `want` bytes."""
    while have < want:
        step = min(have, want - have)
        ids = mix64(ids[: len(ids) - step] * _M + ids[step:])
        have += step
    return ids


def identifiers(data: bytes, q: int) -> np.ndarray:
    """The identifiers of the q-grams at each place."""
    return refined(mix64(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)), 1, q)


def _blocks(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(index, offset, bytes) of the texts in lists of about _BLOCK bytes; a long text's parts begin at multiples of _CHUNK."""
    held, size = [], 0
    for i, text in enumerate(texts):
        windows = len(text) - length + 1
        for at in range(0, windows, _CHUNK):
            held.append((i, at, text[at : min(at + _CHUNK, windows) + length - 1]))
            size += len(held[-1][2])
            if size > _BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _parts(batch, text: int) -> Iterator:
    """The batch in slices of about 16 * _BLOCK bytes of text, so that not all texts of a batch are held twice."""
    import pyarrow.compute as pc

    for i, j in slices(pc.binary_length(batch.column(text)).to_pylist(), 16 * _BLOCK):
        yield batch.slice(i, j - i)


def segments(texts: list[bytes], length: int, classes: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, start, windows, q-gram of the anchor, class) of all segments, block by block."""
    from xxhash import xxh3_64_intdigest

    q = gram_of(length)
    for held in _blocks(texts, length):
        raw = b"".join(part for *_, part in held)
        sizes = np.array([len(part) for *_, part in held])
        ends = np.cumsum(sizes)
        ids = identifiers(raw, q)
        anchor = (_window_min((ids & ~_PLACE) | np.arange(len(ids), dtype=np.uint64), length - q + 1) & _PLACE).astype(np.int64)
        of = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= ends[of]
        edge = np.ones(len(anchor) + 1, bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(edge)
        own = np.flatnonzero(inside[at[:-1]])
        low, high = at[own], at[own + 1]
        index, offset = np.array([i for i, *_ in held]), np.array([a for _, a, _ in held])
        gram = mix64(ids[anchor[low]])  # anchors have small identifiers; mixed again, they are spread over all ranges
        view = memoryview(raw)
        found = [xxh3_64_intdigest(view[i:j]) for i, j in zip(low.tolist(), (high + length - 1).tolist(), strict=True)] if classes else []
        yield index[of[low]], offset[of[low]] + low - (ends - sizes)[of[low]], high - low, gram, np.array(found, np.uint64)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Which of sorted rows differ from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _packed(number: np.ndarray, start: np.ndarray, windows: np.ndarray) -> bytes:
    return zlib.compress(np.diff(number, prepend=0).astype(np.int64).tobytes() + start.astype(np.uint32).tobytes() + windows.astype(np.uint32).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    data = zlib.decompress(packed)
    n = len(data) // 16
    return np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(data, np.uint32, n, 12 * n).astype(np.int64)


def _merged(number: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges of windows, those that follow each other as one."""
    order = np.lexsort((start, number))
    number, start, windows = number[order], start[order], windows[order]
    new = _first_of(number)
    if len(new):
        new[1:] |= start[1:] != start[:-1] + windows[:-1]
    at = np.flatnonzero(new)
    return number[at], start[at], np.add.reduceat(windows, at) if len(at) else windows


def _range_of(gram: np.ndarray, bits: int) -> np.ndarray:
    return (gram >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(gram), np.int64)


def _bits(rows: int) -> int:
    return min(MOST_BITS, max(0, (max(rows, 1) // PER_RANGE).bit_length()))


def _dealt_into(counts: list, bits: int) -> np.ndarray:
    """Into how many parts each range is dealt, from its number of rows."""
    sizes = np.zeros(1 << bits, np.int64)
    for at, n in counts:
        sizes[at] = n
    most = max(CROWDED * PER_RANGE, CROWDED * int(sizes.mean()))
    return np.minimum(np.where(sizes > most, -(-sizes // (most // CROWDED)), 1), (1 << _PART) - 1)


def numbered(docs: DataFrame) -> DataFrame:
    """(number, doc_id, text): numbers grow in the order of the documents, and each row has its own."""
    docs = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        # distinct ids are counted without moving texts
        repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
        if repeats.isEmpty():
            return docs.select(F.col("doc_id").cast("long").alias("number"), "doc_id", "text")
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "suffix-rows")
    order = rows.select("row", "doc_id", F.xxhash64("text").alias("key")).orderBy(F.col("doc_id").asc_nulls_last(), "key", "row")
    numbers = written(order.select("row", F.monotonically_increasing_id().alias("number")), "suffix-numbers")
    found = written(rows.join(numbers, "row").select("number", "doc_id", "text"), "suffix-documents")
    dropped(rows, numbers)
    return found


def _range_sizes(docs: DataFrame, bits: int, length: int) -> list:
    """(range, its segments) over all documents."""

    def run(batches):
        import pyarrow as pa

        sizes = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                for *_, gram, _ in segments(part.column(0).to_pylist(), length, classes=False):
                    sizes += np.bincount(_range_of(gram, bits), minlength=1 << bits)
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], names=["at", "n"])

    return docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect()  # 2^MOST_BITS rows at most


def _dealt_segments(docs: DataFrame, bits: int, parts: np.ndarray, length: int) -> DataFrame:
    """(at, grams, classes, places, repeats): what is left of a task's segments once their classes are settled there, by part."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []
        names = ["at", "grams", "classes", "places", "repeats"]

        def flushed():
            gram, kind, number, start, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, number, gram, kind))
            first = np.zeros(len(order), bool)
            first[order[_first_of(gram[order], kind[order])]] = True
            at = _range_of(gram, bits)
            at = at << _PART | (kind % shared.value[at].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((start, number, at))
            edges = np.flatnonzero(np.append(_first_of(at[order]), True))
            rows = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[i:j]
                new, old = own[first[own]], own[~first[own]]
                rows.append((int(at[own[0]]), gram[new].tobytes(), kind[new].tobytes(), _packed(number[new], start[new], windows[new]), _packed(*_merged(number[old], start[old], windows[old]))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(5)], names=names)

        size = 0
        for batch in batches:
            for part in _parts(batch, 1):
                numbers = part.column(0).to_numpy()
                for index, start, windows, gram, kind in segments(part.column(1).to_pylist(), length):
                    held.append((gram, kind, numbers[index], start, windows))
                    size += len(gram)
                    if size > _HELD:
                        yield flushed()
                        size = 0
        if held:
            yield flushed()

    return docs.select("number", "text").mapInArrow(run, "at long, grams binary, classes binary, places binary, repeats binary")


def _by_part(rows: DataFrame, partitions: int, settle, fields: str) -> DataFrame:
    """settle(at, rows of a part) -> columns, of every part; a part's rows meet in one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):
        import pyarrow as pa

        at, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at and held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(settle(at, held), arrow, strict=True)], schema=arrow)
                    held = []
                at = own
                held.append(row)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(settle(at, held), arrow, strict=True)], schema=arrow)

    return rows.repartition(max(1, min(partitions, MOST_PARTITIONS)), "at").sortWithinPartitions("at").mapInArrow(run, fields)


def settled_segments(docs: DataFrame, length: int) -> DataFrame:
    """(number, span, gram): repeated ranges of windows, whose gram is null, and segments that are to be refined.

    A span is start * 2^32 + windows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(size * 3 // length)  # about; an anchor has some length / 3 windows
    parts = _dealt_into(_range_sizes(docs, bits, length), bits)

    def settle(at: int, rows: list):
        gram, kind = (np.frombuffer(b"".join(r[k] for r in rows), np.uint64) for k in range(2))
        number, start, windows = (np.concatenate(c) for c in zip(*(_unpacked(r[2]) for r in rows), strict=True))
        repeats = [np.concatenate(c) for c in zip(*(_unpacked(r[3]) for r in rows), strict=True)]
        order = np.lexsort((start, number, kind, gram))
        first = _first_of(gram[order], kind[order])
        bucket = np.cumsum(_first_of(gram[order])) - 1
        several = np.bincount(bucket, first) > 1 if parts[at >> _PART] == 1 else np.ones(len(order), bool)
        old, unsure = order[~first], order[first & several[bucket]]
        number_, start_, windows_ = _merged(*(np.concatenate([a, b[old]]) for a, b in zip(repeats, (number, start, windows), strict=True)))
        none = np.zeros(len(number_), np.int64)
        return (
            np.concatenate([number_, number[unsure]]),
            np.concatenate([start_ << 32 | windows_, start[unsure] << 32 | windows[unsure]]),
            _masked(np.concatenate([none, gram[unsure].view(np.int64)]), len(none)),
        )

    return _by_part(_dealt_segments(docs, bits, parts, length), int(parts.sum()), settle, "number long, span long, gram long")


def _masked(values: np.ndarray, nulls: int) -> np.ma.MaskedArray:
    """The values, of which the first ones are null."""
    return np.ma.array(values, mask=np.arange(len(values)) < nulls)


def _told_apart(numbers: DataFrame, docs: DataFrame) -> tuple[Sift, DataFrame]:
    """(a sift that all the numbers pass, the documents that pass it), found without a shuffle."""
    sift = Sift(numbers)
    shared = docs.sparkSession.sparkContext.broadcast(sift)

    def passing(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column(0).to_numpy())))

    return sift, docs.mapInArrow(passing, docs.schema)


def settled_windows(unsure: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(number, span) of the windows in the segments `unsure` (number, span, gram) that occurred before."""
    q = gram_of(length)
    total = unsure.agg(F.sum(F.col("span").bitwiseAND(0xFFFFFFFF))).first()[0] or 0
    bits = _bits(total)
    at = F.shiftrightunsigned("gram", 64 - bits) if bits else F.lit(0).cast("long")
    parts = _dealt_into(unsure.groupBy(at.alias("at")).agg(F.sum(F.col("span").bitwiseAND(0xFFFFFFFF))).collect(), bits)  # 2^MOST_BITS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    spans = unsure.groupBy("number").agg(F.collect_list(F.struct("gram", "span")).alias("spans"))
    _, may = _told_apart(unsure.select("number").distinct(), docs.select("number", "text"))
    rows = may.join(spans, "number")

    def deal(batches):
        import pyarrow as pa

        def dealt(cut: list[bytes], gram, number, start, windows):
            """The rows of some segments, whose bytes are cut out."""
            raw = b"".join(cut)
            ids = refined(identifiers(raw, q), q, length)
            begin = np.cumsum(windows + length - 1) - (windows + length - 1)
            own = ids[np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())]
            of = _range_of(gram, bits)
            several = shared.value[of] > 1
            # segments stay whole, but in crowded ranges each window goes its own way
            each = np.repeat(np.arange(len(gram)), np.where(several, windows, 1))
            nth = np.arange(len(each)) - np.repeat(np.cumsum(np.where(several, windows, 1)) - np.where(several, windows, 1), np.where(several, windows, 1))
            first = np.repeat(np.cumsum(windows) - windows, np.where(several, windows, 1)) + nth
            count = np.where(several[each], 1, windows[each])
            key = of[each] << _PART | np.where(several[each], (own[first] % shared.value[of[each]].astype(np.uint64)).astype(np.int64), 0)
            order = np.lexsort((start[each] + nth, number[each], key))
            edges = np.flatnonzero(np.append(_first_of(key[order]), True))
            out = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                o = order[i:j]
                n = count[o]
                at = np.repeat(first[o] - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append((int(key[o[0]]), gram[each[o]].tobytes(), own[at].tobytes(), _packed(number[each[o]], (start[each] + nth)[o], n)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k else pa.int64()) for k in range(4)], names=["at", "grams", "windows", "places"])

        cut, held, size = [], [], 0
        for batch in batches:
            for part in _parts(batch, 1):
                for number, text, gram_and_span in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for x in sorted(gram_and_span, key=lambda x: x["span"]):
                        start, windows = x["span"] >> 32, x["span"] & 0xFFFFFFFF
                        cut.append(text[start : start + windows + length - 1])
                        held.append((x["gram"], number, start, windows))
                        size += windows
                        if size > _HELD:
                            gram, *more = (np.array(c, np.int64) for c in zip(*held, strict=True))
                            yield dealt(cut, gram.view(np.uint64), *more)
                            cut, held, size = [], [], 0
        if held:
            gram, *more = (np.array(c, np.int64) for c in zip(*held, strict=True))
            yield dealt(cut, gram.view(np.uint64), *more)

    def settle(_: int, rows: list):
        gram, window = (np.frombuffer(b"".join(r[k] for r in rows), np.uint64) for k in range(2))
        number, start, count = (np.concatenate(c) for c in zip(*(_unpacked(r[2]) for r in rows), strict=True))
        gram, number = np.repeat(gram, count), np.repeat(number, count)
        start = np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(window))
        order = np.lexsort((start, number, gram, window))
        old = order[~_first_of(window[order], gram[order])]
        number, start, windows = _merged(number[old], start[old], np.ones(len(old), np.int64))
        return number, start << 32 | windows

    return _by_part(rows.mapInArrow(deal, "at long, grams binary, windows binary, places binary"), int(parts.sum()), settle, "number long, span long")


def removed(text: bytes, spans: list[int] | None, length: int) -> tuple[int, int, str]:
    """(bytes removed, maximal runs of them, SHA-256 of what is left) of a text."""
    kept, n, runs, end = hashlib.sha256(), 0, 0, 0
    view = memoryview(text)
    for span in sorted(spans or ()):
        start, stop = span >> 32, (span >> 32) + (span & 0xFFFFFFFF) - 1 + length
        if start > end or not runs:
            kept.update(view[end:start])
            runs, n, end = runs + 1, n + stop - start, stop
        elif stop > end:
            n, end = n + stop - end, stop
    kept.update(view[end:])
    return n, runs, kept.hexdigest()


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document once its repeated windows' bytes are removed."""
    docs = numbered(docs)
    found = written(settled_segments(docs, length), "suffix-segments")
    spans = found.where("gram is null").select("number", "span").union(settled_windows(found.where("gram is not null"), docs, length))
    spans = written(spans.groupBy("number").agg(F.collect_list("span").alias("spans")), "suffix-spans")
    dropped(found)
    sift, touched = _told_apart(spans.select("number"), docs)
    shared = docs.sparkSession.sparkContext.broadcast(sift)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def measured(ids, texts: list[bytes], spans: list):
        import pyarrow as pa

        done = [removed(t, s, length) for t, s in zip(texts, spans, strict=True)]
        columns = [pa.array([len(t) for t in texts], pa.int64()), *(pa.array([d[k] for d in done], pa.string() if k == 2 else pa.int64()) for k in range(3))]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def cut(batches):
        for part in (p for batch in batches for p in _parts(batch, 1)):
            yield measured(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist())

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch.filter(pa.array(~shared.value.holds(batch.column(0).to_numpy()))), 2):
                yield measured(part.column(1), part.column(2).to_pylist(), [None] * part.num_rows)

    joined = touched.join(spans, "number", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, fields).unionByName(docs.mapInArrow(whole, fields))
