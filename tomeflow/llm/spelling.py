"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words.

1.  Runs of letters are counted text by text and added up within a task before (word, n) rows are shuffled.
2.  Every word is cut into two segments, of length // 2 code points and the rest. If one code point is inserted, deleted
    or replaced, one of the two stays whole: the left one at the beginning of the other word, or the right one at its end.
3.  Segments are dealt over shards; each shard has one automaton over its segments. A word is scanned by the shards that
    may hold a segment it begins or ends with: with lengths one apart at most, four segments. A match counts if its
    offset is the first (left) or it ends the word (right), and the pattern's word is at most one longer or shorter; then
    the two words are compared. What the left segment finds the right one doesn't report again.
4.  A segment of more than PER_BLOCK words is dealt over blocks, and the words that have it are scanned by all of them.
    No pair leaves its task: each word's near words are summed to their number and the best of them.
5.  Forms grow in n, so following them ends; each round jumps from a form to its form's form.

Defined results: a null text has no words; in the hashed key a null id is the empty string; repeated rows count as often
as they occur; ties of n go to the smaller word by code points; words and texts of any length are taken whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs so many times as often as the word at least.
TIMES = 5
#: A code point is deleted from the runs whose hash this divides.
EDITED = 199
PER_SHARD = 4096
PER_BLOCK = 2048
MOST_PARTITIONS = 4096
#: Distinct words that a task adds up before it hands them on, characters of a text that are split at once, words that are scanned at once.
_HELD, _AT_ONCE, _SCANNED = 1 << 18, 1 << 22, 1 << 13


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points or more, n being how often each occurs."""
    source = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text").where("text is not null")

    def run(batches):
        import pyarrow as pa

        # a run that an edit shortens stays long enough only if it was longer, so shorter runs are passed over
        pattern = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
        held: dict[str, int] = {}

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # on bytes, lower() knows A-Z only
                found = Counter(pattern.findall(text) if len(text) < _AT_ONCE else (m.group() for m in pattern.finditer(text)))
                start = zlib.crc32(key.as_py().encode("utf-8", "surrogatepass") + b":")
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % EDITED:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield flushed()
        yield flushed()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near(v: str, w: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between v and w."""
    if len(v) == len(w):
        return sum(map(ne, v, w)) == 1
    if len(v) > len(w):
        v, w = w, v
    if len(w) - len(v) != 1:
        return False
    at = next((i for i, (a, b) in enumerate(zip(v, w, strict=False)) if a != b), len(v))
    return v[at:] == w[at + 1 :]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _near_all(vs: list[str], ws: list[str]):
    """Pairs (i, j) of near vs[i] and ws[j]; all of vs have one length, and all of ws."""
    if len(vs) * len(ws) <= 32:
        yield from ((i, j) for i, v in enumerate(vs) for j, w in enumerate(ws) if near(v, w))
        return
    a, b = _codes(ws), _codes(vs)
    short, long = sorted((a.shape[1], b.shape[1]))
    step = max(1, (1 << 21) // a.size)
    for i in range(0, len(b), step):
        x, y = b[i : i + step, None, :], a[None, :, :]
        if short == long:
            found = (x != y).sum(axis=2) == 1
        else:
            head, tail = (x[..., :short] == y[..., :short]), (x[..., -short:] == y[..., -short:])
            found = np.logical_and.accumulate(head, axis=2).sum(axis=2) + np.logical_and.accumulate(tail[..., ::-1], axis=2).sum(axis=2) >= short
        yield from ((i + int(p), int(j)) for p, j in zip(*np.nonzero(found), strict=True))


class Shard:
    """An automaton over segments of words."""

    def __init__(self, patterns: list[tuple[int, str, str, int]]):
        import ahocorasick

        #: Of each segment, side and length: the words, and how often they occur.
        self.groups: list[dict[tuple[int, int], tuple[list[str], list[int]]]] = []
        self.automaton = ahocorasick.Automaton()
        index: dict[str, int] = {}
        for side, segment, word, n in patterns:
            if segment not in index:
                index[segment] = len(index)
                self.groups.append({})
                self.automaton.add_word(segment, (index[segment], len(segment)))
            words, counts = self.groups[index[segment]].setdefault((side, len(word)), ([], []))
            words.append(word)
            counts.append(n)
        self.automaton.make_automaton()

    def scanned(self, words: list[str]) -> dict[str, tuple[int, int, str]]:
        """(number of near words, the largest n among them, its word) of each of the words that have any here."""
        meets: dict[tuple[int, int, int, int], list[str]] = defaultdict(list)
        for v in words:
            last = len(v) - 1
            for end, (index, length) in self.automaton.iter(v):
                sides = ([0] if end + 1 == length else []) + ([1] if end == last else [])
                for side in sides:
                    for of in (last, last + 1, last + 2):
                        if (side, of) in self.groups[index]:
                            meets[index, side, of, last + 1].append(v)
        found: dict[str, tuple[int, int, str]] = {}
        for (index, side, of, _), vs in meets.items():
            ws, counts = self.groups[index][side, of]
            for i, j in _near_all(vs, ws):
                v, w = vs[i], ws[j]
                if side and v.startswith(w[: of // 2]):
                    continue  # the left segment finds it
                number, n, best = found.get(v, (0, 0, ""))
                if not number or (-counts[j], w) < (-n, best):
                    n, best = counts[j], w
                found[v] = (number + 1, n, best)
        return found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many near words each has, and the struct (less, best) of minus the largest n and its word."""
    shards = max(1, -(-2 * words.count() // PER_SHARD))
    length, half = F.length("word"), (F.length("word") / 2).cast("int")

    def left(n):
        return F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), n).alias("segment"))

    def right(n):
        return F.struct(F.lit(1).alias("side"), F.substring("word", length - n + 1, n).alias("segment"))

    patterns = words.select("word", "n", F.inline(F.array(left(half), right(length - half))))
    # the segments of words that are one shorter, as long, or one longer
    fewer, more = ((length - 1) / 2).cast("int"), ((length + 1) / 2).cast("int")
    routes = F.array_distinct(F.array(left(fewer), left(half), left(more), right(length - 1 - fewer), right(length - half), right(length + 1 - more)))
    scans = words.select("word", F.inline(routes))
    hot = written(patterns.groupBy("side", "segment").agg(F.count("*").alias("words")).where(F.col("words") > PER_BLOCK).select("side", "segment", F.ceil(F.col("words") / PER_BLOCK).alias("blocks")), "spelling-hot")

    def shard(block):
        return F.pmod(F.xxhash64("side", "segment", block), F.lit(shards)).alias("shard")

    blocks = F.coalesce("blocks", F.lit(1))
    dealt = patterns.join(hot, ["side", "segment"], "left").select(shard(F.pmod(F.xxhash64("word"), blocks)), F.lit(0).alias("kind"), "word", "n", "side", "segment")
    scans = scans.join(hot, ["side", "segment"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    scans = scans.select(shard(F.col("block")), F.lit(1).alias("kind"), "word", F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("segment"))
    rows = dealt.unionByName(scans).repartition(min(shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "kind", "word")

    def run(batches):
        import pyarrow as pa

        at, patterns, automaton, waiting, before = None, [], None, [], None

        def scanned():
            found = automaton.scanned(waiting)
            waiting.clear()
            columns = [list(found), [f[0] for f in found.values()], [-f[1] for f in found.values()], [f[2] for f in found.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "less", "best"])

        for batch in batches:
            for own, kind, word, n, side, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at:
                    if waiting:
                        yield scanned()
                    at, patterns, automaton, before = own, [], None, None
                if kind == 0:
                    patterns.append((side, segment, word, n))
                elif patterns and word != before:  # several of its segments may be here; it is scanned once
                    automaton, before = automaton or Shard(patterns), word
                    waiting.append(word)
                    if len(waiting) >= _SCANNED:
                        yield scanned()
        if waiting:
            yield scanned()

    found = rows.mapInArrow(run, "word string, n_near long, less long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every row of links (word, form): the last word that following forms comes to."""
    at = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        further = written(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        dropped(at)
        at = further.select("word", "root")
        if further.where("moved").isEmpty():
            return at


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs LEAST_COUNT times or more."""
    words = written(counted_words(docs).where(F.col("n") >= LEAST_COUNT), "spelling-words")
    best = -F.col("best.less")
    chosen = best >= TIMES * F.col("n")
    formed = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.best")).alias("form"), F.when(chosen, best).alias("form_n"))
    formed = written(formed, "spelling-formed")
    dropped(words)
    found = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
