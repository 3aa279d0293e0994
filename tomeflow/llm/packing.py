"""Lexical retrieval packing: BM25 finds the documents that share a sequence.

Documents are tokenised once and stored as ids. How many documents have an id is counted exactly over the corpus: the
vocabulary bounds that table. BM25 weights by these counts, hashed into a vector of `DIMENSIONS`, place a document:
up to `CLUSTERS` centres are fitted to a bounded sample of the vectors and put in an order in which neighbours are
close; documents are sorted by their centre, their heaviest id and a salt, which splits the documents of a large cluster,
and cut into parts of about equal numbers of ids: the cuts follow from the sums of all documents' ids by centre and heaviest
id, so they are the same in every run. Every document is placed.

A shard is a run of documents of one such part, of at most `SHARD_DOCS` documents or `SHARD_TOKENS` ids. It has an
inverted index of all its documents with BM25 weights by the corpus' counts. Full sequences are cut off a document's
start; what remains is a unit. The first unused unit is the seed of a window: the index returns the unused units by
BM25 score against the seed's document, and they fill the window in that order. The one that no longer fits is cut at
the window's end, and its rest is the next seed. A window that a shard can't fill goes back into the next shard; at the
end of a part, what is left is cut into powers of two, which need no padding.

Reruns agree, whatever the number of Spark's partitions: a part's order is fixed by keys, salt and id, and a sequence's id is
the part's number and a count. Neighbours may still lie in other shards; README states the recall against brute force.

Defined results: a null or empty text is the id 0 alone; a text of any length is cut freely; of units with equal scores
the one placed first is taken; repeated rows are packed as often as they come; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import MOST_RANGES, crc32, dropped, map_texts, mix64, only, range_of, slices, written

WINDOW = 1024
SHARD_DOCS = 8192
SHARD_TOKENS = 1 << 22
PART_TOKENS = 1 << 23
#: An id that more than a share of 1 in so many of a shard's documents have gets a row of weights, others a list.
DENSE = 8
K1, B = 1.2, 0.75
#: Of the vectors, of the centres, and of the documents that these are fitted to; documents to a centre.
DIMENSIONS, CLUSTERS, FITTED_TO, PER_CLUSTER = 512, 256, 8192, 256


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """The ids that `tokenizers` gives by the file at `path`, without special tokens added.

    A byte-level BPE with its merges in the order of the ids merges by least id, which tiktoken does several times
    faster; tests hold both against each other. Any other file is left to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        self.size = 1 + max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens") or ())])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        ranks = _byte_ranks(parsed)
        if ranks is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self._encode = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            import public_tokenizers
            import tiktoken

            special = {t["content"]: t["id"] for t in parsed.get("added_tokens") or ()}
            encoding = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self._encode = lambda text: encoding.encode_to_numpy(text, allowed_special="all")

    def ids(self, text: str) -> np.ndarray:
        """Unsigned ids; a special token's string in the text is that token."""
        return self._encode(text).astype(self.dtype, copy=False)


def _byte_ranks(parsed: dict) -> dict[bytes, int] | None:
    """Tokens' bytes and ids, if the file is a plain byte-level BPE that merges by least id."""
    model, before = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not parsed.get("normalizer")
    added = parsed.get("added_tokens") or []
    alone = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    names = [t["content"] for t in added]
    if not (plain and bytewise and alone) or any(x != y and x in y for x in names for y in names):
        return None
    vocab, letters = model["vocab"], _byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made) or any(c not in vocab for c in letters):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in names}


@dataclass
class Unit:
    """The part of a document that isn't packed yet: its ids from `start` to its end."""

    doc_id: object
    ids: np.ndarray  # of the whole document
    start: int

    @property
    def left(self) -> int:
        return len(self.ids) - self.start


class Index:
    """An inverted index with BM25 weights over the documents of one shard. idf: of every id; mean: the corpus' mean length."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = self.n = len(docs)
        lengths = np.array([len(d) for d in docs])
        key = np.sort(np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), lengths))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        term, doc = key // n, key % n
        del key
        here = (idf[term] > 0).nonzero()[0]  # an id that most documents have tells nothing
        term, doc, tf = term[here], doc[here], tf[here]
        weight = idf[term].astype(np.float32) * tf * np.float32(K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean)).astype(np.float32)[doc])
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(begins, len(term)))
        row = np.repeat(np.arange(len(begins)), df)  # of each posting, its term's number here
        common = df > max(32, n // DENSE)
        self.dense_row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), n), np.float32)
        often = common[row]
        self.dense[self.dense_row[row[often]], doc[often]] = weight[often]
        self.doc, self.weight, self.begins, self.df = doc.astype(np.int32), weight, begins, df
        by_doc = np.argsort(doc, kind="stable")
        self.terms = row[by_doc].astype(np.int32)
        self.at = np.searchsorted(doc[by_doc], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """Every document's BM25 score for the ids of `doc`."""
        terms = self.terms[self.at[doc] : self.at[doc + 1]]
        rows = self.dense_row[terms]
        score = self.dense[rows[rows >= 0]].sum(0).astype(np.float64)
        rare = terms[rows < 0]
        if len(rare):
            df = self.df[rare]
            ends = np.cumsum(df)
            postings = np.arange(ends[-1]) + np.repeat(self.begins[rare] - (ends - df), df)
            score += np.bincount(self.doc[postings], self.weight[postings], self.n)
        return score

    def best(self, doc: int, unused: np.ndarray):
        """The unused documents by score for `doc`, the best first."""
        score = self.scores(doc)
        score[~unused] = -1
        left = int(unused.sum())
        some = min(left, 32)
        if some < left:
            least = np.partition(score, self.n - some)[self.n - some]
            at = np.flatnonzero(score > least)
            yield from at[np.argsort(-score[at], kind="stable")].tolist()
            at = np.flatnonzero((score <= least) & unused)
        else:
            at = np.flatnonzero(unused)
        yield from at[np.argsort(-score[at], kind="stable")].tolist()


def packed_shard(units: list[Unit], idf: np.ndarray, mean: float, window: int = WINDOW) -> tuple[list[list[tuple[Unit, int, int]]], list[Unit]]:
    """Full sequences, as lists of (unit, start, length), and the units that no sequence holds yet."""
    sequences = []
    for u in units:
        while u.left >= window:
            sequences.append([(u, u.start, window)])
            u.start += window
    units = [u for u in units if u.left]
    if not units:
        return sequences, []
    index = Index([u.ids for u in units], idf, mean)
    unused = np.ones(len(units), bool)
    seed, follower = -1, 0
    while True:
        if seed < 0:  # else the rest of the unit that the last window cut
            while follower < len(units) and not unused[follower]:
                follower += 1
            if follower == len(units):
                return sequences, []
            seed = follower
            unused[seed] = False
        held, room = [(seed, units[seed].left)], window - units[seed].left
        cut = -1
        if room:
            for j in index.best(seed, unused.copy()):
                n = min(room, units[j].left)
                held.append((j, n))
                unused[j] = False
                room -= n
                if n < units[j].left:
                    cut = j
                if not room:
                    break
        if room:  # not enough units: all go back
            return sequences, [units[j] for j, _ in held]
        sequence = []
        for j, n in held:
            sequence.append((units[j], units[j].start, n))
            units[j].start += n
        sequences.append(sequence)
        seed = cut


def packed_rest(units: list[Unit], window: int = WINDOW) -> list[list[tuple[Unit, int, int]]]:
    """Sequences of the units' ids, as long as powers of two."""
    total, sequences = sum(u.left for u in units), []
    at = 0
    while total:
        size = min(window, 1 << (total.bit_length() - 1))
        sequence, room = [], size
        while room:
            n = min(room, units[at].left)
            sequence.append((units[at], units[at].start, n))
            units[at].start += n
            room -= n
            at += units[at].left == 0
        sequences.append(sequence)
        total -= size
    return sequences


@dataclass
class Corpus:
    """What BM25 needs to know of all documents: their number and mean length, and how many have each id."""

    n: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.maximum(np.log((self.n - self.df + 0.5) / (self.df + 0.5)), 0)

    def lexical(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each document's vector, of length 1 or 0, and its id of most weight, or -1. Ids that no other document has don't count."""
        vectors, heaviest = np.zeros((len(docs), DIMENSIONS), np.float32), np.full(len(docs), -1, np.int64)
        size = len(self.df)
        key = np.sort(np.concatenate([np.asarray(d, np.int64) + i * size for i, d in enumerate(docs)]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        term, doc = key[first] % size, key[first] // size
        weight = np.where(self.df >= 2, self.idf, 0)[term] * tf * (K1 + 1) / (tf + K1)
        hashed = mix64(np.arange(size, dtype=np.uint64))
        sign, slot = np.where(hashed >> np.uint64(63), 1, -1), (hashed % np.uint64(DIMENSIONS)).astype(np.int64)
        vectors = np.bincount(doc * DIMENSIONS + slot[term], weight * sign[term], len(docs) * DIMENSIONS).reshape(len(docs), DIMENSIONS).astype(np.float32)
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        most = np.maximum.reduceat(weight, begins)
        top = np.flatnonzero((weight > 0) & (weight == np.repeat(most, np.diff(np.append(begins, len(doc))))))[::-1]
        heaviest[doc[top]] = term[top]  # of equal ones the least id
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), heaviest


def centres(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centres of the vectors by spherical k-means, each next to a close one."""
    if not len(vectors):
        return np.zeros((1, DIMENSIONS), np.float32)
    found = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        of = np.argmax(vectors @ found.T, 1)
        for c in np.unique(of):
            mean = vectors[of == c].mean(0)
            found[c] = mean / max(np.linalg.norm(mean), 1e-9)
    found = found[np.linalg.norm(found, axis=1) > 0] if (np.linalg.norm(found, axis=1) > 0).any() else found[:1]
    chain, left = [0], set(range(1, len(found)))
    while left:
        chain.append(max(sorted(left), key=lambda c: found[chain[-1]] @ found[c]))
        left.remove(chain[-1])
    return found[chain]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, salt, ids) of every document, with the 0 at its end. Salts tell documents apart, not copies that have one id."""
    source = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("salt", F.xxhash64("doc_id", "text"))
    tokens: list[Tokens] = []

    def encode(texts):
        if not tokens:
            tokens.append(Tokens(path))
        return [[tokens[0].ids(x).tobytes() + bytes(tokens[0].dtype.itemsize) for x in texts]]

    return map_texts(source, ["doc_id", "salt"], encode, "ids binary")


def _arrays(column, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _slices(batch, column: int):
    """Parts of a batch with about a million ids, or one document."""
    import pyarrow.compute as pc

    for i, j in slices(pc.binary_length(batch.column(column)).to_pylist(), 1 << 21):
        yield batch.slice(i, j - i)


def counted(ids: DataFrame, tokens: Tokens) -> Corpus:
    """Counts over all documents, exactly: a row for each id of the vocabulary at most."""
    size, dtype = tokens.size, tokens.dtype

    def count(batches):
        import pyarrow as pa

        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for own in _arrays(batch.column(0), dtype):
                df[np.unique(own)] += 1
                n, total = n + 1, total + len(own)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], has])), pa.array(np.concatenate([[n, total], df[has]]))], names=["id", "n"])

    df, sums = np.zeros(size, np.int64), {}
    for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.id < 0:
            sums[r.id] = r.n
        else:
            df[r.id] = r.n
    n = sums.get(-2, 0)
    return Corpus(n, sums.get(-1, 0) / max(n, 1), df)


def gathered(ids: DataFrame, corpus: Corpus, dtype: np.dtype) -> DataFrame:
    """(part, doc_id, ids) with lexically close documents next to each other, a part's in one task and in order. ids: (doc_id, salt, ids)."""
    context = ids.sparkSession.sparkContext
    shared = context.broadcast(corpus)
    share = min(1, FITTED_TO / max(corpus.n, 1))

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch, 1):
                v = shared.value.lexical(_arrays(part.column(1), dtype))[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["salt", "v"])

    sample = ids.where(F.pmod("salt", F.lit(1 << 30)) < int(share * (1 << 30))).select("salt", "ids").mapInArrow(vectors, "salt long, v binary").dropDuplicates(["salt"])
    rows = sorted(sample.collect(), key=lambda r: r.salt)  # about FITTED_TO
    fitted = context.broadcast(centres(np.array([np.frombuffer(r.v, np.float32) for r in rows]), max(1, min(CLUSTERS, corpus.n // PER_CLUSTER))))

    def keys(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in _slices(batch, 2):
                v, heaviest = shared.value.lexical(_arrays(part.column(2), dtype))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.argmax(v @ fitted.value.T, 1).astype(np.int32)), pa.array(heaviest), pc.cast(pc.binary_length(part.column(2)), pa.int64())], names=["doc_id", "salt", "ids", "centre", "heaviest", "size"])

    id_type = ids.schema["doc_id"].dataType.simpleString()
    keyed = written(ids.mapInArrow(keys, f"doc_id {id_type}, salt long, ids binary, centre int, heaviest long, size long"), "packing-keyed")
    # ids by centre and heaviest id, in order, and the salts at which a part of about PART_TOKENS ids ends
    sizes = keyed.groupBy("centre", "heaviest").agg(F.sum("size").alias("size"))
    of_centre = sizes.groupBy("centre").agg(F.sum("size").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("centre")) - F.col("size")).select("centre", "before")  # CLUSTERS rows
    total = int(corpus.n * corpus.mean) * dtype.itemsize
    part = max(PART_TOKENS * dtype.itemsize, -(-total // (MOST_RANGES - 1)))
    begin = F.col("before") + F.sum("size").over(Window.partitionBy("centre").orderBy("heaviest")) - F.col("size")
    cuts = sizes.join(F.broadcast(of_centre), "centre").withColumn("begin", begin).withColumn("cut", F.explode(F.sequence(F.ceil(F.col("begin") / part), F.ceil((F.col("begin") + F.col("size")) / part) - 1)))
    found = cuts.where("cut * {0} >= begin and cut * {0} < begin + size".format(part)).select("centre", "heaviest", ((F.col("cut") * part - F.col("begin")) / F.col("size")).alias("share")).collect()  # MOST_RANGES rows at most
    bounds = sorted({(r.centre, r.heaviest, int(r.share * 2.0**64) - (1 << 63)) for r in found})
    at = range_of(F.struct("centre", "heaviest", "salt"), "centre:int,heaviest:bigint,salt:bigint", [Row(centre=c, heaviest=h, salt=x) for c, h, x in bounds])
    placed = keyed.withColumn("part", at["number"].cast("int")).repartitionByRange(len(bounds) + 1, "part")
    return placed.sortWithinPartitions("part", "centre", "heaviest", "salt", "doc_id").select("part", "doc_id", "ids")


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece of each document. tokenizer: the path of a file for `tokenizers`, which the executors have too."""
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = Tokens(path)
    dtype = tokens.dtype
    ids = written(tokenised(docs, path), "packing-ids")
    corpus = counted(ids, tokens)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    id_type = ids.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):
        import pyarrow as pa

        idf, mean = shared.value.idf, shared.value.mean
        following, at = 0, -1
        units: list[Unit] = []
        size = 0

        def rows(sequences):
            nonlocal following
            out = []
            for sequence in sequences:
                offset = 0
                for u, start, n in sequence:
                    out.append((u.doc_id, start, n, crc32(u.ids[start : start + n].astype("<u4").tobytes()), len(u.ids), following, offset))
                    offset += n
                following += 1
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def ended():
            sequences, left = packed_shard(units, idf, mean, window)
            return rows(sequences + packed_rest(left, window))

        for batch in batches:
            for part, doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2), dtype), strict=True):
                if part != at:
                    yield ended()
                    at, following, units, size = part, part << 36, [], 0
                units.append(Unit(doc_id, own, 0))
                size += units[-1].left
                if len(units) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    sequences, units = packed_shard(units, idf, mean, window)
                    size = sum(u.left for u in units)
                    yield rows(sequences)
        yield ended()

    gather = gathered(ids, corpus, dtype)
    dropped(ids)
    return gather.mapInArrow(run, fields)
