"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word n-grams, hashed to 64 bits. Two documents link when their sets' intersection is
at least num/den of their union. With all n-grams in one global order, rare first, documents that link share at
least l of their first |x| - o + l n-grams, for any l, where o is the overlap that their sizes ask for. So every
document takes a prefix, and a pair is verified only if it shares as many prefix n-grams as the smaller l of both:

1.  How often each n-gram occurs is counted over all documents in a table of hashed counters, sized by the text there
    is and at most 2^MOST_SKETCH_BITS; as bytes on a logarithmic scale it is broadcast. It gives the order and the cost
    of prefixes. Any order is right: where counters are crowded, only costs are judged less well.
2.  Each document lengthens its prefix: of all l up to MOST_MATCHES it takes the one with the least estimated cost,
    the documents it meets and the verifications that l shared n-grams leave.
3.  Documents with equal sets are one class from here on, a node with one prefix.
4.  Whatever pair shares l n-grams of the lengthened prefixes shares one of the shortest (l = 1), so only the shortest
    are made into posting lists, and a pair's count of shared n-grams is taken from both lengthened prefixes before
    its texts are read.
5.  In each posting list the node where the n-gram stands foremost is the list's hub. Every node is tried against
    the hub it meets most; what links forms first components. This step only saves work.
6.  Then nodes of a list that aren't in one component yet become pairs, if sizes and places allow it. Rows of a list's
    largest component are never paired with each other, so a group of m near copies costs about m and not m * m. Long
    lists are paired in blocks, so no task holds one whole.
7.  Components of all links are the result: no pair within one can change it.

N-grams that stand in one shortest prefix only link nothing; a bit table sifts most of them before postings are
shuffled. Verification is exact, on the whole texts of the nodes that occur in pairs. Nodes know their text by its
64-bit hash. Texts travel to the hub they are verified against, whose rows are split by a salt where they are many.

Defined results: a document without words has no n-grams, size 0, and is its own component; one with fewer than n
words has one n-gram, all of them; repeated rows are copies; ties in order go to the smaller hash; a text of any length
is taken whole; a null id is the id of no component unless all of its documents' ids are null; an empty table gives an
empty result; extra columns are ignored. No result depends on the order in which the table gives its rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, mix64, only, slices, whole_rows, words, written

#: The counters are about an eighth of the n-grams, as a power of two between these: 16 MB as they are broadcast.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 16, 24
_CHUNKS = 64
MOST_MATCHES = 8
#: Verifications of one hub, and rows of one posting list, that a task takes.
PER_HUB = 256
PER_LIST = 1024
#: Sizes of the bit tables that sift n-grams and texts before a shuffle: 16 bits a key, as a power of two up to these, 16 MB.
LEAST_SIFT_BITS, MOST_SIFT_BITS = 16, 27
_M = np.uint64(0x9E3779B97F4A7C15)


class NGrams:
    """Sorted distinct 64-bit hashes of texts' word n-grams."""

    def __init__(self, n: int):
        self.n = n

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        each = [words(x) for x in texts]
        flat = [w for own in each for w in own]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        h = np.zeros(max(0, len(hashes) - self.n + 1), np.uint64)
        for k in range(self.n):
            h = h * _M + hashes[k : k + len(h)]
        h = mix64(h)
        out, at = [], 0
        for own in each:
            m = len(own)
            if m >= self.n:
                own = np.sort(h[at : at + m - self.n + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif m:
                x = np.array([m], np.uint64)
                for k in range(m):
                    x = x * _M + hashes[at + k : at + k + 1]
                out.append(mix64(x))
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
        return out


def _parts(batch, column: int, most: int = 1 << 20):
    """(slice, texts) of a batch, by size of the texts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, j in slices(sizes, most):
        part = batch.slice(i, j - i)
        yield part, part.column(column).to_pylist()


class Counters:
    """How often n-grams occur, by hashed slots: bytes that hold eight times the binary logarithm of one more."""

    def __init__(self, counts: np.ndarray):
        self.bits = len(counts).bit_length() - 1
        self.levels = np.rint(8 * np.log2(1.0 + counts)).astype(np.uint8)
        self.load = float(counts.mean(dtype=np.float64))

    def slots(self, h: np.ndarray) -> np.ndarray:
        return _slot(h, self.bits)

    def of(self, h: np.ndarray) -> np.ndarray:
        """About how often each hash was seen, with what shares its slot."""
        return np.exp2(self.levels[self.slots(h)] / 8.0) - 1


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _within(n: float, least: int, most: int) -> int:
    return min(most, max(least, int(np.ceil(np.log2(max(n, 2))))))


def counted(docs: DataFrame, n: int) -> Counters:
    """The hashed counters over all documents."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _within(letters / 6 / 8, LEAST_SKETCH_BITS, MOST_SKETCH_BITS)
    width = (1 << bits) // _CHUNKS

    def count(batches):
        import pyarrow as pa

        grams, table = NGrams(n), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, texts in _parts(batch, 0):
                slots = _slot(np.concatenate([*grams.sets(texts), np.zeros(0, np.uint64)]), bits)
                if len(slots) > 1 << (bits - 4):
                    table += np.bincount(slots, minlength=1 << bits).astype(np.uint32)
                else:
                    np.add.at(table, slots, 1)
        rows = []
        for chunk in range(_CHUNKS):
            own = table[chunk * width : (chunk + 1) * width]
            # a byte a slot, most of them small, and what a byte can't hold beside them
            more = np.flatnonzero(own >= 255)
            if own.any():
                rows.append((chunk, zlib.compress(np.minimum(own, 255).astype(np.uint8).tobytes(), 1), more.astype(np.uint32).tobytes(), own[more].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(4)], names=["chunk", "counts", "at", "more"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts, at, more in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint8).astype(np.uint64)
                own[np.frombuffer(at, np.uint32)] = np.frombuffer(more, np.uint32)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(own, 0xFFFFFFFF).astype(np.uint32).tobytes()])], names=["chunk", "counts"])

    out = np.zeros(1 << bits, np.uint32)
    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary, at binary, more binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    for r in rows.toLocalIterator():  # _CHUNKS rows, 2^MOST_SKETCH_BITS counters at most
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, np.uint32)
    return Counters(out)


def chosen_prefix(size: int, costs: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(matches, length) of a prefix. costs: of the n-grams in order, about how many other documents have each."""
    shortest = size - -(-num * size // den) + 1
    most = min(MOST_MATCHES, size - shortest + 1)
    met = np.cumsum(costs[: shortest + most - 1])[shortest - 1 :]
    matches = np.arange(1, most + 1)
    # postings met, and verifications (each as dear as its set is long) of those that share enough of them
    cost = met + met / matches * (1 + size / 32) + matches * 0.01
    best = int(np.argmin(cost))
    return best + 1, shortest + best


def text_key() -> Column:
    """What names a text: a 64-bit hash."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def prefixes(docs: DataFrame, counters: Counters, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, node, size, digest, matches, prefix) of every document; node: its text's hash; digest: its set's."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)
    source = docs.select("doc_id", text_key().alias("node"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        grams, table = NGrams(n), shared.value
        for batch in batches:
            for part, texts in _parts(batch, 2):
                size, digest, matches, prefix = [], [], [], []
                for own in grams.sets(texts):
                    size.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    if not len(own):
                        matches.append(0), prefix.append([])
                        continue
                    count = table.of(own)
                    order = np.lexsort((own, count))
                    m, k = chosen_prefix(len(own), np.maximum(count[order] - table.load - 1, 0), num, den)
                    matches.append(m)
                    prefix.append(own[order[:k]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(matches, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "node", "size", "digest", "matches", "prefix"],
                )

    return source.mapInArrow(run, f"doc_id {id_type}, node long, size long, digest binary, matches int, prefix array<bigint>")


def _overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """The least intersection of sets of sizes a and b that link."""
    return F.ceil((a + b) * num / F.lit(float(num + den)) - 1e-9)


def _allowed(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and places let this n-gram be the first that a linked pair shares."""
    sx, sy = F.col(f"{x}size").cast("long"), F.col(f"{y}size").cast("long")
    o = _overlap(sx, sy, num, den)
    return (sx * den >= sy * num) & (sy * den >= sx * num) & (F.col(f"{x}place") <= sx - o) & (F.col(f"{y}place") <= sy - o)


def _sharing_enough(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose lengthened prefixes share as many n-grams as the smaller number of matches of both."""
    a, b = (nodes.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("size", "matches", "prefix"))) for k in "ab")
    overlap, matches = _overlap(F.col("a_size"), F.col("b_size"), num, den), F.least("a_matches", "b_matches")

    def prefix(k: str) -> Column:
        return F.slice(f"{k}_prefix", F.lit(1), F.greatest(F.col(f"{k}_size") - overlap + matches, F.lit(0)).cast("int"))

    return pairs.join(a, "a").join(b, "b").where(F.size(F.array_intersect(prefix("a"), prefix("b"))) >= matches).select("a", "b")


class Sift:
    """A table of bits with those of all keys set, 8 to a byte. Its size is bounded: with too many keys it holds back less."""

    def __init__(self, keys: DataFrame):
        bits = self.bits = _within(16 * keys.count(), LEAST_SIFT_BITS, MOST_SIFT_BITS)

        def mark(batches):
            import pyarrow as pa

            table = np.zeros(1 << bits, bool)
            for batch in batches:
                table[_sifted(batch.column(0).to_numpy(), bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table, bitorder="little").tobytes()])], names=["bits"])

        self.table = np.zeros(1 << (bits - 3), np.uint8)
        for r in keys.coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():  # 2^(bits - 3) bytes each
            self.table |= np.frombuffer(r.bits, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = _sifted(keys, self.bits)
        return (self.table[at >> 3] >> (at & 7) & 1).astype(bool)


def _sifted(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _shortest(num: int, den: int) -> Column:
    """How many n-grams the shortest prefix has."""
    return (F.col("size") - F.ceil(F.col("size") * num / F.lit(float(den)) - 1e-9) + 1).cast("int")


def _postings(nodes: DataFrame, shared: Broadcast, num: int, den: int) -> DataFrame:
    """(gram, node, size, place, component) of the shortest prefixes' n-grams that a sift lets through."""
    source = nodes.select("node", F.col("size").cast("int").alias("size"), "component", F.slice("prefix", F.lit(1), _shortest(num, den)).alias("prefix"))

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            prefixes = batch.column(3)
            gram = prefixes.flatten().to_numpy()
            lengths = np.diff(prefixes.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.flatnonzero(shared.value.holds(gram))
            of = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), batch.column(0).take(of), batch.column(1).take(of), pa.array(place[at].astype(np.int32)), batch.column(2).take(of)], names=["gram", "node", "size", "place", "component"])

    return source.mapInArrow(explode, "gram long, node long, size int, place int, component long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that link. b is the hub: its text is parsed once for all of its a in a task."""
    hubs = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "jaccard-hubs")
    salts = F.ceil(F.col("n") / PER_HUB)
    salted = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    own = salted.join(_texts_of(pairs.select(F.col("a").alias("node")), docs).withColumnRenamed("node", "a"), "a").select("b", "salt", "a", "text")
    hub = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt")).join(_texts_of(hubs.select(F.col("b").alias("node")), docs).withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(None).cast("bigint").alias("a"), "text")
    rows = own.unionByName(hub).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        grams, hub, of, last = NGrams(n), None, None, None
        for batch in batches:
            for part, texts in _parts(batch, 3):
                found = []
                keys = list(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True))
                # a text may come as often as the table repeats it; it is taken once
                fresh = [k != before for k, before in zip(keys, [last, *keys[:-1]], strict=True)]
                last = keys[-1]
                sets = iter(grams.sets([t for t, new in zip(texts, fresh, strict=True) if new]))
                for (b, salt, a), new in zip(keys, fresh, strict=True):
                    if not new:
                        continue
                    own = next(sets)
                    if a is None:
                        hub, of = own, (b, salt)
                    elif of == (b, salt):
                        both = len(np.intersect1d(hub, own, assume_unique=True))
                        if den * both >= num * (len(hub) + len(own) - both):
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    links = written(rows.mapInArrow(run, "a long, b long"), "jaccard-links")
    dropped(hubs)
    return links


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of `nodes`, and of a few more: the texts are sifted first, so what is shuffled follows the pairs and not the table."""
    shared = docs.sparkSession.sparkContext.broadcast(Sift(nodes))

    def sift(batches):
        import pyarrow as pa

        seen: set[int] = set()  # copies in one task
        for batch in batches:
            at = np.flatnonzero(shared.value.holds(batch.column(0).to_numpy())).tolist()
            own = batch.column(0).to_pylist()
            at = [i for i in at if not (own[i] in seen or (len(seen) < 1 << 20 and seen.add(own[i])))]
            yield batch.take(pa.array(at, pa.int64()))

    source = docs.select(text_key().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(sift, source.schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label's own label, so rounds grow with
    the logarithm of a chain's length. Labels are written every round.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = written(labels.join(near, labels.node == near.a, "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")), "cc-lower")
        up = lower.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = written(lower.join(up, lower.component == up.up, "left").select("node", F.least("component", "above").alias("component"), "before"), "cc-labels")
        dropped(labels, lower)
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            dropped(edges)
            return labels


def _classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, node, size, digest), and the classes of equal sets (digest, least_id, component); a component is named by a node."""
    docs = only(docs, "doc_id", "text")
    base = written(prefixes(docs, counted(docs, n), n, num, den).withColumn("row", F.monotonically_increasing_id()), "jaccard-prefixes")
    classes = written(base.where("size > 0").groupBy("digest").agg(F.min_by("node", "row").alias("node"), F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "jaccard-classes")
    nodes = written(base.select("row", "node", "size", "matches", "prefix").join(classes.select("row"), "row", "left_semi").drop("row"), "jaccard-nodes")
    documents = written(base.select("doc_id", "node", "size", "digest"), "jaccard-documents")
    dropped(base)

    # grams that several nodes' shortest prefixes hold
    alone = nodes.withColumn("component", F.col("node"))
    grams = written(nodes.select(F.explode(F.slice("prefix", F.lit(1), _shortest(num, den))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "jaccard-grams")
    sift = docs.sparkSession.sparkContext.broadcast(Sift(grams))
    dropped(grams)
    postings = _postings(alone, sift, num, den)
    lists = postings.groupBy("gram").agg(F.min(F.struct("place", "node", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("gram", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("place", "node", "size")))
    met = postings.join(lists, "gram").where((F.col("node") != F.col("hub_node")) & _allowed("", "hub_", num, den)).groupBy("node", "hub_node").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub_node")).alias("hub"))).alias("best"))
    tried = written(best.select(F.col("node").alias("a"), (-F.col("best.hub")).alias("b")), "jaccard-tried")
    stars = written(_sharing_enough(tried, nodes, num, den), "jaccard-stars")
    first = verified(stars, docs, n, num, den)
    labels = written(components(first), "jaccard-first")

    # lists that hold several components, and the largest of each
    labelled = written(nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-labelled")
    dropped(nodes, labels, stars)
    several = written(_postings(labelled, sift, num, den).groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most").select("gram", "n"), "jaccard-several")
    sift = docs.sparkSession.sparkContext.broadcast(Sift(several.select("gram")))
    mixed = written(_postings(labelled, sift, num, den).join(several, "gram"), "jaccard-mixed")
    largest = mixed.groupBy("gram", "component").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    largest = written(largest, "jaccard-largest")
    side = mixed.join(largest, "gram").withColumn("blocks", F.ceil(F.col("n") / PER_LIST))
    # the smaller components' rows are dealt over blocks, and every row of the list goes to all of its blocks
    x = side.where("component <> largest").select("gram", F.pmod(F.xxhash64("node"), "blocks").alias("block"), *(F.col(c).alias(f"x_{c}") for c in ("node", "size", "place", "component")))
    y = side.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "largest", *(F.col(c).alias(f"y_{c}") for c in ("node", "size", "place", "component")))
    pairs = (
        x.join(y, ["gram", "block"])
        .where((F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("largest")) | (F.col("x_node") < F.col("y_node"))) & _allowed("x_", "y_", num, den))
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        .distinct()
    )
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(_sharing_enough(pairs.join(done, ["a", "b"], "left_anti"), labelled, num, den), "jaccard-pairs")
    dropped(mixed, several, largest, labelled, tried)
    second = verified(pairs, docs, n, num, den)
    labels = written(components(first.unionByName(second)), "jaccard-components")
    of_class = written(classes.join(labels, "node", "left").select("digest", "least_id", F.coalesce("component", "node").alias("component")), "jaccard-of-class")
    dropped(first, second, pairs, labels, classes)
    return documents, of_class


def joined(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id: the smallest doc_id of its component."""
    documents, of_class = _classes(docs, n, num, den)
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = written(of_class.join(least, "component").select("digest", "component_id"), "jaccard-named")
    dropped(of_class)
    return documents.join(named, "digest", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component one row, the one with the smallest id; without any id, the one whose text has the smallest hash.

    Texts without words are copies only if they have the same id; those without an id stay all. Rows that agree in id
    and text are one, whichever of their other columns come first.
    """
    documents, of_class = _classes(docs, n, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    of_words = documents.where("size > 0").groupBy("digest").agg(first).join(of_class, "digest").groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.node")
    of_empty = documents.where("size = 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("node"))
    rows = documents.groupBy("doc_id", "node").agg(F.count("*").alias("jaccard_rows"))
    kept = of_words.union(of_empty.select("doc_id", "node")).withColumnsRenamed({"doc_id": "jaccard_id", "node": "jaccard_node"})
    rows = rows.withColumnsRenamed({"doc_id": "of_id", "node": "of_node"})
    kept = written(kept.join(rows, (F.col("jaccard_node") == F.col("of_node")) & F.col("jaccard_id").eqNullSafe(F.col("of_id"))).select("jaccard_id", "jaccard_node", "jaccard_rows"), "jaccard-kept")
    # each row whole beside its key, so no column's name clashes
    whole = whole_rows(docs, "doc_id", "text")
    keyed = whole.select("row", "doc_id", text_key().alias("key"))
    chosen = keyed.join(kept, (F.col("key") == F.col("jaccard_node")) & F.col("doc_id").eqNullSafe(F.col("jaccard_id")))
    once = chosen.where("jaccard_rows = 1").select("row.*")
    again = chosen.where("jaccard_rows > 1").dropDuplicates(["jaccard_id", "jaccard_node"]).select("row.*")
    blank = whole.where(F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORD)).select("row.*")
    return once.unionByName(again).unionByName(blank)
