"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words, letters only and lower-cased, and their beginnings of 4 to 8 letters,
hashed into 2^20 slots. From labelled documents, the slots that tell the classes apart are chosen; over them a
factorization machine (bias, a weight a slot, and a vector a slot whose products weigh pairs of slots) is fitted
by gradient descent. The pair terms let a single insult count in full while many together don't count manifold,
and let two terms mean more, or less, than each alone. The model has at most `MOST_SLOTS` slots and is broadcast;
scoring reads whole texts.

Defined results: a null or empty text scores as one without known terms; with no labels to learn from, or
one class only, the score is the share of toxic ones (0 without labels); a text of any length is scored whole; of
slots that tell as much the smaller is chosen first; repeated rows get equal results; an empty table gives an empty
result; extra columns are kept by scored_documents() and ignored by scored().
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, map_texts, only, rows_and_texts

SLOT_BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
#: Learned from at most about so many labelled documents.
MOST_ROWS = 24_000
MOST_SLOTS = 2048
#: Of the likelihood ratio test: chance alone gives as much to about one slot in 100,000.
LEAST_G = 20.0
FACTORS = 8
THRESHOLD = 0.7
_CACHED = 400_000


@dataclass
class FactorizationMachine:
    slots: dict[int, int] = field(default_factory=dict)  # hashed term -> row
    bias: float = -30.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rows: the documents' known terms, distinct in each, one document after the other; at: offsets."""
        out = np.full(len(at) - 1, self.bias)
        has = np.flatnonzero(np.diff(at))
        if len(has):
            first = at[:-1][has]
            v = self.factors[rows]
            sums = np.add.reduceat(v, first, axis=0)
            out[has] += np.add.reduceat(self.weights[rows], first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v**2).sum(1), first))
        return out


def term_slots(token: str) -> list[int]:
    """The slots of a lower-cased token: of its letters as a word, and of the word's beginnings."""
    import xxhash

    word = token if token.isalpha() else "".join(c for c in token if c.isalpha())
    if not word:
        return []
    terms = [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh64_intdigest(t) >> (64 - SLOT_BITS) for t in terms]


class _Terms:
    """Documents' known slots, with a bounded memory of tokens."""

    def __init__(self, known: dict[int, int] | None):
        self.known, self.seen = known, {}

    def of(self, text: str | None) -> list[int]:
        found, seen = set(), self.seen
        for token in set((text or "").lower().split()):
            slots = seen.get(token)
            if slots is None:
                slots = term_slots(token)
                if self.known is not None:
                    slots = tuple(self.known[s] for s in slots if s in self.known)
                if len(token) <= 40:
                    if len(seen) >= _CACHED:
                        seen.clear()
                    seen[token] = slots
            if slots:
                found.update(slots)
        return sorted(found)


def _chosen(sample: DataFrame) -> tuple[dict[int, int], int, int]:
    """The slots whose share differs most between the classes, by the likelihood ratio test."""

    def count(batches):
        import pyarrow as pa

        terms, sums = _Terms(None), [np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label > 0][terms.of(text)] += 1
        slots = np.flatnonzero(sums[0] + sums[1])
        yield pa.RecordBatch.from_pydict({"slot": slots, "a": sums[1][slots], "b": sums[0][slots]}, schema=pa.schema([("slot", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    n = sample.agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") <= 0).alias("n")).first()
    counts = sample.select("text", "label").mapInArrow(count, "slot int, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both, total = F.col("a") + F.col("b"), n.p + n.n

    def part(seen: Column, of_class: int, having: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (of_class * having))).otherwise(0.0)

    g = 2 * (part(F.col("a"), n.p, both) + part(F.col("b"), n.n, both) + part(n.p - F.col("a"), n.p, total - both) + part(n.n - F.col("b"), n.n, total - both))
    rows = counts.select("slot", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "slot").limit(MOST_SLOTS).collect() if n.p and n.n else []
    return {s: i for i, s in enumerate(sorted(r.slot for r in rows))}, n.p, n.n


def _fit(rows: np.ndarray, at: np.ndarray, y: np.ndarray, slots: dict[int, int], steps: int = 400) -> FactorizationMachine:
    """Adam over mini-batches; documents with the same terms and label are one, with a weight.

    In a quarter of its turns a document keeps each term with a chance of a third only, so that a term that mostly
    comes with others learns to count alone.
    """
    rng = np.random.default_rng(7)
    docs: dict[tuple, int] = {}
    for i in range(len(y)):
        key = (int(y[i]), rows[at[i] : at[i + 1]].tobytes())
        docs[key] = docs.get(key, 0) + 1
    keys = sorted(docs)
    y = np.array([k[0] for k in keys], float)
    weight = np.array([docs[k] for k in keys], float)
    each = [np.frombuffer(k[1], rows.dtype) for k in keys]
    model = FactorizationMachine(slots, float(np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))), np.zeros(len(slots)), rng.normal(0, 0.05, (len(slots), FACTORS)))
    state = [np.zeros(1), np.zeros(1), *(np.zeros_like(x) for x in (model.weights, model.weights, model.factors, model.factors))]
    for step in range(1, steps + 1):
        pick = np.arange(len(y)) if len(y) <= 2048 else rng.choice(len(y), 2048, replace=False)
        lens = np.array([len(each[i]) for i in pick])
        rows = np.concatenate([each[i] for i in pick]) if lens.sum() else np.zeros(0, np.int64)
        stays = rng.random(len(rows)) < np.repeat(np.where(rng.random(len(pick)) < 0.75, 1.0, 1 / 3), lens)
        emptied = (lens > 0) & (np.bincount(np.repeat(np.arange(len(pick)), lens)[stays], minlength=len(pick)) == 0)
        stays |= np.repeat(emptied, lens)
        lens = np.bincount(np.repeat(np.arange(len(pick)), lens)[stays], minlength=len(pick))
        rows, at = rows[stays], np.concatenate([[0], np.cumsum(lens)])
        w = weight[pick] / weight[pick].sum()
        error = (1 / (1 + np.exp(-np.clip(model.logits(rows, at), -35, 35))) - y[pick]) * w
        of = np.repeat(error, lens)
        g_w = np.bincount(rows, of, minlength=len(slots)) + 1e-5 * model.weights
        v = model.factors[rows]
        has = np.flatnonzero(lens)
        sums = np.zeros((len(pick), FACTORS))
        if len(has):
            sums[has] = np.add.reduceat(v, at[:-1][has], axis=0)
        pull = of[:, None] * (np.repeat(sums, lens, axis=0) - v)
        g_v = np.stack([np.bincount(rows, pull[:, f], minlength=len(slots)) for f in range(FACTORS)], 1) + 1e-4 * model.factors
        rate = 0.05 * min(1, 2 * (1 - step / (steps + 1)))
        for k, (g, lr) in enumerate(((error.sum(keepdims=True), rate), (g_w, rate), (g_v, rate * 0.5))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            move = lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
            if k == 0:
                model.bias -= float(move[0])
            elif k == 1:
                model.weights -= move
            else:
                model.factors -= move
    return model


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> FactorizationMachine:
    sample = labelled(docs, labels, "toxic", most)
    slots, p, n = _chosen(sample)
    if not p or not n:
        return FactorizationMachine(bias=30.0 if p else -30.0)

    def encode(texts):
        terms = _Terms(slots)
        return [[np.array(terms.of(x), np.int32).tobytes() for x in texts]]

    got = map_texts(sample, ["label"], encode, "terms binary").collect()  # `most` rows of a few known terms each
    each = [np.frombuffer(r.terms, np.int32) for r in got]
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return _fit(np.concatenate(each) if each else np.zeros(0, np.int32), at, np.array([r.label > 0 for r in got], int), slots)


def _scorer(docs: DataFrame, model: FactorizationMachine):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: list[_Terms] = []

    def score(texts):
        m = shared.value
        if not memory:
            memory.append(_Terms(m.slots))
        each = [memory[0].of(x) for x in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        p = 1 / (1 + np.exp(-np.clip(m.logits(np.array([s for x in each for s in x], np.int64), at), -35, 35)))
        return [p, (p >= THRESHOLD).astype(np.int32)]

    return score


def scored(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = only(docs, "doc_id", "text")
    return map_texts(docs.withColumn("held_out", held_out("doc_id")), ["doc_id", "held_out"], _scorer(docs, model), "score double, predicted int")


def scored_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(row, score, predicted): the documents' own rows beside their scores, so no column's name clashes."""
    return map_texts(rows_and_texts(docs), ["row"], _scorer(docs, model), "score double, predicted int")
