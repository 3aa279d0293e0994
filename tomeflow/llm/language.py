"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of other characters than letters becomes one blank. The n-grams of 1 to 4
characters are hashed into `DIMS` slots. Counts by language give a matrix of log-probabilities, which is
broadcast (a row a slot, a column a language); scoring sums its rows over all n-grams of the whole text, and the language
of the greatest sum with its prior is predicted. With many
languages there are fewer slots, so the matrix has at most `MOST_CELLS` cells of 4 bytes; more than `MOST_LANGS`
languages are refused.

Defined results: `und` with score 0 for a null text or one without a letter; with no language to learn from, all
are `und`; a null label is not learned from; repeated rows get equal results; ties go to the first language by
name; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DIGIT, LOWER, NEWLINE, SPACE, UPPER, bounded_sample, char_classes, code_points, held_out, map_texts, only

DIMS = 1 << 16
LEAST_DIMS = 1 << 12
MOST_CELLS = 1 << 24
MOST_LANGS = MOST_CELLS // LEAST_DIMS
ORDERS = (1, 2, 3, 4)
#: Learned from at most about so many documents.
MOST_ROWS = 20_000
#: The score, not the prediction, counts so many n-grams at most, or it would be 0 or 1 for any text longer than a line.
WEIGHED = 60
_B = np.uint64(0x9E3779B97F4A7C15)
del DIGIT, NEWLINE, SPACE


@dataclass
class LanguageModel:
    langs: list[str]
    log_p: np.ndarray  # slots x languages
    prior: np.ndarray


def slots_for(langs: int) -> int:
    """How many slots the matrix has: a power of two."""
    if langs > MOST_LANGS:
        raise ValueError(f"{langs} languages, more than {MOST_LANGS}")
    return min(DIMS, 1 << ((MOST_CELLS // max(langs, 1)).bit_length() - 1))


def hashed_ngrams(texts: list[str | None], dims: int = DIMS):
    """For each order: (slots, the documents' offsets in them)."""
    codes, at = code_points([(x or "").lower() for x in texts])
    classes = char_classes(codes)
    letter = (classes == LOWER) | (classes == UPPER)
    starts = np.zeros(len(codes) + 1, bool)
    starts[at[:-1]] = True
    previous = np.empty(len(codes), bool)
    previous[1:] = letter[:-1]
    previous[starts[:-1]] = False
    keep = letter | previous  # a letter, or the first blank after one
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = kept[at]
    chars = np.where(letter, codes, 32)[keep].astype(np.uint64)
    end_of = np.repeat(ends[1:], np.diff(ends))
    position = np.arange(len(chars))
    h = np.zeros(len(chars), np.uint64)
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        h = (h[:m] * _B + chars[n - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
        inside = position[:m] + n <= end_of[:m]
        slots = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)[inside] & (dims - 1)
        yield slots, np.concatenate([[0], np.cumsum(inside)])[np.minimum(ends, m)]


def fitted(docs: DataFrame, most: int = MOST_ROWS) -> LanguageModel:
    """Learns from documents with a language that aren't held out, about `most` at most."""
    docs = only(docs, "doc_id", "lang", "text")
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    dims = slots_for(may.select("lang").distinct().count())
    sample = bounded_sample(may, "doc_id", most).repartition(8)  # so few rows come back, however many files there are

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            for i in range(0, len(texts), 256):
                for slots, at in hashed_ngrams(texts[i : i + 256], dims):
                    for k, lang in enumerate(langs[i : i + 256]):
                        have = total.setdefault(lang, np.zeros(dims, np.int64))
                        have += np.bincount(slots[at[k] : at[k + 1]], minlength=dims) if at[k + 1] - at[k] > dims // 8 else 0
                        if at[k + 1] - at[k] <= dims // 8:
                            np.add.at(have, slots[at[k] : at[k + 1]], 1)
            for lang in langs:
                rows[lang] = rows.get(lang, 0) + 1
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "n": [rows[x] for x in total], "counts": [c.tobytes() for c in total.values()]}, schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("counts", pa.binary())]))

    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for r in sample.mapInArrow(count, "lang string, n long, counts binary").toLocalIterator():  # 8 tasks' counts, each no larger than the matrix twice
        counts[r.lang] = counts.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
        rows[r.lang] = rows.get(r.lang, 0) + r.n
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((dims, 0), np.float32), np.zeros(0))
    smoothed = np.stack([counts[x] for x in langs], 1) + 0.5
    n = np.array([rows[x] for x in langs], float)
    return LanguageModel(langs, np.log(smoothed / smoothed.sum(0)).astype(np.float32), np.log(n / n.sum()))


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        m = shared.value
        sums, n = np.zeros((len(texts), max(1, len(m.langs)))), np.zeros(len(texts))
        if m.langs:
            for slots, at in hashed_ngrams(texts, len(m.log_p)):
                has = np.flatnonzero(np.diff(at))
                if len(has):
                    sums[has] += np.add.reduceat(m.log_p[slots], at[:-1][has], axis=0, dtype=np.float64)
                n += np.diff(at)
        known = n > 0
        joint = sums + (m.prior if m.langs else 0)
        best = joint.argmax(1)
        # tempered by one factor a text, which leaves the order of languages as it is
        weighed = (joint - joint.max(1, keepdims=True)) * np.minimum(1, WEIGHED / np.maximum(n, 1))[:, None]
        e = np.exp(weighed)
        p = e / e.sum(1, keepdims=True)
        return [[m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)]

    docs = only(docs, "doc_id", "text")
    return map_texts(docs.withColumn("held_out", held_out("doc_id")), ["doc_id", "held_out"], score, "lang_pred string, score double")
