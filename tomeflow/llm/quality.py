"""Quality: a linear-chain conditional random field that labels every line good or bad.

A line is described by shares of character classes, word repetition, length and shape, and by the same of the
lines before and after it. Only documents are labelled, so lines start with their document's label, and in bad
documents lines that look good are relabelled between two fits (at least one stays bad). Forward-backward gives
each line's probability of being good; weighted by length these give the document's share of good text, and a
logistic fit over the labelled documents turns that share into a score.

The model is some hundred numbers and travels in the closure; texts are read whole.

Defined results: a null text, or one with blank lines only, has no good line and scores as one whose lines are all bad
(0 without a field); with one class only to learn from, all others get the share of good documents among those
learned from (0.5 without any); a text of any length is scored whole; repeated rows get equal results; an empty table
gives an empty result; extra columns are kept by scored_documents() and ignored by scored().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import DIGIT, LOWER, NEWLINE, SPACE, SYMBOL, UPPER, char_classes, code_points, crc32, held_out, labelled, map_texts, mix64, only, rows_and_texts

OWN = 13
#: Learned from at most about so many labelled documents, and of each from up to CHAINS chains of CHAIN lines, hashed over
#: the whole document: as many chains as keep all of them to about MOST_LINES lines, and one at least.
MOST_ROWS = 8_000
CHAIN = 64
CHAINS = 8
MOST_LINES = 1 << 20
THRESHOLD = 0.5
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_features(texts: list[str | None]):
    """Of every line that isn't blank: a row of OWN features, its length, and the offsets of the documents' lines."""
    codes, at = code_points([(x or "") + "\n" for x in texts])
    kind = char_classes(codes)
    ends = np.flatnonzero(kind == NEWLINE)
    first = np.concatenate([[0], ends[:-1] + 1])
    blank = (kind == SPACE) | (kind == NEWLINE)
    line = np.repeat(np.arange(len(ends)), ends - first + 1)

    def per_line(mask):
        return np.bincount(line[mask], minlength=len(ends)).astype(np.float64)

    length = (ends - first).astype(np.float64)
    upper, lower, digit, symbol, space = (per_line(kind == k) for k in (UPPER, LOWER, DIGIT, SYMBOL, SPACE))
    start = ~blank & np.concatenate([[True], blank[:-1]])
    stop = ~blank & np.concatenate([blank[1:], [True]])
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    of = line[a]
    words = np.bincount(of, minlength=len(ends)).astype(np.float64)
    n = np.maximum(words, 1)
    # a word's hash: sum of its codes times powers, moved to the word's start
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _B)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _BINV)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * power[:-1])])
    word = (sums[b + 1] - sums[a]) * back[a] * np.uint64(0xBF58476D1CE4E5B9)
    same = np.zeros(len(a), bool)
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[same], minlength=len(ends))
    key = np.sort((of.astype(np.uint64) << np.uint64(36)) | (word >> np.uint64(28)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(36)).astype(np.int64), minlength=len(ends))
    one = np.bincount(of[(a == b) & (kind[a] == SYMBOL)], minlength=len(ends))  # words of a single symbol
    before_end = np.maximum(b - 1, a)
    tail = np.bincount(of[(kind[b] == SYMBOL) & (kind[before_end] == SYMBOL) & (b > a)], minlength=len(ends))  # words that end in two symbols
    last = codes[np.maximum(ends - 1, 0)]
    safe = np.maximum(length, 1)
    f = np.stack(
        [
            np.log1p(length) / 5,
            upper / np.maximum(upper + lower, 1),
            symbol / safe,
            digit / safe,
            space / safe,
            one / n,
            tail / n,
            repeats / n,
            1 - distinct / n,
            np.minimum((length - space) / n, 40) / 10,
            np.isin(last, (46, 33, 63, 8230, 12290)).astype(float),
            (kind[first] == UPPER).astype(float),
            np.log1p(words) / 5,
        ],
        1,
    )
    real = words > 0
    doc_of = np.searchsorted(at, first, side="right") - 1
    lines = np.concatenate([[0], np.cumsum(np.bincount(doc_of[real], minlength=len(texts)))])
    return f[real], length[real], lines


def with_neighbours(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The features of each line, of the line before and of the line after it (0 where there is none), and 1."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    begins, ends = lines[:-1][np.diff(lines) > 0], lines[1:][np.diff(lines) > 0] - 1
    before[begins] = after[ends] = 0
    return np.hstack([f, before, after, np.ones((len(f), 1))])


@dataclass
class LineField:
    emission: np.ndarray  # logit of good over bad, by feature
    transition: np.ndarray  # [from, to], 0 bad, 1 good
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def logits(self, f: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return with_neighbours((f - self.centre) / self.scale, lines) @ self.emission


def marginals(logit: np.ndarray, lines: np.ndarray, transition: np.ndarray):
    """Forward-backward over all chains at once, longest first, so that step t handles those that have a line t.

    Returns P(good) of each line, P of each pair of states summed over all neighbouring lines, and the chains'
    log partition sums.
    """
    order = np.argsort(-np.diff(lines), kind="stable")
    begin, n = lines[:-1][order], np.diff(lines)[order]
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # chains with more than t lines
    e = np.stack([np.zeros_like(logit), logit], 1)
    e -= (shift := e.max(1, keepdims=True))
    e = np.exp(e)
    m = np.exp(transition)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    scale = np.ones(len(e))
    for t in range(steps):
        at = begin[: alive[t]] + t
        x = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        scale[at] = x.sum(1)
        forward[at] = x / scale[at, None]
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        backward[at] = ((e[at + 1] * backward[at + 1]) @ m.T) / scale[at + 1, None]
    p = forward * backward
    inner = np.ones(len(e), bool)
    inner[lines[1:][np.diff(lines) > 0] - 1] = False
    left = np.flatnonzero(inner)
    pairs = forward[left][:, :, None] * m[None] * ((e[left + 1] * backward[left + 1]) / scale[left + 1, None])[:, None, :]
    return p[:, 1] / p.sum(1), pairs, np.log(scale) + shift[:, 0]


def _fit(f, lines, y, steps: int = 150):
    """Maximum likelihood of the line labels y, by Adam on the exact gradient."""
    centre, spread = f.mean(0), f.std(0) + 1e-3
    model = LineField(np.zeros(3 * f.shape[1] + 1), np.zeros((2, 2)), centre, spread)
    x = with_neighbours((f - centre) / spread, lines)
    inner = np.ones(len(f), bool)
    inner[lines[1:][np.diff(lines) > 0] - 1] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[left], y[left + 1]), 1)
    state = [np.zeros_like(model.emission), np.zeros_like(model.emission), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(x @ model.emission, lines, model.transition)
        grads = (x.T @ (good - y) / len(y) + 1e-4 * model.emission, (pairs.sum(0) - seen) / len(y) + 1e-4 * model.transition)
        for k, (g, of) in enumerate(zip(grads, (model.emission, model.transition), strict=True)):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            of -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return model


def _share_good(f, length, lines, model: LineField) -> np.ndarray:
    """The length-weighted mean of P(good) by document, nan without lines."""
    good, _, _ = marginals(model.logits(f, lines), lines, model.transition)
    out, has = np.full(len(lines) - 1, np.nan), np.flatnonzero(np.diff(lines))
    if len(has):
        weight = np.maximum(length, 1)
        out[has] = np.add.reduceat(good * weight, lines[:-1][has]) / np.add.reduceat(weight, lines[:-1][has])
    return out


def _logistic(q: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """slope, offset of P(y) over q by Newton's method, slightly pulled to 0."""
    x, theta = np.stack([q, np.ones_like(q)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05, x.T @ (y - p) - 0.05 * theta)
    return float(theta[0]), float(theta[1])


@dataclass
class QualityModel:
    field: LineField | None
    base: float  # the share of good documents

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.field is None:
            return np.array([self.base if x and not x.isspace() else 0.0 for x in texts])
        q = np.nan_to_num(_share_good(*line_features(texts), self.field))  # a text without lines has no good one
        return 1 / (1 + np.exp(-np.clip(self.field.slope * q + self.field.offset, -35, 35)))


def _sampled(n: int, seed: int, chains: int = CHAINS) -> np.ndarray:
    """Which of a document's n lines are learned from: all, or those of some chains that a hash chooses."""
    chain = np.arange(n) // CHAIN
    if n <= CHAIN * chains:
        return np.ones(n, bool)
    return np.isin(chain, np.argsort(mix64(np.arange(chain[-1] + 1, dtype=np.uint64) + np.uint64(seed << 24)), kind="stable")[:chains])


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> QualityModel:
    sample = labelled(docs, labels, "quality", most)
    chains_each = max(1, min(CHAINS, MOST_LINES // (CHAIN * max(1, sample.count()))))

    def keys(texts):
        return [crc32((x or "").encode("utf-8", "surrogatepass")) for x in texts]

    def encode(texts):
        f, _, lines = line_features(texts)
        key = keys(texts)
        at = [a + np.flatnonzero(_sampled(b - a, k, chains_each)) for a, b, k in zip(lines[:-1], lines[1:], key, strict=True)]
        # where lines that don't follow one another meet, a piece begins
        pieces = [np.flatnonzero(np.diff(x, prepend=-2) != 1) for x in at]
        return [[f[x].astype(np.float32).tobytes() for x in at], [x.astype(np.int64).tobytes() for x in pieces], key]

    rows = sorted(map_texts(sample, ["doc_id", "label"], encode, "f binary, pieces binary, key long").collect(), key=lambda r: (r.doc_id, r.key))
    y = np.array([r.label > 0 for r in rows], int)
    base = float(y.mean()) if len(y) else 0.5
    rows = [(np.frombuffer(r.f, np.float32).reshape(-1, OWN).astype(float), np.frombuffer(r.pieces, np.int64), v, (r.doc_id, r.key)) for r, v in zip(rows, y, strict=True) if r.f]
    if not rows or len({r[2] for r in rows}) < 2:
        return QualityModel(None, base)
    f = np.vstack([r[0] for r in rows])
    lines = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    pieces = np.unique(np.concatenate([lines, *(a + r[1] for a, r in zip(lines[:-1], rows, strict=True))]))
    of = np.array([r[2] for r in rows])
    # long pieces are learned from as several chains
    chains = np.unique(np.concatenate([pieces, *(np.arange(a, b, CHAIN) for a, b in zip(pieces[:-1], pieces[1:], strict=True))]))
    doc = np.repeat(np.arange(len(of)), np.diff(lines))
    y = of[doc]
    first = _fit(f, chains, y)
    looks = first.logits(f, pieces)

    def worst_lines(texts):
        f, _, lines = line_features(texts)
        looks = first.logits(f.astype(np.float32).astype(float), lines)
        return [keys(texts), [float(looks[a:b].min(initial=np.inf)) for a, b in zip(lines[:-1], lines[1:], strict=True)]]

    # the worst line of all, which may be none of those learned from
    whole = {(r.doc_id, r.key): r.worst for r in map_texts(sample, ["doc_id"], worst_lines, "key long, worst double").collect()}
    worst = np.array([whole[r[3]] for r in rows])
    y = np.where((of[doc] == 0) & (looks > 0) & (looks > worst[doc] + 1e-6), 1, of[doc])
    model = _fit(f, chains, y)

    def shares(texts):
        return [_share_good(*line_features(texts), model)]

    shared = sorted((r.doc_id, r.share, r.label > 0) for r in map_texts(sample, ["doc_id", "label"], shares, "share double").collect() if not np.isnan(r.share))
    model.slope, model.offset = _logistic(np.array([x[1] for x in shared]), np.array([x[2] for x in shared], int))
    return QualityModel(model, base)


def _scorer(docs: DataFrame, model: QualityModel):
    def score(texts):
        p = model.score(texts)
        return [p, (p >= THRESHOLD).astype(np.int32)]

    return score


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = only(docs, "doc_id", "text")
    return map_texts(docs.withColumn("held_out", held_out("doc_id")), ["doc_id", "held_out"], _scorer(docs, model), "score double, predicted int", most_chars=1 << 20)


def scored_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(row, score, predicted): the documents' own rows beside their scores, so no column's name clashes."""
    return map_texts(rows_and_texts(docs), ["row"], _scorer(docs, model), "score double, predicted int", most_chars=1 << 20)
