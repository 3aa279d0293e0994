"""Spelling variants against all pairs of words in plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

from tomeflow.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, N int, form string"


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    # two words are one edit apart if they are alike with one place of one of them, or of each, left out
    holes: dict[tuple, set] = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    found = {}
    for w, n in words.items():
        others = set().union(*(holes[w[:i], w[i + 1 :]] for i in range(len(w)))) - {w}
        others |= {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()
        others |= set().union(*(holes.get((w[:i], w[i:]), set()) for i in range(len(w) + 1)))
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        found[w] = (form, n, len(others), words[form] if form else None)
    out = set()
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def run(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_equal_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        found = run(queries.QUERIES["op11_aho_corasick_variants"](spark, f"/root/testdata/{sf}"))
        assert found == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sum(1 for f in found if f[4]) > 20


@pytest.fixture
def crowded(spark):
    """Few letters, so that nearly all words are near others, halves are shared by many, and forms make chains."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8]))) for _ in range(900)]
    text = [w.upper() if rng.random() < 0.1 and "é" not in w else w for k, w in enumerate(words) for _ in range(5 * 5 ** (k % 5) if k < 50 else rng.choice([4, 5, 6, 30]))]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::40])) for i in range(40)]
    x = "Z" * 300
    return [*rows, rows[3], rows[3], (None, rows[4][1]), (50, None), (51, ""), (52, " 12 -- ×"), (53, f"{x} {x} {x} {x} {x} {x}a {x}a {x}a {x}a {x}a"), (54, "abc1def abcdef" * 3)]


def test_crowded_segments_and_odd_rows(spark, crowded, monkeypatch):
    monkeypatch.setattr(spelling, "PER_SHARD", 100)
    monkeypatch.setattr(spelling, "PER_BLOCK", 20)
    monkeypatch.setattr(spelling, "_HELD", 50)
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in crowded], SCHEMA).repartition(3)
    found = run(spelling.grouped(docs))
    assert found == brute(crowded)
    chains = {w: f for w, f, *_ in found if f}
    assert any(chains.get(f) for f in chains.values()) and max(f[4] for f in found) > 10


def test_empty_table(spark):
    assert run(spelling.grouped(spark.createDataFrame([], SCHEMA))) == set()


def test_near_all_equals_near():
    rng = random.Random(1)
    for a, b in ((6, 6), (6, 7), (7, 6)):
        vs = ["".join(rng.choice("ab") for _ in range(a)) for _ in range(30)]
        ws = ["".join(rng.choice("ab") for _ in range(b)) for _ in range(30)]
        assert sorted(spelling._near_all(vs, ws)) == [(i, j) for i, v in enumerate(vs) for j, w in enumerate(ws) if spelling.near(v, w)]
