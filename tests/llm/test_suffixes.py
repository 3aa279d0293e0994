"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tomeflow.llm import queries, suffixes


def brute(rows, length=100):
    """rows: (doc_id, text) in the order of the documents."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((doc_id, len(data), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(data, mask, strict=True) if not m)).hexdigest()))
    return out


def key(row):
    return row[0] is None, str(row[0]), row[1:]


def run(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=key)


def test_dedup_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = run(queries.QUERIES["op12_suffix_bucket_dedup"](spark, "/root/testdata/sf0.001"))
    want = brute(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert found == sorted(want, key=key)
    assert sum(1 for f in found if 0 < f[2] < f[1]) > 5


@pytest.fixture(scope="module")
def repetitive():
    rng = random.Random(9)

    def some(n, letters="abcdefgh é"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages, rows = [some(rng.choice([60, 99, 100, 101, 130, 300])) for _ in range(12)], []
    for _ in range(60):
        rows.append("".join(rng.choice([some(rng.randrange(1, 80)), rng.choice(passages), rng.choice(passages)[5:], "x" * rng.randrange(1, 250)]) for _ in range(rng.randrange(6))))
    rows += ["ab" * 400, "ab" * 90 + "c" + "ab" * 90, "y" * 100, "y" * 99, "y" * 101, "y" * 100, "", None, "é" * 120, some(40_000) + passages[0] + "z" * 5000]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("crowded", [False, True])
def test_repetitive_texts(spark, repetitive, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    monkeypatch.setattr(suffixes, "_BLOCK", 5000)
    monkeypatch.setattr(suffixes, "_HELD", 300)
    if crowded:
        monkeypatch.setattr(suffixes, "PER_RANGE", 8)
        monkeypatch.setattr(suffixes, "MOST_BITS", 2)
    schema = "doc_id int, text string, number string, row string, spans int"
    docs = spark.createDataFrame([(i, t, "n", "t", 0) for i, t in repetitive], schema).repartition(5)
    assert run(suffixes.deduplicated(docs)) == sorted(brute(repetitive), key=key)


def test_short_windows(spark, repetitive):
    rows = [(i, (t or "")[:300]) for i, t in repetitive]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(suffixes.deduplicated(docs, 12)) == sorted(brute(rows, 12), key=key)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_ids(spark, kind):
    long, other = "word and word " * 20, "something else " * 30
    rows = [(2, long), (None, other), (2, long), (1, long + other), (3, "short"), (3, "short"), (None, other), (4, None)]
    docs = spark.createDataFrame([(None if i is None else i if kind == "long" else f"id{i}", t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
    name = {i: i if kind == "long" else f"id{i}" for i in range(9)} | {None: None}
    # equal rows are alike in any order
    want = brute([(name[1], long + other), (name[2], long), (name[2], long), (name[3], "short"), (name[3], "short"), (name[4], None), (None, other), (None, other)])
    assert run(suffixes.deduplicated(docs)) == sorted(want, key=key)


def test_empty_table(spark):
    assert run(suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_identifiers_are_those_of_equal_strings():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(3000))
    for n in (1, 5, 8, 24, 100):
        ids = suffixes.refined(suffixes.identifiers(data, min(n, 24)), min(n, 24), n)
        assert len(ids) == len(data) - n + 1
        by = {}
        for i, x in enumerate(ids.tolist()):
            by.setdefault(data[i : i + n], set()).add(x)
        assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 100, 4000, dtype=np.uint8))
    passage = data[1000:1400]
    (index, start, windows, gram, kind), = suffixes.segments([data, b"q" * 50 + passage + b"r" * 50], 100)
    covered = {(i, s + k): (g, s) for i, s, n, g in zip(index.tolist(), start.tolist(), windows.tolist(), gram.tolist(), strict=True) for k in range(n)}
    assert len(covered) == 3901 + 401
    assert all(covered[0, 1000 + k][0] == covered[1, 50 + k][0] for k in range(301))
