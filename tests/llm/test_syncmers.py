"""Syncmer fingerprints against a finder in plain integers, and short texts, string ids, hot ids."""

import hashlib

import pytest

from tomeflow.llm import syncmers

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(mer):
    h = 0
    for c in mer:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & MASK
    return mixed(h)


def ordered(values):
    return list(dict.fromkeys(values))


def fingerprint(text):
    """(anchors, runs or None): closed syncmers of 12 with inner strings of 5, a 16th of them or the 128 least."""
    found = []
    for i in range(len(text) - 11):
        inner = [hashed(text[i + j : i + j + 5]) for j in range(8)]
        if min(inner) in (inner[0], inner[7]):
            found.append(hashed(text[i : i + 12]) >> 32)
    own = sorted(set(found))
    kept = set(own[: max(128, sum(h < 1 << 28 for h in own))])
    runs = None
    if len(text) < 48:
        runs = [int.from_bytes(hashlib.blake2b(text[j : j + 4].encode(), digest_size=4).digest(), "big") for j in range(max(1, len(text) - 3))] if text else []
    return ordered(h for h in found if h in kept), runs if runs is None else ordered(runs)


def alike(a, b):
    short = a[1] is not None and b[1] is not None
    x, y = (a[1], b[1]) if short else (a[0], b[0])
    if not x or not y:
        return float(short and len(x) == len(y))
    bound = min(1 << 32 if len(z) < 128 else max(1 << 28, max(z) + 1) for z in (x, y))
    union = {h for h in x + y if h < bound}
    places = [y.index(h) for h in x if h in union and h in y]
    best = []  # the longest growing run that ends at each place
    for i, p in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
    return max(best, default=0) / len(union)


def hexed(f):
    anchors, runs = (None if x is None else b"".join(h.to_bytes(4, "big") for h in x).hex() for x in f)
    return anchors if not runs else f"{anchors}-{runs}"


def check(found, rows):
    """rows: (doc_id, text) in order, ids distinct."""
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) == len(by)
    for k, (i, text) in enumerate(rows):
        text, after, r = text or "", rows[(k + 1) % len(rows)][1] or "", by[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = fingerprint(text), fingerprint(edited), fingerprint(after)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other))
        assert (r.near_edited, r.near_next) == (pytest.approx(alike(own, other)), pytest.approx(alike(own, following)))


def test_fingerprints_equal_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    rows = [(i, t[:3000]) for i, t in rows]  # plain integers are slow
    check(syncmers.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), rows)


def test_likeness_has_no_cliff(spark):
    """A text and its edit, which the empty text that follows makes shorter, are near at any length."""
    sentence = "The quick brown fox jumps over the lazy dog, and then it sleeps beside the old mill"
    rows = [r for n in range(12, 80) for r in ((2 * n, sentence[:n]), (2 * n + 1, ""))]
    found = syncmers.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check(found, rows)
    near = {r.n_chars: r.near_edited for r in found if r.n_chars}
    assert min(near.values()) > 0.4, near


def test_string_ids_and_extra_columns(spark):
    rows = [(f"id {i:03}", f"Text number {i} of some length, so that it has anchors {i * 7919}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id string, text string, TEXT string, hash string").repartition(4)
    check(syncmers.fingerprinted(docs).collect(), rows)


def test_hot_ids_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE", 50)
    rows = [(None if i % 3 else i, f"A text {i * i} that stands alone {i}") for i in range(900)] + [(None, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = syncmers.next_texts(docs).where("not helper").groupBy("bucket").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 250
    found = syncmers.fingerprinted(docs).collect()
    assert len(found) == len(rows)
    # every text is some text's next one: the edits of all rows hold all texts' beginnings
    assert sum(r.near_next == 1.0 for r in found) >= 19
