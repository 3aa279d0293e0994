"""The pipeline's stages on the smallest tables, each against its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tomeflow.llm.common import written

from .test_operators import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), "test-stage")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["quality"]
    ids = {r.doc_id for r in after}
    known = [i for i in before if i in labels]
    assert sum((i in ids) == bool(labels[i].quality) for i in known) > 0.9 * len(known)
    before, after = kept["near copies"]
    expected = components([(i, r.text) for i, r in before.items()], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted({c for _, n, c in expected})
    before, after = kept["mixing"]
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and all(before[r.doc_id] == r for r in after)
    before, after = kept["packing"]
    sequences = defaultdict(int)
    for r in after:
        sequences[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())
    copies = Counter(r.doc_id for r in kept["mixing"][1])
    assert sum(r.length for r in after) == sum(copies[r.doc_id] * r.doc_tokens for r in {r.doc_id: r for r in after}.values())
    assert len(after) == corpus_pipeline.run(spark, SF).count()


EXTRA = ["component", "size", "slot", "label", "row", "score", "predicted", "held_out", "copies", "place", "taken", "level", "node", "ids", "_score", "jaccard_key", "of_source"]


def odd_documents(spark, rows):
    """rows: (doc_id, text, source); columns whose names the operators use themselves stand beside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return written(spark.createDataFrame([(i, t, None, s, None, *("x" for _ in EXTRA)) for i, t, s in rows], schema), "test-odd")


@pytest.fixture(scope="session")
def odd(spark):
    base = ". ".join(f"The {k} river runs slowly to the {k} sea where ships wait" for k in range(60)) + "."
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, base, "a"), (4, base, "a"), (5, base, None), (None, base, "b"), (6, base + " One more word.", "b"), (7, "Long words stand here. " * 30_000, "b"), (None, None, None)]
    return odd_documents(spark, rows), rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    docs, rows = odd
    found = stage(spark, docs, SF).collect()
    empty = stage(spark, odd_documents(spark, []), SF)
    assert empty.count() == 0
    if name == "packing":
        assert len({r.doc_id for r in found}) == len({i for i, *_ in rows})
        return
    assert empty.columns == docs.columns and all(r.label == "x" and r._score == "x" for r in found)
    got = Counter((r.doc_id, r.text) for r in found)
    given = Counter((i, t) for i, t, _ in rows)
    blank = {(i, t) for i, t in given if not (t or "").strip()}
    if name == "quality":  # no label is known, so all texts with a line stay
        assert got == Counter({k: n for k, n in given.items() if k not in blank})
    elif name == "toxicity":
        assert got == given
    elif name == "near copies":
        near = {(4, rows[3][1]), (5, rows[3][1]), (None, rows[3][1]), (6, rows[7][1])}
        assert got == Counter({k: 1 for k in given if k not in near} | {(4, rows[3][1]): 1})
    else:
        assert all(k not in blank and n <= 2 * given[k] for k, n in got.items()) and got
