"""What holds for all operators: columns whose names differ by case only, runs that agree; and cases by the numbers."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tomeflow.llm import flac, html, jaccard, language, mixing, packing, quality, sharding, spelling, suffixes, syncmers, toxicity, whitening
from tomeflow.llm.common import only, whole_rows

TEXT = "Some words stand here. They are followed by others, and a third line.\nThen it ends with number {}."


@pytest.fixture(scope="module")
def cased(spark):
    rows = [(i, TEXT.format(i), "en" if i % 2 else "de", f"s{i % 3}", 1, "x", 9.5, "y") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id double, LANG string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), 1) for i in range(40)], "doc_id long, quality int, toxic int, DOC_ID int")


OPERATORS = {
    "op1": lambda d, _: jaccard.joined(d),
    "op2": lambda d, l: toxicity.scored(d, toxicity.fitted(d, l)),
    "op3": lambda d, _: flac.digested(d),
    "op4": lambda d, _: mixing.mixed(d),
    "op5": lambda d, _: sharding.sharded(d),
    "op6": lambda d, _: packing.packed(d),
    "op7": lambda d, _: language.identified(d, language.fitted(d)),
    "op8": lambda d, _: syncmers.fingerprinted(d),
    "op10": lambda d, l: quality.scored(d, quality.fitted(d, l)),
    "op11": lambda d, _: spelling.grouped(d),
    "op12": lambda d, _: suffixes.deduplicated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_that_differ_by_case(cased, labels, name):
    plain = only(cased, "doc_id", "text", "lang", "source", "n_chars")
    found, expected = (sorted(map(repr, OPERATORS[name](d, labels).collect())) for d in (cased, plain))
    if name == "op4":  # ties and draws are the table's own
        assert len(found) == 40
    elif name in ("op5", "op6"):
        assert len(found) == len(expected)
    else:
        assert found == expected and found


def test_names_that_differ_by_case_in_other_tables(spark):
    pages = spark.createDataFrame([(i, "http://h/", f"<p>Page {i}</p>", "x") for i in range(3)], "page_id long, url string, html string, HTML string")
    assert sorted(r.text for r in html.extracted(pages).collect()) == ["Page 0", "Page 1", "Page 2"]
    rows = spark.createDataFrame([(i, [float(i), float(i * i)], None) for i in range(5)], "vec_id long, embedding array<float>, EMBEDDING int")
    assert whitening.whitened(rows).count() == 10


def test_whole_rows_keep_their_columns(cased):
    row = whole_rows(cased, "doc_id").first()
    assert list(row.row) == list(cased.first()) and row.doc_id == row.row[0] and row.row.__fields__ == cased.columns


def test_packing_agrees_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_TOKENS", 1 << 15)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    was, runs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = packing.packed(docs.repartition(int(n)))
            first = sorted(map(tuple, df.collect()))
            assert first == sorted(map(tuple, df.collect()))
            runs.append(first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert runs[0] == runs[1]
    parts = defaultdict(int)
    for r in runs[0]:
        parts[r[5] >> 36] += r[2]
    assert len(parts) > 5 and max(parts.values()) < 3 << 15


def test_many_small_hints_outweigh_a_prior(spark):
    """10,000 n-grams that each favour one language by 0.02 nats against a prior of 99 to 1."""
    model = language.LanguageModel(["aa", "bb"], np.zeros((language.DIMS, 2), np.float32), np.log([0.99, 0.01]))
    model.log_p[:, 1] = 0.02
    docs = spark.createDataFrame([(1, "abcde" * 500), (2, "abc")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs, model).collect()}
    assert found[1][0] == "bb" and found[2][0] == "aa" and all(0.5 < s <= 1 for _, s in found.values())


def test_languages_of_long_texts(spark):
    rare = [(i, "ab " * 30, "aa") for i in range(297)] + [(1000 + i, "ab " * 30 + "ac", "bb") for i in range(3, 9)]
    docs = spark.createDataFrame(rare, "doc_id long, text string, lang string")
    model = language.fitted(docs)
    long = spark.createDataFrame([(1, "ab " * 5000), (2, "ab ac " * 3000)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identified(long, model).collect()}
    slots = [np.concatenate([s[a[0] : a[1]] for s, a in language.hashed_ngrams([t], len(model.log_p))]) for t in ("ab " * 5000, "ab ac " * 3000)]
    for k, own in enumerate(slots):
        joint = model.log_p[own].astype(float).sum(0) + model.prior
        assert found[k + 1].lang_pred == model.langs[int(joint.argmax())]
        assert 0.5 <= found[k + 1].score <= 1


def test_equal_texts_share_a_shard(spark):
    """Groups of copies go together; only one that is too large for a shard is dealt out."""
    rows = [(i, f"group {i % 200} " * 20) for i in range(6000)] + [(10_000 + i, "the largest group " * 20) for i in range(3000)] + [(20_000 + i, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in sharding.sharded(docs).collect()}
    shards = defaultdict(set)
    for i, text in rows:
        shards[text].add(found[i].shard)
    assert all(len(s) == 1 for text, s in shards.items() if text is None or text.startswith("group"))
    assert len(shards["the largest group " * 20]) == 16
    sizes = defaultdict(int)
    for r in found.values():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_toxicity_stage_drops_what_its_model_says(spark):
    """The stage again by hand: rows go if the machine, fitted to the same rows, scores them 0.7 or more."""
    docs, sf = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "/root/testdata/sf0.1"
    known = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).collect()}
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.7} and 0 < len(scores) - len(kept) < len(scores) / 2
    toxic, clean = ({i for i, r in known.items() if r.toxic == v and i in scores} for v in (1, 0))
    assert toxic and len(toxic - kept) > 0.9 * len(toxic) and len(clean & kept) > 0.9 * len(clean)


def test_quality_stage_keeps_what_its_model_says(spark):
    docs, sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, sf).collect()}
    scores = {r.doc_id: r.score for r in quality.scored(docs, quality.fitted(docs, labels)).collect()}
    blank = {r.doc_id for r in docs.collect() if not (r.text or "").strip()}
    assert kept == {i for i, s in scores.items() if s >= 0.5 and i not in blank} and len(kept) < len(scores)


def test_mixing_stage_takes_what_the_mix_says(spark):
    docs, sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    found = defaultdict(int)
    for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf).collect():
        found[r.doc_id] += 1
    assert dict(found) == {i: n for i, n in copies.items() if n}


def test_two_maps_of_one_version_are_refused(spark, tmp_path):
    at = str(tmp_path / "map")
    sharding.stored(sharding.first_map(spark, 4, 16), at)
    sharding.stored(sharding.first_map(spark, 5, 16), at)
    with pytest.raises(ValueError, match="two maps"):
        sharding.newest(spark, at)
