"""A training corpus from documents: quality, toxicity, near duplicates, mixing, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeflow.llm import jaccard, mixing, packing, quality, toxicity
from tomeflow.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good. It learns from the labelled ones of those it is given.

    Null and blank texts go; very long ones are judged by all their lines; repeated rows go or stay together; of an empty
    table nothing is left, and without labels all texts that aren't blank stay.
    """
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored_documents(docs, model).where("predicted = 1").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't take for toxic.

    Null and empty texts stay, and without labels all do; very long texts are judged whole; repeated rows go or stay together.
    """
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored_documents(docs, model).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike by 0.8 or more: the one with the least id.

    Ids that are null come last, and of rows that tie in id the text with the smaller hash stays; rows that repeat id and text
    are one. Texts without a word are alike only if they have the same id. Very long texts are compared whole.
    """
    return jaccard.deduplicated(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 2 times; one without a word never. Null sources are one, the last."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold the documents; a null or empty text is the end's id alone."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifiers and the packing aren't expressible in SQL. tests/llm holds the two classifiers' stages against their models' scores, near copies
#: against brute force, the mix against its draw, which test_operators.py has in loops, and the packing by its layout.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
