"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Within a source, document i is expected e_i = min(most, c * w_i) copies, where
c makes the expected words meet the target. w_i is the document's weight, by default the logarithm of its size, so longer
documents are likelier; weights are rounded to eighths of an octave, so c follows from a sum for each level. A document
gets floor(e_i) copies for certain. The rest l_i = e_i - floor(e_i) is its chance of one copy more, drawn by Pareto order
sampling: documents are ranked by (u/(1-u)) / (l/(1-l)), u a hash of the id in (0, 1), and the first ones are taken
while they fit the words that are left of the target. From the first that no longer fits on, those that are no larger
than what is left are taken in the same way, by rank while they fit, and so on for `ROUNDS` rounds.

The ranking is never sorted as a whole: the rank is a place of 63 bits, sizes are summed for 64 ranges of places a
source, and the range in which a target is reached is cut again, until it holds few rows. Rows that have one rank are
told apart by the lowest bits. What is decided are some numbers a source, so rows are read by narrow passes and
nothing but sums is shuffled. Every source has one row in a window over all of them, that gives weights by name.

Defined results: a null text has size 0, as one without words has; a null source is a source, the last one; a
null id draws like any other; rows with one id draw the same u, and which of them is taken first is open where text and
id are equal; documents of size 0, and those with a weight of 0, less or null, take nothing; a text of any length is
counted whole; an empty table gives an empty result; extra columns are kept by mixed_documents() and ignored by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, only, whole_rows, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: How often the ranking is gone on with after a document that doesn't fit, the first time included.
ROUNDS = 3
#: Rows of a source that one task sorts at most (but for ties in all bits).
SORTED = 4096
_RANK_BITS, _TIE_BITS, _CUT_BITS = 40, 23, 6


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Targets share `share` of all sizes by weight and stop at `most` times the source's size; the excess is shared
    again among the others until none is above. Sorted by the level at which a source is full, the full sources
    are a prefix, so the level is found with running sums instead of a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("full_at", most * F.col("source_size") / F.col("weight"))
        .withColumn("words", share * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("parts", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if all sources before this one are full and none from here on is
        .withColumn("level", F.first(F.when(F.col("words") / F.col("parts") <= F.col("full_at"), F.col("words") / F.col("parts")), ignorenulls=True).over(whole))
    )
    full = most * F.col("source_size").cast("double")
    return ranked.select("source", "source_size", "weight", F.least(F.coalesce(F.col("weight") * F.col("level"), full), full).alias("target"))


def _measured(docs: DataFrame, weight: str | None, *more: Column) -> DataFrame:
    """`more` beside what decides: doc_id, source, size, level (of the weight; null: none), u and tie."""
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    w = F.col(f"`{weight}`").cast("double") if weight else F.log2(size + 1.0)
    level = F.when(w > 0, F.least(F.greatest(F.round(8 * F.log2(w)), F.lit(-1024)), F.lit(1023)).cast("int"))
    tie = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << _TIE_BITS))
    return docs.select(*more, "doc_id", "source", size.alias("size"), F.when(size > 0, level).alias("level"), u.alias("u"), tie.alias("tie"))


def _expected(most: int) -> Column:
    """Copies expected of a row with `level`, beside its source's `c`; without a c every one gets the most."""
    return F.when(F.col("level").isNull(), 0.0).otherwise(F.coalesce(F.least(F.col("c") * _weight(), F.lit(float(most))), F.lit(float(most))))


def _weight() -> Column:
    return F.pow(F.lit(2.0), F.col("level") / 8)


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """rows, that have their source's c, with `whole` copies for certain and the `place` in the ranking (null: takes no part)."""
    chance = F.col("expected") - F.col("whole")
    odds = F.col("u") * (1 - chance)
    # x/(1+x) for x the ratio of odds: the same order, within (0, 1)
    rank = odds / (odds + chance * (1 - F.col("u")))
    place = F.least(F.floor(rank * (1 << _RANK_BITS)), F.lit((1 << _RANK_BITS) - 1)) * (1 << _TIE_BITS) + F.col("tie")
    return rows.withColumn("expected", _expected(most)).withColumn("whole", F.floor("expected")).withColumn("place", F.when((chance > 0) & (F.col("size") > 0), place))


def _shares(sized: DataFrame, weights, share: float, most: int) -> DataFrame:
    """(source, source_size, target, c, gap) a source; gap: the words that are left of the target after what is certain."""
    levels = written(sized.groupBy("source", "level").agg(F.sum("size").alias("size")), "mix-levels")
    targets = source_targets(levels.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = written(targets, "mix-targets")
    # levels from the heaviest on: those before are full, the others share what is left in proportion
    down = Window.partitionBy("source").orderBy(F.desc("level"))
    full = most * F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(_weight() * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = _joined(levels.where("level is not null"), targets).withColumn("c", (F.col("target") - full) / rest).where(F.col("c") * _weight() <= most)
    c = written(tried.groupBy("source").agg(F.max_by("c", "level").alias("c")), "mix-c")
    of_source = _joined(targets, c)
    certain = _joined(levels, of_source.select("source", "c")).groupBy("source").agg(F.sum(F.floor(_expected(most)) * F.col("size")).alias("certain"))
    shares = written(_joined(of_source, certain).withColumn("gap", F.col("target") - F.col("certain")).select("source", "source_size", "target", "c", "gap"), "mix-shares")
    dropped(levels, targets, c)
    return shares


def _prefix(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, upto, left): of the rows after `after` and no larger than `most`, the last place up to which all fit `left`, and what they leave. No row where all fit."""
    bits = _RANK_BITS + _TIE_BITS - _CUT_BITS
    after = ends.select("source", "after", "most")
    cut = ends.select("source", F.lit(0).cast("bigint").alias("low"), "left")
    rows = _joined(rows, after).where((F.col("place") > F.col("after")) & (F.col("size") <= F.col("most"))).select("source", "size", "place")
    while True:
        inside = _joined(rows, cut).where(F.shiftright("place", bits + _CUT_BITS) == F.shiftright("low", bits + _CUT_BITS))
        parts = inside.groupBy("source", F.shiftright("place", bits).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("left").alias("left"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("part"))  # 2^_CUT_BITS rows a source
        reached = parts.withColumn("sum", running).where("sum > left").groupBy("source").agg(F.min(F.struct("part", (F.col("left") - F.col("sum") + F.col("size")).alias("left"), "n")).alias("at"))
        cut = written(reached.select("source", F.shiftleft("at.part", bits).alias("low"), "at.left", "at.n"), "mix-cut")
        if bits < _CUT_BITS or (cut.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        bits -= _CUT_BITS
    order = Window.partitionBy("source").orderBy("place")
    last = _joined(rows, cut).where(F.shiftright("place", bits) == F.shiftright("low", bits)).withColumn("sum", F.sum("size").over(order))
    fits = last.groupBy("source").agg(F.max(F.when(F.col("sum") <= F.col("left"), F.struct("place", "sum"))).alias("at"))
    upto = F.coalesce(F.col("at.place"), F.col("low") - 1)
    return written(_joined(cut, fits).select("source", upto.alias("upto"), (F.col("left") - F.coalesce(F.col("at.sum"), F.lit(0))).alias("now")), "mix-prefix")


def _ends(sized: DataFrame, shares: DataFrame, most: int) -> DataFrame:
    """shares with `taken`, the ranges of places that are: (after, upto, most), each for rows no larger than its most."""
    rows = _placed(_joined(sized, shares.select("source", "c")), most).where("place is not null").select("source", "size", "place")
    none = F.expr("cast(array() as array<struct<after:bigint,upto:bigint,most:double>>)")
    ends = shares.select("source", F.lit(-1).cast("bigint").alias("after"), F.lit(float("inf")).alias("most"), F.col("gap").cast("double").alias("left"), none.alias("taken"))
    for _ in range(ROUNDS):
        found = _joined(ends, _prefix(rows, ends)).withColumn("upto", F.greatest("after", F.coalesce("upto", F.lit((1 << 63) - 1))))
        left = F.coalesce("now", F.lit(0.0)).cast("double")
        ends = written(found.select("source", F.col("upto").alias("after"), left.alias("most"), left.alias("left"), F.concat("taken", F.array(F.struct("after", "upto", "most"))).alias("taken")), "mix-ends")
    return written(_joined(shares, ends.select("source", "taken")), "mix-decided")


def _decided(rows: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    extra = F.coalesce(F.exists("taken", lambda x: (F.col("place") > x["after"]) & (F.col("place") <= x["upto"]) & (F.col("size") <= x["most"])), F.lit(False))
    return _placed(_joined(rows, ends), most).withColumn("copies", (F.col("whole") + extra.cast("bigint")).cast("bigint"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, copies, taken) of every document. weight: a column with the weights."""
    sized = written(_measured(only(docs, "doc_id", "source", "text", *([weight] if weight else [])), weight), "mix-sizes")
    decided = _decided(sized, _ends(sized, _shares(sized, weights, share, most), most), most)
    return decided.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, weight: str | None = None) -> DataFrame:
    """The documents' own rows, each as often as the mix takes it: a second narrow pass over them."""
    docs = whole_rows(docs, "doc_id", "source", "text", *([weight] if weight else []))
    sized = written(_measured(docs, weight), "mix-sizes")
    ends = _ends(sized, _shares(sized, weights, share, most), most)
    dropped(sized)
    taken = _decided(_measured(docs, weight, F.col("row")), ends, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def _joined(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """Left join on the source, null equal to null; Spark broadcasts the table of sources if it is small, and splits hot ones if not."""
    right = by_source.withColumnRenamed("source", "of_source")
    return df.join(right, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
