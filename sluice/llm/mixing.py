"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target number of words.  A source whose target is ``r`` times its own size takes
``floor(r)`` whole copies of every document for certain.  The words ``R`` that are then still wanted are
drawn with unequal probabilities, proportional to the sizes of documents: ``p = lambda * size``, with
``lambda`` such that ``sum(p * size)`` is ``R``; a document whose ``p`` would pass 1 is taken once more
for certain and the others share what is left.  The remaining documents are ranked by
``q = (u / (1 - u)) / (p / (1 - p))``, random odds by inclusion odds, with ``u`` drawn from a hash of the
document id.  The sample is of fixed size in words: ranks are taken up to the place where their words come
nearest to what the source still lacks.

No source meets in one task.  Words are counted once and written; ``q`` is mapped to a number between 0 and 1
that grows with it, and words are summed by its leading digits with partial aggregation; the bucket in which a
source's cut falls is looked at more closely in the same way, and only the documents of that second bucket, one
in some 16 million, are put in order.  Every other document compares itself with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import WORD, cut

#: Buckets of the ranks of a source, and of each of these again.
BUCKETS = 4096
#: Sources up to which the tables of sources (a row of some 100 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Most copies of a document.
COPIES = 3
#: What names a source in the joins below: its name, empty for null, and whether it is null.
SOURCE = ["src", "no_src"]


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """An integer below 2^52 from a hash of the key: the random number of a document, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words; a target ends at
    ``COPIES`` times its source's size, and what is above goes to the others by weight.  The level ``L``
    at which ``sum(min(cap, L * weight))`` equals all words is found by one pass over the sources by
    ``cap / weight``: each source gives the level at which it is the first that isn't capped, and the highest of
    those that do leave their source uncapped is the right one.  Windows without a key hold one row for each
    source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, above = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(above)
    return (
        per.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * COPIES)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"),
        )
    )


def rates(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``rate`` (lambda), ``odds`` (of the mean probability) and ``wanted`` (words that the ranking gives).

    From one row for each source and size; the window of a source holds its different sizes, not its documents.
    """
    squares = F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")
    by_size = sized.where("size > 0").groupBy(*SOURCE, "size").agg(F.count("*").alias("n")).join(goal, SOURCE)
    larger = Window.partitionBy(*SOURCE).orderBy(F.col("size").desc())
    smaller = Window.partitionBy(*SOURCE).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = by_size.withColumns(
        {
            "left": F.col("rest") - before,
            "squares": F.sum(squares).over(smaller).cast("double"),
            "words": F.sum(F.col("size") * F.col("n")).over(smaller),
            "docs": F.sum("n").over(smaller),
        }
    ).withColumn("rate", F.col("left") / F.col("squares"))
    first = F.max_by(F.struct("rate", "left", "words", "docs"), "size")
    best = steps.where(F.col("rate") * F.col("size") <= 1).groupBy(*SOURCE).agg(first.alias("best"))
    mean = F.col("best.rate") * F.col("best.words") / F.col("best.docs")
    return goal.join(best, SOURCE, "left").select(*goal.columns, F.col("best.rate").alias("rate"), (mean / (1 - mean)).alias("odds"), F.col("best.left").alias("wanted"))


def _crossed(buckets: DataFrame, digit: str, given: list[str]) -> DataFrame:
    """The bucket of each source in which its wanted words end, and the words before it."""
    run = Window.partitionBy(*SOURCE).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumn("upto", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0))).where("upto <= wanted")
    return ends.groupBy(*SOURCE, *given).agg(F.max_by(F.struct(digit, "upto"), digit).alias("at")).select(*SOURCE, *given, f"at.{digit}", F.col("at.upto").alias("before"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``df``.

    Null and empty texts have size 0 and take nothing; texts are counted whole, however long; a null source is a
    source of its own; rows of the same key and size in a source share their random number and are taken together
    or not at all, other ties go by key (null first), then size; a repeated row is a document like any other.
    An empty table gives an empty result.  Only the three named columns are read, so other columns may have any
    name.  A source misses its target by half its largest document (or group of repeated rows) at most.
    """
    sized = df.select(
        df[key].alias("doc_id"),
        F.coalesce(df[source].cast("string"), F.lit("")).alias("src"),
        df[source].isNull().alias("no_src"),
        words(df[text]).alias("size"),
        (draw(df[key], seed) / F.lit(float(2**52))).alias("u"),
    )
    sized = cut(sized, "mix-sizes")
    goal = targets(sized.select(F.when(~F.col("no_src"), F.col("src")).alias("source"), "size"))
    sure = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"), "source_size", "target", sure.alias("sure"))
    goal = cut(goal.withColumn("rest", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    goal = cut(rates(sized, goal), "mix-rates")
    few = goal.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda table: table

    p = F.col("size") * F.col("rate")
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    # Each step of the place is monotone in doubles, so places never contradict ranks.
    place = F.floor((1 - 1 / (1 + q * F.col("odds"))) * (BUCKETS * BUCKETS)).cast("long")
    drawn = (F.col("size") > 0) & (p > 0) & (p < 1)
    ranked = sized.join(small(goal), SOURCE).withColumns(
        {
            "sure": F.col("sure") + F.coalesce(((F.col("size") > 0) & (p >= 1)).cast("long"), F.lit(0)),
            "q": F.when(drawn, q),
            "place": F.when(drawn, F.least(place, F.lit(BUCKETS * BUCKETS - 1))),
        }
    )
    at = F.struct("q", "doc_id", "size")
    pool = ranked.where("place IS NOT NULL").withColumns({"high": F.floor(F.col("place") / BUCKETS), "low": F.col("place") % BUCKETS})
    zero = F.lit(0).cast("long").alias("before")
    first = pool.groupBy(*SOURCE, "wanted", "high").agg(F.sum("size").alias("words")).select("*", zero)
    first = cut(_crossed(first, "high", ["wanted"]), "mix-first-cut")
    near = pool.join(small(first.drop("wanted")), [*SOURCE, "high"])
    second = near.groupBy(*SOURCE, "wanted", "high", "before", "low").agg(F.sum("size").alias("words"))
    second = cut(_crossed(second, "low", ["wanted", "high"]), "mix-second-cut")
    last = pool.join(small(second.drop("wanted")), [*SOURCE, "high", "low"])
    last = last.groupBy(*SOURCE, "place", "wanted", "before", "q", "doc_id", F.col("size").alias("each")).agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("q", "doc_id", "each").rowsBetween(Window.unboundedPreceding, 0))
    taken = F.when(upto - F.col("words") / 2 <= F.col("wanted"), F.struct("q", "doc_id", F.col("each").alias("size")))
    last = last.select(*SOURCE, "place", taken.alias("taken")).groupBy(*SOURCE, F.col("place").alias("end")).agg(F.max("taken").alias("edge"))
    last = cut(last, "mix-last-cut")
    more = (F.col("place") < F.col("end")) | ((F.col("place") == F.col("end")) & (at <= F.col("edge")))
    return ranked.join(small(last), SOURCE, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("sure") + F.coalesce(more, F.lit(False)).cast("long"))).alias("taken")
    )
