"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BUCKETS = 4096
SALTS = 256
UNIT = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Null as a key of its own, after all names by code point."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sized: DataFrame, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, source_size, target): the sources' shares of all sizes, capped and shared again.

    Sources with the least room per weight are capped first, so after sorting by that ratio the
    capped ones are the first k for the only k that fits; what is left is shared by weight.
    One row per source is sorted; sizes are whole numbers until the last division.
    """
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("n", F.row_number().over(Window.orderBy("key")))
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1)
    cap = F.col("source_size") * most
    ranked = ranked.withColumn("w", choice.cast("long")).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ranked.select(
        "key",
        "source_size",
        "w",
        "cap",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"),
    ).withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("w"))
    # The sources above the first one that isn't capped share what is left at that place.
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "key", "left", "open")))
    shared = level.withColumn("at", first.over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("at.left").cast("double") * F.col("w") / F.col("at.open")
    )
    return shared.select("key", "source_size", target.alias("target"))


def _salted(per_source: DataFrame) -> DataFrame:
    """Each source's row once per salt."""
    return per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _chances(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, from, m, left): documents of ``from`` words or more share ``left`` words, at m / sqrt(1 + size).

    The chances of all documents that are taken once more must add up to ``rest`` words. The shortest have
    the highest: as long as theirs would be one or more they are certain, their words come off the rest, and
    m grows for the others. One row per source and document length is sorted.
    """
    root = F.sqrt(F.col("size") + 1.0)
    # Words per unit of 1 / sqrt(1 + size), in whole thousandths: the sum has one result.
    thousandths = F.floor(F.col("size") * 1000 / root).cast("long")
    sizes = sized.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(plan.filter("rest >= 0.5").select("key", "rest"), "key")
    order = Window.partitionBy("key").orderBy("size")
    shorter = F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    unit = F.sum(thousandths * F.col("n")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    shares = sizes.withColumn("left", F.col("rest") - F.coalesce(shorter, F.lit(0))).withColumn(
        "m", F.col("left") / F.greatest(unit, F.lit(1))
    )
    first = F.min(F.when(F.col("m") * 1000 / root < 1, F.struct("size", "m", "left"))).alias("first")
    found = shares.groupBy("key").agg(first)
    # Without such a length all are certain.
    return found.select(
        "key",
        F.coalesce("first.size", F.lit(2**62)).alias("from"),
        F.coalesce("first.m", F.lit(0.0)).alias("m"),
        F.coalesce("first.left", F.lit(0.0)).alias("left"),
    )


def _uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(UNIT))


def mix_sources(docs: DataFrame, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for all of ``docs``.

    A document's size is its number of words. A source needs target / source_size copies of each
    word. Whole copies are certain. What is left goes to a Pareto order sample: document j has the
    inclusion probability p = min(1, m / sqrt(1 + size)) with the number m that lets the expected words
    meet the rest. Documents with p = 1 are certain; the others are ranked by the odds of a random number
    divided by the odds of p, and taken in this order while the middle of a document lies within the
    words that are left. Short documents have the higher chances, so one very long text seldom decides
    a source.

    Random numbers come from md5(doc_id): reruns agree. Null text and empty text have size 0 and
    take nothing; sources that are null are one source, the last; a null id is an id of its own;
    repeated rows are documents of their own, with ties in the order of their sizes. An empty table
    gives an empty result. Other columns aren't read.

    Ranks are cut into 4,096 buckets per source; sums per bucket combine before the shuffle, whole
    buckets are taken or left, and only the bucket on the edge is sorted. Documents meet their
    source's numbers under one of 256 salts. So no source, however large, is gathered in a task.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            source_key(F.col("source")).alias("key"),
            word_count(F.col("text")).alias("size"),
        )
    )
    targets = source_targets(sized, most, weights)
    root = F.sqrt(F.col("size") + 1.0)
    plan = targets.select(
        "key",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .cast("long")
        .alias("certain"),
    )
    plan = plan.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    plan = cut_lineage(plan.join(_chances(sized, plan), "key", "left"))
    p = F.least(F.lit(0.999999), F.col("m") * 1000 / root)
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    ranked = (
        sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        .join(_salted(plan), ["key", "salt"])
        .withColumn("u", _uniform(F.col("doc_id")))
        .withColumn("p", F.when((F.col("size") >= F.col("from")) & (F.col("left") >= 0.5), p))
        .withColumn("q", odds)
        .withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
    )
    sums = ranked.filter("p > 0").groupBy("key", "bucket", "left").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bucket")
    edge = (
        sums.withColumn("upto", F.sum("words").over(upto))
        .withColumn("before", F.col("upto") - F.col("words"))
        .groupBy("key")
        .agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "before"))).alias("e")
        )
        .select("key", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    )
    placed = ranked.join(_salted(edge), ["key", "salt"], "left").withColumn(
        "side",
        F.when((F.col("size") > 0) & (F.col("size") < F.col("from")) & (F.col("rest") >= 0.5), -1)
        .when(F.col("p").isNull() | (F.col("p") <= 0), 1)
        .when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), -1)
        .when(F.col("bucket") > F.col("edge"), 1)
        .otherwise(0),
    )
    at_edge = Window.partitionBy("key").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    on = placed.filter("side = 0").withColumn(
        "middle",
        F.col("before") + F.sum("size").over(at_edge.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2,
    ).withColumn("extra", (F.col("middle") <= F.col("left")).cast("long"))
    off = placed.filter("side <> 0").withColumn("extra", (F.col("side") < 0).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "certain", "extra"]
    both = on.select(*names).unionByName(off.select(*names))
    copies = F.col("certain") + F.col("extra")
    return both.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
