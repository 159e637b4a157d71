"""Line dedup: lines found in many documents stay only in the last of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; text without other letters takes the faster way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(rk, doc_id, pos, h) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        F.xxhash64("doc_id", "text").alias("rk"),
        "doc_id",
        F.posexplode(
            F.transform(
                split_lines(F.col("text")),
                lambda x: F.when(F.char_length(x) >= min_chars, F.btrim(x, F.lit(BLANKS))),
            )
        ).alias("pos", "line"),
    ).filter(F.char_length("line") >= min_chars)
    return lines.select("rk", "doc_id", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("h"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with shorter texts, n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` different documents lose their lines except
    in the largest doc_id that holds them. A null text stays null and counts as one empty line; a
    null doc_id is one more document, smaller than any other. Repeated rows of a doc_id are one
    document and lose the same lines. Columns named n_lines or n_dropped are replaced.

    Only (row, position, md5) of the lines travels to the count; texts move once, to meet the
    positions they lose. Hot keys combine before the shuffle (count, largest id), and the rows
    that carry a hot key join its one summary row, which Spark may broadcast or split.
    """
    base = docs.select("doc_id", "text", F.struct("*").alias("row"))
    keys = cut_lineage(line_keys(base, min_chars))
    known = keys.select("h", F.struct("doc_id").alias("d"), "doc_id").distinct()
    hot = (
        known.groupBy("h")
        .agg(F.count("d").alias("n"), F.max("doc_id").alias("keep"))
        .filter(F.col("n") >= min_docs)
        .select("h", "keep")
    )
    # Written, so that Spark knows its size and may broadcast it or split the rows of a hot line.
    hot = cut_lineage(hot)
    drops = (
        keys.join(hot, "h")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy("rk", F.struct("doc_id").alias("d"))
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select("rk", F.col("d.doc_id").alias("gone_id"), "gone")
    )
    joined = base.withColumn("rk", F.xxhash64("doc_id", "text")).join(
        drops.withColumnRenamed("rk", "gone_rk"),
        (F.col("rk") == F.col("gone_rk")) & F.col("doc_id").eqNullSafe(F.col("gone_id")),
        "left",
    )
    whole = joined.withColumn("lines", split_lines(F.col("text")))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("gone")),
        F.concat(F.col("gone"), F.array(F.size("lines"))),
        lambda a, b: F.slice(F.col("lines"), a + F.lit(2), b - a - F.lit(1)),
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.flatten(runs), "\n")
    )
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    out = whole.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    extra = [c for c in ("n_lines", "n_dropped") if c not in docs.columns]
    return out.select(*docs.columns, *extra)
