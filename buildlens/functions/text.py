"""Column expressions over texts: edit distance, byte spans, blob formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the eight bytes every PNG file starts with.
PNG_MAGIC = "89504E470D0A1A0A"


def edit_ratio(threshold: float) -> float:
    """c with: similarity > threshold exactly when distance < c * longer length."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")
    decay = -math.log(threshold)
    return decay / (1.0 + decay)


def edit_budget(length: Column, threshold: float) -> Column:
    """Largest distance worth computing for a pair whose longer text has ``length`` characters.

    Rounded up at the boundary: the similarity test itself decides there.
    """
    return F.floor(length * F.lit(edit_ratio(threshold)) + F.lit(1e-9)).cast("int")


def decay_similarity(distance: Column, longer: Column) -> Column:
    """exp(-d / (m - d)): 1 for equal texts, 0 when every character differs, null for two empties."""
    return (
        F.when(longer == 0, F.lit(None).cast("double"))
        .when(distance >= longer, F.lit(0.0))
        .otherwise(F.exp(-distance / (longer - distance)))
    )


def common_start(left: str, right: str) -> Column:
    """Number of characters that two different texts start with alike, found by halving steps."""
    size = F.greatest(F.char_length(left), F.char_length(right), F.lit(1))
    steps = F.transform(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))
    piece = lambda text, at, step: F.substring(F.col(text), at + 1, step)
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(piece(left, at, step) == piece(right, at, step), at + step).otherwise(at)
    )


def similarity(left: Column, right: Column) -> Column:
    """Similarity of two texts, counted in characters."""
    return decay_similarity(
        F.levenshtein(left, right), F.greatest(F.char_length(left), F.char_length(right))
    )


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets."""
    raw = F.encode(text, "UTF-8")
    return F.decode(F.substring(raw, start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def utf8_text(contents: Column) -> Column:
    """Contents as text, null unless they are valid UTF-8."""
    return F.try_validate_utf8(contents.cast("string"))


def blob_format(contents: Column) -> Column:
    """Null, Png, Svg, Utf8 or Unknown."""
    text = contents.cast("string")
    return (
        F.when(F.octet_length(contents) == 0, "Null")
        .when(F.substring(contents, 1, 8) == F.unhex(F.lit(PNG_MAGIC)), "Png")
        .when(~F.is_valid_utf8(text), "Unknown")
        .when(text.contains("<svg"), "Svg")
        .otherwise("Utf8")
    )
