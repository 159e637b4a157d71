"""Bounded samples of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def smallest(rows: DataFrame, most: int) -> list[Row]:
    """The ``most`` rows of the smallest ``order``, by it and then by ``text``.

    The order of the last one is found first, without texts, so that no task hands more texts to
    the driver than the sample has.
    """
    last = rows.select("order").orderBy("order").limit(most).agg({"order": "max"}).first()[0]
    if last is None:
        return []
    return rows.filter(rows["order"] <= last).orderBy("order", "text").limit(most).collect()
