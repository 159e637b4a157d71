"""Exact ranks by parallel sorting with regular sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.session import cut_lineage

SAMPLES = 256
FAN = 64
SEGMENTS = 4096


def _key_order(score: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Places in the order of falling score, then rising tie."""
    return np.lexsort((tie, -score))


class RegularSample:
    """Every k-th row of a sorted run; k doubles when the sample is full, so its size is bounded."""

    def __init__(self, run: int):
        self.run, self.step, self.seen = run, 1, 0
        self.score, self.tie = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, tie: np.ndarray) -> None:
        at = np.arange(self.seen, self.seen + len(score))
        picked = at % self.step == self.step - 1
        self.seen += len(score)
        self.score = np.concatenate([self.score, score[picked]])
        self.tie = np.concatenate([self.tie, tie[picked]])
        while len(self.score) > 2 * SAMPLES:
            self.score, self.tie, self.step = self.score[1::2], self.tie[1::2], self.step * 2

    def rows(self) -> pa.RecordBatch:
        n = len(self.score)
        columns = [np.full(n, self.run), self.score, self.tie, np.full(n, self.step)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["run", "score", "tie", "stands_for"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: RegularSample | None = None
    for batch in batches:
        run = batch.column("run").to_numpy()
        score, tie = batch.column("score").to_numpy(), batch.column("tie").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if now is None or now.run != run[lo]:
                if now is not None:
                    yield now.rows()
                now = RegularSample(int(run[lo]))
            now.add(score[lo:hi], tie[lo:hi])
    if now is not None:
        yield now.rows()


def _evenly(score: np.ndarray, tie: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Places of the ``parts`` - 1 keys, at most, that cut weighted keys into even parts; keys are sorted."""
    total = np.cumsum(weight)
    wanted = total[-1] * np.arange(1, parts) / parts
    return np.unique(np.minimum(np.searchsorted(total, wanted), len(total) - 1))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The regular sample of some runs, from theirs."""
    order = _key_order(rows["score"].to_numpy(), rows["tie"].to_numpy())
    rows = rows.iloc[order]
    weight = rows["stands_for"].to_numpy()
    picked = _evenly(rows["score"].to_numpy(), rows["tie"].to_numpy(), weight, 2 * SAMPLES + 1)
    total = np.cumsum(weight)[picked]
    out = rows.iloc[picked].copy()
    out["run"] = rows["run"].iloc[0] // FAN
    out["stands_for"] = np.diff(np.append(0, total))
    return out[["run", "score", "tie", "stands_for"]]


def splitters(runs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ties) that cut the sorted runs (run, score, tie) into about even segments.

    Each run gives at most 2 * SAMPLES keys at even distances. Samples of FAN runs at a time are merged
    and thinned again until FAN runs are left, so neither a task nor the driver sees more than
    2 * SAMPLES * FAN keys, however many rows and runs there are.
    """
    sample = cut_lineage(runs.select("run", "score", "tie").mapInArrow(_samples, "run long, score long, tie long, stands_for long"))
    last = sample.agg(F.max("run")).first()[0]
    while last is not None and last >= FAN:
        merged = sample.groupBy(F.expr(f"run div {FAN}")).applyInPandas(_merged, sample.schema)
        sample, last = cut_lineage(merged), last // FAN
    rows = sample.toPandas()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score, tie = rows["score"].to_numpy(), rows["tie"].to_numpy()
    order = _key_order(score, tie)
    score, tie = score[order], tie[order]
    at = _evenly(score, tie, rows["stands_for"].to_numpy()[order], parts)
    return score[at], tie[at]


def segment_of(score: np.ndarray, tie: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted ``cuts`` come before each key; equal keys share a segment."""
    at, ties = cuts
    low = np.searchsorted(-at, -score, side="left")
    high = np.searchsorted(-at, -score, side="right")
    out = low.astype(np.int64)
    tied = np.flatnonzero(low < high)
    for value in np.unique(low[tied]).tolist():
        here = tied[low[tied] == value]
        out[here] = value + np.searchsorted(ties[value : high[here[0]]], tie[here], side="left")
    return out


def sorted_runs(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """``rows`` written with a run number; every run is in the order of falling score and rising tie."""
    runs = rows.withColumn("run", F.spark_partition_id().cast("long"))
    return cut_lineage(runs.sortWithinPartitions(F.desc(score), F.asc(tie)))


def first_ranks(runs: DataFrame, score: str, tie: str, most: int, then: list[str]) -> DataFrame:
    """The rows of sorted_runs with ``rank``: 1 for the highest score, null beyond the first ``most``.

    Equal scores go by rising ``tie``, then by the columns of ``then``. Splitters from regular samples deal
    the keys into segments; counts per segment, added up, give the rank at which each starts. Only the
    segments up to the one that holds rank ``most`` are exchanged and sorted. A null score takes no part.
    """
    spark = runs.sparkSession
    parts = min(SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in runs.columns if c != "run"]
    cuts = splitters(
        runs.filter(F.col(score).isNotNull()).select("run", F.col(score).alias("score"), F.col(tie).alias("tie")), parts
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(score)
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(known), -1)
            out[known] = segment_of(keys.drop_null().to_numpy(), batch.column(tie).filter(pa.array(known)).to_numpy(), cuts)
            yield batch.append_column("segment", pa.array(out, pa.int64()))

    schema = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in rest)
    dealt = cut_lineage(runs.select(*rest).mapInArrow(deal, f"{schema}, segment long"))
    sizes = dict(dealt.filter("segment >= 0").groupBy("segment").agg(F.count(F.lit(1))).collect())
    before, starts = 0, []
    for segment in sorted(sizes):
        if before >= most:
            break
        starts.append((segment, before))
        before += sizes[segment]
    last = starts[-1][0] if starts else -1
    offsets = spark.createDataFrame(starts, "segment long, before long")
    order = Window.partitionBy("segment").orderBy(F.desc(score), F.asc(tie), *then)
    wanted = (F.col("segment") >= 0) & (F.col("segment") <= last)
    # One row per segment, SEGMENTS at most.
    ranked = dealt.filter(wanted).withColumn("place", F.row_number().over(order)).join(F.broadcast(offsets), "segment")
    rank = F.col("before") + F.col("place")
    ranked = ranked.select(*rest, F.when(rank <= most, rank).cast("long").alias("rank"))
    others = dealt.filter(~wanted).select(*rest, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)
