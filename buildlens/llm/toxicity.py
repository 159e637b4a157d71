"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bytesops import pieces, utf8
from buildlens.llm.sampling import smallest

GRAM = 5
BUCKETS = 1 << 18
CHUNK = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


@dataclass(frozen=True)
class ChainModel:
    """Per category: weights over the chosen grams and over the earlier categories' probabilities."""

    categories: tuple[str, ...]
    feature: np.ndarray  # bucket -> feature number, -1 for grams that no model reads
    weights: np.ndarray  # (category, feature)
    links: np.ndarray  # (category, earlier category)
    offsets: np.ndarray


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of every run of GRAM bytes, A-Z folded to lower case and blanks to spaces."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64)
    low = _FOLD[data].astype(np.uint64)
    n = len(low) - GRAM + 1
    packed = low[:n].copy()
    for j in range(1, GRAM):
        packed |= low[j : j + n] << np.uint64(8 * j)
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _feature_rows(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray, width: int) -> np.ndarray:
    """sqrt(count / grams) of the chosen grams, a row per text; whole texts, chunk by chunk."""
    out = np.zeros((len(offsets) - 1, width), np.float32)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        counts = np.zeros(width)
        for lo in range(a, max(a, b - GRAM + 1), CHUNK):
            picked = feature[_grams(data[lo : min(b, lo + CHUNK + GRAM - 1)])]
            counts += np.bincount(picked[picked >= 0], minlength=width)
        out[row] = np.sqrt(counts / max(1, b - a - GRAM + 1))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; features are scaled by their spread."""
    scale = 1 / np.maximum(x.std(axis=0), 1e-4) if len(x) else np.ones(x.shape[1])
    z = x * scale.astype(np.float32)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    w, b = np.zeros(z.shape[1], np.float32), float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return np.zeros(z.shape[1]), b
    v = z[np.random.default_rng(0).choice(len(z), min(len(z), 500), replace=False)]
    rate = 4 / (float(np.linalg.norm(v, 2)) ** 2 * len(z) / len(v) / len(z) + 4 * ridge + 1)
    ahead, b_ahead, t = w.copy(), b, 1.0
    for _ in range(rounds):
        miss = (_sigmoid(z @ ahead + b_ahead) - y).astype(np.float32)
        new = ahead - rate * (z.T @ miss / len(z) + ridge * ahead)
        b_new = b_ahead - rate * float(miss.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    return w.astype(float) * scale, b


def fit_chain(
    labelled: DataFrame,
    categories: Sequence[str],
    most_docs: int = 2000,
    most_bytes: int = 20_000,
    per_category: int = 300,
    folds: int = 3,
    ridge: float = 1e-3,
    rounds: int = 60,
) -> ChainModel:
    """Chain from rows (doc_id, text, one 0/1 column per category); nulls count as 0.

    The sample is bounded: ``most_docs`` rows in which some category is 1 and as many others, by
    the smallest md5(doc_id), texts of at most ``most_bytes`` bytes. Grams are chosen per category
    by how far apart its classes are. The model of a category reads these grams and the
    probabilities of the earlier categories; in training these are out-of-fold: each row's
    earlier probability comes from models fitted without its fold, as they will be unsure later.
    """
    some = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in categories], F.lit(0))
    marked = labelled.filter(
        F.col("doc_id").isNotNull() & (F.octet_length("text") <= most_bytes)
    ).select(
        F.md5(F.col("doc_id").cast("string")).alias("order"),
        "text",
        F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("int") for c in categories]).alias("y"),
        some.alias("some"),
    )
    rows = []
    for want in (0, 1):
        rows += smallest(marked.filter(F.col("some") == want), most_docs)
    rows.sort(key=lambda r: (r["order"], r["text"]))
    column = pa.array([r["text"] for r in rows], pa.string())
    data, offsets = utf8(column)
    y = np.array([r["y"] for r in rows], float).reshape(len(rows), len(categories))

    # How many rows of each class of each category hold a bucket.
    held = np.zeros((len(categories), 2, BUCKETS), np.float32)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        present = np.unique(_grams(data[a:b]))
        for c in range(len(categories)):
            held[c, int(y[row, c]), present] += 1
    chosen = []
    for c in range(len(categories)):
        n1 = y[:, c].sum()
        n0 = len(rows) - n1
        if not n1 or not n0:
            continue
        p1, p0 = held[c, 1] / n1, held[c, 0] / n0
        spread = np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 + 1e-3)
        chosen.append(np.argsort(-(p1 - p0) / spread, kind="stable")[:per_category])
    picked = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    feature = np.full(BUCKETS, -1, np.int32)
    feature[picked] = np.arange(len(picked))
    x = _feature_rows(data, offsets, feature, len(picked))

    fold = np.arange(len(rows)) % folds
    weights = np.zeros((len(categories), len(picked)))
    links = np.zeros((len(categories), len(categories)))
    biases = np.zeros(len(categories))
    earlier = np.zeros((len(rows), 0), np.float32)
    for c in range(len(categories)):
        full = np.hstack([x, earlier])
        unseen = np.zeros(len(rows))
        for k in range(folds):
            w, b = _fit_linear(full[fold != k], y[fold != k, c], ridge, rounds)
            unseen[fold == k] = _sigmoid(full[fold == k] @ w + b)
        w, b = _fit_linear(full, y[:, c], ridge, rounds)
        weights[c], links[c, :c], biases[c] = w[: len(picked)], w[len(picked) :], b
        earlier = np.hstack([earlier, unseen[:, None].astype(np.float32)])
    return ChainModel(tuple(categories), feature, weights, links, biases)


def _chain(batch: pa.RecordBatch, model: ChainModel) -> np.ndarray:
    """Probabilities of a batch, a column per category, each from the ones before it."""
    data, offsets = utf8(batch.column("text"))
    x = _feature_rows(data, offsets, model.feature, model.weights.shape[1])
    p = np.zeros((len(x), len(model.categories)))
    for c in range(p.shape[1]):
        p[:, c] = _sigmoid(x @ model.weights[c] + p[:, :c] @ model.links[c, :c] + model.offsets[c])
    return p


def score_chain(docs: DataFrame, model: ChainModel) -> DataFrame:
    """(doc_id, p_<category>...) for every row of ``docs`` (doc_id, text), whole texts.

    A null, empty or very short text has no grams: its probabilities are those of the offsets.
    Ids pass through, repeated rows are scored alike, other columns aren't read.
    """
    names = [f"p_{c}" for c in model.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            p = _chain(batch, model)
            columns = [batch.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(names))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} double" for n in names]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ChainModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose last category has a probability below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            yield batch.filter(pa.array(_chain(batch, model)[:, -1] < least))

    return docs.mapInArrow(run, docs.schema)
