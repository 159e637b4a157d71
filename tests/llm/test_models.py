"""Scores of the trained models against plain Python."""

import hashlib
import math

import numpy as np
import zstandard
from pyspark.sql import functions as F

from buildlens.llm.quality import fit_quality, score_quality
from buildlens.llm.toxicity import _fit_linear, fit_chain, score_chain


def words(seed, n, vocabulary=300):
    return [f"w{i}x" for i in np.random.default_rng(seed).integers(0, vocabulary, n)]


def labelled(spark):
    rows = []
    for i in range(120):
        text = words(i, 40) + ["grobian"] * (2 * (i % 4 == 0)) + ["Lümmel"] * (3 * (i % 8 == 0))
        rows.append((i, " ".join(text), int(i % 8 == 0), int(i % 4 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, rude int, toxic int")


def gram_share(text, model):
    """sqrt(count / grams) of the model's grams."""
    raw = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in text.encode().lower())
    counts = np.zeros(model.weights.shape[1])
    n = len(raw) - 4
    for i in range(n):
        number = int.from_bytes(raw[i : i + 5], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 46
        if model.feature[number] >= 0:
            counts[model.feature[number]] += 1
    return np.sqrt(counts / max(1, n)).astype(np.float32)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_chain_equals_plain_python(spark):
    rows, table = labelled(spark)
    model = fit_chain(table, ["rude", "toxic"], folds=3, per_category=40)
    # Each category's probability feeds the next one.
    got = {r["doc_id"]: (r["p_rude"], r["p_toxic"]) for r in score_chain(table, model).collect()}
    for doc_id, text, _, _ in rows[::10]:
        x = gram_share(text, model)
        rude = sigmoid(float(x @ model.weights[0]) + model.offsets[0])
        toxic = sigmoid(float(x @ model.weights[1]) + rude * model.links[1, 0] + model.offsets[1])
        assert np.allclose(got[doc_id], (rude, toxic), atol=1e-5)

    # The second model was trained on what models without a row's fold say of the row.
    order = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    x = np.array([gram_share(r[1], model) for r in order])
    rude, toxic = (np.array([r[c] for r in order], float) for c in (2, 3))
    unseen = np.zeros(len(order), np.float32)
    for fold in range(3):
        inside = np.arange(len(order)) % 3 == fold
        w, b = _fit_linear(x[~inside], rude[~inside], 1e-3, 60)
        unseen[inside] = [sigmoid(float(v @ w) + b) for v in x[inside]]
    w, b = _fit_linear(np.hstack([x, unseen[:, None]]), toxic, 1e-3, 60)
    assert np.allclose(model.weights[1], w[:-1], atol=1e-3) and abs(model.links[1, 0] - w[-1]) < 1e-2 and abs(model.offsets[1] - b) < 1e-3
    seen = np.array([sigmoid(float(v @ model.weights[0]) + model.offsets[0]) for v in x])
    assert np.abs(seen - unseen).max() > 1e-3


def test_quality_equals_plain_python(spark):
    rows = [(i, " ".join(words(i, 150) if i % 2 else ["!!" + w.upper() for w in words(i, 10)] * 9), i % 2) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = fit_quality(table.filter("doc_id < 60"))
    books = [zstandard.ZstdCompressionDict(raw) for raw in (model.good, model.bad)]
    packers = [zstandard.ZstdCompressor(level=3, dict_data=b, write_content_size=False, write_dict_id=False) for b in books]
    got = {r["doc_id"]: r["score"] for r in score_quality(table, model).collect()}
    for doc_id, text, _ in rows[::7]:
        raw = text.encode()
        good, bad = (sum(len(p.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for p in packers)
        assert abs(got[doc_id] - sigmoid(model.slope * (bad - good) / len(raw) + model.offset)) < 1e-9
    held = [(got[d] >= 0.5) == bool(y) for d, _, y in rows if d >= 60]
    assert sum(held) >= 28
