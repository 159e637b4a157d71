"""Importance resampling and exact ranks against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from buildlens.llm import regular_sampling, resampling
from buildlens.llm.regular_sampling import first_ranks, segment_of, sorted_runs
from buildlens.llm.resampling import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def feature_list(text, longest):
    w = word_list(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, feature_list(text, longest)))
    for text in target:
        t.update(map(bucket, feature_list(text, longest)))
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * ns / ((s[b] + 1.0) * nt)))
    rows = []
    for doc_id, text in docs:
        found = feature_list(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
    part = [i for i, (d, text) in enumerate(docs) if d is not None and len(word_list(text)) >= least]
    part.sort(key=lambda i: (-rows[i][3], rows[i][0], rows[i][2], rows[i][1]))
    for place, i in enumerate(part[: percent * len(part) // 100], 1):
        rows[i][4] = place
    return Counter(map(tuple, rows))


def texts(n):
    rng = np.random.default_rng(5)
    vocabulary = [*(f"W{i}" for i in range(80)), "Ärger", "naïve", "x" * 70, "x" * 300, "日本", "don't", "a-b_c", "", "1,5"]
    return [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_python(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK", 97)
    docs = [(i * 7 % 401, t) for i, t in enumerate(texts(400))]
    docs += [(1000, None), (1001, ""), (None, docs[0][1]), docs[3], docs[3], (docs[3][0], docs[4][1])]
    docs += [(2000 + i, docs[5][1] + " end of it" * 8) for i in range(200)]
    target = [t for t in texts(30)[::3]] + [None, "", "W1 W2 W1"]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int")
    got = resample(table, spark.createDataFrame([(t,) for t in target], "text string"), longest)
    assert Counter(map(tuple, got.collect())) == brute(docs, target, longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    docs = [(i, "one two three four five six seven " * 4) for i in range(30)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), none)
    assert Counter(map(tuple, got.collect())) == brute(docs, [])


@pytest.mark.parametrize("most", [0, 1, 700, 5000])
def test_ranks_of_many_ties_and_runs(spark, monkeypatch, most):
    monkeypatch.setattr(regular_sampling, "SAMPLES", 4)
    monkeypatch.setattr(regular_sampling, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(int(s) if s else None, int(d)) for s, d in zip(rng.choice([0, 1, 5, 5, 5, 900, -7, -7], 3000), rng.integers(0, 2000, 3000))]
    table = spark.createDataFrame(rows, "score long, id long").repartition(23)
    got = first_ranks(sorted_runs(table, "score", "id"), "score", "id", most, [])
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1]))
    want = Counter((*r, i if i <= most else None) for i, r in enumerate(order, 1))
    want.update((s, d, None) for s, d in rows if s is None)
    assert Counter(map(tuple, got.collect())) == want


def test_segments_follow_the_order():
    rng = np.random.default_rng(2)
    score, tie = rng.integers(-3, 3, 500), rng.integers(0, 40, 500)
    order = np.lexsort((tie, -score))
    cuts = score[order][::50], tie[order][::50]
    segment = segment_of(score, tie, cuts)[order]
    assert (np.diff(segment) >= 0).all() and segment.max() >= 8
    keys = list(zip(-score[order], tie[order]))
    assert all(segment[i] == segment[i + 1] for i in range(499) if keys[i] == keys[i + 1])
