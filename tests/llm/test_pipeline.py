"""Registered queries against SQL or plain Python on the smallest tables, and the pipeline stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from buildlens.llm.oracle import ORACLE
from buildlens.llm.queries import QUERIES
from buildlens.llm.simhash import fingerprint
from buildlens.session import cut_lineage
from tests.compare import DATA, compare, duck
from tests.llm.test_operators import brute_lines, brute_matches, brute_repeats


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    read = lambda t, c: con.execute(f"SELECT {c} FROM read_parquet('{DATA}/{t}.parquet')").fetchall()
    return {
        "documents": read("documents", "doc_id, text"),
        "benchmark": read("benchmark", "item_id, text"),
        "labels": dict((d, (q, t)) for d, q, t in read("labels", "doc_id, quality, toxic")),
    }


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(DATA), name, QUERIES[name], ORACLE[name], DATA) is None


def test_fingerprints_of_the_query(spark, tables):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash_components"](spark, DATA).collect()}
    fps = {d: fingerprint((t or "").encode(), 3) % 2**64 for d, t in tables["documents"]}
    reach = {d: min(o for o in fps if (fps[o] ^ fps[d]).bit_count() <= 2) for d in fps}
    while (again := {d: min(reach[o] for o in fps if reach[o] == reach[d] or (fps[o] ^ fps[d]).bit_count() <= 2) for d in fps}) != reach:
        reach = again
    assert got == {d: (f"{fps[d]:016x}", reach[d]) for d in fps}


def test_contamination_of_the_query(spark, tables):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, DATA).collect()}
    squeeze = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    texts = [(d, squeeze(t)) for d, t in tables["documents"]]
    whole = {(d, i) for i, item in tables["benchmark"] for d, t in texts if squeeze(item) in t}
    items, texts = dict(tables["benchmark"]), dict(tables["documents"])
    assert whole <= got and all(brute_matches(texts[d], items[i], 0.8) for d, i in got)


def test_repeats_of_the_query(spark, tables):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op9_suffix_array_dedup"](spark, DATA).collect())
    want = Counter((*k[:4], hashlib.sha256(k[4]).hexdigest()) for k in brute_repeats(tables["documents"], 100))
    assert got == want


def test_models_of_the_queries(spark, tables):
    quality = {r["doc_id"]: r for r in QUERIES["op10_compression_quality"](spark, DATA).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in QUERIES["op2_toxicity_chain"](spark, DATA).collect()}
    labels = {d: v for d, v in tables["labels"].items() if d in quality}
    held = [d for d in labels if quality[d]["held_out"]]
    right = sum((quality[d]["score"] >= 0.5) == labels[d][0] for d in held)
    assert len(quality) == len(tables["documents"]) and right >= 0.8 * len(held)
    assert sum(toxic[d] == labels[d][1] for d in labels) >= 0.95 * len(labels)


def test_a_run_deletes_what_no_stage_reads_any_more(spark, monkeypatch):
    kept = []
    path_of = corpus_pipeline.scratch_path
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda spark, name: kept.append(path_of(spark, name)) or kept[-1])
    mixed = corpus_pipeline.run(spark, DATA)
    folders = [Path(p.removeprefix("file:")) for p in kept]
    assert mixed.count() > 0 and [f.exists() for f in folders] == [False, False, False, True]
    assert not list(folders[0].parent.glob("scope-*/*"))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, DATA))
        seen[name] = (docs.collect(), out.collect())
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out

    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if tables["labels"].get(r["doc_id"]) and not tables["labels"][r["doc_id"]][1]]
    assert set(after) <= set(before) and sum(d in kept for d in clean) >= 0.98 * len(clean)

    before, after = seen["line_dedup"]
    want = Counter((d, t) for d, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in before], 40, 5).elements())
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near_dedup"]
    by_text, kept = defaultdict(set), {r["doc_id"] for r in after}
    for r in before:
        by_text[" ".join(r["text"].lower().split())].add(r["doc_id"])
    assert set(after) <= set(before) and len(after) >= 0.5 * len(before)
    assert all(len(ids & kept) <= 1 for ids in by_text.values())

    before, after = seen["decontamination"]
    items = [t for _, t in tables["benchmark"]]
    squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    bad = {r["doc_id"] for r in before if any(f" {squeeze(i)} " in f" {squeeze(r['text'])} " for i in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert bad <= gone
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(any(brute_matches(texts[d], i, 0.8) for i in items) for d in gone)

    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert all(0 < r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in after)
    total = sum(len((r["text"] or "").split()) for r in before)
    assert abs(sum(r["taken"] for r in after) - total) <= 0.15 * total
