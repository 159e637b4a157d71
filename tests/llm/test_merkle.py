"""The manifest against a plain Merkle forest."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from buildlens.llm.merkle import fold, leaf_digest, merkle_proofs
from buildlens.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """(root, path of each leaf): the siblings before and after, level by level."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            paths[k].append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [i // 16 for i in at]
    return level[0], paths


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r[:5])))
        subs.append((mine, *tree([leaf_of(*r[:5]) for r in mine])))
    root, tops = tree([s[1] for s in subs])
    out = Counter()
    for (mine, subroot, paths), top in zip(subs, tops):
        for r, path in zip(mine, paths):
            path = path + top
            now = leaf_of(*r[:5])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf_of(r[0], r[1] and r[1].translate(LOWER), *r[2:5])
            for before, after in path:
                now = sha(before + now + after)
            out[r[0], leaf_of(*r[:5]), subroot, root, sha("".join(b + a for b, a in path)), now, now == root] += 1
    return out


def written(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return QUERIES["op13_merkle_manifest"](spark, str(folder))


def documents():
    rows = [(i * 13 % 5003, f"Text {i} é", "en", "hot", i, 0) for i in range(4700)]
    for source, n in (("a", 1), ("b", 16), ("", 17), (None, 257), ("é", 2), ("z z", 33)):
        rows += [(10_000 + len(rows) + i, "no capitals", None, source, None, 0) for i in range(n)]
    rows += [(20_000 + i, "One", "de", f"s{i:03d}", 3, 0) for i in range(300)]
    return rows + [(None, None, None, None, None, 0), (None, "", "", "", 0, 0), rows[0], rows[0], (rows[0][0], "other", "x", "hot", 1, 0)]


def test_manifest_equals_a_plain_forest(spark, tmp_path):
    rows = documents()
    got = written(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s", 1, 0)], [(i, "Ab", "en", "s", 1, 0) for i in range(16)]])
def test_small_manifests(spark, tmp_path, rows):
    got = Counter(map(tuple, written(spark, rows, tmp_path).collect()))
    assert got == (brute(rows) if rows else Counter())


def test_proofs_lead_to_the_root(spark):
    table = spark.createDataFrame([(i, f"v{i}") for i in range(600)], "k long, v string")
    proofs = merkle_proofs(table, F.lit(None).cast("string"), leaf_digest([F.col("v")]), [F.col("k")], {"k": F.col("k")})
    got = proofs.select("k", (fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), F.size("path").alias("n")).collect()
    assert len(got) == 600 and all(r.ok and r.n == 3 for r in got)
