"""Upserts, purges and ids."""

from pyspark.sql import functions as F

from buildlens.functions.ids import assign_ids, issue_key, ordered_ids
from buildlens.operators import store as st
from buildlens.schemas import BUILDS, JOBS
from buildlens.sources import ci_tables

JOB_CHANGE = "name string, url string, retention_floor long"


def test_upsert_jobs_keeps_id_and_url(spark):
    old = spark.createDataFrame([(4, "a", "ua", 1), (9, "b", "ub", 2)], JOBS)
    change = spark.createDataFrame([("b", "moved", None), ("c", "uc", 5)], JOB_CHANGE)
    got = sorted(tuple(r) for r in st.upsert_jobs(old, change).collect())
    assert got == [(4, "a", "ua", 1), (9, "b", "ub", None), (10, "c", "uc", 5)]


def test_upsert_is_idempotent(spark):
    empty = spark.createDataFrame([], BUILDS)
    change = spark.createDataFrame(
        [(f"u{i}", None if i % 2 else "FAILURE", i, 10 * i, 1) for i in range(50)],
        "url string, status string, number long, ts_ms long, job_id long",
    )
    once = st.upsert_builds(empty, change)
    twice = st.upsert_builds(once, change)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(once) == rows(twice) and once.count() == 50
    assert sorted(r.build_id for r in once.collect()) == list(range(1, 51))


def test_assign_ids_continues_and_is_dense(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    top = spark.createDataFrame([(7,)], "m long")
    ids = [r.i for r in assign_ids(df, "k", "i", after=top).collect()]
    assert sorted(ids) == list(range(8, 508))
    assert sorted(tuple(r) for r in assign_ids(df, "k", "i").collect()) == sorted(
        tuple(r) for r in assign_ids(df.repartition(5), "k", "i").collect()
    )


def test_ordered_ids_follow_the_order(spark):
    df = spark.range(300).select(F.format_string("%05d", F.col("id")).alias("k")).repartition(4)
    rows = sorted(tuple(r) for r in ordered_ids(df, "k", "i").collect())
    assert [i for _, i in rows] == sorted({i for _, i in rows}) and len(rows) == 300


def test_issue_key_sorts_by_number(spark):
    df = spark.createDataFrame([(2, 0, None, 1, 5), (10, 0, None, 1, 5), (2, 2, 7, 1, 5), (2, 0, None, 1, 40)],
                               "r long, f int, a long, t long, s long")
    keyed = df.select("*", issue_key(*[F.col(c) for c in "rfats"]).alias("k")).orderBy("k").collect()
    assert [(r.r, r.f, r.s) for r in keyed] == [(2, 0, 5), (2, 0, 40), (2, 2, 5), (10, 0, 5)]


def _store(spark):
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "jobs": table([(1, "keep", 2), (2, "drop", None), (3, "none", None)], "job_id long, name string, retention_floor long"),
        "builds": table([(11, 1, 1), (12, 1, 2), (21, 2, 1), (31, 3, 1)], "build_id long, job_id long, number long"),
        "runs": table([(111, 11, "old"), (121, 12, "now"), (211, 21, None), (311, 31, "now")], "run_id long, build_id long, tag_schema string"),
        "artifacts": table([(1, 111), (2, 121), (3, 211)], "artifact_id long, run_id long"),
        "issues": table([("a", 111), ("b", 121), ("c", 211), ("d", 311)], "issue_id string, run_id long"),
        "similarities": table([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d"), ("k", "b"), ("k", "d")], "group_id string, issue_id string"),
    }


def _keys(store):
    return {name: sorted(r[0] for r in df.collect()) for name, df in store.items()}


def test_purge_retention(spark):
    got = _keys(st.purge_retention(_store(spark)))
    assert got["jobs"] == [1, 2, 3] and got["builds"] == [12, 21, 31]
    assert got["runs"] == [121, 211, 311] and got["artifacts"] == [2, 3]
    assert got["issues"] == ["b", "c", "d"] and got["similarities"] == ["h", "h", "k", "k"]


def test_purge_blocklist_leaves_no_dangling_key(spark):
    store = st.purge_blocklist(_store(spark), ["drop"])
    got = _keys(store)
    assert got["jobs"] == [1, 3] and got["similarities"] == ["g", "g", "k", "k"]
    for child, key, parent in (
        ("builds", "job_id", "jobs"), ("runs", "build_id", "builds"), ("issues", "run_id", "runs"),
        ("artifacts", "run_id", "runs"), ("similarities", "issue_id", "issues"),
    ):
        assert store[child].join(store[parent], key, "left_anti").isEmpty()
    assert _keys(st.purge_blocklist(_store(spark), [])) == _keys(_store(spark))


def test_invalidate(spark):
    store = st.invalidate(_store(spark), "now")
    assert {r.run_id: r.tag_schema for r in store["runs"].collect()} == {111: None, 121: "now", 211: None, 311: "now"}
    assert _keys(store)["issues"] == ["b", "c", "d"]
    assert _keys(store)["similarities"] == ["h", "h", "k", "k"]


def test_line_items_are_grouped_in_as_many_partitions_as_shuffles_have(spark, tmp_path):
    rows = spark.range(1600).select((F.col("id") % 400).alias("l_orderkey"), F.expr("cast(id div 800 as int)").alias("l_linenumber"), (F.col("id") % 7).alias("l_partkey"))
    rows = rows.withColumns({"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F")})
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.range(7).select(F.col("id").alias("p_partkey"), F.lit("ECONOMY").alias("p_type"), F.lit("Brand#11").alias("p_brand"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    runs = ci_tables.runs_b(spark, str(tmp_path))
    assert runs.count() == 800
    assert runs.select(F.spark_partition_id()).distinct().count() == 8
