"""Structured Streaming: ingest arriving snapshots, tag arriving runs and artifacts.

Every batch reads what earlier batches left and overwrites only its own folder, so a batch that is
run again after a failure leaves the same files. What a batch must know of all earlier ones (jobs,
builds, urls and ids seen) is a base table per COMPACT batches and the few batches since: the files it
reads do not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from buildlens.catalog import Tag, fingerprint
from buildlens.functions.ids import assign_ids
from buildlens.operators import ingest, store as st, tagging
from buildlens.schemas import ARTIFACTS, BUILDS, ISSUES, JOBS, PAYLOAD, RUNS
from buildlens.session import cut_lineage, scratch_path, scratch_scope

_URL = T.StructType([RUNS["url"]])
_SEEN = T.StructType([RUNS["run_id"], RUNS["url"]])
_ARTIFACT_ID = T.StructType([ARTIFACTS["artifact_id"]])


COMPACT = 16
BASE_FILES = 8


def _base(batch_id: int) -> int:
    """How many batches the base covers that a batch reads."""
    return batch_id - batch_id % COMPACT


def _earlier(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of the batches before this one: (columns of ``schema``, batch), those of the base with batch -1."""
    base = _base(batch_id)
    rows = spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    if base:
        old = spark.read.schema(schema).parquet(f"{path}-base/upto={base}")
        rows = rows.unionByName(old.withColumn("batch", F.lit(-1).cast("long")))
    if base < batch_id:
        typed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        paths = [f"{path}/batch={i}" for i in range(base, batch_id)]
        rows = rows.unionByName(spark.read.schema(typed).option("basePath", path).parquet(*paths))
    return rows


def _last(rows: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """Of the changes that batches appended, the last one per key: the table as they left it."""
    rest = [c for c in schema.names if c != key]
    if not rest:
        return rows.select(key).distinct()
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(key, "row.*")
    return last.select(*schema.names)


def _compact(spark: SparkSession, path: str, schema: T.StructType, key: str, batch_id: int) -> None:
    """After the last batch that a base covers, write it; a batch that is repeated writes the same."""
    if (batch_id + 1) % COMPACT:
        return
    before = _earlier(spark, path, schema, batch_id)
    own = spark.read.schema(schema).parquet(f"{path}/batch={batch_id}").withColumn("batch", F.lit(batch_id).cast("long"))
    last = _last(before.unionByName(own), schema, key)
    last.repartition(BASE_FILES, key).write.mode("overwrite").parquet(f"{path}-base/upto={batch_id + 1}")


def _current(spark: SparkSession, path: str, schema: T.StructType, key: str, before: int) -> DataFrame:
    return _last(_earlier(spark, path, schema, before), schema, key)


def _every(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The table as all batches left it."""
    typed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return _last(spark.read.schema(typed).parquet(path), schema, key)


def _append_changes(
    path: str, batch_id: int, old: DataFrame, change: DataFrame, key: str, apply: Callable
) -> None:
    """Append the rows that ``change`` adds or updates, whole rows with their id."""
    change = cut_lineage(change)
    written = apply(old, change).join(change.select(key), key, "left_semi").select(*old.columns)
    written.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest_batch(
    payload: DataFrame, batch_id: int, root: str, details: DataFrame, blocklist: list[str], last_n: int
) -> None:
    """Flatten one batch of snapshots into the job, build and run tables under ``root``.

    All tables are only appended to: jobs and builds by the rows that the batch adds or changes, of
    which the last one counts, runs by the new ones, as a stored run is never read again.
    """
    spark = payload.sparkSession
    jobs = ingest.kept_jobs(ingest.payload_jobs(payload), blocklist)

    old_jobs = _current(spark, f"{root}/jobs", JOBS, "job_id", batch_id)
    change = ingest.last_report(ingest.job_rows(jobs, last_n), "name", "retention_floor")
    _append_changes(f"{root}/jobs", batch_id, old_jobs, change, "name", st.upsert_jobs)
    # The batch's own rows name every job and build that it lists.
    job_ids = spark.read.schema(JOBS).parquet(f"{root}/jobs/batch={batch_id}").select(
        F.col("name").alias("job_name"), "job_id"
    )

    listed = ingest.build_rows(jobs, last_n)
    old_builds = _current(spark, f"{root}/builds", BUILDS, "build_id", batch_id)
    change = listed.drop("runs").join(job_ids, "job_name").drop("job_name")
    change = ingest.last_report(change, "url", "ts_ms")
    _append_changes(f"{root}/builds", batch_id, old_builds, change, "url", st.upsert_builds)
    build_ids = spark.read.schema(BUILDS).parquet(f"{root}/builds/batch={batch_id}").select(
        F.col("url").alias("build_url"), "build_id"
    )

    stored = _earlier(spark, f"{root}/runs", _SEEN, batch_id)
    fresh = ingest.new_runs(ingest.last_report(ingest.own_runs(listed), "url", "build_url"), stored)
    rows = ingest.run_rows(fresh, details).join(build_ids, "build_url")
    runs = assign_ids(rows, "url", "run_id", after=stored.agg(F.max("run_id")))
    runs.select(*RUNS.names).write.mode("overwrite").parquet(f"{root}/runs/batch={batch_id}")
    for name, schema, key in (("jobs", JOBS, "job_id"), ("builds", BUILDS, "build_id"), ("runs", _SEEN, "run_id")):
        _compact(spark, f"{root}/{name}", schema, key, batch_id)


def stream_ingest(
    spark: SparkSession,
    inbox: str,
    root: str,
    details: DataFrame,
    blocklist: list[str],
    last_n: int,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start a query that ingests the snapshot files in ``inbox`` and stops when none is left."""
    files = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_batch).json(inbox)
    snapshots = ingest.with_file(files)

    def apply(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            ingest_batch(batch, batch_id, root, details, blocklist, last_n)

    return (
        snapshots.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def tag_batch(runs: DataFrame, batch_id: int, root: str, tags: list[Tag]) -> None:
    """Tag the runs of one batch whose url no earlier batch has tagged under this fingerprint."""
    spark = runs.sparkSession
    home = f"{root}/{fingerprint(tags)}"
    seen = _earlier(spark, f"{home}/tagged", _URL, batch_id)
    fresh = runs.dropDuplicates(["url"]).join(seen, "url", "left_anti")
    issues = tagging.run_name_issues(fresh, tags).unionByName(tagging.console_issues(fresh, tags))
    issues.write.mode("overwrite").parquet(f"{home}/issues/of=runs/batch={batch_id}")
    fresh.select("url").write.mode("overwrite").parquet(f"{home}/tagged/batch={batch_id}")
    _compact(spark, f"{home}/tagged", _URL, "url", batch_id)


def tag_artifact_batch(artifacts: DataFrame, batch_id: int, root: str, tags: list[Tag]) -> None:
    """Tag the artifacts of one batch whose id no earlier batch has tagged under this fingerprint."""
    spark = artifacts.sparkSession
    home = f"{root}/{fingerprint(tags)}"
    seen = _earlier(spark, f"{home}/tagged_artifacts", _ARTIFACT_ID, batch_id)
    fresh = artifacts.dropDuplicates(["artifact_id"]).join(seen, "artifact_id", "left_anti")
    issues = tagging.artifact_issues(fresh, tags)
    issues.write.mode("overwrite").parquet(f"{home}/issues/of=artifacts/batch={batch_id}")
    fresh.select("artifact_id").write.mode("overwrite").parquet(f"{home}/tagged_artifacts/batch={batch_id}")
    _compact(spark, f"{home}/tagged_artifacts", _ARTIFACT_ID, "artifact_id", batch_id)


def stream_tagging(
    spark: SparkSession, inbox: str, root: str, tags: list[Tag], files_per_batch: int = 1000
) -> StreamingQuery:
    """Start a query that tags the run files in ``inbox``; another catalog starts over."""
    return _tag_files(spark, inbox, RUNS, tag_batch, root, tags, "runs", files_per_batch)


def stream_artifact_tagging(
    spark: SparkSession, inbox: str, root: str, tags: list[Tag], files_per_batch: int = 1000
) -> StreamingQuery:
    """The same for artifact files; it may run beside the query over runs under one root."""
    return _tag_files(
        spark, inbox, ARTIFACTS, tag_artifact_batch, root, tags, "artifacts", files_per_batch
    )


def _tag_files(spark, inbox, schema, tag, root, tags, name, files_per_batch) -> StreamingQuery:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)

    def apply(batch: DataFrame, batch_id: int) -> None:
        tag(batch, batch_id, root, tags)

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{root}/{fingerprint(tags)}/_progress/{name}")
        .trigger(availableNow=True)
        .start()
    )


def ingested_jobs(spark: SparkSession, root: str) -> DataFrame:
    return _every(spark, f"{root}/jobs", JOBS, "job_id")


def ingested_builds(spark: SparkSession, root: str) -> DataFrame:
    return _every(spark, f"{root}/builds", BUILDS, "build_id")


def ingested_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs").select(*RUNS.names)


def tagged_issues(spark: SparkSession, root: str, tags: list[Tag]) -> DataFrame:
    return spark.read.parquet(f"{root}/{fingerprint(tags)}/issues").select(*ISSUES.names)


def replay_ingest(
    payload: DataFrame, details: DataFrame, blocklist: list[str], last_n: int, files: int = 3
) -> DataFrame:
    """Write snapshots as files, let the stream take them in, return the stored runs."""
    spark = payload.sparkSession
    path = scratch_path(spark, "ingest")
    payload.repartition(files).write.json(f"{path}/inbox")
    stream_ingest(
        spark, f"{path}/inbox", f"{path}/store", details, blocklist, last_n, files_per_batch=1
    ).awaitTermination()
    return ingested_runs(spark, f"{path}/store")


def replay_tagging(runs: DataFrame, artifacts: DataFrame, tags: list[Tag]) -> DataFrame:
    """Write runs and artifacts as files, let the streams tag them, return the stored issues."""
    spark = runs.sparkSession
    path = scratch_path(spark, "tagging")
    for rows, name, stream in (
        (runs, "runs", stream_tagging),
        (artifacts, "artifacts", stream_artifact_tagging),
    ):
        rows.write.parquet(f"{path}/{name}")
        stream(spark, f"{path}/{name}", f"{path}/store", tags, files_per_batch=4).awaitTermination()
    return tagged_issues(spark, f"{path}/store", tags)
