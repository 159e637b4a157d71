"""From project snapshots to job, build and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions.labels import is_bad
from buildlens.schemas import PAYLOAD


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots as JSON, one per line; fields the schema does not name are not read."""
    return with_file(spark.read.schema(PAYLOAD).json(path))


def with_file(payload: DataFrame) -> DataFrame:
    """Snapshots read from files, with ``file``: time, name and part of the file."""
    at = [f"_metadata.{c}" for c in ("file_modification_time", "file_path", "file_block_start")]
    return payload.select("*", F.struct(*at).alias("file"))


def _arrival(df: DataFrame) -> list[str]:
    return ["arrived"] if "arrived" in df.columns else []


def payload_jobs(payload: DataFrame) -> DataFrame:
    """(name, url, builds): one row per job and snapshot.

    Snapshots read from files give ``arrived`` too, their order by file and line: rows of a part of
    a file keep their order in its partition.
    """
    if "file" in payload.columns:
        line = F.monotonically_increasing_id().alias("line")
        payload = payload.select("jobs", F.struct("file.*", line).alias("arrived"))
    return payload.select(F.inline("jobs"), *_arrival(payload))


def last_report(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one that arrived last, among equals the highest ``order``, then row."""
    names = [c for c in df.columns if c not in (key, "arrived")]
    rank = F.struct(*_arrival(df), order, *names)
    return df.groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("row")).select(key, "row.*")


def kept_jobs(jobs: DataFrame, blocklist: list[str]) -> DataFrame:
    """Jobs with builds whose name is not on the list."""
    kept = jobs.filter(F.size("builds") > 0)
    return kept.filter(~F.col("name").isin(*blocklist)) if blocklist else kept


def job_rows(jobs: DataFrame, last_n: int) -> DataFrame:
    """(name, url, retention_floor): the number of the oldest build that is kept, null without builds."""
    kept = F.slice("builds", 1, last_n)
    floor = F.try_element_at(kept, F.lit(-1))["number"].alias("retention_floor")
    return jobs.select("name", "url", floor, *_arrival(jobs))


def build_rows(jobs: DataFrame, last_n: int | None = None) -> DataFrame:
    """(job_name, number, url, status, ts_ms, runs) of the first ``last_n`` builds as listed, or all."""
    kept = F.col("builds") if last_n is None else F.slice("builds", 1, last_n)
    return jobs.select(F.col("name").alias("job_name"), F.inline(kept), *_arrival(jobs)).select(
        "job_name",
        "number",
        "url",
        F.col("result").alias("status"),
        F.col("timestamp").alias("ts_ms"),
        "runs",
        *_arrival(jobs),
    )


def own_runs(builds: DataFrame) -> DataFrame:
    """(build_url, url): the listed runs that carry their build's own number."""
    listed = builds.select(
        F.col("url").alias("build_url"), "number", F.explode("runs").alias("run"), *_arrival(builds)
    )
    own = listed.filter(F.col("run.number") == F.col("number"))
    return own.select("build_url", "run.url", *_arrival(builds))


def new_runs(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed runs whose url is not stored yet."""
    return listed.join(stored.select("url"), "url", "left_anti")


def cached_runs(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored runs that are listed again."""
    return stored.join(listed.select("url"), "url", "left_semi")


def run_rows(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Run rows with the server's details, one row per url; only bad runs keep their log."""
    status = F.col("status")
    return listed.join(details, "url").select(
        "url",
        "status",
        F.coalesce("full_display_name", "display_name").alias("display_name"),
        F.when(is_bad(status), F.col("log")).alias("log"),
        F.lit(None).cast("string").alias("tag_schema"),
        "build_url",
    )


def newest_builds(builds: DataFrame, last_n: int) -> DataFrame:
    """The ``last_n`` highest-numbered builds per job of a flat build table.

    Spark limits each job's builds before the shuffle, so a job may hold any share of them.
    """
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("number")))
    return builds.withColumn("rn", rank).filter(F.col("rn") <= last_n).drop("rn")


def retention_floors(builds: DataFrame, last_n: int) -> DataFrame:
    """(job_id, retention_floor) of a flat build table."""
    return newest_builds(builds, last_n).groupBy("job_id").agg(F.min("number").alias("retention_floor"))
