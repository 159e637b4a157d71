"""Report tables: what a page about jobs, builds and runs shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.labels import (
    format_label,
    is_bad,
    severity_class,
    status_class,
    status_label,
    status_order,
    time_label,
)
from buildlens.functions.text import blob_format
from buildlens.operators.tagging import not_metadata


def job_builds(jobs: DataFrame, builds: DataFrame) -> DataFrame:
    """Builds of every job with the newest flagged; a job without builds keeps one row.

    The newest build comes from a combined maximum, not from ranking each job's builds in one task,
    and the builds are the side of an inner join that Spark may split when one job holds most.
    """
    # Of builds with equal numbers the first one is the newest.
    place = F.struct("number", (-F.col("build_id")).alias("turn"), "build_id")
    newest = builds.groupBy("job_id").agg(F.max(place)["build_id"].alias("newest"))
    named = jobs.select("job_id", "name").join(newest, "job_id", "left")
    listed = builds.select("job_id", "build_id", "number", "status").join(named, "job_id")
    without = named.filter(F.col("newest").isNull())
    rows = listed.unionByName(without, allowMissingColumns=True)
    latest = F.coalesce(F.col("build_id") == F.col("newest"), F.lit(False))
    has_build = F.col("build_id").isNotNull()
    return rows.select(
        "job_id",
        "name",
        "build_id",
        "number",
        latest.alias("is_latest"),
        (latest & is_bad(F.col("status"))).alias("is_open"),
        F.when(has_build, status_label(F.col("status"))).alias("status_label"),
    )


def job_builds_sorted(job_builds: DataFrame) -> DataFrame:
    return job_builds.orderBy("job_id", F.desc_nulls_last("number"))


def build_runs(runs: DataFrame) -> DataFrame:
    """Runs with their place inside the build: worst status first, then run id."""
    return runs.select(
        "build_id",
        "run_id",
        "display_name",
        status_order(F.col("status")).alias("place"),
        status_label(F.col("status")).alias("status_label"),
        status_class(F.col("status")).alias("status_class"),
    )


def build_runs_sorted(build_runs: DataFrame) -> DataFrame:
    return build_runs.orderBy("build_id", "place", "run_id")


def run_tags(runs: DataFrame, issues: DataFrame, tags: DataFrame) -> DataFrame:
    """(run_id, tag) without repeats; a run without tags shows as untagged."""
    held = issues.select("run_id", "tag_id").distinct().join(tags.select("tag_id", "name"), "tag_id")
    return (
        runs.select("run_id")
        .join(held.select("run_id", "name"), "run_id", "left")
        .select("run_id", F.coalesce("name", F.lit("untagged!")).alias("tag"))
    )


def run_issue_panel(runs: DataFrame, issues: DataFrame, tags: DataFrame) -> DataFrame:
    """Snippets of every run with their extra occurrences; bad runs without any are unknown."""
    shown = not_metadata(issues, tags).select("run_id", "name", "severity", "snippet", "duplicates")
    status = runs.select("run_id", "status")
    known = shown.join(status, "run_id").withColumn("unknown", F.lit(False))
    unknown = (
        status.filter(is_bad(F.col("status")))
        .join(shown.select("run_id").distinct(), "run_id", "left_anti")
        .withColumn("unknown", F.lit(True))
    )
    return known.unionByName(unknown, allowMissingColumns=True).select(
        "run_id",
        status_class(F.col("status")).alias("status_class"),
        F.col("name").alias("tag"),
        severity_class(F.col("severity")).alias("severity_class"),
        "snippet",
        "duplicates",
        "unknown",
    )


def run_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Path and display form of the artifacts of every run."""
    shown = artifacts.select(
        "run_id", "artifact_id", "path", blob_format(F.col("contents")).alias("format")
    )
    return (
        runs.select("run_id")
        .join(shown, "run_id")
        .select("run_id", "artifact_id", "path", "format", format_label(F.col("format")).alias("shown_as"))
    )


def run_links(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Add display name and url to a table of run ids."""
    return ids.join(runs.select("run_id", "display_name", "url"), "run_id")


def build_time_labels(builds: DataFrame, utc_offset_hours: int) -> DataFrame:
    return builds.select(
        "build_id", "ts_ms", time_label(F.col("ts_ms"), utc_offset_hours).alias("label")
    )
