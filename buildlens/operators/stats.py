"""Latest build of every job and the statistics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.labels import is_bad
from buildlens.operators.tagging import not_metadata
from buildlens.schemas import STATUSES


def latest_builds(builds: DataFrame) -> DataFrame:
    """(job_id, build_id, number, status) of the highest build number; a job whose highest is 0 has none.

    The status travels as its number: with fixed-width values Spark aggregates by hash, not by sort.
    """
    names = F.array(*[F.lit(s) for s in STATUSES])
    code = F.array_position(names, F.col("status")).cast("int")
    return (
        builds.groupBy("job_id")
        .agg(
            F.max_by("build_id", "number").alias("build_id"),
            F.max_by(F.nullif(code, F.lit(0)), F.col("number")).alias("code"),
            F.max("number").alias("number"),
        )
        .filter(F.col("number") != 0)
        .select("job_id", "build_id", "number", F.get(names, F.col("code") - 1).alias("status"))
    )


def latest_runs(runs: DataFrame, builds: DataFrame) -> DataFrame:
    """Runs of the latest builds."""
    return runs.join(latest_builds(builds).select("build_id"), "build_id", "left_semi")


def runs_by_status(runs: DataFrame, builds: DataFrame) -> DataFrame:
    """(status, run_id) of the latest builds; runs without a status are in no bucket."""
    return latest_runs(runs, builds).filter(F.col("status").isNotNull()).select("status", "run_id")


def status_counts(runs: DataFrame, builds: DataFrame) -> DataFrame:
    return runs_by_status(runs, builds).groupBy("status").agg(F.count(F.lit(1)).alias("n_runs"))


def job_health(jobs: DataFrame, builds: DataFrame) -> DataFrame:
    """Jobs whose latest build succeeded, all jobs, and their ratio, in one row."""
    last = latest_builds(builds).select("job_id", F.col("status").alias("last_status"))
    counted = jobs.select("job_id").join(last, "job_id", "left")
    good = F.count_if(F.col("last_status") == "SUCCESS")
    return counted.agg(
        good.alias("successful_jobs"),
        F.count(F.lit(1)).alias("total_jobs"),
        F.try_divide(good, F.count(F.lit(1))).alias("health"),
    )


def run_totals(runs: DataFrame, builds: DataFrame) -> DataFrame:
    """Runs of the latest builds with a status, per status and together."""
    status = F.col("status")
    return latest_runs(runs, builds).agg(
        F.count_if(status == "FAILURE").alias("failures"),
        F.count_if(status == "UNSTABLE").alias("unstable"),
        F.count_if(status == "SUCCESS").alias("successful"),
        F.count_if(status == "ABORTED").alias("aborted"),
        F.count_if(status == "NOT_BUILT").alias("not_built"),
        F.count(status).alias("total_runs"),
    )


def issues_found(issues: DataFrame, tags: DataFrame, runs: DataFrame, builds: DataFrame) -> DataFrame:
    """Issues other than Metadata in the latest builds; extra occurrences do not count.

    Only run_id and tag_id of the issues are used: snippets without spans will do.
    """
    latest = latest_runs(runs, builds).select("run_id")
    found = not_metadata(issues, tags).join(latest, "run_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("issues_found"))


def unknown_runs(issues: DataFrame, tags: DataFrame, runs: DataFrame, builds: DataFrame) -> DataFrame:
    """Bad runs of the latest builds without any issue other than Metadata.

    Only run_id and tag_id of the issues are used: hits will do, as no tag matches the empty text.
    """
    bad = latest_runs(runs, builds).filter(is_bad(F.col("status"))).select("run_id", "status")
    known = not_metadata(issues, tags).select("run_id").distinct()
    return bad.join(known, "run_id", "left_anti")


def deployment_totals(
    builds: DataFrame, issues: DataFrame, tags: DataFrame, members: DataFrame
) -> DataFrame:
    """Builds analyzed, issues, distinct snippets and similarity groups, as (metric, value).

    The issues are read once for both of their figures.
    """
    count = F.count(F.lit(1))
    metrics = lambda df, **values: df.agg(*[v.alias(n) for n, v in values.items()]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values]))
    )
    found = metrics(not_metadata(issues, tags), identified_issues=count, unique_issues=F.countDistinct("snippet"))
    return (
        found.unionByName(metrics(builds, builds_analyzed=count))
        .unionByName(metrics(members, similarity_groupings=F.countDistinct("group_id")))
    )
