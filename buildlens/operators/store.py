"""Old table + change set -> new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.ids import assign_ids
from buildlens.session import cut_lineage


def upsert(old: DataFrame, change: DataFrame, key: str, id_col: str, update: list[str]) -> DataFrame:
    """Insert rows with a new key, overwrite ``update`` in the others, nulls included.

    Ids and the remaining columns of stored rows stay. ``change`` has one row per key. Which keys are new
    is settled on the keys alone; the other columns are read where they are needed, once for stored and
    once for new rows, and are not written in between. Nothing here needs the old table shuffled when
    the change set is small enough for Spark to broadcast it.
    """
    keys = cut_lineage(change.select(key))
    known = cut_lineage(old.select(key).join(keys, key, "left_semi"))
    numbered = assign_ids(keys.join(known, key, "left_anti"), key, id_col, after=old.agg(F.max(id_col)))
    incoming = change.select(
        F.col(key), F.lit(True).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in update]
    )
    kept = old.join(incoming, key, "left").select(
        *[
            F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
            for c in old.columns
        ]
    )
    added = change.drop(id_col).join(numbered, key)
    return kept.unionByName(added.select(*old.columns))


def upsert_jobs(old: DataFrame, change: DataFrame) -> DataFrame:
    """Key name; only the retention floor is overwritten, the url never."""
    return upsert(old, change, "name", "job_id", ["retention_floor"])


def upsert_builds(old: DataFrame, change: DataFrame) -> DataFrame:
    """Key url; status, number, time and job are overwritten."""
    return upsert(old, change, "url", "build_id", ["status", "number", "ts_ms", "job_id"])


def upsert_runs(old: DataFrame, change: DataFrame) -> DataFrame:
    """Key url; all else is overwritten, the tag schema too: null marks the run untagged again."""
    return upsert(
        old, change, "url", "run_id", ["status", "display_name", "log", "tag_schema", "build_id"]
    )


def upsert_tags(old: DataFrame, change: DataFrame) -> DataFrame:
    """Key name; all but the id is overwritten."""
    return upsert(
        old, change, "name", "tag_id", ["ord", "desc", "pattern", "field", "severity"]
    )


def _without(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed, key, "left_anti").select(*df.columns)


def drop_groups(similarities: DataFrame, issues: DataFrame, doomed_runs: DataFrame) -> DataFrame:
    """Groups none of whose issues belongs to a doomed run."""
    lost = issues.join(doomed_runs, "run_id", "left_semi").select("issue_id")
    broken = similarities.join(lost, "issue_id", "left_semi").select("group_id").distinct()
    return _without(similarities, broken, "group_id")


def _cascade(store: dict[str, DataFrame], doomed_builds: DataFrame) -> dict[str, DataFrame]:
    """Remove the builds and all that hangs on them; a group goes with its first lost issue."""
    doomed_runs = store["runs"].join(doomed_builds, "build_id", "left_semi").select("run_id")
    return {
        **store,
        "similarities": drop_groups(store["similarities"], store["issues"], doomed_runs),
        "issues": _without(store["issues"], doomed_runs, "run_id"),
        "artifacts": _without(store["artifacts"], doomed_runs, "run_id"),
        "runs": _without(store["runs"], doomed_builds, "build_id"),
        "builds": _without(store["builds"], doomed_builds, "build_id"),
    }


def purge_blocklist(store: dict[str, DataFrame], blocklist: list[str]) -> dict[str, DataFrame]:
    """Remove jobs by name with all their data."""
    if not blocklist:
        return dict(store)
    listed = F.col("name").isin(*blocklist)
    doomed_jobs = store["jobs"].filter(listed).select("job_id")
    doomed = store["builds"].join(doomed_jobs, "job_id", "left_semi").select("build_id")
    return {**_cascade(store, doomed), "jobs": store["jobs"].filter(~listed)}


def purge_retention(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove builds below their job's retention floor; jobs stay."""
    floors = store["jobs"].select("job_id", "retention_floor")
    doomed = (
        store["builds"]
        .join(floors, "job_id")
        .filter(F.col("number") < F.col("retention_floor"))
        .select("build_id")
    )
    return _cascade(store, doomed)


def purge_orphan_tags(tags: DataFrame, issues: DataFrame) -> DataFrame:
    """Tags that have issues."""
    used = issues.select("tag_id").distinct()
    return tags.join(used, "tag_id", "left_semi").select(*tags.columns)


def invalidate(store: dict[str, DataFrame], tag_schema: str) -> dict[str, DataFrame]:
    """Forget the issues of runs tagged under another schema; untagged runs are not stale."""
    stale = F.col("tag_schema") != tag_schema
    stale_runs = store["runs"].filter(stale).select("run_id")
    reset = F.when(stale, F.lit(None)).otherwise(F.col("tag_schema"))
    return {
        **store,
        "similarities": drop_groups(store["similarities"], store["issues"], stale_runs),
        "issues": _without(store["issues"], stale_runs, "run_id"),
        "runs": store["runs"].withColumn("tag_schema", reset),
    }
