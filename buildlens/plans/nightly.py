"""The nightly run: snapshot in, store out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.catalog import Config, check_tags, fingerprint, tags_df
from buildlens.functions.ids import assign_ids
from buildlens.operators import artifacts as art, ingest, similarity, store as st, tagging
from buildlens.session import cut_lineage, scratch_scope
from buildlens.sources.tables import APPENDED, alive, append, appended, publish, published, run_state

Store = dict[str, DataFrame]


def _with_ids(store: Store, config: Config) -> tuple[Store, list]:
    """Put the configured tags into the store and give them their stored ids."""
    spark = store["jobs"].sparkSession
    check_tags(spark, config.tags)
    change = tags_df(spark, config.tags).drop("tag_id")
    store = {**store, "tags": st.upsert_tags(store["tags"], change)}
    ids = {row["name"]: row["tag_id"] for row in store["tags"].select("name", "tag_id").collect()}
    return store, [replace(t, tag_id=ids[t.name]) for t in config.tags]


def take_in(
    store: Store,
    payload: DataFrame,
    details: DataFrame,
    artifacts: DataFrame,
    config: Config,
    root: str,
    night: int,
) -> Store:
    """Upsert the snapshot's jobs and builds; append new runs and their artifacts (url, path, contents).

    Where a key is listed more than once, the last report counts. A night without new runs writes
    neither runs nor artifacts, except the first, which lays down the tables.
    """
    spark = store["jobs"].sparkSession
    jobs = ingest.kept_jobs(ingest.payload_jobs(payload), config.blocklist)
    change = ingest.last_report(ingest.job_rows(jobs, config.last_n_history), "name", "retention_floor")
    new_jobs = cut_lineage(st.upsert_jobs(store["jobs"], change))
    job_ids = new_jobs.select(F.col("name").alias("job_name"), "job_id")
    listed = ingest.build_rows(jobs, config.last_n_history)
    change = listed.drop("runs").join(job_ids, "job_name").drop("job_name")
    builds = cut_lineage(st.upsert_builds(store["builds"], ingest.last_report(change, "url", "ts_ms")))
    store = {**store, "jobs": new_jobs, "builds": builds}

    own = ingest.last_report(ingest.own_runs(listed), "url", "build_url")
    fresh = cut_lineage(ingest.new_runs(own, store["runs"]))
    if fresh.isEmpty() and published(spark, root) is not None:
        return store
    build_ids = builds.select(F.col("url").alias("build_url"), "build_id")
    rows = ingest.run_rows(fresh, details).join(build_ids, "build_url").drop("build_url")
    append(assign_ids(rows, "url", "run_id", after=store["runs"].agg(F.max("run_id"))), root, "runs", night)
    tonight = F.col("night") == night
    added = appended(spark, root, "runs", tonight)
    wanted = art.matching_artifacts(artifacts, config.artifact_rules).join(
        added.select("url", "run_id"), "url"
    )
    keyed = wanted.withColumn("key", F.concat_ws("/", "url", "path"))
    top = store["artifacts"].agg(F.max("artifact_id"))
    append(assign_ids(keyed, "key", "artifact_id", after=top), root, "artifacts", night)
    added = added.withColumns({"tag_schema": F.lit(None).cast("string"), "tagged": F.lit(None).cast("long")})
    return {**store, "runs": store["runs"].unionByName(added)}


def nightly(
    store: Store,
    payload: DataFrame,
    details: DataFrame,
    artifacts: DataFrame,
    config: Config,
    root: str,
    night: int,
) -> Store:
    """One night: new runs, artifacts and issues are appended under ``root``, changed tables written, then published.

    ``store`` is the store of the night before, or an empty one. Runs are tagged once per catalog, and only
    the issues found tonight are written; those of dead runs and of older catalogs are passed over by
    readers. Without a run to tag nothing is purged by retention, and unless the blocklist took runs, the
    groups stay as they are stored. What the night writes in between is deleted at its end.
    """
    with scratch_scope(store["jobs"].sparkSession):
        return _nightly(store, payload, details, artifacts, config, root, night)


def _nightly(
    store: Store,
    payload: DataFrame,
    details: DataFrame,
    artifacts: DataFrame,
    config: Config,
    root: str,
    night: int,
) -> Store:
    spark = store["jobs"].sparkSession
    before = store["runs"].select("run_id")
    first = published(spark, root) is None
    store, tags = _with_ids(store, config)
    schema = fingerprint(tags)
    store = st.purge_blocklist(st.invalidate(store, schema), config.blocklist)
    store = take_in(store, payload, details, artifacts, config, root, night)
    small = {name: store[name] for name in ("jobs", "builds", "tags")}
    todo = tagging.untagged_runs(store["runs"])
    if todo.isEmpty():
        if first:
            append(store["issues"], root, "issues", night)
        gone = before.join(store["runs"].select("run_id"), "run_id", "left_anti")
        if first or not gone.isEmpty():
            small["similarities"] = store["similarities"]
            small["run_state"] = run_state(store["runs"])
        return publish(spark, small, root, night)

    # The artifacts of the runs to tag, read from the nights of these runs only.
    texts = alive(appended(spark, root, "artifacts", F.col("night") <= night), todo).drop("night")
    append(tagging.all_issues(todo, texts, tags), root, "issues", night)
    fresh = appended(spark, root, "issues", F.col("night") == night).select(*APPENDED["issues"].names)
    done = store["runs"].filter("tag_schema is not null").select("run_id")
    issues = store["issues"].join(done, "run_id", "left_semi").select(*fresh.columns).unionByName(fresh)
    tagged = F.when(F.col("tag_schema").isNull(), F.lit(night).cast("long")).otherwise(F.col("tagged"))
    runs = tagging.stamp(store["runs"].withColumn("tagged", tagged), schema)
    # Groups go before they are rebuilt, so the purge need not look at them.
    store = {**store, "issues": issues, "runs": runs, "similarities": store["similarities"].limit(0)}
    store = st.purge_retention(store)
    shown = cut_lineage(tagging.not_metadata(store["issues"], store["tags"]).select("issue_id", "tag_id", "snippet"))
    changed = {
        "jobs": store["jobs"],
        "builds": store["builds"],
        "tags": st.purge_orphan_tags(store["tags"], store["issues"]),
        "similarities": similarity.group_members(shown, config.threshold),
        "run_state": run_state(store["runs"]),
    }
    return publish(spark, changed, root, night)
