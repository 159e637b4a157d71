"""Reading tables, and a store that grows by what each night adds.

Under the root of a store, ``runs``, ``artifacts`` and ``issues`` hold one folder per night that brought
new ones; logs, contents and issues are never written again. The other tables have a folder per night
that changed them. Among these is ``run_state``: the runs that are alive, the night they came, the catalog
they were tagged with and the night of that. Readers merge: an issue counts if its run's state names the
night it was written in. ``published`` holds, per night, which folder of each table belongs to it and is
written last, so a night that fails half-way is not seen by readers and is simply repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.schemas import RUNS, TABLES

NIGHT = T.StructField("night", T.LongType())
# The night in which a run was tagged, null while it is not.
TAGGED = T.StructField("tagged", T.LongType())
STORED_RUNS = T.StructType([*RUNS.fields, NIGHT, TAGGED])
RUN_STATE = T.StructType([RUNS["run_id"], NIGHT, RUNS["tag_schema"], TAGGED])
APPENDED = {
    "runs": T.StructType([f for f in RUNS.fields if f.name != "tag_schema"]),
    "artifacts": TABLES["artifacts"],
    "issues": TABLES["issues"],
}
REPLACED = {**{n: s for n, s in TABLES.items() if n not in APPENDED}, "run_state": RUN_STATE}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        name: spark.createDataFrame([], schema)
        for name, schema in {**TABLES, "runs": STORED_RUNS}.items()
    }


def append(df: DataFrame, root: str, name: str, night: int) -> None:
    """Write the new rows of a night; a night that is repeated replaces only its own rows."""
    df.select(*APPENDED[name].names).write.mode("overwrite").parquet(f"{root}/{name}/night={night}")


def appended(spark: SparkSession, root: str, name: str, nights: Column) -> DataFrame:
    """Appended rows, dead ones too, of the nights that meet a condition on ``night``."""
    schema = T.StructType([*APPENDED[name].fields, NIGHT])
    return spark.read.schema(schema).parquet(f"{root}/{name}").filter(nights)


def run_state(runs: DataFrame) -> DataFrame:
    return runs.select(*RUN_STATE.names)


def alive(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Appended rows whose run is in ``state``; few nights in a small ``state`` prune the others' files."""
    return rows.join(state.select("run_id", "night"), ["run_id", "night"], "left_semi")


def live_issues(issues: DataFrame, state: DataFrame) -> DataFrame:
    """Appended issues whose run is alive and was last tagged in the night that wrote them."""
    tagged = state.filter("tag_schema is not null").select("run_id", F.col("tagged").alias("night"))
    return issues.join(tagged, ["run_id", "night"], "left_semi").select(*APPENDED["issues"].names)


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """(night, name, version) of all nights, None before the first."""
    try:
        return spark.read.schema("name string, version long, night long").parquet(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, night: int
) -> dict[str, DataFrame]:
    """Write changed tables of a night, then what belongs to it, and read the store back.

    Tables that are not given stay those of the last night before.
    """
    for name, df in tables.items():
        df.select(*REPLACED[name].names).write.mode("overwrite").parquet(f"{root}/{name}/v={night}")
    versions = _versions(spark, root, F.col("night") < night) | dict.fromkeys(tables, night)
    manifest = spark.createDataFrame(sorted(versions.items()), "name string, version long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/published/night={night}")
    return read_store(spark, root, night)


def _versions(spark: SparkSession, root: str, nights: Column) -> dict[str, int]:
    """Folder of each replaced table at the last of the nights that meet a condition."""
    every = published(spark, root)
    if every is None:
        return {}
    last = every.filter(nights).groupBy("name").agg(F.max_by("version", "night").alias("version"))
    return {row["name"]: row["version"] for row in last.collect()}


def read_store(spark: SparkSession, root: str, night: int | None = None) -> dict[str, DataFrame]:
    """The store as a published night left it, the last one by default."""
    every = published(spark, root)
    if every is not None and night is None:
        night = every.agg(F.max("night")).first()[0]
    if every is None or every.filter(F.col("night") == night).isEmpty():
        raise ValueError(f"no published night under {root}")
    versions = _versions(spark, root, F.col("night") <= night)
    tables = {
        name: spark.read.schema(schema).parquet(f"{root}/{name}/v={versions[name]}")
        for name, schema in REPLACED.items()
    }
    state = tables.pop("run_state")
    till = F.col("night") <= night
    runs = appended(spark, root, "runs", till).join(state, ["run_id", "night"])
    return {
        **tables,
        "runs": runs.select(*STORED_RUNS.names),
        "artifacts": alive(appended(spark, root, "artifacts", till), state).drop("night"),
        "issues": live_issues(appended(spark, root, "issues", till), state),
    }


def compact(spark: SparkSession, root: str, night: int) -> dict[str, DataFrame]:
    """Rewrite what is alive as the rows of one new night; folders of older nights may then go."""
    store = read_store(spark, root)
    append(store["runs"], root, "runs", night)
    append(store["artifacts"], root, "artifacts", night)
    append(store["issues"], root, "issues", night)
    now = F.lit(night).cast("long")
    state = run_state(store["runs"]).withColumns({"night": now, "tagged": F.when(F.col("tagged").isNotNull(), now)})
    return publish(spark, {"run_state": state}, root, night)
