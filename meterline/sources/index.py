"""The index of threads that a session tool keeps: snapshots of differing schemas as one catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import git_identity
from ..operators.attribution import evidence_of_roots, longest_root, resolved_project
from ..operators.checkpoint import settle

#: What an index can say of a thread; only the id is in all of them.
FIELDS = (
    "id", "rollout_path", "source", "model", "cwd", "project_id", "parent_thread_id", "git_origin", "title", "updated_at", "name", "agent_nickname",
    "agent_role", "agent_path", "thread_source", "created_at", "created_at_ms", "updated_at_ms", "archived", "has_user_event",
)
SPAWNED = "$.subagent.thread_spawn"
SPAWN = f"{SPAWNED}.parent_thread_id"
#: The greatest depth that is one, and milliseconds of the years that times can have.
MOST_DEPTH, LEAST_MILLIS, MOST_MILLIS = 4294967295, -62_135_596_800_000, 253_402_300_799_999


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Snapshots of JSON lines as one column of variants; lines that aren't JSON objects with an id are left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("row")).where(F.try_variant_get("row", "$.id", "string").isNotNull())


def as_variants(snapshot: DataFrame) -> DataFrame:
    """A snapshot with any columns as one column of variants."""
    return snapshot.select(F.to_variant_object(F.struct(*snapshot.columns)).alias("row"))


def united(*snapshots: DataFrame) -> DataFrame:
    """(thread_id, fields) of all snapshots, tables or variants; what one lacks is null, and an empty text is none.

    The parent is the column's, or that of a sub-agent's source, which is JSON. Other sources are plain words.
    """
    rows = reduce(DataFrame.unionByName, [s if s.columns == ["row"] else as_variants(s) for s in snapshots])
    field = lambda f: F.nullif(F.try_variant_get("row", f"$.{f}", "string"), F.lit(""))
    out = rows.select(*[field(f).alias(f) for f in FIELDS])
    spawned = F.try_variant_get(F.try_parse_json("source"), SPAWN, "string")
    return out.withColumn("parent_thread_id", F.coalesce("parent_thread_id", spawned)).withColumnRenamed("id", "thread_id")


def resolved(index: DataFrame, roots: DataFrame) -> DataFrame:
    """index with project, method and confidence: its own project, else that of the longest root above its folder."""
    found = longest_root(index, roots)
    rows = index.join(found, "thread_id", "left")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({c: none for c in ("manual_project", "git_project", "parent_project")})
    return rows.select("*", *resolved_project()).drop("manual_project", "root_project", "git_project", "parent_project")


def catalog(index: DataFrame, projects: DataFrame, roots: DataFrame, manual: DataFrame) -> DataFrame:
    """A row a thread of a united index: project with name, method and confidence, title, model, agent, depth, times, flags.

    projects has (project_id, project_name), roots (path, project_id), manual (thread_id, manual_project, manual_name),
    each a thread once. A project's remotes are learned: those of its own threads, and of threads in its roots. The
    order is by hand, own, longest root, remote. What a sub-agent's source says of it goes before the columns; its depth
    is 1 where nothing says more. Milliseconds go before seconds; times that are none are null, and an update without a
    time is as old as its thread. Titles of white space are none. Empty tables are fine; without threads there is no row.
    The index is settled, as five joins read it, with all that is parsed: no snapshot is read twice.
    """
    index = settle(_parsed(index))
    own = index.select("project_id", "identity").where("project_id is not null and identity is not null")
    known = own.join(projects.select("project_id"), "project_id", "left_semi")
    learned = known.unionByName(evidence_of_roots(index, roots, F.col("identity"))).groupBy("identity").agg(F.min("project_id").alias("git_project"))
    rows = index.join(learned, "identity", "left").join(longest_root(index, roots), "thread_id", "left").join(manual, "thread_id", "left")
    rows = rows.withColumn("project_id", F.col("own_project")).withColumn("parent_project", F.lit(None).cast("string"))
    rows = rows.select("*", *resolved_project())
    rows = rows.drop("project_id").join(projects.select(F.col("project_id").alias("project"), "project_name"), "project", "left")
    name = F.coalesce(F.when(F.col("method") == "manual", F.col("manual_name")), "project_name").alias("project_name")
    return rows.select("thread_id", "parent_thread_id", "project", name, "method", "confidence", "title", "model", *AGENT, "depth", "created_at", "updated_at", *FLAGS)


#: What a sub-agent's source or the columns say of it, and what is true or not of a thread.
AGENT, FLAGS = ("agent_nickname", "agent_role", "agent_path"), ("archived", "has_user_event")


def _parsed(index: DataFrame) -> DataFrame:
    """A united index with its texts as what they stand for: remotes, agents, depths, titles, times and flags."""
    rows = index.withColumn("said", F.try_variant_get(F.try_parse_json("source"), SPAWNED, "variant"))
    said = lambda what, kind="string": F.try_variant_get("said", f"$.{what}", kind)
    depth, below = said("depth", "bigint"), (F.col("thread_source") == "subagent") | F.col("said").isNotNull()
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    created, updated = _moment("created_at"), _moment("updated_at")
    return rows.select(
        "thread_id", "parent_thread_id", "cwd", "project_id", F.nullif(F.trim("project_id"), F.lit("")).alias("own_project"), git_identity("git_origin").alias("identity"),
        F.coalesce(filled("name"), filled("title")).alias("title"), "model", *[F.coalesce(said(c), F.col(c)).alias(c) for c in AGENT],
        F.coalesce(F.when(depth.between(0, MOST_DEPTH), depth), F.when(below, F.lit(1)), F.lit(0)).cast("bigint").alias("depth"),
        created.alias("created_at"), F.coalesce(updated, created).alias("updated_at"), *[F.col(c).try_cast("boolean").alias(c) for c in FLAGS],
    )


def _moment(name: str) -> Column:
    """The time of a column of milliseconds or else of one of seconds since 1970; null if neither is a time."""
    millis = F.coalesce(F.col(f"{name}_ms").try_cast("bigint"), F.try_multiply(F.col(name).try_cast("bigint"), F.lit(1000)))
    seconds = F.when(millis.between(LEAST_MILLIS, MOST_MILLIS), millis).cast("decimal(18,3)") / 1000
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
