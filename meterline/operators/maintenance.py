"""Changes to the ledger as queries over immutable facts: upserts, merges, remaps, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def unseen(new: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    return new.join(known.select(key), key, "left_anti")


def conflicts(new: DataFrame, known: DataFrame, *content: str) -> DataFrame:
    """Keys whose content differs from what is known of them: replay is allowed, change is an error."""
    own = new.select("event_id", content_hash(*content).alias("new_hash"))
    return own.join(known.select("event_id", content_hash(*content).alias("known_hash")), "event_id").where("new_hash <> known_hash")


def merged_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Threads of both: new values over old where there are any, the earliest creation, the latest update.

    A thread that the new snapshot lacks stays, as not present.
    """
    both = old.alias("o").join(new.alias("n"), "thread_id", "full_outer")
    return both.select(
        "thread_id",
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("parent_thread_id", "depth", "project_id")],
        F.least("n.created_at", "o.created_at").alias("created_at"),
        F.greatest("n.updated_at", "o.updated_at").alias("updated_at"),
        F.col("n.thread_id").isNotNull().alias("present"),
    )


def remapped(facts: DataFrame, aliases: DataFrame, column: str = "account") -> DataFrame:
    """facts with provisional accounts replaced by their canonical ones; no sum changes."""
    own = aliases.select(F.col("provisional").alias(column), "canonical")
    return facts.join(own, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def reprojected(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """facts with the catalog's project of their thread, where it has the thread."""
    own = catalog.select("thread_id", F.col("project_id").alias("_project"), F.lit(True).alias("_known"))
    return facts.join(own, "thread_id", "left").withColumn("project_id", F.when(F.col("_known"), F.col("_project")).otherwise(F.col("project_id"))).drop("_project", "_known")


def compacted(facts: DataFrame, before: str) -> tuple[DataFrame, DataFrame]:
    """(facts that stay, keys with content hash of those that go) at a local day; their sums are in the day cube."""
    return facts.where(F.col("local_day") >= before), facts.where(F.col("local_day") < before).select("event_id", content_hash("event_id", "thread_id", "account", "total").alias("content_hash"))


def without_repeats(rows: DataFrame, key: str, payload: str, *order: str) -> DataFrame:
    """Rows whose payload differs from the row before them."""
    before = F.lag(payload).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(f"not (_before <=> {payload})").drop("_before")


def upserted(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of both, of each key the one written last; of two written at once the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by_key(both, key, at, "_new").drop("_new")


def capped_coverage(facts: DataFrame) -> DataFrame:
    """facts whose observed cache writes are no more than their input."""
    return facts.withColumn("cache_write_observed", F.least("cache_write_observed", "input"))


def oldest(facts: DataFrame, before: str, limit: int) -> DataFrame:
    """The facts that compaction takes next: those before a local day, oldest first, `limit` at most."""
    return facts.where(F.col("local_day") < before).orderBy("source_timestamp", "event_id").limit(limit)


def assigned(changes: DataFrame) -> DataFrame:
    """(thread_id, project_id, assigned_at): each thread's last assignment by hand; one without a project takes it back."""
    last = changes.groupBy("thread_id").agg(F.max_by(F.struct("project_id", "assigned_at"), F.struct("assigned_at", "event_id")).alias("a"))
    return last.select("thread_id", "a.*").where("project_id is not null")
