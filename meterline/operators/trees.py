"""Forests of threads, by pointer doubling: after n rounds a thread knows its ancestor 2^n levels up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import settle
from .slots import hour_slot

MOST_LEVELS = 32


def roots(catalog: DataFrame, levels: int | None = MOST_LEVELS) -> DataFrame:
    """(thread_id, root_id, relative_depth) of threads in a tree of at most so many levels below its root.

    A root has no parent. Threads below a missing parent or on a cycle are in no tree. The rounds end when no thread
    has anything above it left, or as many as in the round before, as those of cycles do. Each round is one self-join, so
    that a forest takes log2(depth) shuffles.
    """
    up = settle(catalog.select("thread_id", F.coalesce("parent_thread_id", "thread_id").alias("up"), F.col("parent_thread_id").isNotNull().cast("int").alias("steps")))
    top = catalog.where("parent_thread_id is null").select(F.col("thread_id").alias("root_id"))
    left, reach = None, 1
    while levels is None or reach < levels:
        above = up.select(F.col("thread_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        lifted = settle(up.join(above, "up").select("thread_id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "more"))
        up = lifted.drop("more")
        reach *= 2
        now = lifted.where("more > 0").count()  # falls in each round while there is a tree so deep
        if now in (0, left):
            break
        left = now
    found = up.join(top, up.up == top.root_id).select("thread_id", "root_id", F.col("steps").alias("relative_depth"))
    return found.where(F.col("relative_depth") <= levels) if levels is not None else found


def standalone(catalog: DataFrame) -> DataFrame:
    """(thread_id, root_id) of all members of trees whose root is a native thread at depth 0 without a project."""
    own = catalog.where("parent_thread_id is null and coalesce(depth, 0) = 0 and project_id is null and source_kind = 'native'").select(F.col("thread_id").alias("root_id"))
    return roots(catalog, None).join(own, "root_id", "left_semi").select("thread_id", "root_id")


def ancestors(catalog: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """(thread_id, ancestor_id, distance) of each thread with itself and all threads above it, each pair once."""
    pairs = settle(catalog.select("thread_id", F.col("thread_id").alias("ancestor_id"), F.lit(0).alias("distance")))
    step = catalog.where("parent_thread_id is not null").select(F.col("thread_id").alias("ancestor_id"), F.col("parent_thread_id").alias("up"))
    step = settle(step.join(catalog.select(F.col("thread_id").alias("up")), "up", "left_semi").select("ancestor_id", "up"))
    reach = 1
    while reach <= levels:
        lifted = pairs.join(step, "ancestor_id").select("thread_id", F.col("up").alias("ancestor_id"), (F.col("distance") + F.lit(reach)).alias("distance"))
        pairs = settle(pairs.unionByName(lifted))
        above = step.select(F.col("ancestor_id").alias("up"), F.col("up").alias("next"))
        step = settle(step.join(above, "up").select("ancestor_id", F.col("next").alias("up")))
        reach *= 2
        if step.isEmpty():
            break
    return pairs.where(F.col("distance") <= levels).groupBy("thread_id", "ancestor_id").agg(F.min("distance").alias("distance"))


def preorder(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """(thread_id, root_id, relative_depth, subtree_size, position) of all threads in trees, as members has them.

    position numbers a tree from 0 so that a thread comes before all below it, and siblings, the latest first, with all
    that is below each. It is the sum, over a thread and all above it, of what comes before among siblings: no walk. Sizes
    before a sibling are added up within the hour of its time, and over a parent's hours.
    """
    tree = catalog.join(members, "thread_id").select("thread_id", "parent_thread_id", "updated_at", "root_id", "relative_depth")
    tree = settle(tree)
    pairs = settle(ancestors(tree))
    sized = tree.join(pairs.groupBy(F.col("ancestor_id").alias("thread_id")).agg(F.count("*").alias("subtree_size")), "thread_id").withColumn("_slot", hour_slot("updated_at"))
    before = Window.partitionBy("parent_thread_id", "_slot").orderBy(F.desc("updated_at"), "thread_id").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("parent_thread_id").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    below = settle(sized.withColumn("_before", F.coalesce(F.sum("subtree_size").over(before), F.lit(0))))
    hours = below.where("parent_thread_id is not null").groupBy("parent_thread_id", "_slot").agg(F.sum("subtree_size").alias("_n"))
    hours = hours.select(F.col("parent_thread_id").alias("_parent"), F.col("_slot").alias("_hour"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    same = (below.parent_thread_id == hours["_parent"]) & below["_slot"].eqNullSafe(hours["_hour"])
    steps = below.join(hours, same, "left").select(F.col("thread_id").alias("ancestor_id"), F.when(F.col("parent_thread_id").isNull(), 0).otherwise(1 + F.col("_before") + F.col("_later")).alias("step"))
    position = pairs.join(steps, "ancestor_id").groupBy("thread_id").agg(F.sum("step").cast("bigint").alias("position"))
    return below.join(position, "thread_id").select("thread_id", "root_id", "relative_depth", "subtree_size", "position")


def descendants(catalog: DataFrame, thread_id: str, levels: int = MOST_LEVELS) -> DataFrame:
    """(thread_id, relative_depth) of all threads below one, by levels; each level is a join with the last one's few rows."""
    below = catalog.where(F.col("parent_thread_id") == thread_id).select("thread_id", F.lit(1).alias("relative_depth"))
    found = below = settle(below)
    for level in range(2, levels + 1):
        if below.isEmpty():
            break
        near = below.select(F.col("thread_id").alias("parent_thread_id"))
        below = settle(catalog.join(near, "parent_thread_id", "left_semi").select("thread_id", F.lit(level).alias("relative_depth")))
        found = found.unionByName(below)
    return found.groupBy("thread_id").agg(F.min("relative_depth").alias("relative_depth"))
