"""One source of evidence for each thread and day, never the sum of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selection(sampled_days: DataFrame, reconstructed_days: DataFrame) -> DataFrame:
    """(local_day, thread_id, source, sampling_tokens, reconstruction_tokens): the larger source; a tie is sampling's."""

    def total(cube: DataFrame, name: str) -> DataFrame:
        return cube.groupBy("local_day", "thread_id").agg(F.sum("total").cast("bigint").alias(name))

    both = total(sampled_days.where("quality = 'confirmed'"), "sampling_tokens").join(total(reconstructed_days, "reconstruction_tokens"), ["local_day", "thread_id"], "full_outer").na.fill(0, ["sampling_tokens", "reconstruction_tokens"])
    return both.withColumn("source", F.when(F.col("reconstruction_tokens") > F.col("sampling_tokens"), "reconstruction").otherwise("sampling"))


def effective(sampled: DataFrame, reconstructed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the source that is chosen for their day and thread; both have local_day and thread_id, alike else."""
    branches = [
        rows.join(chosen.where(F.col("source") == source).select("local_day", "thread_id"), ["local_day", "thread_id"], "left_semi").withColumn("source", F.lit(source))
        for rows, source in ((sampled, "sampling"), (reconstructed, "reconstruction"))
    ]
    return branches[0].unionByName(branches[1], allowMissingColumns=True)


def chosen(sampled: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """Both cubes' rows of the source that selection() prefers for their thread and day, with the source.

    As selection() and effective() in one pass: a window over thread and day sums both sources beside the rows, so that
    neither cube is read twice nor joined. A thread's day without confirmed usage of either source has no rows.
    """
    both = sampled.withColumn("source", F.lit("sampling")).unionByName(reconstructed.withColumn("source", F.lit("reconstruction")))
    group = Window.partitionBy("local_day", "thread_id")
    of = lambda source: F.sum(F.when((F.col("source") == source) & (F.col("quality") == "confirmed"), F.col("total"))).over(group)
    rows = both.select("*", of("sampling").alias("_s"), of("reconstruction").alias("_r"))
    prefers = F.when(F.coalesce("_r", F.lit(0)) > F.coalesce("_s", F.lit(0)), "reconstruction").otherwise("sampling")
    return rows.where((F.col("_s").isNotNull() | F.col("_r").isNotNull()) & (F.col("source") == prefers)).drop("_s", "_r")
