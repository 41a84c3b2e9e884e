"""Streams into the ledger: facts that are stored once, whatever is delivered again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.time import local_day
from ..functions.tokens import MEASURES
from ..operators.checkpoint import settle
from ..sources.logs import records, written_files
from ..sources.tail import RANGE_BYTES, ranges, read_ranges, settled_lines, stops
from . import machines
from .machines import guarded
from .store import Store, batch_of, content_hash, exists

#: Facts may come so late; lines of the last seconds are left for the next run, as more of their time may come.
LATE, WATERMARK_SECONDS = "7 days", 5


def append_new(lines: DataFrame, facts: str) -> None:
    """Appends the facts of whole files that the table lacks; only the days of the batch are looked at."""
    key = F.concat_ws("\x1f", "source", F.col("line_no").cast("string"))
    new = guarded(records(lines)).withColumn("event_id", F.sha2(key, 256)).withColumn("local_day", local_day(F.col("at").cast("timestamp_ntz")))
    spark = lines.sparkSession
    if exists(spark, facts):
        days = [r[0] for r in new.select("local_day").distinct().collect()]  # a value a day of the batch
        known = spark.read.parquet(facts).where(F.col("local_day").isin(days))
        new = new.join(known.select("event_id"), "event_id", "left_anti")
    new.write.mode("append").partitionBy("local_day").parquet(facts)


def ingest(lines: DataFrame, facts: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs the replay guard over each micro-batch of whole files and appends facts that the table lacks.

    The batch's number and the facts' own keys make a repeated batch write nothing new. The table is partitioned by
    local day, so that later queries prune it. Files that grow are tail()'s.
    """
    return lines.writeStream.foreachBatch(lambda batch, _: append_new(batch, facts)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Machine(NamedTuple):
    """A state machine over records of files: walk(records, state) gives rows, of which facts and state are taken."""

    walk: Callable[[DataFrame, DataFrame | None], DataFrame]
    facts: Callable[[DataFrame], DataFrame]
    state: Callable[[DataFrame], DataFrame]
    schema: str


GUARD = Machine(machines.guard, machines.guard_facts, machines.guard_state, machines.GUARD_STATE)


def rebuilding(targets: DataFrame) -> Machine:
    """The reconstruction of counters for the targets' files."""
    return Machine(lambda records, state: machines.rebuild(records, targets, state), machines.rebuild_facts, machines.rebuild_state, machines.REBUILD_STATE)


def tail_folder(store: Store, path: str, now: datetime, machine: Machine = GUARD, pattern: str = "rollout-*.jsonl") -> int:
    """Stores the facts of what is new under a folder; how many files had something new. See tail()."""
    return tail(store, written_files(store.spark, path, pattern), now, machine)


def tail(store: Store, files: DataFrame, now: datetime, machine: Machine = GUARD, bootstrap: int | None = None, range_bytes: int = RANGE_BYTES) -> int:
    """Reads files (source, identity, length, path) on from where the last run stopped, and commits facts, parser's states
    and places together; how many files had something new.

    Reading stops at a line that doesn't end yet or is newer than WATERMARK_SECONDS before now. A file that became shorter or has
    another identity was replaced: it is read anew, and its old facts vanish with the same commit. Of a file never seen
    only the last `bootstrap` bytes are read, if given. A run that breaks off anywhere is repeated whole. The places of files
    with news come to the driver, which lists the files anyway.
    """
    known = store.sources()
    if known is None:
        known = store.spark.createDataFrame([], "source string, identity string, next long, generation long")
    last = known.select("source", F.col("identity").alias("was"), "next", F.col("generation").alias("old"))
    replaced = (F.col("was") != F.col("identity")) | (F.col("length") < F.col("next"))
    begin = F.greatest(F.col("length") - bootstrap, F.lit(0)) if bootstrap is not None else F.lit(0)
    rows = files.join(last, "source", "left").select(
        "source", "identity", "path", "length",
        F.when(F.col("next").isNull(), begin).when(replaced, 0).otherwise(F.col("next")).cast("long").alias("first"),
        (F.coalesce("old", F.lit(0)) + F.coalesce(replaced, F.lit(False)).cast("long")).alias("generation"),
        F.coalesce(replaced, F.lit(False)).alias("replaced"),
    )
    news = rows.where("first < length or replaced").collect()
    if not news:
        return 0
    own = ranges([(r.source, r.path, r.first, r.length) for r in news], range_bytes)
    found = settle(read_ranges(store.spark, own, now - timedelta(seconds=WATERMARK_SECONDS)))
    ends = settle(stops(found))
    kept = machine.schema.split(", ", 1)[1]
    files_ = store.spark.createDataFrame([(r.source, r.identity, r.generation, r.first, r.replaced) for r in news], "source string, identity string, generation long, first long, replaced boolean")
    going = files_.where("not replaced").select("source")
    state = store.sources()
    if state is not None:
        state = settle(state.join(going, "source", "left_semi").where("state is not null").select("source", "state.*"))
    walked = settle(machine.walk(records(settled_lines(found, ends)), state))
    states = machine.state(walked).select("source", F.struct(*[c for c in machine.state(walked).columns if c != "source"]).alias("state"))
    if state is not None:  # of files without a record among their new lines
        states = states.unionByName(state.join(walked.select("source").distinct(), "source", "left_anti").select("source", F.struct(*state.columns[1:]).alias("state")))
    after = files_.join(ends, "source", "left").join(states, "source", "left")
    sources = after.select("source", "identity", F.coalesce("next", "first").alias("next"), "generation", F.col("state").cast(f"struct<{kept}>").alias("state"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    facts = machine.facts(walked)
    if "quality" not in facts.columns:
        facts = facts.withColumn("quality", F.lit("confirmed"))
    facts = facts.withColumn("hash", content_hash(facts)).join(files_.select("source", "generation"), "source")
    key = F.concat_ws("\x1f", "source", F.col("line_no").cast("string"), F.col("generation").cast("string"))
    facts = facts.withColumn("event_id", F.sha2(key, 256)).withColumn("local_day", local_day(F.col("at").cast("timestamp_ntz")))
    store.commit(batch_of(store, facts, now, known=False) | {"sources": sources})
    return len(news)


def hourly(facts: DataFrame, at: str = "source_timestamp") -> DataFrame:
    """A stream of facts as hourly sums by thread and model, late facts up to LATE; each key once within that time."""
    unique = facts.withWatermark(at, LATE).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy(F.window(at, "1 hour").alias("hour"), "thread_id", "model").agg(F.count("*").alias("event_count"), *[F.sum(m).alias(m) for m in MEASURES])
