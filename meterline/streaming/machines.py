"""Replay-safe usage from session logs: the replay guard, the reconstruction of counters and the interval matcher.

The first two are functions of what stands before a record in its file, so they are windows over the file's order and
not loops: a phase is the last change of phase, a context the last one since the replay ended, a counter's delta its
difference to the last total. The matcher consumes candidates and is a scan of sorted rows with bounded state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import uuid7_millis
from ..functions.tokens import MEASURES, valid

#: A task may start so long before the session's own record; a child's inherited counters follow within this gap.
START_SLACK_MS, PREFIX_GAP_MS = 2000, 2000
MATCH_MICROS = 250_000


def _usage(prefix: str) -> Column:
    return F.struct(*[F.col(prefix + m).alias(m) for m in MEASURES])


def _has(prefix: str) -> Column:
    return F.col(prefix + "total").isNotNull()


def _millis(at: str) -> Column:
    return F.expr(f"unix_millis({at})")


def _last(c: Column, window: Window) -> Column:
    return F.last(c, ignorenulls=True).over(window)


USAGE = ", ".join(f"{m}: bigint" for m in MEASURES)
#: What the replay guard knows after a file's lines so far; line_no is the last line's.
GUARD_STATE = f"source string, line_no bigint, own struct<session_id: string, at: timestamp, parent_id: string, cwd: string>, phase string, model string, cwd string, previous struct<{USAGE}>, counter_epoch int"


def _seeded(records: DataFrame, state: DataFrame | None, schema: str) -> DataFrame:
    """records with a column `seed`, and the state of each of their files as a record before its first; a state without
    new records has none.

    Files are dealt over all shuffle partitions: records take many times the memory that they take in a shuffle, by whose
    bytes Spark would else put partitions together.
    """
    empty = records.sparkSession.createDataFrame([], schema)
    state = empty if state is None else state.join(records.select("source").distinct(), "source", "left_semi")
    rows = state.select("source", "line_no", F.struct(*empty.columns[1:]).alias("seed"))  # it was the last line's record
    kind = rows.schema["seed"].dataType.simpleString()
    seeded = records.withColumn("seed", F.lit(None).cast(kind)).unionByName(rows, allowMissingColumns=True)
    return seeded.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source")


def guard(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """All records of files, with what the replay guard knows at each; `state` is that of the files' earlier lines.

    The state comes as one more record before a file's new ones, so that the windows are the same from the first line on
    or from any other.
    """
    order = Window.partitionBy("source").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seed = lambda c: F.col(f"seed.{c}")
    rows = _seeded(records.where("kind is not null"), state, GUARD_STATE)
    meta = (F.col("kind") == "session_meta") & F.col("session_id").isNotNull()
    session = F.coalesce(seed("own"), F.when(meta, F.struct("session_id", "at", "parent_id", "cwd")))
    rows = rows.withColumn("session", session).select("*", F.first("session", ignorenulls=True).over(so_far).alias("own"), (meta & (F.count("session").over(before) == 0)).alias("is_first"))
    belongs = F.coalesce(uuid7_millis("turn_id") >= uuid7_millis("own.session_id"), F.lit(False)) | F.coalesce(F.col("started_at") * 1000 + START_SLACK_MS >= _millis("own.at"), F.lit(False))
    change = (
        F.when(F.col("seed").isNotNull(), seed("phase"))
        .when(F.col("is_first"), "live")
        .when(meta & (F.col("session_id") != F.col("own.session_id")), "foreign")
        .when((F.col("kind") == "task_started") & F.col("own").isNotNull() & belongs, "back")
    )
    rows = rows.withColumn("change", change)
    rows = rows.withColumn("phase_before", _last(F.col("change"), before)).withColumn("phase", _last(F.col("change"), so_far))
    # A task start while live changes nothing; only one that ends foreign history does.
    ended = (F.col("change") == "back") & (F.col("phase_before") == "foreign")
    rows = rows.withColumn("live", F.col("phase").isin("live", "back")).withColumn("stretch", F.sum(F.coalesce(ended, F.lit(False)).cast("int")).over(so_far))
    # A context holds to the end of its stretch. It takes the stretch along, so that all windows share one order.
    context = (F.col("kind") == "turn_context") & F.col("live")
    value = lambda c: F.coalesce(seed(c), F.when(context, F.col(c)))
    carried = lambda c: _last(F.when(value(c).isNotNull(), F.struct("stretch", value(c).alias("value"))), so_far)
    rows = rows.withColumn("own_model", carried("model")).withColumn("own_cwd", carried("cwd"))
    rows = rows.withColumns({c: F.when(F.col(f"{c}.stretch") == F.col("stretch"), F.col(f"{c}.value")) for c in ("own_model", "own_cwd")})
    counted = (F.col("kind") == "token_count") & (_has("total_") | _has("last_"))
    total = F.coalesce(seed("previous"), F.when(counted & F.col("live") & _has("total_"), _usage("total_")))
    rows = rows.withColumn("counted", F.coalesce(counted, F.lit(False))).withColumn("total", total)
    rows = rows.withColumn("previous", _last(F.col("total"), before)).withColumn("latest", _last(F.col("total"), so_far))
    rows = rows.withColumn("known", F.col("counted") & F.col("live") & F.col("previous").isNotNull() & _has("total_"))
    falls = F.lit(False)
    for m in MEASURES:
        falls = falls | (F.col(f"total_{m}") < F.col(f"previous.{m}"))
    rows = rows.withColumn("reset", F.coalesce(F.col("known") & falls, F.lit(False)))
    return rows.withColumn("counter_epoch", F.sum(F.coalesce(seed("counter_epoch"), F.col("reset").cast("int"))).over(so_far).cast("int"))


def guard_state(guarded: DataFrame) -> DataFrame:
    """The state after the last record of each file, from guard()'s rows, for the lines still to come."""
    own = F.max_by(F.struct("line_no", "own", "phase", F.col("own_model").alias("model"), F.col("own_cwd").alias("cwd"), F.col("latest").alias("previous"), "counter_epoch"), "line_no")
    return guarded.groupBy("source").agg(own.alias("s")).select("source", "s.*")


def guard_facts(guarded: DataFrame) -> DataFrame:
    """The usage facts among guard()'s rows: confirmed, or quarantined with a reason."""
    rows = guarded.where("counted")
    same = F.coalesce(F.col("known") & (_usage("total_") == F.col("previous")), F.lit(False))
    sound = F.coalesce(_has("last_") & valid("last_"), F.lit(False))
    delta = F.when(F.col("known") & ~F.col("reset"), F.struct(*[(F.col(f"total_{m}") - F.col(f"previous.{m}")).alias(m) for m in MEASURES]))
    usage = F.when(_has("last_"), _usage("last_")).when(F.col("live"), F.coalesce(delta, _usage("total_"))).otherwise(_usage("total_"))
    quality = F.when(F.coalesce(F.col("live"), F.lit(False)) & sound, "confirmed").otherwise("quarantined")
    reason = (
        F.when(F.col("phase") == "foreign", "foreign_history")
        .when(F.col("phase").isNull(), "before_session")
        .when(~_has("last_"), "last_usage_missing")
        .when(~sound, "last_usage_invalid")
        .when(F.col("reset"), "counter_reset")
        .when(delta.isNotNull() & (delta != _usage("last_")), "delta_differs")
    )
    rows = rows.select("*", same.alias("same"), usage.alias("usage"), quality.alias("quality"), reason.alias("reason"))
    nothing = F.lit(True)
    for m in MEASURES:
        nothing = nothing & (F.col(f"usage.{m}") == 0)
    return rows.where(~F.col("same") & ~((F.col("quality") == "confirmed") & nothing)).select(
        "source", "line_no", "at", F.col("own.session_id").alias("thread_id"), F.col("own.parent_id").alias("parent_id"),
        F.when(F.col("live"), F.col("own_model")).alias("model"), F.coalesce("own_cwd", "own.cwd").alias("cwd"), "quality", "reason",
        "counter_epoch", "usage.*",
    )


def guarded(records: DataFrame) -> DataFrame:
    """Usage facts of files that may repeat the history of other sessions: confirmed, or quarantined with a reason.

    A file's first session record names its session. Another session's record begins foreign history, in which all is
    quarantined until a task starts that belongs to the file's session: by its UUID's time, or its start within
    START_SLACK_MS. An unchanged counter is no fact; the explicit last usage is one if it is possible; a counter that
    falls in any component begins a new epoch. Rows: source, line_no, at, thread_id, parent_id, model, cwd, quality,
    reason, counter_epoch, measures.
    """
    return guard_facts(guard(records))


#: What the reconstruction knows after a file's lines so far: the last reading and its time, whether the inherited
#: prefix is over, and whether a reading has counted.
REBUILD_STATE = f"source string, line_no bigint, own struct<at: timestamp, cwd: string>, earlier timestamp, broken boolean, counting boolean, model string, cwd string, previous struct<{USAGE}>, counter_epoch int"


def rebuild(records: DataFrame, targets: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """All records of the targets' files, with what the reconstruction knows at each; `state` is that of earlier lines."""
    order = Window.partitionBy("source").orderBy("line_no")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    seed = lambda c: F.col(f"seed.{c}")
    rows = _seeded(records.where("kind is not null"), state, REBUILD_STATE).join(targets.select("source", "thread_id", "parent_thread_id"), "source")
    meta = (F.col("kind") == "session_meta") & (F.col("session_id") == F.col("thread_id"))
    rows = rows.withColumn("own", F.first(F.coalesce(seed("own"), F.when(meta, F.struct("at", "cwd"))), ignorenulls=True).over(so_far))
    reading = F.coalesce((F.col("kind") == "token_count") & F.col("own").isNotNull() & F.col("at").isNotNull() & _has("total_") & valid("total_"), F.lit(False))
    rows = rows.withColumn("reading", reading).withColumn("read_at", F.coalesce(seed("earlier"), F.when(F.col("reading"), F.col("at"))))
    rows = rows.withColumn("latest_at", _last(F.col("read_at"), so_far))
    gap = F.greatest(_millis("at") - F.unix_millis(F.coalesce(_last(F.col("read_at"), before), F.col("own.at"))), F.lit(0))
    rows = rows.withColumn("near", F.col("reading") & F.coalesce(gap <= PREFIX_GAP_MS, F.lit(False)))
    rows = rows.withColumn("broken", F.max(F.coalesce(seed("broken"), F.col("reading") & ~F.col("near"))).over(so_far))
    rows = rows.withColumn("prefix", F.col("reading") & F.col("parent_thread_id").isNotNull() & ~F.col("broken"))
    # A context counts once the file is live: at once for a root, else after the first reading past the prefix.
    counts = F.coalesce(seed("counting"), F.col("reading") & ~F.col("prefix"))
    rows = rows.withColumn("counting", F.max(counts).over(so_far)).withColumn("counted_before", F.coalesce(F.max(counts).over(before), F.lit(False)))
    live = F.col("own").isNotNull() & (F.col("parent_thread_id").isNull() | F.col("counted_before"))
    context = (F.col("kind") == "turn_context") & live
    own = lambda c: _last(F.coalesce(seed(c), F.when(context, F.col(c))), so_far)
    rows = rows.withColumn("own_model", own("model")).withColumn("own_cwd", own("cwd"))
    rows = rows.withColumn("total", F.coalesce(seed("previous"), F.when(F.col("reading"), _usage("total_"))))
    rows = rows.withColumn("previous", _last(F.col("total"), before)).withColumn("latest", _last(F.col("total"), so_far))
    rows = rows.select("*", *[F.when(F.col("previous").isNull(), F.col(f"total_{m}")).otherwise(F.col(f"total_{m}") - F.col(f"previous.{m}")).alias(f"delta_{m}") for m in MEASURES])
    rises = F.lit(True)
    for m in MEASURES:
        rises = rises & (F.col(f"delta_{m}") >= 0)
    rows = rows.withColumn("rises", F.col("reading") & rises & (F.col("previous").isNull() | valid("delta_")))
    reset = F.col("reading") & ~F.col("prefix") & ~F.col("rises")
    return rows.withColumn("counter_epoch", F.sum(F.coalesce(seed("counter_epoch"), reset.cast("int"))).over(so_far).cast("int"))


def rebuild_state(rebuilt: DataFrame) -> DataFrame:
    """The state after the last record of each file, from rebuild()'s rows."""
    own = F.struct("line_no", "own", F.col("latest_at").alias("earlier"), "broken", "counting", F.col("own_model").alias("model"), F.col("own_cwd").alias("cwd"), F.col("latest").alias("previous"), "counter_epoch")
    return rebuilt.groupBy("source").agg(F.max_by(own, "line_no").alias("s")).select("source", "s.*")


def rebuild_facts(rebuilt: DataFrame) -> DataFrame:
    """The usage facts among rebuild()'s rows."""
    sound = F.coalesce(_has("last_") & valid("last_"), F.lit(False))
    rows = rebuilt.where("reading and not prefix").withColumn("usage", F.when(F.col("rises"), _usage("delta_")).when(sound, _usage("last_")))
    some = F.lit(False)
    for m in MEASURES:
        some = some | (F.col(f"usage.{m}") != 0)
    return rows.where(F.col("usage").isNotNull() & some).select("source", "line_no", "at", "thread_id", F.col("own_model").alias("model"), F.coalesce("own_cwd", "own.cwd").alias("cwd"), "counter_epoch", "usage.*")


def reconstructed(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Usage facts from cumulative counters of known threads; targets has source, thread_id and parent_thread_id.

    A child's file may begin with inherited readings: those that follow its session's record, and then each other, within
    PREFIX_GAP_MS set the baseline and aren't usage. Later readings count by their difference; the first counts in full
    if there is no baseline; where a difference isn't a possible usage the explicit last usage counts, or nothing, and a
    new epoch begins. Rows: source, line_no, at, thread_id, model, cwd, counter_epoch, measures.
    """
    return rebuild_facts(rebuild(records, targets))


MATCHES = "thread_id string, observation_id long, candidate_id long, gap_micros long"


def matched(observations: DataFrame, candidates: DataFrame, micros: int = MATCH_MICROS) -> DataFrame:
    """(thread_id, observation_id, candidate_id, gap_micros): each observation, in order, takes the nearest unused candidate.

    Both have thread_id, id and at. A candidate is within `micros`, the earlier of two equally near. Observations without
    one have null. A thread's rows pass in the order of time; what is held of them is one tolerance's worth.
    """
    tag = lambda df, kind: df.select("thread_id", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.expr("unix_micros(cast(at as timestamp))").alias("micros"))
    rows = tag(observations, 1).unionByName(tag(candidates, 0))
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thread, waiting, near, out = None, deque(), deque(), []

        def settle(now: int | None) -> None:
            while waiting and (now is None or waiting[0][1] + micros < now):
                own, at = waiting.popleft()
                while near and near[0][1] < at - micros:
                    near.popleft()
                best = min((c for c in near if abs(c[1] - at) <= micros), key=lambda c: abs(c[1] - at), default=None)
                if best:
                    near.remove(best)
                out.append((thread, own, best[0] if best else None, abs(best[1] - at) if best else None))

        for batch in batches:
            for thread_id, kind, own, at in zip(batch["thread_id"], batch["kind"], batch["id"], batch["micros"]):
                if thread_id != thread:
                    settle(None)
                    thread = thread_id
                    near.clear()
                settle(at)
                while not waiting and near and near[0][1] < at - micros:  # too old for all that may still come
                    near.popleft()
                (waiting if kind else near).append((own, at))
            yield frame(out)
            out = []
        settle(None)
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[x.split()[0] for x in MATCHES.split(", ")]).astype({"candidate_id": "Int64", "gap_micros": "Int64"})

    return rows.repartition(parts, "thread_id").sortWithinPartitions("thread_id", "micros", "kind", "id").mapInPandas(scan, MATCHES)
