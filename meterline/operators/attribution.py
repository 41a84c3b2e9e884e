"""To whom usage belongs: account intervals, project roots, identities and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import git_identity, normal_path
from ..functions.time import CUBE_HOURS
from .aggregates import DIMENSIONS, cube_totals
from .checkpoint import settle
from .slots import carried, neighbour

#: Ranks of attribution confidence.
CONFIDENCE = {"verified": 2, "inferred": 1, "unknown": 0}
#: Epochs are looked up by the days they touch.
SLOT_SECONDS = 86400


def confidence_rank(name: str = "confidence") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col(name)), F.lit(0))


def inferred_epochs(markers: DataFrame, earliest: Column, now: Column, apart: int | None = 1) -> DataFrame:
    """(observed_from, observed_to, account): windows between logouts in which exactly one account was seen.

    markers has event_id, observed_at, kind, account. A logout within `apart` whole seconds of the last kept one is
    dropped; without it each time of a logout ends a window. A window starts with the last login before the account's
    first sighting, if there is one, and is open if it ends after now. Windows start at `earliest`, the first sampled
    fact; markers before it belong to none.
    """
    logouts = markers.where("kind = 'logout'")
    logouts = logouts.select("observed_at").distinct() if apart is None else kept_apart(logouts, "observed_at", apart)
    first = markers.sparkSession.range(1).select(earliest.alias("observed_at"))
    bounds = first.unionByName(logouts.where(F.col("observed_at") > earliest)).where("observed_at is not null")
    far = now + F.expr("interval 3650 days")
    window = F.struct(F.col("observed_at").alias("start"), F.coalesce("near.observed_at", far).alias("end"))
    starts = neighbour(bounds, ["observed_at"], ["observed_at"], after=True).select("observed_at", window.alias("bound"), F.lit(0).alias("rank"))
    # At equal times bounds come first, then logins, then sightings.
    login = F.col("kind") == "login_success"
    rest = markers.where("observed_at is not null").select("observed_at", "account", "kind", F.when(login, 1).otherwise(2).alias("rank"))
    rows = starts.unionByName(rest, allowMissingColumns=True)
    entry = F.when(F.col("rank") == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("observed_at"))
    rows = rows.withColumn("entry", F.when(F.col("rank") < 2, F.struct(entry.alias("at"))))  # a bound ends what logins say
    seen = carried(rows, {"bound": "window", "entry": "login"}, ["observed_at", "rank"])
    seen = seen.where((F.col("kind") == "account_seen") & F.col("account").isNotNull() & (F.col("observed_at") < F.col("window.end")))
    return (
        seen.groupBy("window")
        .agg(F.min("account").alias("account"), F.max("account").alias("other"), F.min(F.struct("observed_at", "login.at")).alias("first"))
        .where("account = other")
        .select(
            F.coalesce("first.at", "window.start").alias("observed_from"),
            F.when(F.col("window.end") <= now, F.col("window.end")).alias("observed_to"),
            "account",
        )
    )


def kept_apart(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """Rows of distinct times more than so many whole seconds after the last kept one; null times are none.

    A time so far after the one before it is kept whatever came earlier. It begins a chain, and each chain is thinned in
    order by itself: from each kept time a search leads to the next, and only the last kept time is held between batches.
    """
    times = rows.select(at).where(F.col(at).isNotNull()).distinct()
    apart = (seconds + 1) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begins = F.when(F.coalesce(micros(at) - micros(f"near.{at}") >= apart, F.lit(True)), micros(at))
    chains = carried(neighbour(times, [at], [at]).select(at, begins.alias("begins")), {"begins": "chain"}, [at]).select(at, micros(at).alias("micros"), "chain")

    def scan(batches):
        import numpy as np

        chain, last = None, 0
        for batch in batches:
            of, time = batch["chain"].to_numpy(), batch["micros"].to_numpy()
            keep = np.zeros(len(batch), bool)
            starts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1))
            for lo, hi in zip(starts, [*starts[1:], len(of)]):
                i = lo if of[lo] != chain else lo + int(np.searchsorted(time[lo:hi], last + apart))
                chain = of[lo]
                while i < hi:
                    keep[i], last = True, time[i]
                    i += int(np.searchsorted(time[i:hi], last + apart))
            yield batch.loc[keep, [at]]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chains.repartition(parts, "chain").sortWithinPartitions("chain", "micros").mapInPandas(scan, times.schema)


def segments(epochs: DataFrame, last: DataFrame) -> DataFrame:
    """(seg_from, seg_to, epoch_account, epoch_confidence, slot): disjoint intervals, a row for each day they touch.

    Where epochs overlap the best confidence wins, then the latest start. `last` is the one row of the last time asked
    for, up to which open ends reach. Each start or end of an epoch begins a segment; what covers it is found by an
    equi-join on days.
    """
    slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / SLOT_SECONDS)
    days = lambda a, b: F.explode(F.sequence(slot(a), F.greatest(slot(a), slot(b)))).alias("slot")
    known = epochs.join(last, F.col("observed_from") <= F.col("last"))
    spread = known.select("*", days(F.col("observed_from"), F.least(F.coalesce("observed_to", "last"), F.col("last"))))
    points = known.select(F.col("observed_from").alias("seg_from")).union(known.where("observed_to <= last").select("observed_to")).distinct()
    cut = neighbour(points, ["seg_from"], ["seg_from"], after=True).select("seg_from", F.col("near.seg_from").alias("seg_to"), slot(F.col("seg_from")).alias("slot"))
    covers = (F.col("observed_from") <= F.col("seg_from")) & (F.col("observed_to").isNull() | (F.col("seg_from") < F.col("observed_to")))
    best = F.max(F.struct(confidence_rank().alias("rank"), F.col("observed_from"), F.col("account"), F.col("confidence"))).alias("best")
    won = cut.join(spread, "slot").where(covers).groupBy("seg_from", "seg_to").agg(best, F.max("last").alias("last"))
    return won.select("seg_from", "seg_to", F.col("best.account").alias("epoch_account"), F.col("best.confidence").alias("epoch_confidence"), days(F.col("seg_from"), F.coalesce("seg_to", "last")))


def epoch_at(facts: DataFrame, epochs: DataFrame, at: str = "source_timestamp") -> DataFrame:
    """facts with epoch_account and epoch_confidence of the interval [observed_from, observed_to) that holds their time.

    A fact meets the segments of its day, of which one holds it at most: one equi-join, no grouping of facts.
    """
    last = settle(facts.agg(F.max(at).alias("last")))  # one row, met in several places
    found = segments(epochs, last).withColumnRenamed("slot", "_slot")
    own = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / SLOT_SECONDS)
    holds = (own == F.col("_slot")) & (F.col(at) >= F.col("seg_from")) & (F.col("seg_to").isNull() | (F.col(at) < F.col("seg_to")))
    return facts.join(found, holds, "left").drop("_slot", "seg_from", "seg_to")


def applied_to_facts(facts: DataFrame, epochs: DataFrame) -> DataFrame:
    """facts whose account isn't known with that of the epoch that holds their time, if one does."""
    found = epoch_at(facts, epochs).withColumn("account", F.coalesce("account", "epoch_account"))
    return found.drop("epoch_account", "epoch_confidence")


def applied_to_cube(cube: DataFrame, key: str, epochs: DataFrame) -> DataFrame:
    """A day or hour cube whose rows without account move to the epoch that holds their whole bucket.

    Buckets in which an epoch begins or ends stay as they are, but for the day in which the first epoch begins, which
    counts from its start. key is local_day or local_hour; epochs don't overlap. Rows of equal keys are added up.
    """
    grain = {"local_day": "day", "local_hour": "hour"}[key]
    shift = F.make_dt_interval(hours=F.lit(CUBE_HOURS))
    floor = lambda c: F.date_trunc(grain, F.col(c) + shift).cast("timestamp_ntz")
    up = F.when(floor("observed_from") == F.col("observed_from") + shift, floor("observed_from")).otherwise(floor("observed_from") + F.expr(f"interval 1 {grain}"))
    if grain == "day":
        first = epochs.agg(F.min("observed_from").alias("first"))
        epochs = epochs.crossJoin(first)  # one row
        up = F.when(F.col("observed_from") == F.col("first"), floor("observed_from")).otherwise(up)
    whole = epochs.select(up.alias("observed_from"), floor("observed_to").alias("observed_to"), "account", "confidence").where("observed_to is null or observed_from < observed_to")
    named = cube.where("account <> ''")
    nameless = cube.where("account = ''").withColumn("_at", F.col(key).cast("timestamp_ntz"))
    moved = epoch_at(nameless, whole, "_at").withColumn("account", F.coalesce("epoch_account", F.lit("")))
    return cube_totals(named.unionByName(moved.select(*cube.columns)), key, *DIMENSIONS, "quality")


def evidence_of_roots(threads: DataFrame, roots: DataFrame, identity: Column | None = None) -> DataFrame:
    """(project_id, identity): remotes of threads whose folder is a project's root or below it, each once.

    identity is the threads' normalised remote, where it is known already.
    """
    parts = F.split(normal_path("cwd"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = threads.where("cwd is not null").select((git_identity("git_origin") if identity is None else identity).alias("identity"), F.explode(prefixes).alias("root")).where("identity is not null").distinct()
    return own.join(roots.select(normal_path("path").alias("root"), "project_id").where("root <> ''"), "root").select("project_id", "identity").distinct()


def longest_root(threads: DataFrame, roots: DataFrame) -> DataFrame:
    """(thread_id, root_project): the project of the longest root that is a path's ancestor or itself.

    A path is joined with roots by equality of each of its own prefixes, component by component. Ties go by root, then
    project.
    """
    parts = F.split(normal_path("cwd"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = threads.where("cwd is not null").select("thread_id", F.explode(prefixes).alias("root"))
    clean = roots.select(normal_path("path").alias("root"), "project_id").where("root <> ''")
    best = F.min(F.struct((-F.length("root")).alias("longest"), F.col("root"), F.col("project_id")))
    return paths.join(clean, "root").groupBy("thread_id").agg(best.alias("best")).select("thread_id", F.col("best.project_id").alias("root_project"))


def git_project(threads: DataFrame, identities: DataFrame) -> DataFrame:
    """(thread_id, git_project): the lowest project that has a thread's remote."""
    own = threads.select("thread_id", git_identity("git_origin").alias("identity")).where("identity is not null")
    known = identities.select(git_identity("remote").alias("identity"), "project_id").where("identity is not null")
    return own.join(known, "identity").groupBy("thread_id").agg(F.min("project_id").alias("git_project"))


def resolved_project() -> list[Column]:
    """project, method and confidence from manual, native, root, git and parent candidates, in this order."""
    order = (("manual", "manual_project", "verified"), ("native", "project_id", "verified"), ("root", "root_project", "inferred"), ("git", "git_project", "inferred"), ("parent", "parent_project", "inferred"))
    pick = lambda what, none: F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(m if what else conf)) for m, c, conf in order], F.lit(none))
    return [F.coalesce(*[F.col(c) for _, c, _ in order]).alias("project"), pick(True, "unassigned").alias("method"), pick(False, "unknown").alias("confidence")]


def registry(official: DataFrame, aliases: DataFrame, verified: DataFrame, used: DataFrame) -> DataFrame:
    """(account, kind): canonical accounts are official, canonical aliases or verified; others that occur are provisional."""
    canonical = official.select("account").union(aliases.where("is_canonical").select("account")).union(verified.select("account")).where("account is not null and account <> ''").distinct()
    other = aliases.where("not is_canonical").select("account").union(used.select("account")).where("account is not null and account <> ''").distinct()
    return canonical.withColumn("kind", F.lit("canonical")).unionByName(other.join(canonical, "account", "left_anti").withColumn("kind", F.lit("provisional")))
