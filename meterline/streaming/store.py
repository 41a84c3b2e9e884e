"""A store of facts in plain Parquet whose batches become visible at once, by a commit record that is written last.

A batch is a folder with parts: facts, the keys and day sums of late facts, and what is known of each source: how far it
was read, its parser's state, and its generation, which rises when a file was replaced. A commit names a batch; what no
commit names doesn't exist for readers, so a run that breaks off anywhere leaves nothing behind but unread files, and is
simply repeated. Facts of an older generation of their source are hidden in the same moment as the new ones appear.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import MEASURES

#: Facts of this age or older count in the day sums only.
LATE_DAYS = 7
KEYS = "event_id string, hash long, source string, generation long, bucket string"
DAY_KEYS = ("source", "generation", "local_day", "thread_id", "model", "quality")


def exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    # --- commits

    def commits(self) -> list[dict]:
        """The commits in force, in order; those that a later one replaces are left out. A row a commit, until compact()."""
        if not exists(self.spark, f"{self.root}/commits"):
            return []
        rows = self.spark.read.text(f"{self.root}/commits", wholetext=True).collect()
        found = sorted((json.loads(r[0]) for r in rows), key=lambda c: c["n"])
        gone = {b for c in found for b in c["replaces"]}
        return [c for c in found if c["batch"] not in gone]

    def commit(self, parts: dict[str, DataFrame], replaces: tuple[str, ...] = ()) -> int:
        """Writes the parts of a batch, then its commit record; its number.

        Of two writers that end at the same number the second fails, and has to be repeated on what the first wrote.
        """
        number, batch = max((c["n"] for c in self.commits()), default=0) + 1, uuid.uuid4().hex
        schemas = {}
        for name, part in parts.items():
            part = part.withColumn("commit", F.lit(number).cast("long"))
            by = {"facts": ["local_day"], "keys": ["bucket"]}.get(name, [])
            part.write.partitionBy(*by).parquet(f"{self.root}/batches/{batch}/{name}")
            schemas[name] = part.schema.jsonValue()
        self._publish(number, {"n": number, "batch": batch, "parts": schemas, "replaces": list(replaces)})
        return number

    def _publish(self, number: int, record: dict) -> None:
        """The record appears whole, or, where another one has the number, not at all: a rename that doesn't overwrite."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        hadoop, conf = jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        folder = hadoop.Path(f"{self.root}/commits")
        context = hadoop.FileContext.getFileContext(folder.toUri(), conf) if folder.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
        files = folder.getFileSystem(conf)
        files.mkdirs(folder)
        draft = hadoop.Path(folder, f"_{uuid.uuid4().hex}")  # names with an underscore aren't read
        out = files.create(draft)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        none = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        none[0] = getattr(hadoop, "Options$Rename").NONE
        context.rename(draft, hadoop.Path(folder, f"{number:012d}.json"), none)

    def part(self, name: str, schema: str | None = None) -> DataFrame | None:
        """All rows of a part in all commits; columns that an older batch lacks are null. None, or no rows, without any."""
        own = [c for c in self.commits() if name in c["parts"]]
        if not own:
            return self.spark.createDataFrame([], schema) if schema else None
        newest = T.StructType.fromJson(own[-1]["parts"][name])
        rows = [self.spark.read.schema(newest).parquet(f"{self.root}/batches/{c['batch']}/{name}") for c in own]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    # --- what readers see

    def sources(self) -> DataFrame | None:
        """(source, identity, next, generation, state, bytes, commit) of each source, as its last batch left it."""
        rows = self.part("sources")
        if rows is None:
            return None
        return rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source"]), "commit").alias("s")).select("source", "s.*")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of the present generation of their source; only sources that were replaced are met."""
        known = self.sources()
        if known is None:
            return rows
        replaced = known.where("generation > 0").select(F.col("source").alias("_source"), F.col("generation").alias("_generation"))
        return rows.join(replaced, F.col("source") == F.col("_source"), "left").where("_generation is null or generation = _generation").drop("_source", "_generation")

    def facts(self, days: list[str] | None = None) -> DataFrame | None:
        """The facts, of some days or of all; of one that was stored again with other content the last."""
        rows = self.part("facts")
        if rows is None:
            return None
        if days is not None:
            rows = rows.where(F.col("local_day").isin(days))
        rows, again = self._current(rows), self.part("again")
        if again is not None:
            last = again.groupBy(F.col("event_id").alias("_id")).agg(F.max("commit").alias("_commit"))
            rows = rows.join(last, F.col("event_id") == F.col("_id"), "left").where("_commit is null or commit = _commit").drop("_id", "_commit")
        return rows

    def keys(self) -> DataFrame:
        return self._current(self.part("keys", KEYS))

    def days(self) -> DataFrame | None:
        """Day sums by thread, model and quality of all facts, late ones included."""
        facts, late = self.facts(), self.part("days")
        parts = [*([day_sums(facts)] if facts is not None else []), *([self._current(late).drop("commit")] if late is not None else [])]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        sums = [F.sum(c).cast("long").alias(c) for c in ("event_count", *MEASURES)]
        return rows.groupBy(*DAY_KEYS[2:]).agg(*sums)

    def compact(self, now: datetime | None = None) -> int:
        """All commits as one, with the rows that readers see; with a time, facts that are LATE_DAYS old by then become keys
        and day sums. Files of replaced batches stay until vacuum(), as readers may still hold them."""
        old, parts = self.commits(), {}
        facts, late, keys, sources = self.facts(), self.part("days"), self.part("keys"), self.sources()
        late = None if late is None else self._current(late).drop("commit")
        keys = None if keys is None else self._current(keys).drop("commit")
        if facts is not None and now is not None:
            aged = facts.where(is_late(now))
            facts = facts.where(~is_late(now))
            late = day_sums(aged) if late is None else late.unionByName(day_sums(aged))
            keys = keys_of(aged) if keys is None else keys.unionByName(keys_of(aged))
        if late is not None:
            late = late.groupBy(*DAY_KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in ("event_count", *MEASURES)])
        for name, part in (("facts", facts), ("days", late), ("keys", keys), ("sources", sources)):
            if part is not None:
                parts[name] = part.drop("commit")
        return self.commit(parts, tuple(c["batch"] for c in old))

    def vacuum(self) -> int:
        """Deletes batches that no commit in force names, of broken runs too: only while no run is under way. How many."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        files, kept = path.getFileSystem(self.spark._jsc.hadoopConfiguration()), {c["batch"] for c in self.commits()}
        gone = [x.getPath() for x in files.listStatus(path) if x.getPath().getName() not in kept] if files.exists(path) else []
        for x in gone:
            files.delete(x, True)
        return len(gone)


def is_late(now: datetime) -> F.Column:
    return F.coalesce(F.col("at") < F.lit(now) - F.expr(f"interval {LATE_DAYS} days"), F.lit(False))


def day_sums(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*DAY_KEYS).agg(F.count("*").alias("event_count"), *[F.sum(m).cast("long").alias(m) for m in MEASURES])


def keys_of(facts: DataFrame) -> DataFrame:
    return facts.select("event_id", "hash", "source", "generation", F.substring("event_id", 1, 2).alias("bucket"))


def content_hash(facts: DataFrame) -> F.Column:
    """Of all but the key: what a repeated fact must have in common with the stored one."""
    return F.xxhash64(*[F.col(c) for c in sorted(facts.columns) if c != "event_id"])


def batch_of(store: Store, facts: DataFrame, now: datetime, known: bool = True) -> dict[str, DataFrame]:
    """The parts of a batch of facts (event_id, source, generation, at, local_day, thread_id, model, quality, measures, hash).

    Facts of LATE_DAYS and older that aren't stored yet become a key and day sums, others are stored. Of stored ones that
    come again, equal ones are left out and changed ones stored anew, as the last content counts. A late fact whose key is
    known with another content stops the batch with an error that names it: its old content can't be taken back.
    Without `known` the keys are new by construction, and nothing stored is read.
    """
    if not known:
        fresh = facts.where(~is_late(now))
        late = facts.where(is_late(now))
        return {"facts": fresh, "keys": keys_of(late), "days": day_sums(late)}
    facts = facts.dropDuplicates(["event_id"])
    days = [r[0] for r in facts.select("local_day").distinct().collect()]  # a value a day of the batch
    stored = store.facts(days)
    stored = stored.select("event_id", F.col("hash").alias("_stored")) if stored is not None else store.spark.createDataFrame([], "event_id string, _stored long")
    # Keys are met by bucket and key, so that folders and, where it pays, a Bloom filter of the batch's keys prune the scan.
    keys = store.keys().select("bucket", "event_id", F.col("hash").alias("_key"))
    met = facts.withColumn("bucket", F.substring("event_id", 1, 2)).join(stored, "event_id", "left").join(keys, ["bucket", "event_id"], "left").drop("bucket")
    clash = F.col("_stored").isNull() & (F.col("_key") != F.col("hash"))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("a late fact comes with other content than before: "), F.col("event_id"))).cast("boolean")).otherwise(F.col("_key").isNull() | F.col("_stored").isNotNull())
    met = met.where(checked).where("_stored is null or _stored <> hash")
    late = is_late(now) & F.col("_stored").isNull()
    fresh = met.where(~late)
    old = met.where(late).drop("_stored", "_key")
    return {"facts": fresh.drop("_stored", "_key"), "keys": keys_of(old), "days": day_sums(old), "again": fresh.where("_stored is not null").select("event_id")}


def append(store: Store, facts: DataFrame, now: datetime) -> int:
    """Stores facts that may have been delivered before, as batch_of() says; the commit's number.

    Facts without source or generation have the source '' and the generation 0.
    """
    for name, value in (("source", F.lit("")), ("generation", F.lit(0).cast("long"))):
        if name not in facts.columns:
            facts = facts.withColumn(name, value)
    return store.commit(batch_of(store, facts.withColumn("hash", content_hash(facts)), now))
