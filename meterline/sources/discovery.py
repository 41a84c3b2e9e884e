"""Which files and log rows are to be read: discovery, pending work, candidate and marker scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_after, normal_path

#: The newest rows are still being written; they wait for the next reading.
SETTLED = "interval 5 seconds"


def indexed_files(index: DataFrame, roots: list[str], suffix: str = ".jsonl") -> DataFrame:
    """Distinct paths of a session index that lie under a root and have the suffix."""
    path, under = normal_path("path"), F.lit(False)
    for root in roots:
        clean = root.rstrip("/")
        under = under | (path == clean) | path.startswith(clean + "/")
    return index.select(path.alias("path")).where(F.col("path").endswith(suffix)).where(under).distinct() if roots else index.select("path").limit(0)


def pending(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source, identity, length, offset) of files not read to their end.

    A file's place is that of its source, else the farthest of its identity, else 0. A length below the place is pending
    too: the file was replaced.
    """
    own = cursors.select("source", F.col("offset").alias("own_offset"))
    by_identity = cursors.groupBy("identity").agg(F.max("offset").alias("same_offset"))
    rows = files.join(own, "source", "left").join(by_identity, "identity", "left").withColumn("offset", F.coalesce("own_offset", "same_offset", F.lit(0)))
    return rows.where("offset <> length").select("source", "identity", "length", "offset")


def log_rows(logs: DataFrame, after_id: int, now: Column, target: str, marker: str) -> DataFrame:
    """Rows of a log past a cursor, settled, of one target, with a thread and a marker in the body."""
    return logs.where((F.col("id") > after_id) & (F.col("at") <= now - F.expr(SETTLED)) & (F.col("target") == target) & F.col("thread_id").isNotNull() & (F.instr("body", marker) > 0))


def high_water(logs: DataFrame, now: Column) -> DataFrame:
    return logs.where(F.col("at") <= now - F.expr(SETTLED)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))


def auth_markers(logs: DataFrame, rules: dict[str, tuple[str, str]], account_after: str) -> DataFrame:
    """(id, at, kind, account): rows of the targets and substrings of each kind; the account follows the last marker."""
    kind = F.lit(None).cast("string")
    for name, (target, marker) in rules.items():
        kind = F.coalesce(kind, F.when((F.col("target") == target) & F.col("body").contains(marker), name))
    account = field_after("body", account_after)
    return logs.select("id", "at", kind.alias("kind"), F.when(F.length(account) <= 256, account).alias("account")).where("kind is not null")


def recent_roots(threads: DataFrame, edges: DataFrame, now: Column, hours: int = 12, most: int = 512) -> DataFrame:
    """The most recent root threads of the last hours that no spawn edge leads to. The limit is the feature: a top-k."""
    recent = threads.where(F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(hours))).where("depth = 0 and parent_thread_id is null")
    return recent.join(edges.select(F.col("child").alias("thread_id")), "thread_id", "left_anti").orderBy(F.desc("updated_at"), "thread_id").limit(most)


def first_per_id(threads: DataFrame) -> DataFrame:
    """Reconstruction targets: the first row by path of each thread that has one."""
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("path"))
    return threads.where("path is not null and path <> ''").withColumn("_n", n).where("_n = 1").drop("_n")


def account_list(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("account")
    for other in sources[1:]:
        out = out.union(other.select("account"))
    return out.where("account is not null").distinct()


#: The states of a file whose counters are reconstructed.
STATES = ("pending", "reconstructing", "reconstructed", "unrecoverable")


def reconstruction_status(sources: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: files by state, bytes done and in all, and the tokens for which reconstruction is the chosen evidence."""
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    files = sources.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATES], sum_("bytes_processed").alias("bytes_processed"), sum_("bytes_total").alias("bytes_total"))
    chosen = selection.where("source = 'reconstruction'").agg(sum_("reconstruction_tokens").alias("selected_tokens"))
    return files.crossJoin(chosen)  # two single rows


def kept_cursors(cursors: DataFrame, swapped: DataFrame) -> DataFrame:
    """cursors without those of files that were swapped, which are read anew."""
    return cursors.join(swapped.select("source").distinct(), "source", "left_anti")


def source_id(path: str) -> Column:
    """A file's id as a source: the hash of its path, which doesn't show the path."""
    return F.concat(F.lit("file-"), F.substring(F.sha2(F.col(path), 256), 1, 24))


def relative_id(path: str) -> Column:
    """A relative path as an id: its separators become underscores."""
    return F.replace(F.col(path), F.lit("/"), F.lit("_"))
