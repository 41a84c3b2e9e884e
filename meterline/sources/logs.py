"""Session logs: JSON lines, read with their place, parsed into one relation of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import MEASURES

#: Fields of a usage object, and the names under which cache writes occur.
USAGE = {"input": "input_tokens", "cached_input": "cached_input_tokens", "output": "output_tokens", "reasoning_output": "reasoning_output_tokens", "total": "total_tokens"}
CACHE_WRITES = ("cache_write_input_tokens", "cache_write_tokens", "input_cache_write_tokens")
PARENT = "$.payload.source.subagent.thread_spawn"


def ended_lines(files: DataFrame) -> DataFrame:
    """Files of (source, value) as lines. Only lines that end are records; what is still being written is left out."""
    lines = F.split(F.regexp_replace("value", r"[^\n]*\z", ""), "\n")
    rows = files.select("source", F.posexplode(lines).alias("line_no", "line")).where("line <> ''")
    return rows.select("source", F.col("line_no").cast("long").alias("line_no"), F.rtrim(F.col("line"), F.lit("\r")).alias("line"))


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "rollout-*.jsonl") -> DataFrame:
    """(source, line_no, line) of files under a folder, or of some files. A file is read as a whole, as a line's place is
    its identity."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").format("text").load(path)
    return ended_lines(files.select(F.col("_metadata.file_path").alias("source"), "value"))


def written_files(spark: SparkSession, path: str, pattern: str = "rollout-*.jsonl") -> DataFrame:
    """(source, identity, length, path) of the files under a folder, without their contents."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).format("binaryFile").load(path)
    source = F.col("_metadata.file_path")
    return files.select(source.alias("source"), source.alias("identity"), "length", "path")


def stream_lines(spark: SparkSession, path: str, pattern: str = "rollout-*.jsonl", files_per_trigger: int = 64) -> DataFrame:
    """read_lines as a stream of new files; whole files arrive together, so that a file's order is known.

    The file source takes each path once, so this is for files that grow no more; streaming.ingest.tail reads those that grow.
    """
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return ended_lines(reader.load(path).select(F.col("_metadata.file_path").alias("source"), "value"))


def _number(path: str, line: str) -> Column:
    return F.expr(f"try_cast(get_json_object({line}, '{path}') as bigint)")


def lenient_usage(path: str, prefix: str, line: str = "line") -> list[Column]:
    """A usage object as seven columns: numbers or numeric text; cache writes by any of their names; a total by default
    of input and output. All are null without the object."""
    at = lambda f: _number(f"{path}.{f}", line)
    there = F.expr(f"get_json_object({line}, '{path}')").startswith("{")
    own = {m: F.coalesce(at(f), F.lit(0)) for m, f in USAGE.items()}
    named = [F.expr(f"get_json_object({line}, '{path}.{f}')") for f in CACHE_WRITES]
    written = F.coalesce(*named)
    own["cache_write_input"] = F.coalesce(written.try_cast("bigint"), F.lit(0))
    own["cache_write_observed"] = F.when(written.isNotNull(), own["input"]).otherwise(F.lit(0))
    own["total"] = F.coalesce(at(USAGE["total"]), own["input"] + own["output"])
    return [F.when(there, own[m]).cast("bigint").alias(prefix + m) for m in MEASURES]


def strict_usage(path: str, prefix: str = "", line: str = "line") -> list[Column]:
    """A usage object as seven columns, as sampled records have it: whole numbers from 0 to 2**63 - 1 that are JSON
    numbers; anything else counts as absent, and what is absent as 0, the total too. Rows that aren't valid() then are
    no usage. Cache writes have one name only, and are observed if it holds such a number."""
    node = lambda f: F.try_variant_get(F.try_parse_json(F.col(line)), f"{path}.{f}", "variant")
    whole = lambda f: F.when(F.schema_of_variant(node(f)) == "BIGINT", F.try_variant_get(F.try_parse_json(F.col(line)), f"{path}.{f}", "bigint"))
    at = lambda f: F.when(whole(f) >= 0, whole(f))
    own = {m: F.coalesce(at(f), F.lit(0)) for m, f in USAGE.items()}
    written = at(CACHE_WRITES[0])
    own["cache_write_input"] = F.coalesce(written, F.lit(0))
    own["cache_write_observed"] = F.when(written.isNotNull(), own["input"]).otherwise(F.lit(0))
    return [own[m].cast("bigint").alias(prefix + m) for m in MEASURES]


def records(lines: DataFrame) -> DataFrame:
    """Lines as records: kind, time, session, parent, model, folder, task and usage. Lines that aren't JSON have no kind."""
    json = lambda p: F.get_json_object("line", p)
    filled = lambda c: F.when(c != "", c)
    kind, payload = json("$.type"), json("$.payload.type")
    return lines.select(
        "source",
        "line_no",
        F.when(kind.isin("session_meta", "turn_context"), kind).when((kind == "event_msg") & payload.isin("task_started", "token_count"), payload).alias("kind"),
        F.try_to_timestamp(json("$.timestamp")).alias("at"),
        filled(json("$.payload.id")).alias("session_id"),
        F.coalesce(json(f"{PARENT}.parent_thread_id"), json("$.payload.parent_thread_id")).alias("parent_id"),
        filled(json("$.payload.model")).alias("model"),
        filled(json("$.payload.cwd")).alias("cwd"),
        json("$.payload.turn_id").alias("turn_id"),
        _number("$.payload.started_at", "line").alias("started_at"),
        *lenient_usage("$.payload.info.total_token_usage", "total_"),
        *lenient_usage("$.payload.info.last_token_usage", "last_"),
    )
