"""A Python data source of lines of byte ranges of files: only what is new of a log is read.

Files are cut into ranges; a range has the lines that begin in it. A line that doesn't end yet, or is newer than a time,
ends what can be read of its file for now, so each range also says where it stopped: rows without a line. The lines that
count and the place from which to read on follow from these by one aggregate a file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tokens import MEASURES, valid
from .logs import strict_usage

SCHEMA = "source string, place long, line string, stopped boolean, bytes long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Bytes of a partition, and at most of a step in search of the end of its last line: a part of it, but for small ones.
RANGE_BYTES, STEP, STEPS, LEAST_STEP = 64 << 20, 1 << 20, 16, 256
TIMESTAMP = re.compile(rb'"timestamp"\s*:\s*"([^"]*)"')


class Range(NamedTuple):
    """Lines of a file that begin from `first` on and before `last`; the file was `length` long when it was listed."""

    source: str
    path: str
    first: int
    last: int
    length: int


class RangePartition(InputPartition):
    def __init__(self, own: Range) -> None:
        self.own = own


class LineRanges(DataSource):
    """Options: ranges, a JSON list of Ranges; newest, a time with zone, or nothing."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return LineRangeReader([Range(*x) for x in json.loads(self.options["ranges"])], self.options.get("newest"))


class LineRangeReader(DataSourceReader):
    def __init__(self, ranges: list[Range], newest: str | None) -> None:
        self.ranges, self.newest = ranges, newest

    def partitions(self) -> list[InputPartition]:
        return [RangePartition(x) for x in self.ranges]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        yield lines_of(partition.own, datetime.fromisoformat(self.newest) if self.newest else None)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that the workers' libraries can reach by its address; without a scheme, or with file:, a local one."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def lines_of(own: Range, newest: datetime | None) -> pa.RecordBatch:
    """The ended lines of a range, with the place of their first byte, and a row that says where it stopped."""
    with opened(own.path) as file:
        length = min(own.length, file.size())
        lo = max(own.first - 1, 0)
        data = file.read_at(max(min(own.last, length) - lo, 0), lo)
        start = 0 if own.first == 0 or data[:1] == b"\n" and own.first == lo else None
        if own.first:  # a line that began before belongs to the range before
            end = data.find(b"\n")
            start = end + 1 if end >= 0 else len(data)
        read = len(data)
        while lo + start < min(own.last, length) and not data.endswith(b"\n") and lo + len(data) < length:
            step = min(STEP, max(LEAST_STEP, (own.last - own.first) // STEPS))
            more = file.read_at(min(step, length - lo - len(data)), lo + len(data))
            read += len(more)
            end = more.find(b"\n")
            data += more if end < 0 else more[: end + 1]
            if not more:
                break
    begins, lines = [], []
    at, ended = start, data.rfind(b"\n") + 1
    for line in data[start:ended].split(b"\n")[:-1] if ended > start else []:
        if newest is not None and newer(line, newest):
            break
        begins.append(lo + at)
        lines.append(line)
        at += len(line) + 1
    stopped = at < len(data) and lo + at < own.last
    place = lo + at if stopped else max(lo + at, min(own.last, length))
    filled = [i for i, line in enumerate(lines) if line.strip(b"\r")]
    n = len(filled)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([own.source] * (n + 1)),
            pa.array([*(begins[i] for i in filled), place], pa.int64()),
            pa.array([*(lines[i].removesuffix(b"\r").decode(errors="replace") for i in filled), None], pa.string()),
            pa.array([*[None] * n, stopped], pa.bool_()),
            pa.array([*[None] * n, read], pa.int64()),
        ],
        NAMES,
    )


def newer(line: bytes, newest: datetime) -> bool:
    """Whether a line's first timestamp is after a time; lines without one that can be read aren't."""
    found = TIMESTAMP.search(line)
    if not found:
        return False
    try:
        at = datetime.fromisoformat(found[1].decode())
    except ValueError:
        return False
    return (at if at.tzinfo else at.replace(tzinfo=UTC)) > newest


def ranges(files: list[tuple[str, str, int, int]], size: int = RANGE_BYTES) -> list[Range]:
    """Files (source, path, first byte to read, length) in ranges of at most so many bytes."""
    return [Range(source, path, at, min(at + size, length), length) for source, path, first, length in files for at in range(first, length, size)]


def read_ranges(spark: SparkSession, own: list[Range], newest: datetime | None = None) -> DataFrame:
    """Lines (source, place, line) and stops (source, place, stopped, bytes) of ranges."""
    spark.dataSource.register(LineRanges)
    reader = spark.read.format("line_ranges").option("ranges", json.dumps(own))
    return (reader.option("newest", newest.isoformat()) if newest else reader).load()


def stops(rows: DataFrame) -> DataFrame:
    """(source, next, bytes): where each file is to be read on: where its first range stopped, else its end; and what was read."""
    ends = rows.where("line is null").groupBy("source")
    return ends.agg(F.coalesce(F.min(F.when(F.col("stopped"), F.col("place"))), F.max("place")).alias("next"), F.sum("bytes").alias("bytes"))


def settled_lines(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """(source, line_no, line) of the lines before the place where their file stopped; a line's place is its number."""
    return rows.where("line is not null").join(stops, "source").where(F.col("place") < F.col("next")).select("source", F.col("place").alias("line_no"), "line")


def candidates(lines: DataFrame) -> DataFrame:
    """(source, line_no, at, measures) of usage candidates: counts with a time and a possible last usage.

    Lines are looked at by a substring before any is parsed.
    """
    parsed = lines.where(F.col("line").contains('"type":"token_count"')).select(
        "source", "line_no", F.try_to_timestamp(F.get_json_object("line", "$.timestamp")).alias("at"), F.get_json_object("line", "$.payload.info.last_token_usage").alias("there"), *strict_usage("$.payload.info.last_token_usage")
    )
    return parsed.where("at is not null and there is not null").where(valid()).select("source", "line_no", "at", *MEASURES)
