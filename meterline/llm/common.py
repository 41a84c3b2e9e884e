"""What the training-data operators share: table access, checkpoints, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark allows no more buckets.
MOST_BUCKETS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, and so the memory of a Python worker with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors can reach.

    Only a session on one machine that names none gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str) -> tuple[str, str]:
    """(name, folder) of a table with the rows of df, in buckets by key, in the shared folder: what meets it by the key
    is moved to it."""
    spark = df.sparkSession
    name = f"stretches_{uuid.uuid4().hex}"
    where, n = f"{shared_folder(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(min(n, MOST_BUCKETS), key).option("path", where).option("compression", "none").saveAsTable(name)
    return name, where


def unbucket(spark: SparkSession, name: str, where: str) -> None:
    """Drops a table of bucketed(), files included."""
    spark.sql(f"DROP TABLE {name}")
    discard(spark, where)


def discard(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder, and where. Unlike settle() it gives back the disk of df's shuffles at once."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    where, before = f"{shared_folder(spark)}/stored_{uuid.uuid4().hex}", spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "none").parquet(where)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(where), where


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_arrow(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch; an empty partition stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch) if batch.num_rows else None
            if out is None:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """The rows of all batches in pieces of at most `most` bytes of a text column, or of one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
        lo = 0
        for i, n in enumerate(sizes):
            if size + n > most and (held or i > lo):
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, i
            size += n
        if len(sizes) > lo:
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


SALTS = 32


def met_by(rows: DataFrame, few: DataFrame, key: str, own: str) -> DataFrame:
    """rows joined with few, which has a row a key, where one key may have any share of the rows.

    few is repeated SALTS times, and rows are dealt by the key and a hash of a column of their own. Both are shuffled:
    Spark takes few for as small as it was before it was repeated, and would broadcast SALTS times its threshold.
    """
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(few.select("*", salts).hint("merge"), [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    `edges` has long columns a and b. Large-star and small-star steps alternate, so the rounds grow with the
    logarithm of the longest path. Each step is one partial aggregation and one join that AQE may split at a hot
    node; states are checkpointed. Self-loops, repeats and nulls are dropped.
    """
    edges = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = settle(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = settle(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        digest = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
        before, after = edges.agg(*digest).first(), small.agg(*digest).first()
        edges = small
        if before == after:
            break
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
