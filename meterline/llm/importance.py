"""Target-distribution importance resampling by a distinct-feature dictionary (operator 11).

Texts are read in blocks of bounded size. A block has each of its distinct features once, with their counts in each of
its documents as places among them. Features of all blocks are counted as strings; each distinct one is hashed once, and
the counts of the buckets give the gains. The dictionary of gains is joined with the blocks' features, and each block
gets its own back to weigh its documents. A feature has one row a block at most, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import blocks, settle, small_batches, texts
from .suffix_tree import pack, unpack

RUNS, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
BYTES_AT_ONCE = 10 << 20
#: Lower-cases A-Z; of ASCII only digits and letters are parts of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def features(own: list[bytes], runs: int) -> Iterator[bytes]:
    """All runs of 1 to `runs` words, joined by one space."""
    return chain(own, *([b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] for k in range(2, runs + 1)))


RECORD = "block long, features array<binary>, counts array<long>, payload binary"


def records(docs: DataFrame, runs: int) -> DataFrame:
    """Of each block of docs (ref, doc_id, text): distinct features, their counts, and which its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, BYTES_AT_ONCE):
            number: dict[bytes, int] = {}
            codes, n_words = [], []
            for t in texts(rows.column("text").combine_chunks()):
                own = words(t)
                n_words.append(len(own))
                codes.append(np.array([number.setdefault(f, len(number)) for f in features(own, runs)], np.int64))
            length = np.array([len(c) for c in codes])
            code = np.concatenate(codes)
            size = max(len(number), 1)
            pair, n = np.unique(np.repeat(np.arange(len(length)), length) * size + code, return_counts=True)
            doc_id = rows.column("doc_id").combine_chunks()
            payload = pack(doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), np.array(n_words), length, np.diff(pair, prepend=0), n)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("ref").slice(0, 1).combine_chunks(),
                    pa.array([list(number)], pa.list_(pa.binary())),
                    pa.array([np.bincount(code, minlength=len(number)).astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                ["block", "features", "counts", "payload"],
            )

    return docs.mapInArrow(run, RECORD)


WEIGHED = "ref long, doc_id long, n_words long, n_features long, weight long"


def weighed(rows: DataFrame) -> DataFrame:
    """Documents of blocks (block, payload, gains), where gains has (place, gain) of each of the block's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                ids, has_id, n_words, length, pair, n = unpack(payload)
                found = batch.column("gains").slice(i, 1).flatten()
                gain = np.zeros(max(len(found), 1), np.int64)
                gain[found.field("place").to_numpy()] = found.field("gain").to_numpy()
                pair = np.cumsum(pair.astype(np.int64))
                weight = np.zeros(len(ids), np.int64)
                np.add.at(weight, pair // len(gain), gain[pair % len(gain)] * n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("block")[i].as_py() + np.arange(len(ids), dtype=np.int64)),
                        pa.array(ids.view(np.int64), mask=~has_id.astype(bool)),
                        *(pa.array(x.astype(np.int64)) for x in (n_words, length, weight)),
                    ],
                    ["ref", "doc_id", "n_words", "n_features", "weight"],
                )

    return rows.mapInArrow(run, WEIGHED)


def listed(recorded: DataFrame) -> DataFrame:
    """(block, place, feature, n) of each distinct feature of each block."""
    return recorded.select("block", F.posexplode(F.arrays_zip("features", "counts")).alias("place", "f")).select("block", "place", F.col("f.features").alias("feature"), F.col("f.counts").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, gain) of each distinct feature of documents, from listed() of both tables."""
    zero = F.lit(0).cast("long")
    both = documents.select("feature", F.col("n").alias("s"), zero.alias("t")).union(target.select("feature", zero, "n"))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    dictionary = settle(counted.withColumn("bucket", (F.crc32("feature") % buckets).cast("int")))
    sums = settle(dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    of_all = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * float(of_all.s + buckets) / ((F.col("s") + 1).cast("double") * float(of_all.t + buckets))
    gain = F.floor(1000 * F.log(ratio)).cast("long").alias("gain")
    return dictionary.where("s > 0").select("feature", "bucket").join(F.broadcast(sums.select("bucket", gain)), "bucket").select("feature", "gain")  # a row a bucket


def weights(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(ref, doc_id, n_words, n_features, weight) of each row of docs, weighed against the texts of target."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    text = F.col("text").cast("string").alias("text")
    recorded = settle(records(docs.select(F.monotonically_increasing_id().alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), text), runs))
    wanted = records(target.select(F.monotonically_increasing_id().alias("ref"), F.lit(None).cast("long").alias("doc_id"), text), runs)
    own = listed(recorded)
    found = own.join(gains(own, listed(wanted), buckets), "feature").groupBy("block").agg(F.collect_list(F.struct("place", "gain")).alias("gains"))
    small_batches(spark, 4)  # a block's row can have some megabytes
    return settle(weighed(recorded.select("block", "payload").join(found, "block", "left")))


def resampled(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs.

    Of the N rows with least_words words or more, the floor(share * N / 100) of the highest scores (ties: smaller id,
    null last, then the order of the rows) are drawn and ranked from 1; the others have rank null. Null texts have no
    words: no features, weight 0, and a score by the id alone; a null id counts as the empty text in the hash. Repeated
    rows count as often as they occur. An empty table gives none; without target texts all gains are of counts of 0. Only
    doc_id and text are read, whatever other columns there are.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = settle(weights(docs, target, runs, buckets).withColumn("score", F.col("weight") + luck))
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = numbered(scored.where(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("ref"))
    draws = share * scored.where(F.col("n_words") >= least_words).count() // 100
    rank = F.when(F.col("place") < draws, F.col("place") + 1).alias("rank")
    return placed.select(*columns, rank).union(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **parameters: int) -> DataFrame:
    """The rows of docs, all columns, whose id is drawn; rows that share an id go together."""
    ids = resampled(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")


#: The same for DuckDB, with CRC-32 byte by byte.
SQL = r"""
with recursive steps(i, k, c) as (
  select range, 0, range from range(256)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
), crcs as (
  select list(cast(c as bigint) order by i) t from steps where k = 8
), docs as (
  select row_number() over () row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words
  from {documents}
), wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word
  from {benchmark}
), had as (
  select row, unnest(words) word from docs
), counted as (
  select word, sum(s) s, sum(t) t
  from (select word, count(*) s, 0 t from had group by word union all select word, 0, count(*) from wanted group by word) group by word
), dictionary as (
  select word, s, t_, xor(list_reduce([cast(4294967295 as bigint)] || list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda b: cast('0x' || b as bigint)),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 bucket
  from (select word, s, t t_ from counted), crcs
), sums as (
  select bucket, cast(sum(s) as double) s, cast(sum(t_) as double) t from dictionary group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln((t + 1) * ((select sum(s) from sums) + 10000) / ((s + 1) * ((select sum(t) from sums) + 10000)))) as bigint) gain from sums
), weights as (
  select row, sum(gain) weight from had join dictionary using (word) join gains using (bucket) group by row
), scored as (
  select row, doc_id, len(words) n_features, cast(coalesce(weight, 0) as bigint) weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as double) + 0.5) / 4294967296.0))) as bigint) score
  from docs left join weights using (row)
), ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, row) place from scored
)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and place <= 10 * (select count(*) from docs where len(words) >= 20) // 100 then place end rank
from ranked
"""
