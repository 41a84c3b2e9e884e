"""Mixing sources to target weights by hash-threshold histograms (operator 6), in DataFrame operations only.

Tokens are summed by source and hash bucket; the running sum over a source's buckets shows the one bucket in which
the budget ends; only that bucket's rows go on to the next, finer histogram, until a bucket is one hash value. What
is left is one threshold per source, by which the rows are filtered where they are, without sorting them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

WEIGHTS = (5, 2, 1)
MOST = 3
HASH_BITS, STEP_BITS = 60, 12


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, known, size, h): words of the text and a 60-bit hash of the id; known is false for no source."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.col("source").isNotNull().alias("known"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """(src, known, source_size, target, passes, rest) of each source.

    Sources in code point order, null last, have the weights 5, 2, 1 in turn and share the sum of all sizes. A target
    stops at 3 times its source's size; the excess goes to the others by weight. Sources fill up in order of size over
    weight, so the share of one unit of weight after the k fullest is (sum of sizes - their caps) / (weights left).
    """
    everything = Window.partitionBy(F.lit(0))
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), F.desc("known"), "src").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(everything.orderBy(F.desc("known"), F.col("src").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = (
        sized.groupBy("src", "known")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * MOST)
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("unit", (F.col("all_size") - F.coalesce(F.sum("cap").over(by_fill), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_fill), F.lit(0))).cast("double"))
    )
    # The first source that isn't filled sets the share of a unit for all that follow it.
    level = F.min(F.when(F.col("cap") > F.col("unit") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("unit")))).over(everything)["unit"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("long")
    return (
        ranked.withColumn("target", target)
        .withColumn("passes", passes)
        .select("src", "known", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with cut: rows of a source with h < cut are taken once more. Sums of equal hashes stay together.

    The hash value at which the rest is reached is taken if its middle lies before the rest.
    """
    rows, bound = sized, goals.where("rest > 0").select("src", "known", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        running = Window.partitionBy("src", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        filled = (
            rows.groupBy("src", "known", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"))
            .join(bound.select("src", "known", "rest", "before"), ["src", "known"])
            .withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0)))
            .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
        )
        bound = settle(filled.select("src", "known", "rest", "before", "n", F.col("bucket").alias("prefix")))
        if shift:
            rows = rows.withColumn("prefix", F.shiftright("h", shift)).join(bound.select("src", "known", "prefix"), ["src", "known", "prefix"]).drop("prefix")
            rows = settle(rows)
    cut = F.when(2 * F.col("before") + F.col("n") < 2 * F.col("rest"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    found = bound.select("src", "known", cut.alias("cut"))
    return goals.join(found, ["src", "known"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs.

    taken is size times the passes over the source, plus size once more where the hash is below the threshold. Null
    texts have size 0; null sources are a source of their own, which comes last; a null id hashes as the empty text;
    rows that repeat an id share its hash and so its fate. An empty table gives none. Only doc_id, text and source are
    read. A source's sum differs from its target by half the boundary hash's size at most.
    """
    sized = settle(sizes(docs))
    goals = settle(thresholds(sized, settle(targets(sized))))
    return sized.join(goals, ["src", "known"]).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + (F.col("h") < F.col("cut")).cast("long"))).alias("taken"))


#: The same selection for DuckDB, by sorting.
SQL = r"""
with sized as (
  select doc_id, coalesce(source, '') src, source is not null known,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h
  from {documents}
), sources as (
  select src, known, cast(sum(size) as bigint) source_size from sized group by all
), ranked as (
  select *, source_size * 3 cap,
         case (row_number() over (order by known desc, encode(src)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end weight
  from sources
), units as (
  select *, cast(cast(sum(source_size) over () - coalesce(sum(cap) over before, 0) as bigint) as double)
            / cast(cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as bigint) as double) unit
  from ranked
  window before as (order by cast(cap as double) / weight, known desc, src rows between unbounded preceding and 1 preceding)
), goals as (
  select src, known, source_size,
         least(cast(cap as double), coalesce((select arg_min(unit, cast(cap as double) / weight) from units where cap > unit * weight) * weight, cast(cap as double))) target
  from units
), rests as (
  select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end passes,
         target - passes * source_size rest
  from goals
), hashes as (
  select src, known, h, sum(size) n, sum(sum(size)) over (partition by src, known order by h) - sum(size) before
  from sized group by src, known, h
)
select doc_id, size, source_size, target,
       size * (passes + case when 2 * before + n < 2 * rest then 1 else 0 end) taken
from sized join rests using (src, known) join hashes using (src, known, h)
"""
