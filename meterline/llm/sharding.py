"""Sharding by a hierarchical weighted hash tree (operator 12), in DataFrame operations only.

A tree has regions, racks and shards. From the root down, each child of a node draws a number from the hash of its own
path and the row's id, divided by the child's weight, and the smallest wins (weighted rendezvous hashing); a child's
weight is the sum of its shards'. A row's draw for a child depends on nothing but that child, so a changed weight moves
rows into or out of the subtrees whose weights change and leaves all others alone. A shard that is added as a region of
its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import settle

#: Names to subtrees; at the bottom, shard numbers to weights.
Tree = dict

SHARDS, REGIONS, RACKS = 8, 2, 2
#: Hex digits of a draw's hash.
DIGITS = 13


def balanced(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Shards of weight 1 in order, as evenly as can be over racks, and those over regions; empty ones are left out."""
    tree: Tree = {}
    for i in range(shards):
        rack = i * regions * racks // shards
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[i] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, as a region with one rack."""
    return tree | {f"region_of_{shard}": {"rack0": {shard: weight}}}


def weight(node: Tree | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def cost(path: str, weight: float, key: Column) -> Column:
    """An exponential draw of a child for a row, with the child's weight as its rate."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}:"), key).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.log((h + 0.5) / F.lit(float(16**DIGITS))) / F.lit(weight)


def descend(node: Tree, key: Column, path: str = "") -> Column:
    """The shard of a key: one draw at each level, among the children of the node drawn before. Weights of 0 draw nothing."""
    children = [(n, f"{path}/{n}", child) for n, child in node.items() if weight(child) > 0]
    if not children:
        return F.lit(None).cast("int")
    drawn = F.array_min(F.array(*[F.struct(cost(p, weight(child), key), F.lit(i)) for i, (_, p, child) in enumerate(children)]))["col2"] if len(children) > 1 else F.lit(0)
    below = [descend(child, key, p) if isinstance(child, dict) else F.lit(n) for n, p, child in children]
    found = F.when(drawn == 0, below[0])
    for i, shard in enumerate(below[1:], 1):
        found = found.when(drawn == i, shard)
    return found.cast("int")


def key_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("string"), F.lit(""))


def sharded(docs: DataFrame, tree: Tree) -> DataFrame:
    """docs, all columns, with the shard of each row's doc_id in a column _shard; nothing is shuffled."""
    return docs.withColumn("_shard", descend(tree, key_of(docs)))


def write(docs: DataFrame, tree: Tree, folder: str, rows_a_file: int = 1_000_000) -> None:
    """Writes docs as Parquet, a folder a shard (`_shard=0`, ...)."""
    sharded(docs, tree).write.option("maxRecordsPerFile", rows_a_file).partitionBy("_shard").parquet(folder)


def shards(docs: DataFrame, tree: Tree | None = None, larger: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    The law is `key`: doc_id and the tree alone decide. size is the UTF-8 bytes of the text plus 1, text_crc32 the
    unsigned CRC-32 of these bytes; a null text counts as empty (size 1, crc 0). grown_shard is the shard in the larger
    tree, by default one with one more shard. A null id counts as the empty text; rows of one id share a shard, copies of
    a text under different ids need not. slot numbers the rows of a shard from 0 without gaps, by the MD5 of the id, the
    id, size and crc; rows that are equal in all these take following slots in any order. An empty table gives none.
    Only doc_id and text are read, whatever other columns there are.
    """
    tree = tree or balanced()
    larger = larger or grown(tree, SHARDS)
    key, text = key_of(docs), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = settle(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            descend(tree, key).alias("shard"),
            descend(larger, key).alias("grown_shard"),
            F.md5(key.cast("binary")).alias("turn"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    placed = numbered(rows, F.col("shard"), F.col("turn"), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("row"))
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), "grown_shard"
    )


#: The same for DuckDB: the tree as rows, one draw a level, CRC-32 byte by byte.
SQL = r"""
with recursive nodes(tree, parent, child, weight) as (values
  (8, '', '/region0', 4.0), (8, '', '/region1', 4.0),
  (8, '/region0', '/region0/rack0', 2.0), (8, '/region0', '/region0/rack1', 2.0),
  (8, '/region1', '/region1/rack0', 2.0), (8, '/region1', '/region1/rack1', 2.0),
  (8, '/region0/rack0', '/region0/rack0/0', 1.0), (8, '/region0/rack0', '/region0/rack0/1', 1.0),
  (8, '/region0/rack1', '/region0/rack1/2', 1.0), (8, '/region0/rack1', '/region0/rack1/3', 1.0),
  (8, '/region1/rack0', '/region1/rack0/4', 1.0), (8, '/region1/rack0', '/region1/rack0/5', 1.0),
  (8, '/region1/rack1', '/region1/rack1/6', 1.0), (8, '/region1/rack1', '/region1/rack1/7', 1.0)
), trees as (
  select * from nodes union all select 9, parent, child, weight from nodes union all values
  (9, '', '/region_of_8', 1.0), (9, '/region_of_8', '/region_of_8/rack0', 1.0), (9, '/region_of_8/rack0', '/region_of_8/rack0/8', 1.0)
), keys as (
  select distinct coalesce(cast(doc_id as varchar), '') key from {documents}
), costs as (
  select key, tree, parent, child,
         -ln((cast(cast('0x' || substr(md5(child || ':' || key), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0) / cast(weight as double) cost
  from keys, trees
), best as (
  select key, tree, parent, arg_min(child, cost) child from costs group by all
), leaves as (
  select a.key, a.tree, cast(regexp_extract(c.child, '[0-9]+$') as integer) shard
  from best a join best b on b.key = a.key and b.tree = a.tree and b.parent = a.child join best c on c.key = a.key and c.tree = a.tree and c.parent = b.child
  where a.parent = ''
), steps(i, k, c) as (
  select range, 0, range from range(256)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
), crcs as (
  select list(cast(c as bigint) order by i) t from steps where k = 8
), texts as (
  select distinct coalesce(text, '') text from {documents}
), sums as (
  select text, xor(list_reduce([cast(4294967295 as bigint)] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: cast('0x' || b as bigint)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) crc
  from texts, crcs
), placed as (
  select doc_id, cast(octet_length(encode(coalesce(d.text, ''))) + 1 as bigint) size, crc text_crc32, own.shard, larger.shard grown_shard
  from {documents} d join sums on sums.text = coalesce(d.text, '')
  join leaves own on own.tree = 8 and own.key = coalesce(cast(doc_id as varchar), '')
  join leaves larger on larger.tree = 9 and larger.key = coalesce(cast(doc_id as varchar), '')
)
select doc_id, size, text_crc32, 'key' law, shard,
       row_number() over (partition by shard order by md5(coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size, text_crc32) - 1 slot, grown_shard
from placed
"""
