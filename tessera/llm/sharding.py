"""Sharding by a hierarchical weighted hash tree.

A topology is a list of regions, a region a list of racks, a rack a list of
(shard, weight). A row descends from the root: at each node every child draws
``-ln(u) / weight`` with ``u`` a hash of (key, node name, child name), and the
least draw wins. A child's draw depends on nothing but its own name and
weight, so changing one weight moves rows only into or out of the subtrees
whose weights change; inside an untouched subtree nothing moves. ``grown``
adds a shard as a region of its own, which leaves every other weight alone:
rows move only into the new shard.

Defined results: a NULL key draws like the text "null"; equal keys share a
shard; NULL text has no bytes; extra columns are ignored by ``shard_rows``
(it returns only its own columns); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Topology = list[list[list[tuple[int, float]]]]

#: Groups per shard that number its rows; each is sorted by one task.
SLOT_BUCKETS = 1024


def even_topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Topology:
    """Shards of weight 1 filled into racks and regions in order."""
    racks = [[(s, 1.0) for s in range(r, min(r + shards_per_rack, shards))]
             for r in range(0, shards, shards_per_rack)]
    return [racks[r:r + racks_per_region] for r in range(0, len(racks), racks_per_region)]


def grown(topology: Topology, weight: float = 1.0) -> Topology:
    """The topology with one more shard, in a region of its own."""
    new = 1 + max(s for region in topology for rack in region for s, _ in rack)
    return [*topology, [[(new, weight)]]]


def _unit(key: Column, path: str) -> Column:
    """A uniform number in (0, 1) from 52 bits of md5(path | key)."""
    digest = F.md5(F.concat(F.lit(path + "|"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def _least_draw(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; an equal draw goes to the earlier child."""
    children = [c for c in children if c[1] > 0]
    if not children:
        raise ValueError("a node needs a child of positive weight")
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct((-F.ln(_unit(key, path)) / F.lit(w)).alias("d"), F.lit(i).alias("i"))
             for i, (path, w, _) in enumerate(children)]
    won = F.least(*draws)["i"]
    out = F.when(won == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(won == i, value)
    return out


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard a key descends to."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions = []
    for g, region in enumerate(topology):
        racks = []
        for r, rack in enumerate(region):
            shards = [(f"{g}/{r}/{s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"{g}/{r}", sum(w for _, w in rack), _least_draw(key, shards) if rack else None))
        racks = [x for x in racks if x[1] > 0]
        regions.append((f"{g}", sum(x[1] for x in racks), _least_draw(key, racks) if racks else None))
    return _least_draw(key, [x for x in regions if x[1] > 0])


def shard_rows(df: DataFrame, topology: Topology, key: str = "doc_id", text: str = "text",
               slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Slots are gapless per shard, in order of (bucket, key, checksum, size); the
    bucket is a hash of key and checksum, so no task sorts more than a
    ``slot_buckets``-th of a shard. The table of bucket sizes has at most shards
    x ``slot_buckets`` rows, which bounds what the join broadcasts. Text
    is dropped before anything is shuffled."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias(key), (F.octet_length(whole) + 1).cast("bigint").alias("size"),
                     F.crc32(whole).alias("text_crc32"))
    tag = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("|"), F.col("text_crc32").cast("string"))
    rows = rows.select(
        "*", F.lit("key").alias("law"), shard_of(F.col(key), topology).cast("int").alias("shard"),
        shard_of(F.col(key), grown(topology)).cast("int").alias("grown_shard"),
        F.pmod(F.conv(F.substring(F.md5(tag), 1, 12), 16, 10).cast("bigint"),
               F.lit(slot_buckets)).cast("int").alias("__bucket"))
    sizes = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("__at", F.row_number().over(inside).cast("bigint"))
    return (numbered.join(F.broadcast(sizes), ["shard", "__bucket"])
            .select(key, "size", "text_crc32", "law", "shard",
                    (F.col("__before") + F.col("__at") - 1).alias("slot"), "grown_shard"))
