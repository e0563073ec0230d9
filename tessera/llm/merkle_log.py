"""Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` (NULL) or its UTF-8 byte
count, a colon and the value. Rows of one group (``lang``) stand in order of their key; every two
consecutive nodes become the digest of both, a last one without a partner the digest of itself, until
one is left: the group's root. The groups' roots, NULL first and then bytewise by name, become the root alike.

Aligned builders write the tree: a builder takes ``2 ** block_levels`` consecutive nodes that start at a
multiple of that number, and appends each node the moment it is complete, so a segment of the log is
a subtree in postorder. Where a node stands follows from its level, its index and the number of leaves
(``position``); a sibling is read at that place, nothing is searched. A segment's last node is
a leaf of the next tier, so a tier is a ``2 ** block_levels``-th of the one below and no task, group or
driver ever holds more than one segment. Proofs go the other way: each segment of a tier hands its
children the siblings above them.

Ranks within a group come from one range shuffle of digests (texts are hashed where they are read) and the
counts of its partitions; rows that are equal in group, key and digest are told apart by where they were read, so a
group of repeated rows is spread like any other.

Defined results: a NULL key or group comes first and is a value like any other; NULL fields are ``-``; an empty
text is ``0:``; rows that share group and key stand in order of their digests; repeated rows are leaves each; extra columns are
ignored; an empty table has no rows, no segments and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Levels of one builder's subtree.
BLOCK_LEVELS = 10
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` or ``<bytes>:<value>``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


# --- the log of one tree


def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def log_size(n: int, height: int) -> int:
    """Nodes of a tree of ``n`` leaves raised to ``height``."""
    return 2 * n - n.bit_count() + height - _whole_levels(n) if n else 0


def _whole_levels(n: int) -> int:
    """The level of the last complete node after ``n`` leaves: the trailing zeros of n."""
    return (n & -n).bit_length() - 1


def position(level: int, index: int, n: int) -> int:
    """Where node ``index`` of ``level`` stands in the log of ``n`` leaves.

    Before leaf i stand i leaves and i - popcount(i) complete inner nodes, and a complete node
    follows its last leaf by its level. Nodes that lack leaves are written last, from the lowest up."""
    end = (index + 1) << level
    if end <= n:
        last = end - 1
        return 2 * last - last.bit_count() + level
    return 2 * n - n.bit_count() + level - _whole_levels(n) - 1


def append_all(leaves: list[str], height: int) -> list[str]:
    """The log of a subtree: nodes in the order in which they are complete."""
    log, left = [], [""] * (height + 1)
    for i, node in enumerate(leaves):
        level = 0
        log.append(node)
        while level < height and (i >> level) & 1:
            node = digest(left[level], node)
            level += 1
            log.append(node)
        left[level] = node
    n = len(leaves)
    level = _whole_levels(n)
    node = left[level]
    while level < height:  # what lacks leaves
        lone = not ((n - 1) >> level) & 1
        node = digest(node) if lone else digest(left[level], node)
        level += 1
        log.append(node)
    return log


def siblings(i: int, n: int, height: int, log: list[str]) -> list[str]:
    """Per level ``L``, ``R`` (the side of the sibling) and its digest, or ``-`` for a node without one."""
    out = []
    for level in range(height):
        at = (i >> level) ^ 1
        if at << level >= n:
            out.append("-")
        else:
            out.append(("L" if at & 1 == 0 else "R") + log[position(level, at, n)])
    return out


def fold(node: str, path: str) -> str:
    """The root that a leaf's digest and its proof give."""
    at = 0
    while at < len(path):
        side = path[at]
        if side == "-":
            node, at = digest(node), at + 1
        else:
            other, at = path[at + 1:at + 65], at + 65
            node = digest(other, node) if side == "L" else digest(node, other)
    return node


# --- segments as Spark jobs


def _height(n: int, levels: int) -> int:
    """How far a segment is raised: to one node of the next tier, or to the root of its tree."""
    return min(levels, (n - 1).bit_length())


def _hexes(data: bytes) -> list[str]:
    text = data.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _tier(nodes: DataFrame, levels: int, extra: list[tuple[str, str]], name: str) -> DataFrame:
    """``tree, block, n, count, root, log`` and an array of each extra column; one row per segment, written once.

    ``nodes`` has ``tree, at, n, digest``: node number ``at`` of the ``n`` of its tree."""
    import pyarrow as pa

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n, tree, block = (table.column(c)[0].as_py() for c in ("n", "tree", "block"))
        leaves = [d.hex() for d in table.column("digest").to_pylist()]
        log = append_all(leaves, _height(n, levels))
        first = {"tree": pa.array([tree], pa.int64()), "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()),
                 "count": pa.array([len(leaves)], pa.int64()), "root": pa.array([bytes.fromhex(log[-1])], pa.binary()),
                 "log": pa.array([bytes.fromhex("".join(log))], pa.binary())}
        for c, _ in extra:
            values = table.column(c).combine_chunks()
            values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
            first[c] = pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), values)
        return pa.table(first)

    schema = "tree long, block long, n long, count long, root binary, log binary" + "".join(f", `{c}` array<{t}>" for c, t in extra)
    rows = nodes.select("tree", F.shiftright("at", levels).alias("block"), "at", "n", "digest", *[F.col(f"`{c}`") for c, _ in extra])
    path = scratch_path(nodes.sparkSession, name)
    rows.groupBy("tree", "block").applyInArrow(build, schema).write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


@dataclass
class Forest:
    """Trees as tiers of segments; a tree's root is in the tier where its nodes fit one segment."""
    tiers: list[DataFrame]
    levels: int

    def roots(self) -> DataFrame:
        """``tree, root`` of every tree."""
        most = 1 << self.levels
        parts = [t.where(F.col("n") <= most).select("tree", "root") for t in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def with_paths(self, above: DataFrame) -> DataFrame:
        """The segments of the lowest tier with ``path`` (and what else ``above`` has), the proof from their root upwards.

        ``above`` has ``tree, path, ...``: the proof of each tree's root."""
        most, levels, rest = 1 << self.levels, self.levels, [c for c in above.columns if c not in ("tree", "path")]
        handed = None
        for t, tier in reversed(list(enumerate(self.tiers))):
            whole = tier.where(F.col("n") <= most).join(above, "tree")
            if handed is not None:
                whole = whole.unionByName(tier.where(F.col("n") > most).join(handed, ["tree", "block"]))
            if t == 0:
                return whole
            handed = _children(whole, levels, rest)


def _children(segments: DataFrame, levels: int, rest: list[str]) -> DataFrame:
    """``tree, block, path`` of each child of the segments, with the columns ``rest`` of the segment."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                log = _hexes(row["log"])
                h = _height(row["n"], levels)
                for lo in range(0, row["count"], 256):
                    at = range(lo, min(lo + 256, row["count"]))
                    out = {"tree": [row["tree"]] * len(at), "block": [(row["block"] << levels) + i for i in at],
                           "path": ["".join(siblings(i, row["count"], h, log)) + row["path"] for i in at]}
                    for c in rest:
                        out[c] = [row[c]] * len(at)
                    yield pa.RecordBatch.from_pydict(out)

    cols = ["tree", "block", "n", "count", "log", "path", *rest]
    schema = "tree long, block long, path string" + "".join(f", `{c}` {segments.schema[c].dataType.simpleString()}" for c in rest)
    return segments.select(*cols).mapInArrow(run, schema)


def _forest(nodes: DataFrame, levels: int, extra: list[tuple[str, str]], name: str) -> Forest:
    tiers = [_tier(nodes, levels, extra, f"{name}-0")]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1 << levels:
        up = tiers[-1].where(F.col("n") > 1 << levels).select(
            "tree", F.col("block").alias("at"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"), F.col("root").alias("digest"))
        tiers.append(_tier(up, levels, [], f"{name}-{len(tiers)}"))
    return Forest(tiers, levels)


# --- the manifest


def _ranked(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """``leaves`` with ``tree, at, n``, and ``tree, at, n`` of the trees themselves among their number.

    ``leaves(group, key, digest, ...)`` are written once, sorted by ranges and numbered by the counts of the
    range partitions; a tree is named by the number of its first row, so trees are in order of their groups."""
    spark = leaves.sparkSession
    first = scratch_path(spark, f"{name}-leaves")
    leaves.withColumn("__read", F.monotonically_increasing_id()).write.parquet(first)
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("__read")]
    second = scratch_path(spark, f"{name}-sorted")
    (spark.read.parquet(first).repartitionByRange(*order).sortWithinPartitions(*order).drop("__read")
     .withColumn("__row", F.monotonically_increasing_id()).write.parquet(second))
    rows = spark.read.parquet(second).withColumn("__part", F.shiftright("__row", 33))
    # one row per partition and group in it: at most partitions + groups
    runs = rows.groupBy("group", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy("group").orderBy("__part")
    whole = Window.partitionBy("group")
    runs = runs.select(F.col("group").alias("__group"), F.col("__part").alias("__in"), "__first", "__count",
                       (F.sum("__count").over(before) - F.col("__count")).alias("__before"),
                       F.sum("__count").over(whole).alias("n"), F.min("__first").over(whole).alias("tree")).checkpoint()
    ranked = rows.join(runs, (F.col("__part") == F.col("__in")) & F.col("group").eqNullSafe(F.col("__group"))).select(
        *leaves.columns, "tree", (F.col("__row") - F.col("__first") + F.col("__before")).alias("at"), "n")
    # trees among themselves: by the partition in which they begin, then in it
    trees = runs.where(F.col("__first") == F.col("tree")).select("tree", "__in")
    starts = trees.groupBy("__in").agg(F.count(F.lit(1)).alias("__trees"))
    starts = starts.select("__in", (F.sum("__trees").over(Window.orderBy("__in")) - F.col("__trees")).alias("__base"))
    number = F.row_number().over(Window.partitionBy("__in").orderBy("tree")) - 1
    trees = trees.withColumn("__at", number).join(starts, "__in").select("tree", (F.col("__base") + F.col("__at")).alias("at")).checkpoint()
    return ranked, trees, trees.count()


@dataclass
class Manifest:
    """The written log of a dataset: the groups' trees, the tree of their roots, and which tree is which of its leaves."""
    groups: Forest
    top: Forest
    trees: DataFrame
    key: str

    def root(self) -> str | None:
        """The digest of the whole dataset; None if it has no rows."""
        row = self.top.roots().first()
        return row["root"].hex() if row else None

    def segments(self) -> list[DataFrame]:
        """The log, tier by tier: ``tree, block, n, count, root, log``."""
        return [*self.groups.tiers, *self.top.tiers]

    def proofs(self) -> DataFrame:
        """Per row its key, ``leaf, subroot, root, proof, folded_root, position, tree``.

        ``proof`` holds per level the side and digest of the sibling; ``folded_root`` is what the claimed leaf and
        the proof give; ``position`` is the leaf's place in the postorder log of its group."""
        import pyarrow as pa

        levels, key = self.groups.levels, self.key
        top = self.top.with_paths(self.top.roots().select("tree", F.lit("").alias("path"), F.hex("root").alias("whole")))
        tops = _children(top, self.top.levels, ["whole"]).select(F.col("block").alias("at"), "path", F.lower("whole").alias("whole"))
        subroots = self.groups.roots().select("tree", F.lower(F.hex("root")).alias("subroot"))
        above = self.trees.join(tops, "at").join(subroots, "tree").select("tree", "path", "subroot", F.col("whole").alias("top"))
        segments = self.groups.with_paths(above).select("tree", "block", "n", "count", "log", "keys", "claimed", "path", "subroot", "top")
        of = dict(segments.dtypes)["keys"][len("array<"):-1]

        def run(batches):
            for b in batches:
                keys = b.column("keys")
                for r, row in enumerate(b.drop_columns(["keys"]).to_pylist()):
                    log, n, folded = _hexes(row["log"]), row["count"], {}
                    h = _height(row["n"], levels)
                    start = row["block"] << levels
                    values = keys[r].values
                    for lo in range(0, n, 512):
                        part = range(lo, min(lo + 512, n))
                        leaves = [log[position(0, i, n)] for i in part]
                        own = ["".join(siblings(i, n, h, log)) for i in part]
                        ends = []
                        for i, node, path in zip(part, leaves, own, strict=True):
                            claim = row["claimed"][i]
                            node = fold(claim.hex() if claim is not None else node, path)
                            if node not in folded:
                                folded[node] = fold(node, row["path"])
                            ends.append(folded[node])
                        yield pa.RecordBatch.from_arrays(
                            [values.slice(lo, len(part)), pa.array(leaves), pa.array([row["subroot"]] * len(part)), pa.array([row["top"]] * len(part)),
                             pa.array([p + row["path"] for p in own]), pa.array(ends),
                             pa.array([position(0, start + i, row["n"]) for i in part], pa.int64()), pa.array([row["tree"]] * len(part), pa.int64())],
                            names=["key", "leaf", "subroot", "root", "proof", "folded_root", "position", "tree"])

        return segments.mapInArrow(run, f"key {of}, leaf string, subroot string, root string, proof string, folded_root string, "
                                        "position long, tree long").withColumnRenamed("key", key)


def write_manifest(df: DataFrame, fields: list[str] = FIELDS, group: str = "lang", key: str = "doc_id", claimed: Column | None = None,
                   block_levels: int = BLOCK_LEVELS) -> Manifest:
    """Build and write the log. ``claimed`` is the digest (bytes) that a row claims to have, NULL for its leaf; proofs fold it."""
    leaves = df.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{key}`").alias("key"),
                       leaf([F.col(f"`{c}`") for c in fields]).alias("digest"),
                       (claimed if claimed is not None else F.lit(None)).cast("binary").alias("claimed"))
    ranked, trees, n_trees = _ranked(leaves, "merkle")
    nodes = ranked.select("tree", "at", "n", "digest", F.col("key").alias("keys"), "claimed")
    groups = _forest(nodes, block_levels, [("keys", leaves.schema["key"].dataType.simpleString()), ("claimed", "binary")], "merkle-log")
    tops = trees.join(groups.roots(), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("at").cast("long").alias("at"),
                                                     F.lit(n_trees).cast("long").alias("n"), F.col("root").alias("digest"))
    return Manifest(groups, _forest(tops, block_levels, [], "merkle-top"), trees, key)


def audited(df: DataFrame, every: int = 7) -> DataFrame:
    """Proofs of all rows, where ``n_chars`` of the rows whose key's CRC-32 ``every`` divides is claimed to be one more."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % every == 0
    more = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    proofs = write_manifest(df, claimed=F.when(tampered, leaf(more))).proofs()
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", "LR-", ""), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "position")
