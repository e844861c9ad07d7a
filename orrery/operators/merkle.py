"""Merkle trees over content in chunks: leaves are SHA-256 digests, a node that of its children's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import cut

CHUNK = 1 << 20


def merkle_chunks(content: DataFrame, key: str, data: str, chunk: int = CHUNK) -> DataFrame:
    """(key, chunk, size, hash): a leaf per chunk; empty content has none. Digests leave the task, content does not."""
    b = F.col(data).cast("binary")
    n = F.ceil(F.octet_length(b) / chunk).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * chunk + 1, F.lit(chunk)))
    leaf = F.transform(pieces, lambda p: F.struct(F.octet_length(p).alias("size"), F.sha2(p, 256).alias("hash")))
    rows = content.where(n > 0).select(F.col(key).alias("key"), F.posexplode(leaf).alias("chunk", "leaf"))
    return rows.select("key", "chunk", F.col("leaf.size").alias("size"), F.col("leaf.hash").alias("hash"))


def merkle_levels(leaves: DataFrame, most: int = 40) -> DataFrame:
    """(key, level, node, hash): all nodes, level 0 the leaves. Each level is half the one below; a node without a sibling goes up as it is."""
    # Each level is folded from the table of the one below: content is read once, for the leaves.
    level = cut(leaves.select("key", F.lit(0).alias("level"), F.col("chunk").alias("node"), "hash"), "merkle")
    out, n = level, (level.agg(F.max("node")).first()[0] or 0) + 1
    for i in range(1, most):
        if n <= 1:
            break
        pairs = level.groupBy("key", F.floor(F.col("node") / 2).cast("int").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"))
        joined = F.concat(F.unhex(F.col("c")[0]["hash"]), F.unhex(F.get("c", F.lit(1))["hash"]))
        level = cut(pairs.select("key", F.lit(i).alias("level"), "node", F.when(F.size("c") == 2, F.sha2(joined, 256)).otherwise(F.col("c")[0]["hash"]).alias("hash")), "merkle")
        out, n = out.unionByName(level), -(-n // 2)
    return out


def merkle_summary(leaves: DataFrame) -> DataFrame:
    """(key, chunks, bytes, root)."""
    root = merkle_levels(leaves).groupBy("key").agg(F.max_by("hash", "level").alias("root"))
    n = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))
    return n.join(root, "key")


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, chunk, change): added, removed or changed chunks between two sets of leaves."""
    x, y = a.select("key", "chunk", F.col("hash").alias("x")), b.select("key", "chunk", F.col("hash").alias("y"))
    both = x.join(y, ["key", "chunk"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("key", "chunk", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def merkle_verify(content: DataFrame, leaves: DataFrame, key: str, data: str, chunk: int = CHUNK) -> DataFrame:
    """The chunks that no longer are what their leaves say."""
    return merkle_diff(leaves, merkle_chunks(content, key, data, chunk))


def merkle_path(levels: DataFrame, key: object, chunk: int) -> DataFrame:
    """(level, node, hash) from a leaf to the root."""
    on_the_way = F.col("node") == F.floor(F.lit(chunk) / F.pow(F.lit(2.0), F.col("level")))
    return levels.where((F.col("key") == key) & on_the_way).select("level", "node", "hash")


def spoil(leaves: DataFrame, step: int) -> DataFrame:
    """Leaves with the first bit of every ``step``-th hash turned, to try verification."""
    turned = F.concat(F.lower(F.hex(F.conv(F.substring("hash", 1, 1), 16, 10).cast("int").bitwiseXOR(F.lit(8)))), F.substr("hash", F.lit(2)))
    return leaves.withColumn("hash", F.when(F.col("chunk") % step == 0, turned).otherwise(F.col("hash")))
