"""Sharding under exact counts by a hypergeometric communication matrix (DataFrame functions only).

A uniform shuffle is made of three local steps: how many rows of each block go to each shard is
drawn from the multivariate hypergeometric law that a uniform permutation has; each block permutes
its own rows and deals them out by those counts; each shard permutes what it received.

Blocks are made by a hash of the row, so that a task that runs again makes the same choice. Only the
counts of blocks reach the driver: at most MAX_BLOCKS numbers, whatever the input's size.

Defined results: a null text has size 8 and the checksum of the empty text; repeated rows are rows
of their own (which of two identical rows gets which slot makes no difference); rows with a null
``doc_id`` are spread by their text; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.prune import marked
from orrery.session import cut

SHARDS = 24
ROWS_PER_BLOCK = 20_000
MIN_BLOCKS, MAX_BLOCKS = 16, 4096
#: Rows that repeat an id and text, from which on they are told apart.
HOT = 1000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls are good, drawn without putting back; by inversion from the mode outwards.

    Probabilities are doubles: what their rounding leaves of the whole, some 1e-9 at most, falls to the mode.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma

    def choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - p
    down, up, pd, pu = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Rows of block i that go to shard j: row sums are the blocks, column sums the shards' exact sizes."""
    rng, total = random.Random(seed), sum(blocks)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in blocks:
        row, left, rest = [], n, sum(room)
        for c in room:
            k = hypergeometric(rng, c, rest - c, left)
            row.append(k)
            left, rest = left - k, rest - c
        room = [c - k for c, k in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _order(seed: int, *cols: Column) -> list[Column]:
    """A pseudo-random order of rows, with ties settled by their own values."""
    return [F.xxhash64(F.lit(seed), *cols), *cols]


def uniform_shards(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: int = 0, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with shard and slot: a uniform shuffle into shards whose counts differ by one at most.

    ``by`` names the columns that tell rows apart. Slots are gapless from 0 within a shard. A shard
    is permuted in buckets of its second hash, each about a block's size, so that no task holds a
    whole shard; bucket offsets come from a table of (shard, bucket) counts.
    """
    cols = [F.col(c) for c in by]
    total = rows.count()
    n_blocks = max(MIN_BLOCKS, min(MAX_BLOCKS, -(-total // rows_per_block)))
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), *cols), F.lit(n_blocks)).cast("int"))
    counts = {r["_block"]: r["n"] for r in placed.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(i, 0) for i in range(n_blocks)], shards, seed)
    ends = [[sum(row[: j + 1]) for j in range(shards)] for row in matrix]
    plan = rows.sparkSession.createDataFrame(list(enumerate(ends)), "_block int, _ends array<bigint>")
    # Permute locally and deal out by the matrix; the plan has a row per block, 4,096 at most.
    local = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(*_order(seed + 2, *cols))))
    dealt = local.join(F.broadcast(plan), "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int")).drop("_ends", "_rank", "_block")
    # Exchange, and permute again: buckets are ranges of the second hash.
    n_buckets = max(1, -(-total // (shards * rows_per_block)))
    second = _order(seed + 3, *cols)
    bucket = F.floor(F.shiftrightunsigned(second[0], 33) * F.lit(n_buckets) / F.lit(2**31)).cast("int")
    spread = dealt.withColumn("_bucket", bucket)
    sizes = spread.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*second)) - 1
    slotted = spread.withColumn("_within", within).join(offsets, ["shard", "_bucket"])
    return slotted.withColumn("slot", (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_before", "_within")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``; the law is ``rows``.

    Texts are read once, for their sizes. Rows that many others repeat in id and text are told apart by a
    number, so that their hashes spread; which of equal rows goes where is all that it decides.
    """
    data, by = F.coalesce(F.col(text_col), F.lit("")), ["doc_id", "text_crc32", "size"]
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"))
    rows = cut(rows, "sizes").withColumn("key", F.xxhash64(*by))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
    rows = marked(rows, hot, "key", name="hot").withColumn("copy", F.when(F.col("hot"), F.col("uid")).otherwise(F.lit(0)))
    out = uniform_shards(rows.select(*by, "copy"), [*by, "copy"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
