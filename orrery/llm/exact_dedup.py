"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut into chunks at places its own bytes decide: a hash of a window that slides over them
says where. Every chunk gets a verified identifier, a document becomes its ordered list of identifiers (its
recipe), and two documents are equal exactly when their recipes are. Texts are cut once and never meet each
other: chunks whose hash occurs once cannot be mistaken for another, so only those of repeated hashes cross
the network, each distinct one once a task, to be compared byte by byte; afterwards only recipes move.

Defined results: a null text counts as empty; empty texts equal each other and have the empty
recipe; of rows with equal texts the one with the smallest ``doc_id`` stays (null ids are never
chosen while another id is there), of rows that repeat that ``doc_id`` exactly one; an empty table
gives an empty table; other columns are ignored here, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.prune import may_match
from orrery.session import cut

#: White space as the contract names it, except a lone space: what has to be replaced.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: The window's hash has a bit for each of its characters: the parity of the last byte's bits under a mask. A
#: chunk may end where all bits are as wanted. Every mask has the lowest bit, in which neighbours of any alphabet differ.
MASKS, WANTED = (0x01, 0x1B, 0x35, 0x2F, 0x51, 0x6D, 0x47, 0x7B), (1, 0, 1, 1, 0, 1, 0, 0)
#: Bytes of a chunk before its window, at least, and in all, at most.
LEAST, MOST = 248, 4096


def _pattern() -> str:
    """Chunks as a regular expression over bytes, so that the window slides in the JVM; the bytes before a character's last are passed over."""
    before = r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]|[\xF0-\xF4][\x80-\xBF]{2})?+"
    last = ("".join(f"\\x{b:02X}" for b in range(256) if (b & m).bit_count() % 2 == w) for m, w in zip(MASKS, WANTED, strict=True))
    return f"(?s).{{{LEAST},{MOST - 8}}}?{before.join(f'[{x}]' for x in last)}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a text's UTF-8 in order, each byte as the character of its number."""
    return F.regexp_extract_all(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), F.lit(_pattern()), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row_id, doc_id, recipe, text_sha256) per row, as a table in the shared folder.

    A chunk's identifier is its hash and a variant number, 0 unless different chunks share the
    hash. That is verified on the chunks themselves: the dictionary of distinct (hash, chunk) pairs
    under repeated hashes is built with partial aggregation before the shuffle, and hashes with two
    entries are told apart by content.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cuts = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("contents"))
    # The row number only tells repeated ids apart; it is fixed by being written.
    table = cut(cuts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.transform("contents", lambda c: hashed(c)).alias("recipe"), "text_sha256", "contents"), "chunks")
    out = table.drop("contents")
    hashes = table.select(F.explode("recipe").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hashes = cut(hashes, "repeated-hashes")
    pieces = table.select("row_id", F.posexplode(F.arrays_zip(F.col("recipe").alias("h"), F.col("contents").alias("content"))).alias("at", "c")).select("row_id", "at", "c.h", "c.content")
    dictionary = may_match(pieces.select("h", "content"), hashes, "h").distinct()
    clashes = cut(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "clashes")
    if clashes.isEmpty():
        return out
    # Different chunks under one hash: number them by content, and replace the recipes they are in.
    variants = dictionary.join(clashes, "h").groupBy("h").agg(F.sort_array(F.collect_list("content")).alias("contents"))
    variants = variants.select("h", F.posexplode("contents").alias("variant", "content"))
    told = pieces.join(variants, ["h", "content"]).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "variant"))).alias("told"))
    extra = F.coalesce(F.flatten(F.transform("told", lambda x: F.array(x["at"].cast("long"), x["variant"].cast("long")))), F.array().cast("array<bigint>"))
    return cut(out.join(told, "row_id", "left").select("row_id", "doc_id", F.concat("recipe", F.array(F.lit(-1).cast("long")), extra).alias("recipe"), "text_sha256"), "recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per row of ``docs``.

    Groups are counted with partial aggregation, so a text that a third of all rows share reaches
    its reducer as one row a task; handing the result back is an equi-join whose large side
    adaptive execution may split.
    """
    rows = recipes(docs, id_col, text_col, hashed).withColumn("key", F.xxhash64("recipe"))
    # Nulls sort last: the first field is false for a real id.
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))
    groups = rows.groupBy("key", "recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Read from a table, the groups have no partitioning of their own to which a hot recipe's rows would have to come.
    groups = cut(groups, "groups")
    return rows.join(groups, ["key", "recipe"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("row_id") == F.col("best.row_id"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever they are called: one of each group of equal texts."""
    found = cut(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "kept")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    rows = docs.select(F.struct("*").alias("r"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    left = rows.join(ids.where("k = 0").select("doc_id"), F.col("i").eqNullSafe(F.col("doc_id")), "left_anti")
    repeated = ids.where("n > 1 and k > 0").select("doc_id")
    if repeated.isEmpty():
        return left.select("r.*")
    # Rows that share an id: one row of each of its texts, unless another id keeps that text.
    again = F.col("i").eqNullSafe(F.col("doc_id"))
    own = left.join(repeated, again, "left_semi").withColumn("sha", F.sha2(normalised(F.col("t")), 256))
    own = own.join(found.where("kept").select("doc_id", "text_sha256"), again & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return left.join(repeated, again, "left_anti").select("r.*").unionByName(own.dropDuplicates(["i", "sha"]).select("r.*"))
