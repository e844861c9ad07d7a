"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

The index stores a posting (term, row, position) for every token of the training texts, and nothing else
is read afterwards. It is sharded by document: each file holds the postings of the documents that one task
read, ordered by the term's hash, so a term's list is contiguous in every shard, a term that all documents
hold is spread over all shards, and building the index moves nothing.

A phrase is looked up from its rarest term on, by counts over the whole corpus. The lists of its two rarest
terms meet first: places at most SLOP words apart are proximity matches, and those at just the phrase's own
offset are alignments. Each further term's list, shifted by its offset, must hold the alignment too; what all
terms hold is an exact match. Equal windows of several items are one phrase.

Defined results: a null or wordless text has no words and no hits; a wordless item matches nothing;
an item with fewer words than a window is one window; repeated rows each get their own result;
items are reported by ``item_id`` (null ids are left out of the digest list but counted); empty
tables are fine; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.prune import may_match
from orrery.session import cut

WINDOW = 10
#: Words between the two rarest terms of a window in a proximity match, at most.
SLOP = 10
#: A query side of up to so many rows and bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of other characters than these; a capital is one before it is lower-cased.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """Lower-cased in A-Z alone; only words beyond ASCII need the slow way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words as written; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), APART), "")


def words(text: Column) -> Column:
    """Words lower-cased in A-Z alone; null has none."""
    return F.transform(raw_words(text), lowered)


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count of its rows and bytes proves it small, else left to a shuffle join."""
    width = F.octet_length(F.to_json(F.struct("*")))
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all tokens, stored: (term, row, pos, doc_id, text_hash).

    The empty term's postings are the documents themselves: pos is the number of words, and only these rows
    carry doc_id and the text's hash. ``row`` tells repeated ids apart; it is fixed by being written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), raw_words(F.col(text_col)).alias("w"))
    rows = rows.select("*", F.size("w").alias("n_words"))
    posts = rows.select("row", "doc_id", "text_hash", "n_words", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    own = F.col("at") == 0
    return cut(
        posts.select(
            lowered(F.col("word")).alias("term"),
            "row",
            F.when(own, F.col("n_words")).otherwise(F.col("at") - 1).alias("pos"),
            F.when(own, F.col("doc_id")).alias("doc_id"),
            F.when(own, F.col("text_hash")).alias("text_hash"),
        ).sortWithinPartitions(F.when(F.col("term") == "", F.lit(-(1 << 63))).otherwise(F.xxhash64("term"))),
        "postings",
    )


def documents(index: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, n_words) of every indexed row."""
    return index.where("term = ''").select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row, pos) of the terms asked for, with the other columns of ``terms``."""
    return index.where("term <> ''").select("term", "row", "pos").join(_bounded(terms), "term")


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences over all documents of the terms asked for."""
    return postings(index, terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def query_phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, phrase), each distinct window of the items, and (wid, item_id), the items that have it; both stored."""
    texts = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    texts = texts.select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(window)).alias("size")).where("n > 0")
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.get("w", i + k)))
    held = cut(texts.select("item_id", F.explode(windows).alias("phrase")).distinct(), "windows")
    phrases = cut(held.select("phrase").distinct().select(F.monotonically_increasing_id().alias("wid"), "phrase"), "phrases")
    return phrases, cut(held.join(phrases, "phrase").select("wid", "item_id"), "owners")


def by_rarity(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, size, t0, k0, t1, delta, rest), stored: the rarest term and its place, the next one and its distance, all others as (k, term).

    A phrase with a term that the corpus lacks cannot occur and is left out. A phrase of one word has a null t1.
    """
    cells = phrases.select("wid", F.size("phrase").alias("size"), F.posexplode("phrase").alias("k", "term")).join(counts, "term")
    lists = cells.groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "k", "term"))).alias("c")).where(F.size("c") == F.col("size"))
    a, b = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    rest = F.transform(F.filter("c", lambda x, i: i >= 2), lambda x: F.struct(x["k"].alias("k"), x["term"].alias("term")))
    return cut(lists.select("wid", "size", a["term"].alias("t0"), a["k"].alias("k0"), b["term"].alias("t1"), (b["k"] - a["k"]).alias("delta"), rest.alias("rest")), "lists")


def near(index: DataFrame, pairs: DataFrame, slop: int = SLOP) -> DataFrame:
    """(row, t0, t1, p, d): places p of t0 with t1 at p + d, at most ``slop`` words away. ``pairs`` has t0 and t1.

    Positions are dealt into blocks of 2 slop + 1, of which a place reaches two; rows and blocks are the join's
    keys, so neither a frequent term nor a long text is a hot key.
    """
    wide, pairs = 2 * slop + 1, pairs.select("t0", "t1").distinct()
    lists = cut(postings(index, pairs.select(F.explode(F.array("t0", "t1")).alias("term")).distinct()), "lists-asked-for")
    blocks = F.array_distinct(F.array(F.expr(f"(pos + {wide - slop}) div {wide}"), F.expr(f"(pos + {wide + slop}) div {wide}")))
    left = postings(lists, pairs.select(F.col("t0").alias("term"), "t1"))
    left = left.select("row", F.col("term").alias("t0"), "t1", F.col("pos").alias("p"), F.explode(blocks).alias("block"))
    right = postings(lists, pairs.select(F.col("t1").alias("term")).distinct())
    right = right.select("row", F.col("term").alias("t1"), F.col("pos").alias("q"), F.expr(f"(pos + {wide}) div {wide}").alias("block"))
    both = left.join(right, ["row", "block", "t1"]).where(f"p <> q AND abs(q - p) <= {slop}")
    return both.select("row", "t0", "t1", "p", (F.col("q") - F.col("p")).alias("d"))


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Exact matches (row, start, size, wid, item ids by ``wid``) and proximity matches, both stored.

    Returns (occurrences, owners, close): occurrences (wid, row, start, size); owners (wid, item_id);
    close (row, item_id): items with a window whose two rarest terms stand at most ``slop`` words apart.
    """
    phrases, owners = query_phrases(items, window)
    counts = cut(term_counts(index, phrases.select(F.explode("phrase").alias("term")).distinct()), "counts")
    lists = by_rarity(phrases, counts)
    pairs = lists.where("t1 IS NOT NULL")
    found = cut(near(index, pairs, slop), "near")
    single = lists.where("t1 IS NULL")
    alone = cut(postings(index, single.select(F.col("t0").alias("term"), "wid")).select("wid", "row", F.col("pos").alias("start"), F.lit(1).alias("size")), "alone")
    # Alignments of the two rarest terms, and all other terms of their phrases at the places where they must be.
    aligned = found.join(_bounded(pairs.select("wid", "size", "k0", "t0", "t1", F.col("delta").alias("d"))), ["t0", "t1", "d"])
    aligned = cut(aligned.select("wid", "row", (F.col("p") - F.col("k0")).alias("start"), "size"), "alignments")
    wanted = aligned.join(_bounded(pairs.select("wid", "rest")), "wid").select("wid", "row", "start", "size", F.explode("rest").alias("c"))
    wanted = wanted.select("wid", "row", "start", "size", (F.col("start") + F.col("c.k")).alias("pos"), F.col("c.term").alias("term"))
    held = postings(index, pairs.select(F.explode("rest.term").alias("term")).distinct())
    met = wanted.join(may_match(held, aligned, "row"), ["row", "pos", "term"]).groupBy("wid", "row", "start", "size").agg(F.count(F.lit(1)).alias("n"))
    whole = met.where("n = size - 2").drop("n").unionByName(aligned.where("size = 2")).unionByName(alone)
    owned = _bounded(lists.where("t1 IS NOT NULL").join(owners, "wid").select("t0", "t1", "item_id").distinct())
    close = found.select("row", "t0", "t1").distinct().join(owned, ["t0", "t1"]).select("row", "item_id")
    close = close.unionByName(alone.select("wid", "row").distinct().join(_bounded(owners), "wid").select("row", "item_id")).distinct()
    return cut(whole, "matches"), owners, cut(close, "close")


def results(index: DataFrame, items: DataFrame) -> DataFrame:
    """(row, n_hit, n_items, items_sha256, n_near) of the rows with any match."""
    whole, owners, close = matches(index, items)
    # Words in any match, each once: what a match adds to the matches that begin before it.
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    more = F.col("start") + F.col("size") - F.greatest("start", F.coalesce(before, F.lit(0)))
    hits = whole.select("row", F.greatest(more, F.lit(0)).alias("more")).groupBy("row").agg(F.sum("more").alias("n_hit"))
    found = whole.select("row", "wid").distinct().join(_bounded(owners), "wid").select("row", "item_id").distinct()
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    found = found.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
    by_row = close.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    return by_row.join(hits.join(found, "row"), "row", "left").select("row", "n_hit", "n_items", "items_sha256", "n_near")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: one row per row of ``docs``.

    n_near counts the items with a proximity match; every item with an exact match has one.
    """
    index = build_index(docs, id_col, text_col)
    rows = documents(index).join(cut(results(index, items), "results"), "row", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def proximity_hits(docs: DataFrame, pairs: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, n): how often terms a and b stand at most ``slop`` words apart, from the stored postings.

    ``pairs`` has columns a and b. Each occurrence of a with at least one b near it counts once.
    """
    index = build_index(docs, id_col, text_col)
    found = near(index, pairs.select(F.col("a").alias("t0"), F.col("b").alias("t1")).distinct(), slop)
    n = found.select("row", "t0", "t1", "p").distinct().groupBy("row", "t0", "t1").agg(F.count(F.lit(1)).alias("n"))
    return n.join(documents(index), "row").select("doc_id", F.col("t0").alias("a"), F.col("t1").alias("b"), "n")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns. A row is known by its id and its text's hash: rows with both equal have equal results."""
    index = build_index(docs, id_col, text_col)
    bad = matches(index, items)[0].select("row").distinct().join(documents(index), "row")
    bad = cut(bad.select("doc_id", "text_hash").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("r"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    return rows.join(bad, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_anti").select("r.*")
