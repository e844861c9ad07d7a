"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are written once; from then on only distinct values move. With a budget of e differing bits,
e + 1 copies of each are dealt out, rotated so that a different block of bits comes first: two fingerprints
within the budget have one of the blocks in common. Each task sorts its fingerprints, which makes ranges of
them the nodes of a binary trie, and walks pairs of nodes together: differing bits of the common prefixes add
up, a pair beyond the error budget is dropped with all below it, and the larger node is split otherwise. A
block value that very many fingerprints share is dealt out again by the blocks of its remaining bits, so no
task holds more than MOST of them at once.

``near_duplicates`` links fingerprints within the budget. A task returns a spanning forest of the links it
finds, one row per fingerprint at most, so a group of many near copies never becomes all its pairs; node pairs
already in one component are skipped, which loses no connection. Components across tasks are joined by
alternating large-star and small-star steps on tables.

``keep_one`` links texts that share 0.8 or more of their five-word shingles. Such texts differ in about a
seventh of their bits, so the walk runs over TABLES short fingerprints of independent hashes, and each pair that
it finds is confirmed on the whole sets of shingles: no text below the similarity is linked. A pair at just
0.8 is found with a probability of 0.96, one at 0.85 of 0.998. First each text's best neighbours are confirmed;
then all found pairs of different components. Those may be as many as the square of a group whose texts are just
below the similarity, so they never become rows: the walk says which sets are compared in which tile, a task
confirms a tile's pairs on the whole sets and returns a spanning forest of its links.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; repeated rows and equal texts share a fingerprint and so a
component; a component is named by its smallest non-null ``doc_id``; an empty table gives an empty
table; other columns are ignored, or carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.prune import may_match
from orrery.session import cut, drop_path, map_arrow, scratch_path

SHINGLE, SEED, ERRORS = 4, 42, 4
#: Of the near-copy stage: words of a shingle, similarity of sets; number, bits and error budget of its fingerprints.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
TABLES, TABLE_BITS, TABLE_ERRORS = 26, 32, 2
#: Node pairs walked at once: bounds a task's memory, not its result.
SLAB = 1 << 18
#: Fingerprints under one block value that a task takes; more are dealt out again. Fingerprints walked together.
MOST, TOGETHER = 1 << 21, 1 << 19
#: Shingles of a block of sets, of which a tile compares two, and the sets in it at most: bounds a task's memory, not its result.
BLOCK, BLOCK_SETS = 1 << 20, 1 << 12


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    data = b" ".join(words)
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter([h(data[a:b], SEED) for a, b in spans], np.uint64, n - shingle + 1)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, and a hash that tells repeated ids apart."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, text_hash bigint, fp bigint")


def _prefix(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bits, 64 for zero."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return 64 - np.bitwise_count(x).astype(np.int64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels equal along links, each the smallest index of its component."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]


def trie_pairs(keys: np.ndarray, top: int, errors: int, label: np.ndarray, slab: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted distinct ``keys`` that agree in the ``top`` highest bits and differ in ``errors`` bits or fewer.

    Pairs of one label may be left out. The caller may merge labels between the arrays that it gets.
    """
    n = len(keys)
    if n < 2:
        return
    heads = np.flatnonzero(np.concatenate(([True], (keys[1:] ^ keys[:-1]) >> np.uint64(64 - top) != 0))) if top else np.array([0])
    lo, hi = heads, np.append(heads[1:], n)
    many = hi - lo > 1
    stack = [(lo[many], hi[many], lo[many], hi[many])]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        if len(alo) > slab:
            for i in range(0, len(alo), slab):
                stack.append((alo[i : i + slab], ahi[i : i + slab], blo[i : i + slab], bhi[i : i + slab]))
            continue
        # Common prefixes of the nodes, and the bits in which those prefixes differ so far.
        pa_, pb = _prefix(keys[alo] ^ keys[ahi - 1]), _prefix(keys[blo] ^ keys[bhi - 1])
        low = np.minimum(pa_, pb)
        differ = (keys[alo] ^ keys[blo]) >> np.minimum(64 - low, 63).astype(np.uint64)
        differ[low == 0] = 0
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        one = (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]) & (label[alo] == label[blo])
        keep = (np.bitwise_count(differ) <= errors) & ~one
        leaf = keep & (ahi - alo == 1) & (bhi - blo == 1)
        if (pick := leaf & (alo != blo)).any():
            yield alo[pick], blo[pick]
        own = keep & (alo == blo) & (ahi == bhi) & ~leaf
        both = keep & ~leaf & ~own
        # A pair of different nodes splits the one with the shorter prefix.
        first = pa_ <= pb

        def halves(a: np.ndarray, z: np.ndarray, p: np.ndarray) -> np.ndarray:
            s = (63 - p).astype(np.uint64)
            return np.searchsorted(keys, ((keys[a] >> s) | np.uint64(1)) << s)

        new = []
        if own.any():
            a, z = alo[own], ahi[own]
            m = halves(a, z, pa_[own])
            new += [(a, m, a, m), (m, z, m, z), (a, m, m, z)]
        for side in (True, False):
            if (pick := both & (first == side)).any():
                xa, xz, ya, yz = (alo, ahi, blo, bhi) if side else (blo, bhi, alo, ahi)
                xa, xz, ya, yz = xa[pick], xz[pick], ya[pick], yz[pick]
                m = halves(xa, xz, (pa_ if side else pb)[pick])
                new += [(xa, m, ya, yz), (m, xz, ya, yz)]
        if new:
            parts = [np.concatenate(x) for x in zip(*new, strict=True)]
            live = (parts[1] - parts[0] > 1) | (parts[3] - parts[2] > 1) | (parts[0] != parts[2])
            stack.append(tuple(x[live] for x in parts))


def trie_forest(keys: np.ndarray, top: int, errors: int = ERRORS, bits: int = 64, slab: int = SLAB) -> np.ndarray:
    """For sorted distinct keys, of which the highest ``bits`` count: a label for each, equal exactly within components of links."""
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    # Neighbours in a single bit first: it joins most of a dense group, whose node pairs are then skipped.
    for bit in range(64 - bits, 64 - top):
        other = keys ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(keys, other), n - 1)
        found = np.flatnonzero((keys[at] == other) & (other > keys))
        _merge(label, found, at[found])
    for i, j in trie_pairs(keys, top, errors, label, slab):
        _merge(label, i, j)
    return label


def _widths(free: int, parts: int) -> list[int]:
    """``free`` bits as ``parts`` blocks, the wider ones first."""
    return [free // parts + (i < free % parts) for i in range(parts)]


def _fixed(path: int, bits: int, parts: int) -> int:
    """How many of the highest bits all keys of a bucket share that has come this path: digits of base ``parts`` + 1, a block each."""
    fixed = 0
    for d in _digits(path, parts):
        fixed += _widths(bits - fixed, parts)[d]
    return fixed


def _digits(path: int, parts: int) -> list[int]:
    out = []
    while path:
        path, d = divmod(path, parts + 1)
        out.append(d - 1)
    return out[::-1]


def _deal(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """Each row (path, fixed, key, ...) once for each block of the bits that are free, that block rotated to the front of them; top is what the bucket shares."""
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i")).withColumn("free", F.lit(bits) - F.col("fixed"))
    rows = rows.withColumn("offset", F.expr(f"cast(i * (free div {parts}) + least(i, free % {parts}) AS int)"))
    # Of the key, ``fixed`` bits stay, the next ``free`` ones rotate, the rest is zero. A shift by 64 would be one by 0.
    rows = rows.withColumn("tail", F.expr("shiftleft(key, fixed)"))
    turned = F.expr("CASE WHEN offset = 0 THEN tail ELSE shiftleft(tail, offset) | shiftleft(shiftrightunsigned(tail, 64 - offset), 64 - free) END")
    rows = rows.withColumn("turned", turned)
    key = F.expr("CASE WHEN fixed = 0 THEN turned ELSE shiftleft(shiftrightunsigned(key, 64 - fixed), 64 - fixed) | shiftrightunsigned(turned, fixed) END")
    rows = rows.withColumn("key", key).withColumn("path", F.expr(f"path * {parts + 1} + i + 1"))
    rows = rows.withColumn("fixed", F.expr(f"cast(fixed + free div {parts} + if(i < free % {parts}, 1, 0) AS int)"))
    return rows.withColumn("top", F.expr("shiftrightunsigned(key, 64 - fixed)")).drop("i", "free", "offset", "tail", "turned")


def buckets(rows: DataFrame, bits: int, errors: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (key, by..., more...) dealt out with path and top: keys within the budget share a bucket (by..., path, top) of MOST rows at most.

    Buckets of more rows are dealt out again by the blocks of their remaining bits, until none is left; distinct
    keys run out of bits before that could go on.
    """
    parts, out, keys = errors + 1, None, [*by, "path", "top"]
    rows = rows.withColumns({"path": F.lit(0).cast("long"), "fixed": F.lit(0)})
    while True:
        rows = _deal(rows, bits, parts)
        # With fewer bits than blocks left, a bucket has no more keys than those bits can say.
        sizes = rows.where(F.lit(bits) - F.col("fixed") >= parts).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        hot = cut(sizes.where(F.col("size") > MOST).drop("size"), "hot-buckets")
        if hot.isEmpty():
            return rows if out is None else out.unionByName(rows)
        # A third of the rows may be under one hot bucket: it is joined by broadcast; there are a row per MOST keys and block at most.
        cold = rows.join(F.broadcast(hot), keys, "left_anti")
        out = cold if out is None else out.unionByName(cold)
        rows = rows.join(F.broadcast(hot), keys, "left_semi").drop("top")


#: A table's number and a path in one word.
SLOT = 1 << 40


def _dealt(rows: DataFrame, *more: str, by: Column | None = None) -> DataFrame:
    """Rows (slot, key, more...) of buckets, each bucket whole in one task and in one piece."""
    slot = F.col("path") if by is None else by * SLOT + F.col("path")
    rows = rows.select(slot.alias("slot"), "key", *more, "fixed").repartition("slot", F.expr("shiftrightunsigned(key, 64 - fixed)"))
    return rows.select("slot", "key", *more).sortWithinPartitions("slot", "key")


def _tops(slot: np.ndarray, key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """What the keys of a bucket share."""
    out = np.empty(len(key), np.uint64)
    for a, z in _runs(slot):
        out[a:z] = key[a:z].view(np.uint64) >> np.uint64(64 - _fixed(int(slot[a]) % SLOT, bits, parts))
    return out


def _numbers(col: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of one length as rows."""
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False)


def _whole_buckets(batches: Iterable[pa.RecordBatch], bits: int, parts: int) -> Iterator[list[np.ndarray]]:
    """Columns (slot, key, more...) of whole buckets of one slot, several as long as they are few rows."""
    held: list[list[np.ndarray]] = []
    n, limit = 0, TOGETHER

    def pieces(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        yield from ([c[a:z] for c in cols] for a, z in _runs(cols[0]))

    for b in batches:
        held.append([_numbers(c) for c in b.columns])
        n += b.num_rows
        if n < limit:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = _runs(cols[0], _tops(cols[0], cols[1], bits, parts))[-1][0]
        if last:
            yield from pieces([c[:last] for c in cols])
        held, n = [[c[last:] for c in cols]], n - last
        limit = n + TOGETHER
    if n:
        yield from pieces([np.concatenate(x) for x in zip(*held, strict=True)])


def _runs(*cols: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that are equal in all columns, of rows in that order."""
    change = np.zeros(len(cols[0]), bool)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    at = [0, *np.flatnonzero(change).tolist(), len(change)]
    return list(zip(at[:-1], at[1:], strict=True))


def links(distinct: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that connect exactly what all links connect."""
    parts = errors + 1
    rows = _dealt(buckets(distinct.select(F.col("fp").alias("key"), "fp"), 64, errors), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, key, fp in _whole_buckets(batches, 64, parts):
            order = np.argsort(key.view(np.uint64))
            own, back = key.view(np.uint64)[order], fp[order]
            label = trie_forest(own, _fixed(int(slot[0]), 64, parts), errors)
            far = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(back[far]), pa.array(back[label[far]])], names=["u", "v"])

    return map_arrow(rows, run, "u bigint, v bigint")


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(u, root) for every end u of an edge (u, v) but the roots: root is the smallest value connected to u.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and an equi-join, on
    tables in the shared folder, until nothing changes.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "edges")
        df.write.parquet(path)
        return path, spark.read.schema("u bigint, v bigint").parquet(path)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    path, now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    for _ in range(most):
        if not seen[0]:
            break
        # Large star: every larger neighbour of u is tied to u's smallest neighbour.
        ways = now.union(now.select("v", "u"))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: all smaller neighbours of u, and u itself, are tied to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        old, (path, now) = path, stored(small)
        drop_path(spark, old)
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select("u", F.col("v").alias("root"))


def assigned(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (doc_id, text_hash, fp) with best, the (null, doc_id, text_hash) that names the component; ``link`` gives edges (u, v) for distinct ``fp``."""
    # Nulls sort last: the first field is false for a real id.
    distinct = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    roots = components(link(distinct.select("fp")))
    named = cut(distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    # Read from a table, the components have no partitioning of their own to which a large one's fingerprints would have to come.
    least = cut(named.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "components")
    of = named.join(least, "root", "left").select("fp", F.coalesce("best", "first").alias("best"))
    return rows.join(of, "fp")


def _linked(docs: DataFrame, id_col: str, text_col: str, errors: int, shingle: int) -> DataFrame:
    return assigned(cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), lambda distinct: links(distinct, errors))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``."""
    rows = _linked(docs, id_col, text_col, errors, shingle)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    spans = [b" ".join(words)] if len(words) <= shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    return np.unique(np.fromiter((h(s, SEED) for s in spans), np.uint64, len(spans)))


def _mixers(n: int) -> np.ndarray:
    """Odd multipliers, each the hash of its number."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) | 1 for i in range(n)], np.uint64)


def table_keys(hashes: np.ndarray, tables: int = TABLES, bits: int = TABLE_BITS) -> np.ndarray:
    """Short fingerprints of a set of hashes, one for each table, in the highest bits of a 64-bit word."""
    each = 64 // bits
    mixers = _mixers(-(-tables // each))
    sums = np.zeros(len(mixers) * 64, np.int64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] * mixers[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        sums += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    most = np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")
    keys = [most >> np.uint64(i * bits) << np.uint64(64 - bits) for i in range(each)]
    return np.stack(keys, axis=1).reshape(-1)[:tables]


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, tables: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, keys, size): fp names the set of a text's shingles, keys are its fingerprints, size says how many they are."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys, sizes = [], [], []
            for t in b.column(2):
                own = shingle_set(t.as_py(), shingle)
                names.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                keys.append(table_keys(own, tables, bits))
                sizes.append(len(own))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), lists, pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "fp", "keys", "size"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, text_hash bigint, fp bigint, keys array<bigint>, size bigint")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(fp, parts): the shingles of the sets ``wanted`` (text_hash, fp), made from the texts again and stored.

    Only texts that may be wanted are read by Python, and only wanted sets are moved.
    """
    rows = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = may_match(rows, wanted, "text_hash")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["text_hash", "parts"])

    # One text of each set is wanted. Equal texts are one row a task before they are moved.
    made = map_arrow(rows, run, "text_hash bigint, parts array<bigint>").groupBy("text_hash").agg(F.first("parts").alias("parts"))
    return cut(made.join(wanted, "text_hash").select("fp", "parts"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, tables: int, bits: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of sets that share so much of their union, stored.

    All fingerprints of a pair together tell chance from likeness before any text is read again.
    """
    u, v = (sets.select(F.col("fp").alias(x), F.col("keys").alias(f"k{x}")) for x in "uv")
    apart = F.aggregate(F.zip_with("ku", "kv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)
    likely = pairs.join(u, "u").join(v, "v").where(apart <= F.lit(_most_bits(similarity, tables, bits)) * F.size("ku")).select("u", "v")
    return _alike(cut(likely, "likely-pairs"), sets, docs, text_col, shingle, similarity)


def _alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets are as similar, stored."""
    ends = pairs.select(F.col("u").alias("fp")).distinct().union(pairs.select("v").distinct()).distinct()
    parts = _sets(docs, cut(sets.join(ends, "fp", "left_semi").select("fp", "text_hash"), "wanted"), text_col, shingle)
    u, v = (parts.select(F.col("fp").alias(x), F.col("parts").alias(f"p{x}")) for x in "uv")
    both = F.size(F.array_intersect("pu", "pv"))
    found = pairs.join(u, "u").join(v, "v").where(both * (1 + similarity) >= (F.size("pu") + F.size("pv")) * similarity - 1e-9)
    return cut(found.select("u", "v"), "confirmed")


def _most_bits(similarity: float, tables: int, bits: int) -> float:
    """How many bits of a table sets of that similarity differ in, with room for chance: of 200 pairs at just the similarity one is beyond it.

    Their cosine is 2 s / (1 + s), or more where one is larger; the angle over pi is a bit's chance.
    """
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    n = tables * bits
    return bits * min(1.0, share + 2.6 * np.sqrt(share * (1 - share) / n) + 2 / n)


def _best(cells: DataFrame, bits: int, errors: int) -> DataFrame:
    """(u, v, t, degree): for each set ``fp`` of cells (t, key, score, fp) the one of the highest score among those within the budget, in each bucket, and how many those are."""
    rows = _dealt(buckets(cells, bits, errors, ("t",)), "score", "fp", by=F.col("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, key, score, fp in _whole_buckets(batches, bits, errors + 1):
            order = np.argsort(key.view(np.uint64), kind="stable")
            key, score, fp = key.view(np.uint64)[order], score[order], fp[order]
            by_rank = np.lexsort((fp, score))
            rank = np.empty(len(fp), np.int64)
            rank[by_rank] = np.arange(len(fp))
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            of = np.repeat(np.arange(len(start)), size)
            # Of each key the first two sets: the first is the best of all others under the key, the second of it.
            first = np.maximum.reduceat(rank, start)
            lead = rank == first[of]
            second = np.maximum.reduceat(np.where(lead, -1, rank), start)
            best, degree = np.full(len(start), -1), size - 1
            for i, j in trie_pairs(key[start], _fixed(int(slot[0]) % SLOT, bits, errors + 1), errors, np.arange(len(start))):
                np.maximum.at(best, i, first[j])
                np.maximum.at(best, j, first[i])
                np.add.at(degree, i, size[j])
                np.add.at(degree, j, size[i])
            found = np.maximum(best[of], np.where(lead, second[of], first[of]))
            x = np.flatnonzero(found >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[x]), pa.array(fp[by_rank[found[x]]]), pa.array(np.full(len(x), slot[0] // SLOT, np.int32)), pa.array(degree[of][x])], names=["u", "v", "t", "degree"]
            )

    return map_arrow(rows, run, "u bigint, v bigint, t int, degree bigint")


def _in_order(key: np.ndarray, root: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The columns by key and root, as ``_near`` takes them."""
    order = np.lexsort((root, key.view(np.uint64)))
    return [key.view(np.uint64)[order], root[order], *(c[order] for c in more)]


def _near(key: np.ndarray, root: np.ndarray, keys: np.ndarray, top: int, errors: int, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different roots of a bucket's rows whose keys are within the budget, and all whose keys differ in ``most`` bits or fewer."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.append(start[1:], len(key))
    several = root[start] != root[end - 1]
    # A key of one root stands for it; one of several for none, so that it is not passed over.
    names = np.unique(root, return_inverse=True)[1]
    label = np.where(several, -1 - np.arange(len(start)), names[start])

    def ends(i: np.ndarray, j: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(i):
            size = (end[i] - start[i]) * (end[j] - start[j])
            k = max(1, int(np.searchsorted(np.cumsum(size), SLAB // 8)))
            n, width = size[:k], (end[j] - start[j])[:k]
            of = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            a, b = start[i][of] + off // width[of], start[j][of] + off % width[of]
            pick = root[a] < root[b] if own else root[a] != root[b]
            a, b = a[pick], b[pick]
            near = np.bitwise_count((keys[a] ^ keys[b]).view(np.uint64)).sum(1, dtype=np.int64) <= most
            yield a[near], b[near]
            i, j = i[k:], j[k:]

    same = np.flatnonzero(several)
    yield from ends(same, same, True)
    for i, j in trie_pairs(key[start], top, errors, label):
        yield from ends(i, j)


def _first(apart: np.ndarray, errors: int, table: int) -> np.ndarray:
    """Which pairs, whose keys are so many bits apart in each table, are within the budget in this table and in none before it."""
    return (apart[:, table] <= errors) & ~(apart[:, :table] <= errors).any(1)


def _across(cells: DataFrame, bits: int, errors: int, most: float) -> DataFrame:
    """(u, v): the pairs of sets that ``_tiles`` deals out, a row each and table, for tables of few."""
    rows = _dealt(buckets(cells, bits, errors, ("t",)), "root", "fp", "keys", by=F.col("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, *cols in _whole_buckets(batches, bits, errors + 1):
            key, root, keys, fp = _in_order(cols[0], cols[1], cols[3], cols[2])
            for a, b in _near(key, root, keys, _fixed(int(slot[0]) % SLOT, bits, errors + 1), errors, most):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[a], fp[b])), pa.array(np.minimum(fp[a], fp[b]))], names=["u", "v"])

    return map_arrow(rows, run, "u bigint, v bigint")


def _tiles(cells: DataFrame, bits: int, errors: int, most: float, block: int = BLOCK, held_most: int = SLAB) -> DataFrame:
    """(slot, a, b, side, fp): the sets that a tile (slot, a, b) compares, for all pairs of the sets ``fp`` of cells (t, key, root, fp, keys, size)
    with different roots whose keys are within the budget, and all whose keys differ in ``most`` bits or fewer.

    A bucket's sets are cut into blocks, named by their first set; a tile holds those of two blocks (side 1 and 2), or
    of one (side 3), that are in a pair. So a bucket gives a row for each set and block at most, not one for each pair.
    A pair counts in the first table that has it within the budget; cells must hold it there. A row may be there more than once.
    """
    rows = _dealt(buckets(cells, bits, errors, ("t",)), "root", "fp", "keys", "size", by=F.col("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, *cols in _whole_buckets(batches, bits, errors + 1):
            key, root, keys, fp, size = _in_order(cols[0], cols[1], cols[3], cols[2], cols[4])
            n = len(fp)
            full = np.cumsum(np.maximum(size, block // BLOCK_SETS)) // block
            head = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1])))
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
            held = np.zeros(0, np.int64)

            def batch(held: np.ndarray) -> pa.RecordBatch:
                tile, x = np.divmod(held, n)
                low, high = np.divmod(tile, len(head))
                side = np.where(low == high, 3, np.where(of[x] == low, 1, 2)).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), slot[0])), pa.array(fp[head[low]]), pa.array(fp[head[high]]), pa.array(side), pa.array(fp[x])], names=["slot", "a", "b", "side", "fp"])

            for a, b in _near(key, root, keys, _fixed(int(slot[0]) % SLOT, bits, errors + 1), errors, most):
                pick = _first(np.bitwise_count((keys[a] ^ keys[b]).view(np.uint64)), errors, int(slot[0]) // SLOT)
                a, b = a[pick], b[pick]
                tile = np.minimum(of[a], of[b]) * len(head) + np.maximum(of[a], of[b])
                held = np.unique(np.concatenate((held, tile * n + a, tile * n + b)))
                if len(held) > held_most:
                    yield batch(held)
                    held = held[:0]
            if len(held):
                yield batch(held)

    return map_arrow(rows, run, "slot bigint, a bigint, b bigint, side int, fp bigint")


def tile_forest(
    table: int, side: np.ndarray, root: np.ndarray, keys: np.ndarray, parts: list[np.ndarray], errors: int, most: float, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links between a tile's sets that connect, with their roots, what all its pairs of the similarity connect.

    Pairs are of sides 1 and 2, or any two of side 3: those that count in this table, and whose keys differ in ``most`` bits or fewer.
    """
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    # A shingle's number among the tile's own, so that the sets with one set's shingles are marked places.
    word, place = np.unique(np.concatenate(parts), return_inverse=True)
    marked = np.zeros(len(word), bool)
    first, name = np.unique(root, return_index=True, return_inverse=True)[1:]
    label = first[name]
    own, others = side[0] == 3, np.flatnonzero(side != 1)
    left, right = [], []
    for i in np.flatnonzero(side != 2):
        j = others[others > i] if own else others
        j = j[(np.bitwise_count((keys[j, table] ^ keys[i, table]).view(np.uint64)) <= errors) & (label[j] != label[i])]
        apart = np.bitwise_count((keys[j] ^ keys[i]).view(np.uint64))
        j = j[(apart.sum(1, dtype=np.int64) <= most) & _first(apart, errors, table)]
        if not len(j):
            continue
        marked[place[start[i] : start[i] + size[i]]] = True
        ends = np.cumsum(size[j])
        at = np.arange(ends[-1]) + np.repeat(start[j] - (ends - size[j]), size[j])
        both = np.add.reduceat(marked[place[at]], ends - size[j], dtype=np.int64)
        marked[place[start[i] : start[i] + size[i]]] = False
        j = j[both * (1 + similarity) >= (size[i] + size[j]) * similarity - 1e-9]
        j = j[np.unique(label[j], return_index=True)[1]]
        left.append(np.full(len(j), i))
        right.append(j)
        _merge(label, left[-1], j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _tile_links(tiles: DataFrame, sets: DataFrame, errors: int, most: float, similarity: float) -> DataFrame:
    """(u, v): the links of each tile's forest, for sets (fp, root, keys, parts)."""
    rows = tiles.join(sets, "fp").select("slot", "a", "b", "side", "fp", "root", "keys", "parts")
    rows = rows.repartition("slot", "a", "b").sortWithinPartitions("slot", "a", "b", "fp")

    def forest(slot: int, held: list[list]) -> pa.RecordBatch:
        side, fp, root, keys = (np.concatenate([h[c] for h in held]) for c in range(4))
        once = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
        sets = [p for h in held for p in h[4]]
        i, j = tile_forest(slot // SLOT, side[once], root[once], keys[once], [sets[x] for x in once], errors, most, similarity)
        u, v = fp[once][i], fp[once][j]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            names = [_numbers(b.column(c)) for c in range(3)]
            lists = b.column(7)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            cols = [_numbers(b.column(c)) for c in range(3, 7)]
            for x, z in _runs(*names):
                tile = tuple(int(c[x]) for c in names)
                if held and tile != now:
                    yield forest(now[0], held)
                    held = []
                now = tile
                # Copies, so that a tile does not hold the batches that it comes from.
                held.append([*(c[x:z].copy() for c in cols), [flat[at[y] : at[y + 1]].copy() for y in range(x, z)]])
        if held:
            yield forest(now[0], held)

    return map_arrow(rows, run, "u bigint, v bigint")


def similar_links(rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, tables: int, bits: int, errors: int) -> DataFrame:
    """(u, v): confirmed links between the sets of ``rows`` (fp, text_hash, keys, size) that connect what all of them connect.

    A set's score is how many others share one of its keys: in a large group of near copies the one that all
    others are copies of has the highest. First each set is compared with the three best of its neighbours in the
    buckets of the walk, which joins such a group without its pairs. All pairs that this leaves out whose
    components still differ are found by a second walk over the sets that have any, and confirmed tile by tile.
    """
    sets = cut(rows.groupBy("fp").agg(F.min(F.struct("text_hash", "keys", "size")).alias("x")).select("fp", "x.text_hash", "x.keys", "x.size"), "sketched-sets")
    cells = sets.select("fp", F.posexplode("keys").alias("t", "key"))
    # Read from a table, the groups have no partitioning of their own to which a hot key's sets would have to come.
    groups = cut(cells.groupBy("t", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared-keys")
    scores = cut(may_match(cells, groups, "t", "key").join(groups, ["t", "key"]).groupBy("fp").agg(F.sum("k").alias("score")), "scores")
    scored = sets.join(scores, "fp", "left").select("fp", F.coalesce("score", F.lit(0)).alias("score"), F.posexplode("keys").alias("t", "key"))
    best = cut(_best(scored, bits, errors).join(scores.select(F.col("fp").alias("v"), "score"), "v", "left").na.fill(0, ["score"]), "best-neighbours")
    first = best.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "v")), asc=False), 1, 3).alias("first"))
    star = cut(first.select("u", F.explode("first.v").alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    near = confirmed(star, sets, docs, text_col, shingle, similarity, tables, bits)
    roots = components(near).withColumnRenamed("u", "fp")
    # A pair that was not tried is between sets of two neighbours or more, or is one that a set has beyond its first.
    later = best.join(star.select(F.col("u").alias("a"), F.col("v").alias("b")), (F.greatest("u", "v") == F.col("a")) & (F.least("u", "v") == F.col("b")), "left_anti")
    # So a pair that was not tried is open in each table that has it within the budget, and may be left to the first of them.
    open_ = best.where("degree > 1").select(F.col("u").alias("fp"), "t").union(later.select("u", "t")).union(later.select("v", "t")).distinct()
    rooted = sets.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "keys", "size")
    of = cut(open_.join(rooted, "fp").select("t", F.col("keys")[F.col("t")].alias("key"), "root", "fp", "keys", "size"), "open-cells")
    most = _most_bits(similarity, tables, bits) * tables
    tiles = cut(_tiles(of, bits, errors, most), "tiles")
    wanted = cut(sets.join(tiles.select("fp").distinct(), "fp", "left_semi").select("fp", "text_hash"), "wanted")
    whole = rooted.select("fp", "root", "keys").join(_sets(docs, wanted, text_col, shingle), "fp")
    return near.unionByName(cut(_tile_links(tiles, whole, errors, most, similarity), "tile-links"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = STAGE_SHINGLE,
    similarity: float = SIMILARITY,
    tables: int = TABLES,
    bits: int = TABLE_BITS,
    errors: int = TABLE_ERRORS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of near copies the row with the smallest id.

    ``bits`` and ``errors`` say how many pairs by chance have to be confirmed: of n sets n^2 / 2^(bits + 1) in each
    table for each way to place the errors. Beyond some ten million documents take 48 bits and 4 errors, which
    find as much.
    """
    rows = cut(sketches(docs, id_col, text_col, shingle, tables, bits), "sketches")
    linked = assigned(rows.select("doc_id", "text_hash", "fp"), lambda _: similar_links(rows, docs, text_col, shingle, similarity, tables, bits, errors))
    # Of each component one row: its own texts, whose hash tells rows of one id apart.
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    found = cut(linked.groupBy("doc_id", "text_hash").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "near-copies")
    own = docs.select(F.struct("*").alias("r"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    left = own.join(found.where("NOT stays").select("doc_id", "text_hash"), same, "left_anti")
    again = found.where("stays AND n > 1").select("doc_id", "text_hash")
    if again.isEmpty():
        return left.select("r.*")
    # Rows repeated with id and text: one of them stays.
    once = left.join(again, same, "left_semi").dropDuplicates(["i", "h"])
    return left.join(again, same, "left_anti").select("r.*").unionByName(once.select("r.*"))
