"""Exact nearest neighbours, by brute force.

Three plans give the same rows; all pass over the base once for each block of queries of bounded size, which is
broadcast. ``plan="sql"`` joins a block with the base and ranks, a limit that Spark pushes below the shuffle; it is
for small tables, as Spark interprets its sums and sorts all pairs. ``plan="direct"`` sums every distance in DOUBLE and
in component order, as SQL does, and trusts no bound: it is what ``blocks`` is verified by on large ones.
``plan="blocks"`` multiplies matrices, a tile of queries and base rows at a time, rescores in DOUBLE and in
component order every candidate that rounding could leave among the k nearest, and keeps the k nearest of each
query over all that a task has read; k rows a query and task are ranked globally.

Order is (distance, ordinal). NaN and infinite distances are never neighbours. With fewer than k base
rows there are fewer neighbours; the array form is padded with -1 and infinity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.extract import running_sums
from orrery.session import map_arrow

#: Floats of a block of queries that is broadcast (32 MB), and neighbours that a task keeps for it.
BLOCK_FLOATS, BLOCK_KEPT = 4_000_000, 2_000_000
#: Base rows of a tile, its distances, and numbers that are rescored at once: 8 MB each.
ROWS, CELLS, RESCORED = 8192, 2_000_000, 1_000_000
#: Distances that are summed at once, so that they stay in a core's cache.
CACHED = 32_768
#: Components beyond which products are not trusted: floats are taken as doubles, and doubles are rescored one by one.
LARGE = {np.dtype(np.float32): 1e15, np.dtype(np.float64): 1e150}
COSINE_MODES = ("assume_normalized", "proper")


def resolved(metric: str, cosine_mode: str | None) -> str:
    """The metric to compute. Cosine needs a mode: vectors taken as normalised are compared by dot product."""
    name = vec.metric_name(metric)
    if name == "COSINE":
        if cosine_mode not in COSINE_MODES:
            raise ValueError(f"COSINE needs cosine_mode, one of {COSINE_MODES}")
        return "DOT" if cosine_mode == "assume_normalized" else "COSINE"
    if cosine_mode is not None:
        raise ValueError("cosine_mode is for COSINE alone")
    return name


def top_k(pairs: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """(by, neighbor_id, rank from 0, distance) from (by, neighbor_id, kernel, distance)."""
    w = Window.partitionBy(by).orderBy("kernel", "neighbor_id")
    ok = ~F.isnan("kernel") & (F.col("kernel") < float("inf"))
    ranked = pairs.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(by, "neighbor_id", (F.col("rank") - 1).cast("int").alias("rank"), "distance")


def _pairs(q: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Every base row beside every query of a block; with a label column on both sides, within the label."""
    kernel, published = vec.distance(metric, F.col("q_vec"), F.col("b_vec"))
    beside = b.join(F.broadcast(q), "label") if "label" in q.columns else b.crossJoin(F.broadcast(q))
    return beside.select("query_id", "neighbor_id", kernel.alias("kernel"), published.alias("distance"))


def _sides(base: DataFrame, queries: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    return (
        queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("q_vec")),
        base.select(F.col(id_col).alias("neighbor_id"), F.col(vec_col).alias("b_vec")),
    )


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "L2", cosine_mode: str | None = None, plan: str = "blocks", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k nearest base rows of each query."""
    name = resolved(metric, cosine_mode)
    q, b = _sides(base, queries, id_col, vec_col)
    return _knn(q, b, k, name, plan)


def _knn(q: DataFrame, b: DataFrame, k: int, name: str, plan: str = "blocks") -> DataFrame:
    out = None
    for part in _blocks(q, k):
        pairs = _pairs(part, b, name) if plan == "sql" else _candidates(b, part, k, name, ENGINES[plan])
        out = pairs if out is None else out.unionByName(pairs)
    return top_k(out, k)


def _blocks(q: DataFrame, k: int) -> list[DataFrame]:
    """The queries in blocks of bounded size, dealt out by the hash of their ids."""
    n, dim = q.agg(F.count("q_vec"), F.max(F.size("q_vec"))).first()
    blocks = max(1, -(-n * (dim or 1) // BLOCK_FLOATS), -(-n * k // BLOCK_KEPT))
    own = q.where(F.col("q_vec").isNotNull())
    return [own] if blocks == 1 else [own.where(_block("query_id", blocks) == i) for i in range(blocks)]


def _block(col: str, blocks: int) -> Column:
    """The block of a query's id."""
    return F.pmod(F.xxhash64(F.col(col).cast("bigint")), F.lit(blocks))


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows; floats stay floats, all else becomes doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float32 if flat.dtype in (np.float32, np.float16) else np.float64)


def _collected(q: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, vectors and labels of a block."""
    got = q.toArrow().combine_chunks()
    cols = {n: got[n].combine_chunks() for n in got.column_names}
    ids = cols["query_id"].to_numpy(zero_copy_only=False).astype(np.int64)
    labels = np.array(cols["label"].to_pylist(), object) if "label" in cols else None
    return ids, _matrix(cols["q_vec"]) if len(ids) else np.zeros((0, 1)), labels


def _exact(name: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel distances of row pairs, summed in component order as SQL does."""
    acc = np.zeros(len(q))
    if name in ("L2", "L1"):
        for i in range(q.shape[1]):
            d = q[:, i] - b[:, i]
            acc += d * d if name == "L2" else np.abs(d)
        return acc
    qq, bb = np.zeros(len(q)), np.zeros(len(q))
    for i in range(q.shape[1]):
        acc += q[:, i] * b[:, i]
        qq += q[:, i] * q[:, i]
        bb += b[:, i] * b[:, i]
    if name == "DOT":
        return -acc
    size = np.sqrt(qq) * np.sqrt(bb)
    return 1 - np.divide(acc, size, out=np.zeros_like(acc), where=size != 0)


def _near(name: str, q: np.ndarray, b: np.ndarray, qq: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel distances of a tile as fast as they come, and a bound on how far off each may be."""
    if name == "L1":
        near = np.empty((len(q), len(b)))
        wide = b.astype(np.float64)
        for i, v in enumerate(q.astype(np.float64)):
            near[i] = np.abs(wide - v).sum(1)
        return near, near * 1e-12
    # A sum of n products is off by n + 2 roundings of the norms' product at most.
    unit = (q.shape[1] + 4) * np.finfo(np.float64).eps
    dots = q @ b.T
    scale = np.sqrt(qq[:, None] * bb[None, :])
    if name == "DOT":
        return -dots, scale * unit
    if name == "L2":
        return qq[:, None] + bb[None, :] - 2 * dots, scale * (2 * unit) + (qq[:, None] + bb[None, :]) * 1e-12
    return 1 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale != 0), np.full_like(dots, unit + 1e-12)


def _scored(name: str, q: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact kernel distances of index pairs, some at a time."""
    step, out = max(1, RESCORED // q.shape[1]), np.empty(len(i))
    for a in range(0, len(i), step):
        x = slice(a, a + step)
        out[x] = _exact(name, q[i[x]].astype(np.float64), b[j[x]].astype(np.float64))
    return out


class Nearest:
    """The k nearest of each query among the base rows seen so far."""

    def __init__(self, q: np.ndarray, k: int, name: str) -> None:
        self.q, self.k, self.name = _tame(q), k, name
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        self.kernel = np.full((len(q), k), np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> None:
        """See base rows; ``own`` are the queries that they count for, all of them if None."""
        own = np.arange(len(self.q)) if own is None else own
        for x in range(0, len(b), ROWS):
            part, names = b[x : x + ROWS], ids[x : x + ROWS]
            # What is not finite is no neighbour in any metric.
            fine = np.isfinite(part).all(1)
            part, names = (part, names) if fine.all() else (part[fine], names[fine])
            step = max(1, CELLS // max(1, len(part)))
            for y in range(0, len(own) if len(part) else 0, step):
                self._tile(own[y : y + step], names, part)

    def _tile(self, own: np.ndarray, ids: np.ndarray, b: np.ndarray) -> None:
        k, q = self.k, self.q[own]
        limit = self.kernel[own, k - 1]
        with np.errstate(all="ignore"):
            score, error, most = _scores(self.name, q, _tame(b), self.norm[own], limit)
            odd = None if np.isfinite(error).all() else ~np.isfinite(score)
            if odd is not None:
                score[odd] = np.inf
            keep = score <= (most + 2 * error)[:, None]
            if len(ids) > k and np.count_nonzero(keep) > 2 * k * len(own):
                most = np.minimum(most, np.partition(score, k - 1, axis=1)[:, k - 1])
                keep = score <= (most + 2 * error)[:, None]
            if odd is not None:
                keep |= odd
            i, j = np.nonzero(keep)
            kernel = _scored(self.name, q, b, i, j)
        ok = np.isfinite(kernel) & (kernel <= limit[i])
        i, j, kernel = i[ok], j[ok], kernel[ok]
        if not len(i):
            return
        # The k first by (kernel, id) of what each query had and has now.
        hit = np.unique(i)
        who = np.concatenate((np.repeat(hit, k), i))
        kern = np.concatenate((self.kernel[own[hit]].ravel(), kernel))
        name = np.concatenate((self.id[own[hit]].ravel(), ids[j]))
        order = np.lexsort((name, kern, who))
        who, kern, name = who[order], kern[order], name[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        self.kernel[own[hit]] = kern[first].reshape(-1, k)
        self.id[own[hit]] = name[first].reshape(-1, k)


class Direct:
    """The k nearest of each query, by every distance as SQL sums it. Shares nothing with Nearest that could hide an error of either."""

    def __init__(self, q: np.ndarray, k: int, name: str) -> None:
        self.q, self.k, self.name = q.astype(np.float64), k, name
        self.kernel = np.full((len(q), k), np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = _size(self.q.T) if name == "COSINE" else None

    def add(self, ids: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> None:
        """See base rows; ``own`` are the queries that they count for, all of them if None."""
        own = np.arange(len(self.q)) if own is None else own
        rows = -(-len(b) // -(-len(b) // ROWS))
        step = max(1, CACHED // rows)
        for x in range(0, len(b), rows):
            names, wide = ids[x : x + rows], np.ascontiguousarray(b[x : x + rows].T, np.float64)
            for y in range(0, len(own), step):
                who = own[y : y + step]
                with np.errstate(all="ignore"):
                    self._kept(who, names, self._kernels(who, wide))
            self.settle()

    def _kernels(self, who: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A tile's kernel distances, one component after the other; ``b`` has a component in each row."""
        q, acc, d = self.q[who], np.zeros((len(who), b.shape[1])), np.empty((len(who), b.shape[1]))
        for c in range(len(b)):
            (np.subtract if self.name in ("L2", "L1") else np.multiply)(q[:, c, None], b[c], out=d)
            if self.name == "L2":
                np.multiply(d, d, out=d)
            elif self.name == "L1":
                np.abs(d, out=d)
            np.add(acc, d, out=acc)
        if self.name == "DOT":
            return np.negative(acc, out=acc)
        if self.name == "COSINE":
            size = self.size[who][:, None] * _size(b)
            return 1 - np.divide(acc, size, out=np.zeros_like(acc), where=size != 0)
        return acc

    def _kept(self, who: np.ndarray, ids: np.ndarray, kernel: np.ndarray) -> None:
        keep = np.isfinite(kernel) & (kernel <= self.kernel[who, self.k - 1][:, None])
        if len(ids) > self.k and np.count_nonzero(keep) > 2 * self.k * len(who):
            keep &= kernel <= np.partition(np.where(keep, kernel, np.inf), self.k - 1, axis=1)[:, self.k - 1, None]
        i, j = np.nonzero(keep)
        self.offer(who[i], ids[j], kernel[i, j])

    def offer(self, who: np.ndarray, ids: np.ndarray, kernel: np.ndarray) -> None:
        """Take pairs with their finite distances; some are held before they are ranked."""
        if len(who):
            self.pending.append((who, ids, kernel))
        if sum(len(w) for w, _, _ in self.pending) > RESCORED:
            self.settle()

    def settle(self) -> None:
        """The k first by (kernel, id) of what each query had and was offered."""
        if not self.pending:
            return
        who, ids, kernel = (np.concatenate(c) for c in zip(*self.pending, strict=True))
        hit = np.unique(who)
        who, ids, kernel = np.concatenate((np.repeat(hit, self.k), who)), np.concatenate((self.id[hit].ravel(), ids)), np.concatenate((self.kernel[hit].ravel(), kernel))
        order = np.lexsort((ids, kernel, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, place = order[place < self.k], place[place < self.k]
        self.kernel[who[order], place], self.id[who[order], place] = kernel[order], ids[order]
        self.pending = []


def _size(v: np.ndarray) -> np.ndarray:
    """Norms of vectors that have a component in each row, summed in component order."""
    acc = np.zeros(v.shape[1])
    for c in v:
        acc += c * c
    return np.sqrt(acc)


#: What finds a task's neighbours, by the plan.
ENGINES = {"blocks": Nearest, "direct": Direct}


def _tame(v: np.ndarray) -> np.ndarray:
    """As doubles, if floats could overflow in a product."""
    top = np.abs(v).max(initial=0)
    return v if v.dtype == np.float64 or top < LARGE[v.dtype] else v.astype(np.float64)


def _scores(name: str, q: np.ndarray, b: np.ndarray, norm: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's scores, by which each query's rows are ordered as by the kernel; how far off they may be, and the limit as a score, for each query.

    The error is infinite where products may overflow.
    """
    if name == "L1":
        near = np.empty((len(q), len(b)))
        wide, at = b.astype(np.float64), q.astype(np.float64)
        rows = max(1, CACHED // q.shape[1])
        for x in range(0, len(b), rows):
            part = wide[x : x + rows]
            apart = np.empty_like(part)
            for i, v in enumerate(at):
                np.abs(np.subtract(part, v, out=apart), out=apart).sum(1, out=near[i, x : x + rows])
        return near, near.max(1) * 1e-12, limit
    if q.dtype != b.dtype:
        q, b = q.astype(np.float64), b.astype(np.float64)
    wide = b.astype(np.float64)
    bb = (wide * wide).sum(1)
    eps, top = float(np.finfo(q.dtype).eps), np.sqrt(bb.max())
    # A sum of n products is off by n + 2 roundings of the norms' product at most.
    unit = (q.shape[1] + 8) * eps
    odd = max(np.abs(q).max(), np.abs(b).max()) >= LARGE[q.dtype]
    if name == "COSINE":
        b = (wide / np.where(bb > 0, np.sqrt(bb), 1)[:, None]).astype(q.dtype)
        score, error, most = -(q @ b.T), norm * unit + 1e-300, np.where(np.isfinite(limit), (limit - 1) * norm + norm * 1e-12, np.inf)
    elif name == "DOT":
        score, error, most = -(q @ b.T), norm * (top * unit), limit
    else:
        # Half the squared distance, without the query's own part.
        score = q @ b.T
        np.subtract((bb / 2).astype(q.dtype), score, out=score)
        error, most = norm * (top * unit) + (top * top + norm * top) * (4 * eps), (limit - norm * norm) / 2 + (np.where(np.isfinite(limit), limit, 0) + norm * norm) * 1e-12
    # Comparisons are made in the scores' own type.
    return score, np.full(len(q), np.inf) if odd else error + np.abs(np.where(np.isfinite(most), most, 0)) * (4 * eps), most


def _candidates(base: DataFrame, queries: DataFrame, k: int, name: str, engine: type = Nearest) -> DataFrame:
    """(query_id, neighbor_id, kernel, distance): of each task its k nearest to each query; with a label column on both sides, within the label."""
    held = base.sparkSession.sparkContext.broadcast(_collected(queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, labels = held.value
        if not len(qid):
            return
        best = engine(q, k, name)
        by_label: dict = {}
        for i, x in enumerate(labels if labels is not None else ()):
            by_label.setdefault(x, []).append(i)
        by_label = {x: np.array(v) for x, v in by_label.items() if x is not None}
        for batch in batches:
            col = batch.column(1)
            rows = batch.filter(col.is_valid()) if col.null_count else batch
            if not rows.num_rows:
                continue
            ids, b = rows.column(0).to_numpy(zero_copy_only=False), _matrix(rows.column(1))
            if labels is None:
                best.add(ids, b)
                continue
            of: dict = {}
            for j, x in enumerate(rows.column(2).to_pylist()):
                if x in by_label:
                    of.setdefault(x, []).append(j)
            for x, j in of.items():
                best.add(ids[j], b[j], by_label[x])
        yield from _found(best, qid, name)

    return map_arrow(base, run, KEPT)


#: What a task hands on.
KEPT = "query_id bigint, neighbor_id bigint, kernel double, distance double"


def _found(best: Nearest | Direct, qid: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """A task's neighbours as rows."""
    i, r = np.nonzero(np.isfinite(best.kernel))
    for a in range(0, len(i), 100_000):
        kernel = best.kernel[i[a : a + 100_000], r[a : a + 100_000]]
        published = -kernel if name == "DOT" else 1 - kernel if name == "COSINE" else kernel
        yield pa.RecordBatch.from_arrays(
            [pa.array(qid[i[a : a + 100_000]]), pa.array(best.id[i[a : a + 100_000], r[a : a + 100_000]]), pa.array(kernel), pa.array(published)], names=["query_id", "neighbor_id", "kernel", "distance"]
        )


def knn_arrays(neighbors: DataFrame, k: int) -> DataFrame:
    """(query_id, indices, distances): in rank order, padded to k with -1 and infinity."""
    rows = neighbors.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "distance"))).alias("r"))
    short = F.greatest(F.lit(k) - F.size("r"), F.lit(0))
    return rows.select(
        "query_id",
        F.concat(F.col("r.neighbor_id"), F.array_repeat(F.lit(-1).cast("bigint"), short)).alias("indices"),
        F.concat(F.col("r.distance"), F.array_repeat(F.lit(float("inf")), short)).alias("distances"),
    )


def knn_ties(base: DataFrame, queries: DataFrame, k: int, metric: str = "L2", cosine_mode: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, tied_neighbors): base rows at exactly the distance of the k-th neighbour, where more than k are no farther.

    A second pass counts, in tiles, the base rows at and within that distance; no pair leaves its task.
    """
    name = resolved(metric, cosine_mode)
    q, b = _sides(base, queries, id_col, vec_col)
    out = None
    for part in _blocks(q, k):
        kth = _candidates(b, part, k, name).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("kernel")), k, 1).alias("far")).where("size(far) = 1")
        counts = _within(b, part.join(kth.select("query_id", F.col("far")[0].alias("far")), "query_id"), name)
        out = counts if out is None else out.unionByName(counts)
    tied = out.groupBy("query_id").agg(F.sum("at").alias("at"), F.sum("nearer").alias("nearer")).where(F.col("at") + F.col("nearer") > k)
    return queries.select(F.col(id_col).alias("query_id")).join(tied.select("query_id", F.col("at").alias("tied_neighbors")), "query_id", "left").na.fill(0, ["tied_neighbors"])


def _within(base: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """(query_id, at, nearer): of each task the base rows at just the distance ``far`` of each query, and nearer."""
    got = queries.select("query_id", "q_vec", "far").toArrow().combine_chunks()
    ids = got["query_id"].combine_chunks().to_numpy(zero_copy_only=False)
    held = base.sparkSession.sparkContext.broadcast((ids, _matrix(got["q_vec"].combine_chunks()) if len(ids) else np.zeros((0, 1)), got["far"].combine_chunks().to_numpy(zero_copy_only=False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, far = held.value
        if not len(qid):
            return
        wide = q.astype(np.float64)
        qq, at, nearer = (wide * wide).sum(1), np.zeros(len(qid), np.int64), np.zeros(len(qid), np.int64)
        for batch in batches:
            col = batch.column(1)
            rows = batch.filter(col.is_valid()) if col.null_count else batch
            if not rows.num_rows:
                continue
            b = _matrix(rows.column(1)).astype(np.float64)
            bb, step = (b * b).sum(1), max(1, CELLS // ROWS)
            for x in range(0, len(b), ROWS):
                for y in range(0, len(qid), step):
                    z = slice(y, y + step)
                    with np.errstate(all="ignore"):
                        near, slack = _near(name, wide[z], b[x : x + ROWS], qq[z], bb[x : x + ROWS])
                        nearer[z] += (near + slack < far[z, None]).sum(1)
                        i, j = np.nonzero((np.abs(near - far[z, None]) <= slack) | ~np.isfinite(near))
                        kernel = _scored(name, wide[z], b[x : x + ROWS], i, j)
                    np.add.at(at, i + y, kernel == far[z][i])
                    np.add.at(nearer, i + y, kernel < far[z][i])
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(at), pa.array(nearer)], names=["query_id", "at", "nearer"])

    return map_arrow(base, run, "query_id bigint, at bigint, nearer bigint")


def knn_distances(ground: DataFrame, base: DataFrame, queries: DataFrame, metric: str = "L2", cosine_mode: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance) recomputed for the neighbours of ``ground``; negative ordinals are at infinity."""
    q, b = _sides(base, queries, id_col, vec_col)
    published = vec.distance(resolved(metric, cosine_mode), F.col("q_vec"), F.col("b_vec"))[1]
    rows = ground.select("query_id", "rank", "neighbor_id").join(q, "query_id").join(b, "neighbor_id", "left")
    inf = F.lit(float("inf"))
    missing = F.raise_error(F.concat(F.lit("no base row "), F.col("neighbor_id").cast("string"))).cast("double")
    d = F.when(F.col("neighbor_id") < 0, inf).when(F.col("b_vec").isNull(), missing).otherwise(published)
    return rows.select("query_id", "rank", "neighbor_id", d.alias("distance"))


def prefiltered_knn(
    base: DataFrame, queries: DataFrame, passing: DataFrame, k: int, metric: str = "L2", cosine_mode: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", preds: DataFrame | None = None, plan: str = "blocks"
) -> DataFrame:
    """The k nearest among each query's passing rows; ``passing`` is (query_id, ordinal), ordinals without a base row are skipped.

    Where queries share filters, ``passing`` is (pred_id, ordinal) and ``preds`` has one (query_id, pred_id) for each query. Pairs are
    then made in tiles alone, by the plan. Pairs that are given as such are moved as two ids and meet the queries, which are broadcast,
    in the base row's task; either way a task keeps k rows a query.
    """
    name = resolved(metric, cosine_mode)
    q, b = _sides(base, queries, id_col, vec_col)
    by = F.col("query_id").cast("bigint") if preds is None else F.col("pred_id")
    rows = passing.select(by.alias("label"), F.col("ordinal").alias("neighbor_id")).distinct().join(b, "neighbor_id").select("neighbor_id", "b_vec", "label")
    if preds is not None:
        return _knn(q.join(preds.select("query_id", F.col("pred_id").alias("label")), "query_id"), rows, k, name, plan)
    blocks = _blocks(q, k)
    parts = [_paired(rows if len(blocks) == 1 else rows.where(_block("label", len(blocks)) == i), part, k, name) for i, part in enumerate(blocks)]
    return top_k(reduce(DataFrame.unionByName, parts), k)


def _paired(rows: DataFrame, queries: DataFrame, k: int, name: str) -> DataFrame:
    """(query_id, neighbor_id, kernel, distance): of each task the k nearest to each query, among the pairs of a base row and a query's id."""
    held = rows.sparkSession.sparkContext.broadcast(_collected(queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, _ = held.value
        if not len(qid):
            return
        best, order = Direct(q, k, name), np.argsort(qid)
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(1).is_valid(), pc.is_in(batch.column(2), pa.array(qid))))
            if not batch.num_rows:
                continue
            ids, b = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            who = order[np.searchsorted(qid, batch.column(2).to_numpy(zero_copy_only=False), sorter=order)]
            with np.errstate(all="ignore"):
                kernel = _scored(name, best.q, b, who, np.arange(len(b)))
            ok = np.isfinite(kernel) & (kernel <= best.kernel[who, k - 1])
            best.offer(who[ok], ids[ok], kernel[ok])
        best.settle()
        yield from _found(best, qid, name)

    return map_arrow(rows, run, KEPT)


def postfiltered_knn(ground: DataFrame, passing: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """(query_id, neighbor_id, rank): those of the known neighbours that pass, ranked anew in the same order.

    ``passing`` and ``preds`` are as in prefiltered_knn().
    """
    kept = passed(ground, passing, preds)
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.select("query_id", "neighbor_id", (F.row_number().over(w) - 1).cast("int").alias("rank"))


def passed(ground: DataFrame, passing: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """The rows of ``ground`` whose neighbour passes its query's filter."""
    by = "query_id" if preds is None else "pred_id"
    rows = passing.select(by, F.col("ordinal").alias("neighbor_id"))
    own = ground if preds is None else ground.join(preds.select("query_id", "pred_id"), "query_id")
    return own.join(rows, [by, "neighbor_id"], "left_semi").select(*ground.columns)


def partition_profiles(base: DataFrame, label_col: str = "label", id_col: str = "vec_id", least: int = 1, most: int = 50) -> DataFrame:
    """(label, ordinal, id): each label's own ordinals from 0; labels with fewer than ``least`` rows are left out, more than ``most`` labels are an error."""
    sizes = base.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if sizes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} partitions")
    own = base.join(F.broadcast(sizes.select(label_col)), label_col).select(F.col(label_col).alias("label"), F.col(id_col).alias("id"))
    placed = running_sums(own, ["label"], ["id"], place=F.lit(1))
    return placed.select("label", (F.col("place") - 1).cast("bigint").alias("ordinal"), "id")


def partitioned_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "L2", cosine_mode: str | None = None, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(label, query_id, neighbor_id, rank, distance): nearest neighbours within the query's own label.

    The base stays where it is read: a label that a third of it has is spread over all tasks.
    """
    name = resolved(metric, cosine_mode)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("q_vec"), F.col(label_col).alias("label"))
    b = base.select(F.col(id_col).alias("neighbor_id"), F.col(vec_col).alias("b_vec"), F.col(label_col).alias("label"))
    out = _knn(q, b, k, name)
    return q.select("query_id", "label").join(out, "query_id").select("label", "query_id", "neighbor_id", "rank", "distance")


def sized_knn(base: DataFrame, queries: DataFrame, sizes: list[int], k: int, metric: str = "L2", cosine_mode: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", offset: int = 0) -> DataFrame:
    """(size, query_id, neighbor_id, rank, distance) over the first n base rows, for each n.

    Distances are computed once. Each segment between two sizes keeps its k nearest, and a size ranks
    those of its segments: what is ranked again is k rows a segment, not the base.
    """
    name, steps = resolved(metric, cosine_mode), sorted(set(sizes))
    q, b = _sides(base, queries, id_col, vec_col)
    blocks, best = _blocks(q, k), None
    for i, (low, high) in enumerate(zip([None, *steps], steps, strict=False)):
        own = b.where(F.col("neighbor_id") < high + offset)
        own = own if low is None else own.where(F.col("neighbor_id") >= low + offset)
        for part in blocks:
            found = _candidates(own, part, k, name).withColumn("size", F.explode(F.array(*map(F.lit, steps[i:]))))
            best = found if best is None else best.unionByName(found)
    w = Window.partitionBy("size", "query_id").orderBy("kernel", "neighbor_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("size", "query_id", "neighbor_id", (F.col("rank") - 1).cast("int").alias("rank"), "distance")
