"""A quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes in overlapping chunks that cover all of it. Bytes are embedded, learned
filters of eight bytes run over each chunk at every byte, each filter's largest response in
the chunk is kept, and a linear layer makes a logit of them; a document's logit is the mean over its
chunks. All weights are learned by gradient descent on labelled documents; nothing but the text's
bytes goes into a score.

Learning takes place on the driver from a bounded sample: up to SAMPLE rows of each class, the first
by a hash of their ids, with up to PER_ROW chunks each, spread over the whole text. The logit is
corrected from the sample's balance to that of all rows learned from. Weights are a few kB and go to
the tasks with the plan.

Defined results: null and empty texts are one chunk of padding; without labels of both classes the
score is the share of label 1 among those learned from, 0.5 without any; repeated rows score alike;
a row whose id is null counts as held out if the checksum of the empty text says so; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import map_arrow

#: Bounds of the labelled sample.
SAMPLE, PER_ROW = 1500, 4
CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 1
EMBED, FILTERS = 8, 24
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 0
KEEP = 0.7


class Network:
    """Embedding (256, E), filters (WIDTH * E, F), and a linear layer on pooled responses."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.kernel = r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = np.zeros(FILTERS, np.float32)
        self.constant = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.weight, self.constant]

    def responses(self, chunks: np.ndarray, slab: int = 16) -> np.ndarray:
        """Filter responses (chunks, places, F) at every byte: windows of the embedded bytes against the filters, a few chunks at a time."""
        places = (CHUNK - WIDTH) // STRIDE + 1
        embedded = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        out = np.empty((len(chunks), places, FILTERS), np.float32)
        for i in range(0, len(chunks), slab):
            part = windows[i : i + slab]
            out[i : i + slab] = (part.reshape(-1, WIDTH * EMBED) @ self.kernel).reshape(len(part), places, FILTERS)
        return out

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(chunks).max(axis=1) + self.bias, 0)
        return pooled @ self.weight + self.constant[0]

    def gradients(self, chunks: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean logistic loss; the maximum hands its gradient to the place it came from."""
        n = len(chunks)
        r = self.responses(chunks)
        at = r.argmax(axis=1)
        top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        z = pooled @ self.weight + self.constant[0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - labels) / n).astype(np.float32)
        dtop = dz[:, None] * self.weight * (top > 0)
        windows = chunks[np.arange(n)[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        inputs = self.embed[windows].reshape(n, FILTERS, -1)
        dkernel = np.einsum("nfk,nf->kf", inputs, dtop)
        dinputs = (dtop[:, :, None] * self.kernel.T).reshape(-1, EMBED)
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, windows.reshape(-1), dinputs)
        loss = float(np.mean(np.logaddexp(0, -z * (2 * labels - 1))))
        return [dembed, dkernel, dtop.sum(0), pooled.T @ dz, np.array([dz.sum()], np.float32)], loss

    def fit(self, chunks: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches, the step falling to zero."""
        r = np.random.default_rng(seed)
        first, second, t = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        steps = epochs * -(-len(chunks) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(chunks))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                batch = chunks[own]
                # A third of the chunks are cut short, as short documents are too rare to learn padding from.
                short = np.where(r.random(len(own)) < 1 / 3, r.integers(12, CHUNK // 2, len(own)), CHUNK)
                grads, _ = self.gradients(np.where(np.arange(CHUNK) < short[:, None], batch, 0), labels[own])
                t += 1
                rate = RATE * (1 - t / (steps + 1))
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def cut_chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks (n, CHUNK) that cover all bytes; the last is padded with zeros."""
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1)
    whole = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::STEP]


def score_texts(net: Network, shift: float, texts: list[bytes], slab: int = 128) -> np.ndarray:
    """A probability for each text; ``slab`` chunks at a time are in memory, whatever the texts' lengths."""
    out = np.empty(len(texts))
    held: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []
    sums, counts, room = np.zeros(len(texts)), np.zeros(len(texts)), 0

    def flush() -> None:
        nonlocal held, owner, room
        if held:
            z = net.logits(np.concatenate(held)).astype(np.float64)
            at = 0
            for i, k in owner:
                sums[i] += z[at : at + k].sum()
                at += k
        held, owner, room = [], [], 0

    for i, data in enumerate(texts):
        chunks = cut_chunks(data)
        counts[i] = len(chunks)
        for a in range(0, len(chunks), slab):
            part = chunks[a : a + slab]
            if room + len(part) > slab:
                flush()
            held.append(part)
            owner.append((i, len(part)))
            room += len(part)
    flush()
    out[:] = 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + shift, -40, 40)))
    return out


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: the id's CRC-32, as text, is 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Network | None, float]:
    """The network and the shift of its logit; no network, and the logit of the share of 1, without both classes."""
    own = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in own.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    ones = float(np.log(prior / (1 - prior)))
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
        return None, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    picked = [own.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids: broadcast, so that no text is shuffled.
    ids = picked[0].union(picked[1])
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    data = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    k = F.least(F.lit(PER_ROW), F.greatest(F.ceil(n / CHUNK), F.lit(1))).cast("int")
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, F.floor(i * F.greatest(n - CHUNK, F.lit(0)) / F.greatest(k - 1, F.lit(1)))).otherwise(0).cast("int"))
    parts = own.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_id", "_label", F.posexplode(F.transform(at, lambda a: F.substring(data, a + 1, F.lit(CHUNK)))).alias("k", "part"))
    rows = parts.toArrow()
    # In a fixed order, whatever order the tasks ended in.
    order = sorted(range(rows.num_rows), key=lambda i: (rows["_id"][i].as_py(), rows["k"][i].as_py(), rows["part"][i].as_py()))
    chunks = np.zeros((len(order), CHUNK), np.uint8)
    for j, i in enumerate(order):
        b = np.frombuffer(rows["part"][i].as_py(), np.uint8)
        chunks[j, : len(b)] = b
    y = rows["_label"].to_numpy()[order].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None, ones
    net = Network()
    net.fit(chunks, y)
    seen = y.mean()
    return net, ones - float(np.log(seen / (1 - seen)))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    net, shift = learn(docs, labels, label_col, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(2)]
                score = score_texts(net, shift, texts) if net else np.full(len(texts), 1 / (1 + np.exp(-shift)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= keep).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(slim, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, by the same network in the same pass."""
    net, shift = learn(docs, labels, "quality", id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(at)]
                score = score_texts(net, shift, texts) if net else np.full(len(texts), 1 / (1 + np.exp(-shift)))
                yield part.filter(pa.array(score >= keep))

    return map_arrow(docs, run, docs.schema)
