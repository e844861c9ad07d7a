import zlib

import numpy as np
import pytest

from orrery.llm import quality as Q

from .common import SCHEMA, frame, hard_rows, texts


def slow_score(net, shift, data):
    """One position, filter and chunk at a time."""
    starts = [0]
    while starts[-1] + Q.CHUNK < len(data):
        starts.append(starts[-1] + Q.STEP)
    logits = []
    for s in starts:
        chunk = data[s : s + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        z = float(net.constant[0])
        for f in range(Q.FILTERS):
            best = max(sum(float(net.embed[chunk[p + i], e] * net.kernel[i * Q.EMBED + e, f]) for i in range(Q.WIDTH) for e in range(Q.EMBED)) for p in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE))
            z += max(best + float(net.bias[f]), 0.0) * float(net.weight[f])
        logits.append(z)
    return 1 / (1 + np.exp(-(np.mean(logits) + shift)))


def test_score_is_the_network_over_all_chunks(monkeypatch):
    monkeypatch.setattr(Q, "FILTERS", 3)
    net = Q.Network(1)
    net.weight[:] = [1.0, -2.0, 0.5]
    texts = [b"", b"short", bytes(range(256)) * 3, b"x" * 512, b"y" * 513, b"words of a text " * 60]
    got = Q.score_texts(net, 0.3, texts, slab=2)
    assert np.allclose(got, [slow_score(net, 0.3, t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 959, 960, 961, 5000])
def test_chunks_cover_all_bytes(n):
    data = bytes((i % 255) + 1 for i in range(n))
    chunks = Q.cut_chunks(data)
    seen = bytearray(len(chunks) * Q.STEP + Q.CHUNK)
    for i, c in enumerate(chunks):
        seen[i * Q.STEP : i * Q.STEP + Q.CHUNK] = c.tobytes()
    assert bytes(seen[:n]) == data and not any(seen[n:])
    assert n <= Q.CHUNK or (len(chunks) - 2) * Q.STEP + Q.CHUNK < n


def test_gradients():
    net = Q.Network(2)
    r = np.random.default_rng(0)
    net.weight[:] = r.normal(size=Q.FILTERS)
    x, y = r.integers(1, 256, (5, Q.CHUNK), dtype=np.uint8), np.array([0, 1, 1, 0, 1], np.float32)
    grads, loss = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = net.gradients(x, y)[1]
        p[i] = old - 1e-2
        down = net.gradients(x, y)[1]
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 0.05 * abs(g[i]) + 1e-3
    assert loss > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 500
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert np.mean([r.predicted for r in out if r.quality == 1]) > 0.98


def test_a_leading_space_hardly_moves_a_score(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net, shift = Q.learn(docs, labels)
    data = [r.text.encode() for r in docs.orderBy("doc_id").limit(300).collect()]
    a, b = Q.score_texts(net, shift, data), Q.score_texts(net, shift, [b" " + t for t in data])
    assert np.sum((a >= Q.KEEP) != (b >= Q.KEEP)) <= 1
    assert np.abs(a - b).mean() < 0.01


def test_hard_rows_and_no_labels(spark, sf):
    rows = hard_rows(texts(spark, sf))
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None), (None, 1)], "doc_id long, quality int")
    got = Q.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r, s in ((r.doc_id, r.score) for r in got):
        by.setdefault(r, set()).add(s)
    assert len(by[7]) == 1
    assert {r.score for r in Q.classify(df, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def test_learning_leaves_held_out_rows_alone(spark, sf):
    docs = frame(spark, hard_rows(texts(spark, sf)))
    a = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else i % 2) for i in range(60)], "doc_id long, quality int")
    x, y = Q.learn(docs, a), Q.learn(docs, b)
    assert x[1] == y[1] and all((p == q).all() for p, q in zip(x[0].parameters(), y[0].parameters(), strict=True))
