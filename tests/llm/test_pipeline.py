import hashlib
import re
import sys

import numpy as np
import public_tokenizers

import corpus_pipeline
from orrery.llm import quality
from orrery.session import table

from .test_decontam import brute as contaminated
from .test_near_copies import brute as similar


def test_against_brute_force(spark):
    """Stages by plain Python; the network is the stage's own, as its training is no matter of brute force."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]
    net, shift = quality.learn(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scores = quality.score_texts(net, shift, [t.encode() for _, t in docs])
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= quality.KEEP]
    seen, left = set(), []
    for i, t in docs:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        left += [(i, t)] if norm not in seen else []
        seen.add(norm)
    comp = similar(left)
    docs = [d for n, d in enumerate(left) if comp[n] == n]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bad = {w[0] for w in contaminated(docs, items) if w[5]}
    docs = [d for d in docs if d[0] not in bad]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in docs]
    text = dict(docs)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    assert public_tokenizers.PATTERN and "corpus_pipeline" in sys.modules


def test_empty_table_passes(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        table(spark, src, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hard_rows_and_clashing_columns_pass_every_stage(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, r string, i long, h long, t string, sha string, row long, fp long, score double, kept boolean, _id long"
    src = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, src, "documents").orderBy("doc_id").limit(40).collect()]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "x" * 30_000), (None, rows[3][1]), (None, "no id here at all"), rows[5], rows[5], (900, rows[6][1])]
    spark.createDataFrame([(i, t, None, "s", 1, "r", 1, 1, "t", "s", 1, 1, 0.5, True, 1) for i, t in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, src, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
        docs = corpus_pipeline.cut(docs, name)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert 0 < len(got) <= len({" ".join((t or "").split()) for _, t in rows})
