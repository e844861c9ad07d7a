import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import bpe

from .common import SCHEMA, frame, hard_rows, texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RAW = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RAW, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, library, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, "ab" * 9000, "\n" * 300, "é" * 999, "<|endoftext|>", "don't   stop\t\n 12345"])
def test_hard_texts(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_tells_strangers(codec):
    h = codec.whole
    assert sorted(h.values) == list(range(len(codec.tokens)))
    assert all(h.get(t) == i for i, t in enumerate(codec.tokens))
    assert h.get(b"no token at all, surely") == -1 and h.get(b"") == -1
    assert bpe.PerfectHash([]).get(b"x") == -1 and bpe.PerfectHash([b"x"]).get(b"x") == 0


def test_merge_alone_gives_the_same_ids(codec):
    for t in codec.tokens[300:3000:37]:
        assert bpe.merge(t, codec.ranks) == [codec.ranks[t]]


def test_cache_is_bounded_by_characters(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 200)
    own = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for i in range(30):
        text = f"xqz{i}vbn wkj{i} " * 3 + "y" * 5000 + f" end{i}"
        assert ids(own, text) == library.encode_ordinary(text)
        assert own.held == sum(map(len, own.cache)) <= 400 and all(len(p) <= bpe.LONG for p in own.cache)


def test_table(spark, sf, library):
    rows = hard_rows(texts(spark, sf))
    got = bpe.encode_documents(frame(spark, rows), PATH, public_tokenizers.PATTERN, with_decoded=True).collect()
    want = []
    for i, t, *_ in rows:
        e = library.encode_ordinary(t or "")
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in got)
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0
