import gc
import random
import tracemalloc

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import token_count as T

from .common import SCHEMA, frame, hard_rows, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def machine():
    return T.Transducer(T.read_pieces(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcde the ing ▁\n\t<s>éü日本🙂"), st.characters(exclude_categories=["Cs"])), max_size=80), st.sampled_from([1, 3, 17, 1 << 15]))
def test_any_text_in_any_chunks(machine, library, text, chunk):
    assert T.count_tokens(machine, text, chunk) == len(library.encode(text))


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, " " * 5000, "\n" * 500, "<s></s><unk><0x0A>", "▁▁ a", "the" * 3000, "\x00\x01"])
def test_hard_texts(machine, library, text):
    assert T.count_tokens(machine, text) == len(library.encode(text))


def test_maps_compose_associatively(machine):
    text = T.SPACE + "one two▁threefour \nfive sixseveneight".replace(" ", T.SPACE)
    parts = [T.StateMap.of(machine, text[i : i + 5]) for i in range(0, len(text), 5)]
    left = parts[0]
    for p in parts[1:]:
        left = left.then(p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = p.then(right)
    assert left.at(T.START) == right.at(T.START) == T.composed(parts).at(T.START) == machine.run(T.START, text)


def test_start_over_when_full(machine, monkeypatch, library):
    monkeypatch.setattr(T, "TRANSITIONS", 50)
    monkeypatch.setattr(T, "CACHED", 20)
    own = T.Transducer(machine.pieces)
    text = "some words of several kinds " * 5 + "and then other ones"
    for t in (text, text[::-1], text):
        assert T.count_tokens(own, t) == len(library.encode(t))


def test_a_map_takes_each_entry_state_to_its_exit_state(machine):
    # A chunk without a reset has an entry for each state that it was asked for, all of them what running on would give.
    unbroken = T.StateMap.of(machine, "ingthereforwardsandbackwards")
    for before in ("", "th", "work", "zzz", "str"):
        entry, n = machine.run(T.START, T.SPACE + before)
        out, more = unbroken.at(entry)
        assert (out, n + more) == machine.run(T.START, T.SPACE + before + "ingthereforwardsandbackwards")
    assert len(unbroken.table) == 5 and unbroken.beyond is None


def test_memory_of_an_unbroken_text_grows_in_proportion(machine, monkeypatch):
    monkeypatch.setattr(T, "TRANSITIONS", 5_000)
    own, r, peaks = T.Transducer(machine.pieces), random.Random(2), []
    for n in (100_000, 400_000):
        text = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
        own._clear()
        gc.collect()
        tracemalloc.start()
        T.count_tokens(own, text, 4096)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert own.size <= 5_000 and own.held == 0
    assert peaks[1] < 4.5 * peaks[0]


def test_a_long_unbroken_text_as_the_library_counts_it(machine, library):
    r = random.Random(4)
    text = "".join(r.choices(["the", "ing", "tion", "x", "Q", "7", "日本", "é"], k=60_000))
    assert T.count_tokens(machine, text, 1 << 12) == len(library.encode(text))


def test_table(spark, sf, library):
    rows = hard_rows(texts(spark, sf))
    got = T.token_counts(frame(spark, rows), PATH).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert T.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
