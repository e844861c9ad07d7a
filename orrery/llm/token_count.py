"""Token counts by a compiled finite-state transducer.

Merging by rank has two properties: the tokens of a prefix of a token sequence are that prefix, and a
sequence is what merging gives if all its neighbouring pairs are. So the last token of every prefix
of a text is unique, and it follows from the last tokens of the few prefixes before it. A state
holds just those: the longest end of the text that begins some piece, with the last token and the
relative count at each of its positions. Its transitions, compiled when first taken, carry the change
in the number of tokens. Where no piece contains a pair of neighbouring characters, nothing can
merge across it, and the machine is back in its start state: a reset.

A long text is cut into chunks. A chunk's map takes an entry state to an exit state and a count. Up to its
first reset it depends on the entry state and is tabulated for those that occur; beyond, it is the same for
all. Maps compose associatively: a text's are joined in a tree, level by level, each composition a map of its
own. Tables hold states by what they stand for, never a text, so memory grows with the text alone.

Words between resets are taken in one step through a bounded cache of their counts.

Defined results: null and empty texts have no tokens; repeated rows are counted alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import map_arrow

SPACE = "▁"
#: Characters in a chunk; compiled transitions, and characters of cached words, that a worker keeps before it starts either anew.
CHUNK, TRANSITIONS, CACHED = 1 << 15, 600_000, 3_000_000
#: A word of more characters than this is counted anew each time.
LONG = 64
LIMIT = 4096


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field number, wire type, value) of a serialized protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, data[at : at + n]
            at += n


def read_pieces(model: bytes) -> dict[str, float]:
    """Normal pieces and their scores from a model file: field 1 holds pieces (1 text, 2 score, 3 type)."""
    out = {}
    for field, _, value in _fields(model):
        if field == 1:
            text, score, kind = "", 0.0, 1
            for f, _, v in _fields(value):
                if f == 1:
                    text = v.decode("utf-8")
                elif f == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif f == 3:
                    kind = v
            if kind == 1:
                out[text] = score
    return out


#: The state at the beginning of a text and after a reset.
START = ("", (None,), (0,))


class Transducer:
    """The machine of one model, compiled as it runs. A state is the dict of its transitions, with what it stands for under None."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.begins = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Words begin at a space after another character, and at and after a newline.
        odd = [x for x in self.inside if x[1] == SPACE != x[0] or "\n" in x]
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+") if not odd else None
        self.cache: dict[str, int] = {}
        self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.joins: dict[tuple[str | None, str], bool] = {}
        self.shapes: dict[str, tuple] = {}
        self.size = 0
        self.begin = self._state(START)

    def _state(self, key: tuple) -> dict:
        if (s := self.states.get(key)) is None:
            s = self.states[key] = {None: key}
        return s

    def weight(self, token: str) -> int:
        """Ids that a token becomes: one, or a byte each where it is no piece."""
        return 1 if token in self.pieces else len(token.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, key: tuple[str | None, str]) -> bool:
        """Whether a token may stand after the one before it (None: nothing merges across)."""
        before, token = key
        found = self.joins[key] = self.merged((before or "") + token) == ([before, token] if before else [token])
        return found

    def _shape(self, text: str) -> tuple:
        """Of a window and a character: the tokens that can end there, where the next window starts, and its places at which none can start."""
        ends = tuple((s, text[s:], self.weight(text[s:])) for s in range(len(text)) if text[s:] in self.pieces or s == len(text) - 1)
        cut = next((s for s in range(len(text)) if text[s:] in self.begins), len(text))
        dead = tuple(s - cut for s in range(cut, len(text)) if text[s:] not in self.begins)
        out = self.shapes[text] = ends, cut, text[cut:], dead
        return out

    def step(self, state: dict, c: str) -> tuple[dict, int]:
        """Compile the transition of a state under a character."""
        window, lasts, counts = state[None]
        if lasts[-1] is not None and lasts[-1][-1] + c not in self.inside:
            lasts = (*lasts[:-1], None)
        text = window + c
        ends, cut, after, dead = self.shapes.get(text) or self._shape(text)
        joins = self.joins
        for s, token, weight in ends:
            key = lasts[s], token
            fits = joins.get(key)
            if fits if fits is not None else self._fits(key):
                break
        else:
            raise AssertionError(f"no token ends at {c!r} after {window!r}")
        change = counts[s] + weight
        lasts, counts = [*lasts[cut:], token], [*[n - change for n in counts[cut:]], 0]
        for s in dead:
            lasts[s], counts[s] = None, 0
        state[c] = out = self._state((after, tuple(lasts), tuple(counts))), change
        self.size += 1
        return out

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """The state after a text, and the change in the number of tokens. States go in and out as what they stand for, so that transitions can be forgotten between."""
        state, n = self.begin if key is START else self._state(key), 0
        for c in text:
            if (to := state.get(c)) is None:
                if self.size >= TRANSITIONS:
                    state = self._forget(state)
                to = self.step(state, c)
            state, d = to
            n += d
        return state[None], n

    def _forget(self, state: dict) -> dict:
        """Start the compiled transitions anew; the state goes on."""
        key = state[None]
        self._clear()
        gc.collect()  # states refer to each other
        return self._state(key)

    def word(self, text: str) -> int:
        """The count of a text that stands between resets."""
        return self.run(START, text)[1]

    def count_words(self, words: list[str]) -> int:
        cache = self.cache
        missing = set(words).difference(cache)
        if not missing:
            return sum(map(cache.__getitem__, words))
        # States are many small containers that stay: the collector would walk them again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            own = {w: self.word(w) for w in missing}
        finally:
            if on:
                gc.enable()
        short = {w: n for w, n in own.items() if len(w) <= LONG}
        self.held += sum(map(len, short))
        if self.held > CACHED:
            self.cache = cache = {w: cache[w] for w in set(words) if w in cache}
            self.held = sum(map(len, cache)) + sum(map(len, short))
        cache.update(short)
        if len(short) == len(own):
            return sum(map(cache.__getitem__, words))
        return sum(own[w] if w in own else cache[w] for w in words)


class StateMap:
    """What a stretch of text does to an entry state: ``at(entry)`` is (exit state, count), tabulated as it is asked for.

    ``beyond`` is (exit state, count) from the first reset on, None without one; a chunk runs ``head`` from the entry state.
    """

    __slots__ = ("beyond", "first", "head", "machine", "second", "table")

    def __init__(self, machine: Transducer, head: str, beyond: tuple[tuple, int] | None, first: StateMap | None = None, second: StateMap | None = None) -> None:
        self.machine, self.head, self.beyond, self.first, self.second = machine, head, beyond, first, second
        self.table: dict[tuple, tuple[tuple, int]] = {}

    @classmethod
    def of(cls, machine: Transducer, chunk: str) -> StateMap:
        """The map of a chunk. Its first word may go on from the chunk before, its last into the next."""
        words = machine.words.findall(chunk) if machine.words else [chunk]
        if len(words) < 2:
            return cls(machine, chunk, None)
        out, n = machine.run(START, words[-1])
        return cls(machine, words[0], (out, n + machine.count_words(words[1:-1])))

    def at(self, entry: tuple) -> tuple[tuple, int]:
        if (found := self.table.get(entry)) is None:
            if self.first is None:
                out, n = self.machine.run(entry, self.head)
                found = (out, n) if self.beyond is None else (self.beyond[0], n + self.beyond[1])
            else:
                middle, n = self.first.at(entry)
                out, more = self.second.at(middle)
                found = out, n + more
            self.table[entry] = found
        return found

    def then(self, other: StateMap) -> StateMap:
        """This map, then the other. The exit state of a map with a reset is known whatever comes in, so the other is tabulated for it now."""
        if self.beyond is not None:
            other.at(self.beyond[0])
        return StateMap(self.machine, "", None, self, other)


def composed(maps: list[StateMap]) -> StateMap:
    """All maps as one: neighbours are joined, level by level, and each level could run in parallel."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(machine: Transducer, text: str | None, chunk: int = CHUNK) -> int:
    """Tokens of a whole text: its chunks' maps, composed."""
    if not text:
        return 0
    norm = SPACE + text.replace(" ", SPACE)
    return composed([StateMap.of(machine, norm[i : i + chunk]) for i in range(0, len(norm), chunk)]).at(START)[1]


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    """One machine per Python worker, kept between tasks."""
    return Transducer(read_pieces(model))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model.value)
        for b in batches:
            n = np.fromiter((count_tokens(machine, t.as_py()) for t in b.column(2)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(slim, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
