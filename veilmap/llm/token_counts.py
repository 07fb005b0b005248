"""Token counts by finite-state tokenizer compilation.

The model is compiled into a deterministic transducer over classes of characters. Each transition is annotated with the number of tokens that
reading the character adds to the count so far (a merge makes it zero or less). A state is what decides all later counts: the
longest end of the text that can still grow into a piece and, at each place in it, the last piece of the text before and the
count there. Where no piece holds two characters side by side, the second is read from the start state, whatever came before.
Transitions are compiled when first met and kept in tables, up to MOST_STATES states, then anew, so memory is bounded on any corpus.

Texts are cut into chunks of CHUNK characters anywhere. A chunk's map takes the state that it is entered in to the state that it
is left in and to a count: one row for all entries from its first border on, and rows for the entries that come before it. All
chunks of a batch are walked in step, a character of each at a time. Maps compose by a scan: chunks with a border are left in
one state whatever they are entered in, so the rows of all chunks after them are made at once, and further rounds are only
needed for chunks without any border; counts are then prefix sums over each text's chunks.

The model keeps runs of spaces by their length alone, so a run is read as one space and its own pieces are put in.

Defined results: null text is empty, with no byte and no token; equal texts and repeated rows each give their row; an empty
table gives no rows; columns but doc_id and text are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common

MODEL, LIMIT = "piece_bpe_32k.model", 4096
CHUNK, MOST_STATES, PORTION = 256, 400_000, 1 << 21
_SPACES = re.compile(" {2,}")
_FIB = np.uint64(0x9E3779B97F4A7C15)


class Alphabet:
    """Classes of characters: one per character that pieces hold, and others by their bytes; and which may share a piece."""

    def __init__(self, pieces: bpe.Pieces):
        self.chars = sorted({c for p in pieces.parts for c in p})
        n = len(self.chars)
        self.kind = np.full(0x110000, n + 3, np.uint16)
        self.kind[:0x10000], self.kind[:0x800], self.kind[:0x80] = n + 2, n + 1, n
        self.kind[[ord(c) for c in self.chars]] = np.arange(n)
        self.kind[ord(" ")] = self.kind[ord(bpe.SPACE)]
        self.meets = np.zeros((n + 4, n + 4), bool)
        for a, b in {p[i : i + 2] for p in pieces.parts for i in range(len(p) - 1)}:
            self.meets[self.kind[ord(a)], self.kind[ord(b)]] = True

    def classes(self, text: str) -> np.ndarray:
        return self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def borders(self, classes: np.ndarray) -> np.ndarray:
        """Where a character is read from the start state."""
        out = np.ones(len(classes), bool)
        out[1:] = ~self.meets[classes[:-1], classes[1:]]
        return out


class Transducer:
    """The compiled states and transitions; state 0 is the start."""

    def __init__(self, path: str):
        self.pieces = bpe.load(path)
        self.path = path
        self.alphabet = Alphabet(self.pieces)
        self.prefixes = {p[:n] for p in self.pieces.parts for n in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.size, bits = 0, 16
        self.shift = np.uint64(64 - bits)
        self.key, self.to, self.adds = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self._state("", ((None, 0),))

    def _state(self, window: str, marks: tuple) -> int:
        """marks: at each place of the window (its start first, the end last) the last piece and the count relative to the end."""
        key = (window, marks)
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
        return at

    def _holds(self, u: str | None, v: str) -> bool:
        if u is None:
            return True
        got = self.pairs.get((u, v))
        if got is None:
            if len(self.pairs) > 2 * MOST_STATES:
                self.pairs.clear()
            got = self.pairs[u, v] = self.pieces.holds(u, v)
        return got

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """Compile a transition: (state, tokens added)."""
        if kind >= len(self.alphabet.chars):  # bytes; nothing merges over them
            return 0, kind - len(self.alphabet.chars) + 1
        window, marks = self.states[state]
        grown = window + self.alphabet.chars[kind]
        last, count = next((grown[j:], marks[j][1] + 1) for j in range(len(grown)) if grown[j:] in self.pieces.parts and self._holds(marks[j][0], grown[j:]))
        marks = (*marks, (last, count))
        keep = next((j for j in range(len(grown)) if grown[j:] in self.prefixes), len(grown))
        return self._state(grown[keep:], tuple((p, c - count) for p, c in marks[keep:])), count

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, found) of each key: where it is, or the free slot where it belongs."""
        last = len(self.key) - 1
        slot = (keys.astype(np.uint64) * _FIB >> self.shift).astype(np.int64)
        held = self.key[slot]
        found = held == keys
        left = np.flatnonzero(~found & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & last
            held = self.key[slot[left]]
            found[left] = held == keys[left]
            left = left[~found[left] & (held != -1)]
        return slot, found

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        if 2 * (self.size + len(keys)) > len(self.key):
            full = self.key != -1
            keys, to, adds = (np.concatenate([a[full], b]) for a, b in ((self.key, keys), (self.to, to), (self.adds, adds)))
            bits = (4 * len(keys)).bit_length()
            self.shift, self.size = np.uint64(64 - bits), 0
            self.key, self.to, self.adds = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.size += len(keys)
        while len(keys):
            slot, _ = self._slots(keys)
            self.key[slot] = keys  # of keys that meet in a slot the last one stays, the others go on
            won = self.key[slot] == keys
            self.to[slot[won]], self.adds[slot[won]] = to[won], adds[won]
            keys, to, adds = keys[~won], to[~won], adds[~won]

    def read(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, tokens added) of reading one character in each state."""
        keys = state.astype(np.int64) << 16 | kind
        slot, found = self._slots(keys)
        if not found.all():
            new = np.unique(keys[~found])
            made = [self.step(k >> 16, k & 0xFFFF) for k in new.tolist()]
            self._put(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int32))
            slot, _ = self._slots(keys)
        return self.to[slot], self.adds[slot]

    def walk(self, kinds: np.ndarray, border: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state at the end, tokens) of the spans [begin, end), each entered in its state; all spans go on in step."""
        order = np.argsort(begin - end, kind="stable")
        at, state, total = begin[order], entry[order].astype(np.int32), np.zeros(len(order), np.int64)
        size = (end - begin)[order]
        ends = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for t, n in enumerate(ends.tolist()):  # the spans of more than t characters come first
            i = at[:n] + t
            state[:n], added = self.read(np.where(border[i], 0, state[:n]), kinds[i])
            total[:n] += added
        out_state, out_total = np.empty_like(state), np.empty_like(total)
        out_state[order], out_total[order] = state, total
        return out_state, out_total

    def _first_is_space(self, rest: str) -> bool:
        """Whether the model leaves the space before rest as a piece of its own."""
        from .lattice import encoder

        kinds = self.alphabet.classes(bpe.SPACE + rest)
        cut = np.flatnonzero(self.alphabet.borders(kinds)[1:])
        return encoder(self.path).word_ids([(bpe.SPACE + rest)[: int(cut[0]) + 1 if len(cut) else None]])[0][0] == self.pieces.id[bpe.SPACE]

    def _single_spaced(self, text: str) -> tuple[str, int]:
        """(the text with one space for each run, tokens that the runs have beyond that)."""
        more = 0
        for m in _SPACES.finditer(text):
            n, after = m.end() - m.start(), text.find(" ", m.end())
            rest = text[m.end() : after if after >= 0 else None]
            whole = not rest or self._first_is_space(rest)  # else the last space goes to the word
            more += _run_size(self.path, n) - 1 if whole else _run_size(self.path, n - 1)
        return _SPACES.sub(" ", text), more

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts as the library gives them."""
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):  # some MB at a time
            size += len(t)
            if size >= PORTION or i + 1 == len(texts):
                out += self._count(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def _count(self, texts: list[str]) -> list[int]:
        if len(self.states) > MOST_STATES:
            self.clear()
        full = [" " + t.replace(bpe.SPACE, " ") if t else "" for t in texts]  # to the model both are one sign
        more = np.zeros(len(texts), np.int64)
        for i, t in enumerate(full):
            if "  " in t:
                full[i], more[i] = self._single_spaced(t)
        size = np.array([len(t) for t in full], np.int64)
        kinds = self.alphabet.classes("".join(full))
        border = self.alphabet.borders(kinds)
        start = np.cumsum(size) - size
        border[start[size > 0]] = True
        # chunks of each text, in order
        n = -(-size // CHUNK)
        text = np.repeat(np.arange(len(texts)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = start[text] + number * CHUNK
        end = np.minimum(begin + CHUNK, (start + size)[text])
        # the map from the first border on: one row for all entries
        at = np.flatnonzero(border)
        mark = np.searchsorted(at, begin)
        first = np.where(mark < len(at), at[np.minimum(mark, len(at) - 1)], len(kinds)) if len(at) else end
        first = np.minimum(first, end)
        left, tokens = self.walk(kinds, border, first, end, np.zeros(len(text), np.int32))
        # the rows before it, for the entries that come: where a chunk has no border, its end is known one round after the one before
        known, todo = first < end, np.flatnonzero(first > begin)
        while len(todo):
            ready = known[todo - 1]
            now, todo = todo[ready], todo[~ready]
            exits, added = self.walk(kinds, border, begin[now], first[now], left[now - 1])
            tokens[now] += added
            left[now] = np.where(known[now], left[now], exits)
            known[now] = True
        upto = np.concatenate([[0], np.cumsum(tokens)])
        last = np.cumsum(n)
        return (upto[last] - upto[last - n] + more).tolist()


@lru_cache(maxsize=10_000)
def _run_size(path: str, n: int) -> int:
    return len(bpe.run_ids(path, n))


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    common.prepare(docs.sparkSession)

    def run(batches):
        t = transducer(path)
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = t.count(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every whole document."""
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path(MODEL))
