"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each
token and each adjacent pair is the encoding of its own bytes: a merge across a
boundary is decided by the two tokens beside it. So the bytes read so far have
one last token, found among the vocabulary's suffixes of the input whose
predecessor fits it. The nondeterministic transducer guesses where each token
ends; its determinised states hold the guesses that are still open (the bytes
since the guessed start, the token before them and the tokens not yet emitted).
A token is emitted once all open guesses agree on it. As a guess stays open for
at most the longest token's length, the lookahead is bounded. States and
transitions are made when first needed and kept in a table.

Decoding joins token bytes and runs an incremental UTF-8 state machine, so a
character whose bytes lie in several tokens or chunks comes out whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


#: States, and pieces of either generation, that a worker keeps: about 140 MB in all. Fewer take longer and change no result.
MAX_STATES, MAX_PIECES = 260_000, 120_000
_NODE = (1 << 24) - 1
_BEFORE = _NODE << 24
_PLACE = (1 << 32) - 1
_LOW = (1 << 48) - 1
#: Bytes of one piece between two looks at the size of the table.
SPAN = 1024


class Transducer:
    """Encodes byte strings by the merge ranks of a vocabulary.

    ``max_states`` bounds the table: when it is full, what further bytes add is
    dropped after each ``SPAN`` bytes, which costs time and changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        # The prefixes of tokens are nodes of a trie, 0 its root.
        self._child: dict[int, int] = {}
        self._token = [-1]
        self._has_longer = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._has_longer[node] = 1
                step = node << 8 | byte
                node = self._child.get(step, 0)
                if not node:
                    node = self._child[step] = len(self._token)
                    self._token.append(-1)
                    self._has_longer.append(0)
            self._token[node] = rank
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self._fits: dict[int, bool] = {}
        # A guess is one number: node, 1 + the token before (0: none), and the place of its pending tokens in a pool.
        self._pool: list[tuple[int, ...]] = [()]
        self._places: dict[tuple[int, ...], int] = {(): 0}
        start = (0,)
        self._ids = {start: 0}
        self._guesses = [start]
        # By state and byte: the next state, and the place of what the step emits.
        self._steps: dict[int, int] = {}
        self._ends: list[tuple[int, ...]] = [()]
        # Sizes of the tables when they were full.
        self._full: tuple[int, ...] = ()

    def _trim(self, state: int) -> int:
        """Drop what was added to full tables; the number that the state has then."""
        if len(self._fits) > 2 * self.max_states:
            self._fits.clear()
        tables = self._steps, self._ids, self._places
        if not self._full:
            self._full = tuple(map(len, tables))
        if len(self._steps) == self._full[0]:
            return state
        guesses = [(guess & _LOW, self._pool[guess >> 48]) for guess in self._guesses[state]]
        for rows, size in zip(tables, self._full):
            while len(rows) > size:
                rows.popitem()
        _, states, places = self._full
        del self._guesses[states:], self._ends[states:], self._pool[places:]
        return self._state(tuple([low | self._place(pending) << 48 for low, pending in guesses]))

    def _state(self, key: tuple[int, ...]) -> int:
        state = self._ids.get(key)
        if state is None:
            state = self._ids[key] = len(self._guesses)
            self._guesses.append(key)
            self._ends.append(self._pool[key[-1] >> 48])
        return state

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token; None for a single byte; (-1, -1) if merges never make it."""
        if token in self._halves:
            return self._halves[token]
        ranks, data = self.ranks, self.token_bytes[token]
        found: tuple[int, int] | None = None
        if len(data) > 1:
            parts = [data[i : i + 1] for i in range(len(data))]
            found = (-1, -1)
            while len(parts) > 2:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
                found = (ranks[parts[0]], ranks[parts[1]])
        self._halves[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives just these two.

        Undo merges beside the boundary, the latest first. A merge across it
        that comes before one undone would have been made.
        """
        ranks, data, a, b, before = self.ranks, self.token_bytes, left, right, None
        while True:
            across = ranks.get(data[a] + data[b])
            if across is not None and (before is None or across < before):
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]

    def _step(self, state: int, byte: int) -> int:
        child, tokens, longer, pool, fits = self._child, self._token, self._has_longer, self._pool, self._fits
        lows, chains = [], []
        last, chain = -1, ()
        for guess in self._guesses[state]:
            node = child.get((guess & _NODE) << 8 | byte)
            if node is None:
                continue
            if last < 0:
                token = tokens[node]
                if token >= 0:
                    before = guess >> 24 & _NODE
                    key = before << 24 | token
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self.halves(token) != (-1, -1) and (not before or self.fits(before - 1, token))
                    if ok:
                        last, chain = token, (*pool[guess >> 48], token)
            if longer[node]:
                lows.append(guess & _BEFORE | node)
                chains.append(pool[guess >> 48])
        if last < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        agreed = len(chain)
        for pending in chains:
            if pending[:agreed] != chain[:agreed]:
                agreed = min(agreed, len(pending))
                while pending[:agreed] != chain[:agreed]:
                    agreed -= 1
        lows.append(last + 1 << 24)
        chains.append(chain)
        place = self._place
        to = self._state(tuple([low | place(pending[agreed:]) << 48 for low, pending in zip(lows, chains)]))
        made = self._steps[state << 8 | byte] = to << 32 | place(chain[:agreed])
        return made

    def _place(self, pending: tuple[int, ...]) -> int:
        place = self._places.get(pending)
        if place is None:
            place = self._places[pending] = len(self._pool)
            self._pool.append(pending)
        return place

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, known, pool = 0, self._steps.get, self._pool
        for at in range(0, len(data), SPAN):
            if len(self._guesses) > self.max_states:
                state = self._trim(state)
            for byte in data[at : at + SPAN]:
                step = known(state << 8 | byte)
                if step is None:
                    step = self._step(state, byte)
                state = step >> 32
                step &= _PLACE
                if step:
                    out += pool[step]
        out += self._ends[state]
        return out


class _Pieces(dict):
    """Tokens, as 32-bit numbers, of short pieces met before: two generations of at most ``size``, the older of which goes when the newer is full."""

    def __init__(self, transducer: Transducer, size: int = MAX_PIECES, longest: int = 48):
        super().__init__()
        self.transducer, self.size, self.longest = transducer, size, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        tokens = self.older.get(piece)
        if tokens is None:
            tokens = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[piece] = tokens
        return tokens


#: Character classes as they are in text of ASCII characters only.
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t\n\r\f\v"}


def ascii_pattern(pattern: str) -> str | None:
    """An equal pattern for ASCII text, in the syntax of ``re``; None where it uses other classes than letters, numbers and space."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = next((c for c in _ASCII if pattern.startswith(c, at)), None)
        if found:
            out.append(_ASCII[found] if inside else f"[{_ASCII[found]}]")
            at += len(found)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{_ASCII[r'\s']}]")
            at += 2
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
            at += 1
    return "".join(out)


class Utf8Machine:
    """Splits a stream of bytes into characters.

    The state is (continuation bytes still needed, the least and the greatest
    value that the next one may have, the bytes so far), by the table of
    well-formed UTF-8 in the Unicode standard. An ill-formed part gives U+FFFD.
    """

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def needed(lead: int) -> tuple[int, int, int]:
        """(continuation bytes, least, greatest second byte); -1 for a byte that can't lead."""
        if lead < 0x80:
            return 0, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return -1, 0, 0

    def _open_from(self, data: bytes) -> int:
        """Where a character begins that ``data`` leaves unfinished, or its length."""
        n = len(data)
        for back in range(1, min(3, n) + 1):
            byte = data[n - back]
            if byte & 0xC0 == 0x80:
                continue
            more, least, most = self.needed(byte)
            if more >= back and (back == 1 or least <= data[n - back + 1] <= most):
                return n - back
            break
        return n

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = self._open_from(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.pending = self.pending, b""
        return left.decode("utf-8", "replace")


class Encoder:
    """A vocabulary's encoder with a splitting pattern."""

    def __init__(self, path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(load_ranks(path), max_states)
        self.find = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        # The standard library's expressions are faster, but know no character properties.
        self.find_ascii = re.compile(plain, re.ASCII).findall if plain else self.find
        self.pieces = _Pieces(self.transducer, max_pieces)

    def forget(self) -> None:
        """Drop the states and pieces made so far: a worker is kept for other stages, which need the memory."""
        self.transducer._clear()
        self.pieces.clear()
        self.pieces.older = {}

    def encode(self, text: str) -> np.ndarray:
        find = self.find_ascii if text.isascii() else self.find
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, find(text))), np.int32)


class Decoder:
    """A vocabulary's streaming decoder."""

    def __init__(self, path: str):
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        size = np.array([len(tokens.get(i, b"")) for i in range(max(tokens, default=-1) + 1)], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes_of = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes_of[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)].tobytes()

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of token chunks as it comes; a character split between chunks waits for its rest."""
        machine = Utf8Machine()
        for ids in chunks:
            if text := machine.feed(self.decode_bytes(ids)):
                yield text
        if text := machine.close():
            yield text


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path, pattern, max_states, max_pieces)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder for a worker process."""
    return Decoder(path)


#: Tokens of one streamed chunk.
CHUNK = 4096
#: Rows decoded for one batch of results.
ROWS = 500


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the tokens of each whole text; null counts as empty and gives none. Replaces a column named ``out_col``.

    The vocabulary at ``path`` must be there on each executor, as the tokenizer files are.
    """
    kept = docs.drop(out_col) if out_col != text_col else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for a, b in ts.slices(batch.column(text_col)):
                part = batch.slice(a, b - a)
                found = [own.encode(text.as_py() or "") for text in part.column(text_col)]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out_col])
        ts.release()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Replace the tokens of each row by the text that a streaming decoder gives for them (null tokens: empty)."""
    kept = [f for f in encoded.schema.fields if f.name not in (ids_col, out_col)]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch, texts = whole.slice(a, ROWS), []
                for ids in batch.column(ids_col):
                    values = ids.values.to_numpy() if ids.is_valid else ()
                    texts.append("".join(own.decode_stream(values[i : i + CHUNK] for i in range(0, len(values), CHUNK))))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), out_col])

    return encoded.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES, forget: bool = False) -> DataFrame:
    """``encode``, then ``decode`` of its tokens, in one pass and one worker a task, whose tables are bounded.

    A worker keeps its tables for the next task, or forgets them after each, which takes longer.
    """
    kept = docs.drop(*{ids_col, out_col} - {text_col})
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(out_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = encoder(path, pattern, max_states, max_pieces), decoder(path)
        for batch in batches:
            for a, b in ts.slices(batch.column(text_col)):
                part = batch.slice(a, b - a)
                found = [there.encode(text.as_py() or "") for text in part.column(text_col)]
                texts = ["".join(back.decode_stream(ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK))) for ids in found]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(texts, pa.string())], [*part.schema.names, ids_col, out_col])
        if forget:
            there.forget()
        ts.release()

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = encode_and_decode(docs.select("doc_id", "text"), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
