"""Elias-Fano sequences, bit-packed numbers and n-gram trie levels in one flat buffer.

A level is written as bytes and read through ``numpy.memmap`` or any buffer:
nothing is copied before it is decoded, and decoding goes block by block.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import zstandard

#: Elements that are decoded together.
BLOCK = 1 << 13


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 as compressed byte planes."""
    values = np.ascontiguousarray(values).astype("<u8", copy=False)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<qB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qB", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(n).astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def write_bits(values: np.ndarray, width: int) -> bytes:
    """``width`` bits for each number."""
    if not width or not len(values):
        return b""
    out = []
    for a in range(0, len(values), BLOCK):
        part = np.ascontiguousarray(values[a : a + BLOCK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def read_bits(buffer: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """Numbers first to last (exclusive), which must start at a block."""
    n = last - first
    if not width or n <= 0:
        return np.zeros(max(n, 0), np.int64)
    start = first * width // 8
    bits = np.unpackbits(buffer[start : start + (n * width + 7) // 8], bitorder="little")[: n * width].reshape(n, width)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").reshape(n).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary.

    For each block there is the place of its first one-bit among the high bits
    and its first value, so that a search decodes only the blocks it needs.
    """

    def __init__(self, buffer: np.ndarray):
        self.n, self.low_bits, low_size, high_size = struct.unpack("<qqqq", buffer[:32].tobytes())
        blocks = -(-self.n // BLOCK)
        at = 32
        self.starts = buffer[at : at + 8 * blocks].view("<i8")
        at += 8 * blocks
        self.firsts = buffer[at : at + 8 * blocks].view("<i8")
        at += 8 * blocks
        self.low = buffer[at : at + low_size]
        self.high = buffer[at + low_size : at + low_size + high_size]
        self.size = -(-(at + low_size + high_size) // 8) * 8

    @staticmethod
    def write(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = write_bits(values & ((1 << low_bits) - 1), low_bits)
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(-(-(int(places[-1]) + 1) // 8) * 8 if n else 0, np.uint8)
        high[places] = 1
        high = np.packbits(high, bitorder="little").tobytes()
        head = struct.pack("<qqqq", n, low_bits, len(low), len(high))
        data = head + places[::BLOCK].astype("<i8").tobytes() + values[::BLOCK].astype("<i8").tobytes() + low + high
        return data + b"\0" * (-len(data) % 8)

    def block(self, b: int) -> np.ndarray:
        first, last = b * BLOCK, min(self.n, (b + 1) * BLOCK)
        place = int(self.starts[b])
        end = int(self.starts[b + 1]) if b + 1 < len(self.starts) else len(self.high) * 8
        bits = np.unpackbits(self.high[place // 8 : -(-end // 8)], bitorder="little")[place % 8 : end - place // 8 * 8]
        ones = np.flatnonzero(bits)[: last - first] + place
        return ((ones - np.arange(first, last)) << self.low_bits) | read_bits(self.low, self.low_bits, first, last)

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.starts))]) if self.n else np.zeros(0, np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at places, in any order."""
        out = np.zeros(len(places), np.int64)
        which = places // BLOCK
        order = np.argsort(which, kind="stable")
        edges = np.flatnonzero(np.diff(which[order], prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(order)]):
            rows = order[a:z]
            b = int(which[rows[0]])
            out[rows] = self.block(b)[places[rows] - b * BLOCK]
        return out

    def successors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the first value at or after each of the ascending ``wanted``; place n, value -1 where there is none."""
        place = np.full(len(wanted), self.n, np.int64)
        value = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return place, value
        # The block before the first block that starts after a wanted value may hold its successor; else that block's first does.
        which = np.maximum(np.searchsorted(self.firsts, wanted, "left") - 1, 0)
        edges = np.flatnonzero(np.diff(which, prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(wanted)]):
            b = int(which[a])
            values = self.block(b)
            found = np.searchsorted(values, wanted[a:z], "left")
            inside = found < len(values)
            place[a:z] = np.where(inside, found + b * BLOCK, (b + 1) * BLOCK)
            value[a:z] = np.where(inside, values[np.minimum(found, len(values) - 1)], self.firsts[b + 1] if b + 1 < len(self.firsts) else -1)
        place = np.minimum(place, self.n)
        return place, value


def _codes_at(buffer: np.ndarray, bits: int, n: int, places: np.ndarray) -> np.ndarray:
    """Of ``n`` packed codes those at ascending places, decoded block by block."""
    out = np.zeros(len(places), np.int64)
    which = places // BLOCK
    edges = np.flatnonzero(np.diff(which, prepend=-1))
    for a, z in zip(edges, [*edges[1:], len(places)]):
        b = int(which[a])
        values = read_bits(buffer, bits, b * BLOCK, min(n, (b + 1) * BLOCK))
        out[a:z] = values[places[a:z] - b * BLOCK]
    return out


class TrieLevel:
    """The children of contexts: a level of an n-gram trie.

    * contexts, ascending (Elias-Fano), with a quantised back-off weight each;
    * pointers to where a context's children begin (Elias-Fano); a context may have none;
    * children: words made ascending over all contexts, as each context's words
      start from the last value of the context before it (Elias-Fano);
    * a quantised log-probability for each child.

    A child's place is the context number for the next level.
    """

    def __init__(self, buffer: np.ndarray):
        self.bits, n_codes, n_backoff = struct.unpack("<qqq", buffer[:24].tobytes())
        at = 24
        self.contexts = EliasFano(buffer[at:])
        at += self.contexts.size
        self.pointers = EliasFano(buffer[at:])
        at += self.pointers.size
        self.children = EliasFano(buffer[at:])
        at += self.children.size
        self.codes = buffer[at : at + n_codes]
        self.backoffs = buffer[at + n_codes : at + n_codes + n_backoff]

    @staticmethod
    def write(context: np.ndarray, word: np.ndarray, codes: np.ndarray, backoff: np.ndarray, bits: int, contexts: np.ndarray | None = None) -> bytes:
        """From children in the order of (context, word).

        ``contexts`` are all contexts in order, by default those that have
        children; ``backoff`` has a code for each.
        """
        if contexts is None:
            contexts = context[np.flatnonzero(np.diff(context, prepend=-1))]
        first = np.searchsorted(context, contexts)
        size = np.searchsorted(context, contexts, "right") - first
        # Each context's words follow the last value of the contexts before.
        top = np.zeros(len(contexts), np.int64)
        top[size > 0] = word[(first + size - 1)[size > 0]] + 1
        values = word + np.repeat(np.cumsum(top) - top, size)
        packed, kept = write_bits(codes, bits), write_bits(backoff, bits)
        head = struct.pack("<qqq", bits, len(packed), len(kept))
        return head + EliasFano.write(contexts) + EliasFano.write(np.append(first, len(context))) + EliasFano.write(values) + packed + kept

    @classmethod
    def mapped(cls, data: bytes) -> TrieLevel:
        """The level in a memory map of its own."""
        held = mmap.mmap(-1, max(1, len(data)))
        held.write(data)
        return cls(np.frombuffer(held, np.uint8))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each child, its context's number), -1 where there is none; pairs in ascending order.

        The context's place gives the range of its children by two pointers and
        the value that they count from; a successor search for the word relative
        to it finds the child. Only blocks that hold any of these are decoded.
        """
        place, number = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        edges = np.flatnonzero(np.diff(context, prepend=-1))
        size = np.diff(np.append(edges, len(context)))
        found, value = self.contexts.successors(context[edges])
        held = value == context[edges]
        found = found[held]
        begin, end = self.pointers.at(found), self.pointers.at(found + 1)
        base = np.where(begin > 0, self.children.at(np.maximum(begin - 1, 0)) + 1, 0) if self.children.n else begin
        known = np.flatnonzero(np.repeat(held, size))
        spread = [np.repeat(x, size[held]) for x in (found, base, end)]
        number[known] = spread[0]
        at, value = self.children.successors(spread[1] + word[known])
        hit = (value == spread[1] + word[known]) & (at < spread[2])
        place[known[hit]] = at[hit]
        return place, number

    def code(self, places: np.ndarray) -> np.ndarray:
        """The quantised log-probabilities at ascending places."""
        return _codes_at(self.codes, self.bits, self.children.n, places)

    def backoff(self, numbers: np.ndarray) -> np.ndarray:
        """The quantised back-off weights of contexts with ascending numbers."""
        return _codes_at(self.backoffs, self.bits, self.contexts.n, numbers)
