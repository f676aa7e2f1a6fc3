"""Vectorised byte and word hashing over Arrow string columns.

Everything here works on one Arrow batch inside a task: a text column's own buffers are viewed as numpy arrays
(no per-row Python strings), cut into bounded blocks of whole rows, and hashed with array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block of array operations covers; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the odd base of the rolling polynomial (3 mod 8).
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 3)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls while n stays within a block."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Cumulated polynomial: entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word) of the maximal runs of non-separators that cross no row's edge."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    here = np.append(inside, False)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def separator_table(spans: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table that is true for the bytes of the closed spans."""
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Space and the five control characters from tab to carriage return.
WHITE = separator_table([(0x20, 0x20), (0x09, 0x0D)])


class WordNames:
    """128-bit names of words and of runs of words, under a secret that is drawn anew for each run.

    A word of at most 16 bytes goes through a keyed permutation of 128 bits, so two such words never share a name;
    longer ones, and words that hold a zero byte, take a keyed BLAKE2b digest. A run's name is a sum of its words' names
    times secret odd factors, mixed, once for each half. Nobody who writes texts can know the secret.
    """

    def __init__(self, secret: bytes):
        stream = b"".join(hashlib.blake2b(bytes([i]), key=secret[:64]).digest() for i in range(8))
        self.key, values = stream[:32], np.frombuffer(stream[32:], np.uint64)
        self.rounds, self.factors, self.salt = values[:4], values[4:44].reshape(2, 20) | np.uint64(1), values[44:48]
        self.long: dict[bytes, bytes] = {}

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the name of bytes[start:end], for each word."""
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        lanes = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        n = ends - starts
        a = lanes[starts] & _LANE[np.minimum(n, 8)]
        b = lanes[np.minimum(starts + 8, len(data) + 8)] & _LANE[np.clip(n - 8, 0, 8)]
        for k in self.rounds:
            a, b = b, a ^ mix(b ^ k)
        odd = n > 16
        zeros = data == 0
        if zeros.any():
            before = np.concatenate([[0], np.cumsum(zeros)])
            odd |= before[ends] > before[starts]
        at = np.flatnonzero(odd)
        if len(at):
            raw, names = data.tobytes(), []
            for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
                word = raw[i:j]
                name = self.long.get(word)
                if name is None:
                    name = hashlib.blake2b(word, digest_size=16, key=self.key).digest()
                    if len(self.long) < 1 << 16:
                        self.long[word] = name
                names.append(name)
            told = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
            a[at], b[at] = told[:, 0], told[:, 1]
        return a, b

    def shingles(self, names: tuple[np.ndarray, np.ndarray], rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half, second half, row) of every run of ``size`` words, in the order of the rows.

        A row with fewer words, but some, gives its whole sequence as one run.
        """
        counts = np.bincount(rows, minlength=n_rows)
        total = len(rows)
        whole = rows[: total - size + 1] == rows[size - 1 :] if total >= size else np.zeros(0, bool)
        short = np.flatnonzero((counts > 0) & (counts < size))
        first = np.cumsum(counts) - counts
        at = rows[: len(whole)][whole]
        out = []
        for half, factors, salt in zip(names, self.factors, self.salt, strict=False):
            acc = np.zeros(len(whole), np.uint64)
            for k in range(size):
                acc += half[k : k + len(whole)] * factors[k]
            runs = mix(acc[whole] ^ salt)
            if len(short):
                extra = counts[short].astype(np.uint64) * factors[-1]
                for k in range(size - 1):
                    has = counts[short] > k
                    extra[has] += half[first[short[has]] + k] * factors[k]
                runs = np.concatenate([runs, mix(extra ^ salt)])
            out.append(runs)
        if len(short):
            at = np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            out, at = [x[order] for x in out], at[order]
        return out[0], out[1], at


#: Masks of the low n bytes of a 64-bit lane.
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Low bits of a minimizer key that hold a position; a block of windows has to be shorter.
POSITION_BITS = np.uint64(21)
_POSITION = (np.uint64(1) << POSITION_BITS) - np.uint64(1)


def window_blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (bytes, offsets, row numbers, start of the bytes in its row) so that each window of each row is in one block.

    A row longer than a block is cut into parts that overlap by length - 1 bytes.
    """
    for i, j, part, at in blocks(data, offsets):
        if len(part) <= BLOCK_BYTES:
            yield part, at, np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for t in range(0, len(part), BLOCK_BYTES):
                some = part[t : t + BLOCK_BYTES + length - 1]
                yield some, np.array([0, len(some)]), np.array([i]), np.array([t])


class Anchors:
    """The anchors of one block: each window of ``length`` bytes is led by the leftmost least hash of its ``gram``-byte strings.

    ``lo``..``hi`` are the starts of the windows that one anchor leads, and ``gram_hash`` hashes the anchor's bytes. Equal
    windows have equal anchors at equal places, wherever they lie, so repeats can be searched anchor by anchor. The hash
    chooses anchors and deals them to buckets; it never decides that two strings are equal.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.data, self.length, n = data, length, len(data)
        self.rows = self.lo = self.hi = np.zeros(0, np.int64)
        self.gram_hash = np.zeros(0, np.uint64)
        if n < length:
            return
        sums = prefix_sums(data)
        hashes = mix((sums[gram:] - sums[:-gram]) * powers(BASE_INVERSE, n + 1)[: n - gram + 1])
        key = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        leader = (key & _POSITION).astype(np.int64)
        inside = np.arange(len(leader)) + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(leader)]
        leader = np.where(inside, leader, -1)
        lo = np.flatnonzero(np.append(True, leader[1:] != leader[:-1]))
        hi = np.append(lo[1:], len(leader)) - 1
        keep = leader[lo] >= 0
        self.lo, self.hi = lo[keep], hi[keep]
        self.gram_hash = hashes[leader[self.lo]]
        self.rows = np.searchsorted(offsets, self.lo, "right") - 1

    def contexts(self, chosen: np.ndarray) -> list[bytes]:
        """All bytes that the windows of each chosen anchor cover."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.lo[chosen].tolist(), (self.hi[chosen] + self.length).tolist(), strict=True)]
