"""Texts as words and word hashes, in blocks of bounded size.

A word is a run of ASCII letters and digits (A-Z lower-cased) and of any characters beyond ASCII. Words are found on
UTF-8 bytes, since every byte of a character beyond ASCII is 0x80 or more. A null text has no words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Byte -> lower-cased byte of a word, or a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(WORD_TABLE).split()


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            pair.append(np.cumprod(table, dtype=np.uint64))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of translated bytes."""
    data = np.frombuffer(piece, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut translated bytes at spaces into pieces of about BLOCK_BYTES."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK_BYTES else text.find(b" ", at + BLOCK_BYTES)
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


class Block:
    """The words of some texts: `hashes` of all words in order, `starts` and `ends` of each in `data`, and `offsets`,
    where the words of text i are those from offsets[i] to offsets[i + 1]. `first` is the number of the first text."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.data = first, b" ".join(texts)
        found = [(at, _hash_piece(piece)) for at, piece in _pieces(self.data)]
        self.hashes = np.concatenate([f[0] for _, f in found]) if found else np.zeros(0, np.uint64)
        self.starts = np.concatenate([f[1] + at for at, f in found]) if found else np.zeros(0, np.int64)
        self.ends = np.concatenate([f[2] + at for at, f in found]) if found else np.zeros(0, np.int64)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.offsets = np.searchsorted(self.starts, edges)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self) -> np.ndarray:
        """The number within the block of the text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def words(self, start: int, end: int) -> list[bytes]:
        return self.data[self.starts[start]:self.ends[end - 1]].split() if end > start else []


def blocks(texts: Iterable[bytes | None]) -> Iterator[Block]:
    """Consecutive texts in blocks of about BLOCK_BYTES; a longer text is a block of its own."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        held.append(b"" if text is None else text.translate(WORD_TABLE))
        size += len(held[-1])
        if size >= BLOCK_BYTES or len(held) >= 4096:
            yield Block(first, held)
            first, held, size = n + 1, [], 0
    if held:
        yield Block(first, held)


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of `length` words; empty if there are fewer words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, length):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
