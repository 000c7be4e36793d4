"""Words of many texts as arrays of 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed at a time; arrays of eight times this size are made.
CHUNK = 1 << 18
#: Rows of an Arrow batch that are worked on at a time.
ROWS = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = b" \t\n\v\f\r"


def spaced_table(is_separator: bytes) -> bytes:
    """A byte table that lower-cases A-Z and turns separators into spaces."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for b in is_separator:
        table[b] = 32
    return bytes(table)


#: Words are runs of anything but white space.
WHITE = spaced_table(_SPACES)
#: Words are runs of ASCII letters, digits and characters beyond ASCII.
ALNUM = spaced_table(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))


def sliced(batches: Iterable, rows: int = ROWS) -> Iterator:
    """The batches in parts of so many rows, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a block, in which only spaces separate."""
    raw = np.frombuffer(data, np.uint8)
    word = raw != 32
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = 1 << max(18, int(len(raw)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return starts, mixed(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces into pieces of about CHUNK bytes."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(b" ", at + CHUNK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed(texts: Iterable[bytes | None], table: bytes = WHITE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts: how many, the words' hashes one text after another, and where each text's words end.

    A null text has no words.  Groups are about CHUNK bytes; a longer text is a
    group of its own and is hashed piece by piece.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        text = (text or b"").translate(table)
        if len(text) > CHUNK:
            if group:
                yield _group(group)
                group, size = [], 0
            words = np.concatenate([_hash_block(p)[1] for p in _pieces(text)])
            yield 1, words, np.array([len(words)])
            continue
        group.append(text)
        size += len(text) + 1
        if size > CHUNK:
            yield _group(group)
            group, size = [], 0
    if group:
        yield _group(group)


def _group(group: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    starts, words = _hash_block(b" ".join(group))
    ends = np.cumsum([len(t) + 1 for t in group])
    return len(group), words, np.searchsorted(starts, ends)
