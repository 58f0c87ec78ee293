"""Words of whole texts as 64-bit hashes, in numpy: no Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

#: White space that parts words; nothing else does.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word, eight bytes of all words at a time."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _A + _A + np.uint64(seed * 0x5851F42D4C957F2D % (1 << 64)))
    some, at = np.arange(len(starts)), starts
    while len(some):
        size = np.minimum(left[some], 8)
        block = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - size) * 8).astype(np.uint64))
        h[some] = mix(h[some] * _A ^ mix(block + _C))
        more = left[some] > 8
        some, at = some[more], at[more] + 8
        left[some] -= 8
    return h


def words(text: str | None, lower: bool = False) -> np.ndarray:
    """The hashes of one text's words in order; none for null."""
    data = (text or "").encode()
    data = data.translate(_LOWER) if lower else data
    return hashes(data, *spans(data))


def hashed(words: list[bytes]) -> np.ndarray:
    """The hash of each of these words, none of which has white space inside or is empty."""
    data = b" ".join(words)
    return hashes(data, *spans(data))


def sequences(w: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    factors = mix((np.arange(n, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) * _A) | np.uint64(1)
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out += w[i : len(w) - n + 1 + i] * factors[i]
    return mix(out)


def documents(texts: list[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text, worked out for all of them at once."""
    parts = [(t or "").encode() for t in texts]
    data = b"\n".join(parts)
    data = data.translate(_LOWER) if lower else data
    first, last = spans(data)
    h = hashes(data, first, last)
    ends = np.cumsum([len(p) + 1 for p in parts])
    cuts = np.searchsorted(first, ends)
    at = 0
    for cut in cuts:
        yield h[at:cut]
        at = cut


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays, one per row."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
