"""Vectorised text primitives over Arrow string buffers: words, hashes and shingles without a Python loop over words.

All functions take the UTF-8 bytes of many texts in one buffer with the texts' offsets; a null text counts as empty.
Memory is bounded by the chunk size (or by the longest single text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000
#: Polynomial base of the word hash, odd so that it is invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Bytes that one polynomial spans. Over far longer strings a polynomial modulo 2**64 has collisions that anyone can write down.
BLOCK = 64
_POW = np.array([pow(BASE, i + 1, 2**64) for i in range(BLOCK)], dtype=np.uint64)
#: Space bytes of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=width, count=arr.offset + len(arr) + 1)[arr.offset :].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offs[0] : offs[-1]] if len(arr) and bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(arr: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about `size` bytes, whole texts each."""
    data, offs = buffers(arr)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a text's end: (starts, ends, text number)."""
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    first[edge] = solid[edge]
    edge = offs[1:][offs[:-1] < offs[1:]] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes (spans ordered and apart).

    A span of up to BLOCK bytes is one polynomial. Longer ones are cut into blocks, and each block's sum is mixed with its
    number before they are added up, so that blocks in another order give another hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = (ends - starts).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(heads, lens)
    val = (buf[pos + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * _POW[pos % BLOCK]
    if int(lens.max()) > BLOCK:
        at = np.flatnonzero(pos % BLOCK == 0)
        sums, number = np.add.reduceat(val, at), (pos[at] // BLOCK).astype(np.uint64)
        long = np.repeat(lens > BLOCK, -(-lens // BLOCK))
        sums[long] = mix(sums[long] ^ mix(number[long] + np.uint64(BASE)))
        val, heads = sums, np.flatnonzero(number == 0)
    return mix(np.add.reduceat(val, heads) + lens.astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of `[^\\x20\\x09-\\x0D]+`."""
    return spans(~SPACE[buf], offs)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles and the offsets of each text's; fewer words: the whole sequence as one; none: none."""
    count = np.bincount(doc, minlength=n_docs).astype(np.int64)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(per)])
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(int(out_offs[-1]), dtype=np.int64) - np.repeat(out_offs[:-1] - first, per)
    owner = np.repeat(np.arange(n_docs), per)
    size = np.minimum(count, width)[owner]
    acc = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        mult = np.uint64(pow(BASE, 2 * k + 3, 2**64))
        if len(h):
            acc += np.where(k < size, h[np.minimum(at + k, len(h) - 1)] * mult, np.uint64(0))
    return mix(acc), out_offs
