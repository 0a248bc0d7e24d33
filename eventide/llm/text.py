"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

A word is a maximal run of Unicode letters and digits, lower-cased. Its hash is a polynomial in its
UTF-8 bytes modulo 2^64, read off prefix sums over the whole buffer, so the cost follows the bytes
and not the words. A shingle is `k` consecutive words; a text of 1 to k-1 words is one shingle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from eventide.llm.common import mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEEP = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64; kept, since every batch needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    row: np.ndarray  # where each row's words begin in `hash`; one more entry than rows
    start: np.ndarray  # byte where each word begins, from the first byte of `data`
    end: np.ndarray
    data: np.ndarray  # the lower-cased UTF-8 bytes of all rows
    text: np.ndarray  # where each row's bytes begin in `data`


def words(col: pa.Array) -> Words:
    low = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    odd = pc.match_substring_regex(low, r"[^\x00-\x7F\p{L}\p{N}]")  # other separators than ASCII ones
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), r"[^\p{L}\p{N}]+", " "))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    text = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[text[0] : text[-1]]
    text, n = text - text[0], len(data)
    keep = np.zeros(n + 2, bool)
    keep[1:-1] = _KEEP[data]
    first = np.zeros(n + 1, bool)
    first[text] = True
    start = np.flatnonzero(keep[1:-1] & (~keep[:-2] | first[:-1]))
    end = np.flatnonzero(keep[1:-1] & (~keep[2:] | first[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, n), out=total[1:])
    hash_ = mix((total[end] - total[start]) * powers(_INVERSE, n)[start])
    return Words(hash_, np.searchsorted(start, text), start, end, data, text)


class Shingles(NamedTuple):
    hash: np.ndarray
    row: np.ndarray  # where each row's shingles begin; one more entry than rows


def shingles(w: Words, k: int) -> Shingles:
    n, size = len(w.hash), np.diff(w.row)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(row[-1], np.uint64)
    at = np.arange(row[-1]) - np.repeat(row[:-1] - w.row[:-1], count)  # first word of each shingle
    long = np.repeat(size, count)
    q = np.uint64(_BASE)
    for j in range(k):
        has = j < long
        out = np.where(has, out * q + w.hash[np.minimum(at + j, max(n - 1, 0))], out) if n else out
    return Shingles(mix(out ^ np.minimum(long, k).astype(np.uint64)), row)


def owners(row: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(row) - 1), np.diff(row))


def digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's words in order; 0 where there are none."""
    n, out = len(w.hash), []
    for base in (_BASE, 0xD6E8FEB86659FD93):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(w.hash + np.uint64(base)) * powers(base, n), out=total[1:])
        h = (total[w.row[1:]] - total[w.row[:-1]]) * powers(pow(base, -1, 1 << 64), n + 1)[w.row[:-1]]
        out.append(np.where(np.diff(w.row) > 0, mix(h ^ np.diff(w.row).astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]


def jaccard(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Jaccard similarity of the two texts' sets of shingles, row by row; 0 where both have none."""
    keys, rows = [], []
    for col in (a, b):
        s = shingles(words(col), k)
        own = owners(s.row)
        key, first = np.unique(s.hash ^ mix(own.astype(np.uint64) + np.uint64(1)), return_index=True)
        keys.append(key)
        rows.append(own[first])
    both = np.bincount(rows[0][np.isin(keys[0], keys[1], assume_unique=True)], minlength=len(a))
    either = np.bincount(rows[0], minlength=len(a)) + np.bincount(rows[1], minlength=len(a)) - both
    return both / np.maximum(either, 1)
