"""Distinct word shingles of whole texts as sorted 64-bit hashes, for Arrow string columns at a time.

Words are runs of anything but the six ASCII white spaces, A-Z lower-cased; a shingle has ``SHINGLE``
words, and a text of fewer words is one shingle of them all.  A word's hash is a polynomial over random
64-bit values of its bytes, taken for all words of a piece at once from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
PIECE = 1 << 20  # bytes hashed at once; longer texts are cut at white space
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word; no word goes over a cut (a position where a text starts)."""
    inside = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    over = fresh[1:].copy()  # the next byte starts anew, or this one is the last
    over[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & over)
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        begin = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, begin + PIECE, "left")))
        if ends[done] - begin >= PIECE:  # one word longer than a piece
            part = data[begin : ends[done] + 1].copy()
            part[(part >= 65) & (part <= 90)] += 32
            hashes[done] = int.from_bytes(blake2b(part.tobytes(), digest_size=8).digest(), "little")
            done += 1
            continue
        part = _VALUE[data[begin : ends[stop - 1] + 1]] * _UP[: ends[stop - 1] + 1 - begin]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        a, z = starts[done:stop] - begin, ends[done:stop] + 1 - begin
        hashes[done:stop] = mixed((total[z] - total[a]) * _DOWN[a] + (z - a).astype(np.uint64) * _ODD)
        done = stop
    return hashes, starts


def _string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    hashes, starts = _word_hashes(data, offsets)
    at = np.searchsorted(starts, offsets)  # first word of each text
    n = np.diff(at)
    shingle = np.full(max(0, len(hashes) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        shingle = shingle * _ODD + hashes[k : k + len(shingle)]
    shingle = mixed(shingle)
    out = []
    for a, m in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if m >= SHINGLE:
            s = np.sort(shingle[a : a + m - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif m:
            s = np.full(1, m, np.uint64)
            for h in hashes[a : a + m]:
                s = s * _ODD + h
            out.append(mixed(s))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, most: int = 2 * PIECE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of stretches of the column of about ``most`` bytes: sorted distinct shingle hashes."""
    data, offsets = _string_buffers(texts)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, _sets_of(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return next(shingle_sets(pa.array([text or ""], pa.string())))[1][0]


def digest_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
