"""Word and shingle hashes of many texts at once, on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = U(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive texts, null texts being empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, ASCII letters lowered if ``fold``, and the first word of each text (and the end)."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    edge = np.empty(len(raw), bool)
    edge[0] = True
    np.logical_not(word[:-1], out=edge[1:])
    begins = offsets[:-1][np.diff(offsets) > 0]
    edge[begins] = True
    starts = np.flatnonzero(edge & word)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(word)
    firsts = np.searchsorted(at, starts)
    lengths = np.diff(np.append(firsts, len(at)))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER, U))
    values = ((LOWER[raw[at]] if fold else raw[at]).astype(U) + U(1)) * powers[place]
    hashes = mix64(np.add.reduceat(values, firsts) + lengths.astype(U))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words and the first run of each text; a text with fewer words,
    but some, has one run of all its words."""
    counts = np.diff(firsts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(int(ends[-1]), U)
    factors = mix64(np.arange(1, width + 1, dtype=U)) | U(1)
    long = counts >= width
    if long.any():
        doc = np.repeat(np.flatnonzero(long), runs[long])
        place = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(runs[long])))[:-1], runs[long])
        at = firsts[doc] + place
        total = np.zeros(len(at), U)
        for j in range(width):
            total += words[at + j] * factors[j]
        out[ends[doc] + place] = mix64(total)
    for d in np.flatnonzero(~long & (counts > 0)):
        own = words[firsts[d] : firsts[d + 1]]
        out[ends[d]] = mix64((own * factors[: len(own)]).sum(keepdims=True) + factors[len(own) - 1 :][:1] * U(3))[0]
    return out, ends


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for texts without words."""
    for raw, offsets in chunks(texts):
        runs, ends = shingle_hashes(*word_hashes(raw, offsets), width)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.unique(runs[a:b]) if b - a > 1 else runs[a:b]
