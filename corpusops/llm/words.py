"""Words of whole texts and their fingerprints, by columns of bytes."""

from __future__ import annotations

import numpy as np
import xxhash

from corpusops.llm.exchange import mix
from corpusops.llm.ragged import gather

#: Words up to this many bytes are hashed together, byte by byte; longer ones one by one.
TOGETHER = 48

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each text. Words do not cross texts."""
    inside = ~BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts[filled] = inside[filled]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    begins = np.flatnonzero(starts)
    return begins, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(begins, offsets))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[begin:end]; ``data`` has its letters in lower case already."""
    lengths = ends - begins
    order = np.argsort(np.minimum(lengths, TOGETHER + 1).astype(np.uint8), kind="stable")
    sizes, at = lengths[order], begins[order]
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    short = int(np.searchsorted(sizes, TOGETHER, side="right"))
    prime = np.uint64(0x100000001B3)
    for j in range(int(sizes[short - 1]) if short else 0):
        k = int(np.searchsorted(sizes[:short], j, side="right"))
        h[k:short] = (h[k:short] ^ data[at[k:short] + j]) * prime
    h[:short] = mix(h[:short] ^ (sizes[:short].astype(np.uint64) << np.uint64(56)))
    for i in range(short, len(order)):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + sizes[i]].tobytes())
    out = np.empty(len(order), np.uint64)
    out[order] = h
    return out


STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each text as sorted fingerprints, and each text's bounds in them.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    low = LOWER[data]
    begins, ends, counts = word_spans(low, offsets)
    words = word_hashes(low, begins, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled += words[j : j + len(rolled)] * STEP[j]
    rolled = mix(rolled)
    out, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for d, n in enumerate(counts.tolist()):
        a = int(first[d])
        if n >= size:
            own = np.sort(rolled[a : a + n - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mix((words[a : a + n] * STEP[:n]).sum(dtype=np.uint64, keepdims=True) + STEP[60 - n])
        else:
            own = rolled[:0]
        out.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return np.concatenate(out) if out else rolled[:0], bounds


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """64-bit fingerprints of all runs of ``width`` words, from those of the powers of two it is made of."""
    powers, factor = [words], [mix(np.uint64([base])) | np.uint64(1)]
    while 2 << (len(powers) - 1) <= width:
        half, shift = powers[-1], 1 << (len(powers) - 1)
        powers.append(half[: max(len(half) - shift, 0)] * factor[-1] + half[shift:])
        factor.append(factor[-1] * factor[-1])
    value, at = np.zeros(max(len(words) - width + 1, 0), np.uint64), 0
    for k, (power, f) in enumerate(zip(powers, factor)):
        if width >> k & 1:
            value = value * f + power[at : at + len(value)]
            at += 1 << k
    return mix(value)


def joined(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts made of their kept words with one blank between them."""
    sizes = (ends - begins + 1)[keep]
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    stops = np.cumsum(sizes) - 1  # the blank behind each word
    words = np.ones(len(out), bool)
    words[stops] = False
    out[words] = gather(data, begins[keep], sizes - 1)
    per_text = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
    upto = np.concatenate([[0], np.cumsum(per_text)])
    last = upto[1:][per_text > 0] - 1  # no blank behind the last word
    stay = np.ones(len(out), bool)
    stay[stops[last]] = False
    bounds = np.concatenate([[0], np.cumsum(sizes)])[upto]
    return bounds - np.concatenate([[0], np.cumsum(per_text > 0)]), out[stay]
