"""Words of a text as 64-bit hashes, vectorised.

Words are runs of anything but ASCII white space, A-Z lower-cased. A word's hash is a polynomial over a
random byte table, mixed; an n-gram's hash mixes its words' hashes in order.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, r in (("up", _R), ("down", _R_INVERSE)):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of lower-cased bytes."""
    codes = np.frombuffer(data, np.uint8)
    gap = np.r_[True, _SPACE[codes], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[codes] * up[: len(codes)], dtype=np.uint64)]
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order; memory follows CHUNK and the words, not their bytes."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0

    def flush():
        nonlocal size
        if waiting:
            offsets = np.cumsum([0] + [len(w) + 1 for w in waiting])
            starts, hashes = _word_hashes(b"\n".join(waiting))
            cuts = np.searchsorted(starts, offsets)
            out.extend(hashes[cuts[i] : cuts[i + 1]] for i in range(len(waiting)))
            waiting.clear()
            size = 0

    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        if len(data) > CHUNK:
            flush()
            parts, at = [], 0
            while at < len(data):
                end = min(len(data), at + CHUNK)
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                parts.append(_word_hashes(data[at:end])[1])
                at = end
            out.append(np.concatenate(parts))
            continue
        waiting.append(data)
        size += len(data)
        if size > CHUNK:
            flush()
    flush()
    return out


def ngrams(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the n-grams at each place where one fits; of the whole sequence where fewer words are there."""
    m = max(1, len(h) - words + 1) if len(h) else 0
    mixed = np.zeros(m, np.uint64)
    for i in range(min(words, len(h))):
        mixed = mix(mixed * np.uint64(31) + h[i : i + m] + np.uint64(i))
    return mixed
