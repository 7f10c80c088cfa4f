"""Word shingles of whole texts as sorted 64-bit hashes."""

import numpy as np

#: words of a shingle, and bytes hashed at once
WORDS, CHUNK = 5, 1 << 22

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES = np.arange(1, 257, dtype="uint64") * _C
_BYTES ^= _BYTES >> np.uint64(31)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, "uint64")]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that makes every bit of the result depend on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _powers(n):
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _A, "uint64")]), dtype="uint64")
    return _POWERS[0]


def _hash_words(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, "uint8")
    space = _SPACE[data]
    start = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    if not len(start):
        return np.empty(0, "uint64")
    data, space = data[start[0]:], space[start[0]:]
    start = start - start[0]
    length = np.diff(np.append(start, len(data)))
    place = np.arange(len(data)) - np.repeat(start, length)
    values = _BYTES[data] * _powers(int(length.max()))[place]
    values[space] = 0
    return mix(np.add.reduceat(values, start))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of every run of other bytes than 20 and 09 to 0D, A-Z taken as a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while len(raw) - at > CHUNK:
        end = at + CHUNK
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hash_words(raw[at:end]))
        at = end
    parts.append(_hash_words(raw[at:]))
    return np.concatenate(parts)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run, one without words has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        total = total * _A + w[k:len(w) - n + 1 + k]
    return np.unique(mix(total))
