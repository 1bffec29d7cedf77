"""Vectorised hashing of words and word shingles, for use inside Arrow tasks.

Word hashes are polynomial in random byte values modulo 2**64, taken from prefix sums, so that a task
hashes all words of many texts with a few numpy passes. Texts are cut at white space into pieces of about
one megabyte, so memory does not follow the longest text (one word longer than that is held whole).
"""

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.RandomState(20240117).randint(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_PLACE = np.random.RandomState(7).randint(1, 1 << 63, 64, dtype=np.int64).astype(_U) | _U(1)
PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = np.isin(np.arange(256), list(SPACES))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(1 << max(20, (n - 1).bit_length()), base, _U)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(p)
    return _powers[kind][:n]


def _hash_piece(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[a] * _power("up", _BASE, len(a)))))
        return mix((total[end] - total[start]) * _power("down", _INVERSE, len(a) + 1)[start])


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """Hash of each white-space-separated word in order; with fold, A-Z as a-z."""
    text = text.translate(LOWER) if fold else text
    if len(text) <= PIECE:
        return _hash_piece(text) if text else np.zeros(0, _U)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(_hash_piece(text[at:end]))
        at = end
    return np.concatenate(out)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on (as many as there are)."""
    m = len(w) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(m, 0), _U) + _U(n)
        for j in range(n if m > 0 else 0):
            h += w[j : m + j] * _PLACE[j]
        return mix(h)


def stretches(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each stretch [start, end)."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(w * _power("up", _BASE, len(w)))))
        return mix((total[end] - total[start]) * _power("down", _INVERSE, len(w) + 1)[start] + (end - start).astype(_U))


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence is one; none without words."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    m = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - m + 1, _U) + _U(m)
        for j in range(m):
            h += w[j : len(w) - m + 1 + j] * _PLACE[j]
        return np.unique(mix(h))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Intersection and union size of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
