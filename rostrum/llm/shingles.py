"""Word-shingle sets and similarity sketches, one document at a time, in NumPy."""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK = 1 << 17  # words hashed at once; bounds memory on very long texts

COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1


BYTE = _odd(1, 256)
SEEDS = _odd(2, 2 * COORDINATES)
BAND_SEEDS = _odd(3, BANDS)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
EMPTY = np.uint64((1 << 64) - 1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, x in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; cut at blanks 0x20 and 0x09-0x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def window_hashes(tokens: list[bytes], k: int = WORDS) -> np.ndarray:
    """64-bit hash of each window of k tokens, in order; of all tokens if there are
    fewer; none without tokens. Rolling: every byte is read once."""
    m = len(tokens)
    if not m:
        return np.empty(0, np.uint64)
    k = min(k, m)
    raw = np.frombuffer(b" ".join(tokens), np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.empty(m - k + 1, np.uint64)
    for i in range(0, len(out), BLOCK):
        s, e = starts[i:min(i + BLOCK, len(out))], ends[i + k - 1:min(i + BLOCK, len(out)) + k - 1]
        part = raw[s[0]:e[-1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * up[:len(part)], out=sums[1:])
        s, e = s - s[0], e - s[0]
        out[i:i + len(s)] = mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64) * BYTE[255])
    return out


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(window_hashes(words(text), k))


def sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set.

    In round i every element falls into one of t bins with value (i, hash); bins keep
    their least value, so a later round only fills bins that are still empty. After t
    rounds bin j takes the least hash of its own function: every bin is filled.
    Two sets agree in each coordinate with the probability of their similarity.
    """
    out = np.full(t, EMPTY, np.uint64)
    step = max(1, 1024 // len(x))  # small sets: many rounds at a time
    shift, low = np.uint64(56), np.uint64(8)
    for i in range(0, t, step):
        rounds = np.arange(i, min(i + step, t), dtype=np.uint64)
        z = mix(x[None, :] ^ SEEDS[rounds.astype(np.int64)][:, None])
        np.minimum.at(
            out, (z % np.uint64(t)).astype(np.int64).ravel(),
            ((rounds[:, None] << shift) | (z >> low)).ravel(),
        )
        if (out != EMPTY).all():
            return out
    empty = np.flatnonzero(out == EMPTY)
    z = mix(x[None, :] ^ SEEDS[t + empty][:, None])
    out[empty] = (np.uint64(t) << shift) | (z.min(axis=1) >> low)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One hash per band of ROWS coordinates."""
    rows = coordinates.reshape(BANDS, ROWS)
    h = BAND_SEEDS.copy()
    for i in range(ROWS):
        h = mix(h ^ rows[:, i])
    return h
