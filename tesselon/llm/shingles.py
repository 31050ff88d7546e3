"""Hashed word shingles and their sketches, vectorised over a batch of texts.

Texts are lower-cased in A-Z only and cut into words at ASCII white space.  Hashes have 64 bits: two
different shingles agree with probability 2**-64, which is the only way an exact comparison of sets errs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1)
_BYTE = _ODD(256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_POSITION = _ODD(64)
_BASE = int(_ODD(1)[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes hashed at a time, which is also the length of the tables of powers that every worker keeps.
BLOCK = 1 << 16


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) == 1:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(BLOCK + 1, U(base))
            p[0] = U(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its byte span, and the first word of each text (one more entry at the end).

    A word's hash is a polynomial in its bytes, taken from running sums that are made block by block.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts_of = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0], edge]) if not space[0] else edge
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables()
    low, high, back = np.empty(len(begin), U), np.empty(len(end), U), np.empty(len(begin), U)
    carry = 0
    for s in range(0, len(data), BLOCK):
        part = data[s : s + BLOCK]
        shift, unshift = U(pow(_BASE, s, 2**64)), U(pow(_BASE_INVERSE, s, 2**64))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[part] * power[: len(part)], dtype=U)])
        for at, out in ((begin, low), (end, high)):
            i, j = np.searchsorted(at, [s, s + len(part)])
            out[i:j] = U(carry) + shift * sums[at[i:j] - s]
            if at is begin:
                back[i:j] = unshift * inverse[at[i:j] - s]
        carry = (carry + int(shift) * int(sums[-1])) % 2**64
    h = mix64((high - low) * back + (end - begin).astype(U) * _POSITION[63])
    return h, begin, end, np.searchsorted(begin, starts_of)


def grouped(texts: list[str | None], size: int = 1 << 20):
    """(first, last) of runs of texts that together have about ``size`` characters, to bound what is worked on at once."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one text (or of several, if runs across them are dropped)."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, U)
    acc = np.full(n, U(size * int(_POSITION[62]) % 2**64), U)
    for j in range(size):
        acc += words[j : j + n] * _POSITION[j]
    return mix64(acc)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as its one shingle."""
    out = []
    for i, j in grouped(texts):
        words, _, _, first = word_hashes(texts[i:j])
        runs = window_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            else:
                out.append(window_hashes(words[a:b], b - a) if b > a else np.empty(0, U))
    return out


def similarity_sketches(sets: list[np.ndarray], t: int = 256) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: in each round every element throws a hash value into a hashed bin.

    A bin keeps the least value of the first round that reached it.  After ``t`` rounds bin ``k`` is filled
    by round ``t + k``, in which all elements go there, so every coordinate is filled.  Coordinates of two
    sets agree with the sets' Jaccard similarity as probability, concentrated as for full permutations.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    empty = np.iinfo(np.uint64).max
    sketch = np.full(n * t, empty, U)
    if not n:
        return sketch.reshape(0, t)
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        open_ = (sketch.reshape(n, t) == empty).any(1)
        if not open_.any():
            break
        if not open_.all():
            here = open_[owner] if len(owner) else open_[:0]
            items, owner = items[here], owner[here]
        v = mix64(items + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = U(i << 48) | (v >> U(16))
        if i < t:
            np.minimum.at(sketch, owner * t + (v % U(t)).astype(np.int64), value)
        else:
            np.minimum.at(sketch, owner * t + (i - t), value)
        # Values of an earlier round are smaller, so a filled bin never changes.
        # Sets that are full leave before the next round.
    return sketch.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    acc = np.zeros((len(sketch), bands), U) + np.arange(1, bands + 1, dtype=U) * _POSITION[61]
    for r in range(rows):
        acc = mix64(acc + part[:, :, r] * _POSITION[r])
    return acc


def signature(sketch: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, packed into 64-bit words."""
    bits = (mix64(sketch) & U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of ``bits`` places, packed into 64-bit words.

    Common elements of two sets cancel, so their words differ in at most as many bits as the sets differ in elements.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([np.empty(0, U), *sets]) % U(bits)
    odd = np.bincount(np.repeat(np.arange(len(sets)), sizes) * bits + at.astype(np.int64), minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
