"""Hashes of words and word shingles, worked out for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import kept

_MIX, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = 0x9E3779B97F4A7C15
#: Characters that are hashed together, but for a longer text, which is taken by itself.
CHARACTERS = 1 << 18
#: Bits of a shingle's number; the rest of a word of 64 bits numbers the texts of a chunk.
ID_BITS = 48


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``CHARACTERS`` and fewer than 2**16 texts."""
    out: list[str] = []
    held = 0
    for t in texts:
        if out and (held + len(t) > CHARACTERS or len(out) == 60_000):
            yield out
            out, held = [], 0
        out.append(t)
        held += len(t)
    if out:
        yield out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points belong to words; powers of an odd number and of its inverse modulo 2**64, ``n`` at least."""
    held = kept("words")
    if "letters" not in held:
        held["letters"] = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)
    if n <= CHARACTERS * 2:
        if "powers" not in held:
            held["powers"] = _powers(CHARACTERS * 2)
        return held["letters"], *held["powers"]
    return held["letters"], *_powers(n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text).

    A word is a run of letters, digits and underscores in lower case. Its hash is a
    polynomial of its code points, taken from running sums over the whole chunk.
    """
    low = [t.lower() for t in texts]
    data = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, up, down = _tables(len(data) + 1)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = letters[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    after = np.cumsum([len(t) + 1 for t in low])
    counts = np.diff(np.searchsorted(starts, after), prepend=0)
    return h, counts


class Shingler:
    """Word shingles of texts as numbers of ``ID_BITS`` bits; a text of fewer words is one shingle, one without words none."""

    def __init__(self, size: int):
        self.size = size
        self.steps = np.array([pow(_P, k + 1, 2**64) | 1 for k in range(size)], np.uint64)

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct shingles of each text in ascending order, how often each occurs, where each text's begin, numbers of the texts that have any) of one chunk."""
        h, n = word_hashes(texts)
        window = np.zeros(len(h), np.uint64)
        for k, step in enumerate(self.steps):
            window[: len(h) - k] += h[k:] * step if k < len(h) else np.uint64(0)
        first = np.cumsum(n) - n
        made = np.where(n >= self.size, n - self.size + 1, (n > 0).astype(n.dtype))
        owner = np.repeat(np.arange(len(n)), made)
        at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(len(owner))
        found = window[at]
        place = np.cumsum(made) - made
        for i in np.flatnonzero((n > 0) & (n < self.size)):
            found[place[i]] = np.add.reduce(h[first[i] : first[i] + n[i]] * self.steps[: n[i]])
        shift, low = np.uint64(ID_BITS), np.uint64((1 << ID_BITS) - 1)
        both = np.sort((owner.astype(np.uint64) << shift) | (mixed(found) >> np.uint64(64 - ID_BITS)))
        new = np.flatnonzero(np.diff(both, prepend=both[:1] + np.uint64(1))) if len(both) else np.zeros(0, np.int64)
        tf = np.diff(new, append=len(both))
        both = both[new]
        of = (both >> shift).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        return both & low, tf, starts, of[starts]

    def one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, tf, _, _ = self.sets([text])
        return ids, tf


def pack_ids(ids: np.ndarray) -> bytes:
    """Shingles in six bytes each."""
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ID_BITS // 8]).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, ID_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : ID_BITS // 8] = raw
    return out.view("<u8").ravel()


def pack_counts(tf: np.ndarray) -> bytes:
    """Counts that differ from one, as pairs of place and count."""
    at = np.flatnonzero(tf != 1)
    return np.stack([at, tf[at]], axis=1).astype("<u4").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.ones(n)
    pairs = np.frombuffer(data, "<u4").reshape(-1, 2)
    out[pairs[:, 0]] = pairs[:, 1]
    return out
