"""Vectorised 64-bit digests of the words of many texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_MARK = _GAP | np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each range of bytes. Each 8 bytes are mixed with their place in the range before they are summed.

    A sum of the bytes times powers of a number would be cheaper, but for any such number there are long words with equal digests (Thue-Morse words and their
    complements); after mixing, places and bytes have no such linear relation. ``data`` has 8 bytes of padding.
    """
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * nth
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view("<u8").ravel()
    eight &= np.uint64(_MASK) >> (np.uint64(64) - (left << np.uint64(3)))
    mixed = mix(eight ^ mix(nth.astype(np.uint64), 11), 12)
    sums = np.add.reduceat(mixed, first) if len(first) else mixed
    return mix(sums ^ mix(size.astype(np.uint64), 13))


def words(
    texts: list[str | None], punctuation: bool = False, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Digests of all words of ``texts``, A-Z lower-cased, and the text that each word is of (ascending).

    Words are runs of other characters than space and \\t-\\r and, if ``punctuation``, ASCII punctuation. Digests: ``_digests``;
    two different words share one by chance alone, once in 2**64 pairs. Null counts as empty. For each number in ``prefixes`` a third
    result has the digests (and texts) of that many first bytes of each longer word.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    gap = (_MARK if punctuation else _GAP)[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    data = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]) if raw else np.zeros(0, dtype=np.int64)
    digest, owner = _digests(data, starts, ends), np.searchsorted(begins, starts, side="right") - 1
    if not prefixes:
        return digest, owner
    firsts = []
    for k in prefixes:
        at = np.flatnonzero(ends - starts > k)
        firsts.append((mix(_digests(data, starts[at], starts[at] + k), 17), owner[at]))
    return digest, owner, firsts


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the ascending distinct digests of its shingles of ``size`` words.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    digest, owner = words(texts)
    n = len(texts)
    count = np.bincount(owner, minlength=n) if n else np.zeros(0, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    rolled = np.zeros(max(len(digest) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled = mix(rolled, 1) + digest[k : k + len(rolled)]
    rolled = mix(rolled, 2)
    out = []
    for i in range(n):
        a, c = first[i], count[i]
        if c >= size:
            out.append(np.unique(rolled[a : a + c - size + 1]))
        elif c:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(c):
                one = mix(one, 1) + digest[a + k : a + k + 1]
            out.append(mix(one, 3 + int(c)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def chunks(texts: list[str | None], limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, so that the arrays of one range stay small."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= limit:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
