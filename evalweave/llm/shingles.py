"""Vectorised tokens and shingle hashes of many texts at once (numpy; used inside Arrow batches).

Texts are laid end to end as code points; token boundaries, token hashes and window hashes are array operations over the
whole buffer, so the cost per text is a few microseconds a hundred characters. Buffers are bounded by ``CHUNK_CHARS``
(one text may exceed it: texts are never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 400_000

_U = np.uint64
# Python's str.isspace() beyond ASCII.
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_WORD = np.zeros(128, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_CODE = _WORD.copy()
_CODE[95] = True
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    x = x.astype(np.uint64, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters: (index of the first, texts); null counts as empty."""
    start, size, part = 0, 0, []
    for k, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = k, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def tokens(texts: list[str], code: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and the number of tokens of each.

    code: maximal runs of ASCII letters, digits and underscores, and every other non-space character alone.
    Else: maximal runs of ASCII letters and digits, lower-cased; all else separates.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    low = np.minimum(cp, 127).astype(np.int64)
    word = (_CODE if code else _WORD)[low] & (cp < 128)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    start = word & ~before
    if code:
        space = _SPACE[low] & (cp < 128)
        if (cp >= 128).any():
            space |= np.isin(cp, _WIDE_SPACES)
        single = ~word & ~space
        start |= single
        inside = word | single
    else:
        cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
        inside = word
    begin = np.flatnonzero(start)
    end_flag = np.empty_like(word)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    end_flag = (word & ~after) | (inside & ~word)
    end = np.flatnonzero(end_flag) + 1
    power, inverse = _pow(len(cp))
    table = mix(np.arange(128, dtype=np.uint64))
    value = table[low]
    wide = cp >= 128
    if wide.any():
        value[wide] = mix(cp[wide].astype(np.uint64))
    sums = np.empty(len(cp) + 1, np.uint64)
    sums[0] = 0
    if not code:
        value = np.where((low >= 65) & (low <= 90) & ~wide, table[np.minimum(low + 32, 127)], value)
    np.cumsum(value * power, dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin])
    bounds = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))
    return hashes, np.diff(bounds)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` tokens within a text: (hash, index of the text, position of its first token).

    A Karp-Rabin fingerprint: differences of one running sum, brought to a common power.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _pow(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * power[:n], dtype=np.uint64, out=sums[1:])
    first = np.arange(n - width + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = doc[: n - width + 1] == doc[width - 1 :]
    first = first[keep]
    doc = doc[first]
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return mix((sums[first + width] - sums[first]) * inverse[first]), doc, first - starts[doc]


def shingle_sets(texts: list[str], width: int, code: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes of each text, ordered by text and hash: (hash, number of each text, tokens of each text)."""
    hashes, counts = tokens(texts, code)
    h, doc, _ = windows(hashes, counts, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.empty(len(h), bool)
        keep[0] = True
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, np.bincount(doc, minlength=len(texts)), counts
