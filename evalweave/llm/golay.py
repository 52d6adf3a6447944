"""The binary Golay code (23, 12): decoding of 23-bit words and the keys that tolerate two bit errors.

Every 23-bit word lies within distance 3 of exactly one of the 4,096 codewords, named by its 12 information bits.
``keys`` gives a word the codewords of the word itself and of its 23 one-bit neighbours: one key (a seventh of all
words) or six. Two words at distance 2 or less always share a key, since they have a common neighbour.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, INFO, PARITY = 23, 12, 11
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each information word; error pattern of each syndrome; weight of that pattern."""
    parity = np.zeros(1 << INFO, np.uint32)
    for info in range(1 << INFO):
        rest = info << PARITY
        for bit in range(BITS - 1, PARITY - 1, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - PARITY)
        parity[info] = rest
    errors = np.zeros(1 << PARITY, np.uint32)
    weight = np.zeros(1 << PARITY, np.uint8)
    for w in (1, 2, 3):
        for bits in combinations(range(BITS), w):
            e = sum(1 << b for b in bits)
            s = int(parity[e >> PARITY]) ^ (e & ((1 << PARITY) - 1))
            errors[s], weight[s] = e, w
    return parity, errors, weight


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the codeword nearest to each 23-bit word."""
    parity, errors, _ = _tables()
    words = words.astype(np.uint32)
    syndrome = parity[words >> PARITY] ^ (words & np.uint32((1 << PARITY) - 1))
    return ((words ^ errors[syndrome]) >> PARITY).astype(np.int64)


def encode(info: np.ndarray) -> np.ndarray:
    """Codewords of 12-bit indices."""
    return (info.astype(np.uint32) << PARITY) | _tables()[0][info]


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word: (row of the word, key), each key of a word once."""
    flips = np.concatenate(([0], 1 << np.arange(BITS))).astype(np.uint32)
    found = decode((words.astype(np.uint32)[:, None] ^ flips[None, :]).ravel()).reshape(len(words), len(flips))
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, _ = np.nonzero(fresh)
    return row, found[fresh]
