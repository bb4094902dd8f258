"""Keys by which bit strings that differ in at most two bits meet.

The extended binary Golay code has 4,096 words of 24 bits, any two of them 8
or more bits apart, and every 24-bit string of even weight is within 4 bits of
one of them (at distance 2 or less of exactly one, or at distance 4 of exactly
six, whose differences from the string split the 24 places into six fours).
A segment of at most 23 bits becomes such a string by zeros and a parity bit.
Its keys are the indices of the one or six near codewords. Segments that
differ in at most two bits share a key: their strings differ in 0 or 2 places.
If one string is within 2 of a codeword, that codeword is within 4 of the
other. If not, the two places are in one of the six fours, and then that four's
codeword is at distance 2 of the other string; or they are in two of the
fours, and then each of these two codewords is at distance 4 of it.

A 64-bit fingerprint has segments of 22, 21 and 21 bits. Of two errors or
fewer, some segment has none, and every segment has at most two: so the exact
value of a segment with a Golay key of the next segment, three times one or
six keys of 33 or 34 bits, is a complete index for radius 2.
"""

from __future__ import annotations

import numpy as np

SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Coefficients of the cyclic [23, 12] Golay code's generator polynomial.
GENERATOR = 0b101011100011


def _codewords() -> np.ndarray:
    """By index: the 12 highest of the 23 bits are the index itself, then the checks, then parity."""
    out = np.zeros(4096, np.uint32)
    for i in range(4096):
        rest = i << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        word = i << 11 | rest
        out[i] = word << 1 | (word.bit_count() & 1)
    return out


def _leaders(words: np.ndarray) -> np.ndarray:
    """By the 11 check bits (parity follows: the strings are even): the index
    differences to the near codewords, filled up with the first."""
    table = np.full((2048, 6), -1, np.int32)
    weight = np.bitwise_count(words)
    # A syndrome stands for the string whose index bits are 0 and whose checks are it.
    for s in range(2048):
        string = np.uint32(s << 1 | (s.bit_count() & 1))
        near = np.flatnonzero(np.bitwise_count(words ^ string) <= 4)
        table[s, : len(near)] = near
        table[s, len(near) :] = near[0]
    assert sorted(set(weight.tolist())) == [0, 8, 12, 16, 24]
    return table


CODEWORDS = _codewords()
LEADERS = _leaders(CODEWORDS)


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Six codeword indices for each segment of at most 23 bits; repeats stand for one."""
    v = values.astype(np.uint32)
    index = v >> np.uint32(11)
    syndrome = (v ^ (CODEWORDS[index] >> np.uint32(1))) & np.uint32(2047)
    return (index.astype(np.int32)[:, None] ^ LEADERS[syndrome]).astype(np.int64)


def keys(prints: np.ndarray) -> np.ndarray:
    """18 keys of each 64-bit fingerprint (uint64), with repeats as -1."""
    out = np.empty((len(prints), 18), np.int64)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for i in range(3):
        g = segment_keys(parts[(i + 1) % 3])
        k = (np.int64(i) << 34 | parts[i] << 12)[:, None] | g
        k[:, 1:][g[:, 1:] == g[:, :1]] = -1
        out[:, 6 * i : 6 * i + 6] = k
    return out
