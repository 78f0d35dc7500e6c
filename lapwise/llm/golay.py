"""Golay-code keys of 64-bit fingerprints: equal for near fingerprints, few for each.

The binary (23, 12) Golay code is perfect: every 23-bit word lies within three
bits of exactly one code word.  A word's *indices* are the code words that it, or
a word one bit away from it, decodes to: one or up to six of 4,096.  Two words
that differ in one or two bits have an index in common, that of the word midway.

A fingerprint has three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most three bits, then by the pigeonhole principle either

* some segment is equal and the next one (cyclically) differs in two bits at
  most: of the equal segments one is followed by such a segment, since a segment
  with all three errors leaves two equal ones.  Key: the segment and an index of
  the next one.
* or each segment has one error.  Then one half of the first segment is equal,
  and one half of the second.  Key: a half of each and an index of the third.

Fingerprints that may differ in more bits than that are made longer and decoded by
margins: :func:`weighted_index` gives one index for each segment of 23 bits, and near
fingerprints have that of some segment in common (see :mod:`lapwise.llm.near_copies`).
"""

from __future__ import annotations

import numpy as np

WIDTHS = (22, 21, 21)
_SHIFTS = (42, 21, 0)
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def _byte_tables() -> list[np.ndarray]:
    """Remainders of the three bytes of a word; a word's remainder is their exclusive or."""
    return [np.array([_remainder(value << shift) for value in range(256 if shift < 16 else 128)], np.uint32) for shift in (0, 8, 16)]


def _corrections() -> np.ndarray:
    """The error of up to three bits that belongs to each remainder."""
    table = np.zeros(2048, np.uint32)
    bits = [1 << i for i in range(23)]
    for i in range(23):
        table[_remainder(bits[i])] = bits[i]
        for j in range(i):
            table[_remainder(bits[i] | bits[j])] = bits[i] | bits[j]
            for k in range(j):
                table[_remainder(bits[i] | bits[j] | bits[k])] = bits[i] | bits[j] | bits[k]
    return table


_BYTES, _CORRECTIONS = _byte_tables(), _corrections()


def index_of(words: np.ndarray) -> np.ndarray:
    """Number of the code word that each 23-bit word decodes to."""
    remainder = _BYTES[0][words & 255] ^ _BYTES[1][words >> 8 & 255] ^ _BYTES[2][words >> 16]
    return (words ^ _CORRECTIONS[remainder]) >> 11


# The 4,096 code words as signs: 1 for a set bit, -1 for one that is not.
_CODES = np.arange(4096, dtype=np.uint32) << 11
_CODES ^= _BYTES[0][_CODES & 255] ^ _BYTES[1][_CODES >> 8 & 255] ^ _BYTES[2][_CODES >> 16]
_SIGNS = (2 * (_CODES[:, None] >> np.arange(23, dtype=np.uint32) & 1).astype(np.int8) - 1).astype(np.int8)
_FLIPS = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
# Rows that are decoded at a time.
_ROWS = 2048


def weighted_index(margins: np.ndarray) -> np.ndarray:
    """The index of each row of 23 margins that agrees best with them (soft decision).

    A margin is positive for a set bit, and large for a bit that is unlikely to
    differ in a near fingerprint.  Of a row's indices (see above) the one whose
    code word has the largest sum of margins is taken, the smallest of several.
    """
    found = []
    for at in range(0, len(margins), _ROWS):
        part = margins[at : at + _ROWS].astype(np.float32)
        words = ((part > 0) << np.arange(23)).sum(axis=1).astype(np.uint32)
        near = np.sort(index_of(words[:, None] ^ _FLIPS[None, :]), axis=1)
        agreement = np.einsum("rib,rb->ri", _SIGNS[near].astype(np.float32), part)
        found.append(near[np.arange(len(part)), agreement.argmax(axis=1)])
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all indices of each word of ``width`` bits, without repetition."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    near = np.sort(index_of(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints.

    Fingerprints that differ in three bits or fewer have a key in common.
    """
    parts = [
        (fingerprints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32)
        for width, shift in zip(WIDTHS, _SHIFTS)
    ]
    rows, found = [], []
    near = [indices(part, width) for part, width in zip(parts, WIDTHS)]
    for i in range(3):
        row, index = near[(i + 1) % 3]
        rows.append(row)
        found.append((np.int64(i) << 40) | (parts[i][row].astype(np.int64) << 12) | index)
    row, index = near[2]
    for first in range(2):
        for second in range(2):
            a = parts[0][row] >> (11 * first) & 2047
            b = parts[1][row] >> (11 * second) & 2047
            rows.append(row)
            found.append((np.int64(3 + 2 * first + second) << 40) | (a.astype(np.int64) << 23) | (b.astype(np.int64) << 12) | index)
    return np.concatenate(rows), np.concatenate(found)
