"""Minimal perfect hashing of sets of 64-bit keys, in slices that are built apart.

A slice's keys are hashed into a bit array; those that are alone at their bit
stay there, the others go on to the next, smaller array. The number of set bits
before a key's bit is its index, from 0 to n - 1 without gaps.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from parcelio.llm.tokens import mix

#: Bits of an array for each key that enters it.
ROOM = 1.5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(77)) % np.uint64(slices)).astype(np.int64)


def _spot(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) * _STEP + np.uint64(level + 1)) % np.asarray(size, np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Sizes of the levels, their bits, and the distinct keys in the order of their indexes."""
    rest, sizes, bits, order = keys, [], [], []
    while len(rest):
        size = max(64, int(ROOM * len(rest)))
        spot = _spot(rest, len(sizes), size)
        many = np.bincount(spot, minlength=size)
        alone = many[spot] == 1
        sizes.append(size)
        bits.append(many == 1)
        order.append(rest[alone][np.argsort(spot[alone])])
        rest = rest[~alone]
    return (
        np.array(sizes, np.int64),
        np.packbits(np.concatenate(bits)).tobytes() if bits else b"",
        np.concatenate(order) if order else keys,
    )


class Hash(NamedTuple):
    """Some slices side by side: bits, set bits before each byte, and place and size of each level of each slice."""

    bits: np.ndarray
    before: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, -1 where no bit is set; a key that is not in the set may get any index."""
        found = np.full(len(keys), -1, np.int64)
        part = slice_of(keys, self.size.shape[1])
        todo = np.arange(len(keys))
        for level in range(len(self.size)):
            todo = todo[self.size[level, part[todo]] > 0]
            if not len(todo):
                break
            own = part[todo]
            at = self.begin[level, own] + _spot(keys[todo], level, self.size[level, own])
            byte, bit = self.bits[at >> 3], at & 7
            hit = (byte >> (7 - bit)) & 1 == 1
            index = self.before[at >> 3] + _ONES[byte.astype(np.int64) >> (8 - bit)]
            found[todo[hit]] = index[hit]
            todo = todo[~hit]
        return found


def side_by_side(slices: int, parts: list[tuple[int, np.ndarray, bytes]]) -> Hash:
    """One hash from (slice, sizes, bits) of some of the slices; indexes go on from one to the next."""
    depth = max((len(sizes) for _, sizes, _ in parts), default=0)
    begin, size, done = np.zeros((depth, slices), np.int64), np.zeros((depth, slices), np.int64), 0
    for number, sizes, bits in parts:
        size[: len(sizes), number] = sizes
        begin[: len(sizes), number] = 8 * done + np.cumsum(sizes) - sizes
        done += len(bits)
    bits = np.frombuffer(b"".join(b for _, _, b in parts), np.uint8)
    before = np.cumsum(_ONES[bits], dtype=np.int64) - _ONES[bits]
    return Hash(bits, before, begin, size)
