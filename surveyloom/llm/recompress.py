"""Recompression of word sequences: runs and pairs get global names, round by round.

A name is a hash of what it stands for, so the same run or pair has the same name in every document
and no table of names has to be agreed on. A round first names runs of equal symbols, then pairs of
a left symbol and a right one; which side a symbol is on is a bit of a hash of its name and the round.
Whether a symbol is formed depends on few words around it. These are tracked exactly: where a stretch
of words includes all of them, the symbol is formed in every document that has the stretch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

ROUNDS = 7
#: A pair that stands for more words than this isn't named; runs are, however long.
LONGEST = 24
CACHE = 1 << 20
#: Name between texts.
BORDER = np.uint64(0)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Names(dict):
    """Name of each word met, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Symbols(NamedTuple):
    """Symbols of a level: name, words [lo, hi) they stand for, words [dlo, dhi) they depend on."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    dlo: np.ndarray
    dhi: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(s: Symbols, words: np.ndarray) -> Symbols:
    starts = np.concatenate(([0], np.flatnonzero(s.name[1:] != s.name[:-1]) + 1))
    ends = np.append(starts[1:], len(s.name))
    lo, hi = s.lo[starts], s.hi[ends - 1]
    dlo, dhi = np.minimum.reduceat(s.dlo, starts), np.maximum.reduceat(s.dhi, starts)
    # that a neighbour is another symbol shows in the word next to it, or else by the neighbour as a whole
    before = words[np.maximum(lo - 1, 0)] == words[hi - 1]
    after = words[np.minimum(hi, len(words) - 1)] == words[lo]
    own_lo, own_hi = np.minimum(dlo, lo - 1), np.maximum(dhi, hi + 1)
    whole_lo, whole_hi = np.minimum(own_lo, np.roll(dlo, 1)), np.maximum(own_hi, np.roll(dhi, -1))
    count = (ends - starts).astype(np.uint64)
    name = s.name[starts]
    name = np.where(count > 1, mixed(name * _GOLD + count), name)
    out = Symbols(name, lo, hi, np.where(before, whole_lo, own_lo), np.where(after, whole_hi, own_hi))
    edge = name == BORDER
    out.dlo[edge], out.dhi[edge] = lo[edge], hi[edge]
    return out


def _pairs(s: Symbols, number: int) -> Symbols:
    salt = np.uint64(number * int(_GOLD) & (2**64 - 1))
    left, inner = (mixed(s.name + salt) >> np.uint64(63)).astype(bool), s.name != BORDER
    joins = np.zeros(len(s.name), bool)  # with the next one
    joins[:-1] = left[:-1] & ~left[1:] & inner[:-1] & inner[1:] & (s.hi[1:] - s.lo[:-1] <= LONGEST)
    joined = np.zeros(len(s.name), bool)  # to the one before
    joined[1:] = joins[:-1]
    # that a symbol stays alone depends on its neighbour on the side where it could have joined
    alone = inner & ~joins & ~joined
    dlo = np.where(alone & ~left, np.minimum(s.dlo, np.roll(s.dlo, 1)), s.dlo)
    dhi = np.where(alone & left, np.maximum(s.dhi, np.roll(s.dhi, -1)), s.dhi)
    at = np.flatnonzero(joins)
    name, hi = s.name.copy(), s.hi.copy()
    name[at] = mixed(mixed(s.name[at] + _GOLD) * _GOLD + s.name[at + 1])
    hi[at] = s.hi[at + 1]
    dlo[at] = np.minimum(dlo[at], dlo[at + 1])
    dhi[at] = np.maximum(dhi[at], dhi[at + 1])
    keep = ~joined
    return Symbols(name[keep], s.lo[keep], hi[keep], dlo[keep], dhi[keep])


def compress(words: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of the last round over hashed words of one or more texts.

    Texts are set apart by BORDER, which also opens and ends the sequence and is never part of a symbol.
    A symbol that depends on a border depends on what is beyond its text.
    """
    at = np.arange(len(words))
    s = Symbols(words, at, at + 1, at, at + 1)
    for number in range(1, rounds + 1):
        s = _pairs(_runs(s, words), number)
    inner = s.name != BORDER
    return Symbols(*(column[inner] for column in s))


def window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of ``size`` words, built from blocks of doubled length."""
    out = []
    for salt in (1, 2):
        block = mixed(words + np.uint64(salt * int(_GOLD) & (2**64 - 1)))
        done, total, width = 0, None, 1
        while width <= size:
            if size & width:
                part = block[done : len(block) - (size - done - width)] if size - done - width else block[done:]
                total = part if total is None else mixed(mixed(total + _GOLD) * _GOLD + part[: len(total)])
                done += width
            block = mixed(mixed(block[: len(block) - width] + _GOLD) * _GOLD + block[width:]) if len(block) > width else block[:0]
            width *= 2
        out.append(total)
    return out[0], out[1]
