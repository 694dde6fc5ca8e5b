"""Re-Pair grammar of a sequence of whole numbers, and its decoding in whole or in part.

The most frequent pair of neighbours is replaced by a nonterminal, again and again, until no pair occurs as often as ``least`` (2 for a whole grammar). Occurrences that overlap count once, runs
being cut from the left. Pairs of equal count may go in any order, so a round replaces pairs of the highest count of which no two overlap anywhere, as many as can't be added to: the same as one by
one, as none of them takes an occurrence from another, and a pair that comes up is at most as frequent as the one it comes from.

All occurrences of a pair come up in one round, that of its younger symbol, and only go away afterwards. So they are listed once, counts only fall, and a round touches no places but its
occurrences and their neighbours. A pair that comes up less than ``least`` times is never looked at again.

Each symbol has its expansion length; sums of these at every STEP-th place of the sequence lead a reader to any position without decoding what lies before.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

MAGIC = b"RPG2"
LEAST, ROUNDS, STEP = 32, 6, 1024
FEW = 8  # counts that many pairs share
ONE = np.int32(1)
LONG = 255  # lengths from here on don't fit into a byte


class Grammar(NamedTuple):
    terminals: np.ndarray  # ascending; symbol k < len(terminals) stands for terminals[k]
    rules: np.ndarray  # [rule, 2]: symbol len(terminals) + r stands for the two symbols rules[r], both made before it
    lengths: np.ndarray  # of every symbol's expansion
    sequence: np.ndarray


def apart(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``n`` pairs can be replaced at once, where ``one[k]`` and ``other[k]`` overlap somewhere: as many as can't be added to."""
    free, chosen = np.ones(n, bool), np.zeros(n, bool)
    while True:
        later = free.copy()
        later[np.maximum(one, other)] = False
        chosen |= later
        near = np.concatenate([other[later[one]], one[later[other]]])
        free &= ~later
        free[near] = False
        open_ = free[one] & free[other]
        one, other = one[open_], other[open_]
        if not len(one):
            return chosen | free


def every_other(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ``places``, ascending within each pair, don't overlap others of their pair, from the left of each run; after: the place that follows each."""
    first = np.flatnonzero(np.concatenate([[True], after[:-1] != places[1:]])[: len(places)])
    return np.flatnonzero((np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))) % 2 == 0)


class Pairs:
    """A sequence as a linked list of places, and its pairs with their places and counts. The first and the last place are guards."""

    def __init__(self, seq: np.ndarray, symbols: int, least: int):
        n = len(seq) + 2
        self.symbols, self.least = symbols, least
        cells = np.full((n, 4), -1, np.int32)  # what a round reads of a place, and of its neighbours, lies side by side
        self.symbol, self.after, self.before, self.pair = cells.T  # of each place its symbol, -1: none any more, and the number of the pair that begins there, -1: none, or one that is not numbered
        self.symbol[1:-1] = seq
        self.guard = symbols + len(seq) // 2 + 1  # above all symbols
        self.symbol[0] = self.symbol[-1] = self.guard
        self.after[:], self.before[:] = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.number, room = 0, len(seq) // 4 + 16
        self.left, self.right, self.count, self.low, self.size = (np.zeros(room, np.int32) for _ in range(5))  # by number; low, size: where the places are listed
        self.listed, self.places = 0, np.zeros(n, np.int32)
        self.marked = np.zeros(room, bool)  # scratch, by number
        self.floor, self.active = 1 << 31, np.zeros(0, np.intp)  # pairs of unequal symbols with that count or more
        self.equal, self.most, self.highest = np.zeros(0, np.intp), np.zeros(0, np.int64), 0  # pairs of equal symbols, and what their counts can't exceed, and the highest of that
        self.add(np.arange(1, n - 2), seq[:-1], seq[1:])

    def add(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Numbers the pairs of ``left`` and ``right`` symbols that begin at the places ``at``, which have no number; they are all that there are of them."""
        if len(at) < self.least:
            return
        wide, deep = self.guard.bit_length(), len(self.symbol).bit_length()
        if 2 * wide + deep <= 64:  # sorted with its place in one number
            key = left.astype(np.uint64)
            key <<= np.uint64(wide)
            np.bitwise_or(key, right, out=key, dtype=np.uint64, casting="unsafe")
            key <<= np.uint64(deep)
            key |= at.view(np.uint64)
            key.sort()
            at = (key & np.uint64((1 << deep) - 1)).view(np.int64)
            key >>= np.uint64(deep)
        else:
            wide = 32
            order = np.lexsort((at, right, left))
            at, key = at[order], (left.astype(np.uint64) << np.uint64(wide) | right.astype(np.uint64))[order]
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(at)]])
        size = bounds[1:] - bounds[:-1]
        often = size >= self.least
        if not often.any():
            return
        at = at[np.repeat(often, size)]
        often = np.flatnonzero(often)
        size = size[often]
        first = np.cumsum(size) - size
        k, end, low, high = self.number, self.number + len(size), self.listed, self.listed + len(at)
        while end >= len(self.count):  # the last one stands for no pair
            for name in ("left", "right", "count", "low", "size"):
                setattr(self, name, np.append(getattr(self, name), np.zeros_like(self.count)))
            self.marked = np.zeros(len(self.count), bool)
        while high > len(self.places):
            self.places = np.append(self.places, np.zeros_like(self.places))
        self.places[low:high] = at
        self.pair[at] = np.repeat(np.arange(k, end, dtype=np.int32), size)
        self.low[k:end], self.size[k:end], self.count[k:end] = first + low, size, size
        key = key[bounds[often]]
        left, right = key >> np.uint64(wide), key & np.uint64((1 << wide) - 1)
        self.left[k:end], self.right[k:end] = left, right
        self.number, self.listed = end, high
        same = left == right
        if same.any():
            self.ask(np.flatnonzero(same) + k, size[same])
        often = np.flatnonzero((size >= self.floor) & ~same)  # to be looked through
        if len(often):
            self.active = np.concatenate([self.active, often + k])

    def places_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places where the pairs are now, which of them is there), in the order of the pairs, then ascending."""
        if len(pairs) == 1:
            low = int(self.low[pairs[0]])
            at = self.places[low : low + int(self.size[pairs[0]])].astype(np.intp)
            at = at[self.pair[at] == pairs[0]]
            return at, np.zeros(len(at), np.intp)
        size = self.size[pairs].astype(np.int64)
        which = np.repeat(np.arange(len(pairs)), size)
        at = self.places[np.arange(len(which)) + (self.low[pairs] - (np.cumsum(size) - size))[which]].astype(np.intp)
        there = np.flatnonzero(self.pair[at] == pairs[which])
        return at[there], which[there]

    def unequal(self) -> tuple[int, np.ndarray]:
        """(the highest count of pairs of unequal symbols or 0, the pairs that have it); they are looked through by powers of two of their counts, and below FEW by each count."""
        while True:
            count = self.count[self.active]
            top = int(count.max(initial=0))
            if top >= self.floor:
                if 2 * np.count_nonzero(count >= self.floor) < len(count):
                    self.active, count = self.active[count >= self.floor], count[count >= self.floor]
                return top, self.active[count == top]
            if self.floor <= self.least:
                return 0, self.active[:0]
            good = np.where(self.left[: self.number] != self.right[: self.number], self.count[: self.number], 0)
            top = int(good.max(initial=0))
            self.floor = max(self.least, top if top < FEW else 1 << top.bit_length() - 1)
            self.active = np.flatnonzero(good >= self.floor)

    def same(self, top: int) -> tuple[int, np.ndarray]:
        """(the higher of ``top`` and the highest count of pairs of equal symbols, the pairs of these that have it)."""
        if self.highest < max(top, self.least):
            return top, self.equal[:0]
        asked = np.flatnonzero(self.most >= max(top, self.least))
        at, which = self.places_of(self.equal[asked])
        counts = np.bincount(which[every_other(at, self.after[at])], minlength=len(asked))
        self.most[asked] = counts
        top = max(top, int(counts.max()))
        if top < self.least:
            self.highest = 0
            return 0, self.equal[:0]
        found = self.equal[self.most == top]
        self.equal, self.most = self.equal[self.most != top], self.most[self.most != top]
        self.highest = int(self.most.max(initial=0))
        return top, found

    def ask(self, pairs: np.ndarray, most: np.ndarray) -> None:
        """Pairs of equal symbols are to be counted when ``most`` could be the highest count."""
        self.equal, self.most = np.concatenate([self.equal, pairs]), np.concatenate([self.most, most])
        self.highest = max(self.highest, int(most.max(initial=0)))

    def next_round(self) -> np.ndarray:
        """The rules of a round, of which the first is symbol ``symbols``; none if no pair occurs ``least`` times."""
        top, pairs = self.unequal()
        high, same = self.same(top)
        if not high:
            return np.zeros((0, 2), np.int32)
        if len(same):
            pairs = np.sort(np.concatenate([pairs, same])) if high == top else same
        at, which = self.places_of(pairs)
        if len(pairs) > 1:
            self.marked[pairs] = True
            over = self.pair[self.after[at]]
            meet = np.flatnonzero(self.marked[over])
            self.marked[pairs] = False
            if len(same):
                meet = meet[over[meet] != pairs[which[meet]]]
            if len(meet):
                chosen = apart(len(pairs), which[meet], np.searchsorted(pairs, over[meet]))
                left = pairs[~chosen]
                left = left[self.left[left] == self.right[left]]
                self.ask(left, np.full(len(left), high))
                kept = np.flatnonzero(chosen[which])
                pairs, at, which = pairs[chosen], at[kept], (np.cumsum(chosen) - 1)[which[kept]]
        if len(same):
            kept = every_other(at, self.after[at])
            at, which = at[kept], which[kept]
        return self.replace(pairs, at, which)

    def replace(self, pairs: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        symbol, after, before, pair, first = self.symbol, self.after, self.before, self.pair, self.symbols
        second, behind = after[at].astype(np.intp), before[at].astype(np.intp)
        third = after[second].astype(np.intp)
        pair[at] = -1
        lost = pair[second]
        pair[second] = -1
        gone = np.concatenate([lost, pair[behind]])  # -1 if the place behind is itself the second one of another
        pair[behind] = -1
        np.subtract.at(self.count, gone, ONE)  # the last count is that of no pair
        self.count[pairs] = 0
        new = which + first
        symbol[at], symbol[second] = new, -1
        after[at], before[third] = third, at
        self.symbols += len(pairs)
        behind = before[at].astype(np.intp)
        left = symbol[behind]
        old = np.flatnonzero(left < first)  # neither new nor the guard; what begins at the last place but one occurs once
        self.add(np.concatenate([at, behind[old]]), np.concatenate([new, left[old]]), np.concatenate([symbol[third], new[old]]))
        return np.array([self.left[pairs], self.right[pairs]]).T


def build(ids: np.ndarray, least: int = LEAST, rounds: int | None = ROUNDS) -> Grammar:
    """The grammar of ``ids``, whole numbers below 2^31. ``least`` must be 2 or more. It is a whole one with ``least`` 2 and ``rounds`` None; else it ends early."""
    present = np.zeros(int(ids.max(initial=0)) + 1, bool)
    present[ids] = True
    terminals = np.flatnonzero(present)
    pairs = Pairs((np.cumsum(present, dtype=np.int32) - np.int32(1))[ids.astype(np.intp)], len(terminals), least)
    rules, lengths = [np.zeros((0, 2), np.int32)], np.ones(len(terminals) + len(ids) // 2, np.int64)
    while rounds is None or rounds > 0:
        low = pairs.symbols
        new = pairs.next_round()
        if not len(new):
            break
        rules.append(new)
        lengths[low : pairs.symbols] = lengths[new].sum(1)
        rounds = None if rounds is None else rounds - 1
    sequence = pairs.symbol[1:-1]
    sequence = sequence[sequence >= 0]
    return Grammar(terminals.astype(np.uint32), np.concatenate(rules).astype(np.uint32), lengths[: pairs.symbols].copy(), sequence.astype(np.uint32))


def expand(g: Grammar, seq: np.ndarray) -> np.ndarray:
    """What ``seq`` stands for. Lengths say where each symbol's expansion goes; rules are undone all at once, from the outside in, and a terminal is set once."""
    n, seq, rules = len(g.terminals), seq.astype(np.intp), g.rules.astype(np.intp)
    size = g.lengths[seq]
    out = np.empty(int(size.sum()), np.uint32)
    at = np.cumsum(size) - size
    while len(seq):
        rule, end = np.flatnonzero(seq >= n), np.flatnonzero(seq < n)
        out[at[end]] = g.terminals[seq[end]]
        seq, at = seq[rule], at[rule]
        left, right = rules[seq - n].T
        seq, at = np.concatenate([left, right]), np.concatenate([at, at + g.lengths[left]])
    return out


def access(g: Grammar, sums: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Positions ``start`` to ``stop`` of the expansion; ``sums[k]`` is the length of what lies before place k * STEP. Only the symbols in between are decoded."""
    k = int(np.searchsorted(sums, start, "right")) - 1
    stop_k = min(int(np.searchsorted(sums, stop, "left")), len(sums))
    part = g.sequence[k * STEP : stop_k * STEP]
    ends = np.cumsum(g.lengths[part]) + sums[k]
    low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[low - 1]) if low else int(sums[k])
    return expand(g, part[low:high])[start - before : stop - before]


def skip_sums(g: Grammar) -> np.ndarray:
    ends = np.cumsum(g.lengths[g.sequence]) if len(g.sequence) else np.zeros(0, np.int64)
    return np.concatenate([[0], ends[STEP - 1 : -1 : STEP]]).astype(np.int64) if len(ends) else np.zeros(1, np.int64)


def pack(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then the others bit by bit, each for all symbols."""
    return symbols.astype("<u2").tobytes() + b"".join(np.packbits(symbols >> np.uint32(k) & np.uint32(1)).tobytes() for k in range(16, bits))


def packed_size(n: int, bits: int) -> int:
    return 2 * n + max(0, bits - 16) * ((n + 7) // 8)


def unpack(data: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.frombuffer(data, "<u2", n).astype(np.uint32)
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 2 * n + (k - 16) * ((n + 7) // 8)), count=n).astype(np.uint32) << np.uint32(k)
    return out


def to_bytes(g: Grammar) -> bytes:
    """Header, terminals, rules, expansion lengths of the rules, skip sums, sequence; little-endian. Symbols have as many bits as they need, lengths one byte, with those from LONG on in a list behind them."""
    bits, sums, lengths = len(g.lengths).bit_length(), skip_sums(g), g.lengths[len(g.terminals) :]
    long = lengths[lengths >= LONG]
    head = MAGIC + struct.pack("<6I", bits, len(g.terminals), len(g.rules), len(long), len(sums), len(g.sequence))
    parts = [g.terminals.astype("<u4").tobytes(), pack(g.rules.ravel(), bits), np.minimum(lengths, LONG).astype(np.uint8).tobytes(), long.astype("<u8").tobytes(), sums.astype("<u8").tobytes(), pack(g.sequence, bits)]
    return head + b"".join(parts)


def from_bytes(data: bytes | memoryview) -> tuple[Grammar, np.ndarray]:
    data = memoryview(data)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a grammar")
    bits, terminals, rules, long, sums, length = struct.unpack("<6I", data[4:28])
    sizes = [4 * terminals, packed_size(2 * rules, bits), rules, 8 * long, 8 * sums, packed_size(length, bits)]
    ends = np.cumsum([28, *sizes]).tolist()
    part = [data[a:b] for a, b in zip(ends, ends[1:])]
    lengths = np.concatenate([np.ones(terminals, np.int64), np.frombuffer(part[2], np.uint8).astype(np.int64)])
    lengths[terminals:][lengths[terminals:] == LONG] = np.frombuffer(part[3], "<u8")
    return Grammar(np.frombuffer(part[0], "<u4"), unpack(part[1], 2 * rules, bits).reshape(-1, 2), lengths, unpack(part[5], length, bits)), np.frombuffer(part[4], "<u8").astype(np.int64)
