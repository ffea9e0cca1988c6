"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Model. Three orders predict the next id. Orders 1 and 2 look up, by a hash of the last one or two ids, the id that
followed last and how often in a row it was right; each order's share of the probability adapts to its rate of hits at
that confidence. Order 0 has the rest: an adaptive distribution over the whole vocabulary, with a count of one for every
id and ``GAIN`` more for every time it was seen, summed up anew at set steps. All shares lie in one interval: the id
predicted by order 2, the id predicted by order 1 (one part if they agree), then all ids by order 0.

Coding. A carry-less range coder with 64-bit low and range emits 32-bit words. All arithmetic is on integers, so coder and
decoder agree everywhere. Every block starts from the same state and can be decoded alone; its CRC-32 is held beside it.

Lanes. An id depends on the ids before it in its block only, so blocks advance together: each numpy operation takes one
step in all of them. Order 0 is held as the sorted distinct ids of each block, not as a row over the vocabulary, so that
the state of all lanes stays small.
"""
from __future__ import annotations

import zlib

import numpy as np

GAIN = 32
SLOTS = 12  # two to this many slots in each prediction table
RATE = 5  # a share moves by 1/32 of the difference
ONE, MOST = 4096, 3600  # shares are in 4096ths, at most MOST
SURE = 15  # highest confidence; 0 is an empty slot
BOTTOM = np.uint64(1 << 30)
WORD = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)
LIMIT = 1 << 23  # mass of order 0; with the highest shares the whole mass stays within BOTTOM


def refreshes(block: int) -> list[int]:
    """Steps at which order 0 is summed up anew."""
    out, at = [], 32
    while at < block:
        out.append(at)
        at += min(at, 2048)
    return out


def held(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, mass below each, mass of each) of order 0 after ``ids``."""
    known, times = np.unique(ids, return_counts=True)
    own = 1 + GAIN * times
    return known, known + np.cumsum(own - 1) - (own - 1), own


class Predictions:
    """Orders 1 and 2 of all lanes, as rows 0 and 1 of each array; all lanes begin alike and take their steps together."""

    def __init__(self, lanes: int):
        row = np.arange(2 * lanes).reshape(2, lanes)
        self.slot, self.share_row = row << SLOTS, row * (SURE + 1)
        # an entry is the id that came last and, in its low bits, the confidence; at first an id that never comes
        self.table = np.full(2 * lanes << SLOTS, LIMIT << 4, np.uint32)
        self.share = np.where(np.arange(2 * lanes * (SURE + 1)) % (SURE + 1), ONE // 8, 0)
        self.odds = np.array([(h << 16) // (ONE - h) for h in range(MOST + 1)])
        # what a miss and a hit add to an entry
        sure = np.arange(SURE + 1)
        self.change = np.concatenate([(sure >> 1) - sure, (sure < SURE).astype(np.int64)])
        self.key = np.zeros((2, lanes), np.int64)

    def predict(self, m: int, total: int) -> None:
        """Ids and masses that orders 1 and 2 predict in the first ``m`` lanes, beside ``total`` of order 0."""
        self.place = (self.key[:, :m] >> 3 & ((1 << SLOTS) - 1)) + self.slot[:, :m]
        self.entry = self.table.take(self.place, mode="clip").astype(np.int64)
        self.guess, self.sure = self.entry >> 4, self.entry & SURE
        self.cell = self.sure + self.share_row[:, :m]
        self.held = self.share.take(self.cell, mode="clip")
        one, two = self.odds.take(self.held, mode="clip")
        one = one * total >> 16
        two = (one + total) * two >> 16
        self.both = one + two
        self.two = two + one * (self.guess[0] == self.guess[1])  # the id of order 2 comes first, then that of order 1
        self.mass = self.both + total

    def interval(self, below: np.ndarray, own: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass below, mass) of ids with the given place in order 0; ``one`` and ``two`` tell those that come by prediction."""
        below, own = below + self.both, own.copy()
        np.copyto(below, self.two, where=one)
        np.copyto(own, self.both - self.two, where=one)
        np.copyto(below, 0, where=two)
        np.copyto(own, self.two, where=two)
        return below, own

    def learn(self, x: np.ndarray, m: int) -> None:
        hit = self.guess == x
        self.share.put(self.cell, self.held + ((hit * MOST - self.held) >> RATE), mode="clip")
        entry = self.entry + self.change.take(self.sure + (hit << 4), mode="clip")
        np.copyto(entry, (x << 4) + 1, where=(self.sure < 2) & ~hit)
        self.table.put(self.place, entry, mode="clip")
        key = x * 40503
        self.key[1, :m] = (self.key[0, :m] & 0xFFFFF) * 60493 + key
        self.key[0, :m] = key


class Coder:
    """Low and range of every lane."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, unit: np.ndarray, below: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
        """Take the interval; returns the lanes that emit their top word. ``shift`` must follow."""
        low, width = self.low[:m], self.range[:m]
        low += unit * below.view(np.uint64)
        np.multiply(unit, own.view(np.uint64), out=width)
        same = (low ^ (low + width - np.uint64(1))) <= LOW
        cut = (width < BOTTOM) & ~same
        if cut.any():  # the range is small and crosses a word: keep the part below the crossing
            width[cut] = np.uint64(1 << 32) - (low[cut] & LOW)
            same |= cut
        return np.flatnonzero(same)

    def shift(self, lanes: np.ndarray) -> None:
        self.low.put(lanes, self.low.take(lanes) << WORD)
        self.range.put(lanes, (self.range.take(lanes) << WORD) - np.uint64(1))


def lanes_of(blocks: list, sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """Blocks by falling size, so that those still running come first, and their sizes."""
    order = sorted(range(len(blocks)), key=lambda i: -sizes[i])
    return order, np.array([sizes[i] for i in order], np.int64)


def stretches(steps: int):
    """(first step, last step) with the same order 0."""
    marks = [0, *refreshes(steps), steps]
    return [(a, b) for a, b in zip(marks, marks[1:]) if b > a]


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Coded words of every block of ids, each from a state of its own."""
    order, sizes = lanes_of(blocks, [len(b) for b in blocks])
    lanes, steps = len(blocks), int(sizes.max(initial=0))
    if vocabulary + GAIN * steps > LIMIT:
        raise ValueError("the vocabulary or a block is too large")
    if any(len(b) and int(b.max()) >= vocabulary for b in blocks):
        raise ValueError("an id is outside the vocabulary")
    model, coder = Predictions(lanes), Coder(lanes)
    words, used = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    for first, last in stretches(steps):
        m = int(np.searchsorted(-sizes, -first, "left"))
        # what order 0 says of the next ids doesn't change within a stretch
        ids, lower, mine = (np.zeros((last - first, m), np.int64) for _ in range(3))
        for lane in range(m):
            x = blocks[order[lane]][first:last].astype(np.int64)
            known, low, own = held(blocks[order[lane]][:first])
            at = np.searchsorted(known, x)
            seen = at < len(known)
            seen[seen] = known[at[seen]] == x[seen]
            before = np.append(low - known, GAIN * first)[at]  # mass that seen ids add below the place
            ids[:len(x), lane] = x
            lower[:len(x), lane] = x + before
            mine[:len(x), lane] = np.where(seen, np.append(own, 1)[at], 1)
        total = vocabulary + GAIN * first
        for step in range(first, last):
            m = int(np.searchsorted(-sizes, -step, "left"))
            x = ids[step - first, :m]
            model.predict(m, total)
            two = (model.guess[1] == x) & (model.two > 0)
            one = (model.guess[0] == x) & (model.both > model.two)
            below, own = model.interval(lower[step - first, :m], mine[step - first, :m], one & ~two, two)
            out = coder.narrow(coder.range[:m] // model.mass.view(np.uint64), below, own, m)
            if len(out):
                at = used.take(out)
                words.put(out * words.shape[1] + at, coder.low.take(out) >> WORD)
                used.put(out, at + 1)
                coder.shift(out)
            model.learn(x, m)
    result: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        n = int(used[lane])
        if sizes[lane]:
            words[lane, n], words[lane, n + 1] = coder.low[lane] >> WORD, coder.low[lane] & LOW
            n += 2
        while n and not words[lane, n - 1]:  # the decoder reads zeros after the end
            n -= 1
        result[i] = words[lane, :n].astype("<u4").tobytes()
    return result


def decode(coded: list[bytes], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of blocks from their words and sizes."""
    order, count = lanes_of(coded, sizes)
    lanes, steps = len(coded), int(count.max(initial=0))
    most = max((len(c) // 4 for c in coded), default=0)
    words = np.zeros((lanes, max(most, steps) + 4), np.uint64)
    for lane, i in enumerate(order):
        raw = np.frombuffer(coded[i], "<u4")
        words[lane, :len(raw)] = raw
    ids = np.zeros((steps, lanes), np.int32)
    model, coder = Predictions(lanes), Coder(lanes)
    code = words[:, 0] << WORD | words[:, 1]
    used = np.full(lanes, 2, np.int64)
    for first, last in stretches(steps):
        m = int(np.searchsorted(-count, -first, "left"))
        # the distinct ids of each lane with the mass below and of each; entry 0 stands for what lies below the first
        tables = [held(row) for row in np.ascontiguousarray(ids[:first, :m].T)]
        width = 1 << max(len(k) for k, _, _ in tables).bit_length()
        lower = np.full((m, width), 0xFFFFFFFF, np.uint32)
        mine, name = np.zeros((m, width), np.uint32), np.zeros((m, width), np.uint32)
        lower[:, 0] = 0
        for lane, (known, low, own) in enumerate(tables):
            n = len(known) + 1
            lower[lane, 1:n], mine[lane, 1:n], name[lane, 1:n] = low, own, known
        lower, mine, name = lower.reshape(-1), mine.reshape(-1), name.reshape(-1)
        rows = np.arange(m) * width
        total = vocabulary + GAIN * first
        for step in range(first, last):
            m = int(np.searchsorted(-count, -step, "left"))
            model.predict(m, total)
            unit = coder.range[:m] // model.mass.view(np.uint64)
            t = np.minimum(((code[:m] - coder.low[:m]) // unit).view(np.int64), model.mass - 1)
            two, one = t < model.two, t < model.both
            one &= ~two
            t -= model.both
            np.maximum(t, 0, out=t)
            wanted = t.astype(np.uint32)
            at = rows[:m]
            jump = width >> 1
            while jump:
                to = at + jump
                at = np.where(lower.take(to, mode="clip") <= wanted, to, at)
                jump >>= 1
            below, own = lower.take(at, mode="clip").astype(np.int64), mine.take(at, mode="clip")
            x = name.take(at, mode="clip").astype(np.int64)
            beyond = t - below - own
            new = beyond >= 0
            # an unseen id: so many after the seen one below it (entry 0: from the first id on)
            np.copyto(x, x + beyond + (at > rows[:m]), where=new)
            np.copyto(below, t, where=new)
            np.copyto(own, 1, where=new)
            np.copyto(x, model.guess[0], where=one)
            np.copyto(x, model.guess[1], where=two)
            below, own = model.interval(below, own.astype(np.int64), one, two)
            out = coder.narrow(unit, below, own, m)
            if len(out):
                at = used.take(out)
                code.put(out, code.take(out) << WORD | words.take(out * words.shape[1] + at))
                used.put(out, at + 1)
                coder.shift(out)
            model.learn(x, m)
            ids[step, :m] = x
    result: list[np.ndarray] = [np.empty(0, np.int64)] * lanes
    for lane, i in enumerate(order):
        result[i] = ids[:count[lane], lane].astype(np.int64)
    return result


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
