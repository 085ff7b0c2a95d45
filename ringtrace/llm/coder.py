"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes of equal length that advance together, one id a step, so that
numpy does each step for all lanes at once.  All lanes of a block share one model:

* order 2: the id that last followed the two ids before, with a confidence;
* order 1: the id that last followed the id before, with a confidence;
* order 0: how often each id occurs in the block (written in its head).

The order-2 prediction is offered first: is it the next id?  The probability of yes mixes
what the three orders have to say about that id, in the logistic domain, with weights that
are learnt as the block goes on.  If no, the order-1 prediction is offered in the same way
(where it differs), and else the id is coded by its order-0 frequency.  What a mixer is told
of an id is one of few cells, so its probabilities are worked out for each cell, not for each
id, and it learns from the cells' counts, after every step at first and ever more rarely later.  These probabilities drive a range
coder for each lane.  The decoder repeats every step and so meets the same model.  All
arithmetic is in integers, but for one division of doubles that is exact.  The model starts
anew in each block, and a block carries a checksum of its ids, so blocks are decoded, moved
or lost one by one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RTC2"
#: Ids that a lane holds at most, and lanes of a block that is closed in time.
STEPS, LANES = 256, 8192
BLOCK_IDS = STEPS * LANES
#: The mixers learn after every step at first, and then ever more rarely: after step s not for another s / REFRESH.
REFRESH = 2
#: The model takes in the ids of every step up to step ALL, and then of one step in SOME.
ALL, SOME = 32, 4
PAIR_BITS = 18
#: Probabilities of a prediction are in units of 2**-UNIT; each of the three cases has LEAST of them or more.
UNIT, LEAST = 14, 16

#: A lane's range is held between 2**32 and 2**48, so that two divisions by 2**14 and 2**20 leave it above 0.
_MIN, _LOW, _ALL = 1 << 32, (1 << 32) - 1, (1 << 48) - 1
_MIX1, _MIX2, _PAIR_SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(32 - PAIR_BITS)
#: What is added to an entry, by its confidence: after a miss (below 2 it is replaced), then after a hit.
_SURER = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)


def _stretch_table() -> np.ndarray:
    p = (np.arange(4096) + 0.5) / 4096
    return np.round(np.log(p / (1 - p)) * 256).astype(np.int64)


def _squash_table() -> np.ndarray:
    x = np.arange(-2047, 2048) / 256
    return np.clip(np.round(65536 / (1 + np.exp(-x))), 48, 65536 - 48).astype(np.int64)


_STRETCH, _SQUASH = _stretch_table(), _squash_table()

#: A cell: do both predictions agree; how common (2 bits) and how sure (3 bits) are that of order 2 and that of order 1.
_CELLS = np.arange(1 << 11)
_AGREE, _COMMON2, _SURE2, _COMMON1, _SURE1 = _CELLS >> 10, _CELLS >> 8 & 3, _CELLS >> 5 & 7, _CELLS >> 3 & 3, _CELLS & 7


class _Counter:
    """Adaptive probabilities of yes, by context: counts of yes and of all, halved when large."""

    def __init__(self, at: np.ndarray):
        self.at, self.size = at, int(at.max()) + 1
        self.yes, self.all = np.ones(self.size, np.int64), np.full(self.size, 3, np.int64)

    def stretched(self) -> np.ndarray:
        return _STRETCH[(self.yes << 12) // self.all][self.at]

    def update(self, yes: np.ndarray, both: np.ndarray) -> None:
        # whole numbers below 2**53: float sums of them are exact in any order
        self.yes += np.bincount(self.at, yes, self.size).astype(np.int64)
        self.all += np.bincount(self.at, both, self.size).astype(np.int64)
        full = self.all > 1 << 16
        while full.any():
            self.yes[full] = (self.yes[full] >> 1) + 1
            self.all[full] = (self.all[full] >> 1) + 2
            full = self.all > 1 << 16


class _Mixer:
    """The chance that an offered id is next, for each cell, from three counters, by learnt weights."""

    def __init__(self, *contexts: np.ndarray):
        self.inputs, self.first = [_Counter(at) for at in contexts], contexts[0]
        self.sets = self.inputs[0].size
        self.weights = np.full((len(contexts), self.sets), (1 << 16) * 2 // 5, np.int64)
        self._predict()

    def _predict(self) -> None:
        self.stretched = [c.stretched() for c in self.inputs]
        dot = sum(w[self.first] * s for w, s in zip(self.weights, self.stretched)) >> 16
        self.p = _SQUASH[np.clip(dot, -2047, 2047) + 2047]

    def update(self, yes: np.ndarray, both: np.ndarray) -> None:
        error = (yes << 16) - both * self.p
        seen = np.maximum(np.bincount(self.first, both, self.sets).astype(np.int64), 1)
        for w, s in zip(self.weights, self.stretched):
            step = np.bincount(self.first, error * s, self.sets).astype(np.int64)
            w += (step // seen) >> 10
            np.clip(w, -(1 << 18), 1 << 18, out=w)
        for c in self.inputs:
            c.update(yes, both)
        self._predict()


class _Model:
    """Entries of the tables are ``tag * 8 + confidence``; a tag is ``symbol * 4 + how common it is``; symbol 0 is none."""

    def __init__(self, lanes: int, symbols: int):
        self.next1, self.next2 = np.zeros(symbols + 1, np.int32), np.zeros(1 << PAIR_BITS, np.int32)
        self.last = self.before = np.zeros(lanes, np.uint32)
        self.mix2 = _Mixer(_SURE2 * 2 + _AGREE, _SURE1 * 2 + _AGREE, _COMMON2)
        self.mix1 = _Mixer(_SURE1, _SURE2, _COMMON1)
        self.met: list[np.ndarray] = []
        self.step, self.due, self.learns = 0, 1, True
        self._refresh()

    def _refresh(self) -> None:
        if self.met:
            yes2, yes1, no, _ = np.bincount(np.concatenate(self.met), minlength=4 * len(_CELLS)).reshape(-1, 4).T
            self.met = []
            self.mix2.update(yes2, yes2 + yes1 + no)
            self.mix1.update(yes1 * (1 - _AGREE), (yes1 + no) * (1 - _AGREE))
        whole = 1 << UNIT
        end2 = np.clip(self.mix2.p >> 16 - UNIT, LEAST, whole - 2 * LEAST)
        end1 = np.where(_AGREE, end2, end2 + np.clip((whole - end2) * self.mix1.p >> 16, LEAST, whole - LEAST - end2))
        self.ends = (end2 | end1 << 16).astype(np.int32)
        start, end = np.stack([0 * end2, end2, end1, end1]), np.stack([end2, end1, 0 * end2 + whole, end1])
        self.parts = (start | end - start << 16).T.astype(np.int32).reshape(-1)

    def look(self) -> None:
        """Sets tag2 and tag1, the symbols that orders 2 and 1 offer, and the cell that their intervals depend on."""
        self.pair = (self.before * _MIX2 + self.last * _MIX1 >> _PAIR_SHIFT).astype(np.intp)
        self.single = self.last.astype(np.intp)
        self.entry2, self.entry1 = self.next2.take(self.pair, mode="clip"), self.next1.take(self.single, mode="clip")
        self.tag2, self.tag1 = self.entry2 >> 3, self.entry1 >> 3
        self.cell = (self.entry2 & 31) << 5 | (self.entry1 & 31) | (self.tag2 == self.tag1).astype(np.int32) << 10

    def interval(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, in units, of 0: order 2 was right, 1: order 1 was, 2: neither."""
        case = self.cell << 2 | outcome
        if self.learns:
            self.met.append(case)
        part = self.parts.take(case, mode="clip")
        return part & 0xFFFF, part >> 16

    def learn(self, tags: np.ndarray) -> None:
        if self.learns:
            fresh = tags << 3
            for entry, tag, nexts, at in ((self.entry2, self.tag2, self.next2, self.pair), (self.entry1, self.tag1, self.next1, self.single)):
                case = (entry & 7) | (tag == tags).astype(np.int32) << 3
                nexts[at] = entry + _SURER.take(case, mode="clip") + (fresh - entry) * (case < 2)
        self.before, self.last = self.last, (tags >> 2).astype(np.uint32)
        self.step += 1
        self.learns = self.step < ALL or self.step % SOME == 0
        if self.step == self.due:
            self.due += 1 + self.step // REFRESH
            self._refresh()


class _Order0:
    """The order-0 frequencies of a block's symbols, adding up to a power of two; symbol 0 stands for all of it."""

    def __init__(self, size: np.ndarray):
        self.bits = _bits(len(size))
        self.size, self.start = np.concatenate([[1 << self.bits], size]), np.concatenate([[0], np.cumsum(size) - size])
        # how common a symbol is, in powers of four from 2**-10 up
        common = np.clip(np.frexp(self.size)[1] + 9 - self.bits >> 1, 0, 3)
        self.tags = (np.arange(len(self.size)) << 2 | common).astype(np.int32)

    def by_place(self) -> np.ndarray:
        return np.repeat(self.tags[1:], self.size[1:])


def _bits(symbols: int) -> int:
    return min(symbols.bit_length() + 5, 20)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, -(-n // STEPS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray) -> bytes:
    """One block: magic, count, symbols, crc32 of the ids, size of the packed head, that head, code words.  No ids: no head.

    The packed head holds the block's distinct ids (as differences), their order-0 frequencies and the lanes' numbers of
    words; the first words of all lanes come first, then the second ones, and so on.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<IIII", 0, 0, zlib.crc32(ids), 0)
    if int(ids.max()) >= 1 << 20:
        raise ValueError("ids of 2**20 or more are not supported")
    count = np.bincount(ids)
    known = np.flatnonzero(count)
    count = count[known]
    total = 1 << _bits(len(known))
    share = count * (total - len(known)) // n + 1
    share[np.argmax(share)] += total - int(share.sum())
    order0 = _Order0(share)
    tags = np.zeros(int(known[-1]) + 1, np.int32)
    tags[known] = order0.tags[1:]
    lanes, steps = _shape(n)
    grid = np.full(lanes * steps, order0.tags[1])
    grid[:n] = tags[ids]
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, len(known))
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    # words have 17 bits until carries are settled in the end; an id takes 34 bits at most
    out, at = np.zeros((steps * 3 + 8) * lanes, np.int32), np.arange(lanes)
    for now in grid:
        model.look()
        miss2 = model.tag2 != now
        no = miss2 & (model.tag1 != now)
        start, size = model.interval(miss2.astype(np.int32) + no)
        unit = rng >> UNIT
        low += unit * start
        unit = unit * size >> order0.bits
        symbol = (now >> 2) * no
        low += unit * order0.start.take(symbol, mode="clip")
        rng = unit * order0.size.take(symbol, mode="clip")
        model.learn(now)
        short = np.flatnonzero(rng < _MIN)
        while len(short):
            place, value = at.take(short, mode="clip"), low.take(short, mode="clip")
            out[place] = (value >> 32).astype(np.int32)
            at[short] = place + lanes
            low[short] = (value & _LOW) << 16
            value = rng.take(short, mode="clip") << 16
            rng[short] = value
            short = short[value < _MIN]
    # two words more name a number in the lane's range, whatever follows them
    low += 0xFFFF
    out[at], out[at + lanes] = low >> 32, low >> 16 & 0xFFFF
    sizes = at // lanes + 2
    out = out.reshape(-1, lanes)[: int(sizes.max())]
    for k in range(len(out) - 1, 0, -1):
        out[k - 1] += out[k] >> 16
    words = out.astype("<u2")[np.arange(len(out))[:, None] < sizes]
    head = zlib.compress(np.concatenate([np.diff(known, prepend=0), order0.size[1:], sizes]).astype("<u4").tobytes())
    return MAGIC + struct.pack("<IIII", n, len(known), zlib.crc32(ids), len(head)) + head + words.tobytes()


def _read_head(block: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, symbols, crc, packed = struct.unpack_from("<IIII", block, 4)
    lanes, _ = _shape(n)
    try:
        head = np.frombuffer(zlib.decompress(block[20 : 20 + packed]), "<u4").astype(np.int64)
    except zlib.error as e:
        raise ValueError("the head of a block of token ids is damaged") from e
    if len(head) != 2 * symbols + lanes:
        raise ValueError("the head of a block of token ids is damaged")
    known, size, sizes = np.cumsum(head[:symbols]), head[symbols : 2 * symbols], head[2 * symbols :]
    words = np.frombuffer(block, "<u2", -1, 20 + packed)
    if int(size.sum()) != 1 << _bits(symbols) or int(size.min()) < 1 or int(sizes.sum()) != len(words):
        raise ValueError("a block of token ids is cut short")
    return n, crc, known, size, sizes, words


def decode(block: bytes) -> np.ndarray:
    """The ids of a block, as uint32; ValueError if it is damaged."""
    if len(block) < 20 or block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    if block[4:8] == b"\0\0\0\0":
        return np.zeros(0, "<u4")
    n, crc, known, size, sizes, words = _read_head(block)
    order0 = _Order0(size)
    by_place = order0.by_place()
    lanes, steps = _shape(n)
    model = _Model(lanes, len(known))
    held = np.zeros((int(sizes.max()) + 3, lanes), np.int32)
    held[np.arange(len(held))[:, None] < sizes] = words
    words, at = held.reshape(-1), np.arange(lanes)
    rng, code = np.full(lanes, 1 << 48, np.int64), np.zeros(lanes, np.int64)
    for row in held[:3]:
        code = code << 16 | row
        at += lanes
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        model.look()
        ends = model.ends.take(model.cell, mode="clip")
        unit = rng >> UNIT
        miss2, no = code >= unit * (ends & 0xFFFF), code >= unit * (ends >> 16)
        start, size = model.interval(miss2.astype(np.int32) + no)
        code -= unit * start
        unit = unit * size >> order0.bits
        # both are whole and below 2**48, so that the quotient of doubles is cut at the right place
        place = (code / unit).astype(np.int64)
        now = by_place.take(place, mode="clip") * no + model.tag1 * (miss2 ^ no) + model.tag2 * ~miss2
        symbol = (now >> 2) * no
        code -= unit * order0.start.take(symbol, mode="clip")
        rng = unit * order0.size.take(symbol, mode="clip")
        grid[t] = now
        model.learn(now)
        short = np.flatnonzero(rng < _MIN)
        while len(short):
            place = at.take(short, mode="clip")
            # a damaged block may ask for more words than there are; the checksum tells in the end
            code[short] = (code.take(short, mode="clip") << 16 | words.take(place, mode="clip")) & _ALL
            at[short] = place + lanes
            value = rng.take(short, mode="clip") << 16
            rng[short] = value
            short = short[value < _MIN]
    ids = np.concatenate([[0], known]).astype("<u4").take(grid.T.reshape(-1)[:n] >> 2, mode="clip")
    if zlib.crc32(ids) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids
