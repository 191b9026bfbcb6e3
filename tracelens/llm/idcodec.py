"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

A block is coded on its own: its models start empty. An id is predicted by its two predecessors (order 2),
its predecessor (order 1) and the block's own frequencies (order 0), which join in one distribution: the part of it
that the order-2 guess leaves goes to the order-1 guess, and what both leave to order 0, which codes the bytes of the id. Two adaptive estimates for the order-2
guess, by its own record and by the order-1 record, are mixed by a weight that follows the better one; what
the guesses leave of the probability goes to the order-0 model of the low byte, then of the high byte, where
the last high byte seen with that low byte is the guess. Every step codes one id of every block, so that
NumPy works on rows of blocks; the reader repeats the same integer steps. Ids are two bytes: encode_blocks() raises
ValueError for ids below 0 or of IDS or more, before anything is coded.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096  #: ids in a block
IDS = 1 << 16  #: ids that two bytes can hold
LANES = 2048  #: blocks coded at once
SLOTS = 1024  #: entries of a block's order-1 and order-2 tables
UNIT, MASK = 1 << 16, (1 << 48) - 1
SCALE, FLOOR, MOST = 1 << 15, 16, 61440


class Frequencies:
    """Adaptive byte frequencies of each lane; the cumulative table is renewed every few steps. Only a reader looks symbols up."""

    def __init__(self, lanes: int, reads: bool):
        self.reads = reads
        self.count = np.ones((lanes, 256), np.int32)
        self.cum = np.zeros((lanes, 257), np.int64)
        self.base, self.base_c = np.arange(lanes) * 256, np.arange(lanes) * 257
        self.renew()

    def renew(self) -> None:
        total = self.count.sum(axis=1, keepdims=True, dtype=np.int32)
        np.cumsum(FLOOR + self.count * np.int32(SCALE - 256 * FLOOR) // total, axis=1, out=self.cum[:, 1:])
        self.cum[:, 256] = SCALE
        if self.reads:
            at = (self.base_c[:, None] + (self.cum[:, 1:256] + 127 >> 7)).ravel()
            starts = np.bincount(at, minlength=self.cum.size).reshape(self.cum.shape)
            self.slot = np.cumsum(starts[:, :256], axis=1, dtype=np.uint8)
        big = total[:, 0] > 1 << 16
        if big.any():
            self.count[big] = (self.count[big] + 1) >> 1

    def span(self, lane: np.ndarray, symbol: np.ndarray, start: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the symbol when the model gets `rest` from `start` on."""
        at, flat = self.base_c[lane] + symbol, self.cum.reshape(-1)
        low = flat[at] * rest >> 15
        return start + low, (flat[at + 1] * rest >> 15) - low

    def find(self, lane: np.ndarray, value: np.ndarray, rest: np.ndarray) -> np.ndarray:
        symbol = self.slot.reshape(-1)[self.base[lane] + np.minimum(value * SCALE // rest >> 7, 255)].astype(np.int64)
        base, flat = self.base_c[lane], self.cum.reshape(-1)
        todo = np.arange(len(lane))
        while len(todo):
            todo = todo[flat[base[todo] + symbol[todo] + 1] * rest[todo] >> 15 <= value[todo]]
            symbol[todo] += 1
        return symbol

    def add(self, lane: np.ndarray, symbol: np.ndarray) -> None:
        self.count.reshape(-1)[self.base[lane] + symbol] += 24


class Model:
    """What writer and reader share: predictions before an id, updates after it."""

    def __init__(self, lanes: int, reads: bool):
        self.all = np.arange(lanes)
        self.wide = self.all * SLOTS
        self.t1, self.t2 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)
        self.pa, self.pb, self.pc = (np.full(lanes * 8, 8192, np.int64) for _ in range(3))
        self.pr = np.full(lanes * 4, 16384, np.int64)
        self.weight = np.full(lanes, 128, np.int64)
        self.high = np.zeros(lanes * 256, np.int32)
        self.low_f, self.high_f = Frequencies(lanes, reads), Frequencies(lanes, reads)
        self.x1, self.x2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self) -> None:
        if self.step and (self.step % 128 == 0 or self.step in (16, 32, 64)):
            self.low_f.renew()
            self.high_f.renew()
        self.i1 = self.wide + (self.x1 * 40503 >> 4 & SLOTS - 1)
        self.i2 = self.wide + (self.x1 * 40503 + self.x2 * 60493 >> 4 & SLOTS - 1)
        e1, e2 = self.t1[self.i1], self.t2[self.i2]
        self.a1, self.k1, self.a2, self.k2 = e1 & 65535, e1 >> 16, e2 & 65535, e2 >> 16
        self.same = self.a1 == self.a2
        self.ia, self.ib, self.ic = self.all * 8 + self.k2, self.all * 8 + 2 * self.k1 + self.same, self.all * 8 + self.k1
        self.qa, self.qb = self.pa[self.ia], self.pb[self.ib]
        self.p2 = (self.qa * self.weight + self.qb * (256 - self.weight) >> 8) * 15 // 16 + 16
        self.p1 = np.where(self.same, 0, (self.pc[self.ic] * np.maximum(MOST - self.p2, 0) >> 16) + 1)  # p2 reaches MOST + 1, and no guess may be left without a width
        self.rest = UNIT - self.p2 - self.p1

    def high_guess(self, lane: np.ndarray, low: np.ndarray) -> None:
        self.ih = lane * 256 + low
        e = self.high[self.ih]
        self.guess, self.conf = e & 255, e >> 8
        self.ir = lane * 4 + self.conf
        self.q = np.clip(self.pr[self.ir], 64, MOST)

    def update(self, x: np.ndarray, miss: np.ndarray) -> None:
        """`miss`: the lanes where neither guess held; high_guess() was called for them."""
        hit2, hit1 = x == self.a2, x == self.a1
        goal = np.where(hit2, 65535, 0)
        self.weight = np.clip(self.weight + np.where((self.qa > self.qb) == hit2, 2, -2), 16, 240)
        self.pa[self.ia] = self.qa + (goal - self.qa >> 4)
        self.pb[self.ib] = self.qb + (goal - self.qb >> 4)
        one = np.flatnonzero(~(hit2 | self.same))
        at = self.ic[one]
        self.pc[at] += np.where(hit1[one], 65535, 0) - self.pc[at] >> 4
        for table, at, guess, conf, hit in ((self.t1, self.i1, self.a1, self.k1, hit1), (self.t2, self.i2, self.a2, self.k2, hit2)):
            table[at] = np.where(hit, guess + (np.minimum(conf + 1, 3) << 16), np.where(conf > 0, guess + (conf - 1 << 16), x))
        if len(miss):
            low, high = x[miss] & 255, x[miss] >> 8
            hit = high == self.guess
            self.pr[self.ir] += np.where(hit, 65535, 0) - self.pr[self.ir] >> 4
            self.high[self.ih] = np.where(hit, self.guess + (np.minimum(self.conf + 1, 3) << 8), np.where(self.conf > 0, self.guess + (self.conf - 1 << 8), high))
            self.low_f.add(miss, low)
            wrong = np.flatnonzero(~hit)
            self.high_f.add(miss[wrong], high[wrong])
        self.x2, self.x1 = self.x1, x
        self.step += 1


class Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.width = 2 * steps + 4
        self.out, self.at = np.zeros(lanes * self.width, np.int32), np.arange(lanes) * self.width
        self.start = self.at.copy()

    def put(self, lane, cum: np.ndarray, freq: np.ndarray) -> None:
        """`lane`: indices, or a slice for all."""
        range_ = self.range[lane]
        part = range_ >> 16
        low, range_ = self.low[lane] + part * cum, part * freq
        at = self.at[lane]
        over = np.flatnonzero(low > MASK)
        if len(over):
            low[over] &= MASK
            back = at[over] - 1
            while len(back):
                self.out[back] += 1
                back = back[self.out[back] > 65535]
                self.out[back] = 0
                back = back - 1
        full = np.flatnonzero(range_ < 1 << 32)
        if len(full):
            word = low[full]
            self.out[at[full]] = word >> 32
            low[full] = word << 16 & MASK
            range_[full] <<= 16
            at[full] += 1
        self.low[lane], self.range[lane], self.at[lane] = low, range_, at

    def blocks(self) -> list[bytes]:
        for _ in range(3):
            self.out[self.at] = self.low >> 32
            self.low = self.low << 16 & MASK
            self.at = self.at + 1
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(self.start, self.at)]


class Reader:
    def __init__(self, blocks: list[bytes]):
        words = [np.frombuffer(b, "<u2") for b in blocks]
        sizes = np.array([len(w) + 4 for w in words])
        self.words = np.zeros(sizes.sum(), np.uint16)
        self.at = np.cumsum(sizes) - sizes
        for a, w in zip(self.at, words):
            self.words[a : a + len(w)] = w
        self.code, self.range = np.zeros(len(blocks), np.int64), np.full(len(blocks), 1 << 48, np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self.words[self.at]
            self.at = self.at + 1

    def value(self, lane) -> np.ndarray:
        self.part = self.range[lane] >> 16
        return np.minimum(self.code[lane] // self.part, UNIT - 1)

    def took(self, lane, cum: np.ndarray, freq: np.ndarray) -> None:
        code, range_, at = self.code[lane] - self.part * cum, self.part * freq, self.at[lane]
        full = np.flatnonzero(range_ < 1 << 32)
        if len(full):
            code[full] = code[full] << 16 | self.words[at[full]]
            range_[full] <<= 16
            at[full] += 1
        self.code[lane], self.range[lane], self.at[lane] = code, range_, at


EVERY = slice(None)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The coded bytes of each run of `block` ids; the last run may be shorter (it is padded, its reader cuts it)."""
    if not len(ids):
        return []
    least, most = int(ids.min()), int(ids.max())
    if least < 0 or most >= IDS:
        raise ValueError(f"token ids must lie between 0 and {IDS - 1}: these reach from {least} to {most}")
    lanes, steps = -(-len(ids) // block), min(block, len(ids))
    rows = np.zeros(lanes * steps, np.uint16)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    model, writer = Model(lanes, reads=False), Writer(lanes, steps)
    for row in rows:
        x = row.astype(np.int64)
        model.predict()
        hit2, hit1 = x == model.a2, x == model.a1
        cum, freq = np.where(hit2, 0, model.p2), np.where(hit2, model.p2, model.p1)
        miss = np.flatnonzero(~(hit2 | hit1))
        low = x[miss] & 255
        cum[miss], freq[miss] = model.low_f.span(miss, low, (model.p2 + model.p1)[miss], model.rest[miss])
        writer.put(EVERY, cum, freq)
        if len(miss):
            high = x[miss] >> 8
            model.high_guess(miss, low)
            c, f = model.high_f.span(miss, high, model.q, UNIT - model.q)
            hit = high == model.guess
            writer.put(miss, np.where(hit, 0, c), np.where(hit, model.q, f))
        model.update(x, miss)
    return writer.blocks()


def decode_blocks(blocks: list[bytes], steps: int) -> np.ndarray:
    """blocks x steps ids."""
    lanes = len(blocks)
    model, reader, out = Model(lanes, reads=True), Reader(blocks), np.empty((steps, lanes), np.uint16)
    for t in range(steps):
        model.predict()
        value = reader.value(EVERY)
        hit2 = value < model.p2
        hit1 = ~hit2 & (value < model.p2 + model.p1)
        x = np.where(hit2, model.a2, model.a1).astype(np.int64)
        cum, freq = np.where(hit2, 0, model.p2), np.where(hit2, model.p2, model.p1)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            start, rest = (model.p2 + model.p1)[miss], model.rest[miss]
            low = model.low_f.find(miss, value[miss] - start, rest)
            cum[miss], freq[miss] = model.low_f.span(miss, low, start, rest)
        reader.took(EVERY, cum, freq)
        if len(miss):
            model.high_guess(miss, low)
            value = reader.value(miss)
            hit, high = value < model.q, model.guess.astype(np.int64)
            cum, freq = np.zeros(len(miss), np.int64), model.q.copy()
            wrong = np.flatnonzero(~hit)
            start, rest = model.q[wrong], UNIT - model.q[wrong]
            high[wrong] = model.high_f.find(miss[wrong], value[wrong] - start, rest)
            cum[wrong], freq[wrong] = model.high_f.span(miss[wrong], high[wrong], start, rest)
            reader.took(miss, cum, freq)
            x[miss] = high << 8 | low
        model.update(x, miss)
        out[t] = x
    return out.T
