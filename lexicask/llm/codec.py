"""A context-mixing range coder for blocks of token ids.

A block starts from an empty model and carries its own checksum, so any block is decoded without any other.
Its ids are dealt to lanes of consecutive ids that share one adaptive model; every step codes one id of each lane with
array operations. An order-2 and an order-1 context each predict an id; an order-0 distribution of the ids seen so far
holds every other id. The probability that either prediction is right is learnt for each combination of their
confidences, and the three are mixed into one distribution that drives a carry-less range coder of 64 bits per lane.
The model is integers and basic operations on doubles, hence the same for coder and decoder.

Block: magic, ids, vocabulary, lanes, crc32 of the ids as little-endian unsigned 32-bit integers, crc32 of the rest;
then the number of units of each lane, then the units (32 bits each) lane by lane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LXR1"
HEAD = struct.Struct("<4sIIIII")
#: Ids of a block at most; with a vocabulary of up to 2 ** 19 the order-0 total stays within 2 ** 20.
MOST = 1 << 19
LANES, LEAST_STEPS = 4096, 48
SCALE = 24
#: Share of the range that the predictions may take together.
PREDICTED = (1 << SCALE) - (1 << 20)
#: Steps after which the order-0 distribution and the weights of the predictions are made anew.
WINDOW = 32
U = np.uint64
LEAST, UNIT = U(1 << 32), U(32)


class Corrupt(ValueError):
    """A block whose checksum does not hold."""


class Model:
    """What coder and decoder know before a step. Only integers, and products and quotients of doubles, which are exact by IEEE 754."""

    def __init__(self, vocab: int, lanes: int, finds: bool = False):
        """finds: keep the id at each place of the order-0 distribution, for a decoder."""
        self.finds = finds
        self.counts = np.ones(vocab, np.int64)
        self.cdf = np.arange(vocab + 1, dtype=np.float64)
        # predicted id * 8 + confidence
        self.order1, self.order2 = np.zeros(vocab, np.int64), np.zeros(1 << 18, np.int64)
        self.outcomes = np.zeros(4 * 128, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.recent: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.step = 0
        self._renew()

    def _renew(self) -> None:
        """Weights of the predictions by confidences: how often each was right, of all tries."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=len(self.counts))
            np.cumsum(self.counts, out=self.cdf[1:])
            self.outcomes += np.bincount(np.concatenate(self.seen), minlength=512)
            self.recent, self.seen = [], []
        if self.finds:
            self.id_at = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        tried = self.outcomes.reshape(128, 4)
        of = 2 * tried.sum(axis=1) + 4
        self.weight2 = PREDICTED * (2 * tried[:, 2] + 1) // of
        self.weight21 = self.weight2 + PREDICTED * (2 * tried[:, 1] + 1) // of
        self.scale = ((1 << SCALE) - self.weight21) / self.cdf[-1]

    def predict(self) -> None:
        """p2, p1: each lane's predicted ids; w2, w21: where their shares of the range end; scale: of the order-0 distribution in the rest."""
        self.at2 = (self.before * 40503 + self.last * 30011) & ((1 << 18) - 1)
        self.v1, self.v2 = self.order1[self.last], self.order2[self.at2]
        self.p1, self.p2 = self.v1 >> 3, self.v2 >> 3
        self.mix = ((self.v2 & 7) << 3) + (self.v1 & 7) + ((self.p1 == self.p2).view(np.int8).astype(np.int64) << 6)
        self.w2, self.w21, self.s = self.weight2[self.mix], self.weight21[self.mix], self.scale[self.mix]

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """ids: of this step; hit2, hit1: whether they are the predicted ones."""
        self.seen.append((self.mix << 2) + np.maximum(hit2.view(np.int8) << 1, hit1.view(np.int8)))
        new = (ids << 3) + 1
        for table, at, v, hit in ((self.order1, self.last, self.v1, hit1), (self.order2, self.at2, self.v2, hit2)):
            c = v & 7
            changed = v - c + (c >> 1)
            np.copyto(changed, new, where=c <= 1)
            k = np.flatnonzero(hit)
            changed[k] = v[k] + (c[k] < 7)
            table[at] = changed
        self.before, self.last = self.last, ids
        self.recent.append(ids)
        self.step += 1
        if self.renews(self.step):
            self._renew()

    @staticmethod
    def renews(step: int) -> bool:
        return step % WINDOW == 0 or step & (step - 1) == 0


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def _narrowed(low: np.ndarray, span: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Narrow every lane's range in place; lanes whose upper 32 bits are to leave it."""
    r = span >> U(SCALE)
    low += r * start.view(U)
    np.multiply(r, (stop - start).view(U), out=span)
    return np.flatnonzero(span < LEAST)


def _shift(low: np.ndarray, span: np.ndarray, go: np.ndarray) -> np.ndarray:
    """Move 32 bits out of the lanes in go; these bits. A range across a border of them is cut there first."""
    l, s = low[go], span[go]
    across = ((l ^ (l + s)) >> UNIT) != 0
    s = np.where(across, (~l + U(1)) & (LEAST - U(1)), s)
    low[go], span[go] = l << UNIT, s << UNIT
    return l >> UNIT


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """One block of at most MOST ids, each below vocab."""
    n = len(ids)
    if n > MOST:
        raise ValueError(f"a block holds at most {MOST} ids")
    if n and int(ids.max()) >= vocab:
        raise ValueError("an id lies outside the vocabulary")
    check = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocab, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    units, at = np.zeros((lanes, steps + 8), np.uint32), np.zeros(lanes, np.int64)
    first = 0
    for t in range(steps):
        if t == 0 or model.renews(t):  # until the next change the order-0 places of the ids are known
            first, most = t, min(steps, t + WINDOW)
            starts, stops = model.cdf[grid[first:most]], model.cdf[grid[first:most] + 1]
        x = grid[t]
        model.predict()
        start = (starts[t - first] * model.s).astype(np.int64) + model.w21
        stop = (stops[t - first] * model.s).astype(np.int64) + model.w21
        hit2, hit1 = x == model.p2, x == model.p1
        k = np.flatnonzero(hit1)
        start[k], stop[k] = model.w2[k], model.w21[k]
        k = np.flatnonzero(hit2)
        start[k], stop[k] = 0, model.w2[k]
        go = _narrowed(low, span, start, stop)
        units[go, at[go]] = _shift(low, span, go)
        at[go] += 1
        model.learn(x, hit2, hit1)
    units[np.arange(lanes), at] = (low + (LEAST - U(1))) >> UNIT
    at += 1
    body = at.astype("<u4").tobytes() + units[np.arange(units.shape[1])[None, :] < at[:, None]].astype("<u4").tobytes()
    return HEAD.pack(MAGIC, n, vocab, lanes, check, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; raises Corrupt unless both checksums hold."""
    if len(block) < HEAD.size:
        raise Corrupt("the block is cut short")
    magic, n, vocab, lanes, check, body_check = HEAD.unpack_from(block)
    body = block[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_check or not (0 < lanes <= LANES and n <= MOST):
        raise Corrupt("the block's bytes are damaged")
    steps = -(-n // lanes)
    size = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    # each lane's units and two zeros after them, side by side
    units = np.zeros((lanes, int(size.max()) + 2), U)
    units[np.arange(units.shape[1])[None, :] < size[:, None]] = np.frombuffer(body, "<u4", int(size.sum()), 4 * lanes)
    code, at = (units[:, 0] << UNIT) | units[:, 1], np.full(lanes, 2)
    model = Model(vocab, lanes, finds=True)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    out = np.zeros((steps, lanes), np.int64)
    top = U((1 << SCALE) - 1)
    for t in range(steps):
        model.predict()
        value = np.minimum((code - low) // (span >> U(SCALE)), top).view(np.int64)
        hit2, below = value < model.w2, value < model.w21
        k = np.flatnonzero(~below)
        w21, s = model.w21[k], model.s[k]
        other = value[k] - w21
        # the last id that starts at or before `other`; a double may be off by one place at a border
        y = model.id_at[np.minimum(np.ceil((other + 1) / s).astype(np.int64), len(model.id_at)) - 1].astype(np.int64)
        y0, y1 = (model.cdf[y] * s).astype(np.int64), (model.cdf[y + 1] * s).astype(np.int64)
        for off, turn in ((y0 > other, -1), (y1 <= other, 1)):
            if off.any():
                i = np.flatnonzero(off)
                y[i] = np.clip(y[i] + turn, 0, vocab - 1)
                y0[i], y1[i] = (model.cdf[y[i]] * s[i]).astype(np.int64), (model.cdf[y[i] + 1] * s[i]).astype(np.int64)
        x, start, stop = model.p1.copy(), model.w2.copy(), model.w21.copy()
        h = np.flatnonzero(hit2)
        x[h], start[h], stop[h] = model.p2[h], 0, model.w2[h]
        x[k], start[k], stop[k] = y, y0 + w21, y1 + w21
        go = _narrowed(low, span, start, stop)
        _shift(low, span, go)
        code[go] = (code[go] << UNIT) | units[go, np.minimum(at[go], units.shape[1] - 1)]
        at[go] += 1
        out[t] = x
        model.learn(x, hit2, x == model.p1)
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise Corrupt("the ids differ from those that were written")
    return ids
