"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that stand alone. Many blocks are coded side by side, one numpy lane each, so that the steps of a
block, which must follow one another, cost little. In each step the ids last seen after the same two ids (order 2)
and after the same id (order 1) make a prediction. How often such predictions came true lately, and the share of the predicted id
in the counts of all ids so far (order 0), are mixed, by weights that learn, to the probability of a hit. The rest of the interval
belongs to the order-0 counts of single ids: a tree of three levels of RADIX ways that is updated after each id. All arithmetic is on integers.

Block: magic, number of ids, CRC-32 of the ids as little-endian unsigned 32-bit integers, bytes that follow; then the code.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from grainmill.llm.common import travels

travels(__name__)

MAGIC = b"GMR2"
HEADER, HEADER_SIZE = "<4sIII", 16
#: Ids in a block, ids of the alphabet.
BLOCK, ALPHABET = 4096, 49408
#: Ways of each level of the count tree; what an id adds to its counts, the sum at which a node's counts are halved, and
#: their floor, by level from the root. So no id has less than 2**-28 of the rest.
RADIX = 37
GAINS, LIMITS, FLOORS = (24, 16, 8), (4096, 2048, 512), (8, 2, 1)
SLOTS2, SLOTS1 = 2048, 1024
TOTAL_BITS = 36
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
#: Most of 4096 that a prediction gets.
SUREST = 4064


def _priors() -> list[np.ndarray]:
    """Counts before any id is seen, for each node of each level: small ids are likelier, since vocabularies list frequent tokens
    first; numbers beyond the alphabet have none."""
    ids = np.arange(RADIX**3)
    likely = np.where(ids < ALPHABET, 1 + 4000 // (ids + 60), 0).reshape(RADIX, RADIX, RADIX)
    top = likely.sum(axis=(1, 2))
    middle = likely.sum(axis=2)
    return [
        np.where(top > 0, np.maximum(top * 1500 // top.sum(), FLOORS[0]), 0).reshape(1, RADIX),
        np.where(middle > 0, np.maximum(middle * 500 // np.maximum(middle.sum(axis=1, keepdims=True), 1), FLOORS[1]), 0),
        np.where(likely > 0, np.maximum(likely * 60 // np.maximum(likely.sum(axis=2, keepdims=True), 1), FLOORS[2]), 0).reshape(-1, RADIX),
    ]


PRIORS = _priors()
#: Nodes of each level. For each level, the node on the way to a number and the place in it: the number's digits in base RADIX.
NODES = (1, RADIX, RADIX**2)
_NUMBERS = np.arange(RADIX**3)
NODE = np.stack([0 * _NUMBERS, _NUMBERS // RADIX**2, _NUMBERS // RADIX])
PLACE = np.stack([_NUMBERS // RADIX**2, _NUMBERS // RADIX % RADIX, _NUMBERS % RADIX])
#: A node is a row of its counts and their sum.
ROW = RADIX + 1
CELL = np.concatenate([NODE * ROW + PLACE, NODE * ROW + RADIX])
GAIN, LIMIT, FLOOR = (np.array(x, dtype=np.uint16)[:, None] for x in (GAINS * 2, LIMITS, FLOORS))
#: A row times this: the counts up to each place. Row p of the other: the places before p.
UPTO = np.triu(np.ones((ROW, RADIX), dtype=np.float32))
BEFORE = np.ascontiguousarray(np.tril(np.ones((RADIX, ROW), dtype=np.float32), -1))

SQUASH = np.array([min(max(round(4096 / (1 + math.exp(-(x - 2048) / 256))), 16), SUREST) for x in range(4096)], dtype=np.int64)
STRETCH = np.array([min(max(round(256 * math.log((p + 0.5) / (4096 - p - 0.5))), -2047), 2047) for p in range(4096)], dtype=np.int64)
#: Hit rates of a lane: by how sure order 2 is, order 1 is, and both with whether they agree.
RATES = 4 + 4 + 32


class Model:
    """Predictions for the next id of every lane. The lanes that still run come first. Orders, levels and inputs of the mixer are the
    first axis of what is looked up and updated, so that each step takes few calls."""

    def __init__(self, lanes: int) -> None:
        self.one = np.zeros(lanes, dtype=np.int64)
        self.two = np.zeros(lanes, dtype=np.int64)
        # The ids last seen after the same two ids, then after the same one, times four, and how sure that is.
        self.last = np.zeros(lanes * (SLOTS2 + SLOTS1), dtype=np.int32)
        self.rates = np.full(lanes * RATES, 1 << 14, dtype=np.int64)  # 16 bits each
        self.weights = np.repeat(np.array([[26000], [26000], [26000], [4000]], dtype=np.int64), lanes, axis=1)
        # The nodes of the first level of all lanes, one lane after another, then those of the next; counts of a node follow one another.
        self.counts = np.concatenate([np.tile(np.column_stack([p, p.sum(axis=1)]).astype(np.uint16), (lanes, 1)) for p in PRIORS])
        self.flat = self.counts.reshape(-1)
        number = np.arange(lanes, dtype=np.int64)
        self.slots = np.stack([number * (SLOTS2 + SLOTS1), number * (SLOTS2 + SLOTS1) + SLOTS2])
        self.kinds = np.stack([number * RATES, number * RATES + 4, number * RATES + 8])
        self.node = np.stack([lanes * sum(NODES[:level]) + number * nodes for level, nodes in enumerate(NODES)])
        self.cell = np.concatenate([self.node * ROW] * 2)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id of the first n lanes and the part of 2**TOTAL_BITS that it gets."""
        one = self.one[:n] * 40503
        self.at = self.slots[:, :n] + np.stack([(one + self.two[:n] * 60493 >> 7) & (SLOTS2 - 1), (one >> 5) & (SLOTS1 - 1)])
        last = self.last.take(self.at)
        self.guesses, self.now = last >> 2, last & 3
        sure2, sure1 = self.now
        self.guess = np.where(sure2 > 0, *self.guesses).astype(np.int64)
        agreed = self.guesses[0] == self.guesses[1]
        self.context = self.kinds[:, :n] + np.stack([sure2, sure1, sure2 * 8 + sure1 * 2 + agreed])
        # The share of the guess in the counts: below 2**27 over the product of three sums.
        found = self.flat.take(CELL.take(self.guess, axis=1) + self.cell[:, :n]).astype(np.int64)
        share = (found[0] * found[1] * found[2] << 16) // (found[3] * found[4] * found[5])
        self.old = self.rates.take(self.context)
        self.stretched = STRETCH.take(np.concatenate([self.old >> 4, np.minimum(share >> 4, 4095)[None]]))
        dot = (self.weights[:, :n] * self.stretched).sum(axis=0) >> 16
        self.chance = SQUASH.take(np.minimum(np.maximum(dot + 2048, 0), 4095))
        return self.guess, self.chance << (TOTAL_BITS - 12)

    def interval(self, ids: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width in 2**TOTAL_BITS of what stands for the ids."""
        start, width = np.zeros(len(ids), dtype=np.int64), share.copy()
        missed = np.flatnonzero(ids != self.guess)
        sought = ids[missed]
        rows = self.counts.take(NODE.take(sought, axis=1) + self.node.take(missed, axis=1), axis=0)
        own = self.flat.take(CELL.take(sought, axis=1) + self.cell.take(missed, axis=1)).astype(np.int64)
        before = np.einsum("lik,lik->li", rows.astype(np.float32), BEFORE.take(PLACE.take(sought, axis=1), axis=0)).astype(np.int64)
        low, size = share[missed], (1 << TOTAL_BITS) - share[missed]
        for first, count, total in zip(before, own[:3], own[3:], strict=True):
            begin = size * first // total
            low, size = low + begin, size * (first + count) // total - begin
        start[missed], width[missed] = low, size
        return start, width

    def find(self, value: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the values, start and width of these."""
        ids, start, width = self.guess.copy(), np.zeros(len(value), dtype=np.int64), share.copy()
        missed = np.flatnonzero(value >= share)
        left, size, found = value[missed] - share[missed], (1 << TOTAL_BITS) - share[missed], np.zeros(len(missed), dtype=np.int64)
        row = np.arange(len(missed)) * RADIX
        for nodes in self.node:
            node = nodes.take(missed) + found
            rows = self.counts.take(node, axis=0)
            upto, total = rows.astype(np.float32) @ UPTO, np.maximum(rows[:, RADIX], 1).astype(np.int64)
            sought = ((left + 1) * total - 1) // np.maximum(size, 1)
            passed = (upto <= sought.astype(np.float32)[:, None]).view(np.int8)
            place = np.minimum(np.einsum("ik->i", passed).astype(np.int64), RADIX - 1)
            after = upto.take(row + place).astype(np.int64)
            begin = size * (after - self.flat.take(node * ROW + place)) // total
            left, size = left - begin, size * after // total - begin
            found = found * RADIX + place
        ids[missed], start[missed], width[missed] = np.minimum(found, ALPHABET - 1), value[missed] - left, size
        return ids, start, width

    def update(self, ids: np.ndarray) -> None:
        n = len(ids)
        hit = ids == self.guess
        error = ((hit.astype(np.int64) << 12) - self.chance) * 7
        self.weights[:, :n] += (self.stretched * error + 0x8000) >> 16
        self.rates[self.context] = np.minimum(self.old + (((hit.astype(np.int64) << 16) - self.old) >> 5), 65535)
        right, firm = ids == self.guesses, self.now > 1
        sure = np.where(right, np.minimum(self.now + 1, 3), np.where(firm, self.now - 1, 1))
        self.last[self.at] = np.where(right | firm, self.guesses, ids) * 4 + sure
        cell = CELL.take(ids, axis=1) + self.cell[:, :n]
        new = self.flat.take(cell) + GAIN
        self.flat[cell] = new
        over = new[3:] > LIMIT
        if over.any():
            full = cell[3:][over] // ROW
            halved = self.counts.take(full, axis=0)[:, :RADIX]
            halved = np.where(halved > 0, np.maximum(halved >> 1, np.broadcast_to(FLOOR, over.shape)[over][:, None]), 0)
            self.counts[full] = np.column_stack([halved, halved.sum(axis=1)])
        self.two[:n] = self.one[:n]
        self.one[:n] = ids


def _active(lengths: np.ndarray) -> np.ndarray:
    """For each step, how many lanes run; lanes come longest first."""
    steps = int(lengths.max(initial=0))
    return len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids below ALPHABET as bytes."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    if lengths[0] > BLOCK or max((int(b.max(initial=0)) for b in blocks), default=0) >= ALPHABET:
        raise ValueError(f"a block has at most {BLOCK} ids, all below {ALPHABET}")
    lanes = len(blocks)
    table = np.zeros((int(lengths[0]), lanes), dtype=np.uint16)
    for lane, i in enumerate(order):
        table[: lengths[lane], lane] = blocks[i]
    model = Model(lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    out, used = np.zeros((lanes, 3 * max(int(lengths[0]), 1) + 8), dtype="<u2"), np.zeros(lanes, dtype=np.int64)
    for step, n in enumerate(_active(lengths)):
        ids = table[step, :n].astype(np.int64)
        _, share = model.predict(n)
        start, size = model.interval(ids, share)
        unit = width[:n] >> np.uint64(TOTAL_BITS)
        low[:n] += unit * start.astype(np.uint64)
        width[:n] = unit * size.astype(np.uint64)
        model.update(ids)
        lanes_left = np.arange(n)
        while True:
            a, w = low[lanes_left], width[lanes_left]
            settled = (a ^ (a + w)) < TOP
            ready = settled | (w < BOTTOM)
            if not ready.any():
                break
            lanes_left, a, w, settled = lanes_left[ready], a[ready], w[ready], settled[ready]
            w = np.where(settled, w, (np.uint64(0) - a) & (BOTTOM - np.uint64(1)))
            out[lanes_left, used[lanes_left]] = a >> np.uint64(48)
            used[lanes_left] += 1
            low[lanes_left] = a << np.uint64(16)
            width[lanes_left] = w << np.uint64(16)
    made: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        code = np.append(out[lane, : used[lane]], [low[lane] >> np.uint64(s) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)]).astype("<u2").tobytes()
        made[i] = struct.pack(HEADER, MAGIC, len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()), len(code)) + code
    return made


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is damaged raises ValueError."""
    heads = []
    for block in blocks:
        if len(block) < HEADER_SIZE:
            raise ValueError("a block is shorter than its header")
        magic, n, crc, size = struct.unpack_from(HEADER, block)
        if magic != MAGIC or size != len(block) - HEADER_SIZE or size < 8 or n > BLOCK:
            raise ValueError("not a whole block of token ids")
        heads.append((n, crc))
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    lanes = len(blocks)
    codes = [np.frombuffer(blocks[i], dtype="<u2", offset=HEADER_SIZE) for i in order]
    words = np.zeros((lanes, max(len(c) for c in codes) + 4), dtype="<u2")
    for lane, c in enumerate(codes):
        words[lane, : len(c)] = c
    ends = np.array([len(c) for c in codes])
    code = np.zeros(lanes, dtype=np.uint64)
    for k in range(4):
        code = code << np.uint64(16) | words[:, k].astype(np.uint64)
    used = np.full(lanes, 4)
    model, seen = Model(lanes), np.zeros((int(lengths[0]), lanes), dtype=np.uint16)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    for step, n in enumerate(_active(lengths)):
        _, share = model.predict(n)
        unit = width[:n] >> np.uint64(TOTAL_BITS)
        value = np.minimum((code[:n] - low[:n]) // unit, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        ids, start, size = model.find(value, share)
        low[:n] += unit * start.astype(np.uint64)
        width[:n] = unit * np.maximum(size, 1).astype(np.uint64)
        model.update(ids)
        seen[step, :n] = ids
        lanes_left = np.arange(n)
        while True:
            a, w = low[lanes_left], width[lanes_left]
            settled = (a ^ (a + w)) < TOP
            ready = settled | (w < BOTTOM)
            if not ready.any():
                break
            lanes_left, a, w, settled = lanes_left[ready], a[ready], w[ready], settled[ready]
            w = np.where(settled, w, (np.uint64(0) - a) & (BOTTOM - np.uint64(1)))
            here = np.minimum(used[lanes_left], ends[lanes_left])
            code[lanes_left] = code[lanes_left] << np.uint64(16) | words[lanes_left, here].astype(np.uint64)
            used[lanes_left] += 1
            low[lanes_left] = a << np.uint64(16)
            width[lanes_left] = w << np.uint64(16)
    found: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * lanes
    for lane, i in enumerate(order):
        n, crc = heads[i]
        ids = seen[:n, lane].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's ids do not match its checksum")
        found[i] = ids
    return found
