"""Adaptive range coding of token ids, many blocks at a time.

A block codes each id as an event: it is the id that the order-2, the order-1 or the order-0
context predicts, or none of these. Three models give probabilities of the event, by the
confidence of the predictions and by the last event; they are mixed with weights that follow
how well each has predicted. An id that was not predicted is spelled in four digits of four
bits under adaptive order-0 frequencies. All state starts anew in each block, so blocks are
independent, and numpy works on the same place of all blocks at once. Only sums, products
and quotients of single numbers are used, so any machine decodes what another has encoded.
"""

from __future__ import annotations

import numpy as np

CONTEXTS = 2048  # of the order-1 and order-2 predictions of a block
TOP_CONFIDENCE = 3
TOTAL_BITS = 14
TOTAL = 1 << TOTAL_BITS
DIGITS = 4
# Rows of digit frequencies: for the first digit, after the first, after the first two, and
# after the second and third.
DIGIT_ROWS = (0, 1, 17, 273)
ALL_ROWS = 529
DIGIT_RATE = 4
EVENT_RATE = 1 / 16
SHARE = 0.02  # of the weight, spread evenly over the models at each step

_LOW_WORD = np.uint64(0xFFFFFFFF)
_RENORM = np.uint64(1 << 32)
_SIXTEEN = np.uint64(16)
_BITS = np.uint64(TOTAL_BITS)
_SHARE_OF_OTHERS = TOTAL - 512  # what mixed chances are scaled to; the rest keeps every event possible


class _Encoder:
    """48-bit range coder per block. Words keep their carries until the end."""

    def __init__(self, blocks: int, capacity: int):
        self.low = np.zeros(blocks, dtype=np.uint64)
        self.range = np.full(blocks, (1 << 48) - 1, dtype=np.uint64)
        self.words = np.zeros((blocks, capacity), dtype=np.uint32)
        self.at = np.zeros(blocks, dtype=np.int64)

    def put(self, b: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        unit = self.range[b] >> _BITS
        low, width = self.low[b] + unit * start.astype(np.uint64), unit * size.astype(np.uint64)
        out = np.flatnonzero(width < _RENORM)
        if len(out):
            which = out if isinstance(b, slice) else b[out]
            self.words[which, self.at[which]] = low[out] >> np.uint64(32)
            self.at[which] += 1
            low[out] = (low[out] & _LOW_WORD) << _SIXTEEN
            width[out] <<= _SIXTEEN
        self.low[b], self.range[b] = low, width

    def room(self, ids: int) -> None:
        """Makes room for the words that so many ids may bring."""
        if int(self.at.max()) + ids * (DIGITS + 1) + 3 > self.words.shape[1]:
            self.words = np.concatenate((self.words, np.zeros_like(self.words[:, : max(64, self.words.shape[1] // 2)])), axis=1)

    def payloads(self) -> list[bytes]:
        b = np.arange(len(self.low))
        self.room(1)
        for shift in (32, 16, 0):
            word = self.low >> np.uint64(shift)
            self.words[b, self.at] = word if shift == 32 else word & np.uint64(0xFFFF)
            self.at += 1
        for k in range(int(self.at.max()) - 1, 0, -1):
            self.words[:, k - 1] += self.words[:, k] >> 16
            self.words[:, k] &= 0xFFFF
        return [self.words[k, : self.at[k]].astype("<u2").tobytes() for k in range(len(b))]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        longest = max(len(p) for p in payloads) // 2
        self.words = np.zeros((len(payloads), longest + DIGITS + 8), dtype=np.uint64)
        for k, p in enumerate(payloads):
            self.words[k, : len(p) // 2] = np.frombuffer(p, dtype="<u2")
        self.code = (self.words[:, 0] << np.uint64(32)) | (self.words[:, 1] << _SIXTEEN) | self.words[:, 2]
        self.range = np.full(len(payloads), (1 << 48) - 1, dtype=np.uint64)
        self.at = np.full(len(payloads), 3, dtype=np.int64)

    def place(self, b: np.ndarray | slice) -> np.ndarray:
        """Where in TOTAL the next symbol lies."""
        self.unit = self.range[b] >> _BITS
        return np.minimum(self.code[b] // self.unit, np.uint64(TOTAL - 1)).astype(np.int32)

    def take(self, b: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        code, width = self.code[b] - self.unit * start.astype(np.uint64), self.unit * size.astype(np.uint64)
        short = np.flatnonzero(width < _RENORM)
        if len(short):
            which = short if isinstance(b, slice) else b[short]
            at = np.minimum(self.at[which], self.words.shape[1] - 1)
            code[short] = (code[short] << _SIXTEEN) | self.words[which, at]
            width[short] <<= _SIXTEEN
            self.at[which] += 1
        self.code[b], self.range[b] = code, width


def _digit_targets() -> np.ndarray:
    """Bounds that the frequencies of a row move to after each digit; 24 for every other digit."""
    digit, bound = np.arange(16)[:, None], np.arange(16)[None, :]
    return np.where(bound <= digit, bound * 24, TOTAL - (16 - bound) * 24).astype(np.int16)


class _Model:
    """State of all blocks. A prediction is kept as its id and, from bit 16 on, its confidence."""

    def __init__(self, blocks: int):
        self.held = [np.zeros(blocks * n, dtype=np.int32) for n in (1, CONTEXTS, CONTEXTS)]
        self.rows = np.tile(np.arange(16, dtype=np.int16) * (TOTAL // 16), (blocks * ALL_ROWS, 1))
        self.targets = _digit_targets()
        self.events = [np.full((blocks * n, 4), 0.25, dtype=np.float32) for n in (16, 32, 16)]
        self.weights = [np.full(blocks, 1 / 3, dtype=np.float32) for _ in range(3)]
        self.last = np.zeros((2, blocks), dtype=np.uint32)
        self.event = np.full(blocks, 3, dtype=np.int64)
        self.block = np.arange(blocks)
        self.context_of, self.row_of, self.four = self.block * CONTEXTS, self.block * 16, self.block * 4

    def predict(self, n: int) -> None:
        """Guesses of the three orders, and the bounds of the events, for the first n blocks."""
        one = self.last[0, :n] * np.uint32(0x9E3779B1)
        two = one + self.last[1, :n] * np.uint32(0x85EBCA77)
        base = self.context_of[:n]
        self.context = [self.block[:n], base + (one >> np.uint32(21)), base + (two >> np.uint32(21))]
        self.found = [np.take(h, c) for h, c in zip(self.held, self.context, strict=True)]
        self.guessed = [f & 0xFFFF for f in self.found]
        self.sure = [f >> 16 for f in self.found]
        zero, one, two = self.sure
        same = self.guessed[1] == self.guessed[2]
        row = self.row_of[:n]
        self.row = [row + (two * 4 + one), row * 2 + (one * 8 + zero * 2 + same), row + self.event[:n] * 4 + two]
        self.chances = [np.take(e, r, axis=0) for e, r in zip(self.events, self.row, strict=True)]
        w, p = [w[:n, None] for w in self.weights], self.chances
        mixed = (w[0] * p[0] + w[1] * p[1] + w[2] * p[2]) * np.float32(_SHARE_OF_OTHERS)
        self.bounds = np.zeros((n, 5), dtype=np.int32)
        self.bounds[:, 1:4] = np.cumsum(mixed[:, :3].astype(np.int32) + 1, axis=1)
        self.bounds[:, 4] = TOTAL

    def event_of(self, ids: np.ndarray) -> np.ndarray:
        zero, one, two = (g == ids for g in self.guessed)
        return np.where(two, 0, np.where(one, 1, np.where(zero, 2, 3)))

    def event_span(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = self.bounds.ravel(), self.four[: len(event)] + self.block[: len(event)] + event
        start = np.take(flat, at)
        return start, np.take(flat, at + 1) - start

    def learn(self, n: int, event: np.ndarray, ids: np.ndarray) -> None:
        at = self.four[:n] + event
        fit = [np.take(p.ravel(), at) + np.float32(1e-6) for p in self.chances]
        scaled = [w[:n] * f for w, f in zip(self.weights, fit, strict=True)]
        part = np.float32(1 - SHARE) / (scaled[0] + scaled[1] + scaled[2])
        for w, s in zip(self.weights, scaled, strict=True):
            w[:n] = s * part + np.float32(SHARE / 3)
        for e, r, p in zip(self.events, self.row, self.chances, strict=True):
            p *= np.float32(1 - EVENT_RATE)
            p.ravel()[at] += np.float32(EVENT_RATE)
            e[r] = p
        for held, c, f, g, sure in zip(self.held, self.context, self.found, self.guessed, self.sure, strict=True):
            held[c] = np.where(g == ids, f + ((sure < TOP_CONFIDENCE) << 16), np.where(sure > 0, f - 65536, ids))
        self.event[:n] = event
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids

    def digit_rows(self, b: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
        k = len(digits)
        context = 0 if not k else digits[0] if k == 1 else digits[-2] * 16 + digits[-1]
        self.digit_row = b * ALL_ROWS + (DIGIT_ROWS[k] + context)
        self.digit_bounds = np.take(self.rows, self.digit_row, axis=0)
        return self.digit_bounds

    def digit_span(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = self.digit_bounds.ravel(), self.block[: len(digit)] * 16 + digit
        start = np.take(flat, at).astype(np.int32)
        end = np.where(digit < 15, np.take(flat, at + 1, mode="clip"), TOTAL)
        return start, end - start

    def learn_digit(self, digit: np.ndarray) -> None:
        moved = np.take(self.targets, digit, axis=0)
        moved -= self.digit_bounds
        moved >>= DIGIT_RATE
        moved += self.digit_bounds
        self.rows[self.digit_row] = moved


def encode(ids: np.ndarray, block: int) -> list[bytes]:
    """Payload of each block of `block` ids, the last with the rest; ids below 65536."""
    blocks = -(-len(ids) // block)
    grid = np.zeros(blocks * block, dtype=np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    model, coder = _Model(blocks), _Encoder(blocks, block + block // 2 + 64)
    for t in range(min(block, len(ids))):
        n = blocks if (blocks - 1) * block + t < len(ids) else blocks - 1
        own = grid[t, :n]
        if t % 16 == 0:
            coder.room(16)
        model.predict(n)
        event = model.event_of(own)
        coder.put(slice(n), *model.event_span(event))
        spelled = np.flatnonzero(event == 3)
        if len(spelled):
            digits: list[np.ndarray] = []
            for k in range(DIGITS):
                model.digit_rows(spelled, digits)
                digit = (own[spelled] >> (12 - 4 * k)) & 15
                coder.put(spelled, *model.digit_span(digit))
                model.learn_digit(digit)
                digits.append(digit)
        model.learn(n, event, own)
    return coder.payloads()


def decode(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of blocks with these payloads and numbers of ids; all but the last block have
    the same number."""
    blocks, block = len(payloads), int(sizes[0]) if len(sizes) else 0
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    grid = np.zeros((block, blocks), dtype=np.uint32)
    model, coder = _Model(blocks), _Decoder(payloads)
    for t in range(block):
        n = blocks if t < sizes[-1] else blocks - 1
        model.predict(n)
        place = coder.place(slice(n))
        event = (place >= model.bounds[:, 1]).astype(np.int64) + (place >= model.bounds[:, 2]) + (place >= model.bounds[:, 3])
        coder.take(slice(n), *model.event_span(event))
        own = np.where(event == 0, model.guessed[2], np.where(event == 1, model.guessed[1], model.guessed[0]))
        spelled = np.flatnonzero(event == 3)
        if len(spelled):
            digits: list[np.ndarray] = []
            for _ in range(DIGITS):
                bounds = model.digit_rows(spelled, digits)
                digit = np.count_nonzero(bounds <= coder.place(spelled)[:, None].astype(np.int16), axis=1) - 1
                coder.take(spelled, *model.digit_span(digit))
                model.learn_digit(digit)
                digits.append(digit)
            own[spelled] = ((digits[0] * 16 + digits[1]) * 16 + digits[2]) * 16 + digits[3]
        model.learn(n, event, own)
        grid[t, :n] = own
    return grid.T.ravel()[: int(np.sum(sizes))]
