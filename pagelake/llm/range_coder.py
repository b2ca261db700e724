"""Adaptive context-mixing range coder for token ids, many independent blocks in step.

Each block of a frame starts from the same empty model. An id is coded by the
predictions of three orders: the id that last followed the two ids before it, the
id that last followed the one before it, and, for the rest, adaptive frequencies
of the id's high byte and the low byte that last came with it. How far each
prediction is believed comes from adaptive counters, those of the second order
mixed from two contexts; everything is integer arithmetic, so reading repeats
exactly what writing did. All blocks of a frame take the same step at once, as
numpy arrays.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 1024
#: Slots of a block's tables of successors.
SLOTS = 1024
#: Bits of the total of the high byte's frequencies.
TOTAL_BITS = 15
GAIN = 24
#: Steps at which the frequencies are counted anew.
RENEW_EARLY, RENEW_EVERY = (8, 24, 64, 128, 256), 256
MAX_HELD = 15
#: Bits of a decision's probability, and the share of an error by which a counter moves.
P_BITS, RATE = 12, 4
_ALL = 1 << P_BITS
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ZERO, _ONE = np.uint64(0), np.uint64(1)
_P_BITS, _TOTAL_BITS, _BYTE_BITS = np.uint64(P_BITS), np.uint64(TOTAL_BITS), np.uint64(8)


class Coder:
    """The interval of each block. 32-bit words are exchanged when they are settled."""

    def __init__(self, blocks: int):
        self.low = np.zeros(blocks, dtype=np.uint64)
        self.range = np.full(blocks, _FULL)

    def narrow(self, rows: np.ndarray | None, low: np.ndarray, size: np.ndarray) -> None:
        """Exchange what is settled of the new intervals of these blocks (None: the first ones), which are changed."""
        small = np.flatnonzero(size <= _MASK)
        if len(small):
            least, span = low.take(small), size.take(small)
            crosses = ((least ^ (least + span - _ONE)) >> _WORD) != 0
            span = np.where(crosses, (~least + _ONE) & _MASK, span)  # up to where the upper word would change
            self.exchange(small if rows is None else rows.take(small), least >> _WORD)
            low[small], size[small] = least << _WORD, span << _WORD

    def three(self, first: np.ndarray, second: np.ndarray, one: np.ndarray, two: np.ndarray, both: np.ndarray) -> None:
        """Intervals of the first blocks after a choice of three."""
        n = len(first)
        low = self.low[:n] + np.where(first, _ZERO, np.where(second, one, both))
        size = np.where(first, one, np.where(second, two, self.range[:n] - both))
        self.narrow(None, low, size)
        self.low[:n], self.range[:n] = low, size

    def exchange(self, rows: np.ndarray, word: np.ndarray) -> None:
        raise NotImplementedError


class Writer(Coder):
    """Arithmetic coding of all blocks."""

    def __init__(self, blocks: int, ids: int):
        super().__init__(blocks)
        # no id takes more than two words: 24 + 15 + 20 bits and what clamping loses
        self.words = np.zeros((blocks, 3 * ids + 4), dtype=np.uint32)
        self.at = np.zeros(blocks, dtype=np.int64)

    def exchange(self, rows: np.ndarray, word: np.ndarray) -> None:
        at = self.at.take(rows)
        self.words[rows, at] = word
        self.at[rows] = at + 1

    def choice(self, p: np.ndarray, q: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first, the second or neither of two; p is believed of the first, q of the second if it isn't the first."""
        size = self.range[: len(p)]
        one = (size >> _P_BITS) * p
        two = ((size - one) >> _P_BITS) * q
        self.three(*known, one, two, one + two)
        return known

    def symbol(self, rows: np.ndarray, limits: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A high byte, and the blocks' intervals after it, which ``byte`` takes."""
        place = rows * limits.shape[1] + known
        begin = limits.ravel().take(place)
        width = limits.ravel().take(place + 1) - begin
        step = self.range.take(rows) >> _TOTAL_BITS
        low, size = self.low.take(rows) + step * begin, step * width
        self.narrow(rows, low, size)
        return known, low, size

    def byte(self, rows: np.ndarray, low: np.ndarray, size: np.ndarray, guess: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A byte that is the guess with belief p, or else any."""
        one = (size >> _P_BITS) * p
        step = (size - one) >> _BYTE_BITS
        right = known == guess
        low, size = low + np.where(right, _ZERO, one + step * known.astype(np.uint64)), np.where(right, one, step)
        self.narrow(rows, low, size)
        self.low[rows], self.range[rows] = low, size
        return known

    def finish(self) -> list[np.ndarray]:
        rows = np.arange(len(self.low))
        self.exchange(rows, self.low >> _WORD)
        self.exchange(rows, self.low & _MASK)
        return [self.words[i, : n] for i, n in enumerate(self.at)]


class Reader(Coder):
    """The same decisions from the words of all blocks."""

    def __init__(self, words: list[np.ndarray]):
        super().__init__(len(words))
        width = max((len(w) for w in words), default=0) + 2
        self.words = np.zeros((len(words), width), dtype=np.uint32)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        self.code = self.words[:, 0].astype(np.uint64) << _WORD | self.words[:, 1]
        self.at = np.full(len(words), 2, dtype=np.int64)

    def exchange(self, rows: np.ndarray, word: np.ndarray) -> None:
        at = self.at.take(rows)
        # a damaged block may ask for more words than there are; its checksum tells
        self.code[rows] = self.code.take(rows) << _WORD | self.words[rows, np.minimum(at, self.words.shape[1] - 1)]
        self.at[rows] = at + 1

    def choice(self, p: np.ndarray, q: np.ndarray, known: None) -> tuple[np.ndarray, np.ndarray]:
        n = len(p)
        size = self.range[:n]
        one = (size >> _P_BITS) * p
        both = one + ((size - one) >> _P_BITS) * q
        value = self.code[:n] - self.low[:n]
        first = value < one
        second = ~first & (value < both)
        self.three(first, second, one, both - one, both)
        return first, second

    def symbol(self, rows: np.ndarray, limits: np.ndarray, known: None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, step = self.low.take(rows), self.range.take(rows) >> _TOTAL_BITS
        target = np.minimum((self.code.take(rows) - low) // step, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.uint16)
        flat, first = limits.ravel(), rows * limits.shape[1]
        place = first.copy()
        for jump in (128, 64, 32, 16, 8, 4, 2, 1):
            place += (flat.take(place + jump) <= target) * jump
        begin = flat.take(place)
        low, size = low + step * begin, step * (flat.take(place + 1) - begin)
        self.narrow(rows, low, size)
        return place - first, low, size

    def byte(self, rows: np.ndarray, low: np.ndarray, size: np.ndarray, guess: np.ndarray, p: np.ndarray, known: None) -> np.ndarray:
        one = (size >> _P_BITS) * p
        step = (size - one) >> _BYTE_BITS
        value = self.code.take(rows) - low
        right = value < one
        other = np.minimum((value - one) // step, np.uint64(255))  # the value is below one where the guess is right
        low, size = low + np.where(right, _ZERO, one + step * other), np.where(right, one, step)
        self.narrow(rows, low, size)
        self.low[rows], self.range[rows] = low, size
        return np.where(right, guess, other.astype(np.int32))


class Counters:
    """Beliefs of P_BITS bits by place, a block's context, that move towards what came."""

    def __init__(self, places: int):
        self.beliefs = np.full(places, _ALL // 2, dtype=np.int32)

    def learn(self, place: np.ndarray, belief: np.ndarray, came: np.ndarray) -> None:
        self.beliefs[place] = belief + ((came * np.int32(_ALL - 1) - belief) >> RATE)


def bounded(belief: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(belief, 16), _ALL - 16).astype(np.uint64)


_HELD_BITS = 4
#: Held count after a wrong guess, and then those after a right one.
_HELD = np.concatenate([
    np.where(np.arange(MAX_HELD + 1) < 2, 1, np.arange(MAX_HELD + 1) >> 1), np.minimum(np.arange(MAX_HELD + 1) + 1, MAX_HELD)
]).astype(np.int32)


class Successors:
    """The id that last came at a place, a block's context, and below it how often in a row it held."""

    def __init__(self, places: int):
        self.table = np.zeros(places, dtype=np.int32)

    def look(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.table.take(place)
        return both >> _HELD_BITS, both & MAX_HELD

    def learn(self, place: np.ndarray, guess: np.ndarray, held: np.ndarray, came: np.ndarray) -> None:
        right = guess == came
        self.table[place] = np.where(held > 1, guess, came) << _HELD_BITS | _HELD.take(held + right * np.int32(MAX_HELD + 1))


#: Contexts of a block's counters.
CONTEXTS = 2 * (MAX_HELD + 1)


class Model:
    def __init__(self, blocks: int):
        self.second, self.first, self.low_byte = Successors(blocks * SLOTS), Successors(blocks * SLOTS), Successors(blocks * 256)
        self.by_second, self.by_first = Counters(blocks * CONTEXTS), Counters(blocks * CONTEXTS)  # whether the second order is right
        self.is_first, self.is_low = Counters(blocks * CONTEXTS), Counters(blocks * CONTEXTS)
        self.slots, self.contexts = np.arange(blocks) * SLOTS, np.arange(blocks) * CONTEXTS  # where a block's places begin
        self.counts = np.ones((blocks, 256), dtype=np.int32)
        self.limits = np.zeros((blocks, 257), dtype=np.uint16)
        self.renew()

    def renew(self) -> None:
        """Frequencies of the high byte with a total of 2 ** TOTAL_BITS, each at least 1."""
        room = (1 << TOTAL_BITS) - 256
        share = self.counts * room // self.counts.sum(axis=1, dtype=np.int32)[:, None] + 1
        np.cumsum(share.astype(np.uint16), axis=1, dtype=np.uint16, out=self.limits[:, 1:])
        self.limits[:, 256] = 1 << TOTAL_BITS

    def step(self, coder: Coder, last: np.ndarray, before: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        """One id of each of the first blocks, as many as have a last id."""
        slots, contexts = self.slots[: len(last)], self.contexts[: len(last)]
        mixed = last * 40503  # of whose bits only low ones count
        place1, place2 = slots + ((mixed >> 3) & (SLOTS - 1)), slots + ((mixed + before * 50021 >> 4) & (SLOTS - 1))
        guess1, held1 = self.first.look(place1)
        guess2, held2 = self.second.look(place2)
        agree = guess1 == guess2
        twice1 = contexts + held1 * 2
        a, b, c = contexts + (held2 * 2 + agree), twice1 + agree, twice1 + (held2 > 0)
        belief_a, belief_b, belief_c = self.by_second.beliefs.take(a), self.by_first.beliefs.take(b), self.is_first.beliefs.take(c)
        q = bounded(belief_c)
        q[agree] = 0  # both orders guess the same
        is2, is1 = coder.choice(bounded((belief_a + belief_b) >> 1), q, None if known is None else (known == guess2, known == guess1))
        self.by_second.learn(a, belief_a, is2)
        self.by_first.learn(b, belief_b, is2)
        open_ = np.flatnonzero(~(is2 | agree))
        self.is_first.learn(c.take(open_), belief_c.take(open_), is1.take(open_))
        ids = np.where(is2, guess2, guess1)
        own = np.flatnonzero(~is2 & (agree | ~is1))
        if len(own):
            literal = None if known is None else known.take(own)
            high, low, size = coder.symbol(own, self.limits, None if literal is None else literal >> 8)
            place0 = own * 256 + high
            self.counts.ravel()[place0] += GAIN
            guess0, held0 = self.low_byte.look(place0)
            d = own * CONTEXTS + held0
            belief_d = self.is_low.beliefs.take(d)
            byte = coder.byte(own, low, size, guess0, bounded(belief_d), None if literal is None else literal & 255)
            self.is_low.learn(d, belief_d, byte == guess0)
            self.low_byte.learn(place0, guess0, held0, byte)
            ids[own] = high << 8 | byte
        self.first.learn(place1, guess1, held1, ids)
        self.second.learn(place2, guess2, held2, ids)
        return ids


def _run(coder, lengths: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Ids by step and block; no block is longer than the one before it."""
    blocks, longest = len(lengths), int(lengths.max(initial=0))
    model = Model(blocks)
    result = np.zeros((longest, blocks), dtype=np.uint16)
    last, before = np.zeros(blocks, dtype=np.int32), np.zeros(blocks, dtype=np.int32)
    for t in range(longest):
        if t in RENEW_EARLY or (t and t % RENEW_EVERY == 0):
            model.renew()
        n = int(np.searchsorted(-lengths, -t))  # blocks that are longer
        ids = model.step(coder, last[:n], before[:n], None if known is None else known[t, :n].astype(np.int32))
        result[t, :n] = ids
        last, before = ids, last
    return result


def write_blocks(ids: np.ndarray) -> list[tuple[bytes, int, int]]:
    """(bytes, number of ids, checksum of the ids) of each block of BLOCK_IDS ids below 65536."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65536")
    starts = np.arange(0, len(ids), BLOCK_IDS)
    lengths = np.minimum(len(ids) - starts, BLOCK_IDS)
    padded = np.zeros(len(starts) * BLOCK_IDS, dtype=np.uint16)
    padded[: len(ids)] = ids
    known = np.ascontiguousarray(padded.reshape(-1, BLOCK_IDS).T)
    coder = Writer(len(starts), int(lengths.max(initial=0)))
    _run(coder, lengths, known)
    found = []
    for i, words in enumerate(coder.finish()):
        own = ids[starts[i] : starts[i] + lengths[i]].astype("<u2")
        found.append((words.astype("<u4").tobytes(), int(lengths[i]), zlib.crc32(own.tobytes())))
    return found


def read_blocks(blocks: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The ids of blocks, one after the other; a wrong checksum is an error."""
    if not blocks:
        return np.zeros(0, dtype=np.uint16)
    lengths = np.array([n for _, n, _ in blocks], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    result = _run(Reader([np.frombuffer(blocks[i][0], dtype="<u4") for i in order]), lengths[order], None)
    column = np.argsort(order)
    found = []
    for i, (_, n, checksum) in enumerate(blocks):
        own = result[:n, column[i]]
        if zlib.crc32(own.astype("<u2").tobytes()) != checksum:
            raise ValueError(f"block {i} is damaged: its checksum differs")
        found.append(own)
    return np.concatenate(found)
