"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks. A block starts from a reset model, so it can be decoded
alone, and carries a checksum of its ids. Many blocks are coded side by side: every
step codes one id in each of them with array operations; a short last block is
filled up with zeros, which are coded and left out again.

Model. Three predictions are made for an id: the last id that followed the same
two ids (order 2), the last that followed the same one id (order 1), and the most
frequent id so far (order 0); id 0 where nothing is known. The coded symbol says which
prediction holds, the highest order first, or that none does. Each order has its own
counts of that symbol: order 2 and order 1 by how often their slot has been right lately,
order 0 for all. The distribution used is the mix of the three, with weights that follow
how well each has foretold the symbols so far. An id that nobody predicted is coded
by the number of bits above its lowest eight, from adaptive order-0 counts, and by the
bits below the highest one; the lowest eight are kept as they are, in a row of bytes
behind the coder's words. Tables predict from step to step; counts and weights are brought
up to date every ``ROUND`` steps. What is coded follows from integers and
from plain double operations in a fixed order, so that every machine decodes the same.

Coder. A range coder with 64-bit numbers that puts out 32-bit words; a carry is
added to the words already put out. Frequencies have fixed totals: 2 ** 15 for the
symbols, 2 ** 8 for the numbers of bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 4096
ROUND = 64
MAX_ID = (1 << 30) - 1
HIT2, HIT1, HIT0, MISS = range(4)
SLOTS = 1 << 9
COUNTED = 1 << 7  # slots that count how often ids came
SIZES = 10  # numbers of bits 0 to 8 above the lowest eight, and 9 for more
TOTAL = 1 << 15
SIZE_TOTAL = 1 << 8
SIZE_OF = np.array([i.bit_length() for i in range(257)], np.uint8)
TOP = np.array([0, *(1 << i for i in range(8)), 0], np.int32)  # the highest bit, by the size
BELOW = np.array([0, *range(8), 0], np.uint64)  # how many bits are below it
PIECE = np.uint64(11)  # larger ids: two pieces of so many bits follow
HASH = np.int32(-1640531527)
CONTEXTS = 16  # times right of order 2 (0 to 3) and of order 1 (0 to 3)
ROOM = np.uint64(1 << 32)
WORD = np.uint64(32)
SCALE = np.uint64(15)
FIELD_BITS = np.uint64(16)
SIZE_SCALE = np.uint64(8)
HALF = np.uint64((1 << 32) - 1)
FIELD = np.uint64(0xFFFF)
BELOW_TOTAL = np.uint64(TOTAL - 1)
IN_EACH = np.uint64(0x0001_0001_0001_0000)  # for the begins of the last three symbols
SPARE = np.uint64(0x8000_8000_8000_0000)  # the bit above each of them
ONE = np.uint64(1)


def _summed(values: np.ndarray, axis: int) -> np.ndarray:
    """Sum along an axis of four, always in the same order."""
    a, b, c, d = np.moveaxis(values, axis, 0)
    return a + b + c + d


def _slots(mixed: np.ndarray, base: np.ndarray) -> np.ndarray:
    return (mixed >> 13 & SLOTS - 1) + base


class _Model:
    """Predictions and statistics of ``lanes`` blocks."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.lane = np.arange(lanes)
        self.base = self.lane * SLOTS
        self.after2 = np.zeros(lanes * SLOTS, np.int32)  # id << 2 | times right; 0: nothing
        self.after1 = np.zeros(lanes * SLOTS, np.int32)
        self.seen = np.zeros(lanes * COUNTED, np.int32)
        self.newest = np.zeros(lanes * COUNTED, np.int32)
        self.frequent = np.zeros(lanes, np.int32)
        self.by2 = np.zeros((4, 4, lanes))  # symbol, order 2
        self.by1 = np.zeros((4, 4, lanes))
        self.by0 = np.zeros((4, lanes))
        self.trust = np.full((3, lanes), 0.5)
        self.sizes = np.full((SIZES, lanes), 2, np.int64)
        self.coded, self.symbols, self.sized = [], [], []
        self._distributions()

    def predict(self, slot2: np.ndarray, slot1: np.ndarray) -> None:
        """Predictions and symbol frequencies of all blocks."""
        self.slot2, self.slot1 = slot2, slot1
        kept2, kept1 = self.after2[slot2], self.after1[slot1]
        self.guess2, self.guess1 = kept2 >> 2, kept1 >> 2
        self.right2, self.right1 = kept2 & 3, kept1 & 3
        self.context = ((self.right2 << 2) + self.right1) * self.lanes + self.lane
        self.starts = self.packed[self.context]

    def update(self, ids: np.ndarray, symbol: np.ndarray, hit2, hit1) -> None:
        first = (ids << 2) + 1
        self.after2[self.slot2] = first + np.minimum(self.right2, 2) * hit2
        self.after1[self.slot1] = first + np.minimum(self.right1, 2) * hit1
        self.coded.append(self.context)
        self.symbols.append(symbol)

    def refresh(self, ids: np.ndarray) -> None:
        """Statistics of a round; ``ids``: a row per step, a column per block."""
        slot = (ids * HASH >> 13 & COUNTED - 1) + self.lane * COUNTED
        self.newest[slot.ravel()] = ids.ravel()  # of equal slots the last one stays
        self.seen += np.bincount(slot.ravel(), minlength=len(self.seen))
        most = self.seen.reshape(-1, COUNTED).argmax(axis=1)
        self.frequent = self.newest[most + self.lane * COUNTED]
        coded = np.concatenate(self.symbols) * np.int64(CONTEXTS * self.lanes)
        coded += np.concatenate(self.coded)
        new = np.bincount(coded, minlength=4 * CONTEXTS * self.lanes).reshape(4, 4, 4, -1)
        self._learn(_summed(new, 2), _summed(new, 1))
        if self.sized:
            sized = np.bincount(np.concatenate(self.sized), minlength=SIZES * self.lanes)
            self.sizes += sized.reshape(SIZES, -1)
        self.coded, self.symbols, self.sized = [], [], []
        self._distributions()

    def _learn(self, new2: np.ndarray, new1: np.ndarray) -> None:
        """An order's weight follows the probability that it gave to the round's symbols."""
        new0 = _summed(new1, 1)
        n = np.maximum(_summed(new0, 0), 1)
        for order, given in enumerate(
            (_summed(new2 * self.share2, 1), _summed(new1 * self.share1, 1), new0 * self.share0)
        ):
            self.trust[order] += (_summed(given, 0) / n - self.trust[order]) * 0.25
        self.by2 = np.floor((self.by2 + new2) * 0.875)
        self.by1 = np.floor((self.by1 + new1) * 0.875)
        self.by0 = np.floor((self.by0 + new0) * 0.875)

    def _distributions(self) -> None:
        """Where symbols begin, by context, packed as 16-bit fields behind a field for the first
        one's 0; and begin << 16 | width of the sizes. Sums, products and quotients of doubles
        are the same on every machine; frequencies are rounded down to integers."""
        self.share2, self.share1, self.share0 = (
            (p + 0.25) / (_summed(p, 0) + 1.0) for p in (self.by2, self.by1, self.by0)
        )
        weight = np.maximum(self.trust, 1 / 16) ** 2
        weight = weight * ((TOTAL - 128) / (weight[0] + weight[1] + weight[2]))
        ends2, ends1, ends0 = (
            np.cumsum(p[:3], axis=0) * w
            for p, w in zip((self.share2, self.share1, self.share0), weight)
        )
        ends1 += ends0[:, None]
        self.packed = np.zeros(CONTEXTS * self.lanes, np.uint64)
        for i in range(3):
            mix = ends2[i][:, None] + ends1[i]
            mix += 32 * (i + 1)
            self.packed |= mix.astype(np.uint64).ravel() << np.uint64(16 * (i + 1))
        total = self.sizes.sum(axis=0)
        share = self.sizes * (SIZE_TOTAL - SIZES) // total + 1
        share[1] += SIZE_TOTAL - share.sum(axis=0)
        self.size_share = share
        begins = np.cumsum(share, axis=0) - share
        self.size_bounds = (begins << 16 | share).ravel().astype(np.uint64)

    def size_table(self) -> np.ndarray:
        """The size at each of the ``SIZE_TOTAL`` places, block after block."""
        sizes = np.tile(np.arange(SIZES, dtype=np.uint8), self.lanes)
        return np.repeat(sizes, self.size_share.T.ravel())


def _bounds(starts: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of a symbol; the total, where the last one ends, is 0 in its field."""
    here = starts >> (symbol.astype(np.uint64) << np.uint64(4))
    return here & BELOW_TOTAL, (here >> FIELD_BITS) - here & BELOW_TOTAL


class _Writer:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        self.words = np.zeros((lanes, BLOCK // 4 + 64), np.uint64)
        self.at = np.zeros(lanes, np.int64)

    def put(self, starts, symbol, missed, begin, width, value, bits) -> None:
        """A symbol in each block; in the blocks ``missed`` also a size, by its ``begin`` and
        ``width``, and the ``bits`` below the highest one."""
        start, wide = _bounds(starts, symbol)
        part = self.range >> SCALE
        wide *= part
        moved = self.low + start * part
        part = wide >> SIZE_SCALE
        inner = part * width >> bits
        moved += (begin * part + value * inner) * missed
        wide = np.where(missed, inner, wide)
        carried = np.flatnonzero(moved < self.low)
        self.low, self.range = moved, wide
        self._settle(carried, np.flatnonzero(wide < ROOM))

    def put_plain(self, own: np.ndarray, value: np.ndarray) -> None:
        """A piece of plain bits in the blocks ``own``."""
        low = self.low[own]
        inner = self.range[own] >> PIECE
        moved = low + value * inner
        self.low[own], self.range[own] = moved, inner
        self._settle(own[moved < low], own[inner < ROOM])

    def _settle(self, carried: np.ndarray, small: np.ndarray) -> None:
        if len(carried):
            self.words[carried, self.at[carried] - 1] += ONE
        if len(small):
            low = self.low[small]
            self._emit(small, low >> WORD)
            self.low[small] = low << WORD
            self.range[small] <<= WORD

    def _emit(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.at[lanes]
        if at.max() + 1 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[lanes, at] = words
        self.at[lanes] = at + 1

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self._emit(every, self.low >> WORD)
        self._emit(every, self.low & HALF)
        self.words = self.words[:, : self.at.max()]
        while True:
            carry = self.words >> WORD
            if not carry.any():
                break
            self.words &= HALF
            self.words[:, :-1] += carry[:, 1:]
        plain = self.words.astype("<u4")
        return [plain[i, : self.at[i]].tobytes() for i in every]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        longest = max(len(p) // 4 for p in payloads) + 2
        self.words = np.zeros((len(payloads), longest), np.uint32)
        for i, payload in enumerate(payloads):
            self.words[i, : len(payload) // 4] = np.frombuffer(payload, "<u4")
        self.code = self.words[:, 0].astype(np.uint64) << WORD | self.words[:, 1]
        self.range = np.full(len(payloads), np.iinfo(np.uint64).max, np.uint64)
        self.at = np.full(len(payloads), 2, np.int64)

    def take(self, starts: np.ndarray) -> np.ndarray:
        """The symbols of all blocks, from packed frequencies; ``fill`` is to follow."""
        part = self.range >> SCALE
        place = np.minimum(self.code // part, BELOW_TOTAL)
        # A spare bit stays where the place is not before the symbol's begin.
        symbol = np.bitwise_count(place * IN_EACH + SPARE - starts & SPARE)
        start, wide = _bounds(starts, symbol)
        self.code -= start * part
        self.range = wide * part
        return symbol

    def size(self, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The sizes that would follow, from the ``table`` whose blocks begin at ``places``."""
        self.part = self.range >> SIZE_SCALE
        place = np.minimum(self.code // self.part, np.uint64(SIZE_TOTAL - 1))
        return table[places + place.astype(np.int64)]

    def take_some(self, missed: np.ndarray, bounds: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """In the blocks ``missed`` the bits below the highest one, after ``size``."""
        inner = self.part * (bounds & FIELD) >> bits
        code = self.code - (bounds >> FIELD_BITS) * self.part
        value = np.minimum(code // inner, (ONE << bits) - ONE)
        self.code = np.where(missed, code - value * inner, self.code)
        self.range = np.where(missed, inner, self.range)
        return value.astype(np.int32)

    def take_plain(self, own: np.ndarray) -> np.ndarray:
        inner = self.range[own] >> PIECE
        value = np.minimum(self.code[own] // inner, (ONE << PIECE) - ONE)
        self.code[own] -= value * inner
        self.range[own] = inner
        self.fill()
        return value.astype(np.int32)

    def fill(self) -> None:
        small = np.flatnonzero(self.range < ROOM)
        if len(small):
            at = self.at[small]
            word = self.words[small, np.minimum(at, self.words.shape[1] - 1)]
            self.code[small] = self.code[small] << WORD | word
            self.range[small] <<= WORD
            self.at[small] = at + 1


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(number of ids, checksum, payload) of every block of ``BLOCK`` ids."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) > MAX_ID:
        raise ValueError(f"token ids above {MAX_ID} can't be coded")
    made = []
    for start in range(0, len(ids), BLOCK * LANES):
        made += _encode_lanes(ids[start : start + BLOCK * LANES])
    return made


def _encode_lanes(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    lanes = -(-len(ids) // BLOCK)
    steps = min(len(ids), BLOCK)
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, out = _Model(lanes), _Writer(lanes)
    slot1, slot2, hash1 = model.base, model.base, np.zeros(lanes, np.int32)
    missed = np.zeros((steps, lanes), bool)
    for at in range(0, steps, ROUND):
        rows = columns[at : at + ROUND]
        mixed = rows * HASH  # wraps, as a hash may
        before = np.concatenate([hash1[None], mixed[:-1] * np.int32(5)])
        next1, next2 = _slots(mixed, model.base), _slots(mixed ^ before, model.base)
        high = rows >> 8
        size = SIZE_OF[np.minimum(high, 256)]
        below = ((high - TOP[size]) * (size < SIZES - 1)).astype(np.uint64)
        places = size * np.int64(lanes) + model.lane
        bounds = model.size_bounds[places]
        begin, width, bits = bounds >> FIELD_BITS, bounds & FIELD, BELOW[size]
        is_large = size == SIZES - 1
        some_large = is_large.any()
        for i, now in enumerate(rows):
            model.predict(slot2, slot1)
            hit2, hit1 = now == model.guess2, now == model.guess1
            symbol = _symbol(hit2, hit1, now == model.frequent)
            miss = np.equal(symbol, MISS, out=missed[at + i])
            out.put(model.starts, symbol, miss, begin[i], width[i], below[i], bits[i])
            if some_large:
                large = np.flatnonzero(is_large[i] & miss)
                whole = high[i][large].astype(np.uint64)
                out.put_plain(large, whole >> PIECE)
                out.put_plain(large, whole & (ONE << PIECE) - ONE)
            model.update(now, symbol, hit2, hit1)
            slot1, slot2 = next1[i], next2[i]
        model.sized.append(places[missed[at : at + ROUND]])
        hash1 = mixed[-1] * np.int32(5)
        model.refresh(rows)
    low_bytes = padded.astype(np.uint8).reshape(lanes, steps)
    lows = [row[which].tobytes() for row, which in zip(low_bytes, np.ascontiguousarray(missed.T))]
    made = []
    for i, (low, words) in enumerate(zip(lows, out.finish())):
        part = ids[i * BLOCK : (i + 1) * BLOCK]
        payload = struct.pack("<I", len(words)) + words + low
        made.append((len(part), zlib.crc32(part.tobytes()), payload))
    return made


def _symbol(hit2: np.ndarray, hit1: np.ndarray, hit0: np.ndarray) -> np.ndarray:
    after2 = ~hit2
    after1 = after2 & ~hit1
    return after2.view(np.uint8) + after1.view(np.uint8) + (after1 & ~hit0).view(np.uint8)


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks in order, of which only the last may be short; raises where a
    checksum does not agree."""
    made = []
    for start in range(0, len(blocks), LANES):
        made.append(_decode_lanes(blocks[start : start + LANES]))
    return np.concatenate(made) if made else np.empty(0, "<u4")


def _decode_lanes(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    lanes, steps = len(blocks), blocks[0][0]
    columns = np.zeros((steps, lanes), np.int32)
    words = [struct.unpack_from("<I", payload)[0] for _, _, payload in blocks]
    bodies = [payload[4 : 4 + n] for n, (_, _, payload) in zip(words, blocks)]
    tails = [payload[4 + n :] for n, (_, _, payload) in zip(words, blocks)]
    lows = np.frombuffer(b"".join(tails) + b"\0", np.uint8)
    low_at = np.cumsum([0] + [len(tail) for tail in tails[:-1]])
    model, source = _Model(lanes), _Reader(bodies)
    slot1, slot2, hash1 = model.base, model.base, np.zeros(lanes, np.int32)
    table, places = model.size_table(), model.lane * SIZE_TOTAL
    for step, now in enumerate(columns):
        model.predict(slot2, slot1)
        symbol = source.take(model.starts)
        hit2 = symbol == HIT2
        np.copyto(now, model.guess2, where=hit2)
        np.copyto(now, model.guess1, where=symbol == HIT1)
        np.copyto(now, model.frequent, where=symbol == HIT0)
        missed = symbol == MISS
        size = source.size(table, places)
        place = size * np.int64(lanes) + model.lane
        model.sized.append(place[missed])
        high = source.take_some(missed, model.size_bounds[place], BELOW[size]) + TOP[size]
        source.fill()
        large = np.flatnonzero((size == SIZES - 1) & missed)
        if len(large):
            first = source.take_plain(large)
            high[large] = first << np.int32(PIECE) | source.take_plain(large)
        np.copyto(now, high << 8 | lows[np.minimum(low_at, len(lows) - 1)], where=missed)
        low_at += missed
        model.update(now, symbol, hit2, now == model.guess1)
        mixed = now * HASH
        slot1, slot2 = _slots(mixed, model.base), _slots(mixed ^ hash1, model.base)
        hash1 = mixed * np.int32(5)
        if (step + 1) % ROUND == 0 or step + 1 == steps:
            model.refresh(columns[step // ROUND * ROUND : step + 1])
            table = model.size_table()
    whole = np.ascontiguousarray(columns.T).astype("<u4")
    ids = [row[:n] for row, (n, _, _) in zip(whole, blocks)]
    for own, (_, check, _) in zip(ids, blocks):
        if zlib.crc32(own.tobytes()) != check:
            raise ValueError("a block's checksum does not agree with its ids")
    return np.concatenate(ids)
