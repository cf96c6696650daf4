"""Adaptive context-mixing range coder for token ids, many blocks side by side.

The distribution of an id is a mix of three predictions. The orders 2 and 1 each name the id that last followed the two ids (the one id)
before, with a confidence; order 0 spreads the rest over all ids. The weights of the mix adapt, in every block for itself, to how often
predictions of these confidences came true. Order 0 starts every block from the file's own counts, which stand in the header, rounded and
with a checksum; ids that are too rare to be listed there are an escape and their bits. Each decision drives a range coder that carries into the words it has written.

Every block starts from the same model and is checked by the CRC of its ids. Blocks are independent, so the steps of all
blocks are taken together on arrays: the encoder's and the decoder's cost are shared by hundreds of blocks.

File: magic, number of ids, ids per block, number of wide ids, bits of an id, length and CRC of the counts; the wide ids (only where an id needs more
than 24 bits; blocks hold places in this list then); the counts; for each block its number of words and its CRC; all words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR4"
BLOCK = 2048
_HEAD = "<QIIBII"
#: Blocks that are worked on together: bounds the memory for their models, about 13 KB each.
LANES = 4096
_U, _N = np.uint64, np.uint32
#: Frequencies of the mix add up to ``_ONE``.
_BITS = 12
_ONE = 1 << _BITS
#: Those of order 0 to two to this power.
_ORDER_0 = 20
#: An id is listed in the counts if it occurs so often: a listed one takes more than a byte.
_LISTED_FROM = 3
#: Slots of the tables of predictions by order, as powers of two.
_SLOTS = {1: 10, 2: 11}
_LOW = _U(0xFFFFFFFF)
_MOST = np.int32(_ONE - 32)


class _Counts:
    """Order 0: the listed ids, after an escape, with frequencies that add up to two to the power of ``_ORDER_0``."""

    def __init__(self, listed: np.ndarray, levels: np.ndarray) -> None:
        """``levels``: four times the binary logarithm of the counts, rounded; the escape's first."""
        self.listed, self.levels = listed, levels
        weight = np.floor(16 * 2.0 ** (levels / 4)).astype(np.int64)
        width = 1 + weight * ((1 << _ORDER_0) - len(weight)) // weight.sum()
        width[0] += (1 << _ORDER_0) - width.sum()
        self.width, self.begin = width.astype(_N), (np.cumsum(width) - width).astype(_N)
        self.ids = np.concatenate((np.zeros(1, _N), listed.astype(_N)))

    @classmethod
    def of(cls, ids: np.ndarray) -> _Counts:
        """Of ids below ``2 ** 24``. The most frequent ones are listed, half as many as there are frequencies at most; others are escapes."""
        n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        listed = np.flatnonzero(n >= _LISTED_FROM)
        most = 1 << _ORDER_0 - 1
        if len(listed) > most:
            listed = np.sort(listed[np.argsort(-n[listed], kind="stable")[:most]])
        n = np.concatenate(([len(ids) - n[listed].sum() + 1], n[listed]))
        return cls(listed.astype("<u4"), np.rint(4 * np.log2(n)).astype(np.uint8))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Each id's number in the list, counted from 1, or 0 for the escape."""
        to = np.zeros(1 + max(int(ids.max(initial=0)), int(self.listed.max(initial=0))), _N)  # a part of the file may lack the greatest listed id
        to[self.listed] = np.arange(1, len(self.listed) + 1)
        return to[ids]

    def stored(self) -> bytes:
        steps = np.diff(self.listed, prepend=np.zeros(1, "<u4")).astype("<u4")
        return zlib.compress(self.levels.tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 9)

    @classmethod
    def read(cls, data: bytes) -> _Counts:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        k = len(raw) // 5
        steps = np.ascontiguousarray(raw[k + 1 :].reshape(4, k).T).view("<u4").ravel()
        return cls(np.cumsum(steps, dtype=np.uint32), raw[: k + 1])

    def by_target(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.width), dtype=_N), self.width)


class _Model:
    """Predictions and weights of a number of blocks."""

    def __init__(self, lanes: int) -> None:
        at = np.arange(lanes)
        self.tables = {k: np.zeros(lanes << b, _N) for k, b in _SLOTS.items()}
        self.bases = {k: at << b for k, b in _SLOTS.items()}
        # Weights of order 2 by the confidences of both and whether they agree; of order 1 by its own and whether order 2 has one.
        self.two = np.tile(np.repeat(np.array([75, 1100, 1750, 2250, 2750, 3000, 3250, 3500], np.int32), 8), lanes)
        self.one = np.tile(np.repeat(np.array([75, 600, 1100, 1500, 1900, 2100, 2400, 2600], np.int32), 2), lanes)
        self.by64, self.by16 = at << 6, at << 4

    def predict(self, n: int, before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the events "order 2 is right" and "order 1 is right" out of ``_ONE``."""
        one = before[:n] * _N(0x9E3779B1)
        two = (one ^ earlier[:n] * _N(0x85EBCA6B)) * _N(0xC2B2AE35)
        self.slot1 = self.bases[1][:n] + (one >> _N(32 - _SLOTS[1]))
        self.slot2 = self.bases[2][:n] + (two >> _N(32 - _SLOTS[2]))
        self.e1, self.e2 = self.tables[1].take(self.slot1), self.tables[2].take(self.slot2)
        self.c1, self.c2 = self.e1 & _N(7), self.e2 & _N(7)
        self.q1, self.q2 = self.e1 >> _N(8), self.e2 >> _N(8)
        self.agree = self.q1 == self.q2
        self.by2 = self.by64[:n] + (self.c2 << _N(3) | np.minimum(self.c1, _N(3)) << _N(1) | self.agree)
        self.by1 = self.by16[:n] + (self.c1 << _N(1) | (self.c2 > 0))
        self.w2, self.w1 = self.two.take(self.by2), self.one.take(self.by1)
        second = self.w2 + 1 + ((_ONE - 2 - self.w2) * self.w1 >> _BITS)
        np.copyto(second, self.w2, where=self.agree)
        return self.w2, second

    def learn(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        """``two``, ``one``: the prediction of this order was right."""
        self.two[self.by2] = self.w2 + (_goal(two) - self.w2 >> 5)
        asked = np.flatnonzero(~(two | self.agree))
        w = self.w1[asked]
        self.one[self.by1[asked]] = w + (_goal(one[asked]) - w >> 5)
        self.tables[2][self.slot2] = _followed(ids, self.e2, self.c2, two)
        self.tables[1][self.slot1] = _followed(ids, self.e1, self.c1, one)


def _goal(right: np.ndarray) -> np.ndarray:
    """What a weight moves to."""
    return right * (_MOST - np.int32(8)) + np.int32(8)


def _followed(ids: np.ndarray, entry: np.ndarray, confidence: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The new entry: a right prediction grows, a wrong one loses half its confidence or, without one, its place."""
    out = entry + (right & (confidence < 7))
    wrong = np.flatnonzero(~right)
    lost, known = confidence[wrong], entry[wrong]
    out[wrong] = np.where(lost > 1, known - (lost + _N(1) >> _N(1)), ids[wrong] << _N(8) | _N(1))
    return out


class _Writer:
    """Range coders of a number of blocks."""

    def __init__(self, lanes: int) -> None:
        self.low, self.size = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.cap = 256
        self.words, self.used = np.zeros(lanes * self.cap, _N), np.arange(lanes) * self.cap
        self.lanes = np.arange(lanes)

    def put(self, lanes: np.ndarray, low: np.ndarray, size: np.ndarray, begin: np.ndarray, width: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks' states after an event; ``low, size`` are those before it."""
        part, before = size >> _U(bits), low
        low, size = part * begin, part * width
        low += before
        carry = lanes[low < before]
        back = 1
        while len(carry):
            at = self.used[carry] - back
            self.words[at] += _N(1)
            carry, back = carry[self.words[at] == 0], back + 1
        full = np.flatnonzero(size <= _LOW)
        if len(full):
            lane = lanes[full]
            at = self.used[lane]
            self.words[at] = low[full] >> _U(32)
            self.used[lane] = at + 1
            low[full] <<= _U(32)
            size[full] <<= _U(32)
        return low, size

    def room(self) -> None:
        """Doubles the room for words where it may run out."""
        if int((self.used - self.lanes * self.cap).max(initial=0)) + 8 > self.cap:
            self.words = np.concatenate((self.words.reshape(-1, self.cap), np.zeros((len(self.lanes), self.cap), _N)), axis=1).ravel()
            self.used += self.lanes * self.cap
            self.cap *= 2

    def close(self) -> tuple[list[bytes], list[int]]:
        begins = self.lanes * self.cap
        tail = np.stack(((self.low >> _U(32)).astype("<u4"), (self.low & _LOW).astype("<u4")), axis=1)
        return [self.words[a:b].astype("<u4").tobytes() + t.tobytes() for a, b, t in zip(begins.tolist(), self.used.tolist(), tail, strict=True)], (self.used - begins + 2).tolist()


def _shape(n: int, block: int) -> tuple[int, int]:
    """Number of blocks, and length of the last."""
    lanes = -(-n // block)
    return lanes, n - block * (lanes - 1) if lanes else 0


def _encode_lanes(ids: np.ndarray, counts: _Counts, bits: int, block: int) -> tuple[list[bytes], list[int]]:
    lanes, last = _shape(len(ids), block)
    table = np.zeros((lanes, block), _N)
    table.ravel()[: len(ids)] = ids
    table = np.ascontiguousarray(table.T)
    places = counts.places(table)
    model, out, zero = _Model(lanes), _Writer(lanes), np.zeros(lanes, _N)
    for t in range(min(block, len(ids))):
        if not t & 7:
            out.room()
        n = lanes if t < last else lanes - 1
        value = table[t, :n]
        first, second = model.predict(n, table[t - 1] if t else zero, table[t - 2] if t > 1 else zero)
        two, one = value == model.q2, value == model.q1
        begin = np.where(one, first, second)
        begin *= ~two
        width = np.where(two, first, np.where(one, second, _ONE)) - begin
        out.low[:n], out.size[:n] = out.put(out.lanes[:n], out.low[:n], out.size[:n], begin.view(_N), width.view(_N), _BITS)
        model.learn(value, two, one)
        rest = np.flatnonzero(~(two | one))
        if not len(rest):
            continue
        place = places[t].take(rest)
        low, size = out.put(rest, out.low[rest], out.size[rest], counts.begin.take(place), counts.width.take(place), _ORDER_0)
        escape = np.flatnonzero(place == 0)
        if len(escape):
            lane = rest[escape]
            low[escape], size[escape] = out.put(lane, low[escape], size[escape], value[lane], np.ones(len(lane), _N), bits)
        out.low[rest], out.size[rest] = low, size
    return out.close()


class _Reader:
    """What is left of the code of a number of blocks."""

    def __init__(self, words: np.ndarray, begins: np.ndarray) -> None:
        self.words, self.at = np.concatenate((words, np.zeros(2, words.dtype))), begins + 2
        self.code = (self.words[begins].astype(_U) << _U(32)) | self.words[begins + 1]
        self.size = np.full(len(begins), 0xFFFFFFFFFFFFFFFF, _U)
        self.lanes = np.arange(len(begins))

    def take(self, lanes: np.ndarray, part: np.ndarray, code: np.ndarray, begin: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks' states after an event."""
        code, size = code - part * begin, part * width
        full = np.flatnonzero(size <= _LOW)
        if len(full):
            lane = lanes[full]
            at = self.at[lane]
            code[full] = (code[full] << _U(32)) | self.words.take(at, mode="clip")
            size[full] <<= _U(32)
            self.at[lane] = at + 1
        return code, size


def _decode_lanes(words: np.ndarray, begins: np.ndarray, n_ids: int, counts: _Counts, bits: int, block: int) -> np.ndarray:
    lanes, last = _shape(n_ids, block)
    table = np.zeros((block, lanes), _N)
    model, read, zero = _Model(lanes), _Reader(words, begins), np.zeros(lanes, _N)
    by_target = counts.by_target()
    for t in range(min(block, n_ids)):
        n = lanes if t < last else lanes - 1
        first, second = model.predict(n, table[t - 1] if t else zero, table[t - 2] if t > 1 else zero)
        part, code = read.size[:n] >> _U(_BITS), read.code[:n]
        two, other = code < part * first.view(_N), code >= part * second.view(_N)
        begin = np.where(other, second, first)
        begin *= ~two
        width = np.where(two, first, np.where(other, _ONE, second)) - begin
        read.code[:n], read.size[:n] = read.take(read.lanes[:n], part, code, begin.view(_N), width.view(_N))
        value = np.where(two, model.q2, model.q1)
        rest = np.flatnonzero(other)
        if len(rest):
            part, code = read.size[rest] >> _U(_ORDER_0), read.code[rest]
            place = by_target.take((code // part).astype(np.int64), mode="clip")
            code, size = read.take(rest, part, code, counts.begin.take(place), counts.width.take(place))
            ids = counts.ids.take(place)
            escape = np.flatnonzero(place == 0)
            if len(escape):
                part = size[escape] >> _U(bits)
                ids[escape] = code[escape] // part
                code[escape], size[escape] = read.take(rest[escape], part, code[escape], ids[escape], np.ones(len(escape), _N))
            read.code[rest], read.size[rest] = code, size
            value[rest] = ids
        model.learn(value, two, value == model.q1)
        table[t, :n] = value
    return table.T.ravel()[:n_ids] if last == block else np.concatenate((table[:, :-1].T.ravel(), table[:last, -1]))


def compress(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of a run of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    sums = [zlib.crc32(ids[i : i + block].tobytes()) for i in range(0, len(ids), block)]
    n, listed = len(ids), np.zeros(0, "<u4")
    if n and ids.max() >= 1 << 24:
        listed, ids = np.unique(ids, return_inverse=True)
    bits = int(ids.max(initial=0)).bit_length()
    if bits > 24:
        raise ValueError("a file holds at most 2 ** 24 different ids of more than 24 bits")
    counts = _Counts.of(ids)
    table = counts.stored()
    wave = LANES * block
    parts, used = [], []
    for i in range(0, n, wave):
        data, words = _encode_lanes(ids[i : i + wave].astype(np.uint32), counts, bits, block)
        parts += data
        used += words
    head = MAGIC + struct.pack(_HEAD, n, block, len(listed), bits, len(table), zlib.crc32(table))
    return head + listed.astype("<u4").tobytes() + table + np.array(used, "<u4").tobytes() + np.array(sums, "<u4").tobytes() + b"".join(parts)


def decompress(data: bytes) -> np.ndarray:
    """The ids of a file; raises ``ValueError`` if a block's checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of range-coded ids")
    n, block, n_listed, bits, n_table, table_crc = struct.unpack_from(_HEAD, data, 4)
    at, blocks = 4 + struct.calcsize(_HEAD), -(-n // block)
    listed, at = np.frombuffer(data, "<u4", n_listed, at), at + 4 * n_listed
    table, at = data[at : at + n_table], at + n_table
    if zlib.crc32(table) != table_crc:
        raise ValueError("the counts are damaged")
    order_0 = _Counts.read(table)
    counts, sums = np.frombuffer(data, "<u4", blocks, at).astype(np.int64), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    words = np.frombuffer(data, "<u4", -1, at + 8 * blocks)
    if counts.sum() != len(words) or (counts < 2).any():
        raise ValueError("the lengths of blocks are damaged")
    begins, out = np.concatenate(([0], np.cumsum(counts))), [np.zeros(0, np.uint32)]
    for i in range(0, blocks, LANES):
        k = min(i + LANES, blocks)
        out.append(_decode_lanes(words[begins[i] : begins[k]], begins[i:k] - begins[i], min(n - i * block, (k - i) * block), order_0, bits, block))
    ids = np.concatenate(out)
    if n_listed:
        if len(ids) and ids.max() >= n_listed:
            raise ValueError("an id is not listed")
        ids = listed[ids]
    for i, s in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {i} is damaged")
    return ids
