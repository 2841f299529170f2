"""Lossless WebP: a decoder of the whole format to pixel arrays, and an encoder that can write each of its features.

Pixels are (height, width, 4) arrays of 8-bit red, green, blue, alpha. Where only the green takes bits, as in grey images
after cross-colour, the symbol and the next place are looked up at every bit position at once, only the walk from symbol to
symbol is a loop, and each back-reference is one copy of a slice; with a colour cache pixels point to those that they repeat,
and all are followed at once; other images are decoded pixel by pixel. The transforms are inverted by blocks of rows; the
predictor's modes that need the pixel just to the left go pixel by pixel.
"""

from __future__ import annotations

import array
import functools
import itertools
import struct
import sys

import numpy as np

SIGNATURE, MOST_SIDE, MOST_BITS = 0x2F, 1 << 14, 15
LENGTHS, DISTANCES, CACHE_HASH = 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: the order of the code lengths' code lengths, and the places that short distances stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


NOTHING, LITTLE = 1 << 20, sys.byteorder == "little"
#: Images smaller than this are decoded pixel by pixel, which is then faster.
SMALL = 128


class BrokenImage(ValueError):
    """The bytes aren't a lossless WebP image."""


class Bits:
    """Bits of a byte string, least significant first; beyond its end zeros. Some hundred are held as a number."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.ahead, self.known, self.upto = data, 0, 0, at

    @property
    def at(self) -> int:
        return self.upto - self.known

    @at.setter
    def at(self, at: int) -> None:
        self.ahead, self.known, self.upto = 0, 0, at

    def fill(self) -> None:
        at = self.upto
        if at - self.known > 8 * len(self.data) + 64:
            raise BrokenImage("it ends early")
        self.ahead |= int.from_bytes(self.data[at >> 3 : (at >> 3) + 64], "little") >> (at & 7) << self.known
        self.known += 512 - (at & 7)
        self.upto = at + 512 - (at & 7)

    def read(self, n: int) -> int:
        if self.known < n:
            self.fill()
        value = self.ahead & ((1 << n) - 1)
        self.ahead >>= n
        self.known -= n
        return value


class Code:
    """A prefix code: by the next width bits the symbol and how many bits it takes."""

    def __init__(self, width: int, symbol: np.ndarray | list[int], bits: np.ndarray | list[int]):
        self.width, self.mask, self.own = width, (1 << width) - 1, (symbol, bits)
        self.used = int(max(symbol) if isinstance(symbol, list) else symbol.max())  # the largest symbol

    @functools.cached_property
    def symbol(self) -> list[int]:
        return self.own[0] if isinstance(self.own[0], list) else self.own[0].tolist()

    @functools.cached_property
    def bits(self) -> list[int]:
        return self.own[1] if isinstance(self.own[1], list) else self.own[1].tolist()

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(self.own[0], np.int32), np.asarray(self.own[1], np.int32)

    def read(self, source: Bits) -> int:
        if not self.width:
            return self.symbol[0]
        if source.known < MOST_BITS:
            source.fill()
        key = source.ahead & self.mask
        n = self.bits[key]
        source.ahead >>= n
        source.known -= n
        return self.symbol[key]


def code_of(lengths: list[int]) -> Code:
    return _code_of(bytes(lengths).rstrip(b"\0"))


@functools.lru_cache(maxsize=MOST_BITS + 1)
def _mirrored(width: int) -> np.ndarray:
    """Each number of so many bits with its bits in reverse."""
    out = np.zeros(1, np.intp)
    for _ in range(width):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


@functools.lru_cache(maxsize=512)
def _code_of(lengths: bytes) -> Code:
    if len(lengths) <= DISTANCES:
        return _small_code_of(lengths)
    sizes = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(sizes)
    if not len(used):
        raise BrokenImage("a prefix code without symbols")
    if len(used) == 1:
        return Code(0, used.astype(np.int32), np.zeros(1, np.int32))
    order = used[sizes[used].argsort(kind="stable")].astype(np.int32)
    bits = sizes[order].astype(np.int32)
    width = int(bits[-1])
    times = np.int32(1) << (width - bits)
    if int(times.sum()) != 1 << width:
        raise BrokenImage("a prefix code that isn't complete")
    mirror = _mirrored(width)  # in order of their codes the first bit is the highest; in the stream it is the lowest
    return Code(width, order.repeat(times)[mirror], bits.repeat(times)[mirror])


def _small_code_of(lengths: bytes) -> Code:
    """The same for few symbols, where lists are faster."""
    used = sorted([(n, s) for s, n in enumerate(lengths) if n])
    if not used:
        raise BrokenImage("a prefix code without symbols")
    if len(used) == 1:
        return Code(0, [used[0][1]], [0])
    width = used[-1][0]
    symbol, bits = [], []
    for n, s in used:
        symbol += [s] * (1 << (width - n))
        bits += [n] * (1 << (width - n))
    if len(symbol) != 1 << width:
        raise BrokenImage("a prefix code that isn't complete")
    mirror = _mirrored(width).tolist()
    return Code(width, [symbol[k] for k in mirror], [bits[k] for k in mirror])


def read_code(source: Bits, size: int) -> Code:
    lengths = [0] * size
    if source.read(1):
        two, wide = source.read(1), source.read(1)
        first = source.read(8 if wide else 1)
        symbols = [first, source.read(8)] if two else [first]
        if max(symbols) >= size:
            raise BrokenImage("a symbol beyond its alphabet")
        # Of two symbols the first has the bit 0, as they are sorted when codes are dealt out
        for s in symbols:
            lengths[s] = 1
        return code_of(lengths)
    own = [0] * len(LENGTH_ORDER)
    for k in range(4 + source.read(4)):
        own[LENGTH_ORDER[k]] = source.read(3)
    code = code_of(own)
    left = 2 + source.read(2 + 2 * source.read(3)) if source.read(1) else size
    s, last = 0, 8
    while s < size and left:
        left -= 1
        x = code.read(source)
        if x < 16:
            lengths[s] = x
            s, last = s + 1, x or last
            continue
        value, times = (last, 3 + source.read(2)) if x == 16 else (0, 3 + source.read(3)) if x == 17 else (0, 11 + source.read(7))
        if s + times > size:
            raise BrokenImage("more code lengths than symbols")
        lengths[s : s + times] = [value] * times
        s += times
    return code_of(lengths)


def _amount(source: Bits, prefix: int) -> int:
    """The value of a length's or distance's prefix and the extra bits after it."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + source.read(extra) + 1


def _blocks(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


def _cache_slot(colour: int, bits: int) -> int:
    return (CACHE_HASH * colour & 0xFFFFFFFF) >> (32 - bits)


def read_pixels(source: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The coded image as 32-bit alpha, red, green, blue."""
    cache_bits = source.read(4) if source.read(1) else 0
    if cache_bits > 11:
        raise BrokenImage("too large a colour cache")
    meta, tile, n_groups = None, 0, 1
    if main and source.read(1):
        tile = source.read(3) + 2
        meta = (read_pixels(source, _blocks(width, tile), _blocks(height, tile), False) >> 8) & 0xFFFF
        n_groups = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[read_code(source, n) for n in sizes] for _ in range(n_groups)]
    others = [x.symbol[0] for x in groups[0][1:4] if not x.width]  # colours that take no bits
    if n_groups == 1 and not cache_bits and len(others) == 3 and width * height >= SMALL:
        red, blue, alpha = others
        plane = np.frombuffer(read_plane(source, groups[0][0], groups[0][4], width, width * height), np.uint8).astype(np.uint32)
        return (plane << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)).reshape(height, width)
    if n_groups == 1 and cache_bits and width * height >= SMALL:
        found = read_cached(source, groups[0], width, width * height, cache_bits)
        if found is not None:
            return found.reshape(height, width)
    total, out, done, cached = width * height, [0] * (width * height), 0, 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    if meta is None and groups[0][0].used < 256:  # literals only
        green, red, blue, alpha = (code.read for code in groups[0][:4])
        for k in range(total):
            g = green(source) << 8
            out[k] = g | red(source) << 16 | blue(source) | alpha(source) << 24
        return np.array(out, np.uint32).reshape(height, width)
    while done < total:
        group = groups[int(meta[(done // width) >> tile, (done % width) >> tile])] if meta is not None else groups[0]
        s = group[0].read(source)
        if s < 256:
            red, blue, alpha = group[1].read(source), group[2].read(source), group[3].read(source)
            out[done] = alpha << 24 | red << 16 | s << 8 | blue
            done += 1
        elif s < 256 + LENGTHS:
            length = _amount(source, s - 256)
            far = _near(_amount(source, group[4].read(source)), width)
            if far > done or done + length > total:
                raise BrokenImage("a reference beyond the image")
            for k in range(done, done + length):
                out[k] = out[k - far]
            done += length
        else:
            while cached < done:
                cache[_cache_slot(out[cached], cache_bits)] = out[cached]
                cached += 1
            out[done] = cache[s - 256 - LENGTHS]
            done += 1
    return np.array(out, np.uint32).reshape(height, width)


def _near(far: int, width: int) -> int:
    """How many pixels back a distance of the format points."""
    if far > len(NEAR):
        return far - len(NEAR)
    x, y = NEAR[far - 1]
    return max(1, x + y * width)


def read_plane(source: Bits, green: Code, distance: Code, width: int, total: int) -> bytearray:
    """The green of an image in which no other colour takes any bits: what is looked up at every bit position at once."""
    if not green.width and green.symbol[0] < 256:
        return bytearray(green.symbol) * total
    first = source.at >> 3
    data = np.frombuffer(source.data + bytes(8), np.uint8)[first:].astype(np.int32)
    window = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    ahead = ((window[:, None] >> np.arange(8, dtype=np.int32)) & green.mask).ravel()
    top = len(ahead) - 1
    what, jump = (x.take(ahead, mode="clip") for x in green.arrays())
    what[top] = NOTHING
    jump += np.arange(len(ahead), dtype=np.int32)
    np.minimum(jump, top, out=jump)
    # two literals in a row are one step
    second = what.take(jump)
    pair = what | second << 8
    pair[(what > 255) | (second > 255)] = NOTHING
    pair, jump_pair = memoryview(pair), memoryview(jump.take(jump))
    what, jump = memoryview(what), memoryview(jump)
    far_symbol, far_bits, far_mask = distance.symbol, distance.bits, distance.mask
    raw, at, base = source.data, source.at - 8 * first, 8 * first
    out, pairs = bytearray(), array.array("H")
    put = pairs.append
    while True:
        start, before = at, len(out)
        p = pair[at]
        while p < 65_536:  # beyond the image's end this takes what isn't its own
            put(p)
            at = jump_pair[at]
            p = pair[at]
        if pairs:
            out += pairs.tobytes() if LITTLE else pairs.byteswap() or pairs.tobytes()
            del pairs[:]
        s = what[at]
        if s < 256:
            out.append(s)
            at = jump[at]
            s = what[at]
        done = len(out)
        if done >= total:
            break
        if s == NOTHING:
            raise BrokenImage("it ends early")
        bit = jump[at] + base
        value = int.from_bytes(raw[bit >> 3 : (bit >> 3) + 9], "little") >> (bit & 7)
        if s < 260:
            length, used = s - 255, 0
        else:
            used = (s - 258) >> 1
            length = ((2 + (s & 1)) << used) + (value & ((1 << used) - 1)) + 1
            value >>= used
        key = value & far_mask
        far, n = far_symbol[key], far_bits[key]
        used += n
        if far < 4:
            far += 1
        else:
            extra = (far - 2) >> 1
            far = ((2 + (far & 1)) << extra) + (value >> n & ((1 << extra) - 1)) + 1
            used += extra
        far = far - len(NEAR) if far > len(NEAR) else _near(far, width)
        if far > done or done + length > total:
            raise BrokenImage("a reference beyond the image")
        if far >= length:
            out += out[done - far : done - far + length]
        else:
            out += (out[done - far :] * (length // far + 1))[:length]
        at = min(bit + used - base, top)
    if done > total:
        at = start
        for _ in range(total - before):
            at = jump[at]
        del out[total:]
    source.at = at + base
    if source.at > 8 * len(raw):
        raise BrokenImage("it ends early")
    return out


def read_cached(source: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """The pixels of an image with a colour cache and one group of codes.

    How long a symbol with all that belongs to it is, is looked up at every bit position at once, and only the walk from one to the
    next is a loop. Then each pixel points to the one before that it repeats: that of its reference, or the last one with its
    place in the cache; following all at once leads to literals. None, and nothing read, if a place is read before it is set.
    """
    began, first, (green, *others, distance) = source.at, source.at >> 3, codes
    data = np.frombuffer(source.data + bytes(12), np.uint8)[first:].astype(np.int64)
    window = data[:-4] | data[1:-3] << 8 | data[2:-2] << 16 | data[3:-1] << 24
    ahead = ((window[:, None] >> np.arange(8)) & ((1 << 25) - 1)).astype(np.int32).ravel()
    top = len(ahead) - 1

    def looked(code: Code, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        key = (ahead if at is None else ahead[at]) & code.mask
        return code.arrays()[0].take(key), code.arrays()[1].take(key)

    what, jump = looked(green)
    jump += np.arange(len(ahead), dtype=np.int32)
    np.minimum(jump, top, out=jump)
    tokens = np.flatnonzero(what < 256 + LENGTHS)
    of = what[tokens]
    literal, copy = tokens[of < 256], tokens[of >= 256]
    after = jump[literal]
    for code in others:
        after = np.minimum(after + looked(code, after)[1], top)
    size, behind = what[copy] - 256, jump[copy]
    behind = np.minimum(behind + np.maximum((size - 2) >> 1, 0), top)
    far, bits = looked(distance, behind)
    whole = jump.copy()
    whole[literal], whole[copy] = after, np.minimum(behind + bits + np.maximum((far - 2) >> 1, 0), top)
    step, at, found = memoryview(whole), began - 8 * first, []
    put = found.append
    while at < top:
        put(at)
        at = step[at]
    at = np.array(found, np.int64)

    def amount(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
        extra = np.maximum((prefix - 2) >> 1, 0)
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (ahead[at] & ((1 << extra) - 1))) + 1

    symbol, count = what[at].astype(np.int64), np.ones(len(at), np.int64)
    copied = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTHS))
    count[copied] = amount(symbol[copied] - 256, jump[at[copied]])
    ends = count.cumsum()
    n = int(np.searchsorted(ends, total)) + 1
    if n > len(ends):
        raise BrokenImage("it ends early")
    at, symbol, count, place, copied = at[:n], symbol[:n], count[:n], (ends - count)[:n], copied[copied < n]
    source.at = int(whole[at[-1]]) + 8 * first
    if source.at > 8 * len(source.data):
        raise BrokenImage("it ends early")
    behind = np.minimum(jump[at[copied]] + np.maximum((symbol[copied] - 258) >> 1, 0), top)
    far, bits = looked(distance, behind)
    far = amount(far.astype(np.int64), np.minimum(behind + bits, top))
    far = np.where(far > len(NEAR), far - len(NEAR), np.array(_far_table(width)).take(far, mode="clip"))
    if ends[n - 1] != total or (far > place[copied]).any():
        raise BrokenImage("a reference beyond the image")

    shown = np.flatnonzero(symbol < 256)
    parts, after = [], jump[at[shown]]
    for code in others:
        own, bits = looked(code, after)
        parts.append(own.astype(np.uint32))
        after = np.minimum(after + bits, top)
    colour, slot = np.zeros(total, np.uint32), np.zeros(total, np.uint16)
    own = parts[2] << np.uint32(24) | parts[0] << np.uint32(16) | symbol[shown].astype(np.uint32) << np.uint32(8) | parts[1]
    colour[place[shown]] = own
    slot[place[shown]] = _cache_slot(own.astype(np.uint64), cache_bits)
    cached = np.flatnonzero(symbol >= 256 + LENGTHS)
    slot[place[cached]] = symbol[cached] - 256 - LENGTHS
    before, runs = np.arange(total), count[copied]
    copies = place[copied].repeat(runs) + np.arange(int(runs.sum())) - (runs.cumsum() - runs).repeat(runs)
    before[copies] = copies - far.repeat(runs)
    before = _followed(before)
    order = slot[before].argsort(kind="stable")  # the same place in the cache, side by side
    same = slot[before][order]
    last = np.full(total, -1)
    last[order[1:]] = np.where(same[1:] == same[:-1], order[:-1], -1)
    before[place[cached]] = last[place[cached]]
    if (before < 0).any():
        source.at = began
        return None
    return colour[_followed(before)]


def _followed(before: np.ndarray) -> np.ndarray:
    """Where each of these pointers to pixels before leads in the end."""
    while True:
        further = before[before]
        if (further == before).all():
            return before
        before = further


@functools.lru_cache(maxsize=64)
def _far_table(width: int) -> list[int]:
    return [0, *[_near(k + 1, width) for k in range(len(NEAR))]]


def _channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4) as alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, corner, beyond) -> list[int]:
    """The pixel that a mode foresees from its neighbours: each a list of blue, green, red, alpha."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return beyond
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, beyond), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, beyond)
    if mode == 10:
        return mean(mean(left, corner), mean(top, beyond))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return [0, 0, 0, 255]


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Band by band of tiles. Modes 0, 1 and 2 are sums along rows or columns of a whole block; others go pixel by pixel."""
    height, width = argb.shape
    out = argb.view(np.uint8).reshape(height, width, 4).copy()  # blue, green, red, alpha; sums of bytes wrap as they should
    which = ((modes >> np.uint32(8)) & np.uint32(15)).astype(np.int64)
    out[0, 0, 3] = (int(out[0, 0, 3]) + 255) & 255
    np.cumsum(out[0], axis=0, dtype=np.uint8, out=out[0])
    np.cumsum(out[:, 0], axis=0, dtype=np.uint8, out=out[:, 0])
    for band in range(len(which)):
        y0, y1 = max(1, band << bits), min(height, (band + 1) << bits)
        if y0 >= y1:
            continue
        row = which[band]
        if ((row >= 3) & (row <= 13)).any():
            _undo_by_pixel(out, row.tolist(), bits, y0, y1)
            continue
        edges = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(row)], strict=True):
            x0, x1 = max(1, a << bits), min(width, b << bits)
            block = out[y0:y1, x0:x1]
            if row[a] == 1:
                out[y0:y1, x0 - 1 : x1] = np.cumsum(out[y0:y1, x0 - 1 : x1], axis=1, dtype=np.uint8)
            elif row[a] == 2:
                out[y0 - 1 : y1, x0:x1] = np.cumsum(out[y0 - 1 : y1, x0:x1], axis=0, dtype=np.uint8)
            else:
                block[..., 3] += 255
    return out.view("<u4").reshape(height, width)


def _undo_by_pixel(out: np.ndarray, row: list[int], bits: int, y0: int, y1: int) -> None:
    width = out.shape[1]
    done = [out[y0 - 1].tolist()]
    for y in range(y0, y1):
        above, rest = done[-1], out[y].tolist()
        for x in range(1, width):
            beyond = above[x + 1] if x + 1 < width else rest[0]
            foreseen = predicted(row[x >> bits], rest[x - 1], above[x], above[x - 1], beyond)
            rest[x] = [(a + b) & 255 for a, b in zip(rest[x], foreseen, strict=True)]
        done = [rest]
        out[y] = rest


def _planes(argb: np.ndarray) -> np.ndarray:
    """A copy as (height, width, 4) bytes: blue, green, red, alpha."""
    return argb.copy().view(np.uint8).reshape(*argb.shape, 4)


def _scaled(element: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return ((element * colour.view(np.int8)) >> 5).astype(np.uint8)


def _elements(tiles: np.ndarray, bits: int, height: int, width: int) -> list[np.ndarray]:
    """By pixel: green to red, green to blue, red to blue."""
    if tiles.size > 1 and (tiles != tiles[0, 0]).any():
        tiles = np.repeat(np.repeat(tiles, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    else:
        tiles = tiles[:1, :1]
    return [((tiles >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int16) for s in (0, 8, 16)]


def undo_cross_colour(argb: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    c = _planes(argb)
    to_red, to_blue, red_to_blue = _elements(tiles, bits, *argb.shape)
    c[..., 2] += _scaled(to_red, c[..., 1])
    c[..., 0] += _scaled(to_blue, c[..., 1])
    if red_to_blue.any():
        c[..., 0] += _scaled(red_to_blue, c[..., 2])
    return c.view("<u4")[..., 0]


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _joined(c)


def palette_bits(n: int) -> int:
    """How often a width is halved when so many colours' indexes share pixels."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(colours))
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if bits:
        depth = 8 >> bits
        shifts = (np.arange(1 << bits) * depth).astype(np.uint32)
        index = ((index[..., None] >> shifts) & np.uint32((1 << depth) - 1)).reshape(len(argb), -1)[:, :width]
    known = np.r_[colours, np.zeros(256, np.uint32)]  # an index beyond the palette is transparent black
    return known[index]


def decode_stream(data: bytes) -> np.ndarray:
    """Pixels of a VP8L chunk's bytes."""
    source = Bits(data)
    if source.read(8) != SIGNATURE:
        raise BrokenImage("no signature")
    width, height, alpha, version = source.read(14) + 1, source.read(14) + 1, source.read(1), source.read(3)
    if version:
        raise BrokenImage("an unknown version")
    undo, own, seen = [], width, set()
    while source.read(1):
        kind = source.read(2)
        if kind in seen:
            raise BrokenImage("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = source.read(3) + 2
            tiles = read_pixels(source, _blocks(own, bits), _blocks(height, bits), False)
            undo.append(lambda p, f=undo_predictor if kind == PREDICTOR else undo_cross_colour, t=tiles, b=bits: f(p, t, b))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            n = source.read(8) + 1
            steps = _channels(read_pixels(source, n, 1, False))[0]
            colours = _joined(np.cumsum(steps, axis=0))
            undo.append(lambda p, c=colours, w=own: undo_palette(p, c, w))
            own = _blocks(own, palette_bits(n))
    argb = read_pixels(source, own, height, True)
    for f in reversed(undo):
        argb = f(argb)
    out = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
    if not alpha:
        out[..., 3] = 255
    return out


def chunk_of(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L bytes of the file that starts at at, and where the next one starts."""
    if len(data) < at + 20 or data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise BrokenImage("no WebP file")
    end, k = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
    while k + 8 <= end:
        kind, n = data[k : k + 4], struct.unpack_from("<I", data, k + 4)[0]
        if kind == b"VP8L":
            return data[k + 8 : k + 8 + n], end
        k += 8 + n + (n & 1)
    raise BrokenImage("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a file: (height, width, 4), red, green, blue, alpha."""
    return decode_stream(chunk_of(data)[0])


# Writing


@functools.lru_cache(maxsize=1 << 14)
def _bits(value: int, n: int) -> str:
    return format(value, f"0{n}b")[::-1]


class Writer:
    """Bits in the order of the format, kept as text until the end."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(_bits(value, n))

    def done(self) -> bytes:
        bits = "".join(self.parts)
        return int(bits[::-1] or "0", 2).to_bytes((len(bits) + 7) // 8, "little")


def limited_lengths(counts: list[int], most: int = MOST_BITS) -> list[int]:
    """Huffman code lengths of at most most bits; rare symbols' counts are raised until they fit."""
    used = sorted([(n, s) for s, n in enumerate(counts) if n])
    out, m = [0] * len(counts), len(used)
    if m == 1:
        out[used[0][1]] = 1
    least = 1
    while m > 1:
        # leaves in order, and joined nodes, whose weights also come in order
        weights, above, leaf, inner = [max(n, least) for n, _ in used], [0] * (2 * m - 1), 0, m
        for node in range(m, 2 * m - 1):
            total = 0
            for _ in range(2):
                if leaf < m and (inner >= node or weights[leaf] <= weights[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                total += weights[k]
                above[k] = node
            weights.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:m]) <= most:
            for (_, s), d in zip(used, depth, strict=False):
                out[s] = d
            break
        least *= 2
    return out


def write_code(to: Writer, lengths: list[int]) -> None:
    """A prefix code's description: one or two symbols below 256 plainly, else the lengths, themselves in a prefix code."""
    to.parts.append(_described(bytes(lengths)))


@functools.lru_cache(maxsize=2048)
def _described(lengths: bytes) -> str:
    to = Writer()
    _describe(to, list(lengths))
    return "".join(to.parts)


def _describe(to: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        to.put(1, 1)
        to.put(len(used) - 1, 1)
        wide = used[0] > 1
        to.put(wide, 1)
        to.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            to.put(used[1], 8)
        return
    tokens, last = [], 8
    for length, same in itertools.groupby(lengths):
        run = len(list(same))
        while run:
            if not length and run >= 3:
                n = min(run, 138)
                tokens.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            elif length and length == last and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n, last = 1, length or last
                tokens.append((length, 0, 0))
            run -= n
    counts = [0] * 19
    for x, _, _ in tokens:
        counts[x] += 1
    if sum(map(bool, counts)) == 1:  # with one symbol more each takes a bit
        counts[0 if not counts[0] else 1] += 1
    own = limited_lengths(counts, 7)
    codes = _code_strings(own)
    n = max(k for k in range(19) if own[LENGTH_ORDER[k]] or k < 4) + 1
    to.put(0, 1)
    to.put(n - 4, 4)
    for k in range(n):
        to.put(own[LENGTH_ORDER[k]], 3)
    to.put(0, 1)
    for x, extra, bits in tokens:
        to.parts.append(codes[x])
        to.put(extra, bits)


@functools.lru_cache(maxsize=1 << 14)
def _prefix(value: int) -> tuple[int, int, int]:
    """Of a length or distance the prefix, the extra bits and how many they are."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _tokens(argb: list[int], cache_bits: int, references: bool) -> list[tuple]:
    """Literals, (length, distance) and cached colours that give the pixels."""
    out, seen, k, cache = [], {}, 0, [0] * (1 << cache_bits) if cache_bits else []
    while k < len(argb):
        length, start = 0, seen.get(tuple(argb[k : k + 3]), -1) if references else -1
        if start >= 0:
            while k + length < len(argb) and length < 4096 and argb[start + length] == argb[k + length]:
                length += 1
        if length >= 3:
            out.append(("copy", length, k - start))
        else:
            length = 1
            out.append(("cached", _cache_slot(argb[k], cache_bits)) if cache_bits and cache[_cache_slot(argb[k], cache_bits)] == argb[k] and k else ("pixel", argb[k]))
        for x in range(k, k + length):
            if references:
                seen[tuple(argb[x : x + 3])] = x
            if cache_bits:
                cache[_cache_slot(argb[x], cache_bits)] = argb[x]
        k += length
    return out


@functools.lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """By pixels back the short distance that stands for it."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _code_strings(lengths: list[int]) -> list[str]:
    """Each symbol's code as bits; a lone symbol takes none."""
    if sum(map(bool, lengths)) <= 1:
        return [""] * len(lengths)
    out, code, last = [""] * len(lengths), 0, 0
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - last
        out[s] = format(code, f"0{n}b")
        code, last = code + 1, n
    return out


def repeats(samples: bytes, least: int = 12, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, length, distance) of parts, from left to right, that repeat the last place where bytes like their first stood.

    Shorter references than of 12 samples save little (8: 4 % of the size of prose) and take time on both sides.
    """
    total = len(samples)
    n = total - least + 1
    if n <= 1:
        return []
    a = np.frombuffer(samples, np.uint8).astype(np.uint64)
    four = a[:-3] << np.uint64(24) | a[1:-2] << np.uint64(16) | a[2:-1] << np.uint64(8) | a[3:]
    keys = (four[:n] << np.uint64(32) | four[4 : n + 4]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ four[least - 4 : least - 4 + n]
    # a hash of the bytes above, the place below: sorted, equal bytes stand side by side in order
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys &= np.uint64(0xFFFFFFFFFF000000)
    keys |= np.arange(n, dtype=np.uint64)
    keys.sort()
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) < np.uint64(1 << 24))
    places = (keys & np.uint64(0xFFFFFF)).astype(np.int64)
    last = np.full(n, -1)
    last[places[same + 1]] = places[same]
    starts = np.flatnonzero(last >= 0)
    found, done = [], 0
    for i, p in zip(starts.tolist(), last[starts].tolist(), strict=True):
        if i < done or samples[p : p + least] != samples[i : i + least]:
            continue
        far = i - p
        while True:  # a longer repeat is several references
            size = least
            while size + 64 <= most and i + size + 64 <= total and samples[i - far + size : i - far + size + 64] == samples[i + size : i + size + 64]:
                size += 64
            while size < most and i + size < total and samples[i - far + size] == samples[i + size]:
                size += 1
            found.append((i, size, far))
            i += size
            if size < most or samples[i - far : i - far + least] != samples[i : i + least] or i + least > total:
                break
        done = i
    return found


def short_repeats(samples: bytes, most: int = 4096) -> np.ndarray:
    """As repeats(), of parts of three bytes or more: those that _tokens() copies."""
    total, n = len(samples), max(0, len(samples) - 2)
    a = np.frombuffer(samples, np.uint8).astype(np.uint64)
    keys = (a[:-2] << np.uint64(16) | a[1:-1] << np.uint64(8) | a[2:]) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    keys.sort()
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) < np.uint64(1 << 32))
    places = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = np.full(n, -1)
    last[places[same + 1]] = places[same]
    starts = np.flatnonzero(last >= 0)
    # how far each repeat goes, eight bytes at a time; of the few longer ones only those that are used are followed further
    eight = np.ndarray((total,), "<u8", samples + bytes(8), strides=(1,)).copy()
    size, on = np.full(n, 3), starts
    for k in range(3, LONG, 8):
        apart = eight[np.minimum(on + k, total - 1)] ^ eight[np.minimum(last[on] + k, total - 1)]
        size[on] += np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        on = on[(apart == 0) & (on + k + 8 <= total)]
        if not len(on):
            break
    size = np.minimum(size, total - np.arange(n))
    follow = np.minimum.accumulate(np.append(np.where(last >= 0, np.arange(n), n), n)[::-1])[::-1]  # the next start from a place on
    after = follow[np.minimum(np.arange(n) + size, n)]
    after[size >= LONG] = -1
    after, i, found, longer = after.tolist(), int(follow[0]), [], {}
    while i < n:
        found.append(i)
        k = after[i]
        if k < 0:
            p, length, end = int(last[i]), int(size[i]), min(most, total - i)
            while length + 64 <= end and samples[p + length : p + length + 64] == samples[i + length : i + length + 64]:
                length += 64
            while length < end and samples[p + length] == samples[i + length]:
                length += 1
            longer[i] = length
            k = int(follow[min(i + length, n)])
        i = k
    size[list(longer)] = list(longer.values())
    places = np.array(found, np.int64)
    return np.stack([places, size[places], places - last[places]], axis=1)


#: So many bytes of a short repeat are compared for all places at once.
LONG = 3 + 8 * 6


def _entropy(counts: np.ndarray) -> float:
    """Bits that symbols so frequent take at least, whatever their prefix code."""
    own = counts[counts > 0].astype(float)
    return float(own.sum() * np.log2(own.sum()) - (own * np.log2(own)).sum()) if len(own) > 1 else 0.0


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of each."""
    v = values - 1
    high = np.frexp(v)[1].astype(np.int64) - 1
    few = v < 4
    bits = np.where(few, 0, high - 1)
    return np.where(few, v, 2 * high + (v >> np.maximum(bits, 0) & 1)), v & ((1 << bits) - 1), bits


@functools.lru_cache(maxsize=64)
def _near_table(width: int) -> np.ndarray:
    """_near_codes() by pixels back; 0 where there is none."""
    near = _near_codes(width)
    out = np.zeros(max(near) + 2, np.int64)
    out[list(near)] = list(near.values())
    return out


def _spelled(lengths: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first so many symbols the code, its first bit lowest, and its bits."""
    codes = _code_strings(lengths)[:most]
    return np.array([int(x[::-1], 2) if x else 0 for x in codes], np.uint64), np.array([len(x) for x in codes], np.int64)


class Way:
    """A grey image as it would be stored: what stands before its codes, then a literal or a reference at each of some places.

    marks: of each pixel its literal, one of so many kinds. least and size are the bits that it takes at least and exactly;
    neither needs it written, and least not even the codes.
    """

    def __init__(self, head: Writer, width: int, marks: np.ndarray, copies: np.ndarray | list[tuple[int, int, int]], kinds: int, most: int):
        self.head, self.most = "".join(head.parts), most
        place, length, far = np.asarray(copies, np.int64).reshape(-1, 3).T
        near = _near_table(width)
        code = near[np.minimum(far, len(near) - 1)]
        self.length, self.far = _prefixes(length), _prefixes(np.where(code > 0, code, far + len(NEAR)))
        edges = np.zeros(len(marks) + 1, np.int8)
        edges[place] += 1
        edges[place + length] -= 1
        own = np.cumsum(edges[:-1], dtype=np.int8) == 0
        self.literals = marks[own]
        own[place] = True
        self.copied = np.searchsorted(np.flatnonzero(own), place)  # which of all tokens
        self.extra = int(self.length[2].sum() + self.far[2].sum())
        self.counts = self._counted(np.bincount(self.literals, minlength=kinds))

    def _counted(self, literals: np.ndarray) -> list[np.ndarray]:
        """How often each symbol of each alphabet occurs: here all literals are green."""
        green = np.concatenate([literals, np.bincount(self.length[0], minlength=LENGTHS)])
        return [green, *[np.zeros(1, np.int64)] * 3, np.bincount(self.far[0], minlength=DISTANCES)]

    def _literal_codes(self) -> tuple[np.ndarray, np.ndarray]:
        return _spelled(self.lengths[0], 256)

    @property
    def least(self) -> int:
        coded = sum(PLAINLY for n in self.counts if np.count_nonzero(n) > 2)
        return len(self.head) + self.extra + coded + max(0, int(sum(map(_entropy, self.counts)) - 0.01))

    @functools.cached_property
    def lengths(self) -> list[list[int]]:
        made = {id(n): limited_lengths(n.tolist(), self.most) if n.any() else [1] for n in self.counts}  # some are the same
        return [made[id(n)] for n in self.counts]

    @functools.cached_property
    def spent(self) -> int:
        return len(self.head) + self.extra + sum(int(n @ np.array(x)) for n, x in zip(self.counts, self.lengths, strict=True) if np.count_nonzero(n) > 1)

    @functools.cached_property
    def size(self) -> int:
        return self.spent + sum(len(_described(bytes(x))) for x in self.lengths)

    def under(self, size: int) -> bool:
        """Whether its file is shorter; most that aren't are told by their least, or without their codes."""
        return file_size(self.least) < size and file_size(self.spent) < size and file_size(self.size) < size

    def stream(self) -> bytes:
        n = len(self.literals) + len(self.copied)
        value, bits, literal = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
        literal[self.copied] = False
        code, own = self._literal_codes()
        value[literal], bits[literal] = code[self.literals], own[self.literals]
        if len(self.copied):
            green, far = _spelled(self.lengths[0], 256 + LENGTHS), _spelled(self.lengths[-1], DISTANCES)
            at, of = np.zeros(len(self.copied), np.int64), np.zeros(len(self.copied), np.uint64)
            for part, size in ((green[0][256 + self.length[0]], green[1][256 + self.length[0]]), self.length[1:], (far[0][self.far[0]], far[1][self.far[0]]), self.far[1:]):
                of |= part.astype(np.uint64) << at.astype(np.uint64)
                at += size
            value[self.copied], bits[self.copied] = of, at
        out = [np.frombuffer((self.head + "".join(map(_described, map(bytes, self.lengths)))).encode(), np.uint8) & 1]
        for k in range(0, n, AT_ONCE):  # so that memory stays bounded
            own = bits[k : k + AT_ONCE]
            ends = own.cumsum()
            which = np.arange(int(ends[-1])) - (ends - own).repeat(own)
            out.append((value[k : k + AT_ONCE].repeat(own) >> which.astype(np.uint64)).astype(np.uint8) & 1)
        return np.packbits(np.concatenate(out), bitorder="little").tobytes()


#: Bits of a code's description at least, where it has more than two symbols.
PLAINLY = 18
#: Tokens whose bits are laid out at once.
AT_ONCE = 1 << 15


def plane_way(to: Writer, samples: bytes, width: int) -> Way:
    """An image whose green is samples and whose other colours are 0, with back-references and one group of codes."""
    to.put(0, 2)  # no colour cache, one group
    return Way(to, width, np.frombuffer(samples, np.uint8), repeats(samples), 256, PLANE_BITS)


def write_pixels(to: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, tile: int = 0) -> None:
    """The coded image of any pixels, with a colour cache, back-references, and with tile two groups of codes."""
    height, width = argb.shape
    to.put(cache_bits > 0, 1)
    if cache_bits:
        to.put(cache_bits, 4)
    groups, meta = 1, None
    if main:
        to.put(tile > 0, 1)
        if tile:
            to.put(tile - 2, 3)
            y, x = np.mgrid[0 : _blocks(height, tile), 0 : _blocks(width, tile)]
            meta = (x + y) % 2
            groups = int(meta.max()) + 1
            write_pixels(to, (meta.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
    tokens = _tokens(argb.ravel().tolist(), cache_bits, references)
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    near = _near_codes(width)
    counts, coded, at = [[[0] * n for n in sizes] for _ in range(groups)], [], 0
    for token in tokens:
        g = int(meta[(at // width) >> tile, (at % width) >> tile]) if meta is not None else 0
        if token[0] == "pixel":
            p = token[1]
            parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif token[0] == "cached":
            parts = [(0, 256 + LENGTHS + token[1], 0, 0)]
        else:
            length, far = _prefix(token[1]), _prefix(near.get(token[2], token[2] + len(NEAR)))
            parts = [(0, 256 + length[0], *length[1:]), (4, far[0], *far[1:])]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        coded.append((g, parts))
        at += token[1] if token[0] == "copy" else 1
    codes = []
    for g in range(groups):
        codes.append([])
        for n in counts[g]:
            lengths = limited_lengths(n) if any(n) else [1] + [0] * (len(n) - 1)
            write_code(to, lengths)
            codes[g].append(_code_strings(lengths))
    for g, parts in coded:
        for c, s, extra, bits in parts:
            to.parts.append(codes[g][c][s])
            to.put(extra, bits)


def do_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """What is left of the pixels (or of one colour's plane of them) after each is foreseen by its tile's mode."""
    planes = argb.view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)
    height, width = argb.shape
    which = np.repeat(np.repeat(((modes >> np.uint32(8)) & np.uint32(15)).astype(np.uint8), 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width].copy()
    which[0], which[1:, 0], which[0, 0] = 1, 2, 0
    flat = planes.reshape(-1, 4)
    out = flat.copy()
    for mode in np.unique(which).tolist():
        at = np.flatnonzero(which.ravel() == mode)
        out[at] -= foreseen(flat, at, width, mode)
    return (out & 255).astype(np.uint8).view("<u4").reshape(height, width)


def foreseen(flat: np.ndarray, at: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What a mode foresees for the pixels at these places, from the pixels themselves."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    left, top, corner = flat[at - 1], flat[np.maximum(at - width, 0)], flat[np.maximum(at - width - 1, 0)]
    beyond = flat[np.maximum(at - width + 1, 0)]  # in the last column that is the row's own first pixel
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(axis=1, keepdims=True), np.abs(left - corner).sum(axis=1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = (left + top) >> 1
        return np.clip(m + np.trunc((m - corner) / 2).astype(np.int32), 0, 255)
    mean = lambda a, b: (a + b) >> 1
    return {
        1: left, 2: top, 3: beyond, 4: corner, 5: mean(mean(left, beyond), top), 6: mean(left, corner), 7: mean(left, top),
        8: mean(corner, top), 9: mean(top, beyond), 10: mean(mean(left, corner), mean(top, beyond)),
    }[mode]


def do_cross_colour(argb: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    c = _planes(argb)
    to_red, to_blue, red_to_blue = _elements(tiles, bits, *argb.shape)
    c[..., 0] -= _scaled(to_blue, c[..., 1]) + _scaled(red_to_blue, c[..., 2])
    c[..., 2] -= _scaled(to_red, c[..., 1])
    return c.view("<u4")[..., 0]


def riff(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def file_size(bits: int) -> int:
    """Bytes of a file with so many bits in its stream."""
    stream = (bits + 7) // 8
    return 20 + stream + (stream & 1)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, tile: int = 0, block: int = 2) -> bytes:
    """A file of the pixels (height, width, 4) that uses the transforms named, a colour cache, back-references and, with tile, two groups of codes.

    Predictor modes and cross-colour elements go through all their values, block by block; PALETTE needs 256 colours at most.
    """
    height, width = pixels.shape[:2]
    argb = _joined(pixels[..., [3, 0, 1, 2]])
    to = _start(height, width, bool((pixels[..., 3] != 255).any()))
    for kind in transforms:
        to.put(1, 1)
        to.put(kind, 2)
        y, x = np.mgrid[0 : _blocks(height, block), 0 : _blocks(argb.shape[1], block)]
        if kind == PREDICTOR:
            modes = (((x + 3 * y) % 14).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
            to.put(block - 2, 3)
            write_pixels(to, modes, False)
            argb = do_predictor(argb, modes, block)
        elif kind == CROSS_COLOUR:
            tiles = ((x * 37 + y * 11) % 256 | (x * 59 + 40) % 256 << 8 | (y * 83 + 7) % 256 << 16).astype(np.uint32) | np.uint32(0xFF000000)
            to.put(block - 2, 3)
            write_pixels(to, tiles, False)
            argb = do_cross_colour(argb, tiles, block)
        elif kind == SUBTRACT_GREEN:
            c = _channels(argb)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            argb = _joined(c)
        else:
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette holds 256 colours")
            index = index.reshape(argb.shape).astype(np.uint32)
            to.put(len(colours) - 1, 8)
            write_pixels(to, _joined(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.int32)))[None, :], False)
            bits = palette_bits(len(colours))
            if bits:
                per, depth = 1 << bits, 8 >> bits
                full = np.pad(index, ((0, 0), (0, -width % per)))
                index = (full.reshape(height, -1, per) << (np.arange(per) * depth).astype(np.uint32)).sum(axis=2).astype(np.uint32)
            argb = index << np.uint32(8) | np.uint32(0xFF000000)
    to.put(0, 1)
    write_pixels(to, argb, True, cache_bits, references, tile)
    return riff(to.done())


#: Most bits of a code in grey images: short tables make them fast to read.
PLANE_BITS = 10
#: Sides of the tiles of the predictor and of cross-colour in grey images, as powers of two.
PREDICTED, CROSSED = 5, 9
#: Green to red 32 and green to blue 32 take off all of the green, so of a grey image only the green is left.
ALL_OF_GREEN = 0xFF002020


def tile_modes(left: np.ndarray, above: np.ndarray, bits: int = PREDICTED) -> np.ndarray:
    """For each tile of a grey image 1 or 2 if what is left after the pixel before or above is nearly all zeros, else 0."""
    zeros = []
    for rest in (left, above):
        y, x = np.arange(0, rest.shape[0], 1 << bits), np.arange(0, rest.shape[1], 1 << bits)
        zeros.append(np.add.reduceat(np.add.reduceat(rest == 0, x, axis=1, dtype=np.int32), y, axis=0))
    sides = [np.minimum(1 << bits, n - np.arange(0, n, 1 << bits)) for n in left.shape]
    enough = 0.75 * sides[0][:, None] * sides[1]
    return np.where(zeros[1] >= np.maximum(enough, zeros[0] + 1), 2, np.where(zeros[0] >= enough, 1, 0)).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)


def grey_way(samples: np.ndarray) -> Way:
    """A grey image (height, width) through the predictor, cross-colour and back-references."""
    height, width = samples.shape
    left, above = np.diff(samples, axis=1, prepend=samples[:, :1]), np.diff(samples, axis=0, prepend=samples[:1])
    modes = tile_modes(left, above)
    rest = samples.copy()
    if (modes & np.uint32(0xFF00)).any():
        which = np.repeat(np.repeat((modes >> np.uint32(8)).astype(np.uint8), 1 << PREDICTED, axis=0), 1 << PREDICTED, axis=1)[:height, :width]
        rest[which == 1], rest[which == 2] = left[which == 1], above[which == 2]
    rest[0], rest[:, 0] = left[0], above[:, 0]
    rest[0, 0] = samples[0, 0]
    to = _start(height, width, False)
    to.parts.append(_transforms(modes.tobytes(), height, width))
    to.put(0, 1)
    return plane_way(to, rest.tobytes(), width)


def encode_grey(samples: np.ndarray) -> bytes:
    """A VP8L stream of it."""
    return grey_way(samples).stream()


@functools.lru_cache(maxsize=256)
def _transforms(modes: bytes, height: int, width: int) -> str:
    """The description of both transforms of a grey image."""
    to = Writer()
    to.put(1 | PREDICTOR << 1 | (PREDICTED - 2) << 3, 6)
    write_pixels(to, np.frombuffer(modes, np.uint32).reshape(_blocks(height, PREDICTED), _blocks(width, PREDICTED)), False)
    to.put(1 | CROSS_COLOUR << 1 | (CROSSED - 2) << 3, 6)
    write_pixels(to, np.full((_blocks(height, CROSSED), _blocks(width, CROSSED)), ALL_OF_GREEN, np.uint32), False)
    return "".join(to.parts)


def _start(height: int, width: int, alpha: bool) -> Writer:
    to = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        to.put(value, n)
    return to


@functools.lru_cache(maxsize=4096)
def _shades(shades: bytes) -> str:
    """A palette's image: the steps from shade to shade, the same in red, green and blue; the first has the alpha."""
    steps = np.diff(np.frombuffer(shades, np.uint8), prepend=np.uint8(0)).tolist()
    lengths = limited_lengths(np.bincount(steps, minlength=256).tolist())
    to, of_alpha = Writer(), [0] * 256
    of_alpha[255] = 1
    of_alpha[0] = int(len(steps) > 1)
    to.put(0, 1)  # no colour cache
    write_code(to, lengths + [0] * LENGTHS)
    before = len(to.parts)
    write_code(to, lengths)
    to.parts += to.parts[before:]
    write_code(to, of_alpha)
    write_code(to, [1])
    codes, opaque = _code_strings(lengths), _code_strings(of_alpha)
    for k, x in enumerate(steps):
        to.parts.append(3 * codes[x] + opaque[0 if k else 255])
    return "".join(to.parts)


def shades_way(samples: np.ndarray) -> Way:
    """A grey image (height, width) through a palette of its shades and back-references."""
    height, width = samples.shape
    shades = np.flatnonzero(np.bincount(samples.ravel(), minlength=256)).astype(np.uint8)
    number = np.zeros(256, np.uint8)
    number[shades] = np.arange(len(shades))
    index, bits = number[samples], palette_bits(len(shades))
    if bits:
        per = 1 << bits
        full = np.pad(index, ((0, 0), (0, -width % per)))
        index = (full.reshape(height, -1, per) << (np.arange(per) * (8 >> bits)).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    to = _start(height, width, False)
    to.put(1 | PALETTE << 1 | (len(shades) - 1) << 3, 11)
    to.parts.append(_shades(shades.tobytes()))
    to.put(0, 1)
    return plane_way(to, index.tobytes(), index.shape[1])


def encode_shades(samples: np.ndarray) -> bytes:
    """A VP8L stream of it."""
    return shades_way(samples).stream()


class CacheWay(Way):
    """With a colour cache. A mark is a shade, and 256 more where the cache has it."""

    def __init__(self, head: Writer, width: int, marks: np.ndarray, copies: np.ndarray, slots: np.ndarray, cache_bits: int):
        self.slot, self.cache_bits = slots, cache_bits
        super().__init__(head, width, marks, copies, 512, MOST_BITS)

    def _counted(self, literals: np.ndarray) -> list[np.ndarray]:
        whole, alpha = literals[:256], np.zeros(256, np.int64)
        alpha[255] = whole.sum()
        cached = np.bincount(self.slot, literals[256:], 1 << self.cache_bits).astype(np.int64)
        green = np.concatenate([whole, np.bincount(self.length[0], minlength=LENGTHS), cached])
        return [green, whole, whole, alpha, np.bincount(self.far[0], minlength=DISTANCES)]

    def _literal_codes(self) -> tuple[np.ndarray, np.ndarray]:
        every = _spelled(self.lengths[0], len(self.lengths[0]))
        value, bits = every[0][:256].copy(), every[1][:256].copy()
        for code, own in [_spelled(self.lengths[1], 256)] * 2:  # red and blue; alpha takes no bits
            value |= code << bits.astype(np.uint64)
            bits += own
        return np.concatenate([value, every[0][256 + LENGTHS :][self.slot]]), np.concatenate([bits, every[1][256 + LENGTHS :][self.slot]])


def cache_way(samples: np.ndarray, cache_bits: int) -> Way:
    """A grey image (height, width) with a colour cache and references of three pixels or more, as encode() writes it."""
    height, width = samples.shape
    to = _start(height, width, False)
    for value, n in ((0, 1), (1, 1), (cache_bits, 4), (0, 1)):  # no transform, a cache, one group
        to.put(value, n)
    flat = samples.ravel()
    slots = np.zeros(256, np.int64)
    for v in np.flatnonzero(np.bincount(flat, minlength=256)).tolist():
        slots[v] = _cache_slot(0xFF000000 | v * 0x010101, cache_bits)
    # a colour is in the cache if it is the last of those before with its slot
    own = slots.astype(np.uint16)[flat]
    order = own.argsort(kind="stable")
    slot, shade = own[order], flat[order]
    marks = flat.astype(np.uint16)
    marks[order[1:][(slot[1:] == slot[:-1]) & (shade[1:] == shade[:-1])]] += 256
    return CacheWay(to, width, marks, short_repeats(flat.tobytes()), slots, cache_bits)
