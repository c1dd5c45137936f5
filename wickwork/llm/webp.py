"""Lossless WebP (VP8L) images to and from ARGB pixel arrays.

The decoder reads all of the format: prefix codes of both kinds, meta prefix images, back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Where one group of codes serves the whole image,
symbols are looked up at every bit of a segment at once, and the places where pixels begin are followed from one to the next. Inverse transforms work on whole
images or rows, pixel by pixel only where a predictor needs the pixel before. Images with a meta prefix image are read symbol by symbol.
The encoder picks for each image the transform with the least entropy (none, subtract-green, a predictor, a palette), replaces repeated pixels by back-references
and, where it pays, by the colour cache, and writes codes of the lengths that fit the counts.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

#: Fixed value: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Extra bits and least times of the symbols that repeat the length before, or 0.
RUNS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Bits that are looked up at once, and bits beyond them that the last symbol may take.
SEGMENT, AHEAD = 1 << 16, 128
#: Pixels that a back-reference must and may copy, and the tile of a predictor as a power of two.
LEAST_COPY, MOST_COPY, TILE = 3, 4096, 9
#: Size of the colour cache that the encoder tries, and the share of an image's bits that it must save, as it takes a pass over pixels to read.
CACHE_BITS, LEAST_GAIN = 6, 0.05
SIDE = 16_384
_EIGHT, _CHANNEL = np.arange(8), np.array([0, 256, 512, 768], np.int16)
#: Near offsets of the 120 short distance codes: by distance, then |x|, then right before left.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bytes = data, 0, np.frombuffer(data, np.uint8)

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1)


class Writer:
    """Collects numbers of some bits each, least significant bit first."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def fields(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def done(self) -> bytes:
        self.flush()
        values, sizes = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        moved = values << (starts & 31).astype(np.uint64)  # at most 31 + 32 bits
        low, high = (moved & np.uint64(0xFFFFFFFF)).astype(np.float64), (moved >> np.uint64(32)).astype(np.float64)
        count = int(ends[-1] >> 5) + 2
        words = np.bincount(starts >> 5, low, count) + np.bincount((starts >> 5) + 1, high, count)  # sums of bits apart, exact in doubles
        return words.astype(np.uint32).astype("<u4").tobytes()[: int(ends[-1] + 7) >> 3]


@lru_cache(maxsize=16)
def reversed_bits(width: int) -> np.ndarray:
    """The numbers of `width` bits with their bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Code:
    """A canonical prefix code: by length, and within a length by symbol."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        self.sizes = lengths[self.symbols]
        self.width = 0  # bits of every symbol, if all have the same number
        self.table: dict[tuple[int, int], int] | None = None
        if len(used) == 0:
            raise ValueError("a prefix code without symbols")
        if len(used) > 1:
            if int((1 << (15 - self.sizes.astype(np.int64))).sum()) != 1 << 15:
                raise ValueError("a prefix code that is not complete")
            self.width = int(self.sizes[0]) if self.sizes[0] == self.sizes[-1] else -1

    def lookup(self) -> tuple[np.ndarray, int]:
        """symbol << 4 | bits by the next bits of a stream, and the mask of these bits."""
        if len(self.symbols) == 1:
            return np.array([int(self.symbols[0]) << 4]), 0
        most = int(self.sizes[-1])
        full = np.repeat(self.symbols << 4 | self.sizes, 1 << (most - self.sizes.astype(np.int64)))
        return full[reversed_bits(most)], (1 << most) - 1

    def read(self, bits: Bits) -> int:
        if self.width == 0:
            return int(self.symbols[0])
        if self.table is None:
            self.table, value, last = {}, 0, int(self.sizes[0])
            for symbol, size in zip(self.symbols.tolist(), self.sizes.tolist()):
                value <<= size - last
                self.table[size, value] = symbol
                value, last = value + 1, size
        value = 0
        for size in range(1, 16):
            value = value << 1 | bits.read(1)
            if (size, value) in self.table:
                return self.table[size, value]
        raise ValueError("no such prefix code")


@lru_cache(maxsize=64)
def _inner_lookup(lengths: bytes) -> tuple[list[int], int]:
    table, mask = Code(np.frombuffer(lengths, np.uint8)).lookup()
    return table.tolist(), mask


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    inner = np.zeros(19, np.uint8)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        inner[k] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = _inner_lookup(inner.tobytes())
    found, before, window, ready = [], 8, 0, 0
    while len(found) < alphabet and most:
        most -= 1
        if ready < 14:  # a symbol of 7 bits and 7 more
            window, ready = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 64], "little") >> (bits.at & 7), 500
        entry = table[window & mask]
        size, symbol = entry & 15, entry >> 4
        if symbol < 16:
            found.append(symbol)
            before = symbol or before
        else:
            more, least = RUNS[symbol]
            found += [before if symbol == 16 else 0] * (least + (window >> size & (1 << more) - 1))
            size += more
        window >>= size
        ready -= size
        bits.at += size
    lengths[: len(found)] = found[:alphabet]
    return Code(lengths)


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _far(code: int, width: int) -> int:
    """Pixels back of a distance code."""
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _number(symbol: np.ndarray, next_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that prefix symbols and the bits after them stand for, and how many of these bits belong to them."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + (next_bits & ((1 << extra) - 1))) + 1, extra


def windows(data: np.ndarray, first: int, size: int) -> np.ndarray:
    """At each of `size` bits from byte `first` on, a number that begins with the next 17 bits or more; zeros follow the data."""
    here = data[first : first + (size >> 3) + 4]
    part = np.zeros((size >> 3) + 4, np.int64)
    part[: len(here)] = here
    three = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
    return (three[:, None] >> _EIGHT).ravel()


def _even_image(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels (32-bit numbers) of an image with one group of codes."""
    tables = [c.lookup() for c in codes]
    (green, green_mask), others, (far_table, far_mask) = tables[0], tables[1:4], tables[4]
    if all(mask == 0 for _, mask in tables[:4]) and green[0] < LITERALS << 4:
        g, r, b, a = (int(t[0]) >> 4 for t, _ in tables[:4])
        return np.full(n, a << 24 | r << 16 | g << 8 | b, np.uint32)
    plain, sizes = codes[0].symbols.max() < LITERALS, [t & 15 for t, _ in others]
    left, values, runs, fars = n, [], [], []
    while left > 0:
        first = bits.at >> 3
        size = min(SEGMENT, 8 * (len(bits.bytes) - first))  # no symbol begins beyond the data
        if size <= 0:
            raise ValueError("the image ends before its last pixel")
        window = windows(bits.bytes, first, size + AHEAD)
        head = green.take(window[:size] & green_mask)
        step = np.arange(size) + (head & 15)
        for (_, mask), own in zip(others, sizes):
            if mask:
                step += own.take(window & mask).take(step)
        run = back = None
        if not plain:
            run, back = np.ones(size, np.int64), np.zeros(size, np.int64)
            odd = np.flatnonzero(head >= LITERALS << 4)
            symbol, after = (head[odd] >> 4) - LITERALS, odd + (head[odd] & 15)
            step[odd] = after
            copy = symbol < LENGTHS
            odd, after = odd[copy], after[copy]
            run[odd], extra = _number(symbol[copy], window[after])
            entry = far_table[window[after + extra] & far_mask]
            after = after + extra + (entry & 15)
            back[odd], extra = _number(entry >> 4, window[after])
            step[odd] = after + extra
        at, starts, follow = bits.at & 7, [], memoryview(step)
        if plain:
            while left > 0 and at < size:
                starts.append(at)
                left -= 1
                at = follow[at]
        else:
            length = memoryview(run)
            while left > 0 and at < size:
                starts.append(at)
                left -= length[at]
                at = follow[at]
        bits.at = 8 * first + at
        place = np.array(starts)
        entry = head.take(place)
        symbol, after = entry >> 4, place + (entry & 15)
        colour = symbol << 8
        for (table, mask), shift in zip(others, (16, 0, 24)):
            entry = table.take(window.take(after) & mask)
            colour |= entry >> 4 << shift
            after += entry & 15
        if not plain:
            colour = np.where(symbol < LITERALS, colour, LITERALS - 1 - symbol)  # a negative number: not a literal
            runs.append(run.take(place))
            fars.append(back.take(place))
        values.append(colour)
    if bits.at > 8 * len(bits.bytes):
        raise ValueError("the image ends before its last pixel")
    found = np.concatenate(values)
    return found.astype(np.uint32) if plain else _resolved(found, np.concatenate(runs), np.concatenate(fars), n, width, cache_bits)


def _resolved(values: np.ndarray, runs: np.ndarray, fars: np.ndarray, n: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels of a row of literals (0 or more), copies (down to -LENGTHS) and cache places (below).

    Literals are put in place at once. Copies and cache places follow one by one; pixels enter the cache when the next cache place is read.
    """
    ends, shift = np.cumsum(runs), 32 - cache_bits
    if ends[-1] > n:
        raise ValueError("a back-reference outside the image")
    starts, odd = ends - runs, values < 0
    pixels, cache, cached = np.empty(n, np.int64), np.zeros(1 << cache_bits, np.int64), 0
    pixels[starts[~odd]] = values[~odd]
    for at, run, far, value in zip(starts[odd].tolist(), runs[odd].tolist(), fars[odd].tolist(), values[odd].tolist()):
        if value < -LENGTHS:
            new = pixels[cached:at]
            cache[(new * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = new  # of equal places the last one stays
            cached = at
            pixels[at] = cache[-1 - LENGTHS - value]
            continue
        back = _far(far, width)
        if back > at:
            raise ValueError("a back-reference outside the image")
        pixels[at : at + run] = pixels[at - back : at - back + run] if back >= run else np.resize(pixels[at - back : at], run)
    return pixels.astype(np.uint32)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image as rows of alpha, red, green, blue."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups, meta, meta_bits = 1, None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        wide = (width + (1 << meta_bits) - 1) >> meta_bits
        image = _entropy_image(bits, wide, (height + (1 << meta_bits) - 1) >> meta_bits, False)
        meta = (image[:, 1].astype(int) << 8 | image[:, 2]).reshape(-1, wide)
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, a) for a in (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    n = width * height
    if groups == 1:
        return _even_image(bits, codes[0], n, width, cache_bits).astype(">u4").view(np.uint8).reshape(n, 4)
    argb = np.zeros(n, np.int64)
    cache = np.zeros(max(cache_size, 1), np.int64)
    at, cached = 0, 0
    while at < n:
        own = codes[0] if meta is None else codes[meta[at // width >> meta_bits, at % width >> meta_bits]]
        symbol = own[0].read(bits)
        if symbol < LITERALS:
            red = own[1].read(bits)
            blue = own[2].read(bits)
            argb[at] = own[3].read(bits) << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = _prefixed(bits, symbol - LITERALS)
            far = _prefixed(bits, own[4].read(bits))
            back = _far(far, width)
            if back > at or at + length > n:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                argb[at] = argb[at - back]
                at += 1
        else:
            for k in range(cached, at):
                cache[(CACHE_FACTOR * int(argb[k]) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[k]
            cached = at
            argb[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], 1).astype(np.uint8)


def _predicted(mode: int, left, top, top_left, top_right) -> list[int]:
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 11:
        p = [sum(abs(int(t) - int(c)) for t, c in zip(x, top_left)) for x in (top, left)]
        return left if p[0] < p[1] else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), top_left)]
    simple = {0: [255, 0, 0, 0], 1: left, 2: top, 3: top_right, 4: top_left}
    if mode in simple:
        return simple[mode]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    pairs = {6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}
    return mean(*pairs[mode]) if mode in pairs else [255, 0, 0, 0]


def predictions(pixels: list[list[int]], modes: np.ndarray, bits: int, width: int, at: int) -> list[int]:
    """What the pixels before `at` predict there. pixels: rows of alpha, red, green, blue."""
    x, y = at % width, at // width
    if at == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return pixels[at - 1]
    if x == 0:
        return pixels[at - width]
    return _predicted(int(modes[y >> bits, x >> bits]), pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def _unpredicted(rest: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverse predictor transform. Rows whose tiles all predict from the left alone or from the row above alone are done at once, others pixel by pixel."""
    height, width, _ = rest.shape
    out = rest.copy()
    out[0, 0, 0] -= np.uint8(1)  # and 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        kinds, row, above = modes[y >> bits], out[y], out[y - 1]
        row[0] += above[0]
        if (kinds == 1).all():
            out[y] = np.cumsum(row, axis=0, dtype=np.uint8)
        elif np.isin(kinds, (0, 2, 3, 4, 9, 14, 15)).all():
            right = np.concatenate([above[1:], row[:1]])  # the last column's upper right is the first pixel of its own row
            black = np.zeros_like(above)
            black[:, 0] = 255
            mean = ((above.astype(np.uint16) + right) >> 1).astype(np.uint8)
            table = {0: black, 2: above, 3: right, 4: np.concatenate([above[:1], above[:-1]]), 9: mean}
            own = np.repeat(kinds, 1 << bits)[:width]
            for kind in set(kinds.tolist()):
                at = np.flatnonzero(own == kind)
                at = at[at > 0]
                row[at] += table.get(kind, black)[at]
        else:
            rows = [*above.tolist(), *row.tolist()]
            for x in range(1, width):
                expected = _predicted(int(kinds[x >> bits]), rows[width + x - 1], rows[x], rows[x - 1], rows[x + 1])
                rows[width + x] = [(a + b) & 255 for a, b in zip(rows[width + x], expected)]
            out[y] = rows[width:]
    return out


def _cross(image: np.ndarray, factors: np.ndarray, bits: int, width: int, sign: int) -> np.ndarray:
    """Cross-colour transform (sign -1) or its inverse (1)."""
    out = image.astype(np.int64)
    n = np.arange(len(out))
    own = factors[n // width >> bits, n % width >> bits].astype(np.uint8).view(np.int8).astype(np.int64)
    signed = lambda a: (a & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    green, red = signed(out[:, 2]), out[:, 1].copy()
    new_red = (red + sign * (own[:, 3] * green >> 5)) & 255
    true_red = new_red if sign > 0 else red
    blue = out[:, 3] + sign * (own[:, 2] * green >> 5) + sign * (own[:, 1] * signed(true_red) >> 5)
    out[:, 1], out[:, 3] = new_red, blue & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels (rows of alpha, red, green, blue) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown VP8L version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, h = (wide + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            undo.append((kind, size, _entropy_image(bits, w, h, False).reshape(h, w, 4), wide))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, 0, None, wide))
        else:
            colours = bits.read(8) + 1
            table = np.cumsum(_entropy_image(bits, colours, 1, False), axis=0, dtype=np.uint8)
            shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append((kind, shift, table, wide))
            wide = (wide + (1 << shift) - 1) >> shift
    pixels = _entropy_image(bits, wide, height, True)
    for kind, size, extra, wide in reversed(undo):
        if kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[:, 1] += pixels[:, 2]
            pixels[:, 3] += pixels[:, 2]
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, extra, size, wide, 1)
        elif kind == PREDICTOR:
            pixels = _unpredicted(pixels.reshape(height, wide, 4), extra[:, :, 2], size).reshape(-1, 4)
        else:
            index = pixels[:, 2].reshape(height, -1)
            if size:
                each = 8 >> size
                index = np.stack([index >> (each * k) & ((1 << each) - 1) for k in range(1 << size)], 2).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            pixels = table[index.reshape(-1)]
    return width, height, pixels


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code of least size for the counts, none above `most` bits; counts are flattened until that holds."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while True:
        order, n = np.argsort(weights, kind="stable"), len(used)
        leaves, merged, top = [*weights[order].tolist(), 1 << 62], [1 << 62] * n, [0] * (2 * n - 1)
        i = j = 0
        for new in range(n - 1):  # both queues rise, so the two least are at their heads
            if leaves[i] <= merged[j]:
                weight = leaves[i]
                top[i] = n + new
                i += 1
            else:
                weight = merged[j]
                top[n + j] = n + new
                j += 1
            if leaves[i] <= merged[j]:
                merged[new] = weight + leaves[i]
                top[i] = n + new
                i += 1
            else:
                merged[new] = weight + merged[j]
                top[n + j] = n + new
                j += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[top[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        weights = (weights + 1) >> 1 if weights.max() > 1 else weights


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their first bit lowest, as streams hold them."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used])
    out[used] = reversed_bits(15)[np.cumsum(room) - room]
    return out


#: The encoder's code for code lengths: bits of each length it writes, and of the symbols for 3 to 10 and 11 to 138 zeros.
LENGTH_SIZES = {5: 3, 6: 3, 7: 3, 8: 3, 0: 4, 3: 4, 4: 4, 9: 4, 17: 4, 18: 4, 2: 5, 10: 5, 11: 5, 1: 6, 12: 6}
LONGEST = 12


@lru_cache(maxsize=1)
def _length_fields() -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """What stands before the lengths of a code, and what the streams hold for each length and for each number of zeros: rows (bits, how many)."""
    sizes = np.array([LENGTH_SIZES.get(k, 0) for k in range(19)])
    codes = codes_of(sizes).tolist()
    last = max(k for k, x in enumerate(LENGTH_ORDER, 1) if sizes[x])
    head = [(0, 1), (last - 4, 4), *[(int(sizes[x]), 3) for x in LENGTH_ORDER[:last]], (0, 1)]
    gaps = []
    for zeros in range(3 * 138 + 1):
        value = size = 0
        while zeros:
            symbol = 18 if zeros >= 11 else 17 if zeros >= 3 else 0
            more, least = RUNS.get(symbol, (0, 1))
            times = min(zeros, least + (1 << more) - 1)
            value |= (codes[symbol] | times - least << int(sizes[symbol])) << size
            size += int(sizes[symbol]) + more
            zeros -= times
        gaps.append((value, size))
    return head, np.array([(codes[k], sizes[k]) for k in range(LONGEST + 1)]), np.array(gaps)


def _write_code(out: Writer, lengths: np.ndarray) -> None:
    """The lengths of a code: one or two symbols plainly, others one by one with the zeros between them in runs."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        out.put(1 | (len(used) == 2) << 1 | 1 << 2, 3)
        for symbol in used.tolist() or [0]:
            out.put(symbol, 8)
        return
    head, each, gaps = _length_fields()
    for value, size in head:
        out.put(value, size)
    rows = np.empty((2 * len(used) + 1, 2), np.int64)
    rows[1::2] = each[lengths[used]]
    rows[::2] = gaps[np.diff(np.concatenate([[-1], used, [len(lengths)]])) - 1]
    out.fields(rows[:, 0], rows[:, 1])


@lru_cache(maxsize=8)
def _near_codes(width: int) -> dict[int, int]:
    """Distance codes of near pixels by how far back they are."""
    return {max(1, x + y * width): code for code, (x, y) in reversed([*enumerate(NEAR, 1)])}


def _earlier(keys: np.ndarray) -> np.ndarray:
    """The latest earlier place with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(colours: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, pixels back) of runs that repeat what the latest earlier LEAST_COPY equal pixels begin, from left to right."""
    if len(colours) <= LEAST_COPY:
        return []
    keys = colours[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ colours[1:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ colours[:-2].astype(np.uint64)
    before = _earlier(keys)
    found, end = [], 0
    for at in np.flatnonzero(before >= 0).tolist():
        if at < end:
            continue
        start = int(before[at])
        length, most = 0, min(MOST_COPY, len(colours) - at)
        while length < most:  # in growing steps, as most copies are short
            step = min(max(16, length), most - length)
            differ = colours[at + length : at + length + step] != colours[start + length : start + length + step]
            first = int(differ.argmax())
            if differ[first]:
                length += first
                break
            length += step
        if length >= LEAST_COPY:
            found.append((at, length, at - start))
            end = at + length
    return found


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol of a number from 1, its extra bits and how many they are."""
    if value < 5:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    return 2 * high + (value - 1 >> high - 1 & 1), value - 1 & (1 << high - 1) - 1, high - 1


@lru_cache(maxsize=1)
def _weighed() -> np.ndarray:
    """n log2 n of the counts below 4096."""
    n = np.arange(1, 4096)
    return np.concatenate([[0.0], n * np.log2(n)])


def _entropy(pixels: np.ndarray) -> float:
    """Bits of each channel under a code of its own. pixels: rows of samples, or one channel."""
    counts = np.bincount((pixels + _CHANNEL).ravel() if pixels.ndim > 1 else pixels)
    if counts.max(initial=0) < 4096:
        weighed = _weighed().take(counts).sum()
    else:
        counts = counts[counts > 0]
        weighed = counts @ np.log2(counts)
    return pixels.size * math.log2(max(1, len(pixels))) - float(weighed)


def _write_image(out: Writer, pixels: np.ndarray, width: int, main: bool) -> None:
    """An entropy-coded image with one group of codes, with back-references and a colour cache where they pay."""
    n = len(pixels)
    colours = np.ascontiguousarray(pixels).view(">u4").ravel().astype(np.int64)
    channels = np.ascontiguousarray(pixels.T)
    copies = _copies(colours) if main else []
    literal = np.ones(n, bool)
    for at, length, _ in copies:
        literal[at : at + length] = False
    cache_bits, hit = 0, np.zeros(n, bool)
    if main and n > 64:
        bits = CACHE_BITS
        place = (colours * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - bits)
        before = _earlier(place)
        hit = literal & (before >= 0) & (colours[before] == colours)
        rest = pixels[literal]
        every = _entropy(rest)
        if hit.sum() * (every / max(1, len(rest)) - bits - 1) > 64 + every * LEAST_GAIN:
            cache_bits = bits
        else:
            hit[:] = False
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(0, 1)
    own = literal & ~hit
    green = channels[2].astype(np.int64)
    if cache_bits:
        green[hit] = LITERALS + LENGTHS + place[hit]
    near, prefixes = _near_codes(width), []
    for at, length, back in copies:
        size, far = _prefix(length), _prefix(near.get(back, back + 120))
        green[at] = LITERALS + size[0]
        prefixes.append((at, size[1], size[2], far[0], far[1], far[2]))
        literal[at] = True  # one symbol stands for the copy
    at = np.flatnonzero(literal)
    copied = np.array(prefixes, np.int64).reshape(-1, 6)
    counts = [np.bincount(green[at], minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))]
    counts += [np.bincount(channels[c][own], minlength=256) for c in (1, 3, 0)]
    counts.append(np.bincount(copied[:, 3], minlength=DISTANCES))
    lengths = [code_lengths(c, LONGEST) for c in counts]
    for x in lengths:
        _write_code(out, x)
    codes = [codes_of(x) for x in lengths]
    sizes = [x * (np.count_nonzero(x) > 1) for x in lengths]  # a lone symbol takes no bits
    both = [c | z << 20 for c, z in zip(codes, sizes)]
    rows = np.empty((n, 4), np.int64)
    rows[:, 0] = both[0].take(green)
    for k, c in ((1, 1), (2, 3), (3, 0)):
        rows[:, k] = both[k].take(channels[c])
    rows[~own, 1:] = 0
    if prefixes:
        copied[:, 1] |= copied[:, 2] << 20
        copied[:, 4] |= copied[:, 5] << 20
        rows[copied[:, 0], 1], rows[copied[:, 0], 2], rows[copied[:, 0], 3] = copied[:, 1], both[4][copied[:, 3]], copied[:, 4]
        rows = rows[at]
    flat = rows.ravel()
    out.fields(flat & 0xFFFFF, flat >> 20)


def container(stream: bytes) -> bytes:
    """The RIFF file around a VP8L stream."""
    even = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(even)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + even


def _palette(pixels: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Table, packed indices as pixels, and their width; None for more than 256 colours."""
    colours = np.ascontiguousarray(pixels).view(">u4").ravel()
    if np.count_nonzero(np.bincount((colours.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> 20)) > 256:  # places of colours in 4096
        return None
    names, index = np.unique(colours, return_inverse=True)
    if len(names) > 256:
        return None
    shift = 3 if len(names) <= 2 else 2 if len(names) <= 4 else 1 if len(names) <= 16 else 0
    each, step = 8 >> shift, 1 << shift
    wide = (width + step - 1) >> shift
    grid = np.zeros((len(colours) // width, wide * step), np.int64)
    grid[:, :width] = index.reshape(-1, width)
    packed = (grid.reshape(-1, wide, step) << (each * np.arange(step))).sum(axis=2).ravel()
    out = np.zeros((len(packed), 4), np.uint8)
    out[:, 0], out[:, 2] = 255, packed
    return names.astype(">u4").view(np.uint8).reshape(-1, 4), out, wide


def encode(pixels: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of pixels (rows of alpha, red, green, blue)."""
    height = len(pixels) // width
    if not 0 < width <= SIDE or not 0 < height <= SIDE or height * width != len(pixels):
        raise ValueError("no such image size")
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    grid = pixels.reshape(height, width, 4)
    subtracted = pixels.copy()
    subtracted[:, 1::2] -= pixels[:, 2:3]
    tried = {(): pixels, (SUBTRACT_GREEN,): subtracted}
    for mode in (1, 2):
        rest = grid.copy()
        rest[0, 0, 0] += np.uint8(1)  # less 255
        rest[0, 1:] -= grid[0, :-1]
        if mode == 1:
            rest[1:, 1:] -= grid[1:, :-1]
            rest[1:, 0] -= grid[:-1, 0]
        else:
            rest[1:] -= grid[:-1]
        tried[PREDICTOR, mode] = rest.reshape(-1, 4)
    cost = {k: 4 * _entropy(v[:, 1]) + 64 * len(k) for k, v in tried.items()}  # judged by red alone
    table = _palette(pixels, width)
    if table is not None:
        cost[PALETTE,] = _entropy(table[1]) + 24 * len(table[0]) + 64
    best = min(cost, key=cost.get)
    if best:
        out.put(1 | best[0] << 1, 3)
    if best == (PALETTE,):
        colours, image, wide = table
        out.put(len(colours) - 1, 8)
        _write_image(out, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8), len(colours), False)
    else:
        image, wide = tried[best], width
    if best and best[0] == PREDICTOR:
        out.put(TILE - 2, 3)
        tiles = ((width - 1 >> TILE) + 1) * ((height - 1 >> TILE) + 1)
        _write_image(out, np.tile(np.array([255, 0, best[1], 0], np.uint8), (tiles, 1)), (width - 1 >> TILE) + 1, False)
    out.put(0, 1)
    _write_image(out, image, wide, True)
    return container(out.done())
