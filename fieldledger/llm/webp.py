"""Lossless WebP: reading and writing of the still-image bitstream, as a media column.

The reader decodes prefix codes, back-references and the colour cache, undoes the predictor,
cross-colour, subtract-green and palette transforms, and gives the pixel array (height x width, ARGB
as unsigned 32-bit).  The writer makes two kinds of files: ``colour`` (three bytes are one pixel;
subtract-green, cross-colour and predictor transforms and a colour cache), which payloads are stored
in, and on demand ``palette`` (one byte of the payload is one pixel of a grey palette, with
back-references for long repeats).  Bits are found by table look-ups at every bit offset of a block, so a symbol costs one step of a small loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fieldledger.llm.base import add_columns, read_table

#: Fixed by the contract: payloads are padded with 255 to a positive multiple of this.
BLOCK = 576
MAX_SIDE = 16384
#: Name of our chunk with the payload's length; other readers pass over it.
LENGTH_CHUNK = b"FLEN"
#: Repeats of this many bytes become back-references.
LEAST_MATCH = 16
#: Block size of the transforms' images, as a power of two.
TILE_BITS = 4
CACHE_BITS = 6
#: Pixels of an image in colours at most: the writer holds all predictions of one at a time.
COLOUR_PIXELS = 1 << 19
#: Bit offsets whose look-ups are worked out at once.
BITS_AT_ONCE = 1 << 14
#: Symbols that one step of the reader's loop passes, as a power of two.
LEAP_BITS = 4

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 near distances (columns left, rows up), nearest first.
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
GREEN, OTHER, DISTANCE = 256 + 24, 256, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD


class WebpError(ValueError):
    """The bytes are not a lossless WebP file that can be read."""


def blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def reversed_bits(n_bits: int) -> np.ndarray:
    values = np.arange(1 << n_bits)
    out = np.zeros_like(values)
    for k in range(n_bits):
        out |= ((values >> k) & 1) << (n_bits - 1 - k)
    return out


REVERSED = {n: reversed_bits(n) for n in range(16)}


# ---- reading


class Bits:
    """Single reads from a bit stream, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data + bytes(8), at, 8 * len(data)

    def read(self, n: int) -> int:
        word = self.peek()
        self.skip(n)
        return word & ((1 << n) - 1)

    def peek(self, n_bytes: int = 8) -> int:
        """The bits that follow, as one number."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + n_bytes], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise WebpError("the stream ends too early")


class Prefix:
    """A prefix code: ``table[window]`` is symbol * 16 + length for the next ``n_bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise WebpError("a prefix code has no symbols")
        if len(used) == 1:
            self.only, self.n_bits, self.table = int(used[0]), 0, np.array([int(used[0]) * 16])
            return
        self.only, self.n_bits = None, int(lengths.max())
        sizes = lengths[used]
        by_size = np.argsort(sizes, kind="stable")
        order, sizes = used[by_size], sizes[by_size]
        span = 1 << (self.n_bits - sizes)
        if span.sum() != 1 << self.n_bits:
            raise WebpError("a prefix code is not complete")
        self.table = np.repeat(order * 16 + sizes, span)[REVERSED[self.n_bits]]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        entry = int(self.table[bits.peek() & ((1 << self.n_bits) - 1)])
        bits.skip(entry & 15)
        return entry >> 4


@lru_cache(maxsize=4096)
def prefix_of_few(*symbols: int) -> Prefix:
    """The code of one or two symbols."""
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Prefix(lengths)


@lru_cache(maxsize=4096)
def prefix_of_lengths(lengths: tuple[int, ...]) -> Prefix:
    """The code for code lengths, which files often share."""
    return Prefix(np.array(lengths, np.int64))


def read_prefix(bits: Bits, size: int) -> Prefix:
    word = bits.peek(4)
    if word & 1:  # one or two symbols
        n = 11 if word & 4 else 4
        symbols = [word >> 3 & (255 if word & 4 else 1)]
        if word & 2:
            symbols.append(word >> n & 255)
            n += 8
        bits.skip(n)
        if max(symbols) >= size:
            raise WebpError("a symbol lies outside its alphabet")
        return prefix_of_few(*symbols)
    start, code_lengths = bits.at, [0] * 19
    # At most 19 * 3 bits and 18 bits a symbol follow; they're taken off one large integer.
    rest = bits.peek(size * 18 // 8 + 20) >> 1
    n = 4 + (rest & 15)
    rest >>= 4
    for k in LENGTH_ORDER[:n]:
        code_lengths[k] = rest & 7
        rest >>= 3
    code = prefix_of_lengths(tuple(code_lengths))
    taken, left = 6 + 3 * n, size
    if rest & 1:  # the number of lengths that follow
        n = 2 + 2 * (rest >> 1 & 7)
        left = 2 + (rest >> 4 & ((1 << n) - 1))
        rest >>= 3 + n
        taken += 3 + n
    rest >>= 1
    out, before = [], 8
    table, mask = code.table.tolist(), (1 << code.n_bits) - 1
    while left > 0 and len(out) < size:
        left -= 1
        entry = table[rest & mask]
        if mask:
            rest >>= entry & 15
            taken += entry & 15
        s = entry >> 4
        if s < 16:
            out.append(s)
            before = s or before
            continue
        extra, least, value = ((2, 3, before), (3, 3, 0), (7, 11, 0))[s - 16]
        out += [value] * (least + (rest & ((1 << extra) - 1)))
        rest >>= extra
        taken += extra
    bits.at = start
    bits.skip(taken)
    if len(out) > size:
        raise WebpError("code lengths run over")
    return Prefix(np.array(out, np.int64))


def prefixed(symbol: int, bits: Bits) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: flat ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    tile_bits, of_tile, n_groups = 0, None, 1
    if main and bits.read(1):
        tile_bits = 2 + bits.read(3)
        tiles = read_image(bits, blocks(width, tile_bits), blocks(height, tile_bits), False)
        of_tile = ((tiles >> 8) & 0xFFFF).astype(np.int64)
        n_groups = int(of_tile.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_prefix(bits, n) for n in (GREEN + cache_size, OTHER, OTHER, OTHER, DISTANCE)] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return read_one_channel(bits, width, height, groups[0])
    return read_pixels(bits, width, height, groups, of_tile, tile_bits, cache_bits)


def plane_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def copied(out: list[int], distance: int, length: int, total: int) -> None:
    if distance > len(out) or len(out) + length > total:
        raise WebpError("a back-reference leaves the image")
    if distance >= length:
        start = len(out) - distance
        out += out[start : start + length]
    else:
        tail = out[-distance:]
        out += (tail * (length // distance + 1))[:length]


def read_one_channel(bits: Bits, width: int, height: int, group: list[Prefix]) -> np.ndarray:
    """Only green is coded: literals, lengths and distances."""
    green, red, blue, alpha, distance = group
    total, fixed = width * height, np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    if green.only is not None and green.only < 256:
        return np.full(total, fixed | np.uint32(green.only << 8), np.uint32)
    out, done = np.empty(total, np.uint8), 0
    raw = np.frombuffer(bits.data, np.uint8).astype(np.int64)
    mask, table = (1 << green.n_bits) - 1, green.table
    advance = np.where(table >> 4 < 256, table & 15, 0)  # a length symbol leads to itself
    while done < total:
        base = bits.at
        if base >= bits.end and green.n_bits:
            raise WebpError("the stream ends too early")
        first, last = base >> 3, min((base + BITS_AT_ONCE) >> 3, bits.end >> 3) + 1
        words = raw[first:last] | raw[first + 1 : last + 1] << 8 | raw[first + 2 : last + 2] << 16
        n = 8 * len(words)
        windows = np.empty((len(words), 8), np.int64)
        for k in range(8):
            np.right_shift(words, k, out=windows[:, k])
        windows = windows.ravel()
        windows &= mask
        # Where the next symbol starts, and the one after LEAP; the block's end leads to itself.
        step = np.arange(n + 1)
        step[:n] += advance.take(windows)
        np.minimum(step, n, out=step)
        leaps = [step]
        for _ in range(LEAP_BITS):
            leaps.append(leaps[-1].take(leaps[-1]))
        jump, p = leaps.pop().item, base - 8 * first
        while p < n and done < total:
            starts, q = [p], p
            for _ in range((total - done >> LEAP_BITS) + 1):
                if (r := jump(q)) == q:
                    break
                starts.append(r)
                q = r
            way = np.array(starts)
            for leap in reversed(leaps):  # between two of them the one in the middle
                both = np.empty(2 * len(way), np.int64)
                both[::2], both[1::2] = way, leap.take(way)
                way = both
            stop = int(way[-1])
            literals = way[: min(int(np.searchsorted(way, stop)), total - done)]
            if len(literals):
                entries = table.take(windows.take(literals))
                out[done : done + len(literals)] = entries >> 4
                done += len(literals)
                p = int(literals[-1]) + int(entries[-1] & 15)  # unclamped: the block may end within a symbol's bits
            if done < total and p < n and (entry := int(table[windows[p]])) >> 4 >= 256:
                bits.at = 8 * first + p + (entry & 15)
                length = prefixed((entry >> 4) - 256, bits)
                back = plane_distance(prefixed(distance.read(bits), bits), width)
                if back > done or done + length > total:
                    raise WebpError("a back-reference leaves the image")
                have = done - back
                while length:  # what is copied doubles where the reference overlaps itself
                    n_now = min(length, done - have)
                    out[done : done + n_now] = out[have : have + n_now]
                    done += n_now
                    length -= n_now
                p = bits.at - 8 * first
        bits.at = 8 * first + p
    if bits.at > bits.end:
        raise WebpError("the stream ends too early")
    return (out.astype(np.uint32) << np.uint32(8)) | fixed


def read_pixels(bits: Bits, width: int, height: int, groups, of_tile, tile_bits: int, cache_bits: int) -> np.ndarray:
    """The general case: all four channels, groups by tile, colour cache."""
    total, out = width * height, []
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    tiles = blocks(width, tile_bits)
    tile_of = None if of_tile is None else of_tile.tolist()
    looked_up = [[(c.table.tolist(), (1 << c.n_bits) - 1) for c in g[:4]] for g in groups]
    data, at_bit, end, group = bits.data, bits.at, bits.end, groups[0]
    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask) = looked_up[0]
    while (at := len(out)) < total:
        if tile_of is not None:
            y, x = divmod(at, width)
            k = tile_of[(y >> tile_bits) * tiles + (x >> tile_bits)]
            group = groups[k]
            (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask) = looked_up[k]
        word = int.from_bytes(data[at_bit >> 3 : (at_bit >> 3) + 10], "little") >> (at_bit & 7)
        g = green[word & green_mask]
        at_bit += g & 15
        s = g >> 4
        if s < 256:
            word >>= g & 15
            r = red[word & red_mask]
            word >>= r & 15
            b = blue[word & blue_mask]
            a = alpha[word >> (b & 15) & alpha_mask]
            at_bit += (r & 15) + (b & 15) + (a & 15)
            out.append(a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4)
        elif s < GREEN:
            bits.at = at_bit
            length = prefixed(s - 256, bits)
            copied(out, plane_distance(prefixed(group[4].read(bits), bits), width), length, total)
            at_bit = bits.at
        else:
            for v in out[cached:]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
            cached = at
            out.append(cache[s - GREEN])
        if at_bit > end:
            raise WebpError("the stream ends too early")
    bits.at = at_bit
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) int32: alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(k)) & np.uint32(255) for k in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def spread(tiles: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """A tile image (flat) at every pixel."""
    t = tiles.reshape(blocks(height, bits), blocks(width, bits))
    return np.repeat(np.repeat(t, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, :width]


def clamp_add_subtract(a, b, c):
    return np.minimum(np.maximum(a + b - c, 0), 255)


def predict(mode: int, left, top, top_left, top_right, axis: int = -1):
    """The prediction of one of the 14 modes; works on a pixel's channels (on ``axis``) or on many pixels'."""
    average = lambda p, q: (p + q) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return average(average(left, top_right), top)
    if mode == 6:
        return average(left, top_left)
    if mode == 7:
        return average(left, top)
    if mode == 8:
        return average(top_left, top)
    if mode == 9:
        return average(top, top_right)
    if mode == 10:
        return average(average(left, top_left), average(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(axis=axis, keepdims=True)
        to_top = np.abs(left - top_left).sum(axis=axis, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return clamp_add_subtract(left, top, top_left)
    if mode == 13:
        middle = average(left, top)
        half = middle - top_left
        return np.minimum(np.maximum(middle + (half + (half < 0) >> 1), 0), 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), np.shape(left))


def undo_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = channels(argb.reshape(height, width))
    c[0, 0] = (c[0, 0] + (255, 0, 0, 0)) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    mode = spread((modes >> np.uint32(8)) & np.uint32(15), bits, width, height)
    for y in range(1, height):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        right = np.concatenate([above[1:], row[:1]])  # past the last column lies the row's own first pixel
        for start in range(0, width, 1 << bits):
            m, a, b = int(mode[y, start]), max(1, start), min(width, start + (1 << bits))
            if a >= b:
                continue
            if m in (0, 2, 3, 4, 8, 9) or m > 13:
                row[a:b] += predict(m, row[a:b], above[a:b], above[a - 1 : b - 1], right[a:b])
                row[a:b] &= 255
            elif m == 1:
                row[a:b] = (np.cumsum(row[a:b], axis=0) + row[a - 1]) & 255
            else:
                row[a:b] = in_turn(m, row[a:b], row[a - 1], above[a - 1 : b], right[a:b])
    return packed(c).ravel()


def in_turn(mode: int, rest: np.ndarray, left: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pixels of one row's tile where each prediction needs the pixel before it; ``above`` begins one to the left."""
    if mode == 11:
        out, before = [], left.tolist()
        nearer = np.abs(above[1:] - above[:-1]).sum(axis=-1).tolist()
        for r, t, p, to_left in zip(rest.tolist(), above[1:].tolist(), above[:-1].tolist(), nearer):
            guess = before if to_left < sum([abs(x - y) for x, y in zip(before, p)]) else t
            before = [(x + y) & 255 for x, y in zip(r, guess)]
            out.append(before)
        return np.array(out, rest.dtype)
    # elsewhere channels don't meet
    one = {5: turn_5, 6: turn_6, 7: turn_7, 10: turn_10, 12: turn_12, 13: turn_13}[mode]
    columns = [one(*x) for x in zip(left.tolist(), rest.T.tolist(), above[1:].T.tolist(), above[:-1].T.tolist(), right.T.tolist())]
    return np.array(columns, rest.dtype).T


def turn_5(v, rest, top, top_left, right):
    return [v := (r + (((v + q) >> 1) + t >> 1)) & 255 for r, t, q in zip(rest, top, right)]


def turn_6(v, rest, top, top_left, right):
    return [v := (r + (v + p >> 1)) & 255 for r, p in zip(rest, top_left)]


def turn_7(v, rest, top, top_left, right):
    return [v := (r + (v + t >> 1)) & 255 for r, t in zip(rest, top)]


def turn_10(v, rest, top, top_left, right):
    return [v := (r + ((v + p >> 1) + (t + q >> 1) >> 1)) & 255 for r, t, p, q in zip(rest, top, top_left, right)]


def turn_12(v, rest, top, top_left, right):
    return [v := (r + min(255, max(0, v + t - p))) & 255 for r, t, p in zip(rest, top, top_left)]


def turn_13(v, rest, top, top_left, right):
    out = []
    for r, t, p in zip(rest, top, top_left):
        middle = v + t >> 1
        half = middle - p
        v = (r + min(255, max(0, middle + (half // 2 if half >= 0 else -(-half // 2))))) & 255
        out.append(v)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross(element: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (signed(element) * signed(colour)) >> 5


def undo_cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int) -> np.ndarray:
    c, e = channels(argb.reshape(height, width)), channels(spread(elements, bits, width, height))
    c[..., 1] = (c[..., 1] + cross(e[..., 3], c[..., 2])) & 255
    c[..., 3] = (c[..., 3] + cross(e[..., 2], c[..., 2]) + cross(e[..., 1], c[..., 1])) & 255
    return packed(c).ravel()


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = channels(argb)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return packed(c)


def bundle_bits(colours: int) -> int:
    """How many pixels share one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bits = bundle_bits(len(palette))
    index = ((argb >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    if bits:
        each = 8 >> bits
        index = np.stack([(index >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(1 << bits)], axis=-1).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)  # an index outside the palette is transparent black
    table[: len(palette)] = palette
    return table[index].ravel()


#: Palettes read before, by how many bits they took and what those were: one writer's files share them.
KNOWN_PALETTES: dict[tuple[int, int], np.ndarray] = {}


def read_palette(bits: Bits) -> np.ndarray:
    start, ahead = bits.at, bits.peek(64)
    for (n, word), palette in KNOWN_PALETTES.items():
        if ahead & ((1 << n) - 1) == word and start + n <= bits.end:
            bits.skip(n)
            return palette
    steps = channels(read_image(bits, bits.read(8) + 1, 1, False))
    palette, n = packed(np.cumsum(steps, axis=0)), bits.at - start
    if n < 500 and len(KNOWN_PALETTES) < 8:
        KNOWN_PALETTES[n, ahead & ((1 << n) - 1)] = palette
    return palette


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: (height, width) ARGB, unsigned 32-bit."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebpError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise WebpError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version")
    transforms, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in transforms):
            raise WebpError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = 2 + bits.read(3)
            transforms.append((kind, now, tile, read_image(bits, blocks(now, tile), blocks(height, tile), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, now))
        else:
            palette = read_palette(bits)
            transforms.append((kind, now, palette))
            now = blocks(now, bundle_bits(len(palette)))
    argb = read_image(bits, now, height, True)
    for kind, at_width, *more in reversed(transforms):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, at_width, height, more[1], more[0])
        elif kind == CROSS_COLOUR:
            argb = undo_cross_colour(argb, at_width, height, more[1], more[0])
        elif kind == SUBTRACT_GREEN:
            argb = undo_subtract_green(argb)
        else:
            argb = undo_palette(argb, at_width, height, more[0])
    return argb.reshape(height, width)


# ---- writing


class Writer:
    """Collects (value, number of bits) and packs them, least significant bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[int] = []
        self.few_sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.few.append(value)
        self.few_sizes.append(n)

    def flush(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.int64))
            self.sizes.append(np.array(self.few_sizes, np.int64))
            self.few, self.few_sizes = [], []

    def all(self, values, sizes) -> None:
        if isinstance(values, list):
            self.few += values
            self.few_sizes += sizes
        else:
            self.flush()
            self.values.append(values)
            self.sizes.append(sizes)

    def data(self) -> bytes:
        self.flush()
        sizes = np.concatenate(self.sizes)
        values, ends = np.concatenate(self.values)[sizes > 0].view(np.uint64), np.cumsum(sizes)
        sizes, ends = sizes[sizes > 0], ends[sizes > 0]
        starts = ends - sizes
        # Words of 64 bits: each takes the values that start in it, and the rest of the one that runs over from before.
        word, shift = starts >> 6, (starts & 63).view(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out = np.zeros(int(ends[-1] - 1 >> 6) + 1, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8", copy=False).tobytes()[: int(ends[-1]) + 7 >> 3]


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths of at most ``longest`` bits; a lone symbol gets 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = np.array(used)[np.argsort(counts[used], kind="stable")]
    weights = counts[order].tolist()
    n = len(weights)
    while True:
        # Two queues, both in ascending order: the leaves, and the nodes as they are made.
        weight, parent, leaf, node = list(weights), [0] * (2 * n - 1), 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                total += weight[k]
                parent[k] = made
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= longest:
            lengths[order] = depth[:n]
            return lengths
        weights = [(w >> 1) + 1 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for a stream that starts at the least significant one."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths.max())
    span = 1 << (longest - lengths[order])
    codes[order] = REVERSED[longest][np.cumsum(span) - span]
    return codes


def put_few(w: Writer, *symbols: int) -> None:
    """Writes the code of one or two symbols below 256."""
    w.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
    for s in symbols:
        w.put(s, 8)


def write_prefix(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code for ``counts``; returns (codes, lengths) to write symbols with."""
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used.max() < 256):
        symbols = used.tolist() or [0]
        put_few(w, *symbols)
        lengths = np.zeros(len(counts), np.int64)
        codes = np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            lengths[symbols], codes[symbols[1]] = 1, 1
        return codes, lengths
    lengths = code_lengths(counts, 15)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of it
    for value, run in groupby(lengths.tolist()):
        n = len(list(run))
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n > 0:
            if value and n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
            elif not value and n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
            elif not value and n >= 3:
                k = min(n, 10)
                tokens.append((17, k - 3, 3))
            else:
                k = 1
                tokens.append((value, 0, 0))
            n -= k
    symbols = [t[0] for t in tokens]
    inner = code_lengths(np.bincount(symbols, minlength=19), 7)
    w.put(15 << 1, 5)
    w.all(inner[list(LENGTH_ORDER)].tolist(), [3] * 19)
    inner_lengths = inner.tolist() if len(set(symbols)) > 1 else [0] * 19
    codes = codes_of(inner).tolist()
    w.put(0, 1)
    bits, n_bits = 0, 0
    for s, extra, n in tokens:
        own = inner_lengths[s]
        if own:
            bits |= codes[s] << n_bits
        bits |= extra << n_bits + own
        n_bits += own + n
        if n_bits > 40:
            w.put(bits, n_bits)
            bits, n_bits = 0, 0
    w.put(bits, n_bits)
    if len(used) == 1:  # a lone symbol takes no bits
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return codes_of(lengths), lengths


def split_value(values: list[int]) -> np.ndarray:
    """Lengths or distance codes (from 1) -> (symbols, extra bits' values, their numbers)."""
    out = []
    for v in values:
        v -= 1
        extra = max(0, v.bit_length() - 2)
        out.append((v if v < 4 else 2 * extra + (v >> extra), v & ((1 << extra) - 1), extra))
    return np.array(out, np.int64).reshape(-1, 3).T


def find_repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of back-references for repeats of LEAST_MATCH values or more."""
    n = len(flat)
    if n < 2 * LEAST_MATCH:
        return []
    words = flat.astype(np.uint64)
    for k in (1, 2, 4):  # of two, four, eight values
        words = words[:-k] | words[k:] << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        keys = words[:-8] * np.uint64(0x9E3779B97F4A7C15) + (words[8:] ^ (words[8:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # The key's upper bits and the position in one number: sorting them is sorting by key, then position.
    both = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    same = np.flatnonzero((both[1:] ^ both[:-1]) < np.uint64(1 << 32))
    if not len(same):
        return []
    both = (both & np.uint64(0xFFFFFFFF)).view(np.int64)
    at, gap = both[same + 1], both[same + 1] - both[same]
    order = np.argsort(at)
    at, gap = at[order], gap[order]
    edges = (np.flatnonzero((at[1:] - at[:-1] != 1) | (gap[1:] != gap[:-1])) + 1).tolist()
    out, free = [], 0
    for a, b in zip([0, *edges], [*edges, len(at)]):
        start, stop, distance = int(at[a]), int(at[b - 1]) + LEAST_MATCH, int(gap[a])
        start = max(start, free)
        if stop - start >= LEAST_MATCH and distance < (1 << 20) - 240 and (flat[start:stop] == flat[start - distance : stop - distance]).all():
            for p in range(start, stop, 4096):
                if (length := min(4096, stop - p)) >= 4:
                    out.append((p, length, distance))
                    free = p + length
    return out


def write_one_channel(w: Writer, index: np.ndarray, main: bool = True) -> None:
    """An image whose pixels differ only in green."""
    flat = np.ascontiguousarray(index, np.uint8).ravel()
    repeats = find_repeats(flat)
    w.put(0, 2 if main else 1)
    if not repeats:
        codes, lengths = write_prefix(w, np.bincount(flat, minlength=GREEN))
        for only in (0, 0, 255, 0):
            put_few(w, only)
        w.all(codes[flat], lengths[flat])
        return
    literal = np.ones(len(flat), bool)
    for p, length, _ in repeats:
        literal[p : p + length] = False
    at = np.flatnonzero(literal)
    plain = flat[at]
    length_s, length_x, length_n = split_value([r[1] for r in repeats])
    distance_s, distance_x, distance_n = split_value([r[2] + len(NEAR) for r in repeats])
    counts = np.bincount(plain, minlength=GREEN)
    counts[256:] += np.bincount(length_s, minlength=24)
    codes, lengths = write_prefix(w, counts)
    for only in (0, 0, 255):
        put_few(w, only)
    distance_codes, distance_lengths = write_prefix(w, np.bincount(distance_s, minlength=DISTANCE))
    # literals have one code each, back-references four pieces; all in the order of their positions
    starts = np.array([r[0] for r in repeats], np.int64)
    values, sizes = np.empty((2, len(at) + 4 * len(starts)), np.int64)
    place = np.arange(len(at)) + 4 * np.searchsorted(starts, at)
    values[place], sizes[place] = codes[plain], lengths[plain]
    place = np.searchsorted(at, starts) + 4 * np.arange(len(starts))
    pieces = [(codes[256 + length_s], lengths[256 + length_s]), (length_x, length_n), (distance_codes[distance_s], distance_lengths[distance_s]), (distance_x, distance_n)]
    for k, (value, size) in enumerate(pieces):
        values[place + k], sizes[place + k] = value, size
    w.all(values, sizes)


def write_colours(w: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """Pixels in four channels, with a colour cache if ``cache_bits``."""
    flat = argb.ravel()
    c = channels(flat)
    green = c[:, 2].astype(np.int64)
    if cache_bits:
        slots = ((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        order = np.argsort(slots, kind="stable")
        hit = np.zeros(len(flat), bool)
        hit[order[1:]] = (slots[order[1:]] == slots[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
        green = np.where(hit, GREEN + slots.astype(np.int64), green)
        w.put(1, 1)
        w.put(cache_bits, 4)
    else:
        hit = np.zeros(len(flat), bool)
        w.put(0, 1)
    if main:
        w.put(0, 1)
    tables = [write_prefix(w, np.bincount(green, minlength=GREEN + (1 << cache_bits if cache_bits else 0)))]
    tables += [write_prefix(w, np.bincount(c[~hit, k], minlength=OTHER)) for k in (1, 3, 0)]
    write_prefix(w, np.zeros(DISTANCE, np.int64))
    values = np.stack([tables[0][0][green], *(t[0][c[:, k]] for t, k in zip(tables[1:], (1, 3, 0)))], axis=1)
    sizes = np.stack([tables[0][1][green], *(np.where(hit, 0, t[1][c[:, k]]) for t, k in zip(tables[1:], (1, 3, 0)))], axis=1)
    w.all(values.ravel(), sizes.ravel())


def tile_sums(cost: np.ndarray, bits: int) -> np.ndarray:
    height, width = cost.shape
    rows = np.add.reduceat(cost, np.arange(0, height, 1 << bits), axis=0)
    return np.add.reduceat(rows, np.arange(0, width, 1 << bits), axis=1)


def apply_cross_colour(argb: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(residual, tile elements): each tile takes the multipliers that leave least."""
    height, width = argb.shape
    c = channels(argb)
    tries = np.array([-16, -8, 0, 8, 16])

    def best(colour, by):
        costs = np.stack([tile_sums(np.abs(signed(colour - cross(np.full(by.shape, t), by))), bits) for t in tries])
        return tries[np.argmin(costs, axis=0)]

    to_red, to_blue = best(c[..., 1], c[..., 2]), best(c[..., 3], c[..., 2])
    blue = c[..., 3] - cross(spread(to_blue, bits, width, height), c[..., 2])
    red_to_blue = best(blue, c[..., 1])
    out = c.copy()
    out[..., 1] = c[..., 1] - cross(spread(to_red, bits, width, height), c[..., 2])
    out[..., 3] = blue - cross(spread(red_to_blue, bits, width, height), c[..., 1])
    elements = np.stack([np.full(to_red.shape, 255), red_to_blue, to_blue, to_red], axis=-1)
    return packed(out), packed(elements)


def apply_predictor(argb: np.ndarray, bits: int, modes=range(14)) -> tuple[np.ndarray, np.ndarray]:
    """(residual, tile modes): each tile takes the mode that leaves least."""
    height, width = argb.shape
    c = channels(argb)
    above = np.roll(c, 1, axis=0)
    left, top_left = np.roll(c, 1, axis=1), np.roll(above, 1, axis=1)
    right = np.concatenate([above[:, 1:], c[:, :1]], axis=1)
    guesses = [predict(m, left, above, top_left, right) for m in modes]
    costs = np.stack([tile_sums(np.abs(signed(c - g)).sum(axis=-1), bits) for g in guesses])
    chosen = np.argmin(costs, axis=0)
    full = spread(chosen, bits, width, height)
    guess = np.take_along_axis(np.stack(guesses), full[None, ..., None], axis=0)[0]
    guess[:, 0] = above[:, 0]
    guess[0] = left[0]
    guess[0, 0] = (255, 0, 0, 0)
    mode = np.array(list(modes))[chosen]
    return packed(c - guess), (mode.astype(np.uint32) << np.uint32(8)) | np.uint32(OPAQUE)


def file_of(w: Writer) -> bytes:
    return riff(w.data())


def riff(data: bytes) -> bytes:
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def head(w: Writer, width: int, height: int) -> None:
    w.all([0x2F, width - 1, height - 1, 0, 0], [8, 14, 14, 1, 3])


def all_greys() -> tuple[list[int], list[int]]:
    """The palette transform with the 256 greys: two steps, and the second repeated by a back-reference."""
    w = Writer()
    w.all([1, PALETTE, 255], [1, 2, 8])
    w.put(0, 1)
    (repeat, extra, n), = split_value([254]).T
    steps = [0, 1, 256 + int(repeat)]
    green, sizes = write_prefix(w, np.bincount(steps, minlength=GREEN))
    for _ in range(2):
        write_prefix(w, np.bincount([0, 1], minlength=OTHER))
    write_prefix(w, np.bincount([0, 255], minlength=OTHER))
    write_prefix(w, np.bincount([1], minlength=DISTANCE))  # the second near distance: one to the left
    w.all([int(green[0]), 0, 0, 1], [int(sizes[0]), 1, 1, 1])
    w.all([int(green[1]), 1, 1, 0], [int(sizes[1]), 1, 1, 1])
    w.all([int(green[steps[2]]), int(extra)], [int(sizes[steps[2]]), int(n)])
    return w.few, w.few_sizes


GREYS = all_greys()


def encode_palette(values: np.ndarray) -> bytes:
    """A grey image (height, width) of bytes, as indices into a palette of those it has."""
    height, width = values.shape
    present = np.flatnonzero(np.bincount(values.ravel(), minlength=256)).astype(np.uint32)
    if len(present) > 16:  # no bundling: all greys, whose palette costs a few bytes and is the same for every file
        w = Writer()
        head(w, width, height)
        w.all(*GREYS)
        w.put(0, 1)
        write_one_channel(w, values)
        return file_of(w)
    index = np.zeros(256, np.uint8)
    index[present] = np.arange(len(present))
    pixels, bits = index[values], bundle_bits(len(present))
    if bits:
        each, short = 8 >> bits, -width % (1 << bits)
        pixels = np.pad(pixels, ((0, 0), (0, short))).reshape(height, -1, 1 << bits)
        pixels = (pixels.astype(np.int64) << (np.arange(1 << bits) * each)).sum(axis=-1).astype(np.uint8)
    w = Writer()
    head(w, width, height)
    w.all([1, PALETTE, len(present) - 1], [1, 2, 8])
    grey = np.uint32(OPAQUE) | present << np.uint32(16) | present << np.uint32(8) | present
    write_colours(w, packed(np.diff(channels(grey), axis=0, prepend=0)), False)
    w.put(0, 1)
    write_one_channel(w, pixels)
    return file_of(w)


def encode_colours(argb: np.ndarray, tile_bits: int = TILE_BITS, cache_bits: int = CACHE_BITS, modes=range(14)) -> bytes:
    """An image (height, width) of ARGB through all transforms of colours."""
    height, width = argb.shape
    w = Writer()
    head(w, width, height)
    w.all([1, SUBTRACT_GREEN], [1, 2])
    c = channels(argb)
    c[..., 1] -= c[..., 2]
    c[..., 3] -= c[..., 2]
    rest, elements = apply_cross_colour(packed(c), tile_bits)
    w.all([1, CROSS_COLOUR, tile_bits - 2], [1, 2, 3])
    write_colours(w, elements, False)
    rest, chosen = apply_predictor(rest, tile_bits, modes)
    w.all([1, PREDICTOR, tile_bits - 2], [1, 2, 3])
    write_colours(w, chosen, False)
    w.put(0, 1)
    write_colours(w, rest, True, cache_bits)
    return file_of(w)


# ---- payloads and their features


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def shape_of(n_values: int) -> tuple[int, int]:
    """(height, width) of the least rectangle for this many pixels, 192 wide; wider only where an image may not be
    higher.  The last row may be longer than what is left for it."""
    unit = 192
    width = min(unit * -(-n_values // (unit * MAX_SIDE)), MAX_SIDE // unit * unit)
    return -(-n_values // width), width


def encode_payload(payload: bytes, kind: str | None = None) -> bytes:
    """The payload as a file: ``colour``, so that each goes through all transforms and the cache, or ``palette`` on demand.

    A payload beyond one image's size becomes several files of the same width, one after the other.
    """
    raw = np.frombuffer(payload, np.uint8)
    if kind != "palette":
        return b"".join(encode_part(part, width, "colour") for part, width in colour_parts(raw))
    width = shape_of(len(raw))[1]
    step = width * MAX_SIDE
    return b"".join(encode_part(raw[at : at + step], width, kind) for at in range(0, len(raw), step))


def colour_parts(raw: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(bytes, width) of the images in colours that a payload becomes."""
    width = shape_of(len(raw) // 3)[1]
    step = width * min(MAX_SIDE, max(1, COLOUR_PIXELS // width)) * 3
    return [(raw[at : at + step], width) for at in range(0, len(raw), step)]


def filled(raw: np.ndarray, row: int) -> np.ndarray:
    """Whole rows of ``row`` bytes, the last one filled up with 255."""
    short = -len(raw) % row
    return np.concatenate([raw, np.full(short, 255, np.uint8)]) if short else raw


def encode_part(raw: np.ndarray, width: int, kind: str) -> bytes:
    """One image; where its last row has to be filled, a chunk after the pixels holds the bytes' number."""
    full = filled(raw, width if kind == "palette" else 3 * width)
    if kind == "palette":
        media = encode_palette(full.reshape(-1, width))
    else:
        rgb = full.reshape(-1, 3).astype(np.uint32)
        argb = np.uint32(OPAQUE) | rgb[:, 0] << np.uint32(16) | rgb[:, 1] << np.uint32(8) | rgb[:, 2]
        media = encode_colours(argb.reshape(-1, width))
    return with_length(media, len(raw)) if len(full) > len(raw) else media


def with_length(media: bytes, n: int) -> bytes:
    chunk = LENGTH_CHUNK + struct.pack("<IQ", 8, n)
    return media[:4] + struct.pack("<I", len(media) - 8 + len(chunk)) + media[8:] + chunk


def decode_payload(media: bytes) -> tuple[np.ndarray, bytes]:
    """(pixels, payload).  A grey file has one byte a pixel, any other three; several files' images are one below the other."""
    images, parts = [], []
    for one in files_of(media):
        argb = decode(one)
        part = argb.astype(np.uint8).tobytes() if is_palette(one) else channels(argb)[..., 1:].astype(np.uint8).tobytes()
        images.append(argb)
        parts.append(part[: stored_length(one, len(part))])
    return images[0] if len(images) == 1 else np.concatenate(images), b"".join(parts)


def files_of(media: bytes) -> list[bytes]:
    """The files that lie one after the other."""
    out, at = [], 0
    while at < len(media) or not out:
        out.append(media[at:] if len(media) - at < 20 else media[at : at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]])
        at += len(out[-1])
    return out


def stored_length(media: bytes, most: int) -> int:
    """How many of an image's bytes are the payload's: all, unless the file says otherwise."""
    size = struct.unpack("<I", media[16:20])[0]
    chunk = media[20 + size + (size & 1) :]
    if chunk[:4] != LENGTH_CHUNK:
        return most
    if len(chunk) != 16 or (n := struct.unpack("<IQ", chunk[4:])[1]) > most:
        raise WebpError("the stored length is wrong")
    return n


def is_palette(media: bytes) -> bool:
    """True if the file's first transform is the palette."""
    bits = Bits(media[20:64], 40)
    return bits.read(1) == 1 and bits.read(2) == PALETTE


LEVELS = np.arange(256.0)


def features(argb: np.ndarray) -> str:
    """Size, mean and spread of luminance, sixteen shares of its histogram, and mean steps across and down."""
    red, green, blue = ((argb >> np.uint32(k)).astype(np.uint8) for k in (16, 8, 0))
    if np.array_equal(red, green) and np.array_equal(green, blue):
        luma = green
    else:
        luma = ((299 * red.astype(np.int32) + 587 * green.astype(np.int32) + 114 * blue.astype(np.int32)) // 1000).astype(np.uint8)
    shares = np.bincount(luma.ravel(), minlength=256) / luma.size
    mean = float(shares @ LEVELS)
    steps = luma.astype(np.int16)
    across, down = (float(np.abs(d).sum(dtype=np.int64)) / max(1, d.size) for d in (steps[:, 1:] - steps[:, :-1], steps[1:] - steps[:-1]))
    numbers = [mean, max(0.0, float(shares @ LEVELS**2) - mean**2) ** 0.5, across, down, *shares.reshape(16, 16).sum(axis=1).tolist()]
    return f"{argb.shape[1]}x{argb.shape[0]};" + ";".join(f"{x:.4f}" for x in numbers)


STORED = "n_bytes long, media binary"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PIXELS = "width int, height int, pixels binary"


def stored(text: str | None, kind: str | None = None) -> tuple[int, bytes]:
    """(bytes of the text, the stored file of its padded payload)."""
    data = (text or "").encode("utf-8")
    return len(data), encode_payload(padded(data), kind)


def read_back(media: bytes, keep_pixels: bool = False) -> tuple:
    """What READ (and PIXELS) name, from the stored bytes alone."""
    return row_of(media, *decode_payload(media), keep_pixels)


def row_of(media: bytes, argb: np.ndarray, payload: bytes, keep_pixels: bool = False) -> tuple:
    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(argb))
    return (*row, argb.shape[1], argb.shape[0], argb.astype("<u4").tobytes()) if keep_pixels else row


def stored_many(texts: list[str | None], kind: str | None = None) -> list[tuple[int, bytes]]:
    """``stored`` of each; files in colours are made together."""
    from fieldledger.llm.webp_many import encode_payloads

    if kind == "palette":
        return [stored(t, kind) for t in texts]
    data = [(t or "").encode("utf-8") for t in texts]
    return [(len(d), m) for d, m in zip(data, encode_payloads([padded(d) for d in data]))]


def read_back_many(media: list[bytes], keep_pixels: bool = False) -> list[tuple]:
    """``read_back`` of each; files in the writer's colour form are read together."""
    from fieldledger.llm.webp_many import decode_payloads

    return [row_of(m, *read, keep_pixels) for m, read in zip(media, decode_payloads(media))]


def columns_of(rows: list[tuple], n: int) -> list:
    return list(zip(*rows)) if rows else [[]] * n


def with_media(docs: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """Adds n_bytes and ``media``, the stored file of each text's padded payload; the text is left out.

    Null and empty texts are one block of padding; a payload of any length can be stored (beyond one
    image it becomes several).  Repeated rows and equal texts get equal files.  Clashing extra columns
    are replaced; an empty table gives no rows.
    """
    return add_columns(docs, [text], STORED, lambda: lambda texts: columns_of(stored_many(texts, kind), 2), drop=(text,))


def read_media(media: DataFrame, keep_pixels: bool = False) -> DataFrame:
    """Adds what the stored files hold: payload digests and pixel features; with ``keep_pixels`` also
    width, height and ``pixels`` (ARGB as little-endian unsigned 32-bit, row by row)."""
    schema = f"{READ}, {PIXELS}" if keep_pixels else READ
    return add_columns(media, ["media"], schema, lambda: lambda files: columns_of(read_back_many(files, keep_pixels), 9 if keep_pixels else 6), drop=("media",))


def media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """with_media and read_media in one task function: the files aren't sent from one worker to another.

    Null and empty texts are a payload of 576 bytes of 255; texts of any length are stored whole; equal texts, and so repeated
    rows, have equal values; clashing extra columns are replaced; an empty table gives no rows.
    """

    def rows(texts):
        files = stored_many(texts)
        return columns_of([(n, *row) for (n, _), row in zip(files, read_back_many([m for _, m in files]))], 7)

    return add_columns(docs, [text], f"n_bytes long, {READ}", lambda: rows, drop=(text,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_digests(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
