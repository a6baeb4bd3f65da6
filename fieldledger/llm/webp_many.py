"""Lossless WebP for many small images at once: a task's rows go through every transform together.

Texts are short, so that one file after the other spends its time on the steps between array operations.  Here the
images of a slice of rows lie one below the other, and each step (a transform, a prefix code's next node, the next
symbol, the next pixel) is taken for all of them.  The files are those of ``webp.encode_payload`` byte for byte.  The
reader takes any files: those that are not in the writer's form (other transforms, groups by tile, back-references,
transparency, errors) are left to ``webp.decode_payload``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

from fieldledger.llm import webp
from fieldledger.llm.webp import DISTANCE, GREEN, LENGTH_ORDER, OPAQUE, OTHER

#: Pixels that are held at once, apart from an image that is larger itself.
PIXELS_AT_ONCE = 1 << 19
#: Bits after which another lane begins to read the same image, and bits that a lane may go on to meet another.
LANE_BITS = 4096
OVERHANG = 4096
#: Pixels that lanes read before those at their ends are left out.
STEPS_AT_ONCE = 16
#: Symbols of code lengths that are read before it's looked up which images have all theirs.
LENGTHS_AT_ONCE = 16
SIDE = 1 << webp.TILE_BITS
REVERSED = webp.REVERSED[15]
FAR = 1 << 60
#: Extra bits of code length symbols, and the least run that each stands for.
RUN_BITS = np.array([0] * 16 + [2, 3, 7])
RUN_LEAST = np.array([1] * 16 + [3, 3, 11])


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group begins if they lie one after the other."""
    return np.cumsum(counts) - counts


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... in each group."""
    return np.arange(int(counts.sum())) - np.repeat(starts_of(counts), counts)


# ---- prefix codes


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """webp.code_lengths of each row (at least two symbols in it)."""
    size = counts.shape[1]
    used = (counts > 0).sum(axis=1)
    by_used = np.argsort(-used, kind="stable")
    n, rows = used[by_used], len(counts)
    weights, symbols = sorted_pairs(counts[by_used], int(n[0]))
    weights[weights == 0] = FAR
    lengths = np.zeros_like(counts)
    left = np.arange(rows)
    while len(left):
        depth = depths(weights[left], n[left])
        row, column = np.nonzero(np.arange(depth.shape[1]) < n[left, None])
        lengths[by_used[left[row]], symbols[left[row], column]] = depth[row, column]
        left = left[depth[:, 0] > longest]
        halved = weights[left]
        weights[left] = np.where(halved < FAR, (halved >> 1) + 1, FAR)
    return lengths


def depths(weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Huffman depths of ascending weights (``n`` in each row, rows by falling ``n``): two queues, leaves before nodes."""
    rows, most = len(n), int(n[0])
    wide = most + 1
    leaves = np.full((rows, wide), FAR, np.int64)
    leaves[:, :most] = weights[:, :most]
    nodes = np.full((rows, wide), FAR, np.int64)
    parent = np.zeros((rows, 2 * wide), np.int64)
    flat_leaves, flat_nodes, flat_parent = leaves.ravel(), nodes.ravel(), parent.ravel()
    leaf, node, up = np.arange(rows) * wide, np.arange(rows) * wide, np.arange(rows) * 2 * wide
    to_leaf, to_node = up - leaf, up - node + wide  # from a place among leaves or nodes to one in ``parent``
    active = np.searchsorted(-n, -np.arange(1, most), side="left")  # rows with more symbols than that
    for made in range(most - 1):
        k = int(active[made])
        a, b = leaf[:k], node[:k]
        total = 0
        for _ in range(2):
            w, v = flat_leaves.take(a), flat_nodes.take(b)
            is_leaf = w <= v
            flat_parent[np.where(is_leaf, a + to_leaf[:k], b + to_node[:k])] = made
            total = total + np.minimum(w, v)
            a += is_leaf
            b += ~is_leaf
        nodes[:k, made] = total
    depth = np.zeros((rows, wide), np.int64)
    base = np.arange(rows) * wide
    for made in range(most - 3, -1, -1):
        k = int(active[made + 1])  # rows whose root is a later node
        depth[:k, made] = depth.ravel().take(base[:k] + parent[:k, wide + made]) + 1
    return depth.ravel().take(base[:, None] + parent[:, :most]) + 1


def sorted_pairs(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values above 0 and their columns, by value and column, in ``most`` columns; 0 where a row has no more."""
    kind = np.uint32 if values.max(initial=0) < 1 << 20 else np.uint64
    keys = np.where(values > 0, values.astype(kind) << kind(12) | np.arange(values.shape[1], dtype=kind), ~kind(0))
    keys.sort(axis=1)
    keys = keys[:, :most]
    keys[keys == ~kind(0)] = 0
    return (keys >> kind(12)).astype(np.int64), (keys & kind(4095)).astype(np.int64)


def in_code_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their lengths, their spans of a row's longest window) by length and symbol; 0 where a row has no more."""
    sizes, symbols = sorted_pairs(lengths, max(1, int((lengths > 0).sum(axis=1).max())))
    return symbols, sizes, np.where(sizes > 0, 1 << np.maximum(0, lengths.max(axis=1)[:, None] - sizes), 0)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """webp.codes_of for each row."""
    symbols, sizes, span = in_code_order(lengths)
    starts = REVERSED.take((np.cumsum(span, axis=1) - span) & 0x7FFF) >> (15 - lengths.max(axis=1))[:, None]
    out = np.zeros_like(lengths)
    row, column = np.nonzero(sizes)
    out[row, symbols[row, column]] = starts[row, column]
    return out


class Pieces:
    """Groups of (value, number of bits) for each file, packed file by file in the order in which they're added."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def add(self, counts: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append((counts, values, sizes))

    def same(self, values: list[int], sizes: list[int]) -> None:
        """The same for all files."""
        self.add(np.full(self.n, len(values)), np.tile(np.array(values, np.int64), self.n), np.tile(np.array(sizes, np.int64), self.n))

    def data(self) -> list[bytes]:
        counts = np.stack([p[0] for p in self.parts], axis=1)
        offsets = starts_of(counts.ravel()).reshape(counts.shape)
        values, sizes = np.empty((2, int(counts.sum())), np.int64)
        for k, (c, v, s) in enumerate(self.parts):
            place = np.repeat(offsets[:, k] - starts_of(c), c) + np.arange(len(v))
            values[place], sizes[place] = v, s
        each = counts.sum(axis=1)
        n_bits = np.add.reduceat(sizes, offsets[:, 0])
        words = (n_bits + 63) >> 6
        base = starts_of(words)
        at = starts_of(sizes) + np.repeat(64 * base - starts_of(n_bits), each)
        at, values, sizes = at[sizes > 0], values[sizes > 0].view(np.uint64), sizes[sizes > 0]
        word, shift = at >> 6, (at & 63).view(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out = np.zeros(int(words.sum()), np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        packed = out.astype("<u8", copy=False).tobytes()
        return [packed[8 * b : 8 * b + (n + 7 >> 3)] for b, n in zip(base.tolist(), n_bits.tolist())]


def write_prefixes(w: Pieces, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """webp.write_prefix for each file's row of ``counts``."""
    rows, size = counts.shape
    used = (counts > 0).sum(axis=1)
    first, last = (counts > 0).argmax(axis=1), size - 1 - (counts[:, ::-1] > 0).argmax(axis=1)
    lone = used < 2
    first, last = np.where(used == 0, 0, first), np.where(used == 0, 0, last)
    few = (used <= 2) & (last < 256)
    lengths, codes = np.zeros((2, rows, size), np.int64)
    two = np.flatnonzero(few & ~lone)
    lengths[two, first[two]] = lengths[two, last[two]] = codes[two, last[two]] = 1
    pieces = np.where(few, np.where(lone, 2, 3), 0)
    own = np.flatnonzero(~few)
    if len(own):
        if lone[own].any():
            raise ValueError("a lone symbol above 255 is not written for many images")
        lengths[own] = code_lengths(counts[own], 15)
        codes[own] = codes_of(lengths[own])
        token_row, symbol, extra, extra_bits = tokens_of(lengths[own])
        inner_counts = np.bincount(token_row * 19 + symbol, minlength=len(own) * 19).reshape(-1, 19)
        inner = np.zeros_like(inner_counts)
        many = (inner_counts > 0).sum(axis=1) > 1
        inner[~many] = inner_counts[~many] > 0
        if many.any():
            inner[many] = code_lengths(inner_counts[many], 7)
        inner_codes, inner_sizes = codes_of(inner), np.where(many[:, None], inner, 0)
        n = np.bincount(token_row, minlength=len(own))
        pieces[own] = 21 + n
    values, sizes = np.empty((2, int(pieces.sum())), np.int64)
    start = starts_of(pieces)
    at = start[few]
    values[at], sizes[at] = np.where(lone[few], 5, 7), 3
    values[at + 1], sizes[at + 1] = first[few], 8
    at = start[two]
    values[at + 2], sizes[at + 2] = last[two], 8
    if len(own):
        at = start[own]
        values[at], sizes[at] = 30, 5
        at = at[:, None] + np.arange(1, 20)
        values[at], sizes[at] = inner[:, list(LENGTH_ORDER)], 3
        values[start[own] + 20], sizes[start[own] + 20] = 0, 1
        at = np.repeat(start[own] + 21, n) + within(n)
        code, bits = inner_codes[token_row, symbol], inner_sizes[token_row, symbol]
        values[at], sizes[at] = np.where(bits > 0, code, 0) | extra << bits, bits + extra_bits
    w.add(pieces, values, sizes)
    return codes, lengths


def tokens_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths as runs: (row, symbol, extra, its bits), row by row."""
    rows, size = lengths.shape
    edge = np.ones((rows, size), bool)
    edge[:, 1:] = lengths[:, 1:] != lengths[:, :-1]
    begins = np.flatnonzero(edge)
    run = np.diff(begins, append=rows * size)
    value, row = lengths.ravel()[begins], begins // size
    zero = value == 0
    head, full = np.where(zero, 0, 1), np.where(zero, 138, 6)
    whole, rest = np.divmod(run - head, full)
    n = head + whole + np.where(rest >= 3, 1, rest)
    k = within(n)
    value, zero, head, whole, rest = (np.repeat(x, n) for x in (value, zero, head, whole, rest))
    is_full, is_rest = (k >= head) & (k < head + whole), (k >= head + whole) & (rest >= 3)
    length = np.where(is_full, np.where(zero, 138, 6), rest)
    symbol = np.where(is_full | is_rest, np.where(zero, np.where(length >= 11, 18, 17), 16), value)
    extra = np.where(is_full | is_rest, length - RUN_LEAST[symbol], 0)
    return np.repeat(row, n), symbol, extra, RUN_BITS[symbol]


def write_colours(w: Pieces, counts: np.ndarray, colours: np.ndarray, alpha: int, main: bool, cache_bits: int = 0) -> None:
    """webp.write_colours; ``colours`` are red, green and blue (uint8) of all images' pixels, ``counts`` how many each has."""
    red, green, blue = colours
    owner, symbols = np.repeat(np.arange(len(counts)), counts), green.astype(np.int64)
    size = GREEN + (1 << cache_bits if cache_bits else 0)
    literal = None
    if cache_bits:
        flat = red.astype(np.uint32) << np.uint32(16) | green.astype(np.uint32) << np.uint32(8) | blue | np.uint32(alpha << 24)
        slots = (flat * np.uint32(webp.CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        order = in_order(owner, slots, cache_bits, len(counts))
        key, colour = (owner[order] << cache_bits) + slots[order], flat[order]
        hit = np.zeros(len(flat), bool)
        hit[order[1:]] = (key[1:] == key[:-1]) & (colour[1:] == colour[:-1])
        symbols[hit] = GREEN + slots[hit].astype(np.int64)
        literal = ~hit
        w.same([1, cache_bits], [1, 4])
    else:
        w.same([0], [1])
    if main:
        w.same([0], [1])
    value, bits = None, None
    for channel, n in ((symbols, size), (red, OTHER), (blue, OTHER)):
        place = owner * n + channel
        counted = place if channel is symbols or literal is None else place[literal]
        codes, lengths = write_prefixes(w, np.bincount(counted, minlength=len(counts) * n).reshape(-1, n))
        code, length = codes.ravel().take(place), lengths.ravel().take(place)
        if value is None:
            value, bits = code, length
        else:
            if literal is not None:
                code *= literal
                length *= literal
            value |= code << bits
            bits += length
    w.same([5, alpha, 5, 0], [3, 8, 3, 8])  # one alpha, no distances
    w.add(counts, value, bits)


def in_order(owner: np.ndarray, slots: np.ndarray, cache_bits: int, n: int) -> np.ndarray:
    """Pixels by image and cache slot, else as they come."""
    key = (owner << cache_bits) + slots
    return np.argsort(key.astype(np.uint16) if n << cache_bits <= 1 << 16 else key, kind="stable")


# ---- transforms


class Stack:
    """Images of one width, one below the other.  ``lanes`` are arrays (channel, column within a tile, row and tile)."""

    def __init__(self, heights: np.ndarray, width: int):
        self.heights, self.width, self.across = heights, width, width // SIDE
        self.rows, self.first = int(heights.sum()), starts_of(heights)
        self.down = -(-heights // SIDE)
        local = within(heights)
        self.tile_row = np.repeat(starts_of(self.down), heights) + local // SIDE
        self.tile_starts = np.flatnonzero(local % SIDE == 0)
        self.up = np.arange(self.rows) - 1  # the first row's is the image's last, as in webp.apply_predictor
        self.up[self.first] += heights

    def lanes(self, flat: np.ndarray) -> np.ndarray:
        """From pixels (row and column, channel)."""
        return np.ascontiguousarray(flat.reshape(self.rows * self.across, SIDE, -1).transpose(2, 1, 0))

    def flat(self, lanes: np.ndarray) -> np.ndarray:
        """To (channel, pixels row by row)."""
        return np.ascontiguousarray(lanes.transpose(0, 2, 1)).reshape(len(lanes), -1)

    def sums(self, cost: np.ndarray) -> np.ndarray:
        """Each tile's sum."""
        by_row = cost.sum(axis=0, dtype=np.int32).reshape(self.rows, self.across)
        return np.add.reduceat(by_row, self.tile_starts, axis=0)

    def spread(self, tiles: np.ndarray) -> np.ndarray:
        """A tile's value for each row and tile."""
        return tiles[self.tile_row].ravel()


def size_of(x: np.ndarray) -> np.ndarray:
    """Distance of bytes from 0, modulo 256."""
    return np.minimum(x, np.uint8(0) - x)


def cross(element: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return ((element.astype(np.uint8).view(np.int8).astype(np.int16) * colour.view(np.int8)) >> 5).astype(np.uint8)


def apply_cross_colour(s: Stack, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """webp.apply_cross_colour: (residual lanes, elements' red, green and blue)."""
    tries = np.array([-16, -8, 0, 8, 16])

    def best(colour, by):
        return tries[np.argmin(np.stack([s.sums(size_of(colour - cross(t, by))) for t in tries]), axis=0)]

    red, green, blue = c
    to_red, to_blue = best(red, green), best(blue, green)
    blue = blue - cross(s.spread(to_blue), green)
    red_to_blue = best(blue, red)
    out = np.stack([red - cross(s.spread(to_red), green), green, blue - cross(s.spread(red_to_blue), red)])
    return out, np.stack([red_to_blue, to_blue, to_red]).astype(np.uint8)


def apply_predictor(s: Stack, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """webp.apply_predictor with all modes: (residual lanes, tiles' modes)."""
    shape = (3, SIDE, s.rows, s.across)

    def to_the_left(x):
        return np.concatenate([np.roll(x.reshape(shape)[:, -1:], 1, axis=3).reshape(3, 1, -1), x[:, :-1]], axis=1)

    above = c.reshape(shape)[:, :, s.up].reshape(c.shape)
    past = np.roll(above.reshape(shape)[:, :1], -1, axis=3)
    past[:, 0, :, -1] = c.reshape(shape)[:, 0, :, 0]
    right = np.concatenate([above[:, 1:], past.reshape(3, 1, -1)], axis=1)
    near = [x.astype(np.int16) for x in (to_the_left(c), above, to_the_left(above), right)]
    costs = []
    for m in range(14):
        guess = webp.predict(m, *near, axis=0).astype(np.uint8) if m else np.zeros_like(c)
        costs.append(s.sums(size_of(c - guess).sum(axis=0, dtype=np.uint16)))
    chosen = np.argmin(np.stack(costs), axis=0)
    mode = s.spread(chosen)
    rest = np.empty_like(c)
    for m in range(14):
        if len(at := np.flatnonzero(mode == m)):
            one = c[:, :, at]
            rest[:, :, at] = one - webp.predict(m, *(x[:, :, at] for x in near), axis=0).astype(np.uint8) if m else one
    by_row, plain = rest.reshape(shape), c.reshape(shape)
    left = near[0].reshape(shape)
    by_row[:, 0, :, 0] = plain[:, 0, :, 0] - above.reshape(shape)[:, 0, :, 0]
    by_row[:, :, s.first] = plain[:, :, s.first] - left[:, :, s.first].astype(np.uint8)
    by_row[:, 0, s.first, 0] = plain[:, 0, s.first, 0]
    return rest, chosen.astype(np.uint8)


def encode(parts: list[np.ndarray], width: int) -> list[bytes]:
    """Files of byte arrays, each three bytes a pixel and whole rows: webp.encode_colours of each."""
    s = Stack(np.array([len(p) // (3 * width) for p in parts]), width)
    c = s.lanes(np.concatenate(parts).reshape(-1, 3))
    c[0] -= c[1]
    c[2] -= c[1]
    w = Pieces(len(parts))
    w.same([0x2F, width - 1], [8, 14])
    w.add(np.ones(w.n, np.int64), s.heights - 1, np.full(w.n, 14))
    w.same([0, 0, 1, webp.SUBTRACT_GREEN, 1, webp.CROSS_COLOUR, webp.TILE_BITS - 2], [1, 3, 1, 2, 1, 2, 3])
    rest, elements = apply_cross_colour(s, c)
    tiles = s.down * s.across
    write_colours(w, tiles, elements.reshape(3, -1), 255, False)
    w.same([1, webp.PREDICTOR, webp.TILE_BITS - 2], [1, 2, 3])
    rest, modes = apply_predictor(s, rest)
    nothing = np.zeros(modes.size, np.uint8)
    write_colours(w, tiles, np.stack([nothing, modes.ravel(), nothing]), 255, False)
    w.same([0], [1])
    write_colours(w, s.heights * width, s.flat(rest), 0, True, webp.CACHE_BITS)
    return [webp.riff(d) for d in w.data()]


def chunks(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges with PIXELS_AT_ONCE together, or one item."""
    start, total, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if total and total + n > PIXELS_AT_ONCE:
            yield start, k
            start, total = k, 0
        total += n
    if k >= start:
        yield start, k + 1


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """webp.encode_payload of each."""
    by_width: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for k, payload in enumerate(payloads):
        for raw, width in webp.colour_parts(np.frombuffer(payload, np.uint8)):
            by_width.setdefault(width, []).append((k, webp.filled(raw, 3 * width), len(raw)))
    files: list[list[bytes]] = [[] for _ in payloads]
    for width, parts in by_width.items():
        for a, b in chunks(len(p[1]) // 3 for p in parts):
            for (k, full, n), media in zip(parts[a:b], encode([p[1] for p in parts[a:b]], width)):
                files[k].append(webp.with_length(media, n) if n < len(full) else media)
    return [b"".join(f) for f in files]


# ---- reading


class Streams:
    """Bit streams that are read in step; ``ok`` is False for those that turn out to be in another form."""

    def __init__(self, data: list[bytes]):
        raw = np.frombuffer(b"".join(d + bytes(16) for d in data) + bytes(16), np.uint8)
        sizes = np.array([len(d) + 16 for d in data])
        self.words = np.zeros(len(raw) - 8, np.int64)  # the eight bytes from each one on
        for k in range(8):
            self.words |= raw[k : k + len(self.words)].astype(np.int64) << 8 * k
        self.most = 8 * (len(self.words) - 1)
        self.at = 8 * starts_of(sizes)
        self.end = self.at + 8 * (sizes - 16)
        self.ok = np.ones(len(data), bool)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits that follow."""
        return self.words.take(at >> 3) >> (at & 7)

    def read(self, n: int, rows=slice(None)) -> np.ndarray:
        at = self.at[rows].copy()
        self.at[rows] = np.minimum(at + n, self.most)
        return self.peek(at) & ((1 << n) - 1)

    def want(self, good: np.ndarray, rows=slice(None)) -> None:
        self.ok[rows] &= good


class Codes:
    """Prefix codes of many images: ``table[base + (window & mask)]`` is symbol * 16 + length."""

    def __init__(self, s: Streams, lengths: np.ndarray, rows=slice(None)):
        used = (lengths > 0).sum(axis=1)
        longest = np.where(used > 1, lengths.max(axis=1), 0)
        symbols, sizes, span = in_code_order(lengths)
        good = (used == 1) | (used > 1) & (span.sum(axis=1) == 1 << longest)
        s.want(good, rows)
        self.base, self.mask = np.zeros((2, len(lengths)), np.int64)
        self.only = np.where(longest == 0, symbols[:, 0], -1)
        tables, total = [np.zeros(1, np.int32)], 1  # the first entry is for rows without a code
        for n in np.unique(longest).tolist():
            of = np.flatnonzero((longest == n) & good)
            if n == 0:
                tables.append(self.only[of] * 16)
            else:
                entries = np.repeat((symbols[of] * 16 + sizes[of]).ravel(), span[of].ravel()).reshape(len(of), 1 << n)
                tables.append(entries.astype(np.int32)[:, webp.REVERSED[n]].ravel())
            self.base[of], self.mask[of] = total + (np.arange(len(of)) << n), (1 << n) - 1
            total += len(of) << n
        self.table = np.concatenate(tables).astype(np.int32, copy=False)


def read_lengths(s: Streams, size: int) -> np.ndarray:
    """Code lengths of the prefix code that comes next in each stream."""
    n = len(s.at)
    out = np.zeros((n, size), np.int64)
    simple = s.read(1) == 1
    few = np.flatnonzero(simple)
    if len(few):
        two, wide = s.read(1, few), s.read(1, few)
        bits = np.where(wide == 1, 8, 1)
        first = s.peek(s.at[few]) & ((1 << bits) - 1)
        s.at[few] += bits
        second = np.where(two == 1, s.peek(s.at[few]) & 255, first)
        s.at[few] += 8 * two
        good = np.maximum(first, second) < size
        s.want(good, few)
        out[few[good], first[good]] = out[few[good], second[good]] = 1
        out[few[~good], 0] = 1
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out
    n_inner = 4 + s.read(4, rows)
    inner = np.zeros((len(rows), 19), np.int64)
    for k, symbol in enumerate(LENGTH_ORDER):
        has = n_inner > k
        inner[:, symbol] = np.where(has, s.peek(s.at[rows]) & 7, 0)
        s.at[rows] += 3 * has
    s.want(s.read(1, rows) == 0, rows)  # as many lengths as symbols
    codes = Codes(s, inner, rows)
    table = codes.table.astype(np.int64)
    bits = (table & 15) + RUN_BITS[table >> 4]  # those of the symbol and its extra bits
    at, begin, stop = s.at[rows].copy(), s.at[rows], s.end[rows]
    entries, windows, done = [], [], np.zeros(len(rows), np.int64)
    while (done < size).any() and len(entries) * LENGTHS_AT_ONCE < size:
        entry, window = np.empty((2, LENGTHS_AT_ONCE, len(rows)), np.int64)
        for k in range(LENGTHS_AT_ONCE):
            w = s.peek(at)
            e = codes.base + (w & codes.mask)
            entry[k], window[k] = e, w
            at += bits.take(e)
            np.minimum(at, s.most, out=at)
        symbol, own = table.take(entry) >> 4, table.take(entry) & 15
        done += (RUN_LEAST[symbol] + (window >> own & ((1 << RUN_BITS[symbol]) - 1))).sum(axis=0)
        entries.append(entry)
        windows.append(window)
    entry, window = np.concatenate(entries).T, np.concatenate(windows).T
    symbol, own = table.take(entry) >> 4, table.take(entry) & 15
    run = RUN_LEAST[symbol] + (window >> own & ((1 << RUN_BITS[symbol]) - 1))
    before = np.cumsum(run, axis=1) - run
    own_ones = before < size
    run = np.where(own_ones, run, 0)
    taken = begin + np.where(own_ones, bits.take(entry), 0).sum(axis=1)
    good = (run.sum(axis=1) == size) & (taken <= stop)
    s.want(good, rows)
    s.at[rows] = np.minimum(taken, s.most)
    # symbol 16 repeats the last length that isn't 0, at first 8
    last = np.maximum.accumulate(np.where((symbol > 0) & (symbol < 16), np.arange(symbol.shape[1]), -1), axis=1)
    value = np.where(symbol < 16, symbol, 0)
    repeated = np.where(last < 0, 8, np.take_along_axis(symbol, np.maximum(last, 0), axis=1))
    value = np.where(symbol == 16, repeated, value)
    out[rows[good]] = np.repeat(value[good].ravel(), run[good].ravel()).reshape(-1, size)
    out[rows[~good], 0] = 1
    return out


def read_pixels(s: Streams, counts: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """(red, green and blue, alpha of each image) of the images that come next; ``counts`` (falling) are their pixels."""
    cached, some = s.read(1), int(s.ok.argmax())  # the cache's size is that of the first image in our form
    cache_bits = int(s.peek(s.at)[some] & 15) if cached[some] else 0
    s.want((cached == cached[some]) & (cache_bits <= 11))
    if cached[some]:
        s.want(s.read(4) == cache_bits)
    if main:
        s.want(s.read(1) == 0)  # no groups by tile
    size = GREEN + (1 << cache_bits if cache_bits else 0)
    green, red, blue, alpha, _ = (Codes(s, read_lengths(s, n)) for n in (size, OTHER, OTHER, OTHER, DISTANCE))
    s.want(alpha.only >= 0)
    total, n = int(counts.sum()), len(counts)
    owner = np.repeat(np.arange(n), counts)
    at = pixel_starts(s, (green, red, blue), counts)
    w = s.peek(at)
    seen = []
    for c in (green, red, blue):
        e = c.table.take(c.base.take(owner) + (w & c.mask.take(owner)))
        if c is not green:
            e *= seen[0] < 4096  # symbols from 256 on have no further colours
        w >>= e & 15
        at += e & 15
        seen.append(e)
    s.at = at[np.cumsum(counts) - 1]
    s.want(s.at <= s.end)
    s.at = np.minimum(s.at, s.most)
    symbols, colours = seen[0] >> 4, np.stack([seen[1] >> 4, seen[0] >> 4, seen[2] >> 4]).astype(np.uint8)
    s.ok[owner[(symbols >= 256) & (symbols < GREEN)]] = False  # back-references
    if cache_bits:
        hit = symbols >= GREEN
        red, green, blue = colours.astype(np.uint32)
        flat = np.repeat((alpha.only & 255).astype(np.uint32), counts) << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue
        slots = (flat * np.uint32(webp.CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        slots[hit] = symbols[hit] - GREEN
        order = in_order(owner, slots, cache_bits, n)
        key, is_hit = ((owner << cache_bits) + slots)[order], hit[order]
        source = np.maximum.accumulate(np.where(is_hit, 0, np.arange(total)))  # the last colour of the same slot
        s.ok[owner[order[(key[source] != key) | is_hit[source]]]] = False  # a slot never filled
        colours[:, order[is_hit]] = colours[:, order[source[is_hit]]]
    return colours, alpha.only


class Steps:
    """From the bit where a pixel starts to the next one's."""

    def __init__(self, s: Streams, codes: tuple[Codes, Codes, Codes]):
        self.s, self.codes = s, codes
        tables = [(c.table & 15).astype(np.int64) for c in codes]
        tables[0][codes[0].table >= 4096] += 64  # no further colours: the window is shifted out
        self.tables = tables

    def of(self, images: np.ndarray):
        """The step for lanes of these images: their places -> their next places, in place."""
        (g, r, b), words = self.tables, self.s.words
        (g_base, g_mask), (r_base, r_mask), (b_base, b_mask) = ((c.base[images], c.mask[images]) for c in self.codes)

        def step(p):
            w = words.take(p >> 3, mode="clip")
            w >>= p & 7
            own = w & g_mask
            own += g_base
            own = g.take(own)
            literal = own < 64
            own &= 63
            w >>= own
            more = w & r_mask
            more += r_base
            more = r.take(more)
            w >>= more
            w &= b_mask
            w += b_base
            more += b.take(w)
            more *= literal
            own += more
            p += own

        return step

    def follow(self, image: int, p: int, most: int, stop) -> list[int]:
        """Places from ``p`` on, one after the other, before ``stop(place)`` holds; the last one is where it did or ``most`` ended it."""
        words = self.s.words
        (g, r, b), ((g0, gm), (r0, rm), (b0, bm)) = self.tables, [(int(c.base[image]), int(c.mask[image])) for c in self.codes]
        out = [p]
        while len(out) <= most and not stop(p):
            w = int(words[p >> 3]) >> (p & 7)
            own = int(g[g0 + (w & gm)])
            if own < 64:
                w >>= own
                more = int(r[r0 + (w & rm)])
                own += more + int(b[b0 + (w >> more & bm)])
            p += own & 63
            out.append(p)
        return out


def pixel_starts(s: Streams, codes: tuple[Codes, Codes, Codes], counts: np.ndarray) -> np.ndarray:
    """The bit at which each pixel starts, image by image.

    Where a pixel starts is known only from the one before, but reading from any bit soon falls into step with the true
    pixels.  So each image is read from several bits at once: a lane goes from its own bit to the next lane's, then on to
    the first place where a later lane has been.  From an image's first lane on, these ends lead along the true pixels.
    """
    steps, n = Steps(s, codes), len(counts)
    widest = codes[0].mask | codes[1].mask | codes[2].mask
    most = sum((c.mask > 0) * np.log2(c.mask + 1).astype(np.int64) for c in codes)  # bits of a pixel
    begin, end = s.at, np.where(s.ok, np.minimum(s.end, s.at + counts * most), s.at)
    moving = np.flatnonzero((widest > 0) & (end > begin))
    lanes_of = np.zeros(n, np.int64)
    lanes_of[moving] = -(-(end - begin)[moving] // LANE_BITS)
    first_lane, image = starts_of(lanes_of), np.repeat(np.arange(n), lanes_of)
    own = begin[image] + within(lanes_of) * LANE_BITS
    last = end[image]
    limit = np.minimum(own + LANE_BITS, last)
    # where each lane goes before its limit
    room = end - begin
    shift = starts_of(room) - begin  # from a bit of an image to its place among the bits of all of them
    move = shift[image]
    been, passed = np.zeros(int(room.sum()), bool), own.copy()
    first_parts = []
    for lane, places in walk(steps, image, own, lambda lane, places: places >= limit[lane]):
        inside = places < limit[lane]
        been[(places + move[lane])[inside]] = True
        first_parts.append((lane, places))
        passed[lane] = places[np.minimum(inside.sum(axis=0), len(places) - 1), np.arange(len(lane))]
    # and then, until another lane has been there; after OVERHANG bits that is left open
    beyond, joined = np.flatnonzero(passed < last), passed.copy()
    second_parts = []
    over = lambda lane, places: been.take(places + move[lane], mode="clip") | (places >= last[lane]) | (places >= passed[lane] + OVERHANG)
    for k, places in walk(steps, image[beyond], passed[beyond], lambda k, places: over(beyond[k], places)):
        lane = beyond[k]
        inside = np.cumsum(over(lane, places), axis=0) == 0
        second_parts.append((lane, places, inside))
        joined[lane] = places[np.minimum(inside.sum(axis=0), len(places) - 1), np.arange(len(lane))]
    # the way of each image over its lanes
    enter = np.full(len(own), FAR, np.int64)
    chain = np.zeros(len(been), bool)
    ends, joins = last.tolist(), joined.tolist()
    for i, b, f, to in zip(moving.tolist(), begin[moving].tolist(), first_lane[moving].tolist(), shift[moving].tolist()):
        place, stop = b, ends[f]
        while place < stop:
            k = f + (place - b) // LANE_BITS
            enter[k], place = place, joins[k]
            if place < stop and not been[place + to]:
                more = steps.follow(i, place, int(counts[i]), lambda p: p >= stop or been[p + to])
                chain[[p + to for p in more[:-1]]] = True
                place = more[-1]
                if place < stop and not been[place + to]:
                    break
    for lane, places in first_parts:
        chain[(places + move[lane])[(places >= enter[lane]) & (places < limit[lane])]] = True
    for lane, places, inside in second_parts:
        chain[(places + move[lane])[inside & (enter[lane] < FAR)]] = True
    found = np.flatnonzero(chain)
    before = np.searchsorted(found, begin + shift)
    has = np.searchsorted(found, end + shift) - before
    s.ok[(widest > 0) & (has < counts)] = False  # the stream ends too early
    out = np.repeat(begin, counts)
    good = np.flatnonzero((widest > 0) & (has >= counts))
    to = np.repeat(starts_of(counts)[good], counts[good]) + within(counts[good])
    out[to] = found[np.repeat(before[good], counts[good]) + within(counts[good])] - np.repeat(shift[good], counts[good])
    return out


def walk(steps: Steps, images: np.ndarray, at: np.ndarray, done) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lanes, their next places: steps x lanes) until all are ``done`` at their last one."""
    lane, p = np.arange(len(at)), at.copy()
    while len(lane):
        step, places = steps.of(images[lane]), np.empty((STEPS_AT_ONCE + 1, len(lane)), np.int64)
        for k in range(STEPS_AT_ONCE):
            places[k] = p
            step(p)
        places[STEPS_AT_ONCE] = p
        yield lane, places
        going = ~done(lane, places).any(axis=0)
        lane, p = lane[going], p[going]


def undo_predictor(rest: np.ndarray, heights: np.ndarray, width: int, modes: np.ndarray) -> np.ndarray:
    """Pixels (0x00RRGGBB) of residuals (red, green, blue); ``modes`` has one for each pixel.

    A row follows two pixels behind the one above it, so that all rows of all images move on together; images by falling height.
    """
    first, local = np.repeat(starts_of(heights), heights), within(heights)
    start = (first + local) * width
    red, green, blue = rest.astype(np.uint32)
    queue = modes.astype(np.uint32) << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue
    # The image's first row takes the left pixel, every other first column the upper one.
    queue[start] = queue[start] & np.uint32(0xFFFFFF) | np.uint32(2 << 24)
    top_rows = (start[local == 0][:, None] + np.arange(1, width)).ravel()
    queue[top_rows] = queue[top_rows] & np.uint32(0xFFFFFF) | np.uint32(1 << 24)
    queue[start[local == 0]] &= np.uint32(0xFFFFFF)
    present = sorted({0, *np.flatnonzero(np.bincount(queue >> np.uint32(24), minlength=16)).tolist()})
    slot = np.zeros(16, np.int64)
    slot[present] = np.arange(len(present))
    # Lanes are rows by their number in the image, those of one number in the images' order.
    n, tallest = len(heights), int(heights[0])
    order = np.argsort(local, kind="stable")
    y, base = local[order], start[order] - 2 * local[order]
    edges = np.searchsorted(y, np.arange(tallest + 1))
    image = np.repeat(np.arange(n), heights)[order]
    up = np.where(y > 0, edges[np.maximum(y - 1, 0)] + image, np.arange(len(y)))
    lanes = len(y)
    now, top, top_right = (np.zeros((3, lanes), np.int16) for _ in range(3))
    opening = np.zeros((3, lanes), np.int16)  # each row's own first pixel
    out = np.zeros(len(queue), np.uint32)
    for t in range(width + 2 * (tallest - 1)):
        lo, hi = int(edges[max(0, -(-(t - width + 1) // 2))]), int(edges[min(tallest - 1, t // 2) + 1])
        if lo >= hi:
            continue
        at = base[lo:hi] + t
        q = queue.take(at)
        top_left, top = top, top_right
        top_right = now.take(up, axis=1)
        # A row that has come to its last column sees its own first pixel at the upper right.
        if t >= width - 1 and (t - width + 1) % 2 == 0:
            a, b = int(edges[(t - width + 1) // 2]), int(edges[(t - width + 1) // 2 + 1])
            top_right[:, a:b] = opening[:, a:b]
        near = [x[:, lo:hi] for x in (now, top, top_left, top_right)]
        guesses = np.empty((len(present), 3, hi - lo), np.int16)
        for k, m in enumerate(present):
            guesses[k] = webp.predict(m, *near, axis=0) if 0 < m < 14 else 0
        mode = slot.take(q >> np.uint32(24))
        guess = guesses.reshape(-1).take(mode * (3 * (hi - lo)) + (np.arange(3) * (hi - lo))[:, None] + np.arange(hi - lo))
        guess[0] += (q >> np.uint32(16) & np.uint32(255)).astype(np.int16)
        guess[1] += (q >> np.uint32(8) & np.uint32(255)).astype(np.int16)
        guess[2] += (q & np.uint32(255)).astype(np.int16)
        guess &= 255
        now = now.copy()
        now[:, lo:hi] = guess
        if t % 2 == 0 and t // 2 < tallest:  # rows that begin
            a, b = int(edges[t // 2]), int(edges[t // 2 + 1])
            opening[:, a:b] = guess[:, a - lo : b - lo]
        r, g, b = guess.astype(np.uint32)
        out[at] = r << np.uint32(16) | g << np.uint32(8) | b
    return out


def decode(files: list[bytes]) -> list[np.ndarray | None]:
    """webp.decode of each file in the writer's form, None for others."""
    out: list[np.ndarray | None] = [None] * len(files)
    heads: dict[int, list[tuple[int, int]]] = {}
    for k, f in enumerate(files):
        if len(f) > 30 and f[:4] == b"RIFF" and f[8:16] == b"WEBPVP8L" and f[20] == 0x2F:
            word = int.from_bytes(f[21:25], "little")
            width, height = (word & 16383) + 1, (word >> 14 & 16383) + 1
            if width % SIDE == 0 and width * height <= 2 * webp.COLOUR_PIXELS and word >> 29 == 0:
                heads.setdefault(width, []).append((height, k))
    for width, images in heads.items():
        images.sort(key=lambda x: (-x[0], x[1]))
        for a, b in chunks(h * width for h, _ in images):
            some = images[a:b]
            decoded = decode_chunk([files[k][20 : 20 + struct.unpack("<I", files[k][16:20])[0]] for _, k in some], np.array([h for h, _ in some]), width)
            for (_, k), argb in zip(some, decoded):
                out[k] = argb
    return out


def decode_chunk(data: list[bytes], heights: np.ndarray, width: int) -> list[np.ndarray | None]:
    """Images of one width, by falling height."""
    s, stack = Streams(data), Stack(heights, width)
    s.at += 40  # signature and size were read
    tiles = stack.down * stack.across
    tile = webp.TILE_BITS - 2
    s.want((s.read(6) == (1 | webp.SUBTRACT_GREEN << 1 | 1 << 3 | webp.CROSS_COLOUR << 4)) & (s.read(3) == tile))
    elements, _ = read_pixels(s, tiles, False)
    s.want((s.read(3) == (1 | webp.PREDICTOR << 1)) & (s.read(3) == tile))
    modes, _ = read_pixels(s, tiles, False)
    s.want(s.read(1) == 0)
    rest, alpha = read_pixels(s, heights * width, True)
    s.want(alpha == 0)  # else not opaque
    spread = np.repeat(stack.spread(modes[1].reshape(-1, stack.across) & 15), SIDE)
    argb = undo_predictor(rest, heights, width, spread)
    red, green, blue = ((argb >> np.uint32(k)).astype(np.uint8) for k in (16, 8, 0))
    red_to_blue, to_blue, to_red = (np.repeat(stack.spread(e.reshape(-1, stack.across)), SIDE) for e in elements)
    red += cross(to_red, green)
    blue += cross(to_blue, green)
    blue += cross(red_to_blue, red)
    red += green
    blue += green
    argb = np.uint32(OPAQUE) | red.astype(np.uint32) << np.uint32(16) | green.astype(np.uint32) << np.uint32(8) | blue
    by_row = argb.reshape(-1, width)
    return [by_row[f : f + h] if good else None for f, h, good in zip(stack.first.tolist(), heights.tolist(), s.ok.tolist())]


def decode_payloads(media: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """webp.decode_payload of each."""
    files, places = [], []
    for m in media:
        parts = webp.files_of(m)
        places.append((len(files), len(files) + len(parts)))
        files += parts
    images, out = decode(files), []
    for m, (a, b) in zip(media, places):
        if any(x is None for x in images[a:b]):
            out.append(webp.decode_payload(m))
            continue
        raw = [np.ascontiguousarray(x).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes() for x in images[a:b]]
        payload = b"".join(r[: webp.stored_length(f, len(r))] for f, r in zip(files[a:b], raw))
        out.append((images[a] if b - a == 1 else np.concatenate(images[a:b]), payload))
    return out
