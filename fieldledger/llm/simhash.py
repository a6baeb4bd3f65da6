"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's bits are dealt into partitions so that correlated bits share one.  If two fingerprints
differ in at most MAX_DISTANCE bits and the partitions' thresholds t satisfy sum(t + 1) =
MAX_DISTANCE + 1, then in some partition they differ in at most t bits (t = -1 leaves a partition
out).  How many partitions, and their unequal thresholds, come from a dynamic program over candidate
counts estimated on a bounded sample.  Each fingerprint stands in a bucket for its own bits of a
partition, and probes the buckets that differ from it in up to t bits; what meets in a bucket is
verified on all 64 bits.  Any sample gives complete results: it only moves the cost.

Corpora are cleaned by another rule, the exact Jaccard similarity of five-word shingles
(``drop_near_duplicates``), checked on candidates: sets whose fingerprints link by the same probes, and,
as texts at a similarity of 0.8 differ in 10 bits of a fingerprint on average and often in more, which
is too wide a radius to probe, also sets that share one of BANDS keys of BAND_ROWS least hashes each;
a pair at 0.8 shares none with a probability of 4e-7.

Equal fingerprints are one node from the start.  A bucket gives links enough to connect what it
connects (a forest), never all pairs of a group: a member already reached isn't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.base import SLICE_ROWS, add_columns, boxed, cut, join_by_weight, read_table, written

SHINGLE, SEED, BITS, MAX_DISTANCE = 4, 42, 64, 4
PARTITIONS = (2, 3, 4)
#: Fingerprints in the sample for the estimates.
SAMPLE = 20_000
#: What a probe's row and a candidate's comparison cost, in the same unit.
PROBE_COST, COMPARE_COST = 1.0, 0.02
#: Buckets expected to hold more fingerprints than this are dealt out over several tasks.
BUCKET_ROWS = 50_000
#: Buckets up to this many comparisons are compared at once.
MATRIX = 1 << 16

#: Near copies: words a shingle, and the least similarity as a fraction.
NEAR_SHINGLE, NEAR = 5, (4, 5)
BANDS, BAND_ROWS = 28, 4
#: Odd multipliers, two for each order in which a least hash is taken.
ORDERS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Clusters with more shingles than this are compared by pairs of blocks.
CLUSTER_SHINGLES = 2_000_000
#: Up to this many candidates are sent to the tasks; beyond, texts are shuffled to them.
SENT_ROWS = 100_000


def fingerprint(text: str | None) -> int:
    """The text's 64 bits, unsigned; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    hashes = hashes.astype("<u8", copy=False)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", drop: tuple = ()) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long.  Null and empty texts have 0."""
    return add_columns(docs, [text], "fp long", lambda: lambda texts: [[as_long(fingerprint(t)) for t in texts]], drop)


def as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- partitions and thresholds


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of nearly equal size, each of bits that go together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    together = np.abs(bits.T @ bits) / np.outer(norm, norm)
    np.fill_diagonal(together, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        group = [max(free, key=lambda b: (together[b, list(free)].max(), -b))]
        free.discard(group[0])
        while len(group) < width:
            b = max(free, key=lambda b: (together[b, group].sum(), -b))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = total at the least cost; costs[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                if used + k <= total and (used + k not in following or cost + c < following[used + k][0]):
                    following[used + k] = (cost + c, [*chosen, k - 1])
        best = following
    return best[total]


def plan_partitions(sample: np.ndarray, n: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, for ``n`` distinct fingerprints."""
    best = (float("inf"), [])
    if len(sample) < 2:
        sample = np.array([0, 2**64 - 1], np.uint64)
    left, right = sample[:2000, None], sample[None, -2000:]
    differ = left ^ right
    for m in PARTITIONS:
        groups = group_bits(sample, m)
        costs = []
        for bits in groups:
            distance = np.bitwise_count(differ & np.uint64(mask_of(bits)))[differ != 0]
            row, probes = [0.0], 0
            for t in range(MAX_DISTANCE + 1):
                probes += comb(len(bits), t)
                #: never below what independent bits would give: the sample can't show rarer ones
                share = max((distance <= t).mean() if len(distance) else 0.0, probes / 2.0 ** len(bits))
                row.append(probes * PROBE_COST + n * share * COMPARE_COST)
            costs.append(row)
        cost, thresholds = allocate(costs, MAX_DISTANCE + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def flips(bits: list[int], most: int) -> np.ndarray:
    return np.array([mask_of(c) for t in range(most + 1) for c in combinations(bits, t)], np.uint64)


def hot_values(sample: np.ndarray, plan: list[tuple[list[int], int]], n: int) -> dict[int, dict[int, int]]:
    """How many blocks to deal a bucket's own fingerprints over, where the sample expects too many."""
    out = {}
    for part, (bits, _) in enumerate(plan):
        values, counts = np.unique(sample & np.uint64(mask_of(bits)), return_counts=True)
        expected = counts * (n / max(1, len(sample)))
        out[part] = {int(v): int(-(-e // BUCKET_ROWS)) for v, e in zip(values, expected, strict=True) if e > BUCKET_ROWS}
    return out


BUCKET_ROW = "part int, value long, block int, fp long, probe boolean"


def probe_rows(plan, hot):
    """fp -> its own bucket of each partition (probe false) and the ones it probes (true)."""
    schema = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("block", pa.int32()), ("fp", pa.int64()), ("probe", pa.bool_())])
    tables = [(part, np.uint64(mask_of(bits)), flips(bits, t)) for part, (bits, t) in enumerate(plan)]

    def rows(part, value, block, fp, probe):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)), pa.array(block), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), probe))], schema=schema)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for part, mask, flip in tables:
                own, crowded = fp & mask, hot[part]
                blocks = np.array([crowded.get(v, 1) for v in own.tolist()], np.int64) if crowded else np.ones(len(fp), np.int64)
                mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield rows(part, own, (mixed % blocks.astype(np.uint64)).astype(np.int32), fp, False)
                for x in flip:
                    value = own ^ x
                    times = np.array([crowded.get(v, 1) for v in value.tolist()], np.int64) if crowded else np.ones(len(fp), np.int64)
                    if x == 0:
                        # a fingerprint alone in its only block needs no probe: its own row says all
                        times = np.where(times == 1, 0, times)
                    if times.any():
                        at = np.repeat(np.arange(len(fp)), times)
                        block = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                        yield rows(part, value[at], block, fp[at], True)

    return run


# ---- links


def forest(own: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that own-other pairs within MAX_DISTANCE connect; own come first among others."""
    if len(own) * len(others) <= MATRIX:
        a, b = np.nonzero(np.bitwise_count(own[:, None] ^ others[None, :]) <= MAX_DISTANCE)
        x, y = own[a], others[b]
        keep = x != y
        return list(zip(x[keep].tolist(), y[keep].tolist()))
    left = [own, others]
    out = []
    while len(left[0]):
        stack = [(int(left[0][0]), 1)]  # a node, and the side it is to be compared with
        left[0] = left[0][1:]
        while stack:
            node, side = stack.pop()
            near = np.bitwise_count(left[side] ^ np.uint64(node)) <= MAX_DISTANCE
            if near.any():
                new = left[side][near]
                left[side] = left[side][~near]
                for x in new.tolist():
                    if x != node:
                        out.append((node, x))
                    stack.append((x, 1 - side))
    return out


def star(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same connections, each member linked with the least one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(r, x) for x in list(parent) if (r := root(x)) != x]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> links.  A bucket may span batches; one is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple] = []
    links: list[tuple[int, int]] = []

    def columns(batch):
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "block", "fp", "probe")]

    def packed():
        made = np.array(star(links), np.uint64).reshape(-1, 2).view(np.int64)
        links.clear()
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], schema=schema)

    def bucket(fp, probe):
        fp = fp.view(np.uint64)
        own = np.unique(fp[~probe])
        if len(own):
            others = np.concatenate([own, np.setdiff1d(fp[probe], own)])
            if len(others) > 1:
                links.extend(forest(own, others))

    for batch in batches:
        if not batch.num_rows:
            continue
        part, value, block, fp, probe = columns(batch)
        if held and (held[0][0], held[0][1], held[0][2]) != (part[0], value[0], block[0]):
            bucket(np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))
            held = []
        ends = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1])) + 1
        starts = np.concatenate([[0], ends])
        if len(ends):
            if held:
                bucket(np.concatenate([*[h[3] for h in held], fp[: ends[0]]]), np.concatenate([*[h[4] for h in held], probe[: ends[0]]]))
                held, starts = [], starts[1:]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    bucket(fp[a:b], probe[a:b])
        at = int(starts[-1]) if len(ends) else 0
        held.append((part[at], value[at], block[at], fp[at:], probe[at:]))
        if len(links) > 20_000:
            yield packed()
    if held:
        bucket(np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))
    if links:
        yield packed()


# ---- components


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): alternating large and small stars, each round through a checkpoint.

    Every node of a link has a row; root is the least node (as a signed long) of its component.
    Rounds grow with the logarithm of the longest chain.
    """
    state = None
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        edges = cut(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state or now[0] == 0:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_links(distinct: DataFrame, sample: np.ndarray, n: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect what lies within MAX_DISTANCE."""
    plan = plan_partitions(sample, n)
    rows = distinct.select("fp").mapInArrow(probe_rows(plan, hot_values(sample, plan, n)), BUCKET_ROW)
    keys = ["part", "value", "block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(bucket_links, "a long, b long")


def link_fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) -> doc_id, fp, component_id, root, one row for each row.

    component_id is the least doc_id that links reach; it is null only where all of those are null.
    root is the component's least fingerprint, which names it in any case.  Neither the copies of one text nor the
    members of one component meet in a task.
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    n = distinct.count()
    taken = distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    roots = components(fingerprint_links(distinct, taken.view(np.uint64), n))
    members = cut(roots.withColumnRenamed("node", "fp").join(distinct, "fp"))
    ids = cut(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps")))
    linked = join_by_weight(members, ids, "root", "fps").select("fp", "copies", "component_id", "root")
    alone = distinct.join(members.select("fp"), "fp", "left_anti").select("fp", "copies", F.col("first_id").alias("component_id"), F.col("fp").alias("root"))
    return join_by_weight(rows, cut(linked.unionByName(alone)), "fp", "copies").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, root of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like others; null and repeated ids are values like others; texts of
    any length count whole; other columns are left out; an empty table gives no rows.
    """
    return link_fingerprints(cut(with_fingerprints(docs.select("doc_id", "text"), drop=("text",))))


# ---- near copies of a corpus: exact similarity of five-word shingles


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's NEAR_SHINGLE-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < NEAR_SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(NEAR_SHINGLE))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its number and its BAND_ROWS least hashes (of as many orders)."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] * ORDERS[0]
        x ^= x >> np.uint64(32)
        x *= ORDERS[1]
        np.minimum(least, x.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def with_bands(docs: DataFrame, text: str = "text", drop: tuple = ()) -> DataFrame:
    """Adds ``node`` (a hash of the shingle set; 0 without words), n_shingles, ``fp`` (the set's fingerprint) and ``bands``."""

    def rows(texts):
        sets = [shingle_set(t) for t in texts]
        nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets]
        keys = [band_keys(s).view(np.int64).tolist() if len(s) else [] for s in sets]
        return [np.array(nodes, np.uint64).view(np.int64).tolist(), [len(s) for s in sets], [as_long(majority(s)) for s in sets], keys]

    return add_columns(docs, [text], "node long, n_shingles long, fp long, bands array<long>", lambda: rows, drop)


def similar_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all that pairs of a similarity of NEAR or more connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    has, out = np.zeros(int(flat.max()) + 1, bool), []
    left = np.arange(len(sets))
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            node = stack.pop()
            # what differs more in size than NEAR allows isn't looked at
            fits = (sizes[left] * NEAR[1] >= sizes[node] * NEAR[0]) & (sizes[node] * NEAR[1] >= sizes[left] * NEAR[0])
            tried = left[fits]
            if not len(tried):
                continue
            own = flat[starts[node] : starts[node] + sizes[node]]
            has[own] = True
            ends = np.cumsum(sizes[tried])
            places = np.arange(ends[-1]) + np.repeat(starts[tried] - ends + sizes[tried], sizes[tried])
            common = np.add.reduceat(has[flat[places]].astype(np.int64), ends - sizes[tried])
            has[own] = False
            near = tried[common * NEAR[1] >= (sizes[tried] + sizes[node] - common) * NEAR[0]]
            out += [(nodes[node], nodes[x]) for x in near.tolist()]
            stack += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def dealt_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, cluster, blocks) -> the node's set for each pair of blocks that its own block is in."""
    schema = pa.schema([("cluster", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("node", pa.int64()), ("hashes", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = []
            for r in batch.slice(at, SLICE_ROWS).to_pylist():
                own, hashes = r["node"] % r["blocks"], shingle_set(r["text"]).tobytes()
                others = [k for k in range(r["blocks"]) if k != own] or [own]
                rows += [(r["cluster"], min(own, k), max(own, k), r["node"], hashes) for k in others]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def cluster_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of dealt_sets sorted by cluster and blocks -> links (a, b).  One group is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, group = [], None

    def linked():
        pairs = similar_links([n for n, _ in held], [np.frombuffer(h, np.uint64) for _, h in held]) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        cluster, i, j, node, hashes = (batch.column(c) for c in ("cluster", "i", "j", "node", "hashes"))
        for key, n, h in zip(zip(cluster.to_pylist(), i.to_pylist(), j.to_pylist()), node.to_pylist(), hashes.to_pylist()):
            if key != group:
                yield linked()
                held, group = [], key
            held.append((n, h))
    yield linked()


def band_links(rows: DataFrame) -> DataFrame:
    """(node, bands) -> links (a, b) that connect the nodes that share a band's key."""
    keys = rows.select("node", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most")
    return keys.join(shared, "key").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """(node, fp) -> links (a, b) that connect the nodes whose fingerprints link, each with its component's least node."""
    linked = link_fingerprints(nodes.select(F.col("node").alias("doc_id"), "fp"))
    return linked.filter("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def near_copies(rows: DataFrame) -> DataFrame:
    """(row_id, text, node, n_shingles, fp, bands) of a written table -> (node, root) of the nodes that have near copies.

    Candidates are nodes whose fingerprints link (probed as in ``near_duplicates``), and, for pairs beyond that radius,
    nodes that share a band's key.  Candidates' clusters are the groups in which sets are compared; a cluster of more
    than CLUSTER_SHINGLES is dealt out by pairs of blocks.
    """
    nodes = cut(rows.filter("n_shingles > 0").groupBy("node").agg(F.min("row_id").alias("row_id"), F.first("n_shingles").alias("n_shingles"), F.first("fp").alias("fp")))
    candidates = components(near_fingerprints(nodes).unionByName(band_links(rows)))
    nodes = nodes.drop("fp")
    members = cut(nodes.join(candidates.withColumnRenamed("root", "cluster"), "node"))
    blocks = cut(members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES).alias("blocks"), F.count("*").alias("nodes")))
    members = cut(join_by_weight(members, blocks, "cluster", "nodes").select(F.col("row_id").alias("m_row_id"), "node", "cluster", "blocks"))
    sent = F.broadcast(members) if members.count() <= SENT_ROWS else members
    texts = rows.select("row_id", "text").join(sent, F.col("row_id") == F.col("m_row_id")).select("text", "node", "cluster", "blocks")
    by = ["cluster", "i", "j"]
    sets = texts.mapInArrow(dealt_sets, "cluster long, i long, j long, node long, hashes binary")
    return components(sets.repartition(*by).sortWithinPartitions(*by).mapInArrow(cluster_links, "a long, b long"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of near copies: the one with the least id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of NEAR or more,
    directly or through chains.  Candidates come from linked fingerprints and from shared bands.  Among rows with the same id, or with none, the columns' hash decides.
    Texts without words are alike; texts of any length count whole; columns keep their names and order,
    whatever they are called; an empty table gives no rows.
    """
    boxes = boxed(docs, "text").withColumn("row_id", F.monotonically_increasing_id())
    rows = written(with_bands(boxes, drop=("text",)), "near")
    roots = near_copies(rows.select("row_id", F.col("boxed_row.text").alias("text"), "node", "n_shingles", "fp", "bands"))
    slim = rows.select("row_id", "node", F.col("boxed_row.doc_id").alias("doc_id"), F.xxhash64("boxed_row").alias("row_hash"))
    named = slim.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash", "row_id")).alias("first")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(first).select(F.col("first.row_id").alias("row_id"))
    return rows.join(kept, "row_id", "left_semi").select("boxed_row.*")


def hex_fingerprint():
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
