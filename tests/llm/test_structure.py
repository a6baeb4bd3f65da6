"""Alignment, conversation repair and sharding against brute force, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldledger.llm import alignment, conversations, sharding

SF = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256(b"").hexdigest()


# ---- alignment


def aligned_by_hand(texts):
    """The contract's columns from the libraries, one byte at a time."""
    one = alignment.Aligner(*alignment.paths(None, None))
    docs = []
    for t in texts:
        a, b = (one.a.encode(" " + t, add_special_tokens=False).ids, one.b.encode(t)) if t else ([], [])
        data = (" " + t).encode() if t else b""
        if not t or b"".join(one.a_bytes[i] for i in a) != data or b"".join(one.b_bytes[i] for i in b) != data:
            docs.append(None)
            continue
        owner_a = [k for k, i in enumerate(a) for _ in one.a_bytes[i]]
        owner_b = [k for k, i in enumerate(b) for _ in one.b_bytes[i]]
        both = {sum(len(one.a_bytes[i]) for i in a[:k]) for k in range(len(a) + 1)} & {sum(len(one.b_bytes[i]) for i in b[:k]) for k in range(len(b) + 1)}
        ends = sorted(both)
        groups = [",".join(str(a[k]) for k in sorted(set(owner_a[x:y]))) + "|" + ",".join(str(b[k]) for k in sorted(set(owner_b[x:y]))) for x, y in zip(ends, ends[1:])]
        docs.append((len(a), len(b), [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))], groups))
    count = Counter(p for d in docs if d for p in set(d[2]))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    return [(0,) * 6 + ("",) if d is None else (d[0], d[1], len(d[3]), len(d[2]), sum(count[p] == highest[p[0]] for p in d[2]), sum(count[p] for p in d[2]), hashlib.sha256(";".join(d[3]).encode()).hexdigest()) for d in docs]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [3_000_000, 200, 0])
def test_alignment_against_bytes(spark, sent):
    r = random.Random(1)
    signs = "ab zé\n\t '▁日  x1.<|endoftext|>🙂\x1c\x85\r　s"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "  ", "a ", "<|endoftext|> <s></s> x <0x41>", "a" * 3000, "日本" * 500, "\x00a b", "é ﬁ ﷺ", "don't stop", "same text", "same text"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, N_A long")
    out = alignment.aligned_documents(docs, sent_pairs=sent).collect()
    assert {x.doc_id: tuple(x[c] for c in ALIGNED) for x in out} == dict(enumerate(aligned_by_hand(texts)))
    assert all((hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else "") == x.groups_sha256 for x in out)


def test_alignment_forgets_and_meets_again(spark):
    one = alignment.Aligner(*alignment.paths(None, None))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(30).collect()]
    want = one.segments(texts)
    alignment.CACHED_BYTES, kept = 5000, alignment.CACHED_BYTES
    try:
        few = alignment.Aligner(*alignment.paths(None, None))
        assert [few.segments([t])[0] for t in texts] == want and len(few.known) < len(one.known)
    finally:
        alignment.CACHED_BYTES = kept


def test_overlaps_and_cuts():
    a, b, ends = alignment.overlaps(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert list(zip(a.tolist(), b.tolist(), ends.tolist())) == [(0, 0, False), (0, 1, True), (1, 2, False), (2, 2, True)]


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_documents(docs).count() == 0


def test_alignment_query_counts_all_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in texts], aligned_by_hand([t for _, t in texts])))
    assert {x.doc_id: tuple(x[c] for c in ALIGNED) for x in alignment.query(spark, SF).collect()} == want


# ---- conversations


def repaired_by_hand(rows):
    """Uniform-cost search over (cost, audit) in each state: the first arrival is the cheapest, then the least."""
    talks = {}
    for c, t, r, x in rows:
        talk = talks.setdefault(c, [])
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if damage == 1 else re.sub("[.!?]", "", x) if damage == 2 else x
        talk += [(t, "user" if damage == 4 else r, x)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    out = {}
    for c, talk in talks.items():
        talk.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2][: conversations.SHOWN].encode(), hashlib.sha256(z[2].encode()).digest()))
        if not talk:
            out[c] = (0,) * 6 + ("", NOTHING)
            continue
        turns, seen, faults = [t for t, _, _ in talk if t is not None], set(), []
        for _, r, x in talk:
            bare = x.rstrip(conversations.WHITE)
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        heap, done, end = [(0, "", 0, "0", ())], set(), None
        while end is None:
            cost, audit, i, q, said = heapq.heappop(heap)
            if (i, q) in done:
                continue
            done.add((i, q))
            if i == len(talk) and q in "0a":
                end = (cost, audit, said)
            after = {"0": "u", "s": "u", "u": "a", "a": "u"}[q]
            name = {"u": "user", "a": "assistant"}[after]
            heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*said, name + ":")))
            if i < len(talk):
                _, r, x = talk[i]
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, said))
                if faults[i] not in ("blank", "duplicate"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after, (*said, f"{name}:{x}")))
                    if r[:1] and (r[0] == after or r[0] == "s" and q == "0"):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[0], (*said, f"{r}:{x}")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, end[0], end[1], hashlib.sha256("\n".join(end[2]).encode()).hexdigest())
    return out


REPAIRED = (*conversations.FIGURES, "audit", "repaired_sha256")


def test_repair_against_search(spark):
    """Nulls, odd roles, ties, repeated rows, and two conversations over several partitions."""
    r, rows = random.Random(5), []
    for c in [None, *range(60)]:
        for t in range(r.choice([1, 2, 3, 8, 20])):
            rows.append((c, r.choice([t, t, t, None, t + r.randrange(4)]), r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "a"]), r.choice(["Hi.", "Yes!", "no", "", " ", "\t\n", None, "A? \n", "x" * 50 + str(r.randrange(3)), "ok."])))
    rows += [(7, t, r.choice(["user", "assistant"]), r.choice(["Hi.", f"Yes! {r.randrange(300)}", f"no {t}", f"Well {t}."])) for t in range(500)]
    rows += [(55, 3, "user", "same.")] * 200
    talks = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, piece int")
    out, want = conversations.repair(talks), repaired_by_hand(rows)
    assert {x.conv_id: tuple(x[c] for c in REPAIRED) for x in out.collect()} == want
    turns = {}
    for x in conversations.repair(talks, as_turns=True).collect():
        turns.setdefault(x.conv_id, []).append((x.place, f"{x.role}:{x.text}"))
    assert {c: hashlib.sha256("\n".join(x for _, x in sorted(turns.get(c, []))).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}


def test_repair_of_given_tables(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {x.conv_id: tuple(x[c] for c in REPAIRED) for x in conversations.query(spark, SF).collect()} == repaired_by_hand(rows)
    assert conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repair_of_a_long_turn(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "assistant", long)]
    out = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.conv_id: tuple(x[c] for c in REPAIRED) for x in out} == repaired_by_hand(rows)


def test_pieces_chain_to_the_whole():
    r = random.Random(2)
    for _ in range(50):
        turns = [(r.choice("suat"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randrange(1, 12))]
        k = r.randrange(len(turns) + 1)
        whole = conversations.distances(turns, conversations.AT_END)
        rest = conversations.distances(turns[k:], conversations.AT_END)[0]
        through = conversations.costs_through(turns[:k])
        assert [min(through[4 * q + p] + rest[q] for q in range(4)) for p in range(4)] == whole[0]


# ---- shards


def fits(sizes, capacity, shards):
    n, filled = 1, 0
    for x in sizes:
        if x > capacity:
            return False
        n, filled = (n + 1, x) if filled + x > capacity else (n, filled + x)
    return n <= shards


def test_capacity_is_the_smallest():
    r = random.Random(3)
    for _ in range(400):
        sizes = [r.choice([r.randrange(1, 20), r.choice([1, 500])]) for _ in range(r.randrange(1, 150))]
        if r.random() < 0.3:
            sizes[r.randrange(len(sizes))] = sum(sizes) // 2 + 1
        shards, total = r.choice([1, 2, 3, 8]), sum(sizes)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        unit = max(1, total // r.choice([4, 16, 1000]))
        _, first, n = np.unique(begins // unit * 2 + (np.array(sizes) > unit), return_index=True, return_counts=True)
        ends = sharding.Ends(begins[first], n == 1, total, lambda rs: np.concatenate([begins[(begins >= a) & (begins < b)] for a, b in sharding.joined(rs)]))
        capacity = sharding.capacity_of(ends, shards)
        assert fits(sizes, capacity, shards) and not fits(sizes, capacity - 1, shards)
        cuts = sharding.cuts_of(ends, shards, capacity)
        parts = np.diff([0, *cuts])
        assert len(cuts) == shards and cuts[-1] == total and parts.min() >= 0 and parts.max() == capacity and set(cuts) <= {*begins.tolist(), total}


def check_shards(rows, texts):
    """Contiguous slots, equal texts together, sizes and checksums; the largest shard is as small as a contiguous row of groups allows."""
    for s in {x.shard for x in rows}:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))
    place, groups = {}, {}
    for x, t in zip(rows, texts, strict=True):
        assert x["size"] == len((t or "").encode()) + 1 and x.text_crc32 == zlib.crc32((t or "").encode()) and x.law == "bytes" and x.grown_shard is None
        assert place.setdefault(t or "", x.shard) == x.shard
        first, size = groups.get(t or "", (x.doc_id, 0))
        groups[t or ""] = min(first, x.doc_id, key=lambda i: (i is not None, i or 0)), size + x["size"]
    row = sorted(groups.items(), key=lambda g: (g[1][0] is not None, g[1][0] or 0, hashlib.sha256(g[0].encode()).digest()))
    sizes = Counter()
    for x in rows:
        sizes[x.shard] += x["size"]
    assert not fits([size for _, (_, size) in row], max(sizes.values()) - 1, sharding.SHARDS)


def test_shards_of_given_tables(spark):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.query(spark, SF).collect()
    assert len(rows) == len(texts)
    check_shards(rows, [texts[x.doc_id] for x in rows])


def test_shards_of_odd_tables(spark):
    """A third of the rows are copies, and ids are null and repeated; texts told apart by the id in this table."""
    texts = {None: "the same", 1: None, 2: "", 3: "x" * 100_000, **{i: f"text {i}" for i in range(4, 60)}}
    rows = [(i, t, 5) for i, t in texts.items()] + [(None, "the same", 5)] * 40 + [(9, "text 9", 5)] * 3
    out = sharding.placements(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(out) == len(rows)
    check_shards(out, [texts[x.doc_id] for x in out])
    assert sharding.placements(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    few = sharding.placements(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert len({x.shard for x in few}) == 2


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.drop("shard").collect()) == sorted(docs.collect())
    want = {x.doc_id: x.shard for x in sharding.query(spark, SF).collect()}
    assert {x.doc_id: x.shard for x in back.collect()} == want
