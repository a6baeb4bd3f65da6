"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the vocabulary's pattern; each match (a pre-token) is merged on its own.  The queue
keeps, for every rank that some adjacent pair has, a bucket of linked-list positions.  Which buckets
are filled is a bitmap over ranks in three levels of 64-bit words, so finding the least rank is three
find-first-set steps, however much waits.  Entries are never removed when their pair changes: a
position whose pair no longer has the popped rank is stale and skipped.  A pre-token of n bytes costs
O(n log n) at most (the sort of a bucket's positions), so one match of a million bytes is no different
in kind from a word.  The pre-tokens of a block of documents that the worker has not met yet share one
queue: no pair crosses their ends, so they don't touch each other.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from fieldledger.llm.base import add_columns, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens up to this many characters are remembered by a worker, and so many of them.
CACHED_CHARS, CACHED = 64, 800_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank, and the bitmaps that find the least rank with a bucket."""

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        a = rank >> 6
        self.low[a] |= 1 << (rank & 63)
        self.mid[a >> 6] |= 1 << (a & 63)
        self.top |= 1 << (a >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and all its positions, from left to right; the queue must not be empty."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        self.low[a] = word = word & (word - 1)
        if not word:
            self.mid[b] = word = self.mid[b] & (self.mid[b] - 1)
            if not word:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        return rank, bucket


class ByteBpe:
    """Encoder and decoder over one file of ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        n_ranks = max(self.ranks.values()) + 1
        self.queue = RankQueue(n_ranks)
        self.tokens: list[bytes] = [b""] * n_ranks
        self.pairs = np.full(1 << 16, -1, np.int32)  # ranks of two bytes
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each pre-token."""
        data = b"".join(words)
        ends = np.cumsum([len(w) for w in words])
        raw = np.frombuffer(data, np.uint8).astype(np.int32)
        ranks = np.full(len(raw), -1, np.int32)  # of the part that starts here, joined with the next
        ranks[:-1] = self.pairs[raw[:-1] << 8 | raw[1:]]
        ranks[ends[ends > 0] - 1] = -1
        queue, rank_of, buckets = self.queue, self.ranks.get, self.queue.buckets
        order = np.argsort(ranks, kind="stable")
        found, first = np.unique(ranks[order], return_index=True)
        for r, at in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            if r >= 0:
                queue.push(r, at.tolist())
        pair, end, after, before = ranks.tolist(), list(range(1, len(raw) + 1)), np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        after[ends[ends > 0] - 1] = -1  # no pair crosses the end of a pre-token
        before[ends[ends < len(raw)]] = -1
        after, before = after.tolist(), before.tolist()
        while queue.top:
            rank, bucket = queue.pop()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                pair[gone] = -1
                stop = end[i] = end[gone]
                least = rank
                following = after[i] = after[gone]
                if following >= 0:
                    before[following] = i
                    r = rank_of(data[i : end[following]])
                    if r is None:
                        pair[i] = -1
                    else:
                        pair[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            queue.push(r, [i])
                        least = r
                else:
                    pair[i] = -1
                p = before[i]
                if p >= 0:
                    r = rank_of(data[p:stop])
                    if r is None:
                        pair[p] = -1
                    else:
                        pair[p] = r
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            queue.push(r, [p])
                        if r < least:
                            least = r
                if least < rank:  # what was just made comes before the rest of this bucket
                    if rest := bucket[at + 1 :]:
                        queue.push(rank, rest)
                    break
        out, i, ranks = [], 0, self.ranks
        for stop in ends.tolist():
            ids = []
            while i < stop:
                ids.append(ranks[data[i : end[i]]])
                i = end[i]
            out.append(ids)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        made = self.merge([p.encode("utf-8") for p in new]) if new else []
        known.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(new, made, strict=True))
        out = [b"".join([known[p] for p in ps]) for ps in pieces]
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        if len(known) > CACHED:
            known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=1)
def bpe_of(path: str, pattern: str) -> ByteBpe:
    """One encoder, with the pre-tokens it knows, for all tasks of a worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep_text: bool = False) -> DataFrame:
    """Adds n_tokens, token_ids, ids_sha256 and decoded_sha256 to ``docs``.

    token_ids are the ids as little-endian unsigned 32-bit integers (binary).  Special-token strings
    are ordinary text.  A null or empty text has no ids.  The text itself is left out unless
    ``keep_text``.  Repeated rows stay; clashing extra columns are replaced.  Texts of any length are
    encoded whole; an empty table gives no rows.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path(VOCABULARY)
        pattern = pattern or public_tokenizers.PATTERN

    def make():
        bpe = bpe_of(path, pattern)

        def rows(texts):
            ids = bpe.encode_all([t or "" for t in texts])
            return (
                [len(x) // 4 for x in ids],
                ids,
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            )

        return rows

    schema = "n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string"
    return add_columns(docs, [text], schema, make, drop=() if keep_text else (text,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
