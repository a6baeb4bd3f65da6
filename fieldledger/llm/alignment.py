"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes.  For each, the indices of its tokens are repeated over their bytes (``np.repeat``):
the owner of every byte.  Consecutive distinct pairs of owners are the overlaps of A and B tokens; where both
owners change at once, both have a token end: there the text is cut into groups.

No token of either vocabulary has a blank after another character that isn't white space (checked when the
vocabularies are loaded), so both always cut there.  A text is a row of *segments* between such places, each
segment is tokenized and aligned once in a worker's cache, and a document's figures are sums over its segments.

Texts are tokenized once; the id pairs linked in each document are written.  Every task counts, for each pair,
the documents that hold it and sends one number a pair; then the written pairs are looked up.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.llm.base import add_columns, cut, read_table, without, written

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A blank, white space, other characters; goes on unless a blank comes next.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
CROSSING = re.compile(rb"[^\s\x80-\xff\x1c-\x1f] ")
#: Segments up to this many characters are remembered by a worker, up to so many bytes of them.
CACHED_CHARS, CACHED_BYTES = 64, 96 << 20
#: Texts are tokenized in blocks of about so many characters.
BLOCK_CHARS = 1 << 18
#: A pair is A's id above these bits, B's id in them.
B_BITS = 24
#: Pairs that a task counts before it merges them, and distinct ones before it hands them on.
PENDING, HELD = 2_000_000, 4_000_000
#: So many of the most frequent pairs (17 bytes each) are sent to every task.
SENT_PAIRS = 3_000_000
NO_PAIRS = np.empty(0, np.int64)


def runs(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1, each as often as its size says: who owns each byte."""
    return np.repeat(np.arange(len(sizes)), sizes)


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut) for two cuttings of the same bytes: the token indices of all overlaps, in order, and whether both tokens end there."""
    a, b = runs(a_sizes), runs(b_sizes)
    if not len(a):
        return a, b, np.zeros(0, bool)
    new_a, new_b = np.diff(a) != 0, np.diff(b) != 0
    last = np.flatnonzero(np.append(new_a | new_b, True))  # the last byte of each overlap
    return a[last], b[last], np.append(new_a & new_b, True)[last]


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


#: What one segment adds to its document: A tokens, B tokens, groups, the groups' text, the id pairs of its links as 64-bit
#: integers, and whether both tokenizers give its bytes back.  Plain tuples: the collector leaves those alone.
Segment = tuple[int, int, int, str, bytes, bool]


def size_of(text: str, s: Segment) -> int:
    """Bytes that a remembered segment takes, roughly."""
    return 500 + 2 * len(text) + len(s[3]) + len(s[4])


class Aligner:
    """Both tokenizers, and the segments met lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_of_sign()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        with open(path_a, encoding="utf-8") as f:
            for token, i in json.load(f)["model"]["vocab"].items():
                self.a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.split = SEGMENT.findall if not any(CROSSING.search(x) for x in (*self.a_bytes, *self.b_bytes)) else lambda text: [text]
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: Two generations: what isn't met while the younger fills up is forgotten.
        self.known: dict[str, Segment] = {}
        self.older: dict[str, Segment] = {}
        self.held = 0

    def segments(self, texts: list[str | None]) -> list[list[Segment]]:
        """The segments of each text with a blank before it; none for null and empty texts and those whose tokens don't give their bytes back."""
        pieces = [self.split(" " + t) if t else [] for t in texts]
        known, older = self.known, self.older
        wanted = {p for ps in pieces for p in ps if p not in known}
        new = [p for p in wanted if p not in older]
        known.update((p, older[p]) for p in wanted if p in older)
        known.update(zip(new, self.aligned(new), strict=True))
        out = [[known[p] for p in ps] for ps in pieces]
        for i, found in enumerate(out):
            if not all([s[5] for s in found]):
                out[i] = []
        for p in wanted:
            if len(p) > CACHED_CHARS:
                del known[p]
            else:
                self.held += size_of(p, known[p])
        if self.held > CACHED_BYTES:
            self.known, self.older, self.held = {}, known, 0
        return out

    def aligned(self, segments: list[str]) -> list[Segment]:
        if not segments:
            return []
        a_ids = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b_ids = [ids or [self.blank] for ids in self.b.encode([s[1:] for s in segments], num_threads=1)]  # the library puts the blank back
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        alike = [b"".join([a_bytes[i] for i in a]) == (data := s.encode("utf-8")) == b"".join([b_bytes[i] for i in b]) for s, a, b in zip(segments, a_ids, b_ids, strict=True)]
        if not all(alike):
            a_ids = [ids if ok else [] for ids, ok in zip(a_ids, alike, strict=True)]
            b_ids = [ids if ok else [] for ids, ok in zip(b_ids, alike, strict=True)]
        flat_a, flat_b = list(chain.from_iterable(a_ids)), list(chain.from_iterable(b_ids))
        # All segments at once: no overlap crosses their ends, for both have a token end there.
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        at_a, at_b, ends = overlaps(self.a_size[ids_a], self.b_size[ids_b])
        pairs = ids_a[at_a] << B_BITS | ids_b[at_b]
        group_ends = np.flatnonzero(ends)
        names_a, names_b = [self.names[i] for i in flat_a], [self.names[i] for i in flat_b]
        upto_a, upto_b = [0, *(at_a[group_ends] + 1).tolist()], [0, *(at_b[group_ends] + 1).tolist()]
        groups = [
            f"{names_a[i]}|{names_b[k]}" if j - i == 1 == m - k else ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
            for (i, j), (k, m) in zip(pairwise(upto_a), pairwise(upto_b), strict=True)
        ]
        # Where each segment's groups and links end: after as many A tokens as it and those before have.
        stops = np.searchsorted(np.array(upto_a), np.cumsum([len(ids) for ids in a_ids]), "left")
        links = (8 * np.concatenate([[0], group_ends + 1])[stops]).tolist()
        data, out, from_group, from_link = pairs.astype("<i8").tobytes(), [], 0, 0
        for a, b, ok, stop, link in zip(a_ids, b_ids, alike, stops.tolist(), links, strict=True):
            out.append((len(a), len(b), stop - from_group, ";".join(groups[from_group:stop]), data[from_link:link], ok))
            from_group, from_link = stop, link
        return out

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times) of each text; pairs are distinct, times says how often each is linked."""
        gc.disable()  # millions of tuples and no cycles
        try:
            return self.measured(texts)
        finally:
            gc.enable()

    def measured(self, texts: list[str | None]) -> list[tuple]:
        out, at = [], 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and chars < BLOCK_CHARS:
                chars += len(texts[stop] or "")
                stop += 1
            for found in self.segments(texts[at:stop]):
                if not found:
                    out.append((0, 0, 0, 0, "", "", NO_PAIRS, NO_PAIRS))
                    continue
                n_a, n_b, n_groups, groups, pairs, _ = zip(*found)
                links = np.frombuffer(b"".join(pairs), "<i8")
                joined = ";".join(groups)
                out.append((sum(n_a), sum(n_b), sum(n_groups), len(links), joined, hashlib.sha256(joined.encode()).hexdigest(), *np.unique(links, return_counts=True)))
            at = stop
        return out


@lru_cache(maxsize=2)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path(VOCABULARY_A)
        path_b = path_b or public_tokenizers.path(VOCABULARY_B)
    return path_a, path_b


def with_links(docs: DataFrame, text: str, path_a: str, path_b: str, keep_text: bool, keep_groups: bool) -> DataFrame:
    """``docs`` with their figures and link_pairs, link_times: each id pair linked in the document, and how often."""

    def make():
        aligner = aligner_of(path_a, path_b)

        def columns(texts):
            *numbers, groups, digests, pairs, times = zip(*aligner.rows(texts)) if texts else [()] * 8
            upto = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            lists = [pa.ListArray.from_arrays(upto, pa.array(np.concatenate([NO_PAIRS, *x]), pa.int64())) for x in (pairs, times)]
            return [*numbers, digests, *lists, *([groups] if keep_groups else [])]

        return columns

    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_pairs array<long>, link_times array<long>"
    return add_columns(docs, [text], schema + (", groups string" if keep_groups else ""), make, drop=() if keep_text else (text,))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of ``linked`` hold the pair, and whether A's id has no pair with more."""

    def count(batches):
        parts, pending = [], 0
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            parts.append((pairs, n.astype(np.int64)))
            pending += len(pairs)
            if pending > PENDING:
                parts, pending = [merged(parts)], 0
                if len(parts[0][0]) > HELD:
                    yield given(*parts.pop())
        if parts:
            yield given(*merged(parts))

    counts = cut(linked.select("link_pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    of_a = Window.partitionBy(F.shiftright("pair", B_BITS))  # at most one row for each of B's ids
    return cut(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)))


def given(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


def sums_by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]
    return np.diff(upto)


def look_up(linked: DataFrame, sent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Puts n_best and count_sum in the place of the links, and open_pairs, open_times: the links whose pair isn't among those ``sent`` (pair ascending, n, best)."""
    shared = linked.sparkSession.sparkContext.broadcast(sent)
    kept = [f for f in linked.schema if f.name not in ("link_pairs", "link_times")]
    out = T.StructType([*kept, *T.StructType.fromDDL("n_best long, count_sum long, open_pairs array<long>, open_times array<long>")])
    names = out.names

    def find(batches):
        known, n, best = shared.value
        for batch in batches:
            links, times = batch.column("link_pairs"), batch.column("link_times").flatten().to_numpy()
            pairs = links.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            value, top = (np.where(found, times * n[at], 0), np.where(found & best[at], times, 0)) if len(known) else (np.zeros(len(pairs), np.int64),) * 2
            rest = pa.array(sums_by_row(~found, ends).cumsum(), pa.int32())
            rest = pa.concat_arrays([pa.array([0], pa.int32()), rest])
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~found], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(sums_by_row(top, ends)), pa.array(sums_by_row(value, ends)), *lists], names=names)

    return linked.mapInArrow(find, out)


def aligned_documents(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, keep_text: bool = False, keep_groups: bool = True, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum and, with ``keep_groups``, groups to ``docs``.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: the ids between places where tokens of both end.  n_best and count_sum go by how many
    documents hold a link's id pair.  Null and empty texts, and texts whose tokens don't give blank + text back, have no
    tokens: zeros and empty strings.  Special tokens' strings are plain text.  Equal texts have equal values and repeated
    rows each count; texts of any length are aligned whole; an empty table gives no rows; clashing extra columns are
    replaced.  The text is left out unless ``keep_text``.

    Each text is tokenized once: what is linked in it is written to the shared folder, counted, and looked up.  Of the pairs
    the ``sent_pairs`` most frequent are sent to the tasks (17 bytes each); links of rarer pairs are joined by pair.
    """
    path_a, path_b = paths(path_a, path_b)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256", "link_pairs", "link_times", "open_pairs", "open_times", "align_row"]
    linked = written(with_links(without(docs, [n for n in names if n != text]), text, path_a, path_b, keep_text, keep_groups), "links")
    ranked = pair_counts(linked)
    sent = ranked.orderBy(F.desc("n"), "pair").limit(sent_pairs).toArrow()
    order = np.argsort(sent.column("pair").to_numpy(), kind="stable")
    made = look_up(linked, tuple(sent.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    if sent.num_rows < sent_pairs:  # all of them
        return made.drop("open_pairs", "open_times")
    # Few documents hold each of the rarer pairs, so no key of this join is hot.
    made = cut(made.withColumn("align_row", F.monotonically_increasing_id()))
    links = made.select("align_row", F.explode(F.arrays_zip("open_pairs", "open_times")).alias("x")).select("align_row", F.col("x.open_pairs").alias("pair"), F.col("x.open_times").alias("times"))
    rest = ranked.filter(F.col("n") <= int(np.min(sent.column("n").to_numpy()))) if sent.num_rows else ranked
    more = links.join(rest, "pair").groupBy("align_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = made.join(more, "align_row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum", "align_row", "open_pairs", "open_times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned_documents(docs, keep_groups=False).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
