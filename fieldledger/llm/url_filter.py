"""URL filters over a Bloom filter cascade.

A list's keys are hosts with path prefixes.  Over the corpus's complete key universe (every host
suffix with every path prefix of a listed length that some url has), the first level is a Bloom
filter of the listed keys, the second one of the unlisted keys that pass the first, the third of the
listed keys that pass the second, and so on until none passes.  A key of the universe is listed if
the first level that rejects it has an odd number (counted from one: even levels hold false
positives), so membership is exact, by a few bits a key, without a join.

Keys are looked up by their 64-bit hashes.  Whether a text of the universe shares a listed key's hash
without being that key is looked up when the cascade is built; if one does, the join takes its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.llm.base import cut, read_table, without

#: Fixed by the contract: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: False positives of a level; the first one is tighter, as the universe is much larger than the list.
FIRST_RATE, RATE = 1 / 64, 1 / 4
#: A cascade above this isn't sent to the tasks; lookups then join the list instead.
MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> dict[str, Column]:
    part = lambda p: F.coalesce(F.regexp_extract(F.col(url), rf"(?s)^.*?://{p}", 1), F.lit(""))
    return {"host": F.translate(part("([^/?#]*)"), UPPER, LOWER), "path": part("[^/?#]*([^?#]*)")}


def candidates(lengths: list[int]) -> Column:
    """Of host and path: all (host suffix + path prefix) keys, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths, reverse=True)]
    prefixes = F.array_compact(F.array(*fitting))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda x: x["k"]))


@dataclass
class Level:
    bits: np.ndarray  # bytes
    n_bits: int
    n_hashes: int
    seed: int

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """keys (uint64) -> a row of bit positions for each."""
        with np.errstate(over="ignore"):
            a = mixed(keys, 2 * self.seed + 1)
            b = mixed(keys, 2 * self.seed + 2) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.n_hashes, dtype=np.uint64)) % np.uint64(self.n_bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        p = self.positions(keys)
        return ((self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Cascade(list):
    """Levels; ``listed`` answers for the keys of its universe."""

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self):
            passed = level.passes(keys[open_])
            out[open_[~passed]] = k % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self) % 2 == 1
        return out


def filtered(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that pass."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(level.passes(batch.column("key").to_numpy().view(np.uint64))))

    return keys.mapInArrow(run, "key long")


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Each task sets bits in 64-bit words of its own; words are united by bit_or, and what comes back has n_bits at most."""
    n_bits = 64 * max(1, ceil(n * -log(rate) / log(2) ** 2 / 64))
    level = Level(np.zeros(0, np.uint8), n_bits, max(1, round(-log(rate) / log(2))), seed)

    def run(batches):
        for batch in batches:
            p = level.positions(batch.column("key").to_numpy().view(np.uint64)).ravel()
            words, at = np.unique(p >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    made = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(n_bits // 64, np.int64)
    words[made["word"].to_numpy(np.int64)] = made["bits"].to_numpy(np.int64)
    level.bits = words.view(np.uint8)
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade of ``listed`` (key long) over ``universe`` (distinct key long); None if it would outgrow ``max_bytes``.

    The universe may hold listed keys; they don't count as unlisted.  An empty list has no levels.
    """
    inside = cut(listed.distinct().join(universe, "key", "left_semi"))
    outside = universe.join(inside, "key", "left_anti")
    levels, size = Cascade(), 0
    yes, no = inside, outside
    while (n := yes.count()) > 0:
        rate = RATE if levels else FIRST_RATE
        size += n * -log(rate) / log(2) ** 2 / 8
        if size > max_bytes:
            return None
        levels.append(build_level(yes, n, rate, len(levels)))
        yes, no = cut(filtered(no, levels[-1])), yes
    return levels


def collides(keys: DataFrame, listed: DataFrame, key_hash) -> bool:
    """True if some text of ``keys`` (url_keys) has the hash of a listed rule that is another text."""
    rules = listed.select("rule", key_hash(F.col("rule")).alias("rule_hash"))
    texts = keys.select(F.explode("url_keys").alias("text")).withColumn("text_hash", key_hash(F.col("text")))
    return not texts.join(rules, (F.col("text_hash") == F.col("rule_hash")) & (F.col("text") != F.col("rule"))).isEmpty()


def rule_rows(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([(h + p, v) for h, p, v in rules], "rule string, verdict string")


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", default: str = DEFAULT, max_bytes: int = MAX_BYTES, key_hash=F.xxhash64) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; clashing extra columns are replaced.

    A url that no rule fits has a null rule and the verdict ``default``.  Of the rules that fit, the
    longest (host and path together) wins.  A null url, one without ``://`` and an empty host have no
    rule.  Repeated rows stay, an empty table gives none.
    """
    spark = pages.sparkSession
    names = ["host", "path", "rule", "verdict", "url_keys", "url_hashes"]
    lengths = sorted({len(p) for _, p, _ in rules})
    rows = without(pages, names).withColumns(url_parts(url)).withColumn("url_keys", candidates(lengths)).withColumn("url_hashes", F.transform("url_keys", lambda k: key_hash(k)))
    universe = cut(rows.select(F.explode("url_hashes").alias("key")).distinct())
    listed = rule_rows(spark, rules)
    cascades = {}
    for verdict in ("allow", "block"):
        keys = listed.filter(F.col("verdict") == verdict).select(key_hash(F.col("rule")).alias("key"))
        cascades[verdict] = build_cascade(keys, universe, max_bytes)
    if any(c is None for c in cascades.values()) or collides(rows, listed, key_hash):
        return judge_by_join(rows, listed, default)
    out = T.StructType([f for f in rows.schema if f.name != "url_hashes"]).add("rule", "string").add("verdict", "string")
    names = [f.name for f in out][:-2]
    # Both lists' levels are within max_bytes, so they may go to every task with the function.

    def run(batches):
        for batch in batches:
            hashes = batch.column("url_hashes")
            sizes = pa.compute.list_value_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            block, allow = cascades["block"].listed(keys), cascades["allow"].listed(keys)
            hit = np.flatnonzero(block | allow)
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            first = np.unique(row, return_index=True)
            texts = batch.column("url_keys").flatten()
            rule, verdict = [None] * len(sizes), [default] * len(sizes)
            for r, i in zip(first[0].tolist(), hit[first[1]].tolist(), strict=True):
                rule[r], verdict[r] = texts[i].as_py(), "block" if block[i] else "allow"
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"])

    return rows.mapInArrow(run, out).drop("url_keys")


def judge_by_join(rows: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The way for lists whose cascade is too large to send: the distinct keys join the list, then urls their keys."""
    keyed = rows.withColumn("row_id", F.xxhash64("host", "path")).drop("url_hashes")
    keys = keyed.select("host", "path", "url_keys").distinct().select("host", "path", F.posexplode("url_keys").alias("at", "rule"))
    best = keys.join(listed, "rule").groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "at").alias("best"))
    return keyed.join(best, ["host", "path"], "left").select(*[c for c in keyed.columns if c not in ("url_keys", "row_id")], F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in rules)
    return rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} ELSE '{DEFAULT}' END AS verdict FROM ruled
"""
