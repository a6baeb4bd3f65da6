"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

Every document gets counts (``with_counts``) and from them ratios.  A sketch of a ratio in a group is
a histogram over logarithmic buckets, each GAMMA times as wide as the one before: a quantile read from
it is within 2 % of a true one, and merging is adding counts, so the result is the same in whatever
order rows and partial sketches arrive (and when a lost task runs again).

A group's quartiles are drawn towards its language's, and those towards everything's, by SHRINK rows'
weight; there is no size at which a group starts to count.  Its cutoff for a ratio is the upper
quartile plus FENCE times the spread: the distance of the quartiles, or what few signs make of it in
a text as long as this one and as the group's median (``grain``), whichever is more.  So a source of long texts, or one that
writes evenly, is judged more strictly.  CAP times the language's cutoff bounds it: a source
that is mostly junk can't move its cutoff onto its junk.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.base import add_columns, boxed, cut, read_table, without

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
GAMMA = 1.04
FENCE, SHRINK, CAP = 4.0, 50.0, 1.5
#: Cutoffs up to this many bytes are sent to every task; beyond it the join moves rows by group.
MAX_CUTOFF_BYTES = 8 << 20
#: The ratios, each with what it is counted over.
RATIOS = {
    "symbols_per_word": "words",
    "shouts_per_word": "words",
    "upper_share": "chars",
    "dup_line_share": "lines",
    "repeat_share": "words",
    "word_length": "words",
}
#: What a few signs make of a ratio in a text of n words, characters or lines: three signs, three, ten capitals,
#: six tenths of a line, twelve repeated words; a mean word length wavers with the root of the words' number.
GRAIN = {"symbols_per_word": 3.0, "shouts_per_word": 3.0, "upper_share": 10.0, "dup_line_share": 0.6, "repeat_share": 12.0, "word_length": 4.0}
LENGTHS = {"words": "n_words", "chars": "word_chars", "lines": "n_lines"}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouts long, n_upper long"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a ``window``-word sequence found twice or more, the first included.  Exact."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    have = 1
    while have < window:  # codes of sequences of ``have`` words; two of them, overlapping if need be, make longer ones
        step = min(have, window - have)
        both = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        codes = np.unique(both, return_inverse=True)[1]
        have += step
    starts = np.bincount(codes)[codes] > 1
    if not starts.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += starts
    cover[window : window + n] -= starts
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8")  # of bytes, split() and strip() know the contract's white space and no other
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        text.count("!"),
        len(UPPER.findall(text)),
    )


def with_counts(docs: DataFrame, text: str = "text", drop: tuple = ()) -> DataFrame:
    """Adds the counts.  A null text counts as empty; extra columns of the same names are replaced."""
    return add_columns(docs, [text], COUNTS, lambda: lambda texts: list(zip(*map(counts_of, texts))) or [[]] * 8, drop)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def lengths() -> dict[str, Column]:
    return {k: F.greatest(F.col(c), F.lit(1)).cast("double") for k, c in LENGTHS.items()}


def ratios() -> dict[str, Column]:
    over = lengths()
    counted = {
        "symbols_per_word": "n_symbols",
        "shouts_per_word": "n_shouts",
        "upper_share": "n_upper",
        "dup_line_share": "n_dup_lines",
        "repeat_share": "n_repeat_words",
        "word_length": "word_chars",
    }
    return {k: F.col(c) / over[RATIOS[k]] for k, c in counted.items()}


def grain(ratio: str, n: Column) -> Column:
    return F.lit(GRAIN[ratio]) / (F.sqrt(n) if ratio == "word_length" else n)


def sketches(counts: DataFrame) -> DataFrame:
    """Rows (lang, source, name, bucket, n): the sketch of every ratio and length in every group.

    Rows number distinct buckets, a few hundred a group at most.  Documents that fail the base rules
    aren't counted: they'd set the cutoffs by which the rest is judged.
    """
    bucket = lambda x: F.when(x < 1e-4, F.lit(-1)).otherwise(F.ceil(F.log(x / 1e-4) / log(GAMMA)).cast("int"))
    pairs = [F.struct(F.lit(k).alias("name"), bucket(x).alias("bucket")) for k, x in (ratios() | lengths()).items()]
    return (
        counts.filter(~base_failed())
        .select("lang", "source", F.explode(F.array(*pairs)).alias("r"))
        .groupBy("lang", "source", F.col("r.name").alias("name"), F.col("r.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, rows, q1, q2, q3), from merged sketches."""
    by = Window.partitionBy(*keys, "name")
    upto = F.sum("n").over(by.orderBy("bucket"))
    value = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(F.lit(1e-4) * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value")))
    return (
        sketch.withColumns({"rows": F.sum("n").over(by), "upto": upto, "value": value})
        .groupBy(*keys, "name")
        .agg(F.first("rows").alias("rows"), *(quantile(k / 4).alias(f"q{k}") for k in (1, 2, 3)))
    )


def drawn(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` quartiles drawn towards those of the wider group (joined by ``keys`` and name), which stay as w_q1 ... w_q3."""
    w = wider.select(*[F.col(c).alias(f"w_{c}") for c in [*keys, "name", "q1", "q2", "q3"]])
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in [*keys, "name"]]
    pull = lambda c: (F.col("rows") * F.col(c) + SHRINK * F.col(f"w_{c}")) / (F.col("rows") + SHRINK)
    return own.join(w, same).withColumns({c: pull(c) for c in ("q1", "q2", "q3")}).drop(*[f"w_{c}" for c in [*keys, "name"]])


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, cut): for each group a map from ratio to (least, edge, length), from which ``threshold`` makes a
    text's cutoff: the capped upper quartile, the capped fence, and the group's median length."""
    whole = quartiles(merged(sketch, []), [])
    langs = drawn(quartiles(merged(sketch, ["lang"]), ["lang"]), whole, []).drop("w_q1", "w_q2", "w_q3")
    groups = drawn(quartiles(sketch, ["lang", "source"]), langs, ["lang"]).withColumn("q", F.struct("q2", "q3", "q1", "w_q1", "w_q2", "w_q3"))
    maps = groups.groupBy("lang", "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "q")))).alias("q"))
    out = []
    for k, over in RATIOS.items():
        q, n = F.col("q")[k], F.col("q")[over]
        most = q["w_q3"] + FENCE * F.greatest(q["w_q3"] - q["w_q1"], grain(k, n["w_q2"]))
        edge = F.least(q["q3"] + FENCE * (q["q3"] - q["q1"]), CAP * most)
        out += [F.lit(k), F.struct(F.least(q["q3"], most).alias("least"), edge.alias("edge"), n["q2"].alias("length"))]
    return maps.select("lang", "source", F.create_map(*out).alias("cut"))


def threshold(ratio: str) -> Column:
    """A row's cutoff for a ratio, from its group's ``cut``."""
    cut_ = F.col("cut")[ratio]
    return F.greatest(cut_["edge"], cut_["least"] + FENCE * grain(ratio, F.least(lengths()[RATIOS[ratio]], cut_["length"])))


def cutoff_bytes(rows: DataFrame) -> int:
    """About how much the cutoffs take: names, and 96 bytes a ratio."""
    names = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("lang", "source")), F.lit(96 * len(RATIOS)))
    return rows.agg(F.sum(names.cast("long"))).first()[0] or 0


def judged(counts: DataFrame, cutoff_rows: DataFrame, max_bytes: int = MAX_CUTOFF_BYTES) -> DataFrame:
    """Adds base_failed, failed_ratios (array) and kept; a ratio fails above its cutoff, not at it.

    ``cutoff_rows`` is a checkpoint, whose size Spark doesn't know: it is measured here, and sent to the
    tasks only within ``max_bytes``.

    A group without cutoffs (all its documents failed the base rules) has nothing to be kept.
    """
    f = cutoff_rows.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "cut")
    f = F.broadcast(f) if cutoff_bytes(cutoff_rows) <= max_bytes else f
    failed = F.array_compact(F.array(*[F.when(x > threshold(k), F.lit(k)) for k, x in ratios().items()]))
    return (
        without(counts, ["base_failed", "failed_ratios", "kept", "cut", "f_lang", "f_source"])
        .join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
        .withColumns({"base_failed": base_failed(), "failed_ratios": F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(failed)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_ratios") == 0))
        .drop("f_lang", "f_source", "cut")
    )


def judge_documents(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, lang, source), without the text.

    Null and empty texts fail the base rules; null languages and sources are groups of their own;
    repeated rows are judged alike; texts of any length count whole; an empty table gives no rows.
    Texts are read once.
    """
    counts = cut(with_counts(docs.select("doc_id", "lang", "source", "text"), drop=("text",)))
    return judged(counts, cut(cutoffs(sketches(counts))))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are read twice and never shuffled, unless the cutoffs outgrow MAX_CUTOFF_BYTES; then the join
    moves rows by group, and splits skewed ones.  Null and empty texts fail the base rules and go; repeated rows are
    judged alike; an empty table gives no rows.
    """
    narrow = with_counts(docs.select("lang", "source", "text"), drop=("text",))
    cutoff_rows = cut(cutoffs(sketches(narrow)))
    rows = with_counts(boxed(docs, "lang", "source", "text"), drop=("text",))
    return judged(rows, cutoff_rows).filter("kept").select("boxed_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_ratios")
