"""Mixing sources to target weights by subset-sum budget fitting.

Targets: every source gets its weight's share of all words, but never more than MAX_REPEATS times its
own size; what is above goes to the others by weight.  A source then takes all its documents as often
as that fits, and for the rest of its budget a subset: documents are counted by exact size, each size
gives its proportional number, largest remainders and a bounded-knapsack dynamic program over the
small budget that is left choose how many more of each size, so that sizes add up to the target as
closely as whole documents can.  Which documents of a size those are is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.base import WORD_PATTERN, boxed, cut, read_table, without

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 7
#: Buckets of the seeded hash: a size's documents are counted by bucket, so that no task ranks more than one bucket of them.
BUCKETS = 4096
#: The table of sources is sent to the tasks up to so many bytes; beyond, it is joined.
MAX_SENT_BYTES = 8 << 20
#: The budget left to the dynamic program is below this many words (or below one more document).
KNAPSACK = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """Adds ``size``: the number of words (a null text has none).  A clashing extra column is replaced."""
    return without(docs, ["size"]).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long")))


def targets(names: list[str | None], totals: list[int], weights=WEIGHTS, most: int = MAX_REPEATS) -> list[float]:
    """Each source's target; sources by code point, null last, have the weights in turn."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
    out, open_, left = [0.0] * len(names), set(order), float(sum(totals))
    while open_:
        share = left / sum(weight[i] for i in open_)
        above = [i for i in open_ if share * weight[i] > most * totals[i]]
        if not above:
            for i in open_:
                out[i] = share * weight[i]
            break
        for i in above:
            out[i] = float(most * totals[i])
            left -= out[i]
            open_.discard(i)
    return out


def fit(size: np.ndarray, count: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take, so that the words come nearest to ``budget`` from below.

    Sizes are positive and distinct.
    """
    size, count = size.astype(np.int64), count.astype(np.int64)
    total = int((size * count).sum())
    if budget >= total or not total:
        return count.copy()
    exact = count * (budget / total)
    take = np.minimum(np.floor(exact).astype(np.int64), count)
    left = budget - int((size * take).sum())
    # The largest remainders, until what is left is small enough for the program.
    for i in np.lexsort((-size, take - exact)).tolist():
        if left < knapsack:
            break
        if take[i] < count[i] and size[i] <= left:
            take[i] += 1
            left -= int(size[i])
    for i in np.argsort(-size).tolist():  # only if that wasn't enough: the largest that fit
        if left < knapsack:
            break
        more = min(int(count[i] - take[i]), (left - knapsack) // int(size[i]) + 1)
        take[i] += max(0, more)
        left -= max(0, more) * int(size[i])
    if left <= 0:
        return take
    # Bounded knapsack: bit s of ``reach`` is set if some of the spare documents have s words together.
    reach, full = 1, (1 << (left + 1)) - 1
    via = np.full(left + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in range(len(size)):
        s, spare, part = int(size[i]), int(min(count[i] - take[i], left // size[i])), 1
        while spare > 0:  # counts in powers of two
            n = min(part, spare)
            new = (reach << s * n) & full & ~reach
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))
                via[at] = len(items)
                items.append((i, n))
                reach |= new
            spare -= n
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, n = items[via[at]]
        take[i] += n
        at -= n * int(size[i])
    return take


def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's size counts -> how many documents of each size to take beside the whole passes."""
    target, total = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = min(int(target // total), MAX_REPEATS) if total else 0
    pdf = pdf[["source", "size", "n"]].sort_values("size").reset_index(drop=True)
    extra = np.zeros(len(pdf), np.int64)
    some = (pdf["size"] > 0).to_numpy()
    if passes < MAX_REPEATS and total:
        extra[some] = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], int(round(target)) - passes * total)
    return pdf.assign(passes=np.int64(passes), extra=extra)[["source", "size", "n", "passes", "extra"]]


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> source, source_size, target: what ``targets`` gives for lists, by sorted windows.

    Every target is the source's weight times one level, or ``most`` times its size where that is less.  In the order
    of the levels at which sources stop, the level is what the stopped ones leave over the others' weights; the first
    that doesn't stop the next source counts.  The rows, one for each source, are sorted by one task, which may spill.
    """
    by_name, by_stop, all_rows = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("stops_at", F.col("source").isNull(), "source"), Window.partitionBy()
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    place = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("stops_at", most * F.col("source_size") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("place", F.row_number().over(by_stop))
    level = F.min(F.when(F.col("level") <= F.col("stops_at"), F.struct("place", "level"))).over(all_rows)["level"]
    return rows.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * level)).select("source", "source_size", "target")


def same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def shares(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(id, source, size) -> one row for each distinct (id, source, size): n, how many rows have it, source_size, target,
    passes, how often all of them are taken, and more, how many of the n are taken once more.

    Rows with the same id, source and size are one entry with a count, however many they are.  An entry without words
    is taken once for each whole pass, for no words.  All that meets in one task is a table of sources and, for each
    source, one row for each distinct size.
    """
    key = F.xxhash64(F.lit(seed), F.col("id"))
    bucket = F.pmod(F.shiftrightunsigned(F.col("key"), 20), F.lit(BUCKETS)).cast("int")
    entries = cut(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", key).withColumn("bucket", bucket))
    buckets = cut(entries.groupBy("source", "size", "bucket").agg(F.sum("n").alias("n")))
    counts = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = cut(source_targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    g = F.broadcast(g) if (goals.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)).first()[0] or 0) <= MAX_SENT_BYTES else g
    plan = (
        counts.join(g, same_source("source", "g_source"))
        .drop("g_source")
        .groupBy("source")
        .applyInPandas(plan_source, "source string, size long, n long, passes long, extra long")
    )
    # How many each bucket of a size gives: all of it, none, or (one bucket of each size) a part.
    p = cut(plan).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "passes", "extra")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket"))
    quota = (
        buckets.withColumn("before", upto - F.col("n"))
        .join(p, same_source("source", "p_source") & (F.col("size") == F.col("p_size")))
        .select(
            F.col("source").alias("q_source"),
            F.col("size").alias("q_size"),
            F.col("bucket").alias("q_bucket"),
            "passes",
            F.col("n").alias("in_bucket"),
            F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"),
        )
    )
    dealt = entries.join(quota, same_source("source", "q_source") & (F.col("size") == F.col("q_size")) & (F.col("bucket") == F.col("q_bucket"))).drop("q_source", "q_size", "q_bucket")
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("in_bucket"))
    earlier = F.sum("n").over(Window.partitionBy("source", "size", "bucket").orderBy("key", "id")) - F.col("n")
    whole = dealt.filter(~split).withColumn("more", F.when(F.col("quota") > 0, F.col("n")).otherwise(0))
    part = dealt.filter(split).withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - earlier)))
    return whole.unionByName(part).join(g, same_source("source", "g_source")).select("id", "source", "size", "n", "source_size", "target", "passes", F.col("more").cast("long").alias("more"))


def mix(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size) -> doc_id, source, size, source_size, target, copies, taken: one row for each row.

    Repeated rows count as documents of their own; null ids and sources are values like others; the
    seeded hash goes by id, and ties by the id itself; an empty table gives no rows.
    """
    entries = shares(sized.select(F.col("doc_id").alias("id"), "source", "size"), seed).withColumnRenamed("id", "doc_id")
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("at")
    return (
        entries.select("doc_id", "source", "size", "source_size", "target", "passes", "more", row)
        .withColumn("copies", F.col("passes") + F.when(F.col("at") <= F.col("more"), 1).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row taken k times is there k times.

    Each row is decided on its own, whatever its id: rows are told apart by the SHA-256 of all their columns.  Of equal
    rows, of which it doesn't matter which, some may be taken once more than the others.  Null texts have no words, null
    sources are a source; texts of any length are counted whole; an empty table gives no rows.
    """
    rows = sizes(boxed(docs, "source", "text")).drop("text").withColumn("id", F.unhex(F.sha2(F.to_json("boxed_row"), 256)))
    entries = shares(rows.select("id", "source", "size"))
    entries = cut(entries.select(F.col("id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "n", "passes", "more"))
    joined = rows.join(entries, (F.col("id") == F.col("m_id")) & same_source("source", "m_source") & (F.col("size") == F.col("m_size")))
    alike = (F.col("more") == 0) | (F.col("more") == F.col("n"))
    each = joined.filter(alike).select("boxed_row", (F.col("passes") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("copies"))
    some = joined.filter(~alike).groupBy("id", "source", "size").agg(F.first("boxed_row").alias("boxed_row"), F.first(F.col("n") * F.col("passes") + F.col("more")).alias("copies"))
    taken = each.unionByName(some.select("boxed_row", "copies")).filter("copies > 0")
    return taken.select("boxed_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("m_copy")).select("boxed_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", "taken")
