"""The operators' methods and edge cases: nulls, repeated rows, clashing columns, long texts, empty tables."""

import hashlib
import random
import re
import time
import uuid
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fieldledger.llm import base, byte_bpe, mixing, quality_classifier, quality_rules, secrets, simhash, token_counts, toxicity, url_filter, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, DOCS + more)


# ---- media


def naive_undo(argb, width, height, transforms):
    """The inverse transforms one pixel at a time, as the format's description has them."""
    def parts(v):
        return [int(v) >> k & 255 for k in (24, 16, 8, 0)]

    def whole(p):
        return (p[0] & 255) << 24 | (p[1] & 255) << 16 | (p[2] & 255) << 8 | p[3] & 255

    def average(a, b):
        return [(x + y) // 2 for x, y in zip(a, b)]

    def clamp(x):
        return max(0, min(255, x))

    def guess(mode, l, t, tl, tr):
        if mode == 11:
            pl = sum(abs(a - b) for a, b in zip(t, tl))
            pt = sum(abs(a - b) for a, b in zip(l, tl))
            return l if pl < pt else t
        if mode == 12:
            return [clamp(a + b - c) for a, b, c in zip(l, t, tl)]
        if mode == 13:
            return [clamp(int(m + (m - c) / 2)) if (m - c) >= 0 else clamp(m + -((c - m) // 2)) for m, c in zip(average(l, t), tl)]
        return {0: [255, 0, 0, 0], 1: l, 2: t, 3: tr, 4: tl, 5: average(average(l, tr), t), 6: average(l, tl), 7: average(l, t), 8: average(tl, t), 9: average(t, tr), 10: average(average(l, tl), average(t, tr))}[mode]

    out = [parts(v) for v in argb]
    for kind, bits, tiles in reversed(transforms):
        across = -(-width >> bits) if bits is not None else 0
        for y in range(height):
            for x in range(width):
                p, at = out[y * width + x], y * width + x
                if kind == webp.SUBTRACT_GREEN:
                    out[at] = [p[0], (p[1] + p[2]) & 255, p[2], (p[3] + p[2]) & 255]
                    continue
                tile = parts(tiles[(y >> bits) * (-(-width // (1 << bits))) + (x >> bits)])
                if kind == webp.CROSS_COLOUR:
                    s = lambda v: v - 256 if v > 127 else v
                    red = (p[1] + (s(tile[3]) * s(p[2]) >> 5)) & 255
                    blue = p[3] + (s(tile[2]) * s(p[2]) >> 5) + (s(tile[1]) * s(red) >> 5)
                    out[at] = [p[0], red, p[2], blue & 255]
                elif x == 0 and y == 0:
                    out[at] = [(p[0] + 255) & 255, *p[1:]]
                else:
                    if y == 0:
                        g = out[at - 1]
                    elif x == 0:
                        g = out[at - width]
                    else:
                        g = guess(tile[2], out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
                    out[at] = [(a + b) & 255 for a, b in zip(p, g)]
    return np.array([whole(p) for p in out], np.uint32).reshape(height, width)


def assembled(seed):
    """A file put together by hand: two code groups by tile, colour cache, back-references, three transforms; and its pixels."""
    r = random.Random(seed)
    width, height, cache_bits, tile = 13, 11, 3, 2
    across, down = -(-width // 4), -(-height // 4)
    w = webp.Writer()
    webp.head(w, width, height)
    transforms = []
    for kind in r.sample([webp.SUBTRACT_GREEN, webp.CROSS_COLOUR, webp.PREDICTOR], 3):
        w.put(1, 1)
        w.put(kind, 2)
        if kind == webp.SUBTRACT_GREEN:
            transforms.append((kind, None, None))
            continue
        w.put(tile - 2, 3)
        tiles = [255 << 24 | r.randrange(256) << 16 | r.randrange(14 if kind == webp.PREDICTOR else 256) << 8 | r.randrange(256) for _ in range(across * down)]
        webp.write_colours(w, np.array(tiles, np.uint32).reshape(down, across), False)
        transforms.append((kind, tile, tiles))
    w.put(0, 1)
    w.put(1, 1)
    w.put(cache_bits, 4)
    w.put(1, 1)  # a code group for each tile
    w.put(tile - 2, 3)
    groups = [r.randrange(2) for _ in range(across * down)]
    groups[:2] = [0, 1]
    webp.write_colours(w, np.array([g << 8 | 255 << 24 for g in groups], np.uint32).reshape(down, across), False)
    size = webp.GREEN + (1 << cache_bits)
    counts = [[np.array([r.randrange(1, 50) for _ in range(n)]) for n in (size, 256, 256, 256, webp.DISTANCE)] for _ in range(2)]
    codes = [[webp.write_prefix(w, c) for c in group] for group in counts]
    pixels, cache = [], [0] * (1 << cache_bits)

    def put(which, symbol, k):
        table = codes[k][which]
        w.put(int(table[0][symbol]), int(table[1][symbol]))

    def keep(v):
        pixels.append(v)
        cache[(webp.CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while len(pixels) < width * height:
        y, x = divmod(len(pixels), width)
        k = groups[(y >> tile) * across + (x >> tile)]
        choice = r.random()
        if choice < 0.5 or not pixels:
            a, red, g, b = (r.randrange(256) for _ in range(4))
            for which, symbol in enumerate((g, red, b, a)):
                put(which, symbol, k)
            keep(a << 24 | red << 16 | g << 8 | b)
        elif choice < 0.7:
            n = r.randrange(1 << cache_bits)
            put(0, webp.GREEN + n, k)
            keep(cache[n])
        else:
            length, distance = r.randint(1, min(20, width * height - len(pixels))), r.randint(1, len(pixels))
            coded = distance + 120
            near = [i + 1 for i, (dx, dy) in enumerate(webp.NEAR) if max(1, dx + dy * width) == distance]
            if near and r.random() < 0.7:
                coded = r.choice(near)
            for which, value in ((0, length), (4, coded)):
                symbol, extra, n = (int(v) for v in webp.split_value([value])[:, 0])
                put(which, symbol + (256 if which == 0 else 0), k)
                if n:
                    w.put(extra, n)
            for _ in range(length):
                keep(pixels[-distance])
    return webp.file_of(w), naive_undo(pixels, width, height, transforms)


@pytest.mark.parametrize("seed", range(12))
def test_webp_reads_hand_assembled_streams(seed):
    data, pixels = assembled(seed)
    assert (webp.decode(data) == pixels).all()


def test_webp_near_distances():
    assert webp.NEAR[:10] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1)] and webp.NEAR[-2:] == [(8, 6), (8, 7)] and len(webp.NEAR) == 120


def test_webp_tables(spark):
    clash = spark.createDataFrame([(1, "x", 5, "m"), (1, "x", 5, "m"), (2, None, 5, "m")], "doc_id long, text string, N_bytes long, Media string")
    got = webp.read_media(webp.with_media(clash)).orderBy("doc_id").collect()
    assert [r["n_bytes"] for r in got] == [1, 1, 0] and got[0]["payload_sha256"] == got[1]["payload_sha256"] and got[2]["payload_bytes"] == 576
    assert webp.media_digests(clash).select("payload_sha256", "media_sha256", "feature").orderBy("media_sha256").collect() == webp.read_media(webp.with_media(clash)).select("payload_sha256", "media_sha256", "feature").orderBy("media_sha256").collect()
    assert webp.media_digests(clash.limit(0)).count() == 0


def test_webp_largest_payload():
    p = np.random.default_rng(0).integers(97, 123, 576 * 16411, np.uint8).tobytes()
    assert webp.decode_payload(webp.encode_payload(p, "palette"))[1] == p


# ---- token counts


def test_token_counts_at_every_prefix(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))
    values = ["the cat sat on a mat", "", None, "  a\tb 文字 unbelievable 12345 --- x", "aaaa" * 60]
    rows = docs_of(spark, [(i, t, None, None, 0) for i, t in enumerate(values)] * 2, "").withColumn("n_tokens", F.lit("mine"))
    counted = token_counts.with_token_counts(rows, prefix_tables=True)
    assert counted.count() == 10 and counted.limit(0).count() == 0
    for r in counted.select("text", "prefix_tokens", token_counts.count_at(3).alias("three"), token_counts.chars_within(4).alias("four"), token_counts.chars_within(-1).alias("none")).collect():
        t = r["text"] or ""
        want = [len(model.encode(t[:k])) for k in range(len(t) + 1)]
        assert r["prefix_tokens"] == want and r["three"] == want[min(3, len(t))] and r["none"] is None
        assert r["four"] == max(k for k, n in enumerate(want) if n <= 4)


# ---- mixing


def test_knapsack_against_all_subsets():
    r = random.Random(9)
    for _ in range(40):
        size = np.array(sorted(r.sample(range(1, 40), 4)))
        count = np.array([r.randint(0, 3) for _ in size])
        budget = r.randint(0, int((size * count).sum()))
        take = mixing.fit(size, count, budget)
        reach = max(s for s in (sum(a * int(b) for a, b in zip(c, size)) for c in product(*[range(n + 1) for n in count])) if s <= budget)
        assert (size * take).sum() <= budget and (take <= count).all()
        # the proportional part is fixed first; what is left is filled as closely as the rest allows
        base_take = np.minimum(np.floor(count * (budget / max(1, int((size * count).sum())))).astype(int), count)
        left = budget - int((size * base_take).sum())
        rest = max(s for s in (sum(a * int(b) for a, b in zip(c, size)) for c in product(*[range(n + 1) for n in count - base_take])) if s <= left)
        assert (size * take).sum() == int((size * base_take).sum()) + rest <= reach


def test_targets_by_windows_are_those_of_the_list(spark):
    r = random.Random(2)
    for n in (1, 2, 7, 30):
        rows = [(f"s{k:02d}" if k else None, r.choice([0, 1, 5, 40, 1000, 50_000])) for k in range(n)]
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = mixing.targets([a for a, _ in rows], [b for _, b in rows])
        assert [got[a] for a, _ in rows] == pytest.approx(want)
    assert mixing.source_targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mixing_of_repeated_and_null_ids(spark):
    r = random.Random(6)
    rows = [(None if k % 3 == 0 else k % 40, "w " * r.randint(0, 30), "en", "abc"[k % 3 if k % 7 else 0], k if k % 5 else 0) for k in range(600)]
    rows += [(5, "same text here", "en", "b", 1)] * 100 + [(9, None, None, None, None)] * 3
    docs = docs_of(spark, rows)
    targets = {x["source"]: x["target"] for x in mixing.mix(mixing.sizes(docs)).select("source", "target").distinct().collect()}
    for stage in (mixing.mixed_documents(docs), mixing.mixed_documents(docs.repartition(5))):
        words = {x["source"]: x["n"] for x in mixing.sizes(stage).groupBy("source").agg(F.sum("size").alias("n")).collect()}
        assert all(abs(words.get(s, 0) - t) <= 1 for s, t in targets.items())
    taken = mixing.mixed_documents(docs).groupBy(*docs.columns).count().collect()
    had = {tuple(x)[:-1]: x[-1] for x in docs.groupBy(*docs.columns).count().collect()}
    assert all(x["count"] <= 3 * had[tuple(x)[:-1]] for x in taken)
    assert sorted(map(tuple, taken), key=str) == sorted(map(tuple, mixing.mixed_documents(docs.repartition(3)).groupBy(*docs.columns).count().collect()), key=str)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# ---- classifiers


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(3)
    positive = r.normal(2, 1, (2000, 2))
    for prior in (0.3, 0.7):
        n = int(3000 * prior)
        web = np.vstack([r.normal(2, 1, (n, 2)), r.normal(-2, 1, (3000 - n, 2))])
        model = quality_classifier.train(positive, web, 0.5)
        assert abs(model.constant - prior) < 0.08
        w = np.array(model.weights)
        right = ((web @ w[:-1] + w[-1] > 0) == (np.arange(3000) < n)).mean()
        assert right > 0.97


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_take_odd_tables(spark, module, label):
    r = random.Random(1)
    word = lambda: "".join(r.choice("ba ko ri tu len mo sta ver gol pi ash und or eth il wy za hem quo fi".split()) for _ in range(r.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(60)) + f" {k}"
    foul = lambda k: " ".join("&&&" if label == "quality" and j % 2 else r.choice(["zorgblat", "fnordick"]) if j % 9 == 0 else word() for j in range(60)) + f" {k}"
    rows = [(k, prose(k) if k % 2 else foul(k)) for k in range(400)]
    long = "quiet river stone " * 200_000
    rows += [(500, long), (501, None), (502, ""), (None, "quiet farm"), (1, prose(1)), (1, prose(1))]
    docs = spark.createDataFrame([(*x, "x", True) for x in rows], "doc_id long, text string, score string, held_out boolean")
    good = 1 if label == "quality" else 0
    labels = spark.createDataFrame([(k, good if k % 2 else 1 - good) for k in range(400)] + [(1, good), (3, None), (None, 1), (500, good)], f"doc_id long, {label} int")
    out = module.score_documents(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    got = out.toPandas()
    assert got["score"].between(0, 1).all()
    test = got[got["held_out"] & (got["doc_id"] < 400)]
    want = [(good if int(k) % 2 else 1 - good) for k in test["doc_id"]]
    assert (test["predicted"].to_numpy() == want).mean() >= 0.9
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_toxic_dictionaries_come_from_their_classes():
    r = random.Random(4)
    syllables = "ba ko ri tu len mo sta ver gol pi".split()
    prose = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(80)) for _ in range(200)]
    foul = [" ".join(w if j % 20 else r.choice(["zorgblat", "fnordick", "wuggishly"]) for j, w in enumerate(t.split())) for t in prose[:100]]
    model = toxicity.train(prose[100:] + foul, [0] * 100 + [1] * 100)
    assert all(w in d and w not in model.dictionaries.ordinary for w in (b"Zorgbl", b"Fnordi", b"Wuggis") for d in (model.dictionaries.toxic, model.dictionaries.strict))
    distance = toxicity.Distance(model.dictionaries)
    assert min(distance.saved(b"zorgblat")) >= toxicity.LEAST_SAVING and max(*distance.saved(b"ristaver"), *distance.saved(b"azorgblat")) < toxicity.LEAST_SAVING


def test_stems_are_told_by_density():
    """A stem that ordinary texts use seldom and toxic ones often marks those, though no word is theirs alone."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("ba ko ri tu len mo sta ver gol pi".split()) for _ in range(r.randint(2, 4)))
    text = lambda share: " ".join(("xulph" if r.random() < share else "") + word() for _ in range(300))
    rows = [(text(0.03), 1) for _ in range(80)] + [(text(0.002), 0) for _ in range(300)]
    model = toxicity.train(*zip(*rows))
    distance = toxicity.distance_of(model)
    score = lambda share: float(np.dot(distance.features(text(share)), model.weights))
    cut = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    assert sum(score(0.03) >= cut for _ in range(40)) >= 37 and sum(score(0.002) < cut for _ in range(40)) >= 37


# ---- quality rules


def lines_of(r, n, kinds):
    return " ".join(f"{r.choice(kinds)}{r.randrange(10**4)}" for _ in range(n))


def test_cutoffs_follow_the_source(spark):
    r = random.Random(0)
    even, uneven = ["abcd"], ["a", "abcdefghijkl", "abcdefg"]
    rows = [(k, lines_of(r, 400, even), "en", "even", 0) for k in range(200)]
    rows += [(1000 + k, lines_of(r, 25 + k % 9, [r.choice(uneven)]), "en", "uneven", 0) for k in range(200)]
    text = lines_of(r, 40, ["abcdefghijkl"])
    rows += [(5000, text, "en", "even", 0), (5001, text, "en", "uneven", 0), (5002, text, None, None, 0), (5003, "few words", None, "none kept", 0), (5004, None, "de", None, 0)]
    got = {x["doc_id"]: x for x in quality_rules.judge_documents(docs_of(spark, rows)).collect()}
    assert not got[5000]["kept"] and got[5001]["kept"] and got[5000]["failed_ratios"] == ["word_length"]
    assert got[5003]["base_failed"] and got[5004]["base_failed"] and not got[5003]["kept"]
    assert len(got) == len(rows)
    # a source that is mostly junk doesn't exempt its junk
    junk = [(9000 + k, " ".join(f"{w}&&&" for w in lines_of(r, 200, even).split()), "en", "junk", 0) for k in range(30)]
    got = {x["doc_id"]: x for x in quality_rules.judge_documents(docs_of(spark, rows + junk)).collect()}
    assert not any(got[9000 + k]["kept"] for k in range(30))


def test_sketch_quartiles_and_merging(spark):
    r = random.Random(5)
    rows = [(k, lines_of(r, r.randint(20, 300), ["ab", "abcdef"]), "en" if k % 2 else None, f"s{k % 3}", 0) for k in range(300)]
    counts = quality_rules.with_counts(docs_of(spark, rows)).cache()
    whole = quality_rules.quartiles(quality_rules.merged(quality_rules.sketches(counts), []), [])
    exact = counts.agg(*[F.expr(f"percentile_disc({q}) within group (order by word_chars / n_words)").alias(f"q{int(4 * q)}") for q in (0.25, 0.5, 0.75)]).first()
    got = whole.filter("name = 'word_length'").first()
    assert all(abs(got[f"q{k}"] / exact[f"q{k}"] - 1) < 0.021 for k in (1, 2, 3)) and got["rows"] == 300
    halves = [quality_rules.sketches(counts.filter(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    order = ["lang", "source", "name", "bucket"]
    again = halves[1].unionByName(halves[0]).groupBy(*order).agg(F.sum("n").alias("n"))
    assert again.orderBy(*order).collect() == quality_rules.sketches(counts).select(*again.columns).orderBy(*order).collect()
    by_join = quality_rules.judged(counts, base.cut(quality_rules.cutoffs(quality_rules.sketches(counts))), max_bytes=0)
    sent = quality_rules.judge_documents(docs_of(spark, rows))
    assert {x["doc_id"]: x["kept"] for x in by_join.collect()} == {x["doc_id"]: x["kept"] for x in sent.collect()}


def test_quality_rules_on_a_long_text(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    got = quality_rules.judge_documents(docs_of(spark, [(1, long, "en", "a", 0), (1, long, "en", "a", 0)])).collect()
    assert [x["n_words"] for x in got] == [400_000] * 2 and got[0] == got[1]


# ---- secrets


def brute_spans(text):
    found = [(m.start(), m.end(), "jwt") for m in re.finditer(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", text)]
    others = [s for s in secrets.find_spans(text) if s[2] not in ("jwt", "entropy")] + found
    for m in secrets.ENTROPY_WORD.finditer(text):
        if any(c.isdigit() for c in m[0]) and secrets.entropy(m[0]) >= secrets.LEAST_ENTROPY and not any(a < m.end() and m.start() < b for a, b, _ in others):
            others.append((m.start(), m.end(), "entropy"))
    return sorted(others, key=lambda x: (x[0], secrets.KINDS.index(x[2]), x[1]))


def test_added_spans_against_brute_force():
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(400):
        bits = ["eyJ", "eyJabcdefgh", ".", ".eyJ12345678", "-", " ", "x", "AKIA" + "A" * 16, "0123456789abcdef", "token=abcdefghijkl", "".join(r.choice(alphabet) for _ in range(40)), "ghp_" + "a" * 36]
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 16)))
        assert secrets.find_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("piece", ["eyJabcdefgh", "eyJabcdefgh.", "Abc9" * 10 + " deadbeefdeadbeef ", "-----BEGIN ", "token=", "password "])
def test_secrets_are_found_in_linear_time(piece):
    began = time.time()
    secrets.find_spans(piece * (4_000_000 // len(piece)))
    assert time.time() - began < 10


def test_ledger_is_kept_and_read(spark):
    ledger = secrets.new_ledger(spark)
    first = docs_of(spark, [(1, "token=abcdefabcdef12", "en", "a", 0), (2, None, None, None, 0), (3, "plain", "en", "a", 0), (3, "plain", "en", "a", 0)])
    findings, added = secrets.scan_versions(first, ledger)
    assert added.count() == 3 and findings.count() == 4
    second = first.unionByName(docs_of(spark, [(4, "token=abcdefabcdef12", "en", "b", 0), (5, "AKIA" + "Z" * 20, "en", "b", 0)]))
    findings, added = secrets.scan_versions(second, ledger)
    assert added.count() == 1 and {x["doc_id"]: x["n_assign"] + x["n_access"] for x in findings.collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    findings, added = secrets.scan_versions(second, ledger)
    assert added.count() == 0 and findings.count() == 6 and ledger.rows().count() == 4
    assert secrets.scan_versions(second, ledger, rule_version="next")[1].count() == 4
    apart = secrets.scan_versions(second, ledger, max_bytes=0)[0]
    assert sorted(map(str, apart.select(*findings.columns).collect())) == sorted(map(str, findings.collect()))
    assert secrets.scan_unseen(secrets.with_blobs(second), ledger.rows("other"), max_bytes=0).count() == 4
    assert secrets.scan_versions(first.limit(0), secrets.new_ledger(spark))[0].count() == 0
    for most in (0, secrets.MAX_SENT_BYTES):
        clean = {x["doc_id"]: x["text"] for x in secrets.redact_documents(second, max_bytes=most).collect()}
        assert clean == {1: "[assign]", 2: None, 3: "plain", 4: "[assign]", 5: "[access]"}


def test_later_commits_scan_new_blobs_only(spark):
    texts = ["token=abcdefabcdef12", "plain", None, "", "AKIA" + "Z" * 20, "token=abcdefabcdef12"]
    docs = docs_of(spark, [(k, texts[k % 6], "en", "a", 0) for k in range(60)])
    ledger = secrets.new_ledger(spark)
    out = secrets.scan_commits([docs.filter("doc_id < 20"), docs.filter("doc_id between 20 and 39"), docs.filter("doc_id > 39")], ledger)
    assert spark.read.parquet(ledger.path).count() == 4  # each blob was scanned once: a null text is an empty one
    whole, _ = secrets.scan_versions(docs, secrets.new_ledger(spark))
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.select(*out.columns).collect()))
    rows, found = secrets.with_blobs(docs), ledger.rows().filter("length(spans) > 0").select(F.col("blob").alias("f_blob"), "spans")
    joined = [secrets.joined_by_blob(rows.select("doc_id", "blob"), found, most, hot) for most, hot in ((1 << 20, 5), (0, 15), (0, 1000), (0, 0))]
    assert len({tuple(sorted(map(str, x.select("doc_id", "spans").collect()))) for x in joined}) == 1


# ---- urls, byte pairs, near duplicates


def test_url_filter_takes_odd_tables(spark):
    long = "http://" + "a." * 300 + "com/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long, "r"), (2, "https://example.com/en/", "r"), (2, "https://example.com/en/", "r"), (3, None, "r")], "page_id long, url string, Rule string")
    want = {1: ("com/", "allow"), 2: ("example.com/en/", "block"), 3: (None, "allow")}
    weak = lambda k: F.pmod(F.xxhash64(k), F.lit(3)).cast("long")
    for hashed in (F.xxhash64, weak):  # with three hash values keys collide, and the join takes the cascade's place
        got = url_filter.judge_urls(pages, key_hash=hashed).collect()
        assert len(got) == 4 and all((x["rule"], x["verdict"]) == want[x["page_id"]] for x in got)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_byte_bpe_takes_odd_tables(spark):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))  # one pre-token
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (2, None, "x")], "doc_id long, text string, N_tokens string")
    got = byte_bpe.encode_documents(docs).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(enc.encode_ordinary(long)), 0, 0] and got[0]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_hot_copies_and_components(spark, monkeypatch):
    """The same components whether copies and members are above or below what counts as hot."""
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(9)}" for _ in range(50_000))
    values = ["one text that has many copies"] * 40 + [None, "", long, long] + [" ".join(f"w{r.randrange(6)}" for _ in range(6)) for _ in range(60)]
    docs = docs_of(spark, [(k, t, None, None, 0) for k, t in enumerate(values)])
    want = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()}
    assert len(want) == len(values) and want[40] == want[41] and want[39] == 0
    monkeypatch.setattr(simhash, "join_by_weight", lambda *a: base.join_by_weight(*a, hot=1))
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()} == want


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        base.shared_folder(Session())


# ---- pipeline


def test_pipeline_stages_take_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    rows = [(k % 50 if k % 4 else None, lines_of(r, r.randint(20, 80), ["ab", "abcdef"]) + f" token=abcdefabcd{k:04d}", "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None, f"v{k}") for k in range(120)]
    rows += [(7, None, None, None, None, "x")] * 3 + rows[:5]
    docs = docs_of(spark, rows, ", N_words string")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in pipeline.STAGES[:-1]:
            after = pipeline.written(stage(spark, now, ""), f"{name}-{uuid.uuid4().hex}")
            assert after.columns == docs.columns
            if name == "quality_rules":
                assert after.exceptAll(now).count() == 0
            if name == "secrets":
                assert after.count() == now.count() and after.filter(F.col("text").contains("token=")).count() == 0
            now = after
        out = pipeline.STAGES[-1][1](spark, now, "")
        assert out.count() == now.count()
