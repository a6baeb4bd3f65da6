"""What the findings of round 4 asked for: the report jobs' work and disk at size."""

from pyspark.sql import functions as F

from fieldledger.jobs import reports
from fieldledger.operators import lines, semantics


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_play_sequence_reads_plays_once_and_exchanges_nothing(spark):
    """F1 to F18: the texts were parsed twice, for the events and for the gaps between them, and moved three times."""
    plays = spark.createDataFrame([("g", 1, "IND", "SEA", "O.Abel right end to SEA 9 for 2 yards (D.Cole). Then it rained")], "game_id string, play_index long, possession string, defence string, description string")
    plan = plan_of(semantics.play_sequence(plays.repartition(4, "game_id")))
    assert (plan.count("Exchange "), plan.count("Union"), plan.count("Scan ExistingRDD")) == (1, 0, 1)


def test_one_pattern_gives_what_the_first_grammar_row_gives(spark):
    """Each row of the grammar alone, and texts that several rows fit."""
    texts = ["O.Abel pass incomplete deep left intended for T.Birch.", "O.Abel pass short left intended for T.Birch INTERCEPTED by D.Cole (x) [y] at SEA 5.", "O.Abel to SEA 9 for 3 yards, TOUCHDOWN.", "O.Abel to SEA 9.", "o.abel PASS to T.Birch", "Handoff to O.Abel for no gain", "K.Foot 40 yard field goal is BLOCKED", "O.Abel sacked ob at 50 for -3 yards", "O.Abel", "nothing"]
    pattern, framed = semantics.one_pattern()
    d = spark.createDataFrame([(t,) for t in texts], "rest string").withColumn("parts", F.split(F.regexp_replace("rest", pattern, framed), semantics.FRAME, -1))
    got = {r["rest"]: r["a"] for r in d.withColumn("a", semantics.action_of("parts")).collect()}
    for text in texts:
        fits = []
        for kind, rule, p, fields in semantics.GRAMMAR:
            at = "(?i)^" + p
            row = spark.range(1).select(F.lit(text).alias("t")).filter(F.col("t").rlike(at)).select(F.regexp_extract("t", at, 0), *[F.nullif(F.regexp_extract("t", at, k), F.lit("")).alias(f) for f, k in fields.items()]).first()
            if row:
                fits.append((kind, rule, row[0], {f: v for f, v in zip(fields, row[1:]) if v is not None}))
        a = got[text]
        found = (a["action_type"], a["rule"], a["text"], {f: a[f] for f in semantics.FIELDS if a[f] is not None})
        assert found == (fits[0] if fits else (None, None, None, {})), text


def test_report_is_made_without_exchanging_its_words(spark, monkeypatch):
    """F19 to F30: each word, then each line twice, was written to disk on the way; only the chart's rows are, where they are joined by broadcast."""
    once = reports.Reports.once
    monkeypatch.setattr(reports.Reports, "once", lambda self, name, make: make() if name == "report" else once(self, name, make))
    plan = plan_of(reports.Reports(spark, "/root/testdata/sf0.001").report)
    assert plan.count("Exchange hashpartitioning") <= 1 and "Arrow" not in plan


def test_lines_start_where_a_word_leaves_the_line(spark):
    """More lines than one list of starts holds, words in any order, blank ones and words without a place."""
    n, step = 3 * lines.CHUNK + 5, 0.4
    rows = [("g", 1, i, f"w{i}" if i % 7 else " ", 0.0, -step * i, 1.0) for i in range(n)]
    got = lines.rebuild_lines(spark.createDataFrame(rows[::-1], "game_id string, page int, item_idx int, text string, x double, y double, width double")).orderBy("line_no").collect()
    expected, anchor = [], None
    for _, _, i, text, _, y, _ in rows:
        if text.strip():
            if anchor is None or abs(anchor - y) > 1.0:
                anchor = y
                expected.append([])
            expected[-1].append(text)
    assert [r["text"].split() for r in got] == expected and [r["line_no"] for r in got] == list(range(1, len(expected) + 1))


def test_names_are_linked_where_the_plays_lie(spark):
    """a full join lost how the mentions lie, and they were made three times for the kinds of match."""
    plan = plan_of(reports.QUERIES["play_players"](spark, "/root/testdata/sf0.001"))
    assert "Exchange hashpartitioning" not in plan and plan.count(".sequence_") == 1
