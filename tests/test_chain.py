"""One chain from a report's words to its plays and drives: page ranges, headings, the report's own teams, the chart."""

import time

import pytest
from pyspark.sql import functions as F

from fieldledger.functions.spots import COLOURS
from fieldledger.jobs import reports
from fieldledger.operators import lines, plays, quality, replay, sections, semantics
from fieldledger.sources import tables

ITEMS = "game_id string, page int, item_idx int, text string, x double, y double, width double"
SF = "/root/testdata/sf0.001"


def report(spark, pages, visitor="Lake Foxes", home="Salt Wolves"):
    """Lines of game g: a summary page with the teams, then ``pages`` of texts, one line each."""
    rows = [(1, 780.0, 150.0, sections.SUMMARY), (1, 700.0, 20.0, "VISITOR:"), (1, 680.0, 20.0, "HOME:")]
    rows += [(1, y, 90.0 + 40 * k, w) for y, name in ((700.0, visitor), (680.0, home)) for k, w in enumerate(name.split())]
    rows += [(page, 760.0 - 12 * k, 20.0 + 5 * j, w) for page, texts in pages.items() for k, t in enumerate(texts) for j, w in enumerate(t.split())]
    return lines.rebuild_lines(spark.createDataFrame([("g", p, i, t, x, y, 4.0) for i, (p, y, x, t) in enumerate(rows)], ITEMS))


def read(d):
    """(classified lines, plays in order) of a report's lines."""
    team_rows = sections.team_dim(sections.teams(d), COLOURS)
    classified = plays.classify_lines(lines.play_pages(d.select("game_id", "page", "line_no", "text")), sections.team_sides(team_rows))
    return classified, plays.assemble_plays(classified).orderBy("play_index").collect()


FIRST = ["First Quarter", "Play By Play", "Salt Wolves at 15:00", "1-10-SW 25 (15:00) A.Abel left end to SW 29 for 4 yards."]


def test_pages_after_the_range_hold_no_plays(spark):
    d = report(spark, {2: FIRST, 3: ["Miscellaneous Statistics Report", "Ten longest plays", "1-10-SW 25 (9:00) B.Birch left end for 9 yards."], 4: ["1-10-50 (8:00) C.Cole left end for 1 yard."]})
    assert [p["description"] for p in read(d)[1]] == ["A.Abel left end to SW 29 for 4 yards."]
    assert read(report(spark, {2: FIRST[2:]}))[1] == []  # no first play-by-play page


def test_a_heading_counts_wherever_it_stands(spark):
    d = report(spark, {2: FIRST, 3: ["Week 3 Second Quarter Play By Play 2", "2-6-SW 29 (14:20) A.Abel left end for 1 yard."], 4: ["3-5-SW 30 (13:50) A.Abel left end for 2 yards."], 5: ["All of Overtime here", "1-10-50 (9:00) B.Birch left end for 3 yards."]})
    assert [p["quarter"] for p in read(d)[1]] == [1, 2, 2, 5]


def test_teams_of_no_league_keep_their_drives(spark):
    d = report(spark, {2: [*FIRST, "Lake Foxes at 12:00", "1-10-LF 30 (12:00) B.Birch left end for 3 yards."]})
    classified, got = read(d)
    assert [p["possession"] for p in got] == ["SW", "LF"]
    drives, _ = plays.attach_drives(plays.drive_starts(classified), plays.with_yards(plays.assemble_plays(classified)))
    assert {(r["drive_id"], r["plays"], r["net_yards"]) for r in drives.collect()} == {("drive-SW-1", 1, 4), ("drive-LF-1", 1, 3)}


def test_chart_rows_without_starts_and_starts_without_rows(spark):
    starts = spark.createDataFrame([("g", "H", 1, "9:00", 0, 1, 1), ("g", "H", 1, "8:00", 2, 2, 2), ("g", "V", 2, "7:00", 4, 3, 1), ("g", "H", 2, "6:00", 6, 4, 3)], "game_id string, team_id string, quarter int, start_clock string, first_index long, start_no int, team_drive_number int")
    p = spark.createDataFrame([("g", i, "H" if i < 4 else "V", 1) for i in range(6)], "game_id string, play_index long, possession string, yards int")
    chart = spark.createDataFrame([("g", "H", 1, "Punt"), ("g", "V", 1, "Downs"), ("g", "V", 2, "Punt"), ("g", "H", 3, "End of Game")], "game_id string, team_id string, team_drive_number int, result string")
    drives, inside = plays.attach_chart(chart, starts, p)
    got = {r["drive_id"]: (r["quarter"], r["first_play_index"], r["last_play_index"], r["owned_plays"]) for r in drives.collect()}
    assert got == {"drive-H-1": (1, 0, 3, 4), "drive-V-1": (2, 4, 5, 2), "drive-V-2": (0, -1, -1, 0), "drive-H-3": (2, 6, 6, 0)}
    # the second drive of H has no row: its plays stay with the first, whose range holds them too
    assert [r["drive_id"] for r in plays.with_drive_id(p, inside).orderBy("play_index").collect()] == ["drive-H-1"] * 4 + ["drive-V-1"] * 2


@pytest.mark.parametrize("step", [0.04, 0.9, 12.0])
def test_long_pages_are_rebuilt_in_linear_time(spark, step):
    n = 20_000
    items = spark.range(n).select(F.lit("g").alias("game_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("item_idx"), F.lit("w").alias("text"), F.col("id").cast("double").alias("x"), (-step * F.col("id")).alias("y"), F.lit(1.0).alias("width"))
    lines.rebuild_lines(items.limit(10)).collect()
    began = time.time()
    got = lines.rebuild_lines(items).agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).first()
    assert got["items"] == n and time.time() - began < 8  # quadratic folds take minutes
    anchor, count = None, 0
    for k in range(n):
        if anchor is None or abs(anchor + step * k) > 1.0:
            anchor, count = -step * k, count + 1
    assert got["n"] == count


def test_marks_name_pages(spark):
    d = lines.with_marks(report(spark, {2: ["Final Team Statistics", "a"], 3: ["b", "Final Team Statistics"]}), sections.MARKERS)
    got = {(r["page"], tuple(r["page_marks"]), tuple(r["first_marks"])) for r in d.collect()}
    assert got == {(1, (sections.SUMMARY,), (sections.SUMMARY,)), (2, ("Final Team Statistics",), ("Final Team Statistics",)), (3, ("Final Team Statistics",), ())}
    plain = d.drop("page_marks", "first_marks")
    for first in (True, False):
        assert sorted(map(str, sections.marked_pages(d.select(*plain.columns, "page_marks", "first_marks"), "Final Team Statistics", first).select(*plain.columns).collect())) == sorted(map(str, sections.marked_pages(plain, "Final Team Statistics", first).collect()))


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    a = spark.range(500).select((F.col("id") % 37).cast("string").alias("game_id"), F.col("id").alias("n"))
    tables.write_bucketed(a, "bucketed_a", str(tmp_path / "a"), 3, order=("n",))
    back = tables.read_bucketed(spark, "bucketed_a")
    assert sorted(back.collect()) == sorted(a.collect())
    assert len([x for x in (tmp_path / "a").iterdir() if x.name.startswith("part-")]) == 3
    by_game = back.groupBy("game_id").agg(F.sum("n").alias("s")).join(back.groupBy("game_id").agg(F.count("*").alias("c")).hint("merge"), "game_id")
    assert "Exchange" not in by_game._jdf.queryExecution().executedPlan().toString() and by_game.count() == 37
    spark.sql("DROP TABLE bucketed_a")


def test_game_totals_has_no_exchange(spark):
    plan = reports.QUERIES["game_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


PLAYS = "game_id string, play_index long, possession string, defence string, description string"


def events_of(spark, *texts):
    return semantics.play_sequence(spark.createDataFrame([("g", i, "NE", "IND", t) for i, t in enumerate(texts)], PLAYS))


def test_events_name_the_action_before_them(spark):
    d = events_of(
        spark,
        "A.Abel pass short left to C.Cole to IND 30 for 9 yards. FUMBLES, RECOVERED by IND-D.Drake at IND 28.",
        "K.Kane 44 yard field goal is BLOCKED (B.Birch), Center-T.Tate, Holder-H.Hill.",
        "P.Pratt punts 40 yards to IND 10, is BLOCKED (B.Birch).",
        "A.Abel pass short left to C.Cole for 9 yards, TOUCHDOWN.",
    )
    got = {(r["play_index"], r["event_type"], r["actor"], r["team_id"], r["location"], r["result"]) for r in semantics.play_events(d).collect()}
    assert got == {
        (0, "fumble", "A.Abel", "NE", None, None), (0, "recovery", "D.Drake", "IND", "IND 28", None), (0, "possession-change", "D.Drake", "IND", "IND 28", "recovery"),
        (1, "block", "B.Birch", "IND", None, "field-goal"), (2, "block", "B.Birch", "IND", None, "kick"), (3, "touchdown", "C.Cole", "NE", None, None),
    }


def test_timeouts_belong_to_the_last_review_in_list_order(spark):
    """Challenges come before official reviews in the list, wherever they stand; a timeout before all reviews is nobody's."""
    d = events_of(
        spark,
        "(Timeout #3 by NE.) A.Abel left end for 1 yard. The Replay Official reviewed the spot ruling, and the play was Upheld. Foxes challenged the catch ruling, and the play was confirmed. (Timeout #1 by NE.)",
        "A.Abel left end for 1 yard. Foxes challenged the catch ruling, and the play was confirmed. (Timeout #1 by NE.) (Timeout #2 by NE.)",
        "A.Abel left end for 1 yard. (Timeout #2 by NE.)",
    )
    got = {(r["play_index"], r["source"], r["timeout_number"]) for r in semantics.reviews(d).collect()}
    assert got == {(0, "replay-official", 1), (0, "team-challenge", None), (1, "team-challenge", 2)}


def test_a_return_for_a_touchdown_ends_in_the_end_zone(spark):
    d = events_of(spark, "A.Abel pass short middle intended for C.Cole INTERCEPTED by D.Drake at IND 20. D.Drake for 80 yards, TOUCHDOWN.", "A.Abel left end to IND 30 for 1 yard.")
    teams = spark.createDataFrame([("g", "NE", "IND")], "game_id string, visitor_id string, home_id string")
    got = replay.return_paths(d, teams).collect()
    assert [(r["play_index"], r["team_id"], r["direction"], r["yards"], r["touchdown"]) for r in got] == [(0, "IND", "left", 80, True)]
    assert [(p["kind"], p["position"], p["percent"]) for p in got[0]["path"]] == [("change", "IND 20", 74.0), ("end", "END ZONE", 10.0)]


def test_outcome_and_messages(spark):
    teams = spark.createDataFrame([("g", "NE", "Patriots"), ("g", "IND", "Colts"), ("h", "SEA", "Seahawks")], "game_id string, team_id string, short_name string")
    found = spark.createDataFrame([("g", "IND", "snaps-one-sided", "error"), ("g", None, "penalties-unparsed", "error"), ("g", "NE", "score-row-incomplete", "error")], "game_id string, team_id string, code string, severity string")
    counts = spark.createDataFrame([("g", 5, 3, 1, 1)], "game_id string, penalties_named int, penalties_read int, brackets_named int, brackets_read int")
    said = quality.with_messages(found, teams, counts)
    assert {(r["code"], r["section"]) for r in said.collect()} == {("snaps-one-sided", "snaps"), ("penalties-unparsed", "play-by-play"), ("score-row-incomplete", "game")}
    some = spark.createDataFrame([("g",)], "game_id string")
    scoring = spark.createDataFrame([("g", -1), ("g", 4), ("h", -1)], "game_id string, play_index int")
    got = {r["game_id"]: r for r in quality.game_outcome(teams.select("game_id").distinct(), said, some, some, scoring).collect()}
    assert (got["g"]["outcome"], got["g"]["issues"], got["g"]["errors"]) == ("partial", 3, 3)
    assert got["g"]["warnings"].split("\n") == ["1 scoring plays could not be linked to Play-by-Play.", "Patriots score row is incomplete.", "Colts snap table was not parsed while the other team was.", "2 penalty event(s) exist in Play-by-Play but were not structured; raw text is retained."]
    assert got["h"]["outcome"] == "complete" and got["h"]["warnings"].split("\n") == [quality.NO_PLAYS, quality.NO_DRIVES, "1 scoring plays could not be linked to Play-by-Play."]
