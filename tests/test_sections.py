"""The report's other pages, play lines, links, checks, replay views, rendering and tables, on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from fieldledger.functions.spots import COLOURS, group_rank, leading_number, position_group, result_code
from fieldledger.operators import lines, plays, quality, render, replay, scoring, sections, semantics
from fieldledger.sources import manifest, tables

TEAMS = "game_id string, visitor_id string, home_id string"


def page(spark, rows):
    """(page, y, [(x, text), ...]) -> lines of game g."""
    items = [("g", p, i, t, float(x), float(y), 10.0) for p, y, words in rows for i, (x, t) in enumerate(words)]
    return lines.rebuild_lines(spark.createDataFrame(items, "game_id string, page int, item_idx int, text string, x double, y double, width double"))


def play_lines(spark, texts):
    rows = [("g", 1, k, t) for k, t in enumerate(texts)]
    teams = spark.createDataFrame([("g", "NE", "IND")], TEAMS)
    return plays.classify_lines(spark.createDataFrame(rows, "game_id string, page int, line_no int, text string"), teams)


def test_lines_that_are_no_plays(spark):
    texts = ["First Quarter", "Indianapolis Colts at 10:00 after a kick", "1-10-IND 25 (9:50) A.Abel left end to IND 30 for 5 yards", "and more (B.Birch).", "Timeout #1 by NE at 9:30.", "Two-Minute Warning", "END OF QUARTER ONE", "Score 0 0", "New England Patriots 7 12:30", "K.Kick kicks 65 yards", "New England Patriots continued.", "2-5-IND 30 (:45) B.Birch PUNTS 40 yards", "New England Patriots at the end", "stray"]
    got = [r["line_class"] for r in play_lines(spark, texts).orderBy("line_no").collect()]
    assert got == ["furniture", "drive", "play", "continuation", "ignored", "ignored", "summary", "summary", "summary", "ignored", "summary", "play", "drive", "ignored"]
    classified = play_lines(spark, texts)
    assert [(r["description"], r["clock"]) for r in plays.assemble_plays(classified).orderBy("play_index").collect()] == [("A.Abel left end to IND 30 for 5 yards and more (B.Birch).", "9:50"), ("B.Birch PUNTS 40 yards", "0:45")]
    assert [(r["team_id"], r["start_clock"]) for r in plays.drive_starts(classified).orderBy("start_no").collect()] == [("IND", "10:00"), ("NE", "15:00")]


def test_kinds_and_yards(spark):
    want = {
        "A.Abel kneels to NE 3 for -1 yards.": ("other", -1), "A.Abel up the middle. FUMBLES, ball out of bounds.": ("rush", None), "A.Abel FUMBLES, RECOVERED BY NE-B.Birch": ("turnover", None),
        "PUNTS 40 yards": ("punt", None), "SACKED for 5 YARDS": ("sack", 5), "PASS incomplete": ("pass", 0), "TOUCHDOWN. REVERSED. A.Abel left end": ("rush", None), "x REVERSED y TOUCHDOWN": ("touchdown", None), "nothing": ("other", None),
    }
    d = spark.createDataFrame([(t,) for t in want], "description string")
    assert {r["description"]: (r["kind"], r["yards"]) for r in plays.with_yards(plays.with_kind(d)).collect()} == want


def test_scoring_links(spark):
    p = spark.createDataFrame([("g", 1, 0, 600, "A.Abel 30 yard field goal is BLOCKED. B.Birch for 60 yards, TOUCHDOWN."), ("g", 1, 1, 500, "C.Cole pass to D.Drake, touchdown."), ("g", 1, 2, 100, "E.Ellis 40 yard field goal is GOOD.")], "game_id string, quarter int, play_index long, clock_sec int, description string")
    rows = [("g", 1, "NE", 1, "9:58", "B.Birch 60 yd. return of blocked field goal", 7, 0), ("g", 1, "NE", 1, "8:20", "D.Drake 7 yd. pass", 14, 0), ("g", 2, "NE", 1, "8:20", "D.Drake 7 yd. pass", 14, 0), ("g", 1, "NE", 1, "1:40", "E.Ellis 40 yd. Field Goal", 17, 0), ("g", 1, "NE", 2, "1:40", "E.Ellis 40 yd. Field Goal", 20, 0)]
    s = spark.createDataFrame([(g, p_, k, *r) for k, (g, p_, *r) in enumerate(rows)], "game_id string, page int, line_no int, team_id string, quarter int, clock string, description string, visitor_score int, home_score int")
    got = scoring.link_scoring(scoring.scoring_dedup(s), p).orderBy("score_no").collect()
    assert [r["play_index"] for r in got] == [0, 1, 2, -1]


def test_urls_and_ids(spark):
    urls = {"https://h.example.com/a.pdf": True, "HTTPS://H.example.com/A.PDF": True, "https://h.example.com:443/a.pdf": True, "https://h.example.com:8443/a.pdf": False, "https://h.example.com/a.pdf?": True, "https://h.example.com/a.pdf#": True, "https://h.example.com/a.pdf?x": False, "https://u@h.example.com/a.pdf": False, "http://h.example.com/a.pdf": False, None: False}
    got = manifest.approved_urls(spark.createDataFrame([(u,) for u in urls], "u string"), "u", "https://h.example.com", ".pdf").collect()
    assert {r["u"]: r["ok"] for r in got} == urls
    ids = manifest.valid_game_ids(spark.createDataFrame([("a-1", "a-1"), ("a-1", "b"), ("A", "A")], "i string, r string"), "i", "r").collect()
    assert [r["ok"] for r in ids] == [True, False, False]


def test_teams_without_labels_and_unknown_names(spark):
    known = [(1, 780, [(100, sections.SUMMARY)]), (1, 700, [(20, "VISITOR:"), (90, "Some"), (120, "New"), (150, "Team")]), (1, 698.9, [(400, "3"), (500, "17")]), (1, 696, [(500, "99")])]
    got = sections.team_dim(sections.teams(page(spark, known)), COLOURS).orderBy("side").collect()
    assert [(r["name"], r["team_id"], r["short_name"], r["score"], r["digit_items"]) for r in got] == [("Some New Team", "SNT", "Team", 17, 2), ("Home", "H", "Home", 0, 0)]
    assert got[0]["color"] == COLOURS["visitor"]


def test_headers_and_sides(spark):
    d = page(spark, [(1, 700, [(20, "TOP")]), (1, 690, [(20, "a"), (400, "b")]), (1, 680, [(20, "END")]), (1, 670, [(20, "c")])])
    between = lambda **k: [r["text"] for r in sections.between_headers(d, F.col("text") == "TOP", F.col("text") == k.get("end", "END")).collect()]
    assert between() == ["a b"] and between(end="nothing") == ["a b", "END", "c"]
    halves = sections.split_sides(d).filter("text = 'a b'").orderBy("side").collect()
    assert [r["tokens"] for r in halves] == [["a"], ["b"]]


def test_snaps_keep_what_is_missing_null(spark):
    head = [(120, "Offense"), (180, "Defense"), (240, "Special Teams"), (426, "Offense"), (486, "Defense"), (546, "Special Teams")]
    d = page(spark, [(7, 780, [(100, "Playtime Percentage")]), (7, 760, head), (7, 750, [(20, "A.Abel"), (90, "WR"), (122, "40"), (150, "63%"), (242, "5"), (326, "B.Birch"), (488, "9"), (510, "14%")])])
    teams = spark.createDataFrame([("g", 0, "NE"), ("g", 1, "IND")], "game_id string, side int, team_id string")
    got = {r["name"]: r for r in sections.snap_counts(d, teams).collect()}
    a, b = got["A.Abel"], got["B.Birch"]
    assert (a["offense_count"], a["offense_percent"], a["special_count"], a["position"]) == (40, 63, None, "WR")
    assert (b["team_id"], b["defense_count"], b["offense_count"], b["position"]) == ("IND", 9, None, None)


def test_linking_players(spark):
    known = spark.createDataFrame([("g", "NE", "A.Abel", 1), ("g", "IND", "A.Abel", 2), ("g", "NE", "B.Birch Jr", 3)], "game_id string, team_id string, name string, k int").withColumns({"position": F.lit("WR"), "starter": F.lit(False), "listed": F.struct(F.lit(0).alias("rank"), F.col("k").cast("long").alias("at"))}).drop("k")
    rows = [("g", 0, "A.Abel", "IND", "NE", "A.Abel runs"), ("g", 1, "A.Abel", None, "NE", "A.Abel runs"), ("g", 2, "A.Abel", "SF", "SF", "A.Abel"), ("g", 3, "B.Birch", None, "NE", "B.Birch Jr runs"), ("g", 4, "B.Birch", None, "IND", "B.Birch runs"), ("g", 5, "C.Cole", "NE", "IND", "C.Cole")]
    mentions = spark.createDataFrame(rows, "game_id string, play_index int, name string, semantic_team string, possession string, description string")
    players, links = sections.link_players(known, mentions)
    assert {(r["play_index"], r["team_id"], r["name"]) for r in links.collect()} == {(0, "IND", "A.Abel"), (1, "NE", "A.Abel"), (2, "NE", "A.Abel"), (3, "NE", "B.Birch Jr"), (4, "IND", "B.Birch"), (5, "NE", "C.Cole")}
    assert players.count() == 5


def test_issues_of_a_broken_game(spark):
    teams = spark.createDataFrame([("g", 0, "NE", "Visitor", 6), ("g", 1, "IND", "Indianapolis Colts", 2)], "game_id string, side int, team_id string, name string, digit_items long")
    metrics = spark.createDataFrame([("g", 0, "NE", 12, 11, 0, 7), ("g", 1, "IND", 12, 1, 9, 2)], "game_id string, side int, team_id string, players long, positioned long, snapped long, stat_values long")
    drives = spark.createDataFrame([("g", "NE")], "game_id string, team_id string")
    p = spark.createDataFrame([("g", "NE")], "game_id string, possession string")
    flags = spark.createDataFrame([("g", True)], "game_id string, playtime boolean")
    counts = spark.createDataFrame([("g", 30, 6, 3, 2, 1, 0)], "game_id string, plays long, raw long, penalties_named long, penalties_read long, brackets_named long, brackets_read long")
    got = {(r["team_id"], r["code"]) for r in quality.issues(teams, metrics, drives, p, flags, counts).collect()}
    assert got == {("IND", "score-row-incomplete"), ("IND", "positions-low"), ("IND", "team-stats-missing"), ("IND", "drives-team-missing"), ("IND", "pbp-team-missing"), (None, "teams-unresolved"), ("NE", "snaps-one-sided"), ("IND", "positions-one-sided"), (None, "penalties-unparsed"), (None, "brackets-unparsed"), (None, "play-coverage-low")}


def test_labels(spark):
    d = spark.createDataFrame([("WR", "Touchdown", "5-45"), ("XX", "Blocked Punt", "N/A"), (None, "Downs", " -3.5x")], "p string, r string, n string")
    got = d.select(position_group(F.col("p")), group_rank(F.col("p")), result_code(F.col("r")), leading_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("WR", 3, "TD", 5.0), ("OTHER", 10, "BLO", None), ("OTHER", 10, "DN", -3.5)]


def sequence_of(spark, texts):
    """Plays of possession NE, with the text's own state after."""
    rows = [("g", k, 1, "NE", "NE 25", t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "game_id string, play_index long, quarter int, possession string, yard_line string, description string")
    teams = spark.createDataFrame([("g", "IND", "NE")], TEAMS)
    d = plays.with_no_play(plays.with_yards(plays.with_kind(d))).withColumns({"next_yard_line": F.lit("NE 25"), "next_possession": F.lit("NE")})
    return d, teams, semantics.play_sequence(d.withColumn("defence", F.lit("IND")))


@pytest.fixture(scope="module")
def told(spark):
    texts = [
        "A.Abel pass short left to B.Birch to IND 40 for 35 yards, TOUCHDOWN. K.Keene extra point is GOOD, Center-C.Cole, Holder-D.Drake.",
        "A.Abel 40 yard field goal is BLOCKED (D.Drake), Center-C.Cole, Holder-E.Ellis.",
        "A.Abel 40 yard field goal is No Good, Wide Left, Center-C.Cole, Holder-E.Ellis.",
        "A.Abel pass incomplete short right to B.Birch.",
        "A.Abel left end to NE 22 for -3 yards (D.Drake).",
    ]
    d, teams, sequence = sequence_of(spark, texts)
    return d, teams, sequence.cache()


def test_replay_modes(spark, told):
    d, teams, sequence = told
    penalties = semantics.merged_penalties(sequence)
    got = {r["play_index"]: r for r in replay.replay_view(sequence, penalties, semantics.play_summary(sequence, penalties), d, teams).collect()}
    assert (got[0]["mode"], got[0]["visualization"], got[0]["result_state"], got[0]["final_position"]) == ("touchdown", "pass-complete", "touchdown", "END ZONE")
    assert (got[1]["mode"], got[1]["visualization"], got[1]["result_state"]) == ("blocked-kick", "blocked-field-goal", "field-goal-missed")
    assert (got[2]["mode"], got[2]["result_label"], got[2]["result_state"]) == ("field-goal", "FIELD GOAL · MISSED", "field-goal-missed")
    assert (got[3]["mode"], got[3]["final_source"], got[3]["result_label"]) == ("no-movement", "state-after", "INCOMPLETE · 0 YARDS")
    assert (got[4]["mode"], got[4]["movement"], got[4]["result_label"], got[4]["result_detail"]) == ("movement", -3, "-3 YARDS", "LOSS")
    phases = replay.scoring_phases(sequence, penalties).orderBy("phase_no").collect()
    assert [(r["play_index"], r["phase"], r["result"]) for r in phases] == [(0, "scrimmage", "TOUCHDOWN"), (0, "try", "GOOD")]


def test_rendering(spark, told):
    d, _, sequence = told
    templates = spark.createDataFrame([("xx", "action.pass.incomplete", "{actor} misses [[{target}]]"), ("xx", "action.rush", "{actor} runs [[to {end}]] [[({yards})]]"), ("xx", "action.pass", "{actor} throws")], "language string, key string, template string")
    terms = spark.createDataFrame([("xx", "good", "GUT")], "language string, term string, translation string")
    shown = render.render_sections(sequence, d, templates, terms, "xx")
    text = {r["play_index"]: r["text"] for r in render.render_description(shown).collect()}
    assert text[3] == "A.Abel misses B.Birch" and text[4] == "A.Abel runs to NE 22 (-3)" and text[0].startswith("A.Abel throws")
    english = render.render_description(render.render_sections(sequence, d, templates, terms, "en")).collect()
    assert len(english) == 5 and all(r["text"] == d.filter(F.col("play_index") == r["play_index"]).first()["description"] for r in english[:1])
    one = spark.createDataFrame([("NE", None, "Holding", 10, None, "accepted")], "team_id string, player string, penalty_type string, yards int, spot string, status string")
    assert one.select(render.penalty_text(F.lit("{who}: {what}[[, {yards} yd]][[ at {spot}]], {status}"), F.lit(None).cast("string"))).first()[0] == "NE: Holding, 10 yd, accepted"
    line = spark.createDataFrame([("NE 7 IND 0, 8 plays, 75 yards, 4:10 drive, 5:00 elapsed",), ("other",)], "t string")
    assert [r[0] for r in line.select(render.drive_text(F.col("t"), F.lit("{visitor}-{home}: {plays}/{yards}[[/{penalties}]] {time}"))).collect()] == ["NE 7-IND 0: 8/75 4:10", "other"]


def test_tables_round_trip(spark, tmp_path):
    rows = [("g", 1, 0, "a", 1.0, 2.0, 3.0)]
    items = spark.createDataFrame(rows, tables.ITEMS)
    for form in ("parquet", "json", "csv"):
        path = str(tmp_path / form)
        (items.write.option("header", True).csv(path) if form == "csv" else items.write.format(form).save(path))
        assert [tuple(r) for r in tables.read_items(spark, path, form).collect()] == rows
    p = spark.createDataFrame([("g", 2, "b"), ("g", 1, 'a"'), ("h", 1, None)], "game_id string, play_index int, text string")
    s = spark.createDataFrame([("g", 5)], "game_id string, n int")
    tables.write_nested({"plays": p, "scores": s}, {"plays": ["play_index"], "scores": ["n"]}, str(tmp_path / "n"), pages=p)
    got = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "n/documents")).collect()), key=lambda x: x["game_id"])
    assert got == [{"game_id": "g", "plays": [{"play_index": 1, "text": 'a"'}, {"play_index": 2, "text": "b"}], "scores": [{"n": 5}]}, {"game_id": "h", "plays": [{"play_index": 1}], "scores": []}]
    tables.write_tables({"plays": p, "scores": s}, str(tmp_path / "t"), partition_by="play_index")
    assert spark.read.parquet(str(tmp_path / "t/plays")).count() == 3 and spark.read.parquet(str(tmp_path / "t/scores")).count() == 1
