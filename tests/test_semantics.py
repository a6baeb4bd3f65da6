"""Play text to events, on hand-made plays."""

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import explore, semantics

REVERSED = "O.Abel pass short left to T.Birch to SEA 20 for 9 yards (D.Cole). PENALTY on SEA-D.Cole, Holding, 5 yards, enforced at SEA 15. The Replay Official reviewed the pass completion ruling, and the play was REVERSED. O.Abel pass incomplete short left to T.Birch. PENALTY on SEA-D.Cole, Holding, 5 yards, enforced at SEA 15."
TEXTS = {
    0: REVERSED,
    1: "O.Abel up the middle to SEA 4 for 1 yard (D.Cole). PENALTY on SEA-D.Cole, Holding, 5 yards, enforced at SEA 2. PENALTY on SEA-D.Cole, Holding, 5 yards, enforced at SEA 2.",
    2: "Something nobody wrote a rule for",
    3: "O.Abel right end to SEA 9 for 2 yards (D.Cole). Then it rained",
    4: "K.Foot kicks 65 yards from IND 35 to end zone. R.Hale to SEA 25 for 25 yards (T.Birch).",
    5: "(No Huddle, Shotgun) O.Abel sacked at IND 9 for -8 yards (D.Cole) [E.Frost].",
    6: "(Injured) O.Abel pass deep middle to T.Birch for 30 yards, TOUCHDOWN. K.Foot extra point is GOOD, Center-L.Snap, Holder-P.Hold. IND 7 SEA 0, 5 plays, 60 yards, 1 penalty, 2:31 drive, 3:10 elapsed",
    7: "K.Foot 40 yard field goal is BLOCKED (B.Lock), RECOVERED by SEA-R.Hale at SEA 30. R.Hale for 70 yards, TOUCHDOWN.",
    8: "** Injury Update: SEA-D.Cole has returned to the game.",
    9: "",
    10: "Handoff to O.Abel to SEA 9 for no gain (D.Cole). Timeout #2 by IND.",
    11: "O.Abel pass short left to T.Birch to SEA 9 for 3 yards (D.Cole). Seahawks challenged the pass completion ruling, and the play was Upheld. The ruling on the field stands.",
}


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame([("g", i, "IND", "SEA", d) for i, d in TEXTS.items()], "game_id string, play_index long, possession string, defence string, description string")


@pytest.fixture(scope="module")
def sequence(plays):
    return semantics.play_sequence(plays).cache()


def events(sequence, play, *columns):
    return [tuple(r) for r in sequence.filter(F.col("play_index") == play).orderBy("event_order").select(*columns).collect()]


def test_restated_penalty_counts_once_after_a_reversal_only(sequence):
    got = {r["play_index"]: [] for r in semantics.merged_penalties(sequence).select("play_index").collect()}
    for r in semantics.merged_penalties(sequence).orderBy("event_order").collect():
        got[r["play_index"]].append(r["occurrences"])
    assert got == {0: [2], 1: [1, 1]}


def test_rulings_and_official_action(sequence):
    assert [r for r in events(sequence, 0, "type", "ruling") if r[0] == "action"] == [("action", "provisional"), ("action", "final")]
    s = {r["play_index"]: r for r in semantics.play_summary(sequence, semantics.merged_penalties(sequence)).collect()}
    assert (s[0]["official_outcome"], s[0]["official_end"], s[0]["reviewed"]) == ("incomplete", "SEA 15", True)
    assert {k: s[k]["parse_status"] for k in (1, 2, 3, 5)} == {1: "structured", 2: "raw", 3: "partial", 5: "structured"}
    assert (s[7]["visualization"], s[7]["changed_to"], s[7]["returner"], s[7]["return_yards"]) == ("blocked-field-goal", "SEA", "R.Hale", 70)
    assert 9 not in s


def test_raw_gap_keeps_its_text(sequence):
    assert [t for k, t in events(sequence, 3, "type", "text") if k == "raw"] == ["Then it rained"]


def test_return_after_kickoff_starts_where_the_kick_ended(sequence):
    got = [r for r in events(sequence, 4, "type", "action_type", "team_id", "end_position", "start_position") if r[0] == "action"]
    assert got == [("action", "kickoff", "IND", None, None), ("action", "return", "SEA", "SEA 25", None)]


def test_touchdown_belongs_to_the_returning_team(sequence):
    assert [r for r in events(sequence, 7, "type", "team_id") if r[0] == "touchdown"] == [("touchdown", "SEA")]


def test_formation_needs_every_part_known(sequence):
    assert events(sequence, 5, "formation")[0] == ("No Huddle, Shotgun",)
    assert [f for k, f in events(sequence, 6, "type", "formation") if k == "action"][0] is None


def test_participants(sequence):
    got = {(r["play_index"], r["name"], r["role"]): r["team_id"] for r in semantics.participants(sequence).collect()}
    assert got[5, "D.Cole", "sacker"] == "SEA" and got[5, "E.Frost", "qb-hit"] == "SEA"
    assert got[6, "L.Snap", "snapper"] == "IND" and got[6, "K.Foot", "kicker"] == "IND"
    assert got[7, "B.Lock", "blocker"] == "SEA" and got[7, "R.Hale", "recovery"] == "SEA"
    assert got[10, "O.Abel", "rusher"] == "IND"


def test_reviews_injuries_and_scoring(sequence):
    r = {x["play_index"]: x for x in semantics.reviews(sequence).collect()}
    assert (r[0]["source"], r[0]["result"]) == ("replay-official", "reversed")
    assert (r[11]["team_name"], r[11]["result"], r[11]["ruling"]) == ("Seahawks", "upheld", "stands")
    assert semantics.injury_updates(sequence).first()["code"] == "Returned"
    d = {x["play_index"]: x for x in semantics.scoring_details(sequence).collect()}[6]
    assert (d["kicker"], d["extra_point"], d["visitor_score"], d["drive_plays"], d["drive_penalties"], d["elapsed"]) == ("K.Foot", "good", 7, 5, 1, "3:10")


def test_timeout_names_its_team(sequence):
    assert [r for r in events(sequence, 10, "type", "result") if r[0] == "timeout"] == [("timeout", "IND")]


def test_no_plays(plays):
    none = semantics.play_sequence(plays.limit(0))
    assert none.count() == 0 and semantics.participants(none).count() == 0


def test_tied_final_and_hidden_result(spark):
    periods = spark.createDataFrame([("g", q, 7 if q == 1 else 0, 7 if q == 4 else 0) for q in (1, 2, 3, 4)], "game_id string, quarter int, visitor_points int, home_points int")
    got = {r["title"]: (r["visitor_score"], r["home_score"]) for r in explore.period_summary(periods).collect()}
    assert got == {"HALFTIME": (7, 0), "END OF REGULATION": (7, 7), "FINAL - TIE": (7, 7)}
