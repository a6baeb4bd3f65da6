"""Operators on hand-made frames, and registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import spots
from fieldledger.jobs import reports
from fieldledger.operators import lines, play_text, plays, scoring
from fieldledger.sources import manifest

SF = "/root/testdata/sf0.001"


def rows(pdf: pd.DataFrame):
    one = lambda v: "" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(reports.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(reports.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(reports.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(reports.QUERIES) == set(reports.ORACLE_SQL)


def test_line_joins_by_its_first_item(spark):
    items = spark.createDataFrame([("g", 1, 0, "a", 0.0, 10.0, 1.0), ("g", 1, 1, "b", 5.0, 9.4, 1.0), ("g", 1, 2, "c", 0.0, 8.9, 1.0), ("g", 1, 3, " ", 0.0, 8.9, 1.0)], "game_id string, page int, item_idx int, text string, x double, y double, width double")
    got = lines.rebuild_lines(items).orderBy("line_no").select("text").toPandas()["text"].tolist()
    assert got == ["a b", "c"]
    assert lines.rebuild_lines(items.limit(0)).count() == 0


def test_spots(spark):
    df = spark.createDataFrame([("HST 30", "HOU", "IND"), ("50", "HOU", "IND"), ("XXX 4", "HOU", "IND"), ("IND 20", "HOU", "IND")], "s string, v string, h string")
    got = df.select(spots.absolute_yard(F.col("s"), F.col("v"), F.col("h")).alias("a"), spots.field_position(F.col("s"), F.col("v")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(30, 30), (50, 50), (None, 96), (80, 80)]


def test_clock(spark):
    df = spark.createDataFrame([(":07",), ("12:34",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(spots.clock_seconds(F.col("c"))).collect()] == [7, 754, None, None]


def test_two_straight_drives_overlap(spark):
    starts = spark.createDataFrame([("g", "H", 1, 0, 1, 1), ("g", "H", 1, 2, 2, 2), ("g", "V", 1, 4, 3, 1)], "game_id string, team_id string, quarter int, first_index long, start_no int, team_drive_number int").withColumn("start_clock", F.lit("9:00"))
    p = spark.createDataFrame([("g", i, "H" if i < 4 else "V", 1) for i in range(6)], "game_id string, play_index long, possession string, yards int")
    drives, bridge = plays.attach_drives(starts, p)
    got = {r["drive_id"]: (r["first_play_index"], r["last_play_index"]) for r in drives.collect()}
    assert got == {"drive-H-1": (0, 3), "drive-H-2": (2, 3), "drive-V-1": (4, 5)}
    later = {r["play_index"]: r["drive_id"] for r in plays.with_drive_id(p, bridge).collect()}
    assert later[3] == "drive-H-2" and later[1] == "drive-H-1"


def test_nearest_score_tie_takes_the_earlier_play(spark):
    p = spark.createDataFrame([("g", 1, 3, 100, "A.Abel for 2 yards, TOUCHDOWN."), ("g", 1, 5, 96, "A.Abel for 9 yards, TOUCHDOWN."), ("g", 1, 6, 98, "B.Birch for 2 yards, TOUCHDOWN.")], "game_id string, quarter int, play_index long, clock_sec int, description string")
    rows = [("g", 1, "NE", 1, "1:38", "A.Abel 2 yd. run", 7, 0), ("g", 2, "NE", 2, "1:38", "A.Abel 2 yd. run", 14, 0)]
    s = spark.createDataFrame(rows, "game_id string, score_no int, team_id string, quarter int, clock string, description string, visitor_score int, home_score int")
    assert {r["score_no"]: r["play_index"] for r in scoring.link_scoring(s, p).collect()} == {1: 3, 2: -1}


def test_offsetting_penalty_and_spans(spark):
    p = spark.createDataFrame([("g", 1, "O.Abel pass incomplete. PENALTY on SEA-D.Birch, Holding, offsetting - No Play.")], "game_id string, play_index long, description string")
    got = play_text.penalties(p).first()
    assert (got["status"], got["yards"], got["no_play"]) == ("offsetting", None, True)
    spans = p.select(play_text.find_spans("description", r"[A-Z]\.[A-Z][a-z]+").alias("s")).first()["s"]
    assert [(x["start"], x["end"], x["text"]) for x in spans] == [(0, 6, "O.Abel"), (39, 46, "D.Birch")]


def test_admit_reports(spark):
    files = spark.createDataFrame([("a.pdf", 9, "application/pdf", b"%PDF-1.7x"), ("a.txt", 9, "application/pdf", b"%PDF-"), ("b.PDF", 0, "application/pdf", b""), ("c.pdf", 9, None, b"%PDF-"), ("d.pdf", 9, "application/pdf", b"x")], "path string, length long, content_type string, content binary")
    assert [r["reject_reason"] for r in manifest.admit_reports(files).collect()] == [None, "suffix", "empty", "content-type", "magic"]
