"""The bridge's other pages: summary, scoring, statistics, defence and snaps of every game, as positioned words.

``pages_sql`` tells what the pages say, in one dialect for Spark and DuckDB, from the plays' truth; the items are
rendered from it; what is read from them is compared with SQL that starts from the same truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.functions.spots import TEAMS, lookup
from fieldledger.operators.lines import item
from fieldledger.operators.sections import PAGE_WIDTH, SUMMARY
from fieldledger.sources.bridge import SURNAMES, pick

POSITIONS = ("QB", "RB", "WR", "TE", "C", "G", "T", "LB", "CB", "DE", "S", "K")
LABELS = ("TOTAL FIRST DOWNS", "THIRD DOWN EFFICIENCY", "TOTAL NET YARDS", "Net Punting Average", "PENALTIES Number and Yards", "TIME OF POSSESSION", "Turnovers")
HALF = PAGE_WIDTH / 2
PLAYTIME_PAGE = 9500


def pages_sql(each: str) -> str:
    """SQL after ``truth``: sides, one row for each team of a game; squad, one for each of twelve players; labels.

    ``each`` turns a row into rows with a number k, e.g. for DuckDB ``, unnest(range({n})) AS e(k)``.
    """
    return f"""
sides AS (
  SELECT g.*, e.k AS side, CASE WHEN e.k = 0 THEN visitor ELSE home END AS team_id, CAST((user_id * 3 + e.k * 17) % 50 AS INTEGER) AS score
  FROM (SELECT game_id, min(user_id) AS user_id, min(visitor) AS visitor, min(home) AS home FROM truth GROUP BY game_id) g {each.format(n=2)}),
squad AS (
  SELECT game_id, user_id, side, team_id, CAST(e.k AS INTEGER) AS k,
         concat(chr(CAST(65 + (user_id + 7 * side + e.k) % 26 AS INTEGER)), '.', {pick(SURNAMES, 'e.k')}) AS name, {pick(POSITIONS, 'e.k')} AS position,
         CAST(1 + (user_id * 3 + side * 5 + e.k * 7) % 99 AS INTEGER) AS number,
         CAST((user_id * 5 + side * 11 + e.k * 13) % 40 AS INTEGER) AS a, CAST((user_id * 7 + side * 3 + e.k * 17) % 30 AS INTEGER) AS b, CAST((user_id * 11 + side * 13 + e.k * 19) % 25 AS INTEGER) AS c
  FROM sides {each.format(n=12)}),
labels AS (
  SELECT game_id, user_id, CAST(e.k + 1 AS INTEGER) AS stat_no, {pick(LABELS, 'e.k')} AS label, {statistic(0)} AS visitor, {statistic(1)} AS home
  FROM (SELECT game_id, user_id FROM sides WHERE side = 0) s {each.format(n=7)})"""


def statistic(side: int) -> str:
    n = f"(user_id * (e.k + 3) + {side} * 7 + e.k * 5) % 30"
    return f"CASE e.k WHEN 1 THEN concat(CAST({n} AS VARCHAR(9)), '-', CAST(30 + {side} AS VARCHAR(9)), '-40%') WHEN 4 THEN concat(CAST({n} AS VARCHAR(9)), '-45') WHEN 5 THEN concat(CAST({n} AS VARCHAR(9)), ':07') WHEN 6 THEN 'N/A' ELSE CAST({n} AS VARCHAR(9)) END"


def told(spark: SparkSession, plays: DataFrame, name: str) -> DataFrame:
    each = "LATERAL VIEW explode(sequence(0, {n} - 1)) e AS k"
    return spark.sql(f"WITH truth AS (SELECT * FROM {{plays}}), {pages_sql(each)} SELECT * FROM {name}", plays=plays)


def words(rows: DataFrame, page: Column | int, y: Column | float, *placed: tuple[float | Column, Column | str]) -> DataFrame:
    """(game_id, page, words): the texts at their places; a null text has none.

    game_id is named anew, as Spark sees that a union's rows lie by game only where its first part knows it by one name.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    d = rows.withColumns({"y": as_column(y).cast("double"), "at_page": as_column(page).cast("int")})
    places = [(as_column(x).cast("double"), as_column(t).cast("string")) for x, t in placed]
    pieces = [F.when(t.isNotNull(), item((x * 100).cast("int"), x, F.col("y"), 4.0 * F.length(t), t)) for x, t in places]
    return d.select(F.col("game_id").alias("game_id"), F.col("at_page").alias("page"), F.array_compact(F.array(*pieces)).alias("words"))


def page_items(spark: SparkSession, plays: DataFrame, scoring: DataFrame) -> DataFrame:
    """(game_id, page, words) of pages 1 to 6, before the plays, and of PLAYTIME_PAGE, the last; of each game one of its plays will do.

    So that checks have something to find: every fifth game's score rows lack numbers, every sixth has no home snaps, every
    seventh no home statistics.
    """
    sides, squad, labels = (told(spark, plays, name) for name in ("sides", "squad", "labels"))
    games = sides.filter("side = 0")
    full = lookup(TEAMS, F.col("team_id"))
    c, text = F.col, lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    left = c("side") * HALF
    label_y = F.lit(700.0) - 20 * c("side")
    whole_row = c("user_id") % 5 != 0
    digits = [(340.0 + 30 * q, F.when(whole_row | F.lit(q < 2), F.lit(str(q)))) for q in range(5)]
    two_lines = F.when(c("k") == 9, 540.0).otherwise(F.when(c("k") < 8, 560.0).otherwise(550.0))
    sub_x = left + 20 + 130 * (c("k") % 2)
    nickname = F.element_at(F.split(full, " "), -1)
    score_words = F.split("description", " ")
    counted = lambda on, n: F.when(on, n)
    seen = ~((c("side") == 1) & (c("user_id") % 6 == 0))
    unit = lambda x, on, count, share: [(left + x, counted(on, count)), (left + x + 28, counted(on, text(share.cast("string"), "%")))]
    rows = [
        words(games, 1, 780.0, (150.0, SUMMARY)),
        words(games, 1, 745.0, (20.0, text("Date: Sunday, 9/", (1 + c("user_id") % 28).cast("string"), "/2023")), (300.0, "Start Time: 1:02 PM EDT")),
        words(games, 1, 733.0, (20.0, text("at Field ", (c("user_id") % 50).cast("string"), ", Some City, ST"))),
        words(games, 1, 721.0, (20.0, text("Game Weather: Cloudy Temp: ", (50 + c("user_id") % 40).cast("string")))),
        words(sides, 1, label_y, (20.0, F.when(c("side") == 0, "VISITOR:").otherwise("HOME:")), (90.0, F.get(F.split(full, " "), 0)), (130.0, F.get(F.split(full, " "), 1)), (170.0, F.get(F.split(full, " "), 2))),
        words(sides, 1, label_y - 1.1, *digits, (500.0, c("score"))),
        words(sides, 1, 650.0, (left + 20, "Offense"), (left + 160, "Defense")),
        words(squad.filter("k < 6"), 1, F.lit(640.0) - 10 * c("k"), (left + 20, c("position")), (left + 50, c("number")), (left + 80, c("name"))),
        words(sides, 1, 570.0, (left + 20, "Substitutions")),
        words(squad.filter("k between 6 and 9"), 1, F.when(c("k") < 8, 560.0).otherwise(550.0), (sub_x, c("position")), (sub_x + 30, c("number"))),
        words(squad.filter("k between 6 and 9"), 1, two_lines, (sub_x + 60, text(c("name"), ","))),
        words(sides, 1, 520.0, (left + 20, "Not Active")),
        words(squad.filter("k = 10"), 1, 510.0, (left + 20, c("position")), (left + 50, c("number")), (left + 80, c("name"))),
        words(games, 2, 780.0, (150.0, SUMMARY)),
        words(games, 2, 770.0, (20.0, text("Paid Attendance: 65,", (100 + c("user_id") % 900).cast("string"), " Time: 3:0", (c("user_id") % 10).cast("string")))),
        words(games, 2, 760.0, (20.0, "SCORING SUMMARY")),
        words(scoring, c("page"), F.when(c("page") == 1, 500.0).otherwise(750.0) - 3 * c("score_row"), (20.0, nickname), (90.0, c("quarter")), (110.0, c("clock")), *[(150.0 + 30 * k, F.get(score_words, k)) for k in range(8)], (500.0, c("visitor_score")), (540.0, c("home_score"))),
        words(games, 3, 780.0, (150.0, "Final Team Statistics")),
        words(games, 3, 770.0, (450.0, "Visitor"), (530.0, "Home")),
        words(labels, 3, F.lit(760.0) - 10 * c("stat_no"), (20.0, c("label")), (450.0, c("visitor")), (530.0, F.when((c("user_id") % 7 != 0) | (c("stat_no") < 3), c("home")).otherwise(c("visitor")))),
        words(games, 4, 780.0, (150.0, "Final Individual Statistics")),
        *[words(sides, 4, y, (left + 20, title)) for y, title in ((700.0, "RUSHING ATT YDS"), (650.0, "PASSING ATT CMP"), (600.0, "PASS RECEIVING TAR"), (550.0, "INTERCEPTIONS NO"))],
        words(squad.filter("k = 1"), 4, 690.0, (left + 20, c("name")), *[(left + 90 + 30 * i, v) for i, v in enumerate((c("a"), c("b") * 3, text(c("c").cast("string"), ".5"), c("b"), c("c") % 4))]),
        words(squad.filter("k = 0"), 4, 640.0, (left + 20, c("name")), *[(left + 60 + 28 * i, v) for i, v in enumerate((c("a") + 20, c("a"), c("b") * 10, text((c("c") % 5).cast("string"), "/13"), c("c") % 5, c("b") + 10, c("c") % 3, text(c("a").cast("string"), ".5")))]),
        words(squad.filter("k in (2, 3)"), 4, F.lit(610.0) - 10 * c("k"), (left + 20, c("name")), *[(left + 60 + 30 * i, v) for i, v in enumerate((c("b"), c("c"), c("a"), text(c("c").cast("string"), ".5"), c("b"), c("c") % 3))]),
        words(squad.filter("k = 10"), 4, 540.0, (left + 20, c("name")), *[(left + 60 + 28 * i, c("a")) for i in range(8)]),
        words(sides, c("side") + 5, 780.0, (150.0, "Final Defensive Statistics")),
        words(sides, c("side") + 5, 770.0, (20.0, full)),
        words(sides, c("side") + 5, 760.0, (20.0, "Regular Defensive Plays")),
        words(squad.filter("k between 7 and 9"), c("side") + 5, F.lit(750.0) - 10 * c("k"), (20.0, c("name")), *[(120.0 + 30 * i, (c("a") + i * c("b")) % 12) for i in range(11)]),
        words(games, PLAYTIME_PAGE, 780.0, (150.0, "Playtime Percentage")),
        words(sides, PLAYTIME_PAGE, 760.0, (left + 120, "Offense"), (left + 180, "Defense"), (left + 240, "Special Teams")),
        words(squad.filter(seen), PLAYTIME_PAGE, F.lit(750.0) - 10 * c("k"), (left + 20, c("name")), (left + 85, c("position")), *unit(122, c("k") <= 6, c("a") + 1, c("b") + 1), *unit(182, c("k").between(7, 9), c("a") + 2, c("c") + 1), *unit(242, (c("k") % 2 == 0) | (c("k") == 11), c("c") + 3, c("b") + 2)),
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every


def scoring_lines(scoring: DataFrame) -> DataFrame:
    """The scoring rows as they are printed: (game_id, page, score_row, team_id, quarter, clock, description, scores)."""
    what = F.when(F.col("kind") == "touchdown", F.lit(" 7 yd. run (kick is good)")).otherwise(F.lit(" 44 yd. Field Goal"))
    clock = F.concat((F.greatest(F.col("clock_sec"), F.lit(0)) / 60).cast("int").cast("string"), F.lit(":"), F.lpad((F.greatest(F.col("clock_sec"), F.lit(0)).cast("int") % 60).cast("string"), 2, "0"))
    at = F.row_number().over(Window.partitionBy("game_id", "page").orderBy("i"))
    return scoring.select("game_id", "page", at.alias("score_row"), "team_id", "quarter", clock.alias("clock"), F.concat("passer", what).alias("description"), "visitor_score", "home_score")
