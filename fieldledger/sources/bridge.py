"""Report lines from the driver's events, and the truth that those lines tell.

``truth_sql`` gives one row for each play, with the same text for Spark and DuckDB but for integer
division; the lines are rendered from it, our operators parse the lines, and the SQL of a query
starts from the truth, never from a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.functions.spots import ALIASES, TEAMS
from fieldledger.operators.lines import item

LINES_A_PAGE = 40
SURNAMES = ("Abel", "Birch", "Cole", "Drake", "Ellis", "Frost", "Grant", "Hale", "Irwin", "Jonas", "Keene", "Lowe")
DIRECTIONS = ("left end", "left tackle", "left guard", "up the middle", "right guard", "right tackle", "right end")
#: Codes that reports print in another form.
PRINTED = {v: k for k, v in ALIASES.items() if k in ("ARZ", "BLT", "CLV", "HST")}


def pick(values, index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def truth_sql(events: str = "events", div: str = "//") -> str:
    """SQL for the plays; ``div`` is the dialect's integer division."""
    codes = sorted(TEAMS)
    name = lambda k: f"concat(chr(CAST(65 + ({k}) % 26 AS INTEGER)), CASE WHEN ({k}) % 13 = 0 THEN '.J' ELSE '' END, '.', {pick(SURNAMES, f'({k}) % 12')})"
    printed = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PRINTED.items()) + f" ELSE {c} END"
    spot = lambda y: f"CASE WHEN {y} = 50 THEN '50' WHEN {y} < 50 THEN concat({printed('visitor')}, ' ', CAST({y} AS VARCHAR(9))) ELSE concat({printed('home')}, ' ', CAST(100 - {y} AS VARCHAR(9))) END"
    gain = "CASE WHEN yards = 0 THEN 'for no gain' WHEN abs(yards) = 1 THEN concat('for ', CAST(yards AS VARCHAR(9)), ' yard') ELSE concat('for ', CAST(yards AS VARCHAR(9)), ' yards') END"
    return f"""
t0 AS (
  SELECT event_id, user_id, event_type, CAST(user_id AS VARCHAR(20)) AS game_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
         count(*) OVER (PARTITION BY user_id) AS n,
         (CAST(round(value * 100) AS BIGINT) + event_id) % 31 - 10 AS yards,
         event_type IN ('purchase', 'signup') OR (event_type = 'error' AND event_id % 4 IN (0, 2)) AS ends_drive
  FROM {events} WHERE user_id IS NOT NULL),
t1 AS (
  SELECT *, CAST(1 + ((CASE WHEN user_id % 10 = 0 THEN 5 ELSE 4 END) * i) {div} n AS INTEGER) AS quarter,
         {pick(codes, 'user_id % 32')} AS visitor, {pick(codes, '(user_id % 32 + 1 + user_id % 31) % 32')} AS home
  FROM t0),
t2 AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, quarter ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY user_id, quarter) AS m,
         coalesce(lag(ends_drive) OVER (PARTITION BY user_id ORDER BY i), FALSE) AS after_end,
         lag(quarter) OVER (PARTITION BY user_id ORDER BY i) AS quarter_before
  FROM t1),
t3 AS (
  SELECT *, CAST(900 - (900 * r) {div} m AS INTEGER) AS clock_sec,
         i = 0 OR after_end OR (quarter = 3 AND quarter_before = 2) AS starts_drive,
         sum(CASE WHEN after_end THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS turns
  FROM t2),
t4 AS (
  SELECT *, sum(CASE WHEN starts_drive THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS drive_no,
         CASE WHEN turns % 2 = 0 THEN home ELSE visitor END AS possession, CASE WHEN turns % 2 = 0 THEN visitor ELSE home END AS defence,
         CAST(1 + event_id % 4 AS INTEGER) AS down, event_id % 29 = 0 AS is_goal,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(1 + (event_id {div} 4) % 10 AS INTEGER) END AS distance,
         CAST(1 + (event_id * 7) % 99 AS INTEGER) AS abs_yard, CAST(1 + (event_id * 13) % 99 AS INTEGER) AS end_yard,
         {name('event_id * 3 % 40')} AS passer, {name('event_id * 5 % 40')} AS target, {name('event_id * 7 % 40')} AS defender, {name('event_id * 11 % 40')} AS second,
         concat(CAST(clock_sec {div} 60 AS VARCHAR(9)), ':', lpad(CAST(clock_sec % 60 AS VARCHAR(9)), 2, '0')) AS clock
  FROM t3),
t5 AS (
  SELECT *, {spot('abs_yard')} AS spot, {spot('end_yard')} AS end_spot, {gain} AS gain_text FROM t4),
truth AS (
  SELECT *,
    CASE event_type
      WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'touchdown' ELSE 'field-goal' END
      WHEN 'signup' THEN 'punt'
      WHEN 'click' THEN 'rush'
      WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'turnover' WHEN 1 THEN 'sack' WHEN 2 THEN 'turnover' ELSE 'penalty' END
      ELSE 'pass' END AS kind,
    CASE event_type
      WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN concat(passer, ' pass short left to ', target, ' ', gain_text, ', TOUCHDOWN.')
                                ELSE concat(passer, ' 44 yard field goal is GOOD, Center-', target, ', Holder-', second, '.') END
      WHEN 'signup' THEN concat(passer, ' punts 40 yards to ', end_spot, ', Center-', target, '. ', defender, ' to ', spot, ' ', gain_text, ' (', second, ').')
      WHEN 'click' THEN concat(passer, ' ', {pick(DIRECTIONS, 'event_id % 7')}, ' to ', end_spot, ' ', gain_text, ' (', defender, '; ', second, ').')
      WHEN 'error' THEN CASE event_id % 4
        WHEN 0 THEN concat(passer, ' pass short middle intended for ', target, ' INTERCEPTED by ', defender, ' at ', end_spot, '. ', defender, ' to ', spot, ' ', gain_text, ' (', second, ').')
        WHEN 1 THEN concat(passer, ' sacked at ', end_spot, ' ', gain_text, ' (', defender, ').')
        WHEN 2 THEN concat(passer, ' up the middle to ', end_spot, ' ', gain_text, ' (', defender, '). FUMBLES (', defender, '), RECOVERED by ', defence, '-', second, ' at ', spot, '.')
        ELSE concat(passer, ' pass incomplete short right to ', target, '. PENALTY on ', defence, '-', defender, ', Defensive Holding, 5 yards, enforced at ', spot, ' - No Play.') END
      ELSE CASE WHEN event_id % 3 < 2 THEN concat('(Shotgun) ', passer, ' pass short left to ', target, ' to ', end_spot, ' ', gain_text, ' (', defender, ').')
                ELSE concat(passer, ' pass incomplete deep right to ', target, '.') END END AS description
  FROM t5)
"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each play, from the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = f"WITH {truth_sql('{events}', 'div')} SELECT * FROM truth"
    return spark.sql(sql, events=events)


def teams(plays: DataFrame) -> DataFrame:
    """game_id, visitor_id, home_id."""
    return plays.groupBy("game_id").agg(F.first("visitor").alias("visitor_id"), F.first("home").alias("home_id"))


def report_lines(plays: DataFrame) -> DataFrame:
    """(game_id, page, line_no, text): headings, drive headers, plays, wrapped plays and summary rows.

    Every play takes eight line numbers, so that pages follow without a running count: a page is five plays.
    """
    full = F.element_at(F.create_map(*[F.lit(x) for p in TEAMS.items() for x in p]), F.col("possession"))
    clock = F.when(F.col("clock").startswith("0:"), F.substring("clock", 2, 9)).otherwise(F.col("clock"))
    to_go = F.when(F.col("is_goal"), F.lit("Goal")).otherwise(F.col("distance").cast("string"))
    words = F.split("description", " ")
    wraps = (F.col("event_id") % 3 == 0) & (F.size(words) > 6)
    first = F.when(wraps, F.array_join(F.slice(words, 1, 6), " ")).otherwise(F.col("description"))
    rest = F.when(wraps, F.array_join(F.slice(words, 7, 200), " "))
    ordinal = F.when(F.col("quarter") == 5, F.lit("Overtime")).otherwise(F.concat(F.get(F.array(*[F.lit(x) for x in ("First", "Second", "Third", "Fourth")]), F.col("quarter") - 1), F.lit(" Quarter")))
    heads = (F.col("r") == 0) | ((F.col("r") % 5 == 0) & (F.col("r") % 20 != 0))
    parts = [
        (0, F.when(heads, ordinal)),
        (1, F.when(heads, F.lit("Play By Play"))),
        (2, F.when(F.col("starts_drive"), F.concat(full, F.lit(" at "), F.col("clock")))),
        (3, F.when(F.col("starts_drive") & (F.col("drive_no") % 9 == 0), F.lit("Coin toss and weather as noted"))),
        (4, F.concat(F.col("down").cast("string"), F.lit("-"), to_go, F.lit("-"), F.col("spot"), F.lit(" ("), clock, F.lit(") "), first)),
        (5, rest),
        # Lines that no play goes on with, and rows of the summary.
        (6, F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("Timeout #1 by "), F.col("possession"), F.lit(" at "), F.col("clock"), F.lit("."))).when(F.col("event_id") % 13 == 0, F.lit("Two-Minute Warning")).when(F.col("event_id") % 17 == 0, F.concat(full, F.lit(" 7 12:30")))),
        (7, F.when(F.col("r") == F.col("m") - 1, F.lit("END OF QUARTER")).when(F.col("event_id") % 19 == 0, F.lit("Score 7 3")).when(F.col("event_id") % 23 == 0, F.concat(full, F.lit(" continued.")))),
    ]
    pieces = F.filter(F.array(*[F.struct(F.lit(k).alias("at"), t.alias("text")) for k, t in parts]), lambda x: x["text"].isNotNull())
    # A quarter starts on a page of its own, as a heading holds for a whole page.
    page = F.col("quarter") * 1000 + F.floor(F.col("r") / 5)
    return plays.select("game_id", page.cast("int").alias("page"), (F.col("r") % 5 * 8).alias("base"), F.explode(pieces).alias("x")).select("game_id", "page", (F.col("base") + F.col("x.at")).cast("int").alias("line_no"), F.col("x.text").alias("text"))


def items(lines: DataFrame) -> DataFrame:
    """(game_id, page, words): with coordinates, 4 points a character, 12 a line, and each fifth word 0.75 higher."""
    before = lambda k: F.length(F.call_function("substring_index", F.col("text"), F.lit(" "), k))
    y = lambda k: F.lit(760.0) - 12 * F.col("line_no") + F.when(k % 5 == 4, 0.75).otherwise(0.0)
    placed = F.transform(F.split("text", " "), lambda w, k: item(F.col("line_no") * 1000 + k + 1, F.lit(20.0) + 4 * before(k), y(k), F.lit(4.0) * F.length(w), w))
    return lines.select("game_id", "page", placed.alias("words"))


#: After the play pages: what must not be read as plays.
MISCELLANEOUS_PAGE = 8000
MISCELLANEOUS = ("Miscellaneous Statistics Report", "Ten longest plays", "1-10-50 (3:00) N.Nobody left end for 50 yards.", "Second Quarter")


def miscellaneous_lines(games: DataFrame) -> DataFrame:
    """The lines of the page after the plays of each game (game_id)."""
    return games.select("game_id", F.lit(MISCELLANEOUS_PAGE).alias("page"), F.posexplode(F.array(*[F.lit(t) for t in MISCELLANEOUS])).alias("line_no", "text"))


#: What some plays' texts have besides, in ``with_remarks``.
BLOCKED, UPHELD, CHALLENGED, INJURED = "is BLOCKED (B.Birch)", " The Replay Official reviewed the pass completion ruling, and the play was Upheld. (Timeout #2 by NE.)", " Foxes challenged the ball placement ruling, and the play was confirmed. (Timeout #1 by NE.)", " ** Injury Update: SEA-A.Abel is Out of the game."


def with_remarks(plays: DataFrame) -> DataFrame:
    """Parsed plays with blocked field goals, reviews with timeouts, challenges and injuries in some texts, by kind and index."""
    every = lambda kind, n, k: (F.col("kind") == kind) & (F.col("play_index") % n == k)
    caught = F.col("description").contains(" pass short left to ")
    more = F.when(every("pass", 4, 0) & caught, UPHELD).when(every("pass", 4, 1) & caught, CHALLENGED).when(every("rush", 5, 0), INJURED).otherwise("")
    text = F.when(every("field-goal", 3, 0), F.replace(F.col("description"), F.lit("is GOOD"), F.lit(BLOCKED))).otherwise(F.col("description"))
    return plays.withColumn("description", F.concat(text, more))


def scoring(plays: DataFrame) -> DataFrame:
    """Scoring rows with running totals; every row is printed twice; clocks of some are 3 seconds off."""
    points = F.when(F.col("kind") == "touchdown", 7).otherwise(3)
    upto = Window.partitionBy("game_id").orderBy("i")
    own = lambda team: F.sum(F.when(F.col("possession") == F.col(team), points).otherwise(0)).over(upto).cast("int")
    rows = plays.filter("event_type = 'purchase'").select(
        "game_id", F.col("possession").alias("team_id"), "quarter", (F.col("clock_sec") - F.when(F.col("event_id") % 5 == 0, 3).otherwise(0)).alias("clock_sec"),
        "passer", "kind", "i", own("visitor").alias("visitor_score"), own("home").alias("home_score"),
    )
    return rows.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))


def chart_sql() -> str:
    """SQL for the drive chart of ``truth`` and ``drives``, in both dialects: one row for each drive."""
    return """chart AS (
  SELECT d.game_id, d.drive_id, d.team_id, d.team_drive_number, d.start_clock, b.clock AS end_clock, a.spot AS start_position,
         d.plays, d.net_yards, b.spot AS end_position, b.i AS last_index, d.team_drive_number % 4 = 0 AS starred,
         CASE WHEN b.kind = 'touchdown' THEN 'Touchdown' WHEN b.kind = 'field-goal' THEN 'Field Goal' WHEN b.kind = 'punt' THEN 'Punt'
              WHEN b.kind = 'turnover' AND b.event_id % 4 = 0 THEN 'Interception' WHEN b.kind = 'turnover' THEN 'Fumble'
              WHEN b.i = b.n - 1 THEN 'End of Game' ELSE 'Downs' END AS result
  FROM drives d JOIN truth a ON a.game_id = d.game_id AND a.i = d.first_play_index JOIN truth b ON b.game_id = d.game_id AND b.i = d.last_play_index)"""


CHART_PAGE = 9000


def chart_items(chart: DataFrame, sides: DataFrame) -> DataFrame:
    """The chart as words with coordinates: the visitor's rows, the home team's name, its rows."""
    home = F.col("team_id") == F.col("home_id")
    text = lambda c: F.col(c).cast("string")
    position = lambda c, x: [(x, F.get(F.split(c, " "), 0)), (x + 18, F.get(F.split(c, " "), 1))]
    placed = lambda x, y, t: item((y * 1000 + x).cast("int"), x, y, 4.0 * F.length(t), t)
    words = [(F.lit(float(x)), t) for x, t in [
        (25, text("team_drive_number")), (45, F.col("start_clock")), (80, F.col("end_clock")), (106, F.lit("1:00")), (135, F.lit("Kickoff")), *position("start_position", 206),
        (260, text("plays")), (290, text("net_yards")), (330, F.lit("0")), (360, text("net_yards")), (400, F.lit("1")),
        (431, F.when(F.col("starred"), F.lit("*"))), *position("end_position", 440), *[(480 + 30 * k, F.get(F.split("result", " "), k)) for k in range(3)],
    ]]
    row_y = F.when(home, 436.0).otherwise(900.0) - 4 * F.col("team_drive_number")
    rows = chart.join(sides, "game_id").withColumn("row_y", row_y.cast("double"))
    rows = rows.select("game_id", F.array_compact(F.array(*[F.when(t.isNotNull(), placed(x, F.col("row_y"), t)) for x, t in words])).alias("words"))
    full = F.element_at(F.create_map(*[F.lit(x) for p in TEAMS.items() for x in p]), F.col("home_id"))
    names = sides.select("game_id", F.transform(F.split(full, " "), lambda w, k: placed(20.0 + 30 * k, F.lit(440.0), w)).alias("words"))
    title = sides.select("game_id", F.transform(F.split(F.lit("Ball Possession And Drive Chart"), " "), lambda w, k: placed(100.0 + 60 * k, F.lit(940.0), w)).alias("words"))
    # The chart is joined by broadcast where it is small, which leaves open how its rows lie.
    n = int(chart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "game_id").unionByName(names).unionByName(title).select("game_id", F.lit(CHART_PAGE).alias("page"), "words")
