"""Questions on all games at once: as of a cursor, and over whole games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.spots import absolute_yard, clamp, field_percent


def visible_plays(plays: DataFrame, cursors: DataFrame) -> DataFrame:
    """Plays up to each game's cursor (-1: none); nothing later shows."""
    return plays.join(cursors, "game_id").filter(F.col("play_index") <= F.col("cursor"))


def visible_drives(drives: DataFrame, drive_plays: DataFrame, plays: DataFrame, cursors: DataFrame) -> DataFrame:
    """Drives begun by the cursor; an unfinished one counts what is visible and shows as in progress."""
    seen = visible_plays(plays.select("game_id", "play_index", "yards"), cursors)
    counted = seen.join(drive_plays.select("game_id", "drive_id", "play_index"), ["game_id", "play_index"]).groupBy("game_id", "drive_id").agg(F.count("*").alias("seen_plays"), F.sum(F.coalesce("yards", F.lit(0))).alias("seen_yards"))
    begun = drives.join(cursors, "game_id").filter((F.col("first_play_index") >= 0) & (F.col("first_play_index") <= F.col("cursor"))).join(counted, ["game_id", "drive_id"])
    done = F.col("last_play_index") <= F.col("cursor")
    return begun.select("game_id", "drive_id", "team_id", done.alias("finished"), F.when(done, F.col("plays")).otherwise(F.col("seen_plays")).alias("plays"), F.when(done, F.col("net_yards")).otherwise(F.col("seen_yards")).alias("net_yards"))


IN_PROGRESS, DASH = "In Progress", "—"


def visible_chart(chart_drives: DataFrame, drive_plays: DataFrame, plays: DataFrame, cursors: DataFrame) -> DataFrame:
    """Charted drives begun by the cursor, as the chart has them once they have ended.

    An open one counts what is visible, has no penalty yards and first downs yet, and dashes for its end.
    """
    seen = visible_plays(plays.select("game_id", "play_index", "yards"), cursors)
    counted = seen.join(drive_plays.select("game_id", "drive_id", "play_index"), ["game_id", "play_index"]).groupBy("game_id", "drive_id").agg(F.count("*").alias("seen_plays"), F.sum(F.coalesce("yards", F.lit(0))).cast("int").alias("seen_yards"))
    begun = chart_drives.join(cursors, "game_id").filter(F.col("first_play_index") <= F.col("cursor")).join(counted, ["game_id", "drive_id"], "left")
    done = F.col("last_play_index") <= F.col("cursor")
    live = {"plays": F.coalesce("seen_plays", F.lit(0)).cast("int"), "gross_yards": F.coalesce("seen_yards", F.lit(0)), "net_yards": F.coalesce("seen_yards", F.lit(0)), "penalty_yards": F.lit(0), "first_downs": F.lit(0), "end_clock": F.lit(DASH), "possession_time": F.lit(DASH), "end_position": F.lit(DASH), "result": F.lit(IN_PROGRESS)}
    return begun.select("game_id", "drive_id", "team_id", done.alias("finished"), *[F.when(done, F.col(c)).otherwise(v).alias(c) for c, v in live.items()])


def recent_plays(plays: DataFrame, cursors: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` visible plays of each game, newest first."""
    newest = Window.partitionBy("game_id").orderBy(F.desc("play_index"))
    return visible_plays(plays, cursors).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def search_plays(plays: DataFrame, words: str, quarter: int | None = None, n: int = 8) -> DataFrame:
    """The first ``n`` plays of each game whose clock, spot or text holds the words, in any case."""
    hit = F.lower(F.concat_ws(" ", "clock", "yard_line", "description")).contains(words.lower())
    rows = plays.filter(hit if quarter is None else hit & (F.col("quarter") == quarter))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("game_id").orderBy("play_index"))).filter(F.col("rank") <= n)


def completed_drive(drives: DataFrame, cursors: DataFrame) -> DataFrame:
    return drives.join(cursors, (drives["game_id"] == cursors["game_id"]) & (drives["last_play_index"] == cursors["cursor"])).select(drives["game_id"], "drive_id", "plays", "net_yards")


def masked(column: str, at: str = "last_play_index") -> Column:
    """A column that shows only once its row has ended."""
    return F.when(F.col(at) <= F.col("cursor"), F.col(column)).alias(column)


def period_bounds(plays: DataFrame) -> DataFrame:
    """First and last play of each period; 5 and later are overtime."""
    return plays.groupBy("game_id", F.least("quarter", F.lit(5)).alias("period")).agg(F.min("play_index").alias("first_play"), F.max("play_index").alias("last_play"))


def game_counts(plays: DataFrame, drives: DataFrame, players: DataFrame) -> DataFrame:
    """(game_id, plays, drives, players)."""
    count = lambda d, name: d.groupBy("game_id").agg(F.count("*").alias(name))
    d = count(plays, "plays").join(count(drives, "drives"), "game_id", "left").join(count(players, "players"), "game_id", "left")
    return d.select("game_id", "plays", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("drives", "players")])


def game_flow(drives: DataFrame) -> DataFrame:
    """Drives of each team in each quarter."""
    return drives.groupBy("game_id", "quarter", "team_id").agg(F.count("*").alias("drives"), F.sum("plays").alias("plays"), F.sum("net_yards").alias("net_yards"))


def play_flags(plays: DataFrame) -> DataFrame:
    d = F.col("description")
    return plays.select("game_id", "play_index", d.contains("TOUCHDOWN").alias("touchdown"), d.rlike("INTERCEPTED|FUMBLES").alias("turnover"), d.contains("PENALTY on").alias("penalty"), "no_play")


def player_plays(involved: DataFrame) -> DataFrame:
    """(game_id, player) -> plays the player is in and how many."""
    return involved.groupBy("game_id", "player").agg(F.countDistinct("play_index").alias("plays"))


def source_vs_parsed(plays: DataFrame, sequence: DataFrame) -> DataFrame:
    """Penalties and bracket notes that the texts name against those that were read."""
    names = lambda pattern: F.sum(F.regexp_count("description", F.lit(pattern)))
    named = plays.groupBy("game_id").agg(names(r"(?i)\bPENALTY on\b").alias("named"), names(r"\[[^\]]+\]").alias("brackets_named"))
    found = sequence.groupBy("game_id").agg(F.count_if(F.col("type") == "penalty").alias("parsed"), F.count_if((F.col("type") == "defense") & F.col("text").startswith("[")).alias("brackets_parsed"))
    return named.join(found, "game_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("parsed", "brackets_parsed")})


def period_summary(by_period: DataFrame, team_rows: DataFrame | None = None) -> DataFrame:
    """Totals at half time and after four quarters from points by period, and the final score; equal final scores are a tie.

    The final score is what the teams' score rows say (``team_rows``: game_id, side, score); without them periods are added up.
    """
    upto = lambda c, q: F.sum(F.when(F.col("quarter") <= q, F.col(c)).otherwise(0))
    stages = [("HALFTIME", 2), ("END OF REGULATION", 4), ("FINAL", 99)]
    rows = F.array(*[F.struct(F.lit(title).alias("title"), upto("visitor_points", q).alias("visitor_score"), upto("home_points", q).alias("home_score")) for title, q in stages])
    out = by_period.groupBy("game_id").agg(rows.alias("rows")).select("game_id", F.explode("rows").alias("s")).select("game_id", "s.*")
    if team_rows is not None:
        of = lambda k: F.max(F.when(F.col("side") == k, F.col("score"))).cast("long")
        final = F.col("title") == "FINAL"
        said = team_rows.groupBy("game_id").agg(of(0).alias("visitor_final"), of(1).alias("home_final"))
        out = out.join(said, "game_id", "left").select("game_id", "title", *[F.when(final, F.coalesce(f"{t}_final", f"{t}_score")).otherwise(F.col(f"{t}_score")).alias(f"{t}_score") for t in ("visitor", "home")])
    tie = (F.col("title") == "FINAL") & (F.col("visitor_score") == F.col("home_score"))
    return out.withColumn("title", F.when(tie, "FINAL - TIE").otherwise(F.col("title")))


def current_drives(plays: DataFrame, cursors: DataFrame) -> DataFrame:
    """(game_id, cursor, drive_id) of the play at each game's cursor; plays carry drive_id."""
    return plays.join(cursors, "game_id").filter(F.col("play_index") == F.col("cursor")).filter("drive_id is not null").select("game_id", "cursor", "drive_id")


def drive_so_far(drives: DataFrame, drive_plays: DataFrame, current: DataFrame) -> DataFrame:
    """Plays of the current drive up to the cursor; yards only once the drive has ended."""
    counted = current.join(drive_plays.select("game_id", "drive_id", "play_index"), ["game_id", "drive_id"]).filter(F.col("play_index") <= F.col("cursor")).groupBy("game_id", "drive_id").agg(F.count("*").alias("plays_so_far"))
    return current.join(drives, ["game_id", "drive_id"]).join(counted, ["game_id", "drive_id"]).select("game_id", "drive_id", "team_id", "plays_so_far", masked("net_yards"))


OFFENSIVE_ROLES = ("passer", "receiver", "target", "rusher", "kicker", "punter", "returner")


def drive_participants(involved: DataFrame, drives: DataFrame, drive_plays: DataFrame, current: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` distinct names and roles of the current drive's team up to the cursor, in order of play and role list."""
    seen = current.join(drives.select("game_id", "drive_id", F.col("team_id").alias("drive_team")), ["game_id", "drive_id"]).join(drive_plays.select("game_id", "drive_id", "play_index"), ["game_id", "drive_id"]).filter(F.col("play_index") <= F.col("cursor"))
    rows = involved.filter(F.col("role").isin(*OFFENSIVE_ROLES)).join(seen, ["game_id", "play_index"]).filter(F.col("team_id") == F.col("drive_team"))
    first = rows.groupBy("game_id", "name", "role").agg(F.min("play_index").alias("play_index"))
    role_rank = F.array_position(F.array(*[F.lit(r) for r in OFFENSIVE_ROLES]), F.col("role"))
    rank = F.row_number().over(Window.partitionBy("game_id").orderBy("play_index", role_rank, "name"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n).select("game_id", "rank", "name", "role")


def parse_outcome(summary: DataFrame, scoring: DataFrame, least_plays: int = 20, most_raw: float = 0.15) -> DataFrame:
    """Per game: plays by parse status, low coverage, unlinked scoring rows, and complete or partial."""
    count = lambda status: F.count_if(F.col("parse_status") == status)
    games = summary.groupBy("game_id").agg(F.count("*").alias("plays"), count("structured").alias("structured"), count("partial").alias("partial"), count("raw").alias("raw"))
    unlinked = scoring.groupBy("game_id").agg(F.count_if(F.col("play_index") < 0).alias("unlinked"))
    d = games.join(unlinked, "game_id", "left").withColumn("unlinked", F.coalesce("unlinked", F.lit(0)))
    low = (F.col("plays") >= least_plays) & (F.col("raw") > most_raw * F.col("plays"))
    return d.withColumn("coverage_low", low).withColumn("outcome", F.when(low | (F.col("unlinked") > 0), "partial").otherwise("complete"))


def action_ends(sequence: DataFrame, spots: DataFrame) -> DataFrame:
    """(game_id, play_index, action_end): where a punt lands, else the first interception, else the first recovery, else the last action's end."""
    keys = ["game_id", "play_index"]
    punts = sequence.filter("action_type = 'punt' and end_position is not null").groupBy(*keys).agg(F.min_by("end_position", "event_order").alias("punted"))
    of = lambda pick, kind: pick(F.when(F.col("kind") == kind, F.col("position")), F.when(F.col("kind") == kind, F.col("place")))
    s = spots.groupBy(*keys).agg(of(F.min_by, "interception").alias("caught"), of(F.min_by, "recovery").alias("recovered"), of(F.max_by, "action-end").alias("ended"))
    return s.join(punts, keys, "full").select(*keys, F.coalesce("punted", "caught", "recovered", "ended").alias("action_end"))


def field_view(summary: DataFrame, plays: DataFrame, teams: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Start and final spot of each play as yards and percent, the movement in the attack's direction, the first-down mark and, from
    ``ends`` (``action_ends``), where the action ended."""
    d = plays.select("game_id", "play_index", "yard_line", "distance", "is_goal").join(summary.select("game_id", "play_index", "possession", "official_end"), ["game_id", "play_index"]).join(teams, "game_id")
    d = d.withColumn("action_end", F.lit(None).cast("string")) if ends is None else d.join(ends, ["game_id", "play_index"], "left")
    yard = lambda c: absolute_yard(F.col(c), F.col("visitor_id"), F.col("home_id"))
    sign = F.when(F.col("possession") == F.col("visitor_id"), 1).when(F.col("possession") == F.col("home_id"), -1)
    d = d.withColumns({"start_yard": yard("yard_line"), "final_yard": yard("official_end"), "end_yard": yard("action_end")})
    to_go = F.when(F.col("is_goal"), F.when(sign == 1, 100 - F.col("start_yard")).otherwise(F.col("start_yard"))).otherwise(F.col("distance"))
    percent = lambda c: F.when(c.isNotNull(), F.round(field_percent(c), 4))
    mark = clamp(F.col("start_yard") + to_go * sign)
    return d.select(
        "game_id", "play_index", "start_yard", "final_yard", percent(F.col("start_yard")).alias("start_percent"), percent(F.col("final_yard")).alias("final_percent"), ((F.col("final_yard") - F.col("start_yard")) * sign).alias("movement"),
        "action_end", percent(F.col("end_yard")).alias("action_end_percent"), percent(mark).alias("first_down_percent"),
    )
