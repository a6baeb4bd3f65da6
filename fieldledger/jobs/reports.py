"""Queries over the bridge's report lines and the driver's tables, each with DuckDB SQL from the events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.functions.spots import COLOURS, GROUPS, POSITION_GROUPS, RESULT_CODES, TEAMS, absolute_yard, attack_direction, clamp, down_label, field_percent, quarter_label, result_code
from fieldledger.operators import explore, lines, play_text, plays, quality, replay, scoring, sections, semantics, views
from fieldledger.sources import bridge, manifest, report_pages
from fieldledger.sources.stored import stamp, stored

ORIGIN, SUFFIX = "https://m.tiontion.example.com", ".html"


@dataclass
class Reports:
    """The tables of one corpus; those that several jobs start from are written once a session."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        # Stored tables are bucketed by game: a join by game and something more needs no exchange by both.
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.corpus = stamp(self.spark, f"{self.sf_dir}/events.parquet")

    def once(self, name: str, make) -> DataFrame:
        return stored(self.spark, self.corpus, name, make)

    @property
    def truth(self) -> DataFrame:
        return self.once("truth", lambda: bridge.truth(self.spark, self.sf_dir))

    @property
    def report(self) -> DataFrame:
        """All lines of all pages of every report, rebuilt from its words: the other jobs start here."""

        def make():
            games = self.once("games", lambda: self.truth.groupBy("game_id").agg(*[F.min(c).alias(c) for c in ("user_id", "visitor", "home")]))
            sides = bridge.teams(games)
            told = self.spark.sql(f"WITH truth AS (SELECT * FROM {{plays}}){STARTS.split('cursors AS')[0].rstrip().rstrip(',')}, {bridge.chart_sql()} SELECT * FROM chart", plays=self.truth)
            printed = report_pages.scoring_lines(bridge.scoring(self.truth))
            # All parts lie by game, so their union does; nothing is exchanged but the chart's rows.
            played = bridge.items(bridge.report_lines(self.truth).unionByName(bridge.miscellaneous_lines(sides)))
            words = report_pages.page_items(self.spark, games, printed).unionByName(played).unionByName(bridge.chart_items(told, sides))
            return lines.with_marks(lines.page_lines(lines.gather(words)), sections.MARKERS)

        return self.once("report", make)

    @property
    def teams(self) -> DataFrame:
        return self.sides.drop("visitor_name", "home_name")

    @property
    def sides(self) -> DataFrame:
        return sections.team_sides(self.team_rows)

    @property
    def classified(self) -> DataFrame:
        return self.once("classified", lambda: plays.classify_lines(lines.play_pages(self.report.select("game_id", "page", "line_no", "text")), self.sides))

    @property
    def plays(self) -> DataFrame:
        return self.once("plays", lambda: plays.with_no_play(plays.with_yards(plays.with_kind(plays.assemble_plays(self.classified)))))

    @property
    def drives(self) -> tuple[DataFrame, DataFrame]:
        attached = lambda k: plays.attach_drives(plays.drive_starts(self.classified), self.plays)[k]
        return self.once("drive_rows", lambda: attached(0)), self.once("drive_plays", lambda: attached(1))

    @property
    def chart_drives(self) -> tuple[DataFrame, DataFrame]:
        return plays.attach_chart(self.partial_chart, plays.drive_starts(self.classified), self.plays)

    @property
    def with_defence(self) -> DataFrame:
        return self.plays.join(self.teams, "game_id").withColumn("defence", F.when(F.col("possession") == F.col("home_id"), F.col("visitor_id")).otherwise(F.col("home_id")))

    @property
    def sequence(self) -> DataFrame:
        return self.once("sequence", lambda: semantics.play_sequence(self.with_defence))

    @property
    def remarked(self) -> DataFrame:
        """The events of the plays with remarks: blocks, reviews, timeouts, injuries."""
        return self.once("remarked", lambda: semantics.play_sequence(bridge.with_remarks(self.with_defence)))

    @property
    def summary(self) -> DataFrame:
        return self.once("summary", lambda: semantics.play_summary(self.sequence, semantics.merged_penalties(self.sequence)))

    @property
    def chart(self) -> DataFrame:
        return self.once("chart", lambda: views.drive_chart(sections.marked_pages(self.pages, "Ball Possession And Drive Chart"), self.teams))

    @property
    def partial_chart(self) -> DataFrame:
        """The chart as some reports have it: rows are missing, and one of each team has no start."""
        last = self.chart.groupBy("game_id", "team_id").agg(F.max_by(F.struct(*[c for c in self.chart.columns if c not in ("game_id", "team_id", "drive_id")]), "team_drive_number").alias("d"))
        more = last.select("game_id", "team_id", F.lit("").alias("drive_id"), "d.*").withColumn("team_drive_number", F.col("team_drive_number") + 1)
        return self.chart.filter("team_drive_number % 7 <> 3").unionByName(more)

    @property
    def scoring(self) -> DataFrame:
        return self.once("scoring", lambda: scoring.link_scoring(scoring.scoring_dedup(sections.scoring_rows(self.pages, self.team_rows)), self.plays))

    @property
    def pages(self) -> DataFrame:
        """The report's lines; the name says that its tables are looked for page by page."""
        return self.report

    @property
    def team_rows(self) -> DataFrame:
        return self.once("team_rows", lambda: sections.team_dim(sections.teams(self.pages), COLOURS))

    def part(self, name: str) -> DataFrame:
        return getattr(sections, name)(self.pages, self.team_rows)

    @property
    def players(self) -> DataFrame:
        parts = {"starters": "starters", "roster": "roster", "passing": "passing_stats", "rushing": "rushing_stats", "receiving": "receiving_stats", "defense": "defense_stats", "snaps": "snap_counts"}
        return self.once("players", lambda: sections.players_merged({k: self.part(name) for k, name in parts.items()}))

    @property
    def mentions(self) -> DataFrame:
        """Every name of every play: of its participants, with their team, and all others in the text."""
        texts = self.plays.select("game_id", "play_index", "possession", "description")
        said = semantics.participants(self.sequence).select("game_id", "play_index", "name", F.col("team_id").alias("team"), "first_place")
        # game_id is named anew so that the union lies by game, as its parts do; a full join would not.
        named = texts.select(F.col("game_id").alias("game_id"), "play_index", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(semantics.NAME), F.lit(0)))).alias("name"))
        every = named.unionByName(said, allowMissingColumns=True).groupBy("game_id", "play_index", "name").agg(F.min_by("team", "first_place").alias("semantic_team"))
        return every.join(texts, ["game_id", "play_index"])

    @property
    def linked(self) -> tuple[DataFrame, DataFrame]:
        return sections.link_players(self.players, self.mentions)

    @property
    def names(self) -> DataFrame:
        return self.once("names", lambda: sections.linked_names(self.players, self.mentions))

    @property
    def text_counts(self) -> DataFrame:
        text = self.plays.groupBy("game_id").agg(F.sum(F.regexp_count("description", F.lit(r"(?i)\bPENALTY on\b"))).alias("penalties_named"), F.sum(F.regexp_count("description", F.lit(r"\[[^\]]+\]"))).alias("brackets_named"))
        read = self.sequence.groupBy("game_id").agg(F.count_if(F.col("type") == "penalty").alias("penalties_read"), F.count_if((F.col("type") == "defense") & F.col("text").startswith("[")).alias("brackets_read"))
        status = self.summary.groupBy("game_id").agg(F.count("*").alias("plays"), F.count_if(F.col("parse_status") == "raw").alias("raw"))
        return text.join(read, "game_id", "left").join(status, "game_id")

    @property
    def issues(self) -> DataFrame:
        def make():
            metrics = quality.team_metrics(self.team_rows, self.linked[0], sections.team_stats(self.pages))
            return quality.issues(self.team_rows, metrics, self.drives[0], self.plays, lines.section_flags(lines.page_text(self.pages)), self.text_counts)

        return self.once("issues", make)

    @property
    def messages(self) -> DataFrame:
        return quality.with_messages(self.issues, self.team_rows, self.text_counts)

    @property
    def cursors(self) -> DataFrame:
        return self.truth.groupBy("game_id").agg(F.expr("(first(n) * (first(user_id) % 5)) div 5 - 1").alias("cursor"))


def drive_table(r: Reports) -> DataFrame:
    """The flagship: drives of all games with their plays and yards."""
    return r.drives[0].drop("start_no")


def items_to_plays(r: Reports) -> DataFrame:
    """The whole chain: words, lines, pages in range, the report's own teams, plays."""
    return plays.assemble_plays(r.classified).select("game_id", "play_index", "quarter", "clock_sec", "down", "yard_line", "possession", "description")


def game_totals(r: Reports) -> DataFrame:
    """Plays, drives and the longest drive of each game, from two bucketed tables without an exchange."""
    of_plays = r.plays.groupBy("game_id").agg(F.count("*").alias("plays"), F.count_if(F.col("kind") == "touchdown").alias("touchdowns"))
    of_drives = r.drives[0].groupBy("game_id").agg(F.count("*").alias("drives"), F.max("plays").alias("longest_drive"))
    return of_plays.join(of_drives.hint("merge"), "game_id")


def spots(r: Reports) -> DataFrame:
    p = plays.with_field_position(r.plays).join(r.teams, "game_id")
    yard = absolute_yard(F.col("yard_line"), F.col("visitor_id"), F.col("home_id"))
    direction = attack_direction(F.col("possession"), F.col("visitor_id"), F.col("home_id"))
    to_go = F.when(F.col("is_goal"), F.when(direction == "right", 100 - yard).otherwise(yard)).otherwise(F.col("distance"))
    mark = clamp(F.when(direction == "right", yard + to_go).otherwise(yard - to_go))
    return p.select("game_id", "play_index", "field_position", yard.alias("absolute_yard"), direction.alias("direction"), F.round(field_percent(yard), 4).alias("percent"), mark.cast("int").alias("first_down_mark"), down_label(F.col("down"), F.col("distance"), F.col("is_goal")).alias("down_label"), quarter_label(F.col("quarter")).alias("period"))


def current_drives(r: Reports) -> DataFrame:
    return explore.current_drives(plays.with_drive_id(r.plays, r.drives[1]), r.cursors)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("week-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, "--x").when(F.col("page_id") % 7 == 0, "-A").otherwise("-game")).alias("game_id"))
    return manifest.valid_game_ids(ids, "game_id")


JOBS = {
    "drives": drive_table,
    "game_totals": game_totals,
    "chart_drives": lambda r: r.chart_drives[0].select("game_id", "drive_id", "team_id", "team_drive_number", "start_clock", "result", "quarter", "first_play_index", "last_play_index", "owned_plays"),
    "play_chart_drive": lambda r: plays.with_drive_id(r.plays, r.chart_drives[1]).select("game_id", "play_index", "drive_id"),
    "plays_assembled": lambda r: plays.assemble_plays(r.classified).drop("raw_text"),
    "plays_from_items": items_to_plays,
    "play_kind_yards": lambda r: r.plays.select("game_id", "play_index", "kind", "yards", "no_play"),
    "spots": spots,
    "state_after": lambda r: plays.with_state_after(plays.assemble_plays(r.classified)).select("game_id", "play_index", "next_quarter", "next_clock", "next_down", "next_distance", "next_yard_line", "next_possession"),
    "drive_starts": lambda r: plays.drive_starts(r.classified),
    "play_drive_id": lambda r: plays.with_drive_id(r.plays, r.drives[1]).select("game_id", "play_index", "drive_id"),
    "play_actions": lambda r: play_text.play_actions(r.plays).drop("spot_after_to"),
    "penalties": lambda r: play_text.penalties(r.plays),
    "turnover_events": lambda r: play_text.turnover_events(r.plays),
    "tacklers": lambda r: play_text.tacklers(r.plays),
    "scoring_linked": lambda r: r.scoring.select("game_id", "score_no", "team_id", "quarter", "visitor_score", "home_score", "play_index"),
    "score_at": lambda r: scoring.score_changed(scoring.score_at(r.plays, r.scoring)),
    "score_by_period": lambda r: scoring.score_by_period(r.scoring, r.plays.groupBy("game_id").agg(F.max("quarter").alias("last_quarter"))),
    "period_bounds": lambda r: explore.period_bounds(r.plays),
    "visible_drives": lambda r: explore.visible_drives(*r.drives, r.plays, r.cursors).drop("start_no"),
    "recent_plays": lambda r: explore.recent_plays(r.plays, r.cursors).select("game_id", "play_index", "rank", "description"),
    "search_plays": lambda r: explore.search_plays(r.plays, "intercepted").select("game_id", "play_index", "rank"),
    "completed_drive": lambda r: explore.completed_drive(r.drives[0], r.cursors),
    "game_counts": lambda r: explore.game_counts(r.plays, r.drives[0], r.linked[0]),
    "game_flow": lambda r: explore.game_flow(r.drives[0]),
    "play_flags": lambda r: explore.play_flags(r.plays),
    "player_plays": lambda r: explore.player_plays(play_text.tacklers(r.plays).select("game_id", "play_index", "player")),
    "all_actions": lambda r: r.sequence.filter("type = 'action'").select("game_id", "play_index", "start", "action_type", "outcome", "actor", "target", "team_id", "end_position", "yards"),
    "possession_changes": lambda r: r.sequence.filter("type = 'possession-change'").select("game_id", "play_index", "team_id", "location", "result"),
    "play_sequence": lambda r: r.sequence.select("game_id", "play_index", "event_order", "type", "ruling", "phase"),
    "participants": lambda r: semantics.participants(r.sequence).select("game_id", "play_index", "name", "role", "source", "team_id"),
    "merged_penalties": lambda r: semantics.merged_penalties(r.sequence).drop("event_order"),
    "play_summary": lambda r: r.summary.drop("official_yards"),
    "field_view": lambda r: explore.field_view(r.summary, r.plays, r.teams, explore.action_ends(r.sequence, semantics.spots(r.sequence, semantics.merged_penalties(r.sequence), r.plays, r.summary))),
    "return_paths": lambda r: replay.return_paths(r.sequence, r.teams).select("game_id", "play_index", "team_id", "direction", "yards", "touchdown", F.posexplode("path").alias("step", "p")).select("game_id", "play_index", "team_id", "direction", "yards", "touchdown", "step", "p.*"),
    "parse_outcome": lambda r: explore.parse_outcome(r.summary, r.scoring),
    "period_summary": lambda r: explore.period_summary(scoring.score_by_period(r.scoring, r.plays.groupBy("game_id").agg(F.max("quarter").alias("last_quarter"))), r.team_rows),
    "drive_so_far": lambda r: explore.drive_so_far(*r.drives, current_drives(r)),
    "drive_participants": lambda r: explore.drive_participants(semantics.participants(r.sequence), *r.drives, current_drives(r)),
    "drive_chart": lambda r: r.chart.drop("possession_time", "obtained", "penalty_yards", "first_downs"),
    "flow_results": lambda r: views.flow_results(r.chart, r.drives[0]),
    "drive_results": lambda r: views.drive_results(r.chart, r.drives[0], r.plays, r.summary),
    "drive_detail": lambda r: views.drive_detail(r.drives[1], r.plays).select("game_id", "drive_id", "play_no", "play_index", "clock", "yard_line", "description"),
    "participant_labels": lambda r: views.participant_labels(semantics.participants(r.sequence), r.names, r.linked[0]),
    "replay_view": lambda r: replay.replay_view(r.sequence, semantics.merged_penalties(r.sequence), r.summary, plays.with_state_after(r.plays), r.teams),
    "scoring_phases": lambda r: replay.scoring_phases(r.sequence, semantics.merged_penalties(r.sequence)),
    "play_spots": lambda r: semantics.spots(r.sequence, semantics.merged_penalties(r.sequence), r.plays, r.summary).drop("place"),
    "admin_events": lambda r: semantics.admin_events(r.sequence).select("game_id", "play_index", "type"),
    "report_teams": lambda r: r.team_rows,
    "game_meta": lambda r: sections.game_meta(r.pages, r.team_rows),
    "team_stats": lambda r: quality.stat_compare(sections.team_stats(r.pages)),
    "scoring_rows": lambda r: r.scoring.select("game_id", "score_no", "team_id", "quarter", "clock", "description", "visitor_score", "home_score"),
    "starters": lambda r: r.part("starters").drop("at"),
    "roster": lambda r: r.part("roster").drop("at"),
    "passing_stats": lambda r: r.part("passing_stats"),
    "rushing_stats": lambda r: r.part("rushing_stats"),
    "receiving_stats": lambda r: r.part("receiving_stats"),
    "defense_stats": lambda r: r.part("defense_stats"),
    "snap_counts": lambda r: r.part("snap_counts").drop("at"),
    "player_list": lambda r: quality.player_list(r.players),
    "players_sorted": lambda r: sections.players_sorted(r.players).select("game_id", "player_no", "team_id", "name"),
    "position_group_counts": lambda r: quality.position_group_counts(r.players),
    "play_players": lambda r: r.linked[1],
    "players_in_plays": lambda r: r.linked[1].groupBy("game_id", "team_id", "name").agg(F.count("*").alias("plays")),
    "team_metrics": lambda r: quality.team_metrics(r.team_rows, r.linked[0], sections.team_stats(r.pages)),
    "issues": lambda r: r.messages,
    "play_events": lambda r: semantics.play_events(r.remarked),
    "play_reviews": lambda r: semantics.reviews(r.remarked).drop("event_order", "ruling"),
    "play_injuries": lambda r: semantics.injury_updates(r.remarked),
    "game_outcome": lambda r: quality.game_outcome(r.team_rows.select("game_id").distinct(), r.messages, r.plays, r.drives[0], r.scoring),
    "drive_scores": lambda r: scoring.drive_scores(r.drives[0], scoring.score_at(r.plays, r.scoring)),
    "visible_chart": lambda r: explore.visible_chart(*r.chart_drives, r.plays, r.cursors).drop("possession_time", "penalty_yards", "first_downs"),
    "section_flags": lambda r: lines.section_flags(lines.page_text(r.pages)),
    "play_by_play_pages": lambda r: lines.pbp_range(lines.page_text(r.report)),
    "result_codes": lambda r: r.chart.select("game_id", "drive_id", result_code(F.col("result")).alias("code")),
    "source_vs_parsed": lambda r: explore.source_vs_parsed(r.plays, r.sequence),
}

QUERIES = {name: (lambda spark, sf_dir, job=job: job(Reports(spark, sf_dir))) for name, job in JOBS.items()} | {
    "approved_urls": lambda spark, sf_dir: manifest.approved_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ORIGIN, SUFFIX),
    "valid_game_ids": game_ids,
}


# ---- SQL

INCOMPLETE = "((event_type NOT IN ('purchase', 'signup', 'click', 'error') AND event_id % 3 = 2) OR (event_type = 'error' AND event_id % 4 = 3))"
NO_GAIN_TEXT = f"({INCOMPLETE} OR (event_type = 'purchase' AND event_id % 2 = 1))"
DEFENDERS = """CASE event_type WHEN 'click' THEN [defender, second] WHEN 'signup' THEN [second] WHEN 'purchase' THEN []
  WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN [second] WHEN 1 THEN [defender] WHEN 2 THEN [defender, defender] ELSE [] END
  ELSE CASE WHEN event_id % 3 < 2 THEN [defender] ELSE [] END END"""
STARTS = """,
starts AS (SELECT game_id, possession AS team_id, quarter, clock AS start_clock, i AS first_index,
  row_number() OVER (PARTITION BY game_id ORDER BY i) AS start_no, row_number() OVER (PARTITION BY game_id, possession ORDER BY i) AS team_drive_number
  FROM truth WHERE starts_drive),
ranged AS (SELECT s.*, o.end_index, concat('drive-', s.team_id, '-', s.team_drive_number) AS drive_id FROM starts s LEFT JOIN (
  SELECT a.game_id, a.start_no, min(b.first_index) AS end_index FROM starts a JOIN starts b ON a.game_id = b.game_id AND a.team_id <> b.team_id AND b.start_no > a.start_no GROUP BY ALL) o
  ON o.game_id = s.game_id AND o.start_no = s.start_no),
gained AS (SELECT *, CASE WHEN {none} THEN 0 ELSE yards END AS gain FROM truth),
inside AS (SELECT r.game_id, r.drive_id, r.start_no, t.i AS play_index, t.gain FROM ranged r JOIN gained t
  ON t.game_id = r.game_id AND t.i >= r.first_index AND (r.end_index IS NULL OR t.i < r.end_index) AND t.possession = r.team_id),
drives AS (SELECT r.game_id, r.drive_id, r.team_id, r.team_drive_number, r.quarter, r.start_clock, min(play_index) AS first_play_index, max(play_index) AS last_play_index,
  count(*) AS plays, CAST(sum(gain) AS BIGINT) AS net_yards FROM ranged r JOIN inside x ON x.game_id = r.game_id AND x.drive_id = r.drive_id GROUP BY ALL),
cursors AS (SELECT DISTINCT game_id, (n * (user_id % 5)) // 5 - 1 AS cursor FROM truth)""".replace("{none}", NO_GAIN_TEXT)
SCORES = """,
scores AS (SELECT game_id, possession AS team_id, quarter, greatest(clock_sec - CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END, 0) AS clock_sec, passer, kind,
  row_number() OVER (PARTITION BY game_id ORDER BY i) AS score_no,
  CAST(sum(CASE WHEN possession = visitor THEN CASE WHEN kind = 'touchdown' THEN 7 ELSE 3 END ELSE 0 END) OVER (PARTITION BY game_id ORDER BY i) AS INTEGER) AS visitor_score,
  CAST(sum(CASE WHEN possession = home THEN CASE WHEN kind = 'touchdown' THEN 7 ELSE 3 END ELSE 0 END) OVER (PARTITION BY game_id ORDER BY i) AS INTEGER) AS home_score
  FROM truth WHERE event_type = 'purchase'),
linked AS (SELECT s.game_id, s.score_no, s.team_id, s.quarter, s.visitor_score, s.home_score, coalesce(arg_min(t.i, abs(t.clock_sec - s.clock_sec) * 100000 + t.i), -1) AS play_index
  FROM scores s LEFT JOIN truth t ON t.game_id = s.game_id AND t.quarter = s.quarter AND t.kind = s.kind AND contains(t.description, s.passer) GROUP BY ALL),
at_play AS (SELECT t.game_id, t.i AS play_index, coalesce(arg_max(l.visitor_score, l.score_no), 0) AS visitor_score, coalesce(arg_max(l.home_score, l.score_no), 0) AS home_score
  FROM truth t LEFT JOIN linked l ON l.game_id = t.game_id AND l.play_index >= 0 AND l.play_index <= t.i GROUP BY ALL)"""
ABS = "CASE WHEN possession = visitor THEN abs_yard + to_go ELSE abs_yard - to_go END"

CASES = """,
cases AS (SELECT *, i AS play_index, CASE WHEN yards = 0 THEN 'no-gain' WHEN yards < 0 THEN 'loss' ELSE 'gain' END AS moved,
  CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'td' ELSE 'fg' END WHEN 'signup' THEN 'punt' WHEN 'click' THEN 'rush'
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN CASE WHEN yards = 0 THEN 'flat' ELSE 'sack' END WHEN 2 THEN 'fum' ELSE 'pen' END
    ELSE CASE WHEN event_id % 3 < 2 THEN 'comp' ELSE 'inc' END END AS c FROM truth),
first_actions AS (SELECT game_id, play_index, 0 AS start, CASE c WHEN 'fg' THEN 'field-goal' WHEN 'punt' THEN 'punt' WHEN 'sack' THEN 'sack' WHEN 'rush' THEN 'rush' WHEN 'fum' THEN 'rush' ELSE 'pass' END AS action_type,
  CASE c WHEN 'td' THEN 'touchdown' WHEN 'int' THEN 'interception' WHEN 'pen' THEN 'incomplete' WHEN 'inc' THEN 'incomplete' WHEN 'comp' THEN 'complete' WHEN 'fg' THEN 'good' WHEN 'sack' THEN 'loss' WHEN 'punt' THEN NULL ELSE moved END AS outcome,
  passer AS actor, CASE WHEN c IN ('td', 'int', 'pen', 'comp', 'inc') THEN target END AS target, possession AS team_id,
  CASE WHEN c IN ('int', 'sack', 'rush', 'fum', 'comp', 'punt') THEN end_spot END AS end_position, CAST(CASE c WHEN 'fg' THEN 44 WHEN 'punt' THEN 40 WHEN 'int' THEN NULL WHEN 'pen' THEN NULL WHEN 'inc' THEN NULL ELSE yards END AS INTEGER) AS yards
  FROM cases WHERE c <> 'flat'),
returns AS (SELECT game_id, play_index, CAST(strpos(description, concat('. ', defender, ' to ')) + 1 AS INTEGER) AS start, 'return' AS action_type, moved AS outcome, defender AS actor, CAST(NULL AS VARCHAR) AS target, defence AS team_id, spot AS end_position, CAST(yards AS INTEGER) AS yards
  FROM cases WHERE c IN ('int', 'punt')),
steps AS (SELECT *, CASE c WHEN 'td' THEN ['action', 'touchdown'] WHEN 'fg' THEN ['action', 'kick-crew'] WHEN 'punt' THEN ['action', 'possession-change', 'raw', 'action', 'defense'] WHEN 'int' THEN ['action', 'possession-change', 'action', 'defense']
  WHEN 'flat' THEN ['raw', 'defense'] WHEN 'fum' THEN ['action', 'defense', 'fumble', 'defense', 'recovery', 'possession-change'] WHEN 'pen' THEN ['action', 'penalty'] WHEN 'inc' THEN ['action'] ELSE ['action', 'defense'] END AS types FROM cases),
roles AS (SELECT game_id, play_index, c, possession, defence, unnest(CASE c
  WHEN 'td' THEN [[passer, 'passer', 'main', possession], [target, 'receiver', 'main', possession]]
  WHEN 'comp' THEN [[passer, 'passer', 'main', possession], [target, 'receiver', 'main', possession], [defender, 'tackler', 'parenthetical', defence]]
  WHEN 'inc' THEN [[passer, 'passer', 'main', possession], [target, 'target', 'main', possession]]
  WHEN 'pen' THEN [[passer, 'passer', 'main', possession], [target, 'target', 'main', possession], [defender, 'penalized', 'penalty', defence]]
  WHEN 'fg' THEN [[passer, 'kicker', 'main', possession], [target, 'snapper', 'annotation', possession], [second, 'holder', 'annotation', possession]]
  WHEN 'punt' THEN [[passer, 'punter', 'main', possession], [defender, 'returner', 'main', defence], [second, 'tackler', 'parenthetical', defence]]
  WHEN 'int' THEN [[passer, 'passer', 'main', possession], [target, 'target', 'main', possession], [defender, 'interceptor', 'main', defence], [defender, 'returner', 'main', defence], [second, 'tackler', 'parenthetical', defence]]
  WHEN 'sack' THEN [[passer, 'passer', 'main', possession], [defender, 'sacker', 'parenthetical', defence]]
  WHEN 'flat' THEN [[defender, 'tackler', 'parenthetical', defence]]
  WHEN 'fum' THEN [[passer, 'rusher', 'main', possession], [defender, 'tackler', 'parenthetical', defence], [defender, 'forced-fumble', 'parenthetical', defence], [second, 'recovery', 'annotation', defence]]
  ELSE [[passer, 'rusher', 'main', possession], [defender, 'tackler', 'parenthetical', defence], [second, 'tackler', 'parenthetical', defence]] END) AS p FROM cases),
involved AS (SELECT DISTINCT game_id, play_index, p[1] AS name, p[2] AS role, p[3] AS source, p[4] AS team_id FROM roles)"""
CHART = ", " + bridge.chart_sql()
KEPT = """, kept AS (SELECT *, concat('drive-', team_id, '-', team_drive_number) AS drive_id FROM (
  SELECT game_id, team_id, CAST(team_drive_number AS INTEGER) AS team_drive_number, start_clock, end_clock, end_position, plays, net_yards, result FROM chart WHERE team_drive_number % 7 <> 3 UNION ALL
  SELECT game_id, team_id, CAST(max(team_drive_number) + 1 AS INTEGER), arg_max(start_clock, team_drive_number), arg_max(end_clock, team_drive_number), arg_max(end_position, team_drive_number), arg_max(plays, team_drive_number), arg_max(net_yards, team_drive_number), arg_max(result, team_drive_number) FROM chart GROUP BY game_id, team_id))"""
CURRENT = ", current AS (SELECT c.game_id, c.cursor, arg_max(x.drive_id, x.start_no) AS drive_id FROM cursors c JOIN inside x ON x.game_id = c.game_id AND x.play_index = c.cursor GROUP BY ALL)"
OFFICIAL_END = "CASE WHEN c IN ('int', 'punt', 'pen') THEN spot WHEN c IN ('sack', 'rush', 'fum', 'comp') THEN end_spot END"
FINAL_YARD = "CASE WHEN c IN ('int', 'punt', 'pen') THEN abs_yard WHEN c IN ('sack', 'rush', 'fum', 'comp') THEN end_yard END"
BY_PERIOD = """, grid AS (SELECT game_id, CAST(unnest(range(1, greatest(4, max(quarter)) + 1)) AS INTEGER) AS quarter FROM truth GROUP BY game_id),
        upto AS (SELECT g.game_id, g.quarter, coalesce(max(s.visitor_score), 0) AS v, coalesce(max(s.home_score), 0) AS h FROM grid g LEFT JOIN scores s ON s.game_id = g.game_id AND s.quarter <= g.quarter GROUP BY ALL)"""

PAGES = ", " + report_pages.pages_sql(", unnest(range({n})) AS e(k)")
FULL_NAME = "CASE team_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEAMS.items()) + " END"
NICKNAME = f"regexp_extract({FULL_NAME}, '([^ ]+)$', 1)"
HOME_SEEN = "NOT (side = 1 AND user_id % 6 = 0)"
SNAPS = f"""(SELECT *, CASE WHEN k <= 6 THEN a + 1 END AS oc, CASE WHEN k <= 6 THEN b + 1 END AS op, CASE WHEN k BETWEEN 7 AND 9 THEN a + 2 END AS dc, CASE WHEN k BETWEEN 7 AND 9 THEN c + 1 END AS dp,
  CASE WHEN k % 2 = 0 OR k = 11 THEN c + 3 END AS sc, CASE WHEN k % 2 = 0 OR k = 11 THEN b + 2 END AS sp FROM squad WHERE {HOME_SEEN})"""
#: Who is in a game's tables: all but those that only snaps show, where the home team's are missing; and the number that each shows.
GROUP_OF = "CASE position " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_GROUPS.items()) + " ELSE 'OTHER' END"
GROUP_RANK = f"CASE {GROUP_OF} " + " ".join(f"WHEN '{g}' THEN {k}" for k, g in enumerate(GROUPS)) + " END"
LISTED = f""", listed AS (SELECT s.game_id, s.user_id, s.side, s.team_id, s.k, s.name, s.position, s.k < 6 AS starter, s.a, s.b, s.c,
  CASE WHEN {HOME_SEEN} THEN coalesce(CASE WHEN k <= 6 THEN b + 1 END, CASE WHEN k BETWEEN 7 AND 9 THEN c + 1 END, b + 2) END AS snap_percent FROM squad s WHERE k < 10 OR ({HOME_SEEN}))"""
MENTIONS = """, named AS (
  SELECT game_id, play_index, possession, name, arg_min(team_id, k) AS semantic_team FROM (
    SELECT game_id, play_index, possession, p[1] AS name, p[4] AS team_id, CASE p[2] WHEN 'passer' THEN 0 WHEN 'rusher' THEN 0 WHEN 'target' THEN 1 WHEN 'interceptor' THEN 2 WHEN 'returner' THEN 3 WHEN 'punter' THEN 0 WHEN 'kicker' THEN 0 ELSE 4 END AS k FROM roles) GROUP BY ALL
  UNION SELECT game_id, play_index, possession, CASE c WHEN 'punt' THEN target ELSE passer END, NULL FROM cases x WHERE c IN ('punt', 'flat')
    AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.game_id = x.game_id AND r.play_index = x.play_index AND r.p[1] = CASE x.c WHEN 'punt' THEN x.target ELSE x.passer END)),
who AS (SELECT n.game_id, n.play_index, n.name, coalesce(arg_min(l.team_id, CASE WHEN l.team_id = n.semantic_team THEN 0 WHEN l.team_id = n.possession THEN 1000 ELSE 2000 + l.k END), any_value(coalesce(n.semantic_team, n.possession))) AS team_id
  FROM named n LEFT JOIN listed l ON l.game_id = n.game_id AND l.name = n.name GROUP BY n.game_id, n.play_index, n.name),
everyone AS (SELECT game_id, team_id, name, position, snap_percent FROM listed UNION ALL
  SELECT DISTINCT game_id, team_id, name, NULL, NULL FROM who w WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.game_id = w.game_id AND l.team_id = w.team_id AND l.name = w.name)),
figures AS (SELECT t.game_id, t.user_id, t.side, t.team_id, count(e.name) AS players, count(e.position) AS positioned, count(e.snap_percent) AS snapped, CAST(7 AS BIGINT) AS stat_values
  FROM sides t LEFT JOIN everyone e ON e.game_id = t.game_id AND e.team_id = t.team_id GROUP BY ALL)"""

def lookup_sql(k: int) -> str:
    return "CASE code " + " ".join(f"WHEN '{code}' THEN '{row[k]}'" for code, row in quality.CHECKS.items()) + " END"


RAISED = f""", found AS (SELECT game_id, team_id, 'score-row-incomplete' AS code, 'error' AS severity FROM figures WHERE user_id % 5 = 0
        UNION ALL SELECT game_id, team_id, 'positions-low', 'warning' FROM figures WHERE players >= 10 AND positioned < 0.25 * players
        UNION ALL SELECT game_id, team_id, 'snaps-one-sided', 'error' FROM figures WHERE side = 1 AND user_id % 6 = 0
        UNION ALL SELECT game_id, team_id, 'pbp-team-missing', 'error' FROM figures f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.game_id = f.game_id AND t.possession = f.team_id)
        UNION ALL SELECT game_id, team_id, 'drives-team-missing', 'error' FROM figures f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.game_id = f.game_id AND t.possession = f.team_id)
        UNION ALL SELECT v.game_id, CASE WHEN v.positioned * h.players < h.positioned * v.players THEN v.team_id ELSE h.team_id END, 'positions-one-sided', 'error' FROM figures v JOIN figures h ON v.game_id = h.game_id AND v.side = 0 AND h.side = 1
          WHERE greatest(v.positioned / v.players, h.positioned / h.players) > 0.6 AND least(v.positioned / v.players, h.positioned / h.players) < 0.25),
raised AS (SELECT f.game_id, f.team_id, f.code, f.severity, {lookup_sql(0)} AS section, replace({lookup_sql(2)}, '{{team}}', coalesce({NICKNAME}, '')) AS message FROM found f)"""

SELECTS = {
    "replay_view": (CASES, """, after AS (SELECT *, CASE WHEN possession = visitor THEN 1 ELSE -1 END AS sign, coalesce(c IN ('rush', 'comp', 'sack', 'inc') AND (c = 'inc' OR yards = 0) AND lead(possession) OVER w = possession AND lead(spot) OVER w = spot, FALSE) AS stays
          FROM cases WINDOW w AS (PARTITION BY game_id ORDER BY i)),
        ended AS (SELECT *, CASE WHEN stays OR c IN ('int', 'punt', 'pen') THEN abs_yard WHEN c IN ('sack', 'rush', 'fum', 'comp') THEN end_yard END AS last_yard, CASE WHEN stays OR c IN ('int', 'punt', 'pen') THEN spot WHEN c IN ('sack', 'rush', 'fum', 'comp') THEN end_spot END AS last_spot FROM after),
        said AS (SELECT *, CASE c WHEN 'td' THEN 'touchdown' WHEN 'fg' THEN 'field-goal' ELSE CASE WHEN last_yard = abs_yard THEN 'no-movement' WHEN last_yard IS NOT NULL THEN 'movement' ELSE 'unknown' END END AS mode,
          CAST(CASE WHEN c IN ('td', 'int', 'punt') THEN yards WHEN c = 'fg' THEN NULL ELSE (last_yard - abs_yard) * sign END AS INTEGER) AS movement FROM ended),
        labelled AS (SELECT *, CASE WHEN movement IS NULL THEN 'RESULT NOT ESTIMATED' WHEN movement = 0 THEN 'NO GAIN · 0 YARDS' ELSE concat(CASE WHEN movement > 0 THEN '+' ELSE '' END, movement, ' YARDS') END AS moved_label FROM said)
        SELECT game_id, play_index, mode, CASE c WHEN 'td' THEN 'pass-complete' WHEN 'comp' THEN 'pass-complete' WHEN 'inc' THEN 'pass-incomplete' WHEN 'pen' THEN 'pass-incomplete' WHEN 'int' THEN 'pass-intercepted' WHEN 'fg' THEN 'field-goal' WHEN 'punt' THEN 'punt' WHEN 'sack' THEN 'sack' WHEN 'flat' THEN 'other' ELSE 'run' END AS visualization,
          CASE c WHEN 'td' THEN 'END ZONE' WHEN 'fg' THEN 'UPRIGHTS' ELSE last_spot END AS final_position, round(10 + CASE WHEN c IN ('td', 'fg') THEN CASE WHEN sign = 1 THEN 100 ELSE 0 END ELSE last_yard END * 0.8::DOUBLE, 4) AS final_percent, movement,
          CASE WHEN c = 'td' THEN 'touchdown' WHEN c = 'fg' THEN 'kick-target' WHEN stays THEN 'state-after' WHEN last_spot IS NOT NULL THEN 'explicit' ELSE 'unknown' END AS final_source,
          CASE WHEN c = 'int' THEN CASE WHEN yards <> 0 THEN concat('INTERCEPTION RETURN · ', yards, ' YARDS') ELSE 'INTERCEPTION' END WHEN c = 'fum' THEN 'FUMBLE LOST' WHEN c = 'td' THEN 'TOUCHDOWN' WHEN c = 'fg' THEN 'FIELD GOAL · GOOD' WHEN c IN ('inc', 'pen') THEN 'INCOMPLETE · 0 YARDS' ELSE moved_label END AS result_label,
          CASE WHEN c = 'int' THEN CASE WHEN yards <> 0 THEN defender ELSE end_spot END WHEN c = 'fum' THEN moved_label WHEN c = 'td' THEN passer WHEN c = 'fg' THEN '44 YARDS' WHEN c IN ('inc', 'pen') OR movement IS NULL THEN NULL WHEN movement > 0 THEN 'POSITIVE GAIN' WHEN movement < 0 THEN 'LOSS' ELSE 'BALL DID NOT ADVANCE' END AS result_detail,
          CASE WHEN c IN ('int', 'fum') THEN 'turnover' WHEN c = 'td' THEN 'touchdown' WHEN c = 'fg' THEN 'field-goal-good' WHEN c IN ('inc', 'pen') THEN 'incomplete' WHEN movement IS NULL THEN 'unknown' WHEN movement > 0 THEN 'positive' WHEN movement < 0 THEN 'negative' ELSE 'no-gain' END AS result_state, c IN ('int', 'fum') AS turnover FROM labelled"""),
    "scoring_phases": (CASES, "SELECT game_id, play_index, CAST(0 AS INTEGER) AS phase_no, 'scrimmage' AS phase, 'SCRIMMAGE' AS label, 'TOUCHDOWN' AS result, CAST(NULL AS VARCHAR) AS position FROM cases WHERE c = 'td'"),
    "play_spots": (CASES, f"""SELECT game_id, play_index, 'start' AS kind, spot AS position FROM cases UNION ALL SELECT game_id, play_index, CASE outcome WHEN 'interception' THEN outcome ELSE 'action-end' END, end_position FROM first_actions WHERE end_position IS NOT NULL
        UNION ALL SELECT game_id, play_index, 'action-end', spot FROM cases WHERE c IN ('int', 'punt') UNION ALL SELECT game_id, play_index, CASE c WHEN 'fum' THEN 'recovery' ELSE 'enforcement' END, spot FROM cases WHERE c IN ('fum', 'pen')
        UNION ALL SELECT game_id, play_index, 'official-final', {OFFICIAL_END} FROM cases WHERE {OFFICIAL_END} IS NOT NULL"""),
    "admin_events": (CASES, "SELECT game_id, play_index, 'kick-crew' AS type FROM cases WHERE c = 'fg'"),
    "report_teams": (PAGES, f"SELECT game_id, CAST(side AS INTEGER) AS side, CASE side WHEN 0 THEN 'visitor' ELSE 'home' END AS home_away, {FULL_NAME} AS name, score, CAST(CASE WHEN user_id % 5 <> 0 THEN 6 ELSE 3 END AS BIGINT) AS digit_items, team_id, {NICKNAME} AS short_name, CASE team_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items())} END AS color FROM sides"),
    "game_meta": (PAGES, f"""SELECT v.game_id, concat({FULL_NAME.replace('team_id', 'v.team_id')}, ' at ', {FULL_NAME.replace('team_id', 'h.team_id')}) AS title, concat('9/', 1 + v.user_id % 28, '/2023') AS date, '1:02 PM EDT' AS start_time, concat('Field ', v.user_id % 50) AS venue, 'Some City, ST' AS location,
        concat('Cloudy Temp: ', 50 + v.user_id % 40) AS weather, concat('65,', 100 + v.user_id % 900) AS attendance, concat('3:0', v.user_id % 10) AS duration FROM sides v JOIN sides h ON h.game_id = v.game_id AND v.side = 0 AND h.side = 1"""),
    "team_stats": (PAGES, """SELECT game_id, stat_no, label, visitor, home, CASE WHEN label <> 'Turnovers' THEN round(abs(a) / greatest(abs(a), abs(b), 1) * 50, 4) END AS visitor_share, CASE WHEN label <> 'Turnovers' THEN round(abs(b) / greatest(abs(a), abs(b), 1) * 50, 4) END AS home_share
        FROM (SELECT *, TRY_CAST(regexp_extract(visitor, '^[0-9]+') AS DOUBLE) AS a, TRY_CAST(regexp_extract(home, '^[0-9]+') AS DOUBLE) AS b FROM (SELECT game_id, stat_no, label, visitor, CASE WHEN user_id % 7 <> 0 OR stat_no < 3 THEN home ELSE visitor END AS home FROM labels))"""),
    "scoring_rows": (SCORES, "SELECT game_id, score_no, team_id, quarter, concat(clock_sec // 60, ':', lpad(CAST(clock_sec % 60 AS VARCHAR), 2, '0')) AS clock, concat(passer, CASE kind WHEN 'touchdown' THEN ' 7 yd. run (kick is good)' ELSE ' 44 yd. Field Goal' END) AS description, visitor_score, home_score FROM scores"),
    "starters": (PAGES, "SELECT game_id, team_id, name, position FROM squad WHERE k < 6"),
    "roster": (PAGES, "SELECT game_id, team_id, name, position FROM squad WHERE k BETWEEN 6 AND 9"),
    "passing_stats": (PAGES, "SELECT game_id, team_id, name, a + 20.0::DOUBLE AS attempts, a::DOUBLE AS completions, b * 10::DOUBLE AS yards, concat(c % 5, '/13') AS sacks, (c % 5)::DOUBLE AS touchdowns, b + 10::DOUBLE AS long, (c % 3)::DOUBLE AS interceptions, a + 0.5::DOUBLE AS rating FROM squad WHERE k = 0"),
    "rushing_stats": (PAGES, "SELECT game_id, team_id, name, a::DOUBLE AS attempts, b * 3::DOUBLE AS yards, c + 0.5::DOUBLE AS average, b::DOUBLE AS long, (c % 4)::DOUBLE AS touchdowns FROM squad WHERE k = 1"),
    "receiving_stats": (PAGES, "SELECT game_id, team_id, name, b::DOUBLE AS targets, c::DOUBLE AS receptions, a::DOUBLE AS yards, c + 0.5::DOUBLE AS average, b::DOUBLE AS long, (c % 3)::DOUBLE AS touchdowns FROM squad WHERE k IN (2, 3)"),
    "defense_stats": (PAGES, f"SELECT game_id, team_id, name, {', '.join(f'((a + {i} * b) % 12)::DOUBLE AS {n}' for i, n in enumerate(sections.DEFENCE))} FROM squad WHERE k BETWEEN 7 AND 9"),
    "snap_counts": (PAGES, f"SELECT game_id, team_id, name, position, oc AS offense_count, op AS offense_percent, dc AS defense_count, dp AS defense_percent, sc AS special_count, sp AS special_percent FROM {SNAPS}"),
    "player_list": (PAGES + LISTED, f"""SELECT game_id, team_id, CAST(row_number() OVER (PARTITION BY game_id, team_id ORDER BY {GROUP_RANK}, position, name) AS INTEGER) AS place, name, position, starter, {GROUP_OF} AS position_group,
        CASE WHEN k = 0 THEN concat(a, '/', a + 20, ' · ', b * 10, ' PASS YDS') WHEN k = 1 THEN concat(a, ' CAR · ', b * 3, ' RUSH YDS') WHEN k IN (2, 3) THEN concat(c, ' REC · ', a, ' REC YDS')
          WHEN k BETWEEN 7 AND 9 THEN concat((a + 2 * b) % 12, ' TKL · ', (a + 3 * b) % 12, ' SACK') ELSE 'Game participant' END AS summary, snap_percent FROM listed"""),
    "players_sorted": (PAGES + LISTED, "SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY team_id, name) AS INTEGER) AS player_no, team_id, name FROM listed"),
    "position_group_counts": (PAGES + LISTED, f"SELECT game_id, team_id, {GROUP_OF} AS position_group, count(*) AS players FROM listed GROUP BY ALL"),
    "play_players": (PAGES + CASES + LISTED + MENTIONS, "SELECT game_id, play_index, team_id, name FROM who"),
    "players_in_plays": (PAGES + CASES + LISTED + MENTIONS, "SELECT game_id, team_id, name, count(*) AS plays FROM who GROUP BY ALL"),
    "team_metrics": (PAGES + CASES + LISTED + MENTIONS, "SELECT game_id, CAST(side AS INTEGER) AS side, team_id, players, positioned, snapped, stat_values FROM figures"),
    "issues": (PAGES + CASES + LISTED + MENTIONS + RAISED, "SELECT * FROM raised"),
    "play_events": (CASES, """SELECT game_id, play_index, e[1] AS event_type, e[2] AS actor, e[3] AS team_id, e[4] AS location, e[5] AS result FROM (SELECT game_id, i AS play_index, unnest(CASE
        WHEN c = 'int' THEN [['interception', defender, defence, end_spot, NULL]]
        WHEN c = 'fum' THEN [['fumble', passer, possession, NULL, NULL], ['recovery', second, defence, spot, NULL], ['possession-change', second, defence, spot, 'recovery']]
        WHEN c = 'td' THEN [['touchdown', target, possession, NULL, NULL]]
        WHEN c = 'fg' AND i % 3 = 0 THEN [['block', 'B.Birch', defence, NULL, 'field-goal']]
        WHEN c = 'comp' AND i % 4 = 0 THEN [['replay', NULL, NULL, NULL, 'upheld']] WHEN c = 'comp' AND i % 4 = 1 THEN [['replay', NULL, NULL, NULL, 'confirmed']]
        WHEN c = 'rush' AND i % 5 = 0 THEN [['injury', 'A.Abel', 'SEA', NULL, 'is Out of the game']] END) AS e FROM cases)"""),
    "play_reviews": (CASES, """SELECT game_id, i AS play_index, CASE WHEN i % 4 = 0 THEN 'replay-official' ELSE 'team-challenge' END AS source, CASE WHEN i % 4 = 1 THEN 'Foxes' END AS team_name, CASE WHEN i % 4 = 0 THEN 'pass completion' ELSE 'ball placement' END AS subject,
        CASE WHEN i % 4 = 0 THEN 'upheld' ELSE 'confirmed' END AS result, CAST(CASE WHEN i % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS timeout_number FROM cases WHERE c = 'comp' AND i % 4 IN (0, 1)"""),
    "play_injuries": (CASES, "SELECT game_id, i AS play_index, 'SEA' AS team_id, 'A.Abel' AS player, 'is Out of the game' AS status, 'Out' AS code FROM cases WHERE c = 'rush' AND i % 5 = 0"),
    "game_outcome": (PAGES + CASES + LISTED + MENTIONS + RAISED + SCORES, f"""SELECT s.game_id, CASE WHEN count(r.code) > 0 THEN 'partial' ELSE 'complete' END AS outcome, count(r.code) AS issues, count(*) FILTER (r.severity = 'error') AS errors,
        concat_ws(chr(10), CASE WHEN any_value(u.unlinked) > 0 THEN concat(any_value(u.unlinked), ' scoring plays could not be linked to Play-by-Play.') END, nullif(coalesce(string_agg(r.message, chr(10) ORDER BY list_position({list(quality.CHECKS)}, r.code), coalesce(r.team_id, '')), ''), '')) AS warnings
        FROM sides s LEFT JOIN raised r ON r.game_id = s.game_id LEFT JOIN (SELECT game_id, count(*) FILTER (play_index < 0) AS unlinked FROM linked GROUP BY 1) u ON u.game_id = s.game_id WHERE s.side = 0 GROUP BY s.game_id"""),
    "drive_scores": (STARTS + SCORES, """SELECT d.game_id, d.drive_id, coalesce(b.visitor_score, 0) AS visitor_before, coalesce(b.home_score, 0) AS home_before, coalesce(a.visitor_score, 0) AS visitor_after, coalesce(a.home_score, 0) AS home_after,
        (coalesce(b.visitor_score, 0), coalesce(b.home_score, 0)) <> (coalesce(a.visitor_score, 0), coalesce(a.home_score, 0)) AS changed
        FROM drives d LEFT JOIN at_play b ON b.game_id = d.game_id AND b.play_index = d.first_play_index - 1 LEFT JOIN at_play a ON a.game_id = d.game_id AND a.play_index = d.last_play_index"""),
    "visible_chart": (STARTS + CHART + KEPT, f"""SELECT game_id, drive_id, team_id, finished, CAST(CASE WHEN finished THEN plays ELSE seen_plays END AS INTEGER) AS plays, CAST(CASE WHEN finished THEN net_yards ELSE seen_yards END AS INTEGER) AS gross_yards,
        CAST(CASE WHEN finished THEN net_yards ELSE seen_yards END AS INTEGER) AS net_yards, CASE WHEN finished THEN end_clock ELSE '{explore.DASH}' END AS end_clock, CASE WHEN finished THEN end_position ELSE '{explore.DASH}' END AS end_position, CASE WHEN finished THEN result ELSE '{explore.IN_PROGRESS}' END AS result
        FROM (SELECT k.game_id, k.drive_id, k.team_id, coalesce(d.last_play_index, -1) <= c.cursor AS finished, k.plays, k.net_yards, k.end_clock, k.end_position, k.result,
          (SELECT count(*) FROM inside x WHERE x.game_id = k.game_id AND x.drive_id = k.drive_id AND x.play_index <= c.cursor) AS seen_plays, (SELECT coalesce(sum(gain), 0) FROM inside x WHERE x.game_id = k.game_id AND x.drive_id = k.drive_id AND x.play_index <= c.cursor) AS seen_yards
          FROM kept k JOIN cursors c ON c.game_id = k.game_id LEFT JOIN drives d ON d.game_id = k.game_id AND d.drive_id = k.drive_id WHERE coalesce(d.first_play_index, -1) <= c.cursor)"""),
    "section_flags": (PAGES, "SELECT game_id, TRUE AS scoring, TRUE AS team_stats, TRUE AS individual_stats, TRUE AS defensive_stats, TRUE AS drive_chart, TRUE AS playtime, TRUE AS play_by_play, TRUE AS roster FROM sides WHERE side = 0"),
    "play_by_play_pages": ("", "SELECT game_id, CAST(1000 AS INTEGER) AS first_page, CAST(8000 AS INTEGER) AS end_page FROM truth WHERE i = 0"),
    "result_codes": (STARTS + CHART, f"SELECT game_id, drive_id, CASE result {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RESULT_CODES.items())} END AS code FROM chart"),
    "all_actions": (CASES, "SELECT * FROM first_actions UNION ALL SELECT * FROM returns"),
    "possession_changes": (CASES, "SELECT game_id, play_index, defence AS team_id, CASE c WHEN 'fum' THEN spot ELSE end_spot END AS location, CASE c WHEN 'fum' THEN 'recovery' WHEN 'int' THEN 'interception' ELSE c END AS result FROM cases WHERE c IN ('int', 'punt', 'fum')"),
    "play_sequence": (CASES, "SELECT game_id, play_index, event_order, type, 'official' AS ruling, CASE WHEN type = 'raw' THEN 'administrative' ELSE 'scrimmage' END AS phase FROM (SELECT game_id, play_index, CAST(generate_subscripts(types, 1) - 1 AS INTEGER) AS event_order, unnest(types) AS type FROM steps)"),
    "participants": (CASES, "SELECT * FROM involved"),
    "merged_penalties": (CASES, "SELECT game_id, play_index, defence AS team_id, defender AS player, 'Defensive Holding' AS penalty_type, 5 AS yards, spot, 'enforced' AS enforcement, 'accepted' AS status, TRUE AS no_play, 'scrimmage' AS phase, CAST(1 AS BIGINT) AS occurrences FROM cases WHERE c = 'pen'"),
    "play_summary": (CASES, f"""SELECT k.game_id, k.play_index, k.possession, coalesce(a.action_type, 'other') AS official_action, a.outcome AS official_outcome, a.actor AS official_actor, a.team_id AS official_team, {OFFICIAL_END} AS official_end,
        CASE c WHEN 'int' THEN 'INTERCEPTION' WHEN 'fum' THEN 'FUMBLE LOST' END AS turnover_label, CASE WHEN c IN ('int', 'punt', 'fum') THEN defence END AS changed_to, CASE c WHEN 'fum' THEN spot WHEN 'int' THEN end_spot WHEN 'punt' THEN end_spot END AS changed_at,
        CASE c WHEN 'fum' THEN 'recovery' WHEN 'int' THEN 'interception' WHEN 'punt' THEN 'punt' END AS changed_by, r.actor AS returner, r.yards AS return_yards,
        CASE c WHEN 'td' THEN 'pass-complete' WHEN 'comp' THEN 'pass-complete' WHEN 'inc' THEN 'pass-incomplete' WHEN 'pen' THEN 'pass-incomplete' WHEN 'int' THEN 'pass-intercepted' WHEN 'fg' THEN 'field-goal' WHEN 'punt' THEN 'punt' WHEN 'sack' THEN 'sack' WHEN 'flat' THEN 'other' ELSE 'run' END AS visualization,
        c = 'td' AS touchdown, FALSE AS reviewed, CAST(len(types) AS BIGINT) AS events, CAST(len(list_filter(types, lambda x: x = 'action')) AS BIGINT) AS actions, CAST(len(list_filter(types, lambda x: x = 'raw')) AS BIGINT) AS raw_parts, CASE WHEN c IN ('punt', 'flat') THEN 'partial' ELSE 'structured' END AS parse_status
        FROM steps k LEFT JOIN returns r USING (game_id, play_index) LEFT JOIN (SELECT * FROM returns UNION ALL SELECT f.* FROM first_actions f ANTI JOIN returns x USING (game_id, play_index)) a USING (game_id, play_index)"""),
    "field_view": (CASES, f"""SELECT game_id, play_index, abs_yard AS start_yard, final_yard, round(10 + abs_yard * 0.8::DOUBLE, 4) AS start_percent, round(10 + final_yard * 0.8::DOUBLE, 4) AS final_percent, CAST((final_yard - abs_yard) * sign AS INTEGER) AS movement,
        CASE WHEN c IN ('punt', 'int', 'sack', 'rush', 'comp') THEN end_spot WHEN c = 'fum' THEN spot END AS action_end, round(10 + 0.8::DOUBLE * CASE WHEN c IN ('punt', 'int', 'sack', 'rush', 'comp') THEN end_yard WHEN c = 'fum' THEN abs_yard END, 4) AS action_end_percent,
        round(10 + 0.8::DOUBLE * least(100, greatest(0, abs_yard + sign * CASE WHEN is_goal THEN CASE WHEN sign = 1 THEN 100 - abs_yard ELSE abs_yard END ELSE distance END)), 4) AS first_down_percent
        FROM (SELECT *, {FINAL_YARD} AS final_yard, CASE WHEN possession = visitor THEN 1 ELSE -1 END AS sign FROM cases)"""),
    "return_paths": (CASES, """SELECT game_id, play_index, defence AS team_id, CASE WHEN defence = visitor THEN 'right' ELSE 'left' END AS direction, CAST(yards AS INTEGER) AS yards, FALSE AS touchdown, p.step AS step, CASE p.step WHEN 0 THEN 'change' ELSE 'end' END AS kind,
        CASE p.step WHEN 0 THEN end_spot ELSE spot END AS position, round(10 + 0.8::DOUBLE * CASE p.step WHEN 0 THEN end_yard ELSE abs_yard END, 4) AS percent FROM cases, (VALUES (0), (1)) p(step) WHERE c IN ('int', 'punt')"""),
    "parse_outcome": (CASES + SCORES, """SELECT g.*, coalesce(u.unlinked, 0) AS unlinked, FALSE AS coverage_low, CASE WHEN coalesce(u.unlinked, 0) > 0 THEN 'partial' ELSE 'complete' END AS outcome
        FROM (SELECT game_id, count(*) AS plays, count(*) FILTER (c NOT IN ('punt', 'flat')) AS structured, count(*) FILTER (c IN ('punt', 'flat')) AS partial, CAST(0 AS BIGINT) AS raw FROM cases GROUP BY 1) g
        LEFT JOIN (SELECT game_id, count(*) FILTER (play_index < 0) AS unlinked FROM linked GROUP BY 1) u USING (game_id)"""),
    "period_summary": (PAGES + SCORES + BY_PERIOD, """SELECT game_id, CASE WHEN title = 'FINAL' AND visitor_score = home_score THEN 'FINAL - TIE' ELSE title END AS title, visitor_score, home_score FROM (
        SELECT u.game_id, t.title, CAST(CASE t.title WHEN 'FINAL' THEN any_value(a.score) ELSE max(CASE WHEN quarter <= t.q THEN v ELSE 0 END) END AS BIGINT) AS visitor_score, CAST(CASE t.title WHEN 'FINAL' THEN any_value(b.score) ELSE max(CASE WHEN quarter <= t.q THEN h ELSE 0 END) END AS BIGINT) AS home_score
        FROM upto u JOIN sides a ON a.game_id = u.game_id AND a.side = 0 JOIN sides b ON b.game_id = u.game_id AND b.side = 1, (VALUES ('HALFTIME', 2), ('END OF REGULATION', 4), ('FINAL', 99)) t(title, q) GROUP BY u.game_id, t.title, t.q)"""),
    "drive_so_far": (STARTS + CURRENT, "SELECT u.game_id, u.drive_id, d.team_id, count(*) AS plays_so_far, CASE WHEN d.last_play_index <= u.cursor THEN d.net_yards END AS net_yards FROM current u JOIN drives d USING (game_id, drive_id) JOIN inside x ON x.game_id = u.game_id AND x.drive_id = u.drive_id AND x.play_index <= u.cursor GROUP BY u.game_id, u.drive_id, d.team_id, d.last_play_index, u.cursor, d.net_yards"),
    "drive_participants": (STARTS + CURRENT + CASES, f"""SELECT game_id, CAST(rank AS INTEGER) AS rank, name, role FROM (SELECT game_id, name, role, row_number() OVER (PARTITION BY game_id ORDER BY min(v.play_index), list_position({list(explore.OFFENSIVE_ROLES)}, role), name) AS rank
        FROM involved v JOIN current u USING (game_id) JOIN drives d ON d.game_id = u.game_id AND d.drive_id = u.drive_id JOIN inside x ON x.game_id = u.game_id AND x.drive_id = u.drive_id AND x.play_index = v.play_index AND x.play_index <= u.cursor
        WHERE v.team_id = d.team_id AND role IN {explore.OFFENSIVE_ROLES} GROUP BY game_id, name, role) WHERE rank <= 8"""),
    "drive_chart": (STARTS + CHART, "SELECT game_id, drive_id, team_id, CAST(team_drive_number AS INTEGER) AS team_drive_number, start_clock, end_clock, start_position, CAST(plays AS INTEGER) AS plays, CAST(net_yards AS INTEGER) AS gross_yards, CAST(net_yards AS INTEGER) AS net_yards, end_position, result FROM chart"),
    "flow_results": (STARTS + CHART, "SELECT c.game_id, c.drive_id, least(d.quarter, 5) AS period, c.team_id, c.result, c.result IN ('Touchdown', 'Field Goal') AS scoring, c.result IN ('Interception', 'Fumble', 'Downs') AS turnover FROM chart c JOIN drives d USING (game_id, drive_id)"),
    "drive_results": (STARTS + CHART + CASES, f"""SELECT game_id, drive_id, team_id,
        CASE result WHEN 'Touchdown' THEN 'touchdown' WHEN 'Field Goal' THEN 'field-goal-good' WHEN 'Punt' THEN 'punt' WHEN 'Interception' THEN 'interception' WHEN 'Fumble' THEN 'fumble' WHEN 'Downs' THEN 'downs' ELSE 'end' END AS category,
        CASE result WHEN 'Field Goal' THEN 'FIELD GOAL GOOD' WHEN 'Fumble' THEN 'FUMBLE LOST' WHEN 'Downs' THEN 'TURNOVER ON DOWNS' ELSE upper(result) END AS label,
        CASE WHEN next_team <> team_id THEN next_team WHEN c IN ('int', 'fum') THEN defence END AS new_team,
        CASE WHEN next_team <> team_id THEN next_spot WHEN c = 'int' THEN end_spot WHEN c = 'fum' THEN spot END AS new_spot, CASE WHEN next_team <> team_id THEN next_down END AS new_down
        FROM chart h JOIN (SELECT game_id, i AS last_index, c, defence, spot, end_spot, lead(possession) OVER w AS next_team, lead(spot) OVER w AS next_spot,
          lead(concat(down, CASE down WHEN 1 THEN 'ST' WHEN 2 THEN 'ND' WHEN 3 THEN 'RD' ELSE 'TH' END, ' & ', CASE WHEN is_goal THEN 'Goal' ELSE CAST(distance AS VARCHAR) END)) OVER w AS next_down
          FROM cases WINDOW w AS (PARTITION BY game_id ORDER BY i)) USING (game_id, last_index)"""),
    "drive_detail": (STARTS, "SELECT x.game_id, x.drive_id, CAST(row_number() OVER (PARTITION BY x.game_id, x.drive_id ORDER BY x.play_index) AS INTEGER) AS play_no, x.play_index, t.clock, t.spot AS yard_line, t.description FROM inside x JOIN truth t ON t.game_id = x.game_id AND t.i = x.play_index"),
    "participant_labels": (PAGES + CASES + LISTED + MENTIONS, f"SELECT i.*, w.team_id AS player_team, w.name AS player, e.position FROM (SELECT game_id, play_index, name, role, min(team_id) AS team_id, CASE role {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in views.ROLE_LABELS.items())} END AS label FROM involved GROUP BY ALL) i LEFT JOIN who w ON w.game_id = i.game_id AND w.play_index = i.play_index AND w.name = i.name LEFT JOIN everyone e ON e.game_id = w.game_id AND e.team_id = w.team_id AND e.name = w.name"),
    "drives": (STARTS, "SELECT * FROM drives"),
    "game_totals": (STARTS, "SELECT game_id, plays, touchdowns, drives, longest_drive FROM (SELECT game_id, count(*) AS plays, count(*) FILTER (WHERE kind = 'touchdown') AS touchdowns FROM truth GROUP BY game_id) JOIN (SELECT game_id, count(*) AS drives, max(plays) AS longest_drive FROM drives GROUP BY game_id) USING (game_id)"),
    "chart_drives": (STARTS + CHART + KEPT, "SELECT k.game_id, k.drive_id, k.team_id, k.team_drive_number, k.start_clock, k.result, coalesce(d.quarter, 0) AS quarter, coalesce(d.first_play_index, -1) AS first_play_index, coalesce(d.last_play_index, -1) AS last_play_index, coalesce(d.plays, 0) AS owned_plays FROM kept k LEFT JOIN drives d ON d.game_id = k.game_id AND d.drive_id = k.drive_id"),
    "play_chart_drive": (STARTS + CHART + KEPT, "SELECT t.game_id, t.i AS play_index, arg_max(x.drive_id, x.start_no) AS drive_id FROM truth t LEFT JOIN (SELECT i.* FROM inside i JOIN kept k ON k.game_id = i.game_id AND k.drive_id = i.drive_id) x ON x.game_id = t.game_id AND x.play_index = t.i GROUP BY ALL"),
    "plays_assembled": ("", "SELECT game_id, i AS play_index, quarter, possession, clock, clock_sec, down, distance, is_goal, spot AS yard_line, description FROM truth"),
    "plays_from_items": ("", "SELECT game_id, i AS play_index, quarter, clock_sec, down, spot AS yard_line, possession, description FROM truth"),
    "play_kind_yards": ("", f"SELECT game_id, i AS play_index, kind, CAST(CASE WHEN {INCOMPLETE} THEN 0 WHEN {NO_GAIN_TEXT} THEN NULL ELSE yards END AS INTEGER) AS yards, contains(description, 'No Play') AS no_play FROM truth"),
    "spots": ("", f"""SELECT game_id, i AS play_index,
        CASE WHEN (possession = visitor) THEN abs_yard ELSE 100 - abs_yard END AS field_position, abs_yard AS absolute_yard,
        CASE WHEN possession = visitor THEN 'right' ELSE 'left' END AS direction, round(10 + abs_yard * 0.8::DOUBLE, 4) AS percent,
        CAST(greatest(0, least(100, {ABS})) AS INTEGER) AS first_down_mark,
        concat(down, CASE down WHEN 1 THEN 'ST' WHEN 2 THEN 'ND' WHEN 3 THEN 'RD' ELSE 'TH' END, ' & ', CASE WHEN is_goal THEN 'Goal' ELSE CAST(distance AS VARCHAR) END) AS down_label,
        CASE WHEN quarter >= 5 THEN 'OT' ELSE concat('Q', quarter) END AS period
        FROM (SELECT *, CASE WHEN is_goal THEN CASE WHEN possession = visitor THEN 100 - abs_yard ELSE abs_yard END ELSE distance END AS to_go FROM truth)"""),
    "state_after": ("", "SELECT game_id, i AS play_index, " + ", ".join(f"lead({c}) OVER (PARTITION BY game_id ORDER BY i) AS next_{n}" for c, n in (("quarter", "quarter"), ("clock", "clock"), ("down", "down"), ("distance", "distance"), ("spot", "yard_line"), ("possession", "possession"))) + " FROM truth"),
    "drive_starts": (STARTS, "SELECT game_id, team_id, quarter, start_clock, first_index, start_no, team_drive_number FROM starts"),
    "play_drive_id": (STARTS, "SELECT t.game_id, t.i AS play_index, arg_max(x.drive_id, x.start_no) AS drive_id FROM truth t LEFT JOIN inside x ON x.game_id = t.game_id AND x.play_index = t.i GROUP BY ALL"),
    "play_actions": ("", f"""SELECT game_id, i AS play_index,
        CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'pass-touchdown' ELSE 'field-goal' END WHEN 'signup' THEN 'punt' WHEN 'click' THEN 'rush'
          WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'pass-intercepted' WHEN 1 THEN 'sack' WHEN 2 THEN 'rush' ELSE 'pass-incomplete' END
          ELSE CASE WHEN event_id % 3 < 2 THEN 'pass-complete' ELSE 'pass-incomplete' END END AS action_type,
        passer AS player,
        CASE WHEN kind IN ('pass', 'touchdown', 'penalty') OR (event_type = 'error' AND event_id % 4 = 0) THEN target END AS target,
        CASE WHEN kind IN ('touchdown', 'penalty') OR (event_type = 'error' AND event_id % 4 = 0) OR (kind = 'pass' AND event_id % 3 < 2) THEN 'short' WHEN kind = 'pass' THEN 'deep' END AS depth,
        CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'left' END WHEN 'signup' THEN NULL WHEN 'click' THEN {bridge.pick(bridge.DIRECTIONS, 'event_id % 7')}
          WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'middle' WHEN 1 THEN NULL WHEN 2 THEN 'up the middle' ELSE 'right' END
          ELSE CASE WHEN event_id % 3 < 2 THEN 'left' ELSE 'right' END END AS direction,
        CAST(CASE WHEN {NO_GAIN_TEXT} OR yards = 0 THEN NULL ELSE yards END AS INTEGER) AS yards FROM truth"""),
    "penalties": ("", "SELECT game_id, i AS play_index, defence AS team_id, defender AS player, 'Defensive Holding' AS penalty_type, 5 AS yards, spot, 'accepted' AS status, TRUE AS no_play FROM truth WHERE kind = 'penalty'"),
    "turnover_events": ("", """SELECT game_id, i AS play_index, 'interception' AS event_type, defender AS player, end_spot AS spot, CAST(NULL AS VARCHAR) AS team_id FROM truth WHERE event_type = 'error' AND event_id % 4 = 0
        UNION ALL SELECT game_id, i, 'fumble', defender, NULL, NULL FROM truth WHERE event_type = 'error' AND event_id % 4 = 2
        UNION ALL SELECT game_id, i, 'recovery', second, spot, defence FROM truth WHERE event_type = 'error' AND event_id % 4 = 2"""),
    "tacklers": ("", f"SELECT game_id, i AS play_index, CAST(generate_subscripts(ds, 1) - 1 AS INTEGER) AS k, unnest(ds) AS player FROM (SELECT game_id, i, {DEFENDERS} AS ds FROM truth)"),
    "scoring_linked": (SCORES, "SELECT * FROM linked"),
    "score_at": (SCORES, "SELECT *, (visitor_score, home_score) <> (coalesce(lag(visitor_score) OVER w, 0), coalesce(lag(home_score) OVER w, 0)) AS changed FROM at_play WINDOW w AS (PARTITION BY game_id ORDER BY play_index)"),
    "score_by_period": (SCORES + """, grid AS (SELECT game_id, CAST(unnest(range(1, greatest(4, max(quarter)) + 1)) AS INTEGER) AS quarter FROM truth GROUP BY game_id),
        upto AS (SELECT g.game_id, g.quarter, coalesce(max(s.visitor_score), 0) AS v, coalesce(max(s.home_score), 0) AS h FROM grid g LEFT JOIN scores s ON s.game_id = g.game_id AND s.quarter <= g.quarter GROUP BY ALL)""", """SELECT game_id, quarter, v - coalesce(lag(v) OVER w, 0) AS visitor_points, h - coalesce(lag(h) OVER w, 0) AS home_points FROM upto WINDOW w AS (PARTITION BY game_id ORDER BY quarter)"""),
    "period_bounds": ("", "SELECT game_id, least(quarter, 5) AS period, min(i) AS first_play, max(i) AS last_play FROM truth GROUP BY ALL"),
    "visible_drives": (STARTS, """SELECT d.game_id, d.drive_id, d.team_id, d.last_play_index <= c.cursor AS finished,
        CASE WHEN d.last_play_index <= c.cursor THEN d.plays ELSE count(*) END AS plays, CASE WHEN d.last_play_index <= c.cursor THEN d.net_yards ELSE CAST(sum(x.gain) AS BIGINT) END AS net_yards
        FROM drives d JOIN cursors c ON c.game_id = d.game_id JOIN inside x ON x.game_id = d.game_id AND x.drive_id = d.drive_id AND x.play_index <= c.cursor
        GROUP BY d.game_id, d.drive_id, d.team_id, d.last_play_index, d.plays, d.net_yards, c.cursor"""),
    "recent_plays": (STARTS, "SELECT game_id, play_index, CAST(rank AS INTEGER) AS rank, description FROM (SELECT t.game_id, t.i AS play_index, row_number() OVER (PARTITION BY t.game_id ORDER BY t.i DESC) AS rank, description FROM truth t JOIN cursors c ON c.game_id = t.game_id AND t.i <= c.cursor) WHERE rank <= 3"),
    "search_plays": ("", "SELECT game_id, play_index, CAST(rank AS INTEGER) AS rank FROM (SELECT game_id, i AS play_index, row_number() OVER (PARTITION BY game_id ORDER BY i) AS rank FROM truth WHERE event_type = 'error' AND event_id % 4 = 0) WHERE rank <= 8"),
    "completed_drive": (STARTS, "SELECT d.game_id, d.drive_id, d.plays, d.net_yards FROM drives d JOIN cursors c ON c.game_id = d.game_id AND d.last_play_index = c.cursor"),
    "game_counts": (STARTS + PAGES + CASES + LISTED + MENTIONS, """SELECT t.game_id, t.plays, coalesce(d.drives, 0) AS drives, coalesce(p.players, 0) AS players FROM (SELECT game_id, count(*) AS plays FROM truth GROUP BY 1) t
        LEFT JOIN (SELECT game_id, count(*) AS drives FROM drives GROUP BY 1) d USING (game_id) LEFT JOIN (SELECT game_id, count(*) AS players FROM everyone GROUP BY 1) p USING (game_id)"""),
    "game_flow": (STARTS, "SELECT game_id, quarter, team_id, count(*) AS drives, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(net_yards) AS BIGINT) AS net_yards FROM drives GROUP BY 1, 2, 3"),
    "play_flags": ("", "SELECT game_id, i AS play_index, kind = 'touchdown' AS touchdown, kind = 'turnover' AS turnover, kind = 'penalty' AS penalty, kind = 'penalty' AS no_play FROM truth"),
    "player_plays": ("", f"SELECT game_id, player, count(DISTINCT i) AS plays FROM (SELECT game_id, i, unnest({DEFENDERS}) AS player FROM truth) GROUP BY ALL"),
    "source_vs_parsed": ("", "SELECT game_id, count(*) FILTER (kind = 'penalty') AS named, count(*) FILTER (kind = 'penalty') AS parsed, CAST(0 AS BIGINT) AS brackets_named, CAST(0 AS BIGINT) AS brackets_parsed FROM truth GROUP BY 1"),
}


def sql_of(name: str) -> str:
    more, select = SELECTS[name]
    return f"WITH {bridge.truth_sql()}{more}\n{select}"


ORACLE_SQL = {name: sql_of(name) for name in SELECTS} | {
    "approved_urls": f"""SELECT page_id, url, coalesce(length(url) <= 2048 AND regexp_extract(url, '^([a-z]+://[^/?#@]*)', 1) = '{ORIGIN}'
        AND ends_with(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '{SUFFIX}') AND NOT contains(url, '?') AND NOT contains(url, '#') AND NOT contains(url, '@'), FALSE) AS ok FROM pages""",
    "valid_game_ids": "SELECT page_id, concat('week-', page_id, CASE WHEN page_id % 5 = 0 THEN '--x' WHEN page_id % 7 = 0 THEN '-A' ELSE '-game' END) AS game_id, NOT (page_id % 5 = 0 OR page_id % 7 = 0) AS ok FROM pages",
}
