"""Tables of the report's other pages: teams, game data, team statistics, scoring rows, and the players' tables.

Everything starts from ``lines`` (rebuild_lines) and is keyed by game; ``marked_pages`` says which pages a table is on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.spots import POSITION_GROUPS, TEAMS, lookup
from fieldledger.operators.lines import first_page_with, page_text, with_marks

PAGE_WIDTH = 612.0
LABEL_TOLERANCE = 1.25
# What marks a page, a band or a row.
SUMMARY = "National Football League Game Summary"
PLAYER = r"[A-Z][a-z]?\.[A-Z][A-Za-z'-]*(?:-[A-Za-z]+)*"
STARTER = r"\b([A-Z]{1,3})\s+\d+\s+([A-Z][a-z]?\.[A-Za-z'-]+(?:-[A-Za-z]+)?)"
ROSTER = r"\b([A-Z]{1,3})\s+\d+\s+([A-Z][a-z]?\.[A-Za-z'-]+(?: [A-Z][A-Za-z'-]+)?)"
TABLE_HEAD = r"^(?:RUSHING|PASSING|PASS RECEIVING|INTERCEPTIONS)\b"
STAT_LABELS_BELOW = 400.0
PASSING = ("attempts", "completions", "yards", "sacks", "touchdowns", "long", "interceptions", "rating")
RUSHING = ("attempts", "yards", "average", "long", "touchdowns")
RECEIVING = ("targets", "receptions", "yards", "average", "long", "touchdowns")
DEFENCE = ("tackles", "assists", "combined", "sacks", "sack_yards", "tackles_for_loss", "quarterback_hits", "interceptions", "passes_defended", "forced_fumbles", "fumble_recoveries")
UNITS = ("Offense", "Defense", "Special Teams")
MARKERS = (SUMMARY, "Final Team Statistics", "Final Individual Statistics", "Final Defensive Statistics", "Playtime Percentage", "Ball Possession And Drive Chart", "Miscellaneous Statistics Report")


# ---- bands of a page


def tokens(items: Column) -> Column:
    return F.transform(F.filter(items, lambda s: F.trim(s["text"]) != ""), lambda s: F.trim(s["text"]))


def within(items: str, low: Column, high: Column) -> Column:
    return F.filter(items, lambda s: (s["x"] >= low) & (s["x"] < high))


def split_sides(lines: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """Two rows for each line: side 0, the items left of the middle (the visitor's), and side 1; with their tokens."""
    half = lambda k: F.filter("items", lambda s: (s["x"] < width / 2) if k == 0 else (s["x"] >= width / 2))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), half(k).alias("side_items")) for k in (0, 1)])
    return lines.withColumn("half", F.explode(sides)).select(*lines.columns, "half.side", "half.side_items").withColumn("tokens", tokens(F.col("side_items")))


def between_headers(lines: DataFrame, top: Column, bottom: Column, top_default: float = float("inf"), bottom_default: float = float("-inf")) -> DataFrame:
    """The lines strictly below the first line for which ``top`` holds and above the first one for which ``bottom`` does,
    page by page; the defaults stand for a header that isn't there."""
    page = Window.partitionBy("game_id", "page")
    y = lambda where, default: F.coalesce(F.max(F.when(where, F.col("y"))).over(page), F.lit(default))
    return lines.withColumns({"top_y": y(top, top_default), "bottom_y": y(bottom, bottom_default)}).filter("y < top_y and y > bottom_y").drop("top_y", "bottom_y")


def marked_pages(lines: DataFrame, marker: str, first: bool = True) -> DataFrame:
    """The lines of the pages that hold the marker: the game's first such page, or all of them.

    Lines that know their pages' marks (``with_marks``) are only filtered.
    """
    known = lines if "page_marks" in lines.columns else with_marks(lines, (marker,))
    return known.filter(F.array_contains("first_marks" if first else "page_marks", marker)).select(*[c for c in lines.columns])


# ---- teams and the game


def initials(name: Column) -> Column:
    return F.upper(F.substring(F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), ""), 1, 3))


def team_dim(teams: DataFrame, colours: dict[str, str]) -> DataFrame:
    """(name, home_away, ...) -> + team_id, short_name, color: of the 32 teams, else initials, last word and a side's colour."""
    codes = lookup({name: code for code, name in TEAMS.items()}, F.col("name"))
    return teams.withColumn("team_id", F.coalesce(codes, initials(F.col("name")))).withColumns(
        {
            "short_name": F.element_at(F.split("name", " "), -1),
            "color": F.coalesce(lookup(colours, F.col("team_id")), F.when(F.col("home_away") == "visitor", colours["visitor"]).otherwise(colours["home"])),
        }
    )


def teams(lines: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """(game_id, side, home_away, name, score, digit_items): from the labels' rows of the summary page.

    The row of a label is all that lies within LABEL_TOLERANCE of it; left of the middle is the name, the last number
    right of it the score.  A game without a label still has both teams.
    """
    summary = marked_pages(lines, SUMMARY).select("game_id", "page", "line_no", "y", "text", "items")
    labels = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(n).alias("home_away"), F.lit(f"{n.upper()}:").alias("label")) for k, n in ((0, "visitor"), (1, "home"))])
    found = summary.withColumn("l", F.explode(labels)).filter(F.col("text").startswith(F.col("l.label"))).groupBy("game_id", "l").agg(F.max("y").alias("label_y"))
    every = summary.select("game_id").distinct().withColumn("l", F.explode(labels)).join(found, ["game_id", "l"], "left")
    near = summary.select("game_id", "y", F.explode("items").alias("s")).join(every, "game_id").filter(F.abs(F.col("y") - F.col("label_y")) <= LABEL_TOLERANCE)
    text, x = F.trim("s.text"), F.col("s.x")
    name = F.when((x < width / 2) & (text != F.col("l.label")), F.struct(x.alias("x"), text.alias("t")))
    digits = F.when((x > width / 2) & text.rlike(r"^\d+$"), F.struct(x.alias("x"), text.try_cast("int").alias("n")))
    row = near.groupBy("game_id", "l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda s: s["t"]), " ").alias("name"), F.max(digits)["n"].alias("score"), F.count(digits).alias("digit_items"))
    out = every.select("game_id", "l").join(row, ["game_id", "l"], "left")
    default = F.initcap("l.home_away")
    return out.select("game_id", "l.side", "l.home_away", F.coalesce(F.nullif(F.col("name"), F.lit("")), default).alias("name"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("digit_items", F.lit(0)).alias("digit_items"))


def team_sides(team_rows: DataFrame) -> DataFrame:
    """(game_id, visitor_id, visitor_name, home_id, home_name): the two teams of a report in one row."""
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    return team_rows.groupBy("game_id").agg(of(0, "team_id").alias("visitor_id"), of(0, "name").alias("visitor_name"), of(1, "team_id").alias("home_id"), of(1, "name").alias("home_name"))


def part(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def game_meta(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    """Date, start time, venue, location, weather, attendance and duration; the title is "visitor at home"."""
    summary = page_text(marked_pages(lines, SUMMARY)).withColumnRenamed("page", "first_page")
    first = lambda pattern: part(F.col("text"), rf"(?m){pattern}")
    venue = F.split(first(r"^at\s+(.*)$"), ",", 2)
    paid = page_text(marked_pages(lines, SUMMARY, first=False)).filter(F.col("text").contains("Paid Attendance:")).join(summary.select("game_id", "first_page"), "game_id").filter("page <> first_page")
    paid = paid.groupBy("game_id").agg(F.min_by("text", "page").alias("paid"))
    names = team_rows.groupBy("game_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "name"))), lambda s: s["name"]), " at ").alias("title"))
    line = F.coalesce(part(F.col("paid"), r"(?m)^(.*Paid Attendance:.*)$"), F.lit(""))
    return summary.join(paid, "game_id", "left").join(names, "game_id", "left").select(
        "game_id", "title", first(r"Date:\s+\w+,\s+([^\s]+(?:/\d{4})?)").alias("date"), first(r"Start Time:\s+([^\n]+)").alias("start_time"),
        F.get(venue, 0).alias("venue"), F.coalesce(F.trim(F.get(venue, 1)), F.lit("")).alias("location"), first(r"^Game Weather:\s*(.*)$").alias("weather"),
        part(line, r"Paid Attendance:\s*([\d,]+)").alias("attendance"), part(line, r"Time:\s*([\d:]+)").alias("duration"),
    )


def team_stats(lines: DataFrame) -> DataFrame:
    """(game_id, stat_no, label, visitor, home): rows with a label left of the values' column and two values in it."""
    page = marked_pages(lines, "Final Team Statistics")
    label = F.array_join(tokens(F.filter("items", lambda s: s["x"] < STAT_LABELS_BELOW)), " ")
    d = page.select("game_id", "line_no", label.alias("label"), tokens(F.filter("items", lambda s: s["x"] > STAT_LABELS_BELOW)).alias("values"))
    d = d.filter((F.col("label") != "") & (F.size("values") >= 2) & ~F.col("label").isin("Visitor", "Home"))
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("line_no"))
    return d.select("game_id", number.alias("stat_no"), "label", F.get("values", 0).alias("visitor"), F.element_at("values", -1).alias("home"))


def scoring_rows(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    """(game_id, page, line_no, team_id, quarter, clock, description, visitor_score, home_score) of every summary page."""
    d = marked_pages(lines, SUMMARY, first=False).withColumn("t", tokens(F.col("items")))
    rows = d.filter(F.get("t", 1).rlike(r"^\d+$") & F.get("t", 2).rlike(r"^\d+:\d+$") & (F.size("t") >= 5)).withColumn("short_name", F.get("t", 0))
    score = lambda k: F.coalesce(F.try_element_at("t", F.lit(k)).try_cast("int"), F.lit(0))
    return rows.join(team_rows.select("game_id", "team_id", "short_name"), ["game_id", "short_name"]).select(
        "game_id", "page", "line_no", "team_id", F.get("t", 1).try_cast("int").alias("quarter"), F.get("t", 2).alias("clock"),
        F.array_join(F.slice("t", F.lit(4), F.size("t") - 5), " ").alias("description"), score(-2).alias("visitor_score"), score(-1).alias("home_score"),
    )


# ---- players


def team_of(team_rows: DataFrame) -> DataFrame:
    return team_rows.select("game_id", "side", "team_id")


def position_and_name(text: Column, pattern: str) -> Column:
    return F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("position"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("name")))


def starters(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    """(game_id, team_id, name, position, at): between the lineups' header and the substitutions."""
    text = F.col("text")
    rows = between_headers(marked_pages(lines, SUMMARY), text.contains("Offense") & text.contains("Defense"), text.contains("Substitutions"))
    each = split_sides(rows).join(team_of(team_rows), ["game_id", "side"]).select("game_id", "team_id", "line_no", position_and_name(F.array_join("tokens", " "), STARTER).alias("p"))
    return each.groupBy("game_id", "team_id", "p.name").agg(F.min_by("p.position", "line_no").alias("position"), F.min("line_no").alias("at"))


def roster(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    """(game_id, team_id, name, position, at): between the substitutions and those not active; a row may wrap."""
    text = F.col("text")
    page = Window.partitionBy("game_id", "page")
    both = marked_pages(lines, SUMMARY).withColumn("marks", F.sum(F.when(text.contains("Substitutions"), 1).when(text.contains("Not Active"), 1000).otherwise(0)).over(page)).filter("marks % 1000 > 0 and marks >= 1000").drop("marks")
    rows = split_sides(between_headers(both, text.contains("Substitutions"), text.contains("Not Active")))
    whole = rows.groupBy("game_id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.array_join("tokens", " ").alias("t")))), lambda s: s["t"]), " ").alias("t"))
    each = whole.join(team_of(team_rows), ["game_id", "side"]).select("game_id", "team_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("t", F.lit(ROSTER), F.lit(1)).alias("position"), F.regexp_extract_all("t", F.lit(ROSTER), F.lit(2)).alias("name"))).alias("at", "p"))
    known = each.filter(F.col("p.position").isin(*POSITION_GROUPS))
    return known.groupBy("game_id", "team_id", "p.name").agg(F.min_by("p.position", "at").alias("position"), F.min("at").alias("at"))


def stat_rows(lines: DataFrame, team_rows: DataFrame, top: str, bottom: str, names: tuple[str, ...], texts: tuple[str, ...] = ()) -> DataFrame:
    """(game_id, team_id, name, one column for each statistic): rows of a table whose first token is a player; a number that isn't one is 0."""
    page = marked_pages(lines, "Final Individual Statistics")
    head = lambda name: F.col("text").startswith(name) & F.col("text").rlike(TABLE_HEAD)
    rows = split_sides(between_headers(page, head(top), head(bottom), -1.0, -1.0)).filter(F.get("tokens", 0).rlike(f"^{PLAYER}$") & (F.size("tokens") > len(names)))
    value = lambda k, name: F.get("tokens", k) if name in texts else F.coalesce(F.get("tokens", k).try_cast("double"), F.lit(0.0))
    stats = [value(k, name).alias(name) for k, name in enumerate(names, start=1)]
    each = rows.join(team_of(team_rows), ["game_id", "side"]).select("game_id", "team_id", F.get("tokens", 0).alias("name"), "line_no", F.struct(*stats).alias("stats"))
    return each.groupBy("game_id", "team_id", "name").agg(F.max_by("stats", "line_no").alias("stats")).select("game_id", "team_id", "name", "stats.*")


def passing_stats(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    return stat_rows(lines, team_rows, "PASSING", "PASS RECEIVING", PASSING, ("sacks",))


def rushing_stats(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    return stat_rows(lines, team_rows, "RUSHING", "PASSING", RUSHING)


def receiving_stats(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    return stat_rows(lines, team_rows, "PASS RECEIVING", "INTERCEPTIONS", RECEIVING)


def defense_stats(lines: DataFrame, team_rows: DataFrame) -> DataFrame:
    """(game_id, team_id, name, 11 columns): a page is the team's whose name stands over its regular defensive plays."""
    pages = marked_pages(lines, "Final Defensive Statistics", first=False)
    whose = page_text(pages).join(team_rows.select("game_id", "side", "team_id", F.col("name").alias("team")), "game_id")
    titled = F.col("text").contains(F.concat("team", F.lit("\nRegular Defensive Plays")))
    in_line = F.regexp_like("text", F.concat(F.lit(r"(?m)^\Q"), F.col("team"), F.lit(r"\E.*Regular Defensive Plays")))
    of_page = whose.filter(titled | in_line).groupBy("game_id", "page").agg(F.min_by("team_id", F.struct(~titled, F.col("side"))).alias("team_id"))
    rows = pages.withColumn("t", tokens(F.col("items"))).filter(F.get("t", 0).rlike(PLAYER) & (F.size("t") > len(DEFENCE))).join(of_page, ["game_id", "page"])
    stats = F.struct(*[F.coalesce(F.get("t", k).try_cast("double"), F.lit(0.0)).alias(n) for k, n in enumerate(DEFENCE, start=1)])
    each = rows.groupBy("game_id", "team_id", F.get("t", 0).alias("name")).agg(F.max_by(stats, F.struct("page", "line_no")).alias("stats"))
    return each.select("game_id", "team_id", "name", "stats.*")


def snap_counts(lines: DataFrame, team_rows: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """(game_id, team_id, name, position, at, and for each unit count and percent, null where the unit has none).

    The header's words are the left edges of the units, on this page and those after it.
    """
    starts = first_page_with(lines, "Playtime Percentage").withColumnRenamed("page", "start")
    d = split_sides(lines.join(starts, "game_id").filter("page >= start"), width)
    at = lambda word: F.get(F.filter("side_items", lambda s: F.trim(s["text"]) == word), 0)["x"]
    n = lambda word: F.size(F.filter("items", lambda s: F.trim(s["text"]) == word))
    heads = d.filter((F.col("page") == F.col("start")) & (n(UNITS[0]) == 2) & (n(UNITS[1]) == 2)).groupBy("game_id", "side").agg(*[F.min_by(at(u), "line_no").alias(f"x{k}") for k, u in enumerate(UNITS)])
    named = d.withColumn("who", F.get(F.filter("side_items", lambda s: F.trim(s["text"]).rlike(f"^{PLAYER}$")), 0)).filter("who is not null")
    rows = named.join(heads, ["game_id", "side"]).join(team_of(team_rows), ["game_id", "side"])
    place = F.get(F.filter("side_items", lambda s: (s["x"] > F.col("who.x")) & F.trim(s["text"]).isin(*POSITION_GROUPS)), 0)["text"]
    ends = [F.col("x1"), F.col("x2"), F.when(F.col("side") == 0, width / 2).otherwise(width)]
    units = []
    for k, (unit, end) in enumerate(zip(("offense", "defense", "special"), ends)):
        words = tokens(within("side_items", F.col(f"x{k}"), end))
        count, share = F.get(F.filter(words, lambda w: w.rlike(r"^\d+$")), 0), F.get(F.filter(words, lambda w: w.rlike(r"^\d+%$")), 0)
        both = count.isNotNull() & share.isNotNull()
        units += [F.when(both, count.try_cast("int")).alias(f"{unit}_count"), F.when(both, F.rtrim(share, F.lit("%")).try_cast("int")).alias(f"{unit}_percent")]
    row = F.struct(F.trim(place).alias("position"), *units)
    out = rows.groupBy("game_id", "team_id", F.trim("who.text").alias("name")).agg(F.max_by(row, F.struct("page", "line_no")).alias("s"), F.min(F.struct(F.lit(1).alias("seen"), F.col("page"), F.col("line_no"))).alias("at"), F.min_by(F.trim(place), F.struct(place.isNull(), F.col("page"), F.col("line_no"))).alias("first_position"))
    return out.select("game_id", "team_id", "name", F.col("first_position").alias("position"), (F.col("at.page") * 10_000 + F.col("at.line_no")).alias("at"), *[f"s.{u}_{c}" for u in ("offense", "defense", "special") for c in ("count", "percent")])


def players_merged(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each (game_id, team_id, name): the first position of starters, roster, snaps; starter; and a struct for each
    table of statistics.  ``parts`` has any of starters, roster, passing, rushing, receiving, defense, snaps."""
    order = ("starters", "roster", "rushing", "passing", "receiving", "defense", "snaps")
    stats = {k: [c for c in parts[k].columns if c not in ("game_id", "team_id", "name", "position", "at")] for k in order if k in parts}
    rows = []
    for rank, k in enumerate(order):
        if k in parts:
            has = parts[k].columns
            position = F.col("position") if "position" in has else F.lit(None).cast("string")
            at = F.col("at").cast("long") if "at" in has else F.lit(0).cast("long")
            own = [F.struct(*stats[k]).alias(k)] if stats[k] else []
            rows.append(parts[k].select("game_id", "team_id", "name", position.alias("position"), F.struct(F.lit(rank).alias("rank"), at.alias("at")).alias("listed"), F.lit(k == "starters").alias("starter"), *own))
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    kept = [F.first(k, ignorenulls=True).alias(k) for k in stats if stats[k]]
    return union.groupBy("game_id", "team_id", "name").agg(F.min_by("position", F.when(F.col("position").isNotNull(), F.col("listed"))).alias("position"), F.bool_or("starter").alias("starter"), F.min("listed").alias("listed"), *kept)


def players_sorted(players: DataFrame) -> DataFrame:
    """By team, then name, in locale order, numbered in the game."""
    order = Window.partitionBy("game_id").orderBy(F.collate("team_id", "UNICODE"), F.collate("name", "UNICODE"), "name")
    return players.withColumn("player_no", F.row_number().over(order))


# ---- players in plays


def linked_names(players: DataFrame, mentions: DataFrame) -> DataFrame:
    """(game_id, play_index, name, team_id, player): who the names in the plays are; player is null for one that is nobody's.

    ``mentions``: game_id, play_index, name, semantic_team (null if the text doesn't say), possession, description.  A name is a
    player of the game with exactly this name; where there is none, one whose longer name begins with it and stands in the text.
    The text's team goes first, then the one in possession, then who is listed first.  Nobody's name has the text's team or
    the one in possession.
    """
    known = players.select("game_id", "name", F.col("name").alias("p_name"), F.col("team_id").alias("p_team"), "listed", F.lit(True).alias("exact"))
    begun = known.filter(F.col("p_name").contains(" ")).withColumns({"name": F.substring_index("p_name", " ", 1), "exact": F.lit(False)})
    names = mentions.dropDuplicates(["game_id", "play_index", "name"])
    # One join for both: a player of exactly this name goes before all longer ones, so those count only where there is none.
    found = names.join(known.unionByName(begun), ["game_id", "name"], "left").withColumn("fits", F.col("exact") | F.col("description").contains(F.col("p_name")))
    rank = F.struct(~F.col("exact"), ~F.coalesce(F.col("p_team") == F.col("semantic_team"), F.lit(False)), F.col("p_team") != F.col("possession"), F.col("listed"), F.col("p_team"), F.col("p_name"))
    best = F.min_by(F.struct(F.col("p_team").alias("team_id"), F.col("p_name").alias("player")), F.when(F.col("fits"), rank))
    every = found.groupBy("game_id", "play_index", "name", "semantic_team", "possession").agg(best.alias("b"))
    return every.select("game_id", "play_index", "name", F.coalesce("b.team_id", "semantic_team", "possession").alias("team_id"), F.col("b.player").alias("player"))


def link_players(players: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players with new ones, play_players): a name that is nobody's (``linked_names``) is a new player."""
    names = linked_names(players, mentions)
    new = names.filter("player is null").groupBy("game_id", "team_id", "name").agg(F.struct(F.lit(9).alias("rank"), F.min("play_index").cast("long").alias("at")).alias("listed")).withColumns({"position": F.lit(None).cast("string"), "starter": F.lit(False)})
    links = names.select("game_id", "play_index", "team_id", F.coalesce("player", "name").alias("name")).distinct()
    return players.unionByName(new, allowMissingColumns=True), links


def player_summary(passing: str = "passing", rushing: str = "rushing", receiving: str = "receiving", defense: str = "defense") -> Column:
    """The first of passing, rushing, receiving and defence that a player has, as text."""
    whole = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    return (
        F.when(F.col(passing).isNotNull(), F.concat(whole(f"{passing}.completions"), F.lit("/"), whole(f"{passing}.attempts"), F.lit(" · "), whole(f"{passing}.yards"), F.lit(" PASS YDS")))
        .when(F.col(rushing).isNotNull(), F.concat(whole(f"{rushing}.attempts"), F.lit(" CAR · "), whole(f"{rushing}.yards"), F.lit(" RUSH YDS")))
        .when(F.col(receiving).isNotNull(), F.concat(whole(f"{receiving}.receptions"), F.lit(" REC · "), whole(f"{receiving}.yards"), F.lit(" REC YDS")))
        .when(F.col(defense).isNotNull(), F.concat(whole(f"{defense}.combined"), F.lit(" TKL · "), whole(f"{defense}.sacks"), F.lit(" SACK")))
        .otherwise(F.lit("Game participant"))
    )


def snap_percent(snaps: str = "snaps") -> Column:
    return F.coalesce(*[F.col(f"{snaps}.{u}_percent") for u in ("offense", "defense", "special")])
