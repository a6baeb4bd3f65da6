"""Event tables from play descriptions: set-level patterns over all plays, JVM functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"[A-Z][a-z]?(?:\.[A-Z])?\.[A-Z][A-Za-z'-]*"
SPOT = r"(?:[A-Z]{2,3} \d+|50)"
KEYS = ("game_id", "play_index")


def find_spans(text: str, pattern: str):
    """All matches of a pattern as array<struct<start, end, text>>; offsets from 0, end exclusive."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    numbered = F.transform(found, lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    before = lambda k: F.aggregate(F.slice(between, 1, k + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda a, s: a + F.length(s))
    return F.transform(numbered, lambda x: F.struct(before(x["k"]).alias("start"), (before(x["k"]) + F.length(x["m"])).alias("end"), x["m"].alias("text")))


def part(pattern: str, k: int = 1):
    return F.nullif(F.regexp_extract("description", pattern, k), F.lit(""))


#: The first pattern that fits a description's first name decides; groups are (player, ...).
LEAD = rf"^(?:\([^)]*\) )?({NAME})"
GRAMMAR = (
    ("pass-incomplete", rf"{LEAD} pass incomplete"),
    ("pass-intercepted", rf"{LEAD} pass .*INTERCEPTED by"),
    ("pass-touchdown", rf"{LEAD} pass (?!incomplete).*TOUCHDOWN(?! NULLIFIED)"),
    ("pass-complete", rf"{LEAD} pass "),
    ("scramble", rf"{LEAD} scrambles"),
    ("rush", rf"{LEAD} (?:left end|left tackle|left guard|up the middle|right guard|right tackle|right end)"),
    ("kneel", rf"{LEAD} kneels"),
    ("spike", rf"{LEAD} spiked"),
    ("sack", rf"{LEAD} sacked"),
    ("field-goal", rf"{LEAD} \d+ yard field goal"),
    ("extra-point", rf"{LEAD} extra point"),
    ("punt", rf"{LEAD} punts"),
    ("kickoff", rf"{LEAD} kicks"),
)


def play_actions(plays: DataFrame) -> DataFrame:
    """One row for each play with an action: type, player, target, direction, depth, spot, yards."""
    d = F.col("description")
    kind = F.coalesce(*[F.when(d.rlike(p), name) for name, p in GRAMMAR])
    target = F.coalesce(part(rf"intended for ({NAME})"), part(rf"pass (?:incomplete )?(?:short|deep) (?:left|middle|right) to ({NAME})"))
    return plays.withColumn("action_type", kind).filter("action_type is not null").select(
        *KEYS, "action_type", part(LEAD).alias("player"),
        F.when(F.col("action_type").startswith("pass"), target).alias("target"),
        F.when(F.col("action_type").startswith("pass"), part(r" pass (?:incomplete )?(short|deep)")).alias("depth"),
        F.coalesce(part(r" pass (?:incomplete )?(?:short|deep) (left|middle|right)"), part(r" (left end|left tackle|left guard|up the middle|right guard|right tackle|right end)")).alias("direction"),
        part(rf"^[^.]*(?:\.[A-Z][^.]*)*? to ({SPOT})").alias("spot_after_to"),
        part(r"for (-?\d+) yards?").try_cast("int").alias("yards"),
    )


def penalties(plays: DataFrame) -> DataFrame:
    """Team, player, type, yards, spot, status and no_play of each penalty."""
    pattern = rf"PENALTY on ([A-Z]{{2,3}})-({NAME}), ([^,]+?)(?:, (\d+) yards?)?(?:, (enforced|placed) at ({SPOT}))?(?:, (declined|offsetting))?(?: - (No Play))?\."
    spans = F.explode(F.regexp_extract_all("description", F.lit(pattern), F.lit(0))).alias("p")
    group = lambda k: F.nullif(F.regexp_extract("p", pattern, k), F.lit(""))
    status = F.when(group(7) == "declined", "declined").when(group(7) == "offsetting", "offsetting").when(group(4).isNotNull() | group(5).isNotNull(), "accepted").otherwise("unknown")
    return plays.filter(F.col("description").contains("PENALTY on")).select(*KEYS, spans).select(
        *KEYS, group(1).alias("team_id"), group(2).alias("player"), group(3).alias("penalty_type"), group(4).try_cast("int").alias("yards"), group(6).alias("spot"), status.alias("status"), group(8).isNotNull().alias("no_play")
    )


def turnover_events(plays: DataFrame) -> DataFrame:
    """Interceptions, fumbles and recoveries, in order of the text."""
    patterns = {"interception": rf"INTERCEPTED by ({NAME}) at ({SPOT})()", "fumble": rf"FUMBLES \(({NAME})\)()()", "recovery": rf"RECOVERED by [A-Z]{{2,3}}-({NAME}) at ({SPOT})()"}
    parts = [
        plays.filter(F.col("description").rlike(p)).select(*KEYS, F.lit(k).alias("event_type"), part(p, 1).alias("player"), part(p, 2).alias("spot"), F.when(F.lit(k) == "recovery", part(r"RECOVERED by ([A-Z]{2,3})-")).alias("team_id"))
        for k, p in patterns.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tacklers(plays: DataFrame) -> DataFrame:
    """Each name in a parenthesis of defenders, with its order."""
    inner = F.regexp_extract_all("description", F.lit(rf"\(({NAME}(?:[;,] ?{NAME})*)\)"), F.lit(1))
    return plays.select(*KEYS, F.posexplode(F.flatten(F.transform(inner, lambda g: F.regexp_extract_all(g, F.lit(NAME), F.lit(0))))).alias("k", "player"))
