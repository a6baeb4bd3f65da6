"""Play text to events: spans, actions, possession, order, participants, and one summary row a play.

All work is on exploded spans.  Windows and groups are keyed by (game_id, play_index), so the rows
of a play meet in one task and no group is larger than one play's text.  The chain to ``play_sequence`` has no
union and no join: plays that lie by game are read once and exchanged nowhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.spots import lookup, norm_team_code

KEYS = ["game_id", "play_index"]

# The report's patterns, action grammar (the first that fits wins) and priorities.
NAME = r"(?:[A-Z][a-z]?\.){1,2}[A-Z][A-Za-z'-]*"
SPOT = r"(?:[A-Z]{2,3} \d+|50|end zone)"
DIRECTION = "left end|left tackle|left guard|up the middle|right guard|right tackle|right end"
FORMATION = "(?:shotgun|no huddle|run formation|punt formation|field goal formation)"
FORMED = rf"(?i:\(\s*{FORMATION}(?:\s*,\s*{FORMATION})*\s*\)\s*)"
AIM = r"(?: (short|deep) (left|middle|right))?"
BOUNDARY, WHERE, GAIN = r"(?: ((?:ran|pushed) ob))?", rf"(?: (?:to|at) ({SPOT}))?", r"(?: for (no gain|-?\d+ yards?))?"
GRAMMAR = (
    ("pass", "incomplete", rf"({NAME}) pass incomplete{AIM}(?: (?:to|intended for) ({NAME}))?", {"actor": 1, "depth": 2, "direction": 3, "target": 4}),
    ("pass", "interception", rf"({NAME}) pass{AIM}(?: intended for ({NAME}) )?INTERCEPTED by ({NAME})(?:\s*(?:\([^)]*\)|\[[^\]]+\]))* at ({SPOT})", {"actor": 1, "depth": 2, "direction": 3, "target": 4, "other": 5, "end_position": 6}),
    ("pass", "complete", rf"({NAME}) pass{AIM} to ({NAME}){BOUNDARY}{WHERE}{GAIN}(?:, TOUCHDOWN(?: NULLIFIED by Penalty)?)?", {"actor": 1, "depth": 2, "direction": 3, "target": 4, "boundary": 5, "end_position": 6}),
    ("scramble", None, rf"({NAME}) scrambles(?: ({DIRECTION}))?{BOUNDARY}{WHERE}{GAIN}(?:, TOUCHDOWN)?", {"actor": 1, "direction": 2, "boundary": 3, "end_position": 4}),
    ("rush", None, rf"({NAME}) ({DIRECTION}){BOUNDARY}{WHERE}{GAIN}(?:, TOUCHDOWN)?", {"actor": 1, "direction": 2, "boundary": 3, "end_position": 4}),
    ("rush", None, rf"Handoff to ({NAME}){WHERE}{GAIN}", {"actor": 1, "end_position": 2}),
    ("kneel", None, rf"({NAME}) kneels?(?: to ({SPOT}))?{GAIN}", {"actor": 1, "end_position": 2}),
    ("spike", "incomplete", rf"({NAME}) spiked", {"actor": 1}),
    ("sack", "loss", rf"({NAME}) sacked(?: (ob))? at ({SPOT}) for (-?\d+) yards?", {"actor": 1, "boundary": 2, "end_position": 3, "number": 4}),
    ("field-goal", "kick", rf"({NAME}) (\d+) yard field goal is (GOOD|No Good|BLOCKED)", {"actor": 1, "number": 2, "other": 3}),
    ("extra-point", "kick", rf"({NAME}) extra point is (GOOD|No Good)", {"actor": 1, "other": 2}),
    ("punt", "punt", rf"({NAME}) punts (\d+) yards? to ({SPOT})", {"actor": 1, "number": 2, "end_position": 3}),
    ("kickoff", "kickoff", rf"({NAME}) kicks (\d+) yards? from {SPOT} to ({SPOT})", {"actor": 1, "number": 2, "end_position": 3}),
    ("advance", None, rf"({NAME}){BOUNDARY}{WHERE} for (no gain|-?\d+ yards?)(?:, TOUCHDOWN)?", {"actor": 1, "boundary": 2, "end_position": 3}),
    ("advance", None, rf"({NAME})(?: FUMBLES \(Aborted\) at| to) ({SPOT}){GAIN}", {"actor": 1, "end_position": 2}),
)
PENALTY = rf"(?i)\bPENALTY on ([A-Z]{{2,3}})(?:-\s*({NAME}))?,\s*([^,.]+?)(?:,\s*(\d+) yards?)?(?:,\s*(declined|offsetting))?(?:(?:,\s*(enforced at|placed at)\s*({SPOT}))|(?:,\s*(enforced between downs)))?(?:,\s*(declined|offsetting))?(?:\s*-\s*No Play)?(?=\.|$)"
RECOVERY = rf"(?:RECOVERED|recovered) by ([A-Z]{{2,3}})-\s*({NAME}) at ({SPOT})"
INJURY = r"(?i)\*\* Injury Update:\s*([A-Z]{2,3})-((?:[A-Z]\.){1,2}[A-Z][A-Za-z'-]*)\s+(.+?)(?=(?:\s+(?:PENALTY|Penalty) on\b)|(?:\s+\b(?:P|R|X)\d+\b)|$)"
CHALLENGE, OFFICIAL = r"(?i)\b([A-Z][A-Za-z]+) challenged the (.+?) ruling", r"(?i)The Replay Official reviewed the (.+?) ruling"
SCORE = r"(?i)\b[A-Z]{2,3} (\d+) [A-Z]{2,3} (\d+),\s*(\d+) plays?,\s*(-?\d+) yards?,(?:\s*(\d+) penalt(?:y|ies),)?\s*(\d+:\d+) drive(?:\s*,\s*(\d+:\d+) elapsed)?"
BLOCK, TIMEOUT_NUMBER = rf"(?i)\bis BLOCKED \(({NAME})\)", r"(?i)Timeout #?(\d+)"
#: (type, priority, a part that any match holds in lower case, pattern)
SPANS = (
    ("action", 1, "", rf"(?i:\bHandoff to ){NAME}|(?:{FORMED})?{NAME}"),
    ("touchdown", 2, "touchdown", r"(?i)\bTOUCHDOWN(?! NULLIFIED)"),
    ("fumble", 2, "fumbles", rf"(?i)FUMBLES(?: \((?:{NAME}|Aborted)\))?"),
    ("recovery", 2, "recovered", RECOVERY),
    ("block", 2, "blocked", BLOCK),
    ("defense", 4, "", r"\([^)]+\)|\[[^\]]+\]"),
    ("penalty", 5, "penalty on", PENALTY),
    ("review", 6, "challenged the", CHALLENGE),
    ("review", 6, "replay official", OFFICIAL),
    ("review-result", 7, "the play was", r"(?i)(?:and\s+)?the play was (?:REVERSED|Upheld|confirmed)"),
    ("review-result", 7, "field stands", r"(?i)The ruling on the field stands\.?"),
    ("timeout", 8, "timeout", r"(?i)\(?Timeout #?(\d+)?(?: by ([A-Z]{2,3}))?\.?\)?"),
    ("injury-update", 9, "injury update", INJURY),
    ("drive-summary", 11, " drive", SCORE),
    ("official-marker", 12, "", r"\b(?:P|R|X)\d+\b"),
    ("kick-crew", 13, "holder-", rf"(?i)Center-({NAME}),\s*Holder-({NAME})"),
    ("administrative", 14, "runoff", r"(?i)\b10-second runoff\.?"),
    ("administrative", 14, "incomplete pass by", rf"(?i)Incomplete Pass by (?:\d+-)?({NAME}) after Blocked Kick Recovery\.?"),
)
CHANGE, RAW, END = 3, 99, "end"
FRAME = "\u0001"
#: A type outside of this list has no provisional or final form.
RULED = ("action", "possession-change", "block", "touchdown", "fumble", "recovery", "penalty", "defense", "official-marker", "raw")
ROLE = {"rush": "rusher", "scramble": "rusher", "kneel": "rusher", "advance": "rusher", "return": "returner", "pass": "passer", "sack": "passer", "field-goal": "kicker", "extra-point": "kicker", "kickoff": "kicker", "punt": "punter"}
FIELDS = ("actor", "target", "depth", "direction", "boundary", "end_position", "number", "other")


def group(text: str, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def one_pattern() -> tuple[str, str]:
    """A pattern of all grammar rows, tried in their order at a text's start, and what to replace the text by.

    That is, framed: each row's match, of which one is not empty, then the values of FIELDS; a row that doesn't fit leaves
    its groups empty.  A text that no row fits stays as it is.
    """
    rows, matches, values, groups = [], [], {f: "" for f in FIELDS}, 0
    for _, _, pattern, fields in GRAMMAR:
        rows.append(f"({pattern})")
        matches.append(f"${groups + 1}")
        for f, k in fields.items():
            values[f] += f"${groups + 1 + k}"
        groups += 1 + re.compile(pattern).groups
    return rf"(?i)^(?:{'|'.join(rows)})[\s\S]*$", FRAME + FRAME.join([*matches, *values.values()])


def action_of(parts: str) -> Column:
    """The struct of the first grammar row that fits, from a text framed by ``one_pattern``; fields are null for none."""
    match = [F.get(parts, F.lit(i + 1)) for i in range(len(GRAMMAR))]
    first = lambda values: F.coalesce(*[F.when(m != "", F.lit(v)) for m, v in zip(match, values) if v is not None])
    values = [F.nullif(F.get(parts, F.lit(len(GRAMMAR) + 1 + i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS)]
    return F.struct(first([g[0] for g in GRAMMAR]).alias("action_type"), first([g[1] for g in GRAMMAR]).alias("rule"), F.nullif(F.concat(*match), F.lit("")).alias("text"), *values)


def find_all(plays: DataFrame) -> DataFrame:
    """(game_id, play_index, possession, defence, description, type, priority, start, stop, text): every span of every pattern, and an "end" where the text ends.

    A pattern runs once over a text: its matches are framed by two signs that no report has, and the text is cut at those.
    """
    one = lambda kind, priority, hint, p: F.when(
        F.col("lower").contains(hint),
        F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.split(F.regexp_replace("description", p, f"{FRAME}$0{FRAME}"), FRAME, -1).alias("parts")),
    )
    end = F.when(F.col("lower").isNotNull(), F.struct(F.lit(END).alias("type"), F.lit(0).alias("priority"), F.array(F.col("description"), F.lit(""), F.lit("")).alias("parts")))
    base = plays.select(*KEYS, "possession", "defence", F.translate(F.trim(F.regexp_replace("description", r"\s+", " ")), FRAME, "").alias("description"))
    kinds = base.withColumn("lower", F.lower("description")).select(*base.columns, F.explode(F.array_compact(F.array(*[one(*s) for s in SPANS], end))).alias("s")).select(*base.columns, "s.*").filter(F.size("parts") > 1)
    # Every second part is a match; what comes before it gives its place.
    each = kinds.select(*base.columns, "type", "priority", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))).alias("k")).withColumn("text", F.get("parts", F.col("k")))
    start = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""))
    return each.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text")).drop("parts", "k")


def with_actions(spans: DataFrame) -> DataFrame:
    """Candidates become actions with their end and fields, or go; an action inside an earlier one goes."""
    is_action = F.col("type") == "action"
    pattern, framed = one_pattern()
    d = spans.withColumn("lead", F.when(is_action, F.length(F.regexp_extract("text", f"^{FORMED}", 0))).otherwise(0))
    rest = F.substring(F.col("description"), F.col("start") + F.col("lead") + 1, F.length("description"))
    d = d.withColumn("parts", F.when(is_action, F.split(F.regexp_replace(rest, pattern, framed), FRAME, -1))).withColumn("a", action_of("parts"))
    # A candidate that is no action has no end, so it covers nothing; it goes with the covered ones.
    stop = F.when(is_action, F.col("start") + F.col("lead") + F.length("a.text")).otherwise(F.col("stop"))
    d = d.withColumn("stop", stop).withColumn("formation", F.when(F.col("lead") > 0, F.initcap(F.regexp_extract("text", r"\(([^)]*)\)", 1))))
    earlier = Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("covered", F.max(F.when(is_action, F.col("stop"))).over(earlier)).filter(~is_action | (F.col("stop") > F.coalesce("covered", F.lit(-1))))
    words = F.substring(F.col("description"), F.col("start") + 1, F.col("stop") - F.col("start"))
    d = d.withColumn("text", words).withColumn("gain", F.when(is_action, F.when(F.col("text").rlike("(?i)for no gain"), 0).otherwise(group("text", r"(?i)for (-?\d+) yards?", 1).try_cast("int"))))
    gain = F.col("gain")
    kick = lookup({"GOOD": "good", "BLOCKED": "blocked", "NO GOOD": "no-good"}, F.upper("a.other"))
    touchdown = F.col("text").rlike("(?i)TOUCHDOWN") & ~F.col("text").rlike("(?i)NULLIFIED")
    moved = F.when(touchdown, "touchdown").when(gain < 0, "loss").when(gain == 0, "no-gain").when(gain > 0, "gain")
    rule = F.col("a.rule")
    catch = F.substring(F.col("description"), F.col("start") + 1, F.col("stop") - F.col("start") + 100).rlike("(?i)fair catch")
    outcome = F.when(rule == "complete", F.when(touchdown, "touchdown").otherwise("complete")).when(rule == "kick", kick).when(rule == "punt", F.when(catch, "fair-catch")).when(rule.isNull(), moved).when(rule != "kickoff", rule)
    spot = F.when(F.lower("a.end_position") != "end zone", F.col("a.end_position"))
    return d.select(
        *KEYS, "possession", "defence", "description", "type", "priority", "start", "stop", "text", "formation",
        F.col("a.action_type").alias("action_type"), F.when(is_action, outcome).alias("outcome"), F.col("a.actor").alias("actor"), F.col("a.target").alias("target"),
        F.lower("a.depth").alias("depth"), F.lower("a.direction").alias("direction"), F.when(F.col("a.boundary").isNotNull(), "out-of-bounds").alias("boundary"),
        F.when(is_action, spot).alias("end_position"), F.when(is_action & ~rule.eqNullSafe("incomplete"), F.coalesce(F.col("a.number").try_cast("int"), F.when(~rule.eqNullSafe("interception"), gain))).alias("yards"),
        F.when(rule == "interception", F.col("a.other")).alias("interceptor"),
    )


def with_changes(actions: DataFrame) -> DataFrame:
    """Adds possession changes (after interceptions, punts, kickoffs, recoveries by the other team), and each action's team.

    An action belongs to the team of the latest change at or before its start, else to the offence; an
    advance after a change or a punt is a return.  ``location`` and ``result`` are those of the event.
    """
    recovered = F.when(F.col("type") == "recovery", norm_team_code(group("text", RECOVERY, 1)))
    parens = F.col("text").startswith("(")
    skipped = (F.col("type") == "defense") & parens & (F.col("text").rlike(f"^{FORMED}$") | F.col("text").rlike(r"(?i)^\((?:Timeout|Aborted\))") | F.substring(F.col("description"), F.greatest(F.col("start") - 15, F.lit(1)), F.least(F.lit(16), F.col("start"))).rlike(r"(?i)is BLOCKED\s*$") | ~F.col("text").rlike(NAME))
    d = actions.filter(~skipped).withColumn("recovered_by", recovered).withColumn("recovered_at", F.when(F.col("type") == "recovery", group("text", RECOVERY, 3)))
    turns = F.when(F.col("interceptor").isNotNull(), "interception").when(F.col("action_type").isin("punt", "kickoff"), F.col("action_type")).when(F.col("recovered_by").isNotNull() & (F.col("recovered_by") != F.col("possession")), "recovery")
    twice = d.withColumn("change", turns).select("*", F.explode(F.when(turns.isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("is_change"))
    c = F.col("is_change")
    gone = [F.when(~c, F.col(x)).alias(x) for x in ("formation", "action_type", "outcome", "actor", "target", "depth", "direction", "boundary", "end_position", "yards", "interceptor")]
    d = twice.select(
        *KEYS, "possession", "defence", "description", F.when(c, "possession-change").otherwise(F.col("type")).alias("type"), F.when(c, CHANGE).otherwise(F.col("priority")).alias("priority"),
        F.when(c, F.col("stop")).otherwise(F.col("start")).alias("start"), "stop", F.when(c, "").otherwise(F.col("text")).alias("text"), *gone,
        F.when(c & (F.col("change") != "recovery"), F.col("defence")).otherwise(F.col("recovered_by")).alias("event_team"),
        F.coalesce("recovered_at", F.when(c, F.col("end_position"))).alias("location"), F.when(c, F.col("change")).alias("result"),
    )
    reading = Window.partitionBy(*KEYS).orderBy("start", F.when(F.col("type") == "possession-change", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("control", F.last(F.when((F.col("type") == "possession-change") & F.col("event_team").isNotNull(), F.struct("event_team", "location", "result")), ignorenulls=True).over(reading))
    is_action = F.col("type") == "action"
    team = F.when(is_action, F.coalesce("control.event_team", "possession"))
    returned = (F.col("action_type") == "advance") & ((team != F.col("possession")) | (F.col("control.result") == "punt"))
    return d.withColumn("start_position", F.when(F.col("action_type") == "advance", F.col("control.location"))).withColumn("team_id", F.coalesce(team, "event_team")).withColumn("action_type", F.when(returned, "return").otherwise(F.col("action_type"))).drop("control", "event_team")


def with_gaps(events: DataFrame) -> DataFrame:
    """Adds raw rows: text that no span covers and that is more than punctuation or a stop word.

    The closing row of each play, at the text's end, makes the last gap and goes; a play without spans is one gap.
    """
    before = Window.partitionBy(*KEYS).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    d = events.withColumn("covered", F.coalesce(F.max("stop").over(before), F.lit(0)))
    d = d.withColumn("gap", F.when(F.col("covered") < F.col("start"), F.trim(F.substring(F.col("description"), F.col("covered") + 1, F.col("start") - F.col("covered")))))
    cleaned = F.trim(F.regexp_replace("gap", r"^[\s,.;:*-]+|[\s,.;:*-]+$", ""))
    d = d.withColumn("means", F.coalesce(~cleaned.rlike("(?i)^(?:and|the|at|to|for)?$"), F.lit(False)))
    both = [F.when(F.col("type") != END, F.lit(False)), F.when(F.col("means"), F.lit(True))]
    d = d.select("*", F.explode(F.array_compact(F.array(*both))).alias("is_raw"))
    own = {"type": F.lit("raw"), "priority": F.lit(RAW), "start": F.col("covered"), "stop": F.col("start"), "text": F.regexp_replace("gap", r"^[,.;:\s-]+", "")}
    kept = (*KEYS, "possession", "defence", "description")
    return d.select(*[F.col(c) if c in kept else F.when(~F.col("is_raw"), F.col(c)).otherwise(own[c] if c in own else F.lit(None)).alias(c) for c in events.columns])


def play_sequence(plays: DataFrame) -> DataFrame:
    """All events of all plays (plays need possession and defence), in order: by start, priority, end.  Rulings before a reversal are provisional."""
    d = with_gaps(with_changes(with_actions(find_all(plays))))
    play = Window.partitionBy(*KEYS)
    order = play.orderBy("start", "priority", "stop", "text")
    reversed_at = F.min(F.when((F.col("type") == "review-result") & F.col("text").rlike("(?i)reversed"), F.col("start"))).over(play)
    ruled = reversed_at.isNotNull() & F.col("type").isin(*RULED)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns(
        {
            "event_order": F.row_number().over(order) - 1,
            "ruling": F.when(~ruled, "official").when(F.col("start") < reversed_at, "provisional").otherwise("final"),
            "before": F.last(F.when(F.col("type") == "action", F.struct("action_type", "outcome", "actor", "target", "team_id")), ignorenulls=True).over(before),
        }
    )
    forced = F.substring(F.col("description"), F.greatest(F.col("start") - 17, F.lit(1)), F.least(F.lit(18), F.col("start"))).rlike(r"(?i)FUMBLES?\s*$")
    role = F.when(F.col("text").startswith("["), "qb-hit").when(forced, "forced-fumble").when(F.col("before.action_type") == "sack", "sacker").when(F.col("before.outcome") == "incomplete", "defender").otherwise("tackler")
    verdict = F.lower(F.coalesce(group("text", "(?i)(reversed|upheld|confirmed|stands)", 1)))
    result = F.when(F.col("type") == "defense", role).when(F.col("type") == "review-result", verdict).when(F.col("type") == "timeout", group("text", r"(?i) by ([A-Z]{2,3})", 1)).otherwise(F.col("result"))
    kind = F.when(F.col("type") == "action", F.col("action_type")).otherwise(F.col("before.action_type"))
    phase = F.when(F.col("type").isin("review", "review-result", "timeout", "injury-update", "official-marker", "administrative", "raw"), "administrative").when((F.col("type") == "drive-summary") | (kind == "extra-point"), "try").when((kind == "kickoff") | ((F.col("type") == "penalty") & F.col("text").rlike("(?i)on [^,]*, *[^,.]*kickoff")), "kickoff").otherwise("scrimmage")
    scorer = F.when(F.col("type") == "touchdown", F.coalesce("before.team_id", "possession"))
    return d.withColumn("result", result).withColumn("phase", phase).withColumn("team_id", F.coalesce(scorer, "team_id")).drop("before")


def participants(sequence: DataFrame) -> DataFrame:
    """(game_id, play_index, name, role, source, team_id, first_place): distinct by name, role and source."""
    one = lambda name, role, source, team: F.struct(name.alias("name"), role.alias("role"), F.lit(source).alias("source"), team.alias("team_id"))
    t, text, c, lit = F.col("type"), "text", F.col, F.lit
    every = lambda role, source: F.transform(F.regexp_extract_all("text", lit(NAME), lit(0)), lambda n: one(n, role, source, c("defence")))
    caught = F.when(c("outcome").isin("complete", "touchdown"), "receiver").otherwise("target")
    lists = (
        F.when(t == "action", F.array(one(c("actor"), lookup(ROLE, c("action_type")), "main", c("team_id")), one(F.when(c("action_type") == "pass", c("target")), caught, "main", c("team_id")), one(c("interceptor"), lit("interceptor"), "main", c("defence"))))
        .when(t == "block", every(lit("blocker"), "parenthetical"))
        .when((t == "defense") & c(text).startswith("["), every(lit("qb-hit"), "bracket"))
        .when(t == "defense", every(c("result"), "parenthetical"))
        .when(t == "recovery", F.array(one(group(text, RECOVERY, 2), lit("recovery"), "annotation", c("team_id"))))
        .when(t == "kick-crew", F.array(one(group(text, rf"(?i)Center-({NAME})", 1), lit("snapper"), "annotation", c("possession")), one(group(text, rf"(?i)Holder-({NAME})", 1), lit("holder"), "annotation", c("possession"))))
        .when(t == "penalty", F.array(one(group(text, PENALTY, 2), lit("penalized"), "penalty", norm_team_code(F.upper(group(text, PENALTY, 1))))))
        .when(t == "injury-update", F.array(one(group(text, INJURY, 2), lit("other"), "annotation", norm_team_code(F.upper(group(text, INJURY, 1))))))
        .when((t == "raw") & c(text).rlike("(?i)fair catch by"), F.array(one(group(text, rf"(?i)fair catch by ({NAME})", 1), lit("returner"), "annotation", c("defence"))))
    )
    rows = sequence.select(*KEYS, "event_order", F.posexplode(lists).alias("place", "p")).select(*KEYS, F.struct("event_order", "place").alias("place"), "p.*").filter("name is not null and role is not null")
    return rows.groupBy(*KEYS, "name", "role", "source").agg(F.min_by("team_id", "place").alias("team_id"), F.min("place").alias("first_place"))


def merged_penalties(sequence: DataFrame) -> DataFrame:
    """One row for each penalty, with its occurrences: a restatement after a reversal joins the first row of its key."""
    fields = {"team_id": norm_team_code(F.upper(group("text", PENALTY, 1))), "player": group("text", PENALTY, 2), "penalty_type": F.trim(group("text", PENALTY, 3)), "yards": group("text", PENALTY, 4).try_cast("int"), "spot": group("text", PENALTY, 7)}
    p = sequence.filter("type = 'penalty'").select(*KEYS, "event_order", "ruling", "phase", "text", *[v.alias(k) for k, v in fields.items()])
    disposition = F.lower(F.coalesce(group("text", PENALTY, 5), group("text", PENALTY, 9)))
    enforcement = F.when(group("text", PENALTY, 8).isNotNull(), "between-downs").when(F.lower(group("text", PENALTY, 6)) == "placed at", "placed").when(group("text", PENALTY, 6).isNotNull(), "enforced")
    p = p.withColumn("enforcement", enforcement).withColumn("status", F.coalesce(disposition, F.when(F.col("yards").isNotNull() | F.col("enforcement").isNotNull(), "accepted").otherwise("unknown"))).withColumn("no_play", F.col("text").rlike("(?i)No Play"))
    key = Window.partitionBy(*KEYS, *[F.lower(c) if c == "penalty_type" else F.col(c) for c in (*fields, "enforcement", "status", "no_play")])
    crosses = (F.col("ruling") == "final") & (F.first("ruling").over(key.orderBy("event_order")) == "provisional")
    p = p.withColumn("again", crosses).withColumn("restated", F.sum(F.when(crosses, 1).otherwise(0)).over(key)).withColumn("first_of_key", F.row_number().over(key.orderBy("event_order")) == 1)
    return p.filter(~F.col("again")).select(*KEYS, "event_order", *fields, "enforcement", "status", "no_play", "phase", (1 + F.when(F.col("first_of_key"), F.col("restated")).otherwise(0)).cast("long").alias("occurrences"))


def reviews(sequence: DataFrame) -> DataFrame:
    """Team challenges and official reviews; results go to the play's last review in list order (challenges come first).

    A numbered timeout belongs to the last review in list order that stands before it in the text; of several the last counts.
    """
    r = sequence.filter("type = 'review'").withColumn("source", F.when(F.col("text").rlike(CHALLENGE), "team-challenge").otherwise("replay-official"))
    r = r.select(*KEYS, "event_order", "start", "source", group("text", CHALLENGE, 1).alias("team_name"), F.coalesce(group("text", CHALLENGE, 2), group("text", OFFICIAL, 1)).alias("subject"))
    results = sequence.filter("type = 'review-result'").groupBy(*KEYS).agg(F.max_by(F.when(F.col("result") != "stands", F.col("result")), F.when(F.col("result") != "stands", F.col("event_order"))).alias("last_result"), F.bool_or(F.col("result") == "stands").alias("stood"))
    place = F.struct(F.col("source") == "replay-official", "event_order")
    numbered = sequence.filter("type = 'timeout'").select(*KEYS, F.col("start").alias("at"), group("text", TIMEOUT_NUMBER, 1).try_cast("int").alias("number")).filter("number is not null")
    whose = r.join(numbered, KEYS).filter(F.col("start") < F.col("at")).groupBy(*KEYS, "at", "number").agg(F.max_by("event_order", place).alias("event_order"))
    numbers = whose.groupBy(*KEYS, "event_order").agg(F.max_by("number", "at").alias("timeout_number"))
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.col("source") == "replay-official"), F.desc("event_order"))) == 1
    d = r.join(results, KEYS, "left").withColumn("is_last", last).join(numbers, [*KEYS, "event_order"], "left")
    return d.select(*KEYS, "event_order", "source", "team_name", "subject", F.when(F.col("is_last"), F.col("last_result")).alias("result"), F.when(F.col("is_last") & F.col("stood"), "stands").alias("ruling"), "timeout_number")


def play_events(sequence: DataFrame) -> DataFrame:
    """(game_id, play_index, event_type, actor, team_id, location, result): interceptions, blocks, touchdowns, fumbles, recoveries and the
    changes they bring, reviews' results and injuries.

    A fumble and a touchdown name no one themselves: theirs is the latest action at or before them, a fumble's its actor, a touchdown's
    its target if it has one.  A blocked kick is a field goal if those words stand just before.
    """
    near = F.last(F.when(F.col("type") == "action", F.struct("actor", "target")), ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("start"))
    d = sequence.withColumn("near", near)
    none = F.lit(None).cast("string")

    def event(on: Column, kind: str, actor: Column = none, team: Column = none, location: Column = none, result: Column = none) -> Column:
        return F.when(on, F.struct(F.lit(kind).alias("event_type"), actor.alias("actor"), team.alias("team_id"), location.alias("location"), result.alias("result")))

    is_ = lambda t: F.col("type") == t
    whose, who, where = norm_team_code(F.upper(group("text", RECOVERY, 1))), group("text", RECOVERY, 2), group("text", RECOVERY, 3)
    before = F.substring(F.col("description"), F.greatest(F.col("start") - 23, F.lit(1)), F.least(F.lit(24), F.col("start")))
    rows = F.array_compact(
        F.array(
            event(is_("action") & F.col("interceptor").isNotNull(), "interception", F.col("interceptor"), F.col("defence"), F.col("end_position")),
            event(is_("block"), "block", group("text", BLOCK, 1), F.col("defence"), result=F.when(before.rlike("(?i)field goal"), "field-goal").otherwise("kick")),
            event(is_("touchdown"), "touchdown", F.coalesce("near.target", "near.actor"), F.col("possession")),
            event(is_("fumble"), "fumble", F.coalesce("near.actor", "near.target"), F.col("possession")),
            event(is_("recovery"), "recovery", who, whose, where),
            event(is_("recovery") & (whose != F.col("possession")), "possession-change", who, whose, where, F.lit("recovery")),
            event(is_("review-result") & (F.col("result") != "stands"), "replay", result=F.col("result")),
            event(is_("injury-update"), "injury", group("text", INJURY, 2), norm_team_code(F.upper(group("text", INJURY, 1))), result=F.trim(F.regexp_replace(group("text", INJURY, 3), r"[.]$", ""))),
        )
    )
    return d.select(*KEYS, F.explode(rows).alias("e")).select(*KEYS, "e.*")


def injury_updates(sequence: DataFrame) -> DataFrame:
    status = F.regexp_replace(group("text", INJURY, 3), r"[.]$", "")
    code = F.when(status.rlike("(?i)return is Questionable"), "Return Questionable").when(status.rlike("(?i)is Out of the game"), "Out").when(status.rlike("(?i)has returned to the game"), "Returned").otherwise(status)
    return sequence.filter("type = 'injury-update'").select(*KEYS, norm_team_code(F.upper(group("text", INJURY, 1))).alias("team_id"), group("text", INJURY, 2).alias("player"), F.trim(status).alias("status"), code.alias("code"))


def scoring_details(sequence: DataFrame) -> DataFrame:
    """Extra point and drive summary of each play that has one."""
    extra, drive = (F.col("type") == "action") & (F.col("action_type") == "extra-point"), F.col("type") == "drive-summary"
    names = (("visitor_score", 1), ("home_score", 2), ("drive_plays", 3), ("drive_yards", 4), ("drive_penalties", 5))
    return sequence.filter(extra | drive).groupBy(*KEYS).agg(
        F.min_by(F.when(extra, F.col("actor")), F.when(extra, F.col("event_order"))).alias("kicker"), F.min_by(F.when(extra, F.col("outcome")), F.when(extra, F.col("event_order"))).alias("extra_point"),
        *[F.first(F.when(drive, group("text", SCORE, k).try_cast("int")), ignorenulls=True).alias(n) for n, k in names],
        F.first(F.when(drive, group("text", SCORE, 6)), ignorenulls=True).alias("possession_time"), F.first(F.when(drive, group("text", SCORE, 7)), ignorenulls=True).alias("elapsed"),
    )


def play_summary(sequence: DataFrame, penalties: DataFrame) -> DataFrame:
    """One row a play: official action and end, turnovers, possession change, parse status, kind of picture, result."""
    t, order = F.col("type"), F.col("event_order")
    act = F.struct("action_type", "outcome", "actor", "target", "end_position", "yards", "team_id")
    pick = lambda value, cond: F.max_by(F.when(cond, value), F.when(cond, order))
    is_action = t == "action"
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    s = sequence.groupBy(*KEYS, "possession").agg(
        F.coalesce(pick(act, is_action & (F.col("ruling") != "provisional")), pick(act, is_action)).alias("official"),
        pick(F.struct("team_id", "location"), t == "recovery").alias("recovery"), pick(F.struct("team_id", "location", "result"), t == "possession-change").alias("change"),
        pick(F.struct("actor", "yards", "outcome"), F.col("action_type") == "return").alias("returned"), has(F.col("interceptor").isNotNull()).alias("intercepted"), has(t == "fumble").alias("fumbled"), has(t == "touchdown").alias("touchdown"),
        has((F.col("action_type") == "field-goal") & (F.col("outcome") == "blocked")).alias("blocked"), has(F.col("action_type") == "punt").alias("punted"), F.count("*").alias("events"), F.count_if(is_action).alias("actions"), F.count_if(t == "raw").alias("raw_parts"),
        has(~t.isin("raw", "official-marker")).alias("structured"), has(t == "review").alias("reviewed"),
        has(t == "penalty").alias("penalized"), F.min_by(F.when(t == "timeout", F.struct(F.col("result"))), F.when(t == "timeout", order)).alias("timeout"),
    )
    enforced = penalties.filter("status = 'accepted' and spot is not null").groupBy(*KEYS).agg(F.max_by("spot", "event_order").alias("enforced_at"))
    s = s.join(enforced, KEYS, "left")
    a, o = F.col("official.action_type"), F.col("official.outcome")
    # a play without an action is what else it has
    instead = F.when(F.col("penalized"), "penalty").when(F.col("reviewed"), "replay").when(F.col("timeout").isNotNull(), "timeout").otherwise("other")
    lost = F.col("fumbled") & F.coalesce(F.col("recovery.team_id") != F.col("possession"), F.lit(False))
    picture = (
        F.when(F.col("blocked"), "blocked-field-goal").when(F.col("intercepted"), "pass-intercepted").when(F.col("punted"), "punt").when(a.isin("field-goal", "sack"), a)
        .when(a == "pass", F.when(o == "incomplete", "pass-incomplete").otherwise("pass-complete")).when(a.isin("rush", "scramble", "kneel", "advance", "return"), "run")
        .when(F.col("touchdown"), "touchdown").otherwise("other")
    )
    return s.select(
        *KEYS, "possession", F.coalesce(a, instead).alias("official_action"), o.alias("official_outcome"), F.when(a.isNull(), F.col("timeout.result")).otherwise(F.col("official.actor")).alias("official_actor"), F.col("official.yards").alias("official_yards"), F.col("official.team_id").alias("official_team"),
        F.coalesce("enforced_at", "official.end_position", "recovery.location").alias("official_end"), F.when(F.col("intercepted"), "INTERCEPTION").when(lost, "FUMBLE LOST").alias("turnover_label"),
        F.col("change.team_id").alias("changed_to"), F.col("change.location").alias("changed_at"), F.col("change.result").alias("changed_by"), F.col("returned.actor").alias("returner"), F.col("returned.yards").alias("return_yards"),
        picture.alias("visualization"), "touchdown", "reviewed", "events", "actions", "raw_parts", F.when(~F.col("structured"), "raw").when(F.col("raw_parts") > 0, "partial").otherwise("structured").alias("parse_status"),
    )


def spots(sequence: DataFrame, penalties: DataFrame, plays: DataFrame, summary: DataFrame) -> DataFrame:
    """(game_id, play_index, kind, position, place): start, action-end, interception, recovery, enforcement and official-final."""
    t, end = F.col("type"), F.col("end_position")
    moved = sequence.filter((t == "action") & end.isNotNull()).select(*KEYS, F.when(F.col("outcome") == "interception", "interception").otherwise("action-end").alias("kind"), end.alias("position"), F.col("event_order").cast("int").alias("place"))
    recovered = sequence.filter((t == "recovery") & F.col("location").isNotNull()).select(*KEYS, F.lit("recovery").alias("kind"), F.col("location").alias("position"), F.col("event_order").cast("int").alias("place"))
    enforced = penalties.filter("spot is not null").select(*KEYS, F.lit("enforcement").alias("kind"), F.col("spot").alias("position"), F.col("event_order").cast("int").alias("place"))
    # game_id is named anew so that the union lies by game where its parts do.
    start = plays.select(F.col("game_id").alias("game_id"), "play_index", F.lit("start").alias("kind"), F.col("yard_line").alias("position"), F.lit(-1).alias("place"))
    final = summary.filter("official_end is not null").select(*KEYS, F.lit("official-final").alias("kind"), F.col("official_end").alias("position"), F.col("events").cast("int").alias("place"))
    return start.unionByName(moved).unionByName(recovered).unionByName(enforced).unionByName(final)


ADMIN = ("timeout", "administrative", "official-marker", "drive-summary", "kick-crew")


def admin_events(sequence: DataFrame) -> DataFrame:
    """(game_id, play_index, event_order, type, result, text): timeouts, runoffs, markers, drive summaries and kicking crews."""
    return sequence.filter(F.col("type").isin(*ADMIN)).select(*KEYS, "event_order", "type", "result", "text")
