"""What a play looks like on the field: its mode, its result in words, and the phases of a touchdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.spots import absolute_yard, attack_direction, field_percent

KEYS = ["game_id", "play_index"]
ACTION = ("event_order", "action_type", "outcome", "actor", "yards", "end_position", "team_id")
RUNS = ("rush", "scramble", "kneel", "advance", "return")
SAME_PERCENT = 0.1


def with_actions(sequence: DataFrame) -> DataFrame:
    """One row a play: its actions in order, and what else happened in it."""
    t, order = F.col("type"), F.col("event_order")
    last = lambda value, on: F.max_by(F.when(on, value), F.when(on, order))
    has = lambda on: F.coalesce(F.bool_or(on), F.lit(False))
    return sequence.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(t == "action", F.struct(*ACTION)))).alias("a"),
        last(F.struct("team_id", "location"), t == "recovery").alias("recovery"),
        has(F.col("interceptor").isNotNull()).alias("intercepted"),
        has(t == "touchdown").alias("touchdown_event"),
        has(t.isin("fumble", "recovery", "review", "review-result") | F.col("interceptor").isNotNull()).alias("unsettled"),
    )


def first(on) -> Column:
    return F.get(F.filter("a", on), 0)


def visualization(action: str, blocked: Column, intercepted: Column, touchdown: Column) -> Column:
    """The picture of the action that is shown."""
    kind, outcome = F.col(f"{action}.action_type"), F.col(f"{action}.outcome")
    return (
        F.when(blocked, "blocked-field-goal")
        .when(intercepted, "pass-intercepted")
        .when(kind.isin("field-goal", "punt"), kind)
        .when(kind == "pass", F.when(outcome == "incomplete", "pass-incomplete").when(outcome == "interception", "pass-intercepted").otherwise("pass-complete"))
        .when(kind.isin(*RUNS), "run")
        .when(kind == "sack", "sack")
        .when(touchdown | (outcome == "touchdown"), "touchdown")
        .otherwise("other")
    )


def yard_label(yards: Column) -> Column:
    n = yards.cast("string")
    return F.when(yards.isNull(), "RESULT NOT ESTIMATED").when(yards == 0, "NO GAIN · 0 YARDS").otherwise(F.concat(F.when(yards > 0, F.lit("+")).otherwise(F.lit("")), n, F.lit(" YARDS")))


def result_presentation() -> dict[str, Column]:
    """result_label, result_detail and result_state, the first rule that fits; from the columns of replay_view."""
    c, lit = F.col, F.lit
    n = lambda x: c(x).cast("string")
    returned = F.when(c("returned.yards").isNull(), c("returned.actor")).otherwise(F.concat(n("returned.yards"), lit(" YARDS · "), c("returned.actor")))
    blocked, move, scored = c("blocked").isNotNull(), c("shown_movement"), c("returned.outcome") == "touchdown"
    incomplete = c("shown.outcome") == "incomplete"
    moved = (move != 0) & move.isNotNull()
    rules = [
        (blocked & scored, "BLOCKED FG RETURN · TOUCHDOWN", returned, "touchdown"),
        (blocked & c("returned.yards").isNotNull(), F.concat(lit("BLOCKED FG RETURN · "), n("returned.yards"), lit(" YARDS")), c("returned.actor"), "turnover"),
        (blocked & c("recovery.team_id").isNotNull(), F.concat(lit("BLOCKED FG · RECOVERED BY "), c("recovery.team_id")), c("recovery.location"), F.when(c("recovery.team_id") == c("possession"), "neutral").otherwise("turnover")),
        (blocked, "BLOCKED FIELD GOAL", F.concat(n("blocked.yards"), lit(" YARD ATTEMPT")), "field-goal-missed"),
        (c("intercepted") & scored, "INTERCEPTION RETURN · TOUCHDOWN", returned, "touchdown"),
        (c("intercepted") & (c("returned.yards") != 0), F.concat(lit("INTERCEPTION RETURN · "), n("returned.yards"), lit(" YARDS")), c("returned.actor"), "turnover"),
        (c("intercepted"), "INTERCEPTION", c("changed_at"), "turnover"),
        (c("turnover_label").isNotNull(), c("turnover_label"), F.when(move.isNotNull(), yard_label(move)), "turnover"),
        (c("is_touchdown") | (c("shown.outcome") == "touchdown"), "TOUCHDOWN", c("shown.actor"), "touchdown"),
        (c("mode") == "field-goal", F.when(c("goal.outcome") == "good", "FIELD GOAL · GOOD").otherwise("FIELD GOAL · MISSED"), F.concat(n("goal.yards"), lit(" YARDS")), F.when(c("goal.outcome") == "good", "field-goal-good").otherwise("field-goal-missed")),
        (incomplete, F.concat(lit("INCOMPLETE · "), F.when(moved, F.concat(F.when(move > 0, lit("+")).otherwise(lit("")), move.cast("string"))).otherwise(lit("0")), lit(" YARDS")), F.when(moved, "OFFICIAL BALL ADJUSTMENT"), F.when(move < 0, "negative").otherwise("incomplete")),
        (move.isNull(), yard_label(move), None, "unknown"),
        (move > 0, yard_label(move), "POSITIVE GAIN", "positive"),
        (move < 0, yard_label(move), "LOSS", "negative"),
        (lit(True), yard_label(lit(0)), "BALL DID NOT ADVANCE", "no-gain"),
    ]
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")

    def chosen(k: int) -> Column:
        out = None
        for rule in rules:
            out = F.when(rule[0], as_column(rule[k])) if out is None else out.when(rule[0], as_column(rule[k]))
        return out

    return {name: chosen(k) for k, name in enumerate(("result_label", "result_detail", "result_state"), start=1)}


def replay_view(sequence: DataFrame, penalties: DataFrame, summary: DataFrame, plays: DataFrame, teams: DataFrame) -> DataFrame:
    """One row a play: mode (touchdown, blocked-kick, field-goal, movement, no-movement, unknown), picture, final spot and
    percent, movement, where the final spot comes from, and the result in words.  ``plays`` carry the state after them.

    A play's next spot stands for its own end only where nothing moved the ball: no gain, no review, no further action or
    event, no penalty whose effect isn't known, and the same team in possession.
    """
    c = F.col
    unclear = penalties.groupBy(*KEYS).agg(F.lit(True).alias("penalized"), F.bool_or(c("status").isin("unknown", "offsetting") | c("no_play")).alias("unclear"))
    s = summary.select(*KEYS, F.struct(F.lit(None).cast("int").alias("event_order"), c("official_action").alias("action_type"), c("official_outcome").alias("outcome"), c("official_actor").alias("actor"), c("official_yards").alias("yards"), c("official_end").alias("end_position"), c("official_team").alias("team_id")).alias("official"), "official_end", "turnover_label", "changed_at", "changed_to", "reviewed")
    d = plays.select(*KEYS, "possession", "kind", "yard_line", "no_play", "next_yard_line", "next_possession").join(with_actions(sequence), KEYS).join(s, KEYS).join(unclear, KEYS, "left").join(teams, "game_id")
    yard = lambda spot: absolute_yard(spot, c("visitor_id"), c("home_id"))
    sign = lambda team: F.when(team == c("visitor_id"), 1).when(team == c("home_id"), -1)
    d = d.withColumns(
        {
            "punt": first(lambda x: x["action_type"] == "punt"),
            "scored": first(lambda x: x["outcome"] == "touchdown"),
            "goal": first(lambda x: x["action_type"] == "field-goal"),
            "blocked": first(lambda x: (x["action_type"] == "field-goal") & (x["outcome"] == "blocked")),
            "returned": F.try_element_at(F.filter("a", lambda x: x["action_type"] == "return"), F.lit(-1)),
            "thrown": first(lambda x: x["action_type"] == "pass"),
        }
    )
    d = d.withColumn("action", F.coalesce("punt", "official")).withColumn("pictured", F.coalesce("blocked", F.when(c("intercepted"), c("thrown")), "punt", "scored", "action"))
    is_td = c("scored").isNotNull() | (c("kind") == "touchdown")
    still = c("action.outcome").isin("incomplete", "no-gain") | (c("action.yards") == 0)
    settled = still & ~c("no_play") & ~c("reviewed") & (F.size("a") <= 1) & ~c("unsettled") & (c("next_possession") == c("possession"))
    after = F.when(settled & c("penalized").isNull() & (c("next_yard_line") == c("yard_line")), c("next_yard_line")).when(settled & c("penalized") & ~c("unclear"), c("next_yard_line"))
    d = d.withColumns({"is_touchdown": c("touchdown_event") | (c("kind") == "touchdown"), "after": after}).withColumn("spot", F.coalesce("after", "official_end"))
    start, end = yard(c("yard_line")), yard(c("spot"))
    same = F.coalesce(F.abs(field_percent(start) - field_percent(end)) <= SAME_PERCENT, F.lit(False))
    mode = F.when(is_td, "touchdown").when(c("blocked").isNotNull(), "blocked-kick").when(c("goal").isNotNull(), "field-goal").when(same, "no-movement").when(c("spot").isNotNull(), "movement").otherwise("unknown")
    d = d.withColumns({"mode": mode, "start_yard": start, "end_yard": end})
    toward = lambda team: F.when(sign(team) == 1, 100).otherwise(0)
    scoring_team = F.coalesce("scored.team_id", "possession")
    recovered = yard(F.coalesce("returned.end_position", "recovery.location"))
    moved = F.coalesce(c("returned.yards"), F.when(c("mode") == "no-movement", 0).otherwise((c("end_yard") - c("start_yard")) * sign(c("possession"))))
    by_mode = lambda td, blocked, goal, other: F.when(c("mode") == "touchdown", td).when(c("mode") == "blocked-kick", blocked).when(c("mode") == "field-goal", goal).otherwise(other)
    d = d.withColumns(
        {
            "visualization": visualization("pictured", c("blocked").isNotNull(), c("intercepted"), c("is_touchdown")),
            "final_position": by_mode(F.lit("END ZONE"), F.coalesce("returned.end_position", "recovery.location"), F.lit("UPRIGHTS"), c("spot")),
            "final_percent": F.round(field_percent(by_mode(toward(scoring_team), recovered, toward(c("possession")), c("end_yard"))), 4),
            "movement": by_mode(F.coalesce("returned.yards", "scored.yards"), F.coalesce("returned.yards", F.lit(0)), F.lit(None).cast("int"), moved).cast("int"),
            "final_source": by_mode(F.lit("touchdown"), F.when(c("returned.end_position").isNotNull(), "explicit").when(c("recovery.location").isNotNull(), "recovery").otherwise("unknown"), F.lit("kick-target"), F.when(c("after").isNotNull(), "state-after").when(c("spot").isNotNull(), "explicit").otherwise("unknown")),
            "shown": by_mode(F.coalesce("scored", "action"), c("goal"), c("goal"), c("action")),
            "shown_movement": by_mode(F.coalesce("returned.yards", "scored.yards"), c("returned.yards"), F.lit(None).cast("int"), moved).cast("int"),
        }
    )
    # a field that a percent can't be worked out for has none
    known = by_mode(F.lit(True), recovered.isNotNull(), F.lit(True), c("end_yard").isNotNull())
    d = d.withColumn("final_percent", F.when(known, c("final_percent"))).withColumns(result_presentation())
    return d.select(*KEYS, "mode", "visualization", "final_position", "final_percent", "movement", "final_source", "result_label", "result_detail", "result_state", (F.when(c("mode") == "blocked-kick", c("changed_to").isNotNull()).otherwise(c("turnover_label").isNotNull())).alias("turnover"))


def scoring_phases(sequence: DataFrame, penalties: DataFrame) -> DataFrame:
    """(game_id, play_index, phase_no, phase, label, result, position) of each play with a touchdown: scrimmage, try, kickoff."""
    c = F.col
    kick = F.struct(*[c(k) for k in ("event_order", "action_type", "outcome", "end_position")], F.col("text"))
    d = sequence.groupBy(*KEYS).agg(
        F.bool_or((c("type") == "touchdown") | (c("outcome") == "touchdown")).alias("scored"),
        F.min(F.when(c("action_type") == "extra-point", kick)).alias("extra"),
        F.min(F.when(c("action_type") == "kickoff", kick)).alias("kickoff"),
    ).filter("scored")
    foul = penalties.filter("phase = 'kickoff'").groupBy(*KEYS).agg(F.min_by(F.struct("penalty_type", "spot"), "event_order").alias("foul"))
    d = d.join(foul, KEYS, "left")
    phase = lambda name, label, result, position=F.lit(None).cast("string"): F.struct(F.lit(name).alias("phase"), F.lit(label).alias("label"), result.alias("result"), position.alias("position"))
    outside = (c("kickoff.outcome") == "out-of-bounds") | c("kickoff.text").rlike("(?i)out of bounds")
    kicked = F.coalesce(F.upper(F.regexp_replace("foul.penalty_type", r"(?i)^Kickoff\s+", "")), F.when(outside, "OUT OF BOUNDS").otherwise("KICKED"))
    rows = F.array_compact(
        F.array(
            phase("scrimmage", "SCRIMMAGE", F.lit("TOUCHDOWN")),
            F.when(c("extra").isNotNull(), phase("try", "XP", F.when(c("extra.outcome") == "good", "GOOD").otherwise("NO GOOD"))),
            F.when(c("kickoff").isNotNull() | c("foul").isNotNull(), phase("kickoff", "KICKOFF", kicked, F.coalesce("foul.spot", "kickoff.end_position"))),
        )
    )
    return d.select(*KEYS, F.posexplode(rows).alias("phase_no", "p")).select(*KEYS, "phase_no", "p.*")


def return_paths(sequence: DataFrame, teams: DataFrame) -> DataFrame:
    """(game_id, play_index, team_id, direction, yards, touchdown, path): the last return of each play that has one.

    ``path`` is an ordered array of kind, position and percent: where the ball changed hands, and where the return ended, which is the
    end zone that the team runs to after a touchdown.  A return without both places has no path.
    """
    order = F.col("event_order")
    pick = lambda value, on: F.max_by(F.when(on, value), F.when(on, order))
    changed = (F.col("type") == "possession-change") & F.col("team_id").isNotNull()
    d = sequence.groupBy(*KEYS).agg(pick(F.struct("team_id", "start_position", "end_position", "yards", "outcome"), F.col("action_type") == "return").alias("r"), pick(F.struct("team_id", "location"), changed).alias("change")).filter("r is not null").join(teams, "game_id")
    d = d.withColumn("team", F.coalesce("r.team_id", "change.team_id"))
    direction = attack_direction(F.col("team"), F.col("visitor_id"), F.col("home_id"))
    yard = lambda spot: absolute_yard(spot, F.col("visitor_id"), F.col("home_id"))
    touchdown = F.coalesce(F.col("r.outcome") == "touchdown", F.lit(False))
    goal = F.when(direction == "right", 100).when(direction == "left", 0)
    d = d.withColumns({"direction": direction, "touchdown": touchdown, "from_yard": yard(F.col("change.location")), "to_yard": F.coalesce(F.when(touchdown, goal), yard(F.col("r.end_position")))})
    place = lambda kind, position, at: F.struct(F.lit(kind).alias("kind"), position.alias("position"), F.round(field_percent(at), 4).alias("percent"))
    path = F.array(place("change", F.coalesce("r.start_position", "change.location"), F.col("from_yard")), place("end", F.when(F.col("touchdown"), "END ZONE").otherwise(F.col("r.end_position")), F.col("to_yard")))
    return d.filter("team is not null and from_yard is not null and to_yard is not null").select(*KEYS, F.col("team").alias("team_id"), "direction", F.col("r.yards").alias("yards"), "touchdown", path.alias("path"))
