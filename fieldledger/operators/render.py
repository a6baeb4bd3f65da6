"""Plays in words of another language: one section for each event, from templates and terms that are data.

``templates``: (language, key, template).  A key is an event's type, or ``action.<type>``, or ``action.<type>.<outcome>``; the
longest that the language has is used.  ``{actor}``, ``{target}``, ``{end}``, ``{yards}``, ``{team}``, ``{at}``, ``{result}`` and ``{text}``
stand for the event's values; a part in double brackets, ``[[to {end}]]``, is left out where its value is missing.
``terms``: (language, term, translation), for results, penalties and directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["game_id", "play_index"]
ORIGINAL = "en"
KINDS = {"defense": "defense", "fumble": "turnover", "recovery": "turnover", "block": "turnover", "possession-change": "turnover", "penalty": "penalty", "review": "review", "review-result": "review", "drive-summary": "scoring", "kick-crew": "scoring"}
DRIVE = r"(?i)([A-Z]{2,3}) (\d+) ([A-Z]{2,3}) (\d+),\s*(\d+) plays?,\s*(-?\d+) yards?,(?:\s*(\d+) penalt(?:y|ies),)?\s*(\d+:\d+) drive"


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its values; bracketed parts without theirs go."""
    out = template
    for name, value in values.items():
        marked = F.lit("{" + name + "}")
        out = F.when(value.isNull(), F.regexp_replace(out, r"\[\[[^\[\]]*\{" + name + r"\}[^\[\]]*\]\]", "")).otherwise(out)
        out = F.replace(out, marked, F.coalesce(value, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\[\[|\]\]", ""), r"\s+", " "))


def render_sections(sequence: DataFrame, plays: DataFrame, templates: DataFrame, terms: DataFrame, language: str) -> DataFrame:
    """(game_id, play_index, section_no, kind, text, raw) of every play.

    In the original language a play is its text.  In another, events without a template are left out, text that no rule has read
    stays as it is, and a play without any section is its original text.
    """
    original = plays.select(*KEYS, F.lit(0).alias("section_no"), F.lit("main").alias("kind"), F.col("description").alias("text"), F.lit(True).alias("raw"))
    if language == ORIGINAL:
        return original
    t = F.broadcast(templates.filter(F.col("language") == language).select("key", "template"))  # a dictionary of a few dozen rows
    words = F.broadcast(terms.filter(F.col("language") == language).select(F.lower("term").alias("term"), "translation"))
    kind = F.col("type")
    keys = F.when(kind == "action", F.array_compact(F.array(F.concat(F.lit("action."), F.col("action_type"), F.lit("."), F.col("outcome")), F.concat(F.lit("action."), F.col("action_type"))))).otherwise(F.array(kind))
    events = sequence.filter(kind != "official-marker").withColumn("term", F.lower(F.coalesce("result", "outcome")))
    tried = events.select(*KEYS, "event_order", F.posexplode(keys).alias("at", "key")).join(t, "key").groupBy(*KEYS, "event_order").agg(F.min_by("template", "at").alias("template"))
    d = events.join(tried, [*KEYS, "event_order"], "left").join(words, "term", "left")
    text = lambda c: F.col(c).cast("string")
    values = {"actor": F.col("actor"), "target": F.col("target"), "end": F.col("end_position"), "yards": text("yards"), "team": F.col("team_id"), "at": F.col("location"), "result": F.coalesce("translation", "result", "outcome"), "text": F.col("text")}
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    section = F.when(kind == "action", F.when(F.col("action_type").isin("extra-point", "field-goal"), "scoring").otherwise("main")).otherwise(F.coalesce(F.try_element_at(names, kind), F.lit("note")))
    shown = d.withColumn("said", F.when(kind == "raw", F.col("text")).when(F.col("template").isNotNull(), filled(F.col("template"), values))).filter("said is not null")
    sections = shown.select(*KEYS, F.col("event_order").cast("int").alias("section_no"), section.alias("kind"), F.col("said").alias("text"), (kind == "raw").alias("raw"))
    return sections.unionByName(original.join(sections.select(*KEYS).distinct(), KEYS, "left_anti"))


def render_description(sections: DataFrame) -> DataFrame:
    """(game_id, play_index, text): a play's sections in order, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("section_no", "text")))
    return sections.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))


def penalty_text(template: Column, translation: Column) -> Column:
    """A penalty's phrase from its columns: {who} (team and player), {what}, {yards}, {spot}, {status}."""
    who = F.nullif(F.concat_ws("-", "team_id", "player"), F.lit(""))
    what = F.when(translation.isNotNull(), F.concat(translation, F.lit(" ("), F.col("penalty_type"), F.lit(")"))).otherwise(F.col("penalty_type"))
    return filled(template, {"who": who, "what": what, "yards": F.col("yards").cast("string"), "spot": F.col("spot"), "status": F.col("status")})


def drive_text(text: Column, template: Column) -> Column:
    """A drive summary's phrase: {visitor}, {home} (code and score), {plays}, {yards}, {penalties}, {time}; else the text itself."""
    part = lambda k: F.nullif(F.regexp_extract(text, DRIVE, k), F.lit(""))
    values = {"visitor": F.concat(part(1), F.lit(" "), part(2)), "home": F.concat(part(3), F.lit(" "), part(4)), "plays": part(5), "yards": part(6), "penalties": part(7), "time": part(8)}
    return F.when(text.rlike(DRIVE), filled(template, values)).otherwise(text)
