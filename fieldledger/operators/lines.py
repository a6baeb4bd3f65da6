"""Lines from positioned text, and sections from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item(item_idx: Column, x: Column, y: Column, width: Column, text: Column) -> Column:
    """One positioned word, so that words sort from the top down."""
    return F.struct((-y).alias("down"), item_idx.alias("item_idx"), x.alias("x"), y.alias("y"), width.alias("width"), text.alias("text"))


#: A fold copies the list that it adds to, so lists are short: full ones are set aside, and those are few.
CHUNK = 256


def line_starts(page_items: str, tolerance: float) -> Column:
    """Where each line starts (from 1) among a page's sorted items: at one that lies further than ``tolerance`` from the current line's first item."""
    ints, lists = "array<int>", "array<array<int>>"
    none = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("at"), F.array().cast(ints).alias("last"), F.array().cast(lists).alias("full"))

    def step(s: Column, one: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(s["anchor"] - one["y"]) > tolerance)
        at, is_full = s["at"] + 1, new & (F.size(s["last"]) >= CHUNK)
        last = F.when(is_full, F.array(at)).when(new, F.concat(s["last"], F.array(at))).otherwise(s["last"])
        full = F.when(is_full, F.concat(s["full"], F.array(s["last"]))).otherwise(s["full"])
        return F.struct(F.when(new, one["y"]).otherwise(s["anchor"]).alias("anchor"), at.alias("at"), last.cast(ints).alias("last"), full.cast(lists).alias("full"))

    return F.aggregate(page_items, none, step, lambda s: F.concat(F.flatten(s["full"]), s["last"]))


def gather(rows: DataFrame) -> DataFrame:
    """(game_id, page, words) -> (game_id, page, page_items): a page's words from all its rows, in any order, but for blank ones."""
    words = F.filter("words", lambda w: F.trim(w["text"]) != "")
    return rows.select("game_id", "page", words.alias("words")).groupBy("game_id", "page").agg(F.flatten(F.collect_list("words")).alias("page_items")).filter(F.size("page_items") > 0)


def rebuild_lines(items: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(game_id, page, item_idx, text, x, y, width) -> (game_id, page, line_no, y, text, items); see ``page_lines``."""
    word = item(*[F.col(c) for c in ("item_idx", "x", "y", "width", "text")])
    return page_lines(items.filter(F.trim("text") != "").groupBy("game_id", "page").agg(F.collect_list(word).alias("page_items")), tolerance)


def page_lines(pages: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(game_id, page, page_items) -> (game_id, page, line_no, y, text, items).

    Items come from the top down; one joins the current line if it lies within ``tolerance`` of that
    line's first item.  Only a page's items meet in one array, which is cut where lines start; what lies
    by game stays so, as no step leaves Spark's own expressions.
    """
    d = pages.select("game_id", "page", F.sort_array("page_items").alias("page_items")).withColumn("starts", line_starts("page_items", tolerance))
    cut = F.transform("starts", lambda at, k: F.slice("page_items", at, F.coalesce(F.get("starts", k + 1), F.size("page_items") + 1) - at))
    d = d.select("game_id", "page", F.posexplode(cut).alias("k", "line"))
    ordered = F.sort_array(F.transform("line", lambda s: F.struct(s["x"].alias("x"), s["item_idx"].alias("item_idx"), s["text"].alias("text"), s["width"].alias("width"))))
    d = d.select("game_id", "page", (F.col("k") + 1).alias("line_no"), F.get("line", F.lit(0))["y"].alias("anchor"), ordered.alias("sorted"))
    text = F.trim(F.regexp_replace(F.array_join(F.col("sorted.text"), " "), r"\s+", " "))
    return d.select("game_id", "page", "line_no", (F.floor(F.col("anchor") * 2 + 0.5) / 2).alias("y"), text.alias("text"), F.transform("sorted", lambda s: F.struct(s["text"].alias("text"), s["x"].alias("x"), s["width"].alias("width"))).alias("items"))


def page_text(lines: DataFrame) -> DataFrame:
    """(game_id, page, text): a page's lines from the top, by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("game_id", "page").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def first_page_with(pages: DataFrame, marker: str) -> DataFrame:
    """(game_id, page): the first page that holds the marker, of rows of pages or of lines."""
    return pages.filter(F.col("text").contains(marker)).groupBy("game_id").agg(F.min("page").alias("page"))


def pbp_range(pages: DataFrame) -> DataFrame:
    """(game_id, first_page, end_page): play-by-play pages; end_page is exclusive, null for none."""
    starts, ends = F.col("text").rlike(r"First Quarter\s*\nPlay By Play"), F.col("text").contains("Miscellaneous Statistics Report")
    return pages.groupBy("game_id").agg(F.min(F.when(starts, F.col("page"))).alias("first_page"), F.min(F.when(ends, F.col("page"))).alias("end_page")).filter("first_page is not null")


def play_pages(lines: DataFrame) -> DataFrame:
    """The lines of the play-by-play pages: from the first one to the miscellaneous statistics; a report without them has none."""
    pages = pbp_range(page_text(lines))
    return lines.join(pages, "game_id").filter(F.col("page") >= F.col("first_page")).filter(F.col("end_page").isNull() | (F.col("page") < F.col("end_page"))).drop("first_page", "end_page")


# What a section's pages hold.
SECTIONS = {
    "scoring": "SCORING SUMMARY",
    "team_stats": "Final Team Statistics",
    "individual_stats": "Final Individual Statistics",
    "defensive_stats": "Final Defensive Statistics",
    "drive_chart": "Ball Possession And Drive Chart",
    "playtime": "Playtime Percentage",
}
PLAY_BY_PLAY, ROSTER_MARKS, SUMMARY_MARK = r"First Quarter\s*\nPlay By Play", r"Substitutions|Lineups", "National Football League Game Summary"


def with_marks(lines: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Adds page_marks, the markers that the line's page holds, and first_marks, those for which it is the game's first page.

    A marker stands within one line, so no page's text has to be put together.
    """
    page, game = Window.partitionBy("game_id", "page"), Window.partitionBy("game_id")
    held = F.array_compact(F.array(*[F.when(F.max(F.col("text").contains(m)).over(page), F.lit(m)) for m in markers]))
    marked = lines.withColumn("page_marks", held)
    first = [F.min(F.when(F.array_contains("page_marks", m), F.col("page"))).over(game) == F.col("page") for m in markers]
    return marked.withColumn("first_marks", F.array_compact(F.array(*[F.when(on, F.lit(m)) for on, m in zip(first, markers)])))


def section_flags(pages: DataFrame) -> DataFrame:
    """(game_id, eight flags): which sections a report has; the roster is looked for on the first summary page only."""
    flags = {k: F.col("text").contains(marker) for k, marker in SECTIONS.items()} | {"play_by_play": F.col("text").rlike(PLAY_BY_PLAY)}
    summary = F.min_by("text", F.struct(~F.col("text").contains(SUMMARY_MARK), "page"))
    return pages.groupBy("game_id").agg(*[F.bool_or(x).alias(k) for k, x in flags.items()], summary.rlike(ROSTER_MARKS).alias("roster"))


def slice_columns(lines: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds the text of each x-band (low inclusive, high exclusive)."""
    def band(low, high):
        inside = F.filter("items", lambda s: (s["x"] >= low) & (s["x"] < high) & (F.trim(s["text"]) != ""))
        return F.array_join(F.transform(inside, lambda s: s["text"]), " ")

    return lines.withColumns({name: band(low, high) for name, (low, high) in bands.items()})
