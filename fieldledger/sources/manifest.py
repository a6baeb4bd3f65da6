"""Admission of report files, urls and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits, and the form of a game's id.
MAX_BYTES, MAX_URL, MAX_ID = 30 * 1024 * 1024, 2048, 120
GAME_ID = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def admit_reports(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content_type, content) -> + ok, reject_reason: the first rule that fails."""
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), "suffix")
        .when(F.col("length") > max_bytes, "size")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty")
        .when(F.coalesce(F.col("content_type"), F.lit("")) != "application/pdf", "content-type")
        .when(F.coalesce(F.substring("content", 1, 5), F.lit(b"")) != F.lit(b"%PDF-"), "magic")
    )
    return files.withColumn("reject_reason", reason).withColumn("ok", F.col("reject_reason").isNull())


def approved_urls(df: DataFrame, url: str, origin: str, suffix: str) -> DataFrame:
    """+ ok: short enough, this origin (scheme and host in any case, port 443 or none), a path with this suffix in any
    case, no user, and neither a query nor a fragment that isn't empty."""
    part = lambda p: F.coalesce(F.try_parse_url(F.col(url), F.lit(p)), F.lit(""))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d*)$", 1)
    origin_of = F.lower(F.concat(part("PROTOCOL"), F.lit("://"), part("HOST"), F.when(port.isin("", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))))
    plain = (part("QUERY") == "") & (part("REF") == "") & part("USERINFO").isin("", ":")
    ok = (F.length(url) <= MAX_URL) & (origin_of == origin.lower()) & F.lower(part("PATH")).endswith(suffix.lower()) & plain
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def valid_game_ids(df: DataFrame, game_id: str, requested: str | None = None) -> DataFrame:
    """+ ok: the id's form and length; with ``requested`` also that the manifest's id is the one asked for."""
    ok = F.col(game_id).rlike(GAME_ID) & (F.length(game_id) <= MAX_ID)
    if requested is not None:
        ok = ok & (F.col(game_id) == F.col(requested))
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))
