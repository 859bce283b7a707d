"""iCalendar scans: landed feeds as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``file, payload``: one row per landed file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def guard_min_rows(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of groups with at least ``n``; a shorter feed counts as a failed fetch."""
    return df.join(df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(by), by, "left_semi")


def prop(block: str | Column, name: str) -> Column:
    """Value of an unfolded property, whatever its parameters; empty if absent."""
    return F.trim(F.regexp_extract(X.col(block), rf"(?im)^{name}(?:;[^:\r\n]*)?:(.*?)\r?$", 1))


def parse_ics(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """VEVENTs of payloads: ``uid, vendor_id, title, description, location, url, status, categories, start_at, end_at, all_day`` and the problem of rows that are not events.

    Lines are unfolded first. A date without time stays a date, a UTC time
    becomes an ISO instant, wall time keeps its zone's offset.
    """
    unfolded = F.regexp_replace(F.col(payload), r"\r?\n[ \t]", "")
    blocks = F.slice(F.split(unfolded, r"(?m)^BEGIN:VEVENT\r?\n"), 2, 1 << 30)
    rows = df.select(*keep, F.posexplode(blocks).alias("ingest_seq", "_block"))
    when = lambda name: F.regexp_extract("_block", rf"(?im)^{name}((?:;[^:\r\n]*)?):", 1)
    iso = lambda name: D.token_to_iso(prop("_block", name))
    date_only = when("DTSTART").rlike("(?i)VALUE=DATE(?!-)") | prop("_block", "DTSTART").rlike(r"^\d{8}$")
    status = F.upper(prop("_block", "STATUS"))
    out = rows.select(
        *keep,
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
        prop("_block", "UID").alias("uid"),
        F.nullif(prop("_block", "X-LIVEWHALE-ID"), F.lit("")).alias("vendor_id"),
        X.decode_ics(prop("_block", "SUMMARY")).alias("title"),
        X.decode_ics(prop("_block", "DESCRIPTION")).alias("description"),
        X.decode_ics(prop("_block", "LOCATION")).alias("location"),
        F.nullif(prop("_block", "URL"), F.lit("")).alias("url"),
        F.nullif(status, F.lit("")).alias("status"),
        F.filter(F.transform(F.split(prop("_block", "CATEGORIES"), ","), F.trim), lambda t: t != "").alias("categories"),
        iso("DTSTART").alias("start_at"),
        iso("DTEND").alias("end_at"),
        date_only.alias("all_day"),
    )
    return out.withColumn("problem", F.when(F.col("start_at").isNull(), "no start").when(F.col("status").isin("CANCELLED", "CANCELED"), "cancelled"))


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    return parse_ics(read_payloads(spark, path))


def calendar_rules(df: DataFrame, units: dict[str, str] = X.L.UNITS, base_url: str = "") -> DataFrame:
    """Canonical columns of a calendar feed: id of the vendor or else the UID, address from the UID if none, unit from the address, flag where that is generic."""
    link = F.coalesce("url", F.concat(F.lit(base_url), "uid"))
    unit = X.unit_from_url(link, units)
    flags = F.array_compact(F.array(F.when((unit["slug"] == "") | F.lower(unit["slug"]).isin(*X.L.GENERIC_PATHS), "unknown_unit")))
    return df.select(
        "*", F.coalesce("vendor_id", "uid").alias("source_id"), link.alias("source_url"), link.alias("canonical_url"), F.col("location").alias("venue"), unit["unit"].alias("organizer"), flags.alias("quality_flags"),
    )


def athletics_rules(df: DataFrame) -> DataFrame:
    """Fixtures: mark cut off titles, results noted, venue from ``City, ST, Venue``, flag for games away."""
    parts = F.split("location", r",\s*")
    game = X.game_flags("title")
    return df.select(
        *[c for c in df.columns if c != "title"], X.clean_summary("title").alias("title"), game["completed"].alias("completed"),
        F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 100), ", ")).otherwise(F.col("location")).alias("venue"),
        F.when(F.size(parts) >= 3, F.concat_ws(", ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise("").alias("address"),
        F.when(game["is_home"], F.array().cast("array<string>")).otherwise(F.array(F.lit("away_or_neutral"))).alias("quality_flags"),
    )
