"""Operators on rows: canonical projection, validation, filters, predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import text as X
from ..schema import CANONICAL_DDL, ddl_fields

DEFAULTS = {
    "description": "''", "timezone": f"'{L.TIME_ZONE}'", "all_day": "false", "venue": "''", "building": "''", "address": "''", "modality": "'in_person'", "organizer": "''",
    "organizer_unit": "''", "audience": "''", "cost": "''", "categories": "array()", "tags": "array()", "confidence": "1", "quality_flags": "array()", "source_order": "0", "ingest_seq": "0",
}


def to_canonical(df: DataFrame, source: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """All canonical columns in order and type; absent and null ones take their default (SQL text)."""
    defaults = DEFAULTS | (defaults or {})
    out = []
    for name, kind in ddl_fields(CANONICAL_DDL):
        c = F.lit(source) if name == "source_name" and source else df[name] if name in df.columns else F.lit(None)
        c = c.cast(kind)
        out.append((F.coalesce(c, F.expr(defaults[name]).cast(kind)) if name in defaults else c).alias(name))
    return df.select(*out)


def http_url(c: str | Column) -> Column:
    """Whether a text is an absolute http or https address."""
    return F.coalesce(X.col(c).rlike(r"(?i)^https?://[^\s/?#]+") & F.lower(F.try_parse_url(X.col(c), F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def problems(sources: list[str] | None = None) -> Column:
    """``field:message`` of every constraint that a canonical row breaks."""
    known = [s[0] for s in L.SOURCES] if sources is None else sources
    c, out = F.col, []
    rule = lambda field, message, bad: out.append(F.when(F.coalesce(bad, F.lit(True)), f"{field}:{message}"))  # noqa: E731  unknown is broken
    rule("source_name", "unknown source", ~c("source_name").isin(*known) if known else F.lit(False))
    rule("source_id", "length", ~F.length("source_id").between(1, 512))
    for field in ("source_url", "canonical_url"):
        rule(field, "not an http address", ~http_url(field))
    for field in ("evidence_url", "registration_url"):
        rule(field, "not an http address", c(field).isNotNull() & ~http_url(field))
    rule("title", "length", ~F.length("title").between(2, 300))
    rule("description", "length", F.length("description") > 20000)
    rule("start_at", "not a date or instant", ~D.is_iso_or_date("start_at"))
    rule("end_at", "not a date or instant", F.when(c("end_at").isNotNull(), ~D.is_iso_or_date("end_at")).otherwise(False))
    for field in ("venue", "building", "address", "organizer", "organizer_unit", "audience"):
        rule(field, "length", F.length(field) > 500)
    rule("modality", "unknown", ~c("modality").isin(*L.MODALITIES))
    rule("confidence", "out of range", ~c("confidence").between(0, 1))
    rule("last_seen_at", "missing", c("last_seen_at").isNull())
    return F.array_compact(F.array(*out))


def validate(df: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``problems``)."""
    marked = df.withColumn("problems", problems(sources))
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def drop_past(df: DataFrame, today: date | str, start: str = "start_at", tz: str = L.TIME_ZONE) -> DataFrame:
    """Rows that start today or later; rows without a day go too."""
    return df.filter(D.local_date(start, tz) >= D.day(today))


def is_cancelled(title: str | Column) -> Column:
    return F.coalesce(X.col(title).rlike(rf"(?i)^({L.CANCELLED})[:\s]"), F.lit(False))


def drop_cancelled(df: DataFrame, title: str = "title", status: str | None = None) -> DataFrame:
    """Rows whose title does not begin with a cancelling word, nor whose status is CANCELLED."""
    gone = is_cancelled(title)
    return df.filter(~(gone | F.coalesce(F.upper(F.col(status)) == "CANCELLED", F.lit(False)) if status else gone))


def drop_completed(df: DataFrame, title: str = "title") -> DataFrame:
    """Fixtures without a result."""
    return df.filter(~F.coalesce(X.game_flags(title)["completed"], F.lit(False)))


def has_future(today: date | str, on: str = "date", end: str = "end_date", dates: str = "dates") -> Column:
    """Whether the day, the last day or any day of a row is today or later; days are DATE, so only real ones count."""
    t = D.day(today)
    return F.coalesce(F.col(on) >= t, F.lit(False)) | F.coalesce(F.col(end) >= t, F.lit(False)) | F.coalesce(F.exists(dates, lambda d: F.coalesce(d >= t, F.lit(False))), F.lit(False))


def by_category(df: DataFrame, category: str, tags: str = "tags") -> DataFrame:
    """Rows whose first tag is the category, in any case; ``All`` passes everything."""
    return df if category.lower() == "all" else df.filter(F.lower(F.get(tags, F.lit(0))) == category.lower())


def has_tag(category: str | Column, tags: str = "tags") -> Column:
    wanted = F.lower(category if isinstance(category, Column) else F.lit(category))
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == wanted), F.lit(False))


def by_any_tag(df: DataFrame, category: str, tags: str = "tags") -> DataFrame:
    """Rows that have the category among their tags."""
    return df.filter(has_tag(category, tags))


def by_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    return df if source.lower() == "all" else df.filter(F.col(column) == source)


def require_date(df: DataFrame, on: str = "date") -> DataFrame:
    return df.filter(F.col(on).isNotNull())


def in_range(range_: str | Column, today: date | str | Column, on: str | Column = "date", week_days: int = 7) -> Column:
    """today, tomorrow, week (both ends included) or upcoming; other names pass nothing."""
    r, t, d = (F.lit(range_) if isinstance(range_, str) else range_), D.day(today), X.col(on)
    return (
        F.when(r == "today", d == t)
        .when(r == "tomorrow", d == F.date_add(t, 1))
        .when(r == "week", d.between(t, F.date_add(t, week_days)))
        .when(r == "upcoming", d >= t)
        .otherwise(False)
    )


def by_range(df: DataFrame, range_: str, today: date | str, week_days: int = 7) -> DataFrame:
    return df.filter(in_range(range_, today, week_days=week_days))


def bounds(preset: Column, start: Column, end: Column, today: date | str) -> Column:
    """Struct of first and last day of a request: explicit days before the preset's, and whether they contradict each other."""
    t = D.day(today)
    first = F.coalesce(start, F.when(preset.isin("today", "week", "upcoming"), t).when(preset == "tomorrow", F.date_add(t, 1)))
    last = F.coalesce(end, F.when(preset == "today", t).when(preset == "tomorrow", F.date_add(t, 1)).when(preset == "week", F.date_add(t, 6)))
    return F.struct(first.alias("first"), last.alias("last"), F.coalesce(first > last, F.lit(False)).alias("invalid"))


def by_bounds(df: DataFrame, first: date | str | None, last: date | str | None, on: str = "date") -> DataFrame:
    """Rows between two days, both included; contradicting days are an error."""
    if first and last and str(first) > str(last):
        raise ValueError("the first day must not be after the last")
    df = df.filter(F.col(on) >= D.day(first)) if first else df
    return df.filter(F.col(on) <= D.day(last)) if last else df


def haystack(prefix: str = "") -> Column:
    """What a keyword is looked for in: non-empty fields and tags, lower-cased."""
    c = lambda n: F.col(f"{prefix}{n}")
    parts = F.concat(F.array(c("title"), c("description"), c("organizer"), c("location"), c("source")), F.coalesce(c("tags"), F.array().cast("array<string>")))
    return F.lower(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " "))


def matches_text(query: str | Column, prefix: str = "") -> Column:
    q = F.lower(query if isinstance(query, Column) else F.lit(query))
    return (F.coalesce(q, F.lit("")) == "") | haystack(prefix).contains(q)


def is_home_game(tags: str = "tags", location: str = "location", venues: list[str] | None = None) -> Column:
    """True save for sports rows whose location names none of the home venues."""
    sports = F.coalesce(F.exists(tags, lambda t: F.lower(t).contains("sport")), F.lit(False))
    at_home = F.exists(F.array(*[F.lit(v) for v in (venues or L.HOME_VENUES)]), lambda v: F.lower(F.coalesce(F.col(location), F.lit(""))).contains(v))
    return ~sports | at_home


def split_short(queries: DataFrame, text: str = "query", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(queries long enough to be searched, those that are not)."""
    long_enough = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least
    return queries.filter(long_enough), queries.filter(~long_enough)


def clamp_limit(c: str | Column, default: int = 10, most: int = 50) -> Column:
    """A limit from any text: truncated, from 1 to ``most``; unreadable ones are the default."""
    number = X.col(c).cast("string").try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e300)
    whole = F.when(number < 0, F.ceil(F.greatest(number, F.lit(-1e9)))).otherwise(F.floor(F.least(number, F.lit(1e9))))
    return F.when(fine, F.greatest(F.lit(1), F.least(F.lit(most), whole))).otherwise(default).cast("int")


def to_tool_rows(df: DataFrame, category: str | Column | None = None) -> DataFrame:
    """Rows as the tool shows them: category is the matched tag or else the first."""
    wanted = F.lower(category if isinstance(category, Column) else F.lit(category))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    matched = F.get(F.filter(tags, lambda t: F.lower(t) == wanted), F.lit(0))
    return df.select(
        "id", "title", "date", "time", "location", "organizer", F.coalesce(matched, F.get(tags, F.lit(0))).alias("category"), matched.alias("matched_category"), tags.alias("tags"), "source", "url",
    )


def by_ids(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """A row per wanted id, null beside those that are not there; a missing id is an error, as a row with ``problem``."""
    asked = wanted.select(F.col(key).alias("_asked"))
    found = asked.join(df, asked["_asked"] == df[key], "left").drop(key).withColumnRenamed("_asked", key)
    return found.withColumn("problem", F.when(F.col(key).isNull(), "missing id"))
