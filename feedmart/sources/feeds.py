"""JSON and HTML scans: landed payloads as rows. Payloads are a column, so files and tables are parsed alike."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators.groups import first_by
from ..operators.rows import is_cancelled

ODATA = "value array<struct<id:string,name:string,description:string,organizationName:string,location:string,startsOn:string,endsOn:string,theme:string,categoryNames:array<string>,visibility:string,status:string>>"
TRIBE = (
    "events array<struct<id:string,title:string,url:string,description:string,utc_start_date:string,utc_end_date:string,timezone:string,all_day:boolean,is_virtual:boolean,"
    "venue:string,organizer:string,categories:string,cost:string,status:string>>, total long, total_pages long, next_rest_url string"
)
CALENDAR = (
    "entries array<struct<event:struct<api_id:string,name:string,start_at:string,end_at:string,timezone:string,url:string,location_type:string,"
    "geo_address_info:struct<mode:string,full_address:string,city_state:string,city:string>>>>"
)
TALKS = "array<struct<start:string,`end`:string,title:string,url:string,event_type:string,workshop_type:string,speakers:string,location:string,program:string>>"
POSTS = "array<struct<id:long,slug:string,link:string,title:struct<rendered:string>,content:struct<rendered:string>>>"


def json_or(c: str | Column, schema: str, default: Column | None = None) -> Column:
    """Tolerant parse: what does not fit is the default."""
    parsed = F.from_json(X.col(c), schema, {"mode": "PERMISSIVE"})
    return parsed if default is None else F.coalesce(parsed, default)


def first_of(c: str | Column, name: str) -> Column:
    """A field of an object, or of the first of a list of objects; null for anything else, ``false`` included."""
    v = F.try_parse_json(X.col(c))
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(v, f"$[0].{name}", "string"))


def read_odata(df: DataFrame, payload: str = "payload") -> DataFrame:
    """OData pages: public records with id, name and a day; others carry their ``problem``."""
    rows = df.select(F.explode(json_or(payload, ODATA)["value"]).alias("v")).select("v.*")
    on = D.local_date("startsOn")
    problem = (
        F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.coalesce("name", F.lit("")) == "", "no name")
        .when(F.coalesce(F.lower("visibility"), F.lit("public")) != "public", "not public").when(on.isNull(), "no start")
    )
    return rows.select(
        F.col("id").alias("source_id"), X.clean_title("name").alias("title"), X.strip_html(F.coalesce("description", F.lit(""))).alias("description"), F.col("startsOn").alias("start_at"),
        F.col("endsOn").alias("end_at"), F.coalesce("location", F.lit("")).alias("venue"), F.coalesce("organizationName", F.lit("")).alias("organizer"), X.categorize_theme("theme", "categoryNames").alias("categories"), problem.alias("problem"),
    )


def read_tribe(df: DataFrame, payload: str = "payload", page: str = "page", host: str = "host", defaults: DataFrame | None = None) -> DataFrame:
    """Paged REST events of several hosts: published ones, the first page winning an id; venue and organizer may be an object, a list or false."""
    rows = df.select(page, host, F.posexplode(json_or(payload, TRIBE)["events"]).alias("n", "v")).select(page, host, "n", "v.*")
    rows = rows.filter(F.coalesce("status", F.lit("publish")) == "publish")
    rows = first_by(rows, [host, "id"], [page, "n"])
    names = F.transform(F.from_json("categories", "array<struct<name:string>>"), lambda c: X.strip_html(c["name"]))
    out = rows.select(
        host, F.col("id").alias("source_id"), X.strip_html("title", True).alias("title"), X.strip_html(F.coalesce("description", F.lit("")), True).alias("description"), F.col("url").alias("canonical_url"),
        F.when(F.col("all_day"), F.substring("utc_start_date", 1, 10)).otherwise(D.with_utc_suffix("utc_start_date")).alias("start_at"),
        D.with_utc_suffix("utc_end_date").alias("end_at"), F.coalesce("all_day", F.lit(False)).alias("all_day"), X.strip_html(F.coalesce(first_of("venue", "venue"), F.lit("")), True).alias("venue"),
        X.strip_html(F.coalesce(first_of("organizer", "organizer"), F.lit("")), True).alias("organizer"), F.coalesce(names, F.array().cast("array<string>")).alias("categories"), X.strip_html(F.coalesce("cost", F.lit(""))).alias("cost"),
        F.when(F.coalesce("is_virtual", F.lit(False)), "virtual").otherwise("in_person").alias("modality"),
    )
    if defaults is not None:  # a row per configured host
        out = out.join(defaults.select(host, F.col("organizer").alias("_organizer"), "organizer_unit", "address", "category"), host, "left").withColumn("organizer", F.coalesce(F.nullif("organizer", F.lit("")), "_organizer", F.lit(""))).drop("_organizer")
    return out


def modality_of(location_type: str | Column) -> Column:
    low = F.lower(F.coalesce(X.col(location_type), F.lit("")))
    return F.when(low.isin("online", "zoom", "meet", "virtual"), "virtual").when(low == "hybrid", "hybrid").when(low == "offline", "in_person").otherwise("unknown")


def read_calendars(df: DataFrame, calendars: DataFrame, payload: str = "payload", key: str = "calendar") -> DataFrame:
    """Entries of several calendars with their dimension's organizer, category and address; addresses fall back from full to city to the calendar's."""
    rows = df.select(key, F.explode(json_or(payload, CALENDAR)["entries"]).alias("e")).select(key, "e.event.*")
    rows = rows.join(calendars.select(key, "organizer", "category", "default_address"), key, "left")  # Spark broadcasts it where it is small
    geo = lambda name: F.nullif(F.col(f"geo_address_info.{name}"), F.lit(""))
    return rows.select(
        key, F.col("api_id").alias("source_id"), X.clean_title("name").alias("title"), "start_at", "end_at", F.coalesce("timezone", F.lit(X.L.TIME_ZONE)).alias("timezone"), F.col("url").alias("slug"),
        modality_of("location_type").alias("modality"), F.coalesce(geo("full_address"), geo("city_state"), geo("city"), "default_address", F.lit("")).alias("address"), F.coalesce("organizer", F.lit("")).alias("organizer"),
        F.array_compact(F.array("category")).alias("categories"), F.when(F.coalesce(F.col("api_id"), F.lit("")) == "", "no id").when(D.local_date("start_at").isNull(), "no start").alias("problem"),
    )


def slug_of(url: str | Column) -> Column:
    """Path of an address as a slug."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.try_parse_url(X.col(url), F.lit("PATH")), F.lit("")), "^/+|/+$", ""), "/+", "-")


def talk_categories(event_type: str | Column, workshop_type: str | Column) -> Column:
    """Categories of a talk; one for everyone has one more."""
    kinds = F.lower(F.concat_ws(" ", F.coalesce(X.col(event_type), F.lit("")), F.coalesce(X.col(workshop_type), F.lit(""))))
    both = F.array(*[F.lit(c) for c in X.L.PUBLIC_TALK_CATEGORIES])
    return F.when(kinds.rlike(X.L.PUBLIC_TALKS), both).otherwise(F.array(*[F.lit(c) for c in X.L.TALK_CATEGORIES]))


def calendars_dim(spark: SparkSession) -> DataFrame:
    """The configured calendars: ``calendar, slug, organizer, organizer_unit, default_address, category``."""
    return spark.createDataFrame(X.L.CALENDARS, "calendar string, slug string, organizer string, organizer_unit string, default_address string, category string")


def hosts_dim(spark: SparkSession) -> DataFrame:
    """The configured hosts: ``host, organizer, organizer_unit, address, category``."""
    return spark.createDataFrame(X.L.HOSTS, "host string, organizer string, organizer_unit string, address string, category string")


def read_talks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A JSON list of talks: title, start and address are needed, cancelled titles are none; speakers and programme are the description."""
    rows = df.select(F.explode(F.from_json(F.concat(F.lit('{"a":'), payload, F.lit("}")), f"a {TALKS}")["a"]).alias("v")).select("v.*")
    start = D.with_utc_suffix("start")
    problem = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(F.coalesce("start", F.lit("")) == "", "no start").when(F.coalesce("url", F.lit("")) == "", "no url").when(is_cancelled("title"), "cancelled")
    )
    return rows.select(
        F.concat(slug_of("url"), F.lit("::"), D.local_date(start).cast("string")).alias("source_id"), X.clean_title("title").alias("title"), start.alias("start_at"), D.with_utc_suffix("end").alias("end_at"),
        F.concat_ws(" — ", F.nullif(F.trim("speakers"), F.lit("")), F.nullif(F.trim("program"), F.lit(""))).alias("description"), F.coalesce("location", F.lit("")).alias("venue"), F.col("url").alias("canonical_url"),
        talk_categories("event_type", "workshop_type").alias("categories"), problem.alias("problem"),
    )


def read_posts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Posts with an event in their HTML: start and end spans, venue link, price block, first paragraph of substance, genre from the address."""
    rows = df.select(F.explode(F.from_json(F.concat(F.lit('{"a":'), payload, F.lit("}")), f"a {POSTS}")["a"]).alias("v")).select("v.*")
    html = F.col("content.rendered")
    span = lambda name: D.us_datetime_to_iso(X.strip_html(F.regexp_extract(html, rf'(?is)<span[^>]*class="[^"]*{name}[^"]*"[^>]*>(.*?)</span>', 1)))
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: X.strip_html(p))
    body = F.get(F.filter(paragraphs, lambda p: (F.length(p) > 30) & ~p.rlike(r"(?i)^(tickets|buy|single tickets|please note|click)")), F.lit(0))
    path = F.split(F.regexp_replace(F.try_parse_url("link", F.lit("PATH")), "^/+|/+$", ""), "/")
    start = span("start")
    return rows.select(
        F.col("id").cast("string").alias("source_id"), X.clean_title("title.rendered").alias("title"), start.alias("start_at"), span("end").alias("end_at"),
        X.strip_html(F.regexp_extract(html, r'(?is)<a[^>]*class="[^"]*venue[^"]*"[^>]*>(.*?)</a>', 1)).alias("venue"), X.strip_html(F.regexp_extract(html, r'(?is)<div[^>]*class="[^"]*price[^"]*"[^>]*>(.*?)</div>', 1)).alias("cost"),
        F.coalesce(body, F.lit("")).alias("description"), F.when(F.size(path) >= 2, F.get(path, F.size(path) - 2)).alias("genre"), F.col("link").alias("canonical_url"), F.when(start.isNull(), "no start").alias("problem"),
    )


def read_html_anchors(df: DataFrame, payload: str = "html", keep: tuple[str, ...] = ("page_id",), pattern: str = r"calendar/(?:render|event)\?[^\"']*") -> DataFrame:
    """Calendar-template links of pages: one row per address and day, the first winning."""
    links = F.regexp_extract_all(F.col(payload), F.lit(rf"(?is)<a[^>]+href=[\"']([^\"']*{pattern})[\"']"), F.lit(1))
    rows = df.select(*keep, F.posexplode(links).alias("n", "href")).withColumn("link", X.parse_template_link("href")).filter("link is not null")
    rows = rows.select(*keep, "n", "link.*").withColumn("start_at", D.token_to_iso("start")).withColumn("end_at", D.token_to_iso("end"))
    rows = rows.withColumn("on", D.local_date("start_at")).withColumn("canonical_url", F.coalesce("url", F.lit("")))
    rows = first_by(rows, ["canonical_url", "title", "on"], [*keep, "n"])
    return rows.withColumn("source_id", F.concat(F.coalesce(F.nullif(slug_of("url"), F.lit("")), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")), F.lit("::"), F.col("on").cast("string")))


def page_links(df: DataFrame, payload: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All links of pages: ``keep, n, href, label``."""
    found = F.regexp_extract_all(F.col(payload), F.lit(r"(?is)<a[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = df.select(*keep, F.posexplode(found).alias("n", "a"))
    return rows.select(*keep, "n", F.regexp_extract("a", r"(?is)href=[\"']([^\"']*)[\"']", 1).alias("href"), X.strip_html("a").alias("label"))


#: rule name -> (kind, argument): what a landed payload must look like. Fixed values.
CONTRACTS = {
    "livewhale": ("ical", 10_000), "calbears": ("ical", 0), "callink": ("$.value", 0), "haas": ("$.events", 0), "berkeley_law": ("$.events", 0), "begin": ("$.events", 0),
    "luma": ("$.entries", 0), "simons": ("$", 0), "cal_performances": ("$", 0), "bampfa": ("html", 0),
}


def check_contracts(df: DataFrame, rules: dict[str, tuple[str, int]] | None = None, source: str = "source", payload: str = "payload", link: str = "calendar/render") -> DataFrame:
    """``source, ok, severity, message`` of each landed payload; one failing never stops the rest."""
    critical = [s[0] for s in X.L.SOURCES if s[-1]]
    kind, least = F.lit(None).cast("string"), F.lit(0)
    for name, (k, n) in (CONTRACTS if rules is None else rules).items():
        kind, least = F.when(F.col(source) == name, k).otherwise(kind), F.when(F.col(source) == name, n).otherwise(least)
    v = F.try_parse_json(payload)
    is_list = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))
    shape = F.when(kind == "ical", F.col(payload).contains("BEGIN:VCALENDAR")).when(kind == "html", F.col(payload).contains(link)).when(kind == "$.value", is_list("$.value")).when(kind == "$.events", is_list("$.events")).when(kind == "$.entries", is_list("$.entries")).when(kind == "$", is_list("$"))
    message = F.when(kind.isNull(), "no contract").when(~F.coalesce(shape, F.lit(False)), F.concat(F.lit("unexpected shape for "), kind)).when(F.length(payload) < least, "payload too short")
    return df.select(source, message.isNull().alias("ok"), F.when(message.isNotNull(), F.when(F.col(source).isin(*critical), "critical").otherwise("supplementary")).alias("severity"), message.alias("message"))


def target_months(spark: SparkSession, start: date | str, n: int = 3) -> DataFrame:
    """``month``: first days of the month and the next ones to read."""
    first = F.trunc(D.day(start), "MM")
    return spark.range(1).select(F.explode(F.sequence(first, F.add_months(first, n), F.expr("INTERVAL 1 MONTH"))).alias("month"))
