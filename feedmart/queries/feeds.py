"""Queries of sources and sinks: payloads are made from the tables, then scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import feeds as E
from ..sources import ical as I
from ..sources import snapshot as S
from .common import PUB, published, query, table


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a[^>]*href=[\"''][^\"'']*[\"''][^>]*>.*?</a>')) AS links FROM pages WHERE links > 0")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query(
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '</?[A-Za-z][^>]*>', ' ', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&rsquo;', '’'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages"
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("text"))


UNIT_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in X.L.UNITS.items())


@query(
    f"WITH u(k, unit) AS (VALUES {UNIT_ROWS}), p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ['eecs', 'Math', 'live', '', 'new-unit_x', 'abc'][page_id % 6 + 1] ELSE coalesce(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1), '') END AS slug FROM pages) "
    "SELECT page_id, slug, CASE WHEN slug = '' OR lower(slug) IN ('live', 'event', 'events') THEN 'UC Berkeley' WHEN unit IS NOT NULL THEN unit WHEN len(regexp_replace(slug, '[^A-Za-z]', '', 'g')) BETWEEN 1 AND 4 THEN upper(slug) "
    "ELSE array_to_string(list_transform(string_split(regexp_replace(slug, '[-_]', ' ', 'g'), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS unit FROM p LEFT JOIN u ON lower(slug) = k"
)
def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pages by address; every third page is given one of six paths."""
    paths = F.array(*[F.lit(x) for x in ("eecs", "Math", "live", "", "new-unit_x", "abc")])
    path = F.element_at(paths, (F.col("page_id") % 6 + 1).cast("int"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://events.example.org/"), path, F.when(path != "", "/x").otherwise(""))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.unit_from_url(url).alias("u")).select("page_id", "u.slug", "u.unit")


@query(
    "SELECT page_id, 'Film Night ' || page_id AS title, strftime(d, '%Y-%m-%d') || 'T19:00:00' || z AS start_at, strftime(d, '%Y-%m-%d') || 'T21:00:00' || z AS end_at, 'Hall' AS location, 'https://example.org/films/' || page_id AS canonical_url, "
    "'films-' || page_id || '::' || strftime(d, '%Y-%m-%d') AS source_id FROM (SELECT page_id, d, CASE WHEN d >= DATE '2024-03-10' THEN '-07:00' ELSE '-08:00' END AS z FROM (SELECT page_id, CAST(DATE '2024-03-01' + CAST(page_id % 30 AS INT) AS DATE) AS d FROM pages))"
)
def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar-template links, put at the end of every page and scanned out again."""
    p = table(spark, sf_dir, "pages")
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-03-01")), (F.col("page_id") % 30).cast("int")), "yyyyMMdd")
    link = F.concat(F.lit('<a href="https://cal.example.org/calendar/render?action=TEMPLATE&amp;text=Film+Night+'), F.col("page_id").cast("string"), F.lit("&amp;dates="), day, F.lit("T190000/"), day, F.lit("T210000&amp;details=see+https%3A%2F%2Fexample.org%2Ffilms%2F"), F.col("page_id").cast("string"), F.lit('&amp;location=Hall">add</a>'))
    return E.read_html_anchors(p.select("page_id", F.concat("html", link).alias("html"))).select("page_id", "title", "start_at", "end_at", "location", "canonical_url", "source_id")


@query("SELECT 'o' || (n_nationkey % 3) AS source, n_nationkey % 3 = 0 AS ok, CASE WHEN n_nationkey % 3 <> 0 THEN 'supplementary' END AS severity, CASE n_nationkey % 3 WHEN 1 THEN 'unexpected shape for $.value' WHEN 2 THEN 'no contract' END AS message FROM nation")
def payload_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("o"), k.cast("string")).alias("source"), F.when(k == 0, F.to_json(F.struct(F.array("n_name").alias("value")))).otherwise(F.to_json(F.struct(F.col("n_name").alias("value")))).alias("payload"))
    return E.check_contracts(n, {"o0": ("$.value", 0), "o1": ("$.value", 0)})


def page_of(c: str) -> F.Column:
    """Number of the payload that a row goes into: at most 500 ids share one, so payloads grow in number, not in size."""
    return F.floor(F.col(c).cast("long") / 500).alias("page")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a source with a VEVENT per document."""
    d = published(spark, sf_dir)
    body = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id", F.lit("@x")), F.concat(F.lit("DTSTART:"), F.date_format("date", "yyyyMMdd"), F.lit("T180000Z")), F.concat(F.lit("SUMMARY:"), X.ics_escape(F.concat_ws("; ", F.lit("Doc"), "id"))),
        F.concat(F.lit("LOCATION:"), F.substring("location", 1, 3), F.lit("\r\n "), F.expr("substring(location, 4)")), F.when(F.col("id").cast("long") % 10 == 0, "STATUS:CANCELLED").otherwise("STATUS:CONFIRMED"), F.lit("END:VEVENT"),
    )
    return d.groupBy(F.col("source").alias("file"), page_of("id")).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.array_sort(F.collect_list(body)), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("payload"))


@query(f"WITH {PUB} SELECT source AS file, id || '@x' AS uid, 'Doc; ' || id AS title, location, strftime(date, '%Y-%m-%d') || 'T18:00:00Z' AS start_at, CASE WHEN doc_id % 10 = 0 THEN 'cancelled' END AS problem FROM pub")
def ical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.parse_ics(_calendar(spark, sf_dir)).select("file", "uid", "title", "location", "start_at", "problem")


@query(f"WITH {PUB} SELECT source AS file, count(*) AS rows FROM pub GROUP BY source HAVING count(*) >= 50")
def ical_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.guard_min_rows(I.calendar_rules(I.athletics_rules(I.parse_ics(_calendar(spark, sf_dir))).drop("quality_flags", "venue", "address"), {}), "file", 50)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def odata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    record = F.struct(k.cast("string").alias("id"), F.concat(F.lit("Doc "), k.cast("string")).alias("name"), F.when(k % 4 == 1, "Private").otherwise("Public").alias("visibility"), F.when(k % 6 == 0, "soon").otherwise("2024-02-01T18:00:00Z").alias("startsOn"), F.lit("<p>One &amp; two</p>").alias("description"), F.element_at(F.array(F.lit("Arts"), F.lit("Athletics"), F.lit("none")), (k % 3 + 1).cast("int")).alias("theme"), F.when(k % 3 == 1, F.array(F.lit("data science"), F.lit("sport club"))).otherwise(F.array().cast("array<string>")).alias("categoryNames"))
    pages = d.groupBy(page_of("doc_id")).agg(F.to_json(F.struct(F.collect_list(record).alias("value"))).alias("payload"))
    return E.read_odata(pages)


@query("SELECT CAST(e.doc_id AS VARCHAR) AS source_id, 'Doc ' || e.doc_id AS title, 'One & two' AS description, CASE e.doc_id % 3 WHEN 0 THEN 'Arts' WHEN 1 THEN 'Sports,Science & Tech' ELSE 'Student Life' END AS categories, CASE WHEN e.doc_id % 4 = 1 THEN 'not public' WHEN e.doc_id % 6 = 0 THEN 'no start' END AS problem FROM documents e")
def odata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odata_rows(spark, sf_dir).select("source_id", "title", "description", F.array_join("categories", ",").alias("categories"), "problem")


@query("SELECT ['haas', 'berkeley_law', 'begin'][doc_id % 3 + 1] AS host, CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'A & B' ELSE '' END AS venue, '2024-02-01T18:00:00Z' AS start_at, CASE WHEN doc_id % 4 = 0 THEN 'Unit' ELSE ['Berkeley Haas', 'Berkeley Law', 'Berkeley Gateway to Innovation'][doc_id % 3 + 1] END AS organizer, ['Entrepreneurship', 'Academic', 'Entrepreneurship'][doc_id % 3 + 1] AS category FROM documents WHERE doc_id % 5 <> 0")
def tribe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"title":"<b>Doc</b>","status":"'), F.when(k % 5 == 0, "draft").otherwise("publish"), F.lit('","all_day":false,"utc_start_date":"2024-02-01 18:00:00","utc_end_date":"2024-02-01 19:00:00","venue":'), F.when(k % 2 == 0, '[{"venue":"<p>A &amp; B</p>"}]').otherwise("false"), F.lit(',"organizer":'), F.when(k % 4 == 0, '{"organizer":"Unit"}').otherwise("[]"), F.lit(',"categories":[{"name":"Talk"}]}'))
    page = lambda p: d.groupBy(F.element_at(F.array(*[F.lit(h[0]) for h in E.X.L.HOSTS]), (k % 3 + 1).cast("int")).alias("host"), F.floor(k / 500)).agg(F.concat(F.lit('{"events":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("payload")).withColumn("page", F.lit(p)).select("host", "payload", "page")
    return E.read_tribe(page(1).unionByName(page(2)), defaults=E.hosts_dim(spark)).select("host", "source_id", "venue", "start_at", "organizer", "category")


@query("SELECT 'cal-' || ['4TEeXLXVUtUqg91', '7lfE7NPvJ79Cogr', 'QzSyFbecenFng8a'][doc_id % 3 + 1] AS calendar, CAST(doc_id AS VARCHAR) AS source_id, CASE doc_id % 3 WHEN 0 THEN 'virtual' WHEN 1 THEN 'in_person' ELSE 'unknown' END AS modality, CASE WHEN doc_id % 2 = 0 THEN 'Main St 1' ELSE ['Berkeley, CA', 'UC Berkeley, Berkeley, CA', '2054 University Ave, Berkeley, CA'][doc_id % 3 + 1] END AS address, ['Berkeley Gateway Accelerator', 'Club AI at Berkeley', 'Berkeley SkyDeck'][doc_id % 3 + 1] AS organizer, CASE WHEN doc_id % 3 = 1 THEN 'Science & Tech' ELSE 'Entrepreneurship' END AS category FROM documents")
def calendar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    geo = F.struct(F.when(k % 2 == 0, "Main St 1").alias("full_address"))
    event = F.struct(k.cast("string").alias("api_id"), F.lit("Meet").alias("name"), F.lit("2024-02-01T18:00:00Z").alias("start_at"), F.element_at(F.array(F.lit("zoom"), F.lit("offline"), F.lit(None).cast("string")), (k % 3 + 1).cast("int")).alias("location_type"), geo.alias("geo_address_info"))
    ids = F.element_at(F.array(*[F.lit(E.X.L.CALENDARS[i][0]) for i in (0, 2, 4)]), (k % 3 + 1).cast("int"))
    pages = d.groupBy(ids.alias("calendar"), page_of("doc_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(event.alias("event"))).alias("entries"))).alias("payload"))
    return E.read_calendars(pages, E.calendars_dim(spark)).select("calendar", "source_id", "modality", "address", "organizer", F.array_join("categories", ",").alias("category"))


def talk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    item = F.struct(F.lit("2024-02-01 20:00:00").alias("start"), F.when(k % 8 == 0, "Cancelled: talk").otherwise("Talk").alias("title"), F.concat(F.lit("https://example.org/talks/"), k.cast("string")).alias("url"), F.lit("Ann").alias("speakers"), F.lit("Series").alias("program"), F.when(k % 3 == 0, "Public Lecture").otherwise("Workshop").alias("event_type"))
    pages = table(spark, sf_dir, "documents").groupBy(page_of("doc_id")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return E.read_talks(pages)


@query("SELECT 'talks-' || doc_id || '::2024-02-01' AS source_id, CASE WHEN doc_id % 8 = 0 THEN 'Cancelled: talk' ELSE 'Talk' END AS title, 'Ann — Series' AS description, CASE WHEN doc_id % 3 = 0 THEN 'Science & Tech,Academic' ELSE 'Science & Tech' END AS categories, CASE WHEN doc_id % 8 = 0 THEN 'cancelled' END AS problem FROM documents")
def talk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk_rows(spark, sf_dir).select("source_id", "title", "description", F.array_join("categories", ",").alias("categories"), "problem")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 5 > 0 THEN '2024-04-17T17:30:00-07:00' END AS start_at, '2024-11-17T19:00:00-08:00' AS end_at, 'From $10' AS cost, CASE WHEN doc_id % 5 = 0 THEN 'no start' END AS problem, 'Hall' AS venue, 'music' AS genre, CASE WHEN doc_id % 2 = 0 THEN 'A long evening of chamber music and song.' ELSE '' END AS description FROM documents")
def post_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    html = F.concat(F.when(k % 5 > 0, '<span class="start">04/17/2024 05:30 pm</span>').otherwise('<span class="start">soon</span>'), F.lit('<span class="end">11/17/2024 07:00 pm</span><div class="price">From $10</div><a class="venue-link" href="#">Hall</a><p>Tickets from 10 dollars at the box office</p>'), F.when(k % 2 == 0, "<p>A long evening of chamber music and song.</p>").otherwise("<p>Short.</p>"))
    item = F.struct(k.alias("id"), F.concat(F.lit("https://example.org/music/p"), k.cast("string"), F.lit("/")).alias("link"), F.struct(F.lit("Night").alias("rendered")).alias("title"), F.struct(html.alias("rendered")).alias("content"))
    pages = table(spark, sf_dir, "documents").groupBy(page_of("doc_id")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return E.read_posts(pages).select("source_id", "start_at", "end_at", "cost", "problem", "venue", "genre", "description")


@query(f"WITH {PUB} SELECT id, 0 AS n, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || id || '-0' AS head, CASE WHEN doc_id % 7 = 0 THEN 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') ELSE 'DTSTART;TZID=America/Los_Angeles:' || strftime(date, '%Y%m%d') || 'T' || CASE WHEN doc_id % 11 = 0 THEN '1200' ELSE lpad(CAST(mins // 60 AS VARCHAR), 2, '0') || lpad(CAST(mins % 60 AS VARCHAR), 2, '0') END || '00' END AS start_line FROM pub")
def ical_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("vevent", "\r\n")
    out = S.export_ics(published(spark, sf_dir))
    return out.select("id", "n", F.array_join(F.slice(lines, 1, 2), "\r\n").alias("head"), F.get(lines, F.lit(2)).alias("start_line"))


@query("SELECT CAST(m AS VARCHAR) AS month, count(*) AS orders FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-05-01') GROUP BY m")
def month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.to_date(F.trunc("o_orderdate", "MM")))
    return o.join(F.broadcast(E.target_months(spark, "1996-01-15")), "month").groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
