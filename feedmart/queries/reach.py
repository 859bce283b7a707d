"""Queries of rules, sinks and loaders that the other queries do not reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import text as X
from ..operators import classify as C
from ..operators import groups as G
from ..operators import rows as R
from ..plans import browse as B
from ..plans import refresh as P
from ..plans.index import build_index, index_json
from ..plans.lineage import shared_folder
from ..sources import ical as I
from ..sources import snapshot as S
from .common import PUB, TODAY, published, query, sql_tokens, table
from .feeds import page_of


def pick(key: str | Column, *values: str | None) -> Column:
    """The value at the key's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (X.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, *values: str | None) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{shown}][{key} % {len(values)} + 1]"


MARKS = ("[H] Game", "[A] Match", "[W] Final", "[x] Meet", "Open day")
PLACES = ("Town, CA, Field, North", "City, NV", "Stadium")


@query(
    f"WITH d AS (SELECT doc_id, {sql_pick('doc_id', *MARKS)} AS t, {sql_pick('doc_id', *PLACES)} AS place FROM documents) SELECT 'g' || doc_id AS uid, trim(regexp_replace(t, '^\\[[A-Za-z]\\]\\s*', '')) AS title, "
    "CASE doc_id % 3 WHEN 0 THEN 'Field, North' ELSE place END AS venue, CASE doc_id % 3 WHEN 0 THEN 'Town, CA' ELSE '' END AS address, doc_id % 5 = 2 AS completed, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'away_or_neutral' END AS flags FROM d"
)
def athletics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of calendar payloads: mark, result, venue and flag."""
    k = F.col("doc_id")
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:g"), k.cast("string")), F.lit("DTSTART:20240201T180000Z"), F.concat(F.lit("SUMMARY:"), pick(k, *MARKS)), F.concat(F.lit("LOCATION:"), X.ics_escape(pick(k, *PLACES))), F.lit("END:VEVENT"))
    pages = table(spark, sf_dir, "documents").groupBy(page_of("doc_id")).agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list(event), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("payload"))
    out = I.athletics_rules(I.parse_ics(pages, keep=()))
    return out.select("uid", "title", "venue", "address", "completed", F.array_join("quality_flags", ",").alias("flags"))


@query(f"SELECT doc_id, {sql_pick('doc_id', *MARKS)} AS title FROM documents WHERE doc_id % 5 <> 2")
def without_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_completed(table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", *MARKS).alias("title")))


SPORTS = ("Sports", "sports club", "Arts", None)
GROUNDS = ("Memorial Stadium", "Elsewhere Arena", None)


@query(f"SELECT doc_id, NOT (doc_id % 4 IN (0, 1)) OR doc_id % 3 = 0 AS home FROM documents")
def home_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(pick("doc_id", *SPORTS))).alias("tags"), pick("doc_id", *GROUNDS).alias("location"))
    return d.select("doc_id", R.is_home_game().alias("home"))


IDS = ("20240110T070000Z-", "show-march-2024", "talk::2024-01-10", "plain")
SOURCES = ("livewhale", "bampfa", "simons", "haas")


@query(
    f"WITH d AS (SELECT doc_id, {sql_pick('doc_id', *SOURCES)} AS s FROM documents) SELECT doc_id, s || '::' || CASE doc_id % 4 WHEN 0 THEN doc_id || '@h' WHEN 1 THEN doc_id || '-show' WHEN 2 THEN doc_id || '-talk' ELSE doc_id || '-20240110T070000Z-::2024-01-10' END AS key FROM d"
)
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of ids that name a day or month, by the rules of their source."""
    k = F.col("doc_id").cast("string")
    ids = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("20240110T070000Z-"), k, F.lit("@h"))).when(F.col("doc_id") % 4 == 1, F.concat(k, F.lit("-show-March-2024"))).when(F.col("doc_id") % 4 == 2, F.concat(k, F.lit("-talk::2024-01-10"))).otherwise(F.concat(k, F.lit("-20240110T070000Z-::2024-01-10")))
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_event_key(pick("doc_id", *SOURCES), ids).alias("key"))


TAGS = ("fine art", "Sporting", "Computer Science", "Student group", "Entrepreneurs", "academic", "Food")
CANONICAL = ("Arts", "Sports", "Science & Tech", "Student Life", "Entrepreneurship", "Academic", "Food")
VENUES = ("Berkley Art Museum and Pacific Film Archive", "BERKEY ART MUSEUM & PACIFIC FILM ARCHIVE", "Hall 1")


@query(f"SELECT doc_id, {sql_pick('doc_id', *CANONICAL)} AS tag, CASE WHEN doc_id % 3 = 2 THEN 'Hall 1' ELSE 'BAMPFA' END AS venue FROM documents")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_tag(pick("doc_id", *TAGS)).alias("tag"), X.canonical_venue(pick("doc_id", *VENUES)).alias("venue"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Arts' WHEN 1 THEN 'Sports,Academic' WHEN 2 THEN 'Science & Tech' ELSE 'Student Life' END AS categories FROM documents")
def theme_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("A research group"), F.lit("Learning"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("Data club"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.categorize_theme(pick("doc_id", "Arts", "Athletics", "none", "none"), names), ",").alias("categories"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') END AS day FROM documents")
def real_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of texts: impossible ones are null."""
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    text = F.when(F.col("doc_id") % 4 == 3, pick((F.col("doc_id") / 4).cast("long"), "2024-02-30", "2024-13-01", "soon")).otherwise(day)
    return table(spark, sf_dir, "documents").select("doc_id", D.valid_date(text).cast("string").alias("day"))


@query(
    f"WITH o AS (SELECT user_id, list_sort(list(DISTINCT CAST(ts AS DATE))) AS d FROM events WHERE event_id % 5 < 2 GROUP BY user_id) SELECT user_id, CASE WHEN len(d) = 1 THEN 'single' WHEN len(d) = date_diff('day', d[1], d[len(d)]) + 1 THEN 'continuous' ELSE 'gappy' END AS shape, "
    f"d[1] <= DATE '{TODAY}' AND d[len(d)] >= DATE '{TODAY}' AS ongoing, CAST(d[1] AS VARCHAR) AS first, CAST(d[len(d)] AS VARCHAR) AS last, len(list_filter(d, lambda x: x BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 6)) AS coming FROM o"
)
def occurrence_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").filter("event_id % 5 < 2").groupBy("user_id").agg(G.date_set(F.collect_set(F.to_date("ts"))).alias("dates"))
    shape = D.run_shape(F.element_at("dates", 1), F.lit(None).cast("date"), "dates", TODAY)
    return o.select("user_id", shape.alias("s")).select("user_id", "s.shape", "s.ongoing", F.col("s.first").cast("string").alias("first"), F.col("s.last").cast("string").alias("last"), F.col("s.coming").cast("long").alias("coming"))


@query("SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-20 00:00:00' THEN floor(date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') / 3600.0::DOUBLE * 10 + 0.5) / 10 END::DOUBLE AS hours FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return e.select("event_id", D.age_hours("ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).cast("double").alias("hours"))


@query(
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), "
    "'(?i)<br\\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)\\s*>', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&rsquo;', '’'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages"
)
def page_block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html("html", blocks=True).alias("text"))


@query(
    "SELECT conv_id, turn, len(trim(coalesce(text, ''))) >= 2 AS searched FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN left(text, 1) ELSE text END AS text FROM conversations)"
)
def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 1)).otherwise(F.col("text")).alias("query"))
    enough, short = R.split_short(c)
    return enough.withColumn("searched", F.lit(True)).unionByName(short.withColumn("searched", F.lit(False))).select("conv_id", "turn", "searched")


@query("SELECT 0 AS source_order, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 1, CAST(p_partkey AS VARCHAR), NULL, p_brand FROM part UNION ALL SELECT 2, CAST(s_suppkey AS VARCHAR), NULL, NULL FROM supplier")
def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of different columns in registry order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return P.union_sources([c, p, s]).select("source_order", "id", "segment", "brand")


@query(f"WITH {PUB} SELECT id, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN mins = -1 THEN 0 ELSE mins END, lpad(id, 9, '0'), id) AS place FROM pub")
def publish_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within their day in publishing order, by titles of digits alone, which every language orders alike."""
    p = published(spark, sf_dir).withColumn("title", F.lpad("id", 9, "0"))
    return G.with_rank(p, ["date"], B.publish_order(), "place").select("id", F.col("place").cast("long").alias("place"))


@query(
    f"WITH {PUB}, t AS ({sql_tokens('pub', 'id', 'location')}) SELECT 'l' AS field, token, string_agg(CAST(id AS BIGINT), ',' ORDER BY CAST(id AS BIGINT)) AS positions FROM t GROUP BY token"
)
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served JSON lines of the location's index, read back."""
    postings = build_index(published(spark, sf_dir).withColumn("pos", F.col("id").cast("long")), pos="pos", aliases=False).filter("field = 'l'")
    back = index_json(postings).select(F.from_json("value", "field string, token string, positions array<long>").alias("v")).select("v.*")
    return back.select("field", "token", F.array_join("positions", ",").alias("positions"))


@query(
    f"WITH {PUB}, n AS (SELECT count(*) AS rows FROM pub) SELECT id, title, CAST(date AS VARCHAR) AS date, source, '2024-01-10 12:00:00' AS last_updated, 'src1' AS degraded, rows, "
    f"(SELECT count(*) FROM ({sql_tokens('pub', 'id', 'location')})) AS postings FROM pub, n"
)
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots published one after the other with status and index, and the second read back through the pointer."""
    folder = shared_folder(spark, "snapshot")
    p = published(spark, sf_dir)
    status = spark.createDataFrame([("src1", True, False, None), ("src2", False, False, None)], "name string, degraded boolean, fallback_used boolean, fallback_age_hours double")
    meta = S.snapshot_meta(status, "2024-01-10 12:00:00")
    S.publish({"events": p.limit(0), "meta": meta}, folder, "first")
    S.publish({"events": p, "meta": meta}, folder, "second")
    S.write_status(status.groupBy().agg(F.count(F.lit(1)).alias("sources")), f"{folder}/status/second")
    postings = build_index(p.withColumn("pos", F.col("id").cast("long")), pos="pos", aliases=False).filter("field = 'l'")
    S.write_index(postings, f"{folder}/index")
    rows, updated = S.read_snapshot(spark, folder)
    found = S.load_snapshot(spark, folder)
    meta = found["meta"].select(F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), F.array_join("degraded_sources", ",").alias("degraded"))
    counts = found["events"].agg(F.count(F.lit(1)).alias("rows")).crossJoin(spark.read.parquet(f"{folder}/index").agg(F.count(F.lit(1)).alias("postings")))
    return rows.select("id", "title", F.col("date").cast("string").alias("date"), "source").crossJoin(F.broadcast(meta.crossJoin(counts)))  # one row


@query(
    f"WITH {PUB} SELECT count(*) AS events, count(DISTINCT id) AS ids, TRUE AS framed FROM pub"
)
def ics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export written as calendars and scanned again: all events, every file one frame around its entries."""
    folder = shared_folder(spark, "ics")
    S.write_ics(S.export_ics(published(spark, sf_dir)), folder)
    files = I.read_payloads(spark, folder).filter("length(payload) > 0")
    frames = files.select(F.regexp_count("payload", F.lit("BEGIN:VCALENDAR")).alias("b"), F.regexp_count("payload", F.lit("END:VCALENDAR")).alias("e"))
    ok = frames.agg(F.bool_and((F.col("b") == 1) & (F.col("e") == 1)).alias("framed"))
    return I.parse_ics(files).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("uid").alias("ids")).crossJoin(ok)


KEYWORD_ROWS = ", ".join("('{}', '{}')".format(c, w) for c, ws in L.KEYWORDS.items() for w in ws)
UNITS = ("Department of Music", "Simons Institute", "Cal Bears", "Nobody")
GIVEN = ("arts", "Science", "Student", "unknown")
EXTRA = ("data science talk", "grad student org mixer", "film", "go-to-market fit", "plain")


@query(
    f"WITH {PUB}, kw(category, word) AS (VALUES {KEYWORD_ROWS}), src AS (SELECT id, lower(title || ' ' || {sql_pick('doc_id', *EXTRA)}) AS title, lower(description) AS description, lower({sql_pick('doc_id', *UNITS)}) AS organizer, doc_id FROM pub), "
    "f AS (SELECT id, 10.0 AS points, title AS text FROM src UNION ALL SELECT id, 8.0, organizer FROM src UNION ALL SELECT id, 3.0, description FROM src), "
    "e AS (SELECT id, category, points * len(regexp_extract_all(text, '\\b' || word || '\\b')) AS points FROM f JOIN kw ON contains(text, word) "
    "UNION ALL SELECT id, CASE doc_id % 4 WHEN 0 THEN 'Arts' WHEN 1 THEN 'Science & Tech' ELSE 'Sports' END, 100.0 FROM src WHERE doc_id % 4 < 3 "
    "UNION ALL SELECT id, CASE doc_id % 4 WHEN 0 THEN 'Arts' WHEN 1 THEN 'Science & Tech' ELSE 'Student Life' END, 40.0 FROM src WHERE doc_id % 4 < 3), "
    f"s AS (SELECT id, category, sum(points) AS score, list_position({L.CATEGORIES!r}, category) AS place FROM e GROUP BY id, category HAVING sum(points) > 0) "
    "SELECT id, string_agg(category, ',' ORDER BY score DESC, place) AS tags, arg_min(category, {'a': -score, 'b': place}) AS category FROM s GROUP BY id "
    "UNION ALL SELECT id, '', 'Student Life' FROM pub WHERE id NOT IN (SELECT id FROM s)"
)
def category_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked tags of every row from organiser, source labels and keywords, and the category inferred from them."""
    k = F.col("id").cast("long")
    df = published(spark, sf_dir).withColumn("title", F.concat_ws(" ", "title", pick(k, *EXTRA))).withColumn("organizer", pick(k, *UNITS)).withColumn("categories", F.array(pick(k, *GIVEN)))
    return C.derive_tags(df).select("id", F.array_join("tags", ",").alias("tags"), C.infer_category("tags").alias("category"))
