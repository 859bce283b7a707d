"""Queries of refinement: validation, filters, groups, windows, sets and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import groups as G
from ..operators import rows as R
from ..sources import snapshot as S
from .common import PUB, TODAY, published, query, table

STOPS = "'a','an','the','and','or','of','in','on','at','to','for','with','by','from','is','as','vs','vs.','&'"


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical occurrence rows: a series per user and type, starts in UTC."""
    e = table(spark, sf_dir, "events")
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return R.to_canonical(
        e.select(
            F.col("event_type").alias("source_name"), F.concat_ws("-", "user_id", "event_type").alias("source_id"), F.concat(F.lit("https://example.org/"), "event_type").alias("source_url"),
            F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")).alias("canonical_url"), F.when(F.col("event_id") % 50 == 0, "x").when(F.col("event_id") % 50 == 1, "Cancelled: visit").otherwise(F.concat(F.lit("Visit "), F.col("user_id").cast("string"))).alias("title"),
            F.when(F.col("event_id") % 40 == 0, "soon").otherwise(start).alias("start_at"), F.lit("2024-01-01T00:00:00Z").alias("last_seen_at"), F.col("event_id").alias("ingest_seq"),
        )
    )


LOCAL = "CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AS DATE)"
BAD = "(event_id % 50 = 0 OR event_id % 40 = 0)"
TYPES = ["view", "signup", "error", "click", "purchase"]


@query(f"SELECT event_type AS source_name, count(*) FILTER (NOT {BAD} AND {LOCAL} >= DATE '{TODAY}') AS count, count(*) AS raw_count, count(*) FILTER (NOT {BAD} AND {LOCAL} < DATE '{TODAY}') AS filtered_past, count(*) FILTER ({BAD}) AS invalid FROM events GROUP BY event_type")
def run_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_metrics(occurrences(spark, sf_dir).withColumn("problems", R.problems(TYPES)), TODAY)


@query(f"SELECT event_id, CASE WHEN event_id % 200 = 0 THEN 'title:length,start_at:not a date or instant' WHEN event_id % 50 = 0 THEN 'title:length' ELSE 'start_at:not a date or instant' END AS problems FROM events WHERE {BAD}")
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = R.validate(occurrences(spark, sf_dir), TYPES)
    return rejects.select(F.col("ingest_seq").alias("event_id"), F.array_join("problems", ",").alias("problems"))


@query(f"SELECT event_id FROM events WHERE NOT {BAD} AND event_id % 50 <> 1 AND {LOCAL} >= DATE '{TODAY}'")
def valid_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = R.validate(occurrences(spark, sf_dir), TYPES)
    return R.drop_completed(R.drop_cancelled(R.drop_past(valid, TODAY))).select(F.col("ingest_seq").alias("event_id"))


@query(
    "SELECT event_type AS source_name, user_id || '-' || event_type AS source_id, greatest(count(DISTINCT d), 1) AS days, CASE WHEN NOT bool_or(d IS NULL) THEN CAST(min(d) AS VARCHAR) END AS first_day, CASE WHEN count(DISTINCT d) > 1 THEN CAST(max(d) AS VARCHAR) END AS end_at, "
    f"arg_min(event_id, struct_pack(d := coalesce(d, DATE '0001-01-01'), e := event_id)) AS first_event FROM (SELECT *, CASE WHEN event_id % 40 <> 0 THEN {LOCAL} END AS d FROM events) GROUP BY user_id, event_type"
)
def collapse_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with unreadable starts among theirs, which come first and are on no day."""
    out, _ = G.collapse_multi_day(occurrences(spark, sf_dir))
    first = D.local_date("start_at")
    return out.select("source_name", "source_id", F.greatest(F.coalesce(F.size("occurrence_dates"), F.lit(1)), F.lit(1)).cast("long").alias("days"), first.cast("string").alias("first_day"), "end_at", F.col("ingest_seq").alias("first_event"))


@query(f"SELECT CAST(sum(n - 1) AS BIGINT) AS rows_eliminated, count(*) FILTER (d > 1) AS multi_day_events FROM (SELECT count(*) AS n, count(DISTINCT CASE WHEN event_id % 40 <> 0 THEN {LOCAL} END) AS d FROM events GROUP BY user_id, event_type)")
def collapse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collapse_multi_day(occurrences(spark, sf_dir))[1]


NORMAL = f"array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({STOPS})), ' ')"


@query(f"SELECT {NORMAL} AS title, min(struct_pack(a := -CAST(substr(p_brand, 7) AS INT), b := p_partkey)).b AS p_partkey, count(*) - 1 AS losers FROM part GROUP BY 1")
def dedupe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("key", X.normalize_for_dedupe("p_name"))
    placed = G.pick_winner(p, ["key"], [F.expr("-cast(substring(p_brand, 7) as int)"), "p_partkey"], keep_losers=True)
    return placed.groupBy(F.col("key").alias("title")).agg(F.min_by("p_partkey", "place").alias("p_partkey"), (F.count(F.lit(1)) - 1).alias("losers"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates_removed FROM (SELECT count(*) AS n FROM documents GROUP BY source, lang, doc_id % 30)")
def dedupe_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    return G.dedupe(d, source="source", source_id="id", key=F.struct("source", "lang", (F.col("doc_id") % 30).alias("k")))[1]


@query(f"WITH d AS (SELECT DISTINCT user_id, {LOCAL} AS d FROM events), r AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM d) SELECT user_id, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, count(*) AS days FROM r GROUP BY user_id, g")
def day_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date(D.zone_time("ts")).alias("d"))
    return G.islands(e, ["user_id"], "d").select("user_id", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "days")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n <= 20")
def cap_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = G.cap_per_key(table(spark, sf_dir, "lineitem"), "l_suppkey", ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 20)
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, count(*) AS rows, l_suppkey || ' returned ' || count(*) || ' events (capped at 20)' AS reason FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20")
def cap_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.col("l_suppkey"))
    return G.cap_per_key(li, "l_suppkey", ("l_orderkey",), 20)[1].select("l_suppkey", "rows", "reason")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def global_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_position(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query("SELECT uid, event_id FROM (SELECT user_id || '@' || (event_id % 30) AS uid, event_id, row_number() OVER (PARTITION BY user_id, event_id % 30 ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) AS n FROM events) WHERE n = 1")
def merged_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("@", "user_id", (F.col("event_id") % 30).cast("string")).alias("uid"), "event_id", (F.col("event_type") != "view").cast("int").alias("feed_order"), F.col("event_id").alias("ingest_seq"))
    return G.merge_feeds(e).select("uid", "event_id")


@query(f"WITH o AS (SELECT user_id, list_sort(list(DISTINCT {LOCAL})) AS dates FROM events GROUP BY user_id) SELECT user_id, len(dates) AS n, len(list_filter(dates, lambda d: d BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 6)) AS coming, len(dates) = date_diff('day', dates[1], dates[len(dates)]) + 1 AS contiguous, len(list_filter(dates, lambda d: d >= DATE '{TODAY}')) > 0 AS future FROM o")
def run_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").select("user_id", F.to_date(D.zone_time("ts")).alias("d")).groupBy("user_id").agg(G.date_set(F.collect_list("d")).alias("dates"))
    o = o.withColumn("date", F.get("dates", F.lit(0))).withColumn("end_date", F.lit(None).cast("date"))
    return o.select("user_id", F.size("dates").cast("long").alias("n"), D.in_window("dates", TODAY).cast("long").alias("coming"), D.is_contiguous("dates").alias("contiguous"), R.has_future(TODAY).alias("future"))


@query(f"WITH {PUB} SELECT id, CASE WHEN mins IN (-1, 99999) THEN NULL ELSE CAST(floor(mins / 60) AS INT) END AS hour, CASE WHEN mins = -1 THEN 0 WHEN mins = 99999 THEN 1073741824 ELSE mins END AS minute, CASE WHEN date_diff('day', DATE '{TODAY}', date) BETWEEN 0 AND 30 THEN CAST(floor(15.0 * (1 - date_diff('day', DATE '{TODAY}', date) / 30.0) + 0.5) AS INT) ELSE 0 END AS bonus FROM pub")
def time_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).select("id", D.parse_hour("time").cast("int").alias("hour"), D.minute_of_day("time").cast("long").alias("minute"), D.recency("date", TODAY).alias("bonus"))


@query("SELECT event_id, CAST(CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AS DATE) AS VARCHAR) AS day, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%-I:%M %p') AS shown FROM events")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", D.local_date(iso).cast("string").alias("day"), D.display_time(iso, F.lit(False)).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 17 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'UTC') - epoch((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'America/Los_Angeles')) = -25200 THEN '-07:00' ELSE '-08:00' END AS iso FROM orders")
def us_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.us_datetime_to_iso(F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 05:00 pm"))).alias("iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS z FROM orders")
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.token_to_iso(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), D.with_utc_suffix(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("z"))


_BARE = "regexp_replace(m, '<[^>]+>', ' ', 'g')"
for _entity, _char in X.ENTITIES.items():
    _BARE = "replace({}, '{}', '{}')".format(_BARE, _entity, _char.replace("'", "''"))
_BARE = f"replace({_BARE}, '&amp;', '&')"


@query(
    f"WITH {PUB}, t AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '<b>' || title || '</b> &amp; more -' WHEN 1 THEN '&lt;' || title || ' &nbsp;' ELSE title END AS m FROM pub) "
    f"SELECT id, trim(regexp_replace(trim(regexp_replace(regexp_replace({_BARE}, '[<>]', '', 'g'), '\\s+', ' ', 'g')), '^[\\s\\-–—:]+|[\\s\\-–—:]+$', '', 'g')) AS title, location, CAST(date AS VARCHAR) AS date, time, CASE doc_id % 3 WHEN 0 THEN 'Arts,Sports' WHEN 1 THEN '' ELSE 'Academic' END AS tags FROM t"
)
def publish_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows as published, half of the titles with markup, tags of which some are not on the list."""
    k = F.col("id").cast("long")
    title = F.when(k % 4 == 0, F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more -"))).when(k % 4 == 1, F.concat(F.lit("&lt;"), "title", F.lit(" &nbsp;"))).otherwise(F.col("title"))
    tags = F.when(k % 3 == 0, F.array(*[F.lit(t) for t in ("Arts", "Odd", "Sports", "Arts")])).when(k % 3 == 1, F.array(F.lit("Odd"))).otherwise(F.array(F.lit("Academic")))
    p = published(spark, sf_dir)
    c = R.to_canonical(
        p.select(
            F.lit("x").alias("source_name"), F.col("id").alias("source_id"), F.col("url").alias("source_url"), F.col("url").alias("canonical_url"), title.alias("title"), "description", "organizer", tags.alias("tags"),
            F.col("date").cast("string").alias("start_at"), F.col("location").alias("venue"), F.col("time"),
        )
    )
    out = S.to_published(c)
    return out.select(F.substring(F.col("id"), F.lit(3), F.length("id")).alias("id"), "title", "location", F.col("date").cast("string").alias("date"), F.array_join("tags", ",").alias("tags")).join(p.select("id", "time"), "id")


@query("SELECT min(n_nationkey) AS pos, 'https://example.org/' || (n_nationkey % 7) AS uri, arg_max(n_name, n_nationkey) AS title FROM nation GROUP BY n_nationkey % 7")
def source_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://example.org/"), (F.col("n_nationkey") % 7).cast("string")).alias("uri"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("pos"))
    return G.source_links(n)


@query(
    "WITH a AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 3000 GROUP BY 1) "
    "SELECT a.k, array_to_string(list_sort(list_distinct(list_concat(a.s, b.s))), ',') AS both_sets, array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ',') AS only_first, array_to_string(list_filter(a.s, lambda x: list_contains(b.s, x)), ',') AS shared FROM a JOIN b USING (k)"
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    sets = lambda cond, name: c.filter(cond).groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias(name))
    j = sets("c_custkey % 2 = 0", "a").join(sets("c_custkey % 3 = 0 and c_acctbal > 3000", "b"), "k")
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return j.select("k", text(G.set_union("a", "b")).alias("both_sets"), text(G.set_minus("a", "b")).alias("only_first"), text(G.set_and("a", "b")).alias("shared"))


@query("SELECT o_orderkey, CAST(greatest(1, least(50, CAST(trunc(o_totalprice / 1000 - 20) AS INT))) AS INT) AS lim FROM orders")
def clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", R.clamp_limit((F.col("o_totalprice") / 1000 - 20).cast("string")).alias("lim"))


@query(
    f"WITH {PUB}, r AS (SELECT id, 2000 + k AS wanted FROM pub, range(1) g(k)) SELECT CAST(p_partkey AS VARCHAR) AS id, pub.source, NULL::VARCHAR AS problem FROM part LEFT JOIN pub ON CAST(p_partkey AS VARCHAR) = pub.id"
)
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return R.by_ids(published(spark, sf_dir).select("id", "source"), wanted).select("id", "source", "problem")
