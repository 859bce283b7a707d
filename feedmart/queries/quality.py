"""Queries of recovery, gates, health and the whole refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health as H
from ..plans import refresh as P
from ..plans.index import build_index
from ..registry import DDL, registry_df
from .common import TODAY, published, query, table
from .feeds import odata_rows, talk_rows
from .refine import BAD, LOCAL, TYPES, occurrences


def registry(spark: SparkSession) -> DataFrame:
    """The event types as sources: views are critical, errors are never marked."""
    rows = [(i, t, t.title(), 4 - i, 400 if t == "view" else 5, 50, t != "error", t != "click", t == "view") for i, t in enumerate(TYPES)]
    return spark.createDataFrame(rows, DDL)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per day: what each source returned that day; days of one number failed."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    failed = (F.dayofmonth("day") % 6 == 0) & F.col("name").isin("view", "click", "error")
    return e.withColumn("ok", ~failed).withColumn("error", F.when(failed, "timeout")).withColumn("filtered_past", F.lit(0).cast("long")).withColumn("invalid", F.lit(0).cast("long")).withColumn("duration_ms", F.lit(1).cast("long"))


ST = (
    "st AS (SELECT CAST(ts AS DATE) AS day, event_type AS name, count(*) AS count FROM events GROUP BY ALL), "
    "sf AS (SELECT *, NOT (day(day) % 6 = 0 AND name IN ('view', 'click', 'error')) AS ok, CASE WHEN name = 'view' THEN 400 ELSE 5 END AS expected FROM st), "
    "sd AS (SELECT *, name <> 'error' AND (NOT ok OR count < 50) AS degraded FROM sf)"
)


@query(
    f"WITH {ST} SELECT CAST(day AS VARCHAR) AS day, name, degraded, CASE WHEN degraded AND NOT ok THEN name || ' failed: timeout' WHEN degraded THEN name || ' returned ' || count || ' events (below healthy threshold 50)' END AS degraded_reason FROM sd"
)
def degraded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mark_degraded(status(spark, sf_dir), registry(spark)).select(F.col("day").cast("string").alias("day"), "name", "degraded", "degraded_reason")


@query(f"WITH {ST} SELECT name, name || ' returned ' || count || ' events (expected >= ' || expected || ')' AS message FROM sf WHERE ok AND count < expected")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.coverage_warnings(status(spark, sf_dir), registry(spark))


def _prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fresh rows, last-good rows): documents of three sources were fetched anew, save every third."""
    p = published(spark, sf_dir)
    return p.filter("source in ('src1', 'src2', 'src3') and id % 3 <> 1"), p


def _recovered(spark: SparkSession, sf_dir: str, age: float | None) -> tuple[DataFrame, DataFrame]:
    fresh, last = _prior(spark, sf_dir)
    names = [f"src{i}" for i in range(8)]
    reg = spark.createDataFrame([(i, n, n, 3, 1, 1, n != "src6", n != "src7", n == "src0") for i, n in enumerate(names)], DDL)
    counts = fresh.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    st = reg.select("name").join(counts, "name", "left").na.fill(0).withColumn("ok", F.col("count") > 0).withColumn("error", F.when(~F.col("ok"), "timeout"))
    st = st.withColumn("filtered_past", F.lit(0).cast("long")).withColumn("invalid", F.lit(0).cast("long")).withColumn("duration_ms", F.lit(1).cast("long"))
    return H.recover(fresh, last, H.mark_degraded(st, reg), TODAY, age)


@query(
    f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE (source IN ('src1', 'src2', 'src3') AND doc_id % 3 <> 1) OR (source IN ('src0', 'src4', 'src5') AND DATE '2024-01-01' + CAST(doc_id % 60 AS INT) >= DATE '{TODAY}' AND NOT regexp_matches(text, '(?i)^(canceled|cancelled|postponed|rescheduled)[:\\s]'))"
)
def recovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir, 20.0)[0].select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 3 <> 1")
def expired_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir, 90.0)[0].select("id")


@query(
    "WITH n AS (SELECT 'src' || i AS name, i FROM range(8) t(i)), c AS (SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 3 <> 1 GROUP BY source), "
    "s AS (SELECT name, coalesce(n, 0) = 0 AND i <> 6 AS degraded, i <> 7 AS allowed FROM n LEFT JOIN c ON name = source), "
    "w AS (SELECT name, name || ' failed: timeout' || CASE WHEN allowed THEN '; ' || name || ' fallback expired (90.0h old, exceeding 48h); last-good events dropped' ELSE '' END AS reason, allowed FROM s WHERE degraded) "
    "SELECT '2024-01-10 12:00:00' AS generated_at, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c) AS total_events, string_agg(reason, '; ' ORDER BY reason) AS degraded_reason, string_agg(name, ',' ORDER BY name) AS degraded, "
    "string_agg(name, ',' ORDER BY name) FILTER (allowed) AS expired, '' AS used, 0::BIGINT AS last_good_used, CASE WHEN bool_or(name = 'src0') THEN 'critical source(s) on fallback older than 48h: src0' END AS reason FROM w"
)
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's summary, and the gate's reason."""
    rows, st = _recovered(spark, sf_dir, 90.0)
    gate = H.quality_gate(st, strict=True)
    out = H.status_report(st, rows.count(), 0, "2024-01-10 12:00:00").crossJoin(gate)
    names = [F.array_join(c, ",").alias(a) for a, c in {"degraded": "degraded_sources", "expired": "stale_fallback_sources", "used": "fallback_sources"}.items()]
    return out.select(F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), "total_events", "degraded_reason", *names, "last_good_used", "reason")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status report per day, from its sources' rows."""
    s = H.mark_degraded(status(spark, sf_dir), registry(spark))
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    used = F.col("degraded") & (F.col("name") == "click")
    return s.groupBy(F.col("day").cast("string").alias("report_id"), F.col("day").cast("timestamp_ntz").alias("generated_at")).agg(
        F.sum("count").alias("total_events"), names(F.col("degraded")).alias("degraded_sources"), names(used).alias("fallback_sources"), F.max(used).alias("fallback_used"), F.max("degraded").alias("degraded"), F.lit(None).cast("string").alias("degraded_reason"),
        F.lit(None).cast("array<string>").alias("stale_fallback_sources"), F.max(F.when(used, 60.0)).alias("fallback_age_hours"), F.lit(False).alias("data_quality_blocked"), F.sum(F.when(used, F.col("count")).otherwise(0)).alias("last_good_used"), F.array_sort(F.collect_list(F.struct("name", "ok", "count"))).alias("sources"),
    )


#: All messages with their place; degraded sources come before others that failed.
MESSAGES = (
    f"WITH {ST}, r AS (SELECT CAST(day AS VARCHAR) AS report_id, day, list_concat(coalesce(list_sort(list(name) FILTER (degraded)), []), coalesce(list_sort(list(name) FILTER (NOT ok AND NOT degraded)), [])) AS deg, "
    "coalesce(list_sort(list(name) FILTER (degraded)), []) AS low, bool_or(degraded AND name = 'click') AS used, bool_or(degraded) AS degraded FROM sd GROUP BY day), "
    "h AS (SELECT *, list_contains(deg, 'view') AS bare, list_filter(deg, lambda x: x <> 'view') AS rest, date_diff('second', CAST(day AS TIMESTAMP), TIMESTAMP '2024-01-20 00:00:00') / 3600.0 AS age FROM r), "
    "m AS (SELECT report_id, 3 AS k, '' AS name, 'blocking' AS severity, 'critical source(s) degraded without fallback: view' AS message FROM h WHERE bare "
    "UNION ALL SELECT report_id, 6, '', 'blocking', 'status.json is ' || CAST(floor(age + 0.5) AS BIGINT) || 'h old (threshold 36h)' FROM h WHERE age > 36 "
    "UNION ALL SELECT report_id, 11, '', 'warning', 'non-critical source(s) degraded: ' || array_to_string(rest, ', ') FROM h WHERE len(rest) > 0 "
    "UNION ALL SELECT report_id, 13, '', 'warning', 'expired fallback dropped for: click (older than 48h)' FROM h WHERE used UNION ALL SELECT report_id, 14, '', 'warning', 'fallback data in use for: click (60h)' FROM h WHERE used "
    "UNION ALL SELECT report_id, 15, '', 'warning', 'feed marked degraded: ' || array_to_string(deg, ', ') FROM h WHERE degraded AND NOT bare "
    "UNION ALL SELECT CAST(day AS VARCHAR), 16, name, 'warning', name || ' returned ' || count || ' events (expected >= ' || expected || ')' FROM sf WHERE ok AND count < expected) "
)


@query(f"{MESSAGES} SELECT report_id, severity, message FROM m")
def health_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.evaluate_health(reports(spark, sf_dir), registry(spark), "2024-01-20 00:00:00").select("report_id", "severity", "message")


@query(f"{MESSAGES} SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY k, name) - 1 AS ord, severity, message FROM m")
def health_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.evaluate_health(reports(spark, sf_dir), registry(spark), "2024-01-20 00:00:00").withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {ST}, r AS (SELECT CAST(day AS VARCHAR) AS report_id, bool_or(degraded AND name = 'click') AS used, bool_or(degraded) AS deg FROM sd GROUP BY day) SELECT report_id, CASE WHEN used THEN 'silent' WHEN deg THEN 'warning-partial' ELSE 'silent' END AS class, deg AS stale FROM r")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).withColumn("data_age_hours", F.lit(0.0))
    return r.select("report_id", H.status_class().alias("class"), H.stale_flag().alias("stale"))


@query(
    "WITH p AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, source, doc_id % 10 < 9 AS tagged FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, string_split(text, chr(10))[1], source, doc_id % 10 < 9 FROM documents WHERE doc_id % 7 = 0 AND doc_id % 2 = 0) "
    "SELECT * FROM (SELECT 'unique ids' AS invariant, count(*) - count(DISTINCT doc_id) AS violations FROM p UNION ALL SELECT 'title', count(*) FILTER (coalesce(len(title), 0) < 2) FROM p UNION ALL SELECT 'url', 0 UNION ALL SELECT 'source', count(*) FILTER (source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')) FROM p "
    "UNION ALL SELECT 'tags', count(*) FILTER (NOT tagged) FROM p UNION ALL SELECT 'date', 0 UNION ALL SELECT 'position has one id', 0 UNION ALL SELECT 'position has a row', 0 UNION ALL SELECT 'chronological', 0 UNION ALL SELECT 'positions unique', 0 UNION ALL SELECT 'positions in range', 0 UNION ALL SELECT 'total', CASE WHEN count(*) <> 1000 THEN 1 ELSE 0 END FROM p)"
)
def snapshot_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a snapshot that lacks some tags, knows eight of its sources and misstates its size."""
    p = published(spark, sf_dir).filter("id % 7 > 0 or id % 2 = 0").withColumn("tags", F.when(F.col("id") % 10 < 9, F.array(F.lit("Arts"))).otherwise(F.array().cast("array<string>")))
    return H.check_invariants(p, build_index(p), total=1000, sources=[f"src{i}" for i in range(8)])


def _refresh(spark: SparkSession, sf_dir: str) -> P.Refresh:
    prior = published(spark, sf_dir).limit(0)
    return P.run_refresh(occurrences(spark, sf_dir), registry(spark), prior, None, TODAY, datetime(2024, 1, 10, 12))


#: The batch step by step: valid rows, upcoming ones, the cap, one row a series, one row a title and day.
REFRESH = (
    f"WITH v AS (SELECT event_id, user_id, event_type, ts, {LOCAL} AS d, {BAD} AS bad FROM events), "
    f"fut AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM v WHERE NOT bad AND d >= DATE '{TODAY}'), "
    "series AS (SELECT event_type, user_id || '-' || event_type AS sid, list_sort(list(DISTINCT d)) AS dates, arg_min(event_id, struct_pack(d := d, e := event_id)) AS first FROM fut WHERE rn <= 5000 GROUP BY event_type, user_id), "
    "named AS (SELECT s.*, v.ts, v.d AS day, CASE WHEN first % 50 = 1 THEN 'Cancelled: visit' ELSE 'Visit ' || v.user_id END AS title FROM series s JOIN v ON v.event_id = s.first), "
    f"win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, day ORDER BY list_position({TYPES!r}, event_type), event_type, sid) AS n FROM named) WHERE n = 1), "
    "pub AS (SELECT * FROM win WHERE title NOT LIKE 'Cancelled:%') "
)


@query(
    f"{REFRESH} SELECT event_type || '_' || sid AS id, title, CAST(day AS VARCHAR) AS date, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%-I:%M %p') AS time, 'Student Life' AS tags, event_type AS source, "
    "CASE WHEN len(dates) > 1 THEN CAST(dates[len(dates)] AS VARCHAR) END AS end_date, CASE WHEN len(dates) > 1 THEN len(dates) END AS n_dates FROM pub"
)
def refresh_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch over the event log: the published rows."""
    out = _refresh(spark, sf_dir).events
    day = lambda c: F.col(c).cast("string").alias(c)
    return out.select("id", "title", day("date"), "time", F.array_join("tags", ",").alias("tags"), "source", day("end_date"), F.when(F.col("dates").isNotNull(), F.size("dates")).cast("long").alias("n_dates"))


@query(
    f"{REFRESH}, m AS (SELECT event_type AS name, count(*) FILTER (NOT bad AND d >= DATE '{TODAY}') AS n, count(*) FILTER (NOT bad AND d < DATE '{TODAY}') AS past, count(*) FILTER (bad) AS invalid FROM v GROUP BY event_type), "
    "r AS (SELECT *, nullif(concat_ws('; ', CASE WHEN name <> 'error' AND n < 50 THEN name || ' returned ' || n || ' events (below healthy threshold 50)' END, CASE WHEN n > 5000 THEN name || ' returned ' || n || ' events (capped at 5000)' END), '') AS reason FROM m) "
    "SELECT '2024-01-10 12:00:00' AS generated_at, (SELECT count(*) FROM pub) AS total_events, (SELECT count(*) FROM named) - (SELECT count(*) FROM win) AS duplicates_removed, CAST(sum(past) AS BIGINT) AS past_events_filtered, CAST(sum(invalid) AS BIGINT) AS invalid_events_filtered, "
    "FALSE AS fallback_used, count(reason) > 0 AS degraded, string_agg(reason, '; ' ORDER BY reason) AS degraded_reason, coalesce(string_agg(name, ',' ORDER BY name) FILTER (reason IS NOT NULL), '') AS degraded_sources, 0::BIGINT AS last_good_used FROM r"
)
def refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the whole batch."""
    report = _refresh(spark, sf_dir).report
    return report.select(
        F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), "total_events", "duplicates_removed", "past_events_filtered", "invalid_events_filtered", "fallback_used", "degraded", "degraded_reason", F.array_join("degraded_sources", ",").alias("degraded_sources"), "last_good_used",
    )


@query(
    "WITH o AS (SELECT count(*) AS n FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 6 <> 0), t AS (SELECT count(*) FILTER (doc_id % 8 <> 0) AS n FROM documents) "
    "SELECT 'callink' AS source, least(n, 5000) AS events, '2024-02-01' AS first_day FROM o WHERE n > 0 UNION ALL SELECT 'simons', 1, '2024-02-01' FROM t WHERE n > 0"
)
def refresh_from_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed payloads of two sources through scan, union and the whole batch: talks of one title on one day are one event."""
    rows = P.land({"callink": odata_rows(spark, sf_dir), "simons": talk_rows(spark, sf_dir)}, "2024-01-10T00:00:00Z", {"callink": "https://example.org/event/"})
    run = P.run_refresh(rows, registry_df(spark), published(spark, sf_dir).limit(0), None, TODAY, datetime(2024, 1, 10, 12))
    return run.events.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.min("date").cast("string").alias("first_day"))
