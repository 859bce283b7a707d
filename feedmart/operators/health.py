"""Degradation, recovery, gates and health of runs, as tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from .rows import drop_cancelled, has_future

STRINGS = "array<string>"


def ts(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def age_text(c: Column) -> Column:
    """Hours as text, whole ones without decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def mark_degraded(status: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``degraded`` and ``degraded_reason``: failed, or below its healthy count; sources that are not to be marked never are."""
    reg = registry.select(F.col("name").alias("_n"), "min_healthy", "degrade_on_failure", "allow_last_good", "critical")
    df = status.join(reg, F.col("name") == F.col("_n"), "left").drop("_n")
    low = F.col("ok") & (F.col("count") < F.col("min_healthy"))
    reason = F.when(~F.col("ok"), F.concat("name", F.lit(" failed: "), F.coalesce("error", F.lit("unknown error")))).otherwise(
        F.concat("name", F.lit(" returned "), F.col("count").cast("string"), F.lit(" events (below healthy threshold "), F.col("min_healthy").cast("string"), F.lit(")"))
    )
    hit = (~F.col("ok") | F.coalesce(low, F.lit(False))) & F.coalesce("degrade_on_failure", F.lit(False))
    return df.withColumn("degraded", hit).withColumn("degraded_reason", F.when(hit, reason))


def for_sources(last_good: DataFrame, degraded: DataFrame, source: str = "source") -> DataFrame:
    """Rows of the sources that need recovery."""
    return last_good.join(degraded.select(F.col("name").alias(source)).distinct(), source, "left_semi")


def only_missing(last_good: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not among the fresh ones."""
    return last_good.join(fresh.select(key), key, "left_anti")


def union_recovered(fresh: DataFrame, restored: DataFrame) -> DataFrame:
    return fresh.unionByName(restored.select(*fresh.columns))


def recover(fresh: DataFrame, last_good: DataFrame, status: DataFrame, today: date | str, age: float | None, max_age: float = L.MAX_FALLBACK_HOURS) -> tuple[DataFrame, DataFrame]:
    """(fresh and restored rows, status with what was restored).

    ``status`` comes from ``mark_degraded``; ``age`` is the prior snapshot's
    age in hours or None. Too old a snapshot restores nothing and marks the
    sources expired; else a degraded source gets back its future, uncancelled
    rows that are not there already.
    """
    old = age is not None and age > max_age
    asked = F.col("degraded") & F.coalesce("allow_last_good", F.lit(False))
    status = status.withColumn("fallback_expired", asked & F.lit(old))
    if old:
        restored = last_good.limit(0)
    else:
        usable = drop_cancelled(last_good.filter(has_future(today)))
        restored = only_missing(for_sources(usable, status.filter(asked)), fresh)
    counts = restored.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("fallback_count"))
    status = status.join(counts, F.col("name") == F.col("_s"), "left").drop("_s")
    status = status.withColumn("fallback_count", F.coalesce("fallback_count", F.lit(0).cast("long"))).withColumn("fallback_used", F.col("fallback_count") > 0)
    status = status.withColumn("fallback_age_hours", F.when(F.col("fallback_used") | F.col("fallback_expired"), F.lit(age).cast("double")))
    expired = F.concat("name", F.lit(f" fallback expired ({age}h old, exceeding {max_age:g}h); last-good events dropped"))
    status = status.withColumn("degraded_reason", F.when(F.col("fallback_expired"), F.concat_ws("; ", "degraded_reason", expired)).otherwise(F.col("degraded_reason")))
    return union_recovered(fresh, restored), status


def status_report(status: DataFrame, total: int | Column, duplicates: int | Column, now: datetime | str, publish_reason: str | None = None, blocked: bool = False) -> DataFrame:
    """One row that sums a run up, its sources nested."""
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("name"))))
    reasons = F.array_sort(F.collect_set("degraded_reason"))
    sources = F.array_sort(F.collect_list(F.struct("name", "ok", "count", "duration_ms", "degraded", "fallback_used", "fallback_count")))
    df = status.agg(
        F.sum("filtered_past").alias("past_events_filtered"), F.sum("invalid").alias("invalid_events_filtered"), F.sum("fallback_count").alias("last_good_used"),
        F.max(F.when(F.col("fallback_used"), F.col("fallback_age_hours"))).alias("fallback_age_hours"), names(F.col("fallback_used")).alias("fallback_sources"),
        names(F.col("degraded")).alias("degraded_sources"), names(F.col("fallback_expired")).alias("stale_fallback_sources"), reasons.alias("_reasons"), sources.alias("sources"),
    )
    every = F.concat("_reasons", F.array(F.lit(publish_reason)) if publish_reason else F.array().cast(STRINGS))
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        ts(now).alias("generated_at"), value(total).cast("long").alias("total_events"), value(duplicates).cast("long").alias("duplicates_removed"), "past_events_filtered", "invalid_events_filtered",
        "sources", (F.lit(publish_reason is not None) | (F.size("fallback_sources") > 0)).alias("fallback_used"), (F.size(every) > 0).alias("degraded"),
        F.nullif(F.array_join(every, "; "), F.lit("")).alias("degraded_reason"), "last_good_used", "fallback_age_hours", F.lit(blocked).alias("data_quality_blocked"), "fallback_sources", "degraded_sources", "stale_fallback_sources",
    )


def quality_gate(status: DataFrame, strict: bool = False, max_age: float = L.MAX_FALLBACK_HOURS) -> DataFrame:
    """One row with ``reason`` why publishing is blocked, or null."""
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("name")))), ", ")
    critical = F.coalesce("critical", F.lit(False))
    df = status.agg(
        names(critical & F.col("fallback_expired")).alias("_stale"), names(critical & F.col("degraded") & ~F.col("fallback_used")).alias("_bare"), names(critical & F.col("degraded")).alias("_low"),
        F.max(F.col("fallback_used")).alias("_used"), F.max("fallback_age_hours").alias("_age"),
    )
    reason = F.when(F.col("_stale") != "", F.concat(F.lit(f"critical source(s) on fallback older than {max_age:g}h: "), "_stale"))
    if strict:
        reason = reason.when(F.col("_bare") != "", F.concat(F.lit("critical source(s) degraded without fallback: "), "_bare"))
        reason = reason.when((F.col("_low") != "") & F.col("_used") & F.col("_age").isNull(), "fallback data age is unknown")
    return df.select(reason.alias("reason"))


def refuse_empty(published: DataFrame, status: DataFrame) -> str | None:
    """Why an empty result must not replace the last snapshot, or None."""
    if not published.isEmpty():
        return None
    return "sources produced 0 events" if status.filter("ok").count() else "all sources failed"


def coverage_warnings(status: DataFrame, registry: DataFrame) -> DataFrame:
    """``name, message`` of good sources below their expected count."""
    reg = registry.select(F.col("name").alias("_n"), "expected_min")
    low = status.join(reg, F.col("name") == F.col("_n")).filter(F.col("ok") & (F.col("count") < F.col("expected_min")) & (F.col("expected_min") > 0))
    return low.select("name", F.concat("name", F.lit(" returned "), F.col("count").cast("string"), F.lit(" events (expected >= "), F.col("expected_min").cast("string"), F.lit(")")).alias("message"))


def evaluate_health(reports: DataFrame, registry: DataFrame, now: datetime | str, max_age: float = L.MAX_FALLBACK_HOURS, stale_hours: float = L.STALE_STATUS_HOURS) -> DataFrame:
    """``report_id, ord, severity, message``: what is wrong with each of a table of status reports.

    Reports have ``report_id`` and the columns of ``status_report`` (sources as
    array of struct with name, ok, count); an absent
    ``stale_fallback_sources`` is null and takes the older rule by age.
    """
    critical = [r["name"] for r in registry.filter("critical").select("name").collect()]  # a few names of the registry
    crit = F.array(*[F.lit(n) for n in critical]) if critical else F.array().cast(STRINGS)
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(STRINGS))
    failed = F.transform(F.filter(F.coalesce(F.col("sources"), F.array()), lambda s: ~F.coalesce(s["ok"], F.lit(True))), lambda s: s["name"])
    df = reports.withColumn("_deg", F.array_union(arr("degraded_sources"), F.array_compact(failed))).withColumn("_fb", arr("fallback_sources")).withColumn("_stale", arr("stale_fallback_sources"))
    both = lambda a, b: F.array_intersect(a, b)
    less = lambda a, b: F.array_except(a, b)
    said = lambda text, a, tail="": F.when(F.size(a) > 0, F.concat(F.lit(text), F.array_join(a, ", "), F.lit(tail)))
    hours = F.timestamp_diff("SECOND", F.col("generated_at").cast("timestamp_ntz"), ts(now)) / 3600
    older = F.coalesce("fallback_used", F.lit(False)) & F.col("stale_fallback_sources").isNull() & F.coalesce(F.col("fallback_age_hours") > max_age, F.lit(False))
    used_by = F.when(F.size("_fb") > 0, F.array_join("_fb", ", ")).otherwise("unknown")
    age = F.coalesce(F.concat(age_text(F.col("fallback_age_hours")), F.lit("h")), F.lit("unknown"))
    m = f"{max_age:g}"
    blocking = [
        F.when(F.coalesce("data_quality_blocked", F.lit(False)), "data quality gate blocked publishing fresh events"),
        F.when(F.coalesce("total_events", F.lit(0)) <= 0, "published event count is zero"),
        said("critical source(s) degraded without fallback: ", less(both(F.col("_deg"), crit), F.col("_fb"))),
        said(f"critical source(s) on fallback older than {m}h: ", both(F.col("_stale"), crit)),
        F.when(older, said(f"critical source(s) on fallback older than {m}h: ", both(F.col("_fb"), crit))),
        F.when(hours > stale_hours, F.concat(F.lit("status.json is "), F.floor(hours + 0.5).cast("string"), F.lit(f"h old (threshold {stale_hours:g}h)"))),
        F.when(F.col("generated_at").isNull(), "status.json missing a valid generated_at timestamp"),
    ]
    # The general mark of degradation is only worth a warning where nothing blocks before the age checks.
    before_age = F.size(F.array_compact(F.array(*blocking[:5]))) == 0
    expected = F.create_map(*[F.lit(x) for r in registry.select("name", "expected_min").collect() for x in (r["name"], r["expected_min"])])  # the registry's rows
    low = F.filter(F.coalesce(F.col("sources"), F.array()), lambda s: F.coalesce(s["ok"] & (s["count"] < F.try_element_at(expected, s["name"])), F.lit(False)))
    coverage = F.transform(low, lambda s: F.concat(s["name"], F.lit(" returned "), s["count"].cast("string"), F.lit(" events (expected >= "), F.try_element_at(expected, s["name"]).cast("string"), F.lit(")")))
    warnings = [
        said("critical source(s) recovered via fallback: ", both(both(F.col("_deg"), crit), F.col("_fb"))),
        said("non-critical source(s) degraded: ", less(F.col("_deg"), crit)),
        said("expired fallback dropped for: ", less(F.col("_stale"), crit), f" (older than {m}h)"),
        F.when(older, said("expired fallback dropped for: ", less(F.col("_fb"), crit), f" (older than {m}h)")),
        F.when(F.coalesce("fallback_used", F.lit(False)), F.concat(F.lit("fallback data in use for: "), used_by, F.lit(" ("), age, F.lit(")"))),
        F.when(F.coalesce("degraded", F.lit(False)) & before_age, F.concat(F.lit("feed marked degraded: "), F.coalesce("degraded_reason", F.nullif(F.array_join("_deg", ", "), F.lit("")), F.lit("unknown")))),
    ]
    rows = lambda kind, messages: F.transform(F.array_compact(messages), lambda t: F.struct(F.lit(kind).alias("severity"), t.alias("message")))
    every = F.concat(rows("blocking", F.array(*blocking)), rows("warning", F.concat(F.array(*warnings), coverage)))
    return df.select("report_id", F.posexplode(every).alias("ord", "x")).select("report_id", "ord", "x.severity", "x.message")


def status_class() -> Column:
    """How a report is shown: nothing if recovered and not blocked, else fresh or partial warnings."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    restored = F.coalesce("last_good_used", F.lit(0)) > 0
    return (
        F.when(flag("fallback_used") & ~flag("data_quality_blocked") & restored, "silent")
        .when(flag("fallback_used"), "warning-fresh")
        .when(flag("degraded") | restored, "warning-partial")
        .otherwise("silent")
    )


def stale_flag(age: str = "data_age_hours", degraded: str = "degraded_sources") -> Column:
    """Whether shown data is old or lacks a source."""
    return (F.coalesce(F.col(age), F.lit(0.0)) > L.STALE_DATA_HOURS) | (F.coalesce(F.size(degraded), F.lit(0)) > 0)


def check_invariants(events: DataFrame, postings: DataFrame, total: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """``invariant, violations`` of a published snapshot; all are zero when it is sound."""
    from pyspark.sql import Window

    from .rows import http_url

    known = sources or [s[0] for s in L.SOURCES]
    ids = events.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("unique ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"))
    bad = {
        "title": F.length("title") < 2,
        "url": ~http_url("url"),
        "source": ~F.col("source").isin(*known),
        "tags": (F.coalesce(F.size("tags"), F.lit(0)) == 0) | ~F.coalesce(F.get("tags", F.lit(0)).isin(*L.CATEGORIES), F.lit(False)),
        "date": F.col("date").isNull(),
    }
    rows = events.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in bad.items()])
    placed = postings.groupBy("pos").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    joined = placed.join(events.select("id", "date"), "id", "left")
    block = F.floor(F.col("pos") / 100_000)
    day_before = F.lag("date").over(Window.partitionBy("_block").orderBy("pos"))
    joined = joined.withColumn("_block", block)
    # Days are compared inside blocks, and each block's first day with the last one before it: one row per block.
    ends = joined.filter("date is not null").groupBy("_block").agg(F.min_by("date", "pos").alias("_first_day"), F.max_by("date", "pos").alias("_last_day"))
    edges = ends.withColumn("_before", F.lag("_last_day").over(Window.orderBy("_block"))).agg(F.count_if(F.col("_before") > F.col("_first_day")).alias("_edges"))
    index = joined.withColumn("_before", day_before).agg(
        F.count_if(F.col("id") != F.col("other")).alias("position has one id"), F.count_if(F.col("date").isNull()).alias("position has a row"), F.count_if(F.col("_before") > F.col("date")).alias("chronological"),
        F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"), F.coalesce(F.min("pos"), F.lit(0)).alias("_first"),
    )
    twice = postings.groupBy("field", "token", "pos").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("positions unique"))
    one = ids.crossJoin(rows).crossJoin(index).crossJoin(twice).crossJoin(edges).withColumn("chronological", F.col("chronological") + F.col("_edges"))  # one row each
    one = one.withColumn("positions in range", ((F.col("_last") >= F.col("_rows")) | (F.col("_first") < 0)).cast("long"))
    one = one.withColumn("total", (F.lit(total) != F.col("_rows")).cast("long") if total is not None else F.lit(0).cast("long"))
    names = ["unique ids", *bad, "position has one id", "position has a row", "chronological", "positions unique", "positions in range", "total"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(f"`{n}`").cast("long").alias("violations")) for n in names])).alias("x")).select("x.*")
