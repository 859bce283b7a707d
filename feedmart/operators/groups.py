"""Operators on groups: collapse of recurring rows, dedupe, first-wins, caps, ranks, facets, day groups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import text as X


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; a task passes on one row per key, so hot keys are spread."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def merge_feeds(df: DataFrame, key: str = "uid", order: tuple[str, ...] = ("feed_order", "ingest_seq")) -> DataFrame:
    """Rows of several feeds, the first feed winning each key."""
    return first_by(df, [key], [*order])


def top_n(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def cap_per_key(df: DataFrame, key: str = "source_name", order: tuple[str, ...] = ("ingest_seq",), n: int = L.SOURCE_CAP) -> tuple[DataFrame, DataFrame]:
    """(rows within the cap in arrival order, keys that went over it with count and reason)."""
    kept = top_n(df, [key], [*order], n)
    over = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > n)
    reason = F.concat(F.col(key), F.lit(" returned "), F.col("rows").cast("string"), F.lit(f" events (capped at {n})"))
    return kept, over.withColumn("reason", reason)


def with_rank(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_position(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Global position in an order, without a window over all rows.

    Rows are range-partitioned and sorted by the order, written once to the
    checkpoint folder so that both uses see the same partitions, counted by
    partition, and numbered inside theirs from the rows before it.
    """
    from ..plans.lineage import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = counts.select("_part", (F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_n", inside).join(F.broadcast(ahead), "_part").withColumn(name, (F.col("_ahead") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_ahead")


def collapse_multi_day(
    df: DataFrame, source: str = "source_name", source_id: str = "source_id", start: str = "start_at", order: tuple[str, ...] = ("source_order", "ingest_seq"), tz: str = L.TIME_ZONE
) -> tuple[DataFrame, DataFrame]:
    """(one row per recurring event, one-row statistics).

    Rows meet by their stable key. Those on one day give their first row as it
    is; those on several give the earliest row with the stable id, ``end_at``
    of the last day and all days in ``occurrence_dates``. One aggregate does
    it: the earliest row is a minimum, so equal keys combine before the shuffle.
    """
    key = X.stable_event_key(source, source_id)
    on = D.local_date(start, tz)
    columns = df.columns
    rank = F.struct(F.coalesce(on, F.to_date(F.lit("0001-01-01"))).alias("_on"), *[F.col(c) for c in order])
    grouped = (
        df.withColumn("_key", key)
        .groupBy("_key")
        .agg(
            F.min_by(F.struct(*columns), rank).alias("_first"),
            F.array_sort(F.collect_set(on)).alias("_dates"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    many = F.size("_dates") > 1
    changed = {
        source_id: F.when(many, F.regexp_replace("_key", r"^.*?::", "")).otherwise(F.col(f"_first.{source_id}")),
        "end_at": F.when(many, F.element_at("_dates", -1).cast("string")).otherwise(F.col("_first.end_at") if "end_at" in columns else F.lit(None)),
        "occurrence_dates": F.when(many, F.col("_dates")).otherwise(F.col("_first.occurrence_dates") if "occurrence_dates" in columns else F.lit(None)),
    }
    out = grouped.select(*[changed.get(c, F.col(f"_first.{c}")).alias(c) for c in [*columns, *(x for x in changed if x not in columns)]])
    stats = grouped.agg(F.sum(F.col("_rows") - 1).alias("rows_eliminated"), F.count_if(many).alias("multi_day_events"))
    return out, stats


def dedupe_key(title: str = "title", source: str = "source_name", source_id: str = "source_id", on: Column | None = None) -> Column:
    """Normalised title and day; rows whose title normalises to nothing are only equal to themselves."""
    plain = X.normalize_for_dedupe(title)
    return F.struct(
        F.when(plain != "", plain).alias("title"), F.when(plain == "", F.col(source)).alias("source"), F.when(plain == "", F.col(source_id)).alias("id"), (D.local_date("start_at") if on is None else on).alias("on"),
    )


def dedupe(df: DataFrame, registry: DataFrame | None = None, source: str = "source_name", source_id: str = "source_id", on: Column | None = None, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(winners, one-row statistics): of rows with one key the highest priority, then source, then id. One aggregate, combined before the shuffle."""
    columns = df.columns
    if registry is not None:
        df = df.join(registry.select(F.col("name").alias("_name"), F.col("priority").alias("_priority")), F.col(source) == F.col("_name"), "left").drop("_name")
        priority = F.coalesce("_priority", F.lit(0))
    else:
        priority = F.lit(0)
    grouped = df.withColumn("_key", dedupe_key(source=source, source_id=source_id, on=on) if key is None else key).groupBy("_key")
    best = grouped.agg(F.min_by(F.struct(*columns), F.struct((-priority).alias("p"), F.col(source), F.col(source_id))).alias("_best"), F.count(F.lit(1)).alias("_rows"))
    return best.select("_best.*"), best.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicates_removed"))


def pick_winner(df: DataFrame, keys: list[str | Column], order: list[str | Column], keep_losers: bool = False) -> DataFrame:
    """Priority winner of each group; with losers kept each row tells its ``place``."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if keep_losers else ranked.filter("place = 1").drop("place")


def islands(df: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Runs of days that follow each other: ``keys, first, last, days``."""
    days = df.select(*keys, on).distinct()
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(on))
    return days.withColumn("_run", F.date_sub(F.col(on), n)).groupBy(*keys, "_run").agg(F.min(on).alias("first"), F.max(on).alias("last"), F.count(F.lit(1)).alias("days")).drop("_run")


def facets(df: DataFrame, registry: DataFrame | None = None, source: str = "source") -> DataFrame:
    """``value, label, count, ord``: all rows first, then the sources that have any in registry order."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(F.lit("All").alias("value"), F.lit("All").alias("label"), "count", F.lit(-1).alias("ord"))
    if registry is None:
        return total.unionByName(counts.select(F.col(source).alias("value"), F.col(source).alias("label"), "count", F.lit(0).alias("ord")))
    named = counts.join(registry.select("name", "label", "ord"), F.col(source) == F.col("name"))
    return total.unionByName(named.select(F.col("name").alias("value"), "label", "count", "ord"))


def bucket_flags(today: date | str, on: str = "date", week_days: int = 7) -> dict[str, Column]:
    from .rows import in_range

    return {r: in_range(r, today, on, week_days) for r in ("today", "tomorrow", "week", "upcoming")}


def bucket_counts(df: DataFrame, today: date | str, keys: list[str] | None = None, week_days: int = 7) -> DataFrame:
    """Rows in each of the overlapping buckets, by ``keys``; one pass."""
    return df.groupBy(*(keys or [])).agg(*[F.count_if(c).alias(r) for r, c in bucket_flags(today, week_days=week_days).items()])


def day_groups(df: DataFrame, order: list[str | Column], fields: list[str], on: str = "date") -> DataFrame:
    """``on, events``: the rows of a day in order, days by their key."""
    ranked = df.withColumn("_ord", F.struct(*[F.expr(o) if isinstance(o, str) else o for o in order]))
    return ranked.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.struct(*fields).alias("event")))), lambda e: e["event"]).alias("events"))


def run_metrics(df: DataFrame, today: date | str, source: str = "source_name", tz: str = L.TIME_ZONE) -> DataFrame:
    """``source, count, raw_count, filtered_past, invalid`` in one pass over rows that carry ``problems``."""
    past = D.local_date("start_at", tz) < D.day(today)
    bad = F.size("problems") > 0
    return df.groupBy(source).agg(
        F.count_if(~bad & ~F.coalesce(past, F.lit(False))).alias("count"), F.count(F.lit(1)).alias("raw_count"), F.count_if(~bad & past).alias("filtered_past"), F.count_if(bad).alias("invalid"),
    )


def recent_distinct(log: DataFrame, user: str = "user_id", query: str = "query", at: str = "ts", n: int = 8, least: int = 2) -> DataFrame:
    """Each user's latest searches, one per spelling without case, newest first with ``place``."""
    clean = log.withColumn(query, F.trim(F.col(query))).filter(F.length(query) >= least).withColumn("_low", F.lower(query))
    latest = first_by(clean, [user, "_low"], [F.col(at).desc(), query])
    return with_rank(latest, [user], [F.col(at).desc(), "_low"], "place").filter(F.col("place") <= n).drop("_low")


def suggestions(recents: DataFrame, popular: DataFrame, query: str = "query") -> DataFrame:
    """Recent searches, then popular ones that are not among them; ``kind`` tells which."""
    key = lambda df: F.lower(df[query])
    fresh = popular.join(recents.select(key(recents).alias("_k")).distinct(), key(popular) == F.col("_k"), "left_anti")
    return recents.select(query).withColumn("kind", F.lit("recent")).unionByName(fresh.select(query).withColumn("kind", F.lit("popular")))


def source_links(df: DataFrame, uri: str = "uri", title: str = "title", pos: str = "pos") -> DataFrame:
    """Links unique by address: first position, last title."""
    return df.groupBy(uri).agg(F.min(pos).alias(pos), F.max_by(title, pos).alias(title))


def set_union(a: str | Column, b: str | Column) -> Column:
    return F.array_union(a, b)


def set_minus(a: str | Column, b: str | Column) -> Column:
    return F.array_except(a, b)


def set_and(a: str | Column, b: str | Column) -> Column:
    return F.array_intersect(a, b)


def date_set(c: str | Column) -> Column:
    """Sorted distinct dates, nulls gone."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def whitelist_distinct(c: str | Column, allowed: list[str] | None = None) -> Column:
    """Distinct allowed tags in their order."""
    return F.array_distinct(F.filter(c, lambda t: t.isin(*(allowed or L.CATEGORIES))))


def primary(c: str | Column) -> Column:
    return F.get(c, F.lit(0))
