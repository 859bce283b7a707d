"""Published snapshots: written under a run id, then named by a pointer; read back with defaults."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import groups as G
from ..schema import PUBLISHED_DDL


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(tables: dict[str, DataFrame], path: str, run_id: str) -> str:
    """Writes every table under ``path/snapshot=run_id`` and then swaps ``path/CURRENT`` to it.

    Readers follow the pointer, so they see the old set or the new one whole.
    A failing write leaves the pointer alone and is raised again.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/snapshot={run_id}"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    except Exception:
        fs, p = _fs(spark, folder)
        fs.delete(p, True)
        raise
    _swap(spark, f"{path}/CURRENT", f"{path}/CURRENT.{run_id}", run_id)
    return folder


def _swap(spark: SparkSession, target: str, fresh: str, text: str) -> None:
    """Writes ``fresh`` and renames it over ``target`` in one step: there is no moment without a pointer."""
    fs, new = _fs(spark, fresh)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, hadoop.Path(target), options)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder that the pointer names, or None."""
    if not exists(spark, f"{path}/CURRENT"):
        return None
    return f"{path}/snapshot={spark.read.text(f'{path}/CURRENT').first()['value']}"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """(published rows, their time); no readable snapshot gives no rows and None."""
    folder = current(spark, path)
    if folder is None or not exists(spark, f"{folder}/events"):
        return spark.createDataFrame([], PUBLISHED_DDL), None
    meta = spark.read.parquet(f"{folder}/meta").first() if exists(spark, f"{folder}/meta") else None
    return spark.read.schema(PUBLISHED_DDL).parquet(f"{folder}/events"), meta["last_updated"] if meta else None


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Artifacts with defaults: events must be there, metadata gets age 0 and no degraded sources, status may be missing."""
    folder = current(spark, path)
    if folder is None or not exists(spark, f"{folder}/events"):
        raise ValueError("the snapshot has no events")
    meta_ddl = "last_updated timestamp_ntz, data_age_hours double, degraded_sources array<string>"
    out = {"events": spark.read.schema(PUBLISHED_DDL).parquet(f"{folder}/events")}
    meta = spark.read.schema(meta_ddl).parquet(f"{folder}/meta") if exists(spark, f"{folder}/meta") else spark.createDataFrame([(None, None, None)], meta_ddl)
    out["meta"] = meta.select("last_updated", F.coalesce("data_age_hours", F.lit(0.0)).alias("data_age_hours"), F.coalesce("degraded_sources", F.array().cast("array<string>")).alias("degraded_sources"))
    for name in ("index", "status", "sources"):
        if exists(spark, f"{folder}/{name}"):
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def snapshot_meta(status: DataFrame, now: str) -> DataFrame:
    """One row: time, age of the oldest restored data or 0, degraded sources."""
    return status.agg(
        F.lit(now).cast("timestamp_ntz").alias("last_updated"), F.coalesce(F.max(F.when(F.col("fallback_used"), F.col("fallback_age_hours"))), F.lit(0.0)).alias("data_age_hours"),
        F.array_sort(F.collect_set(F.when(F.col("degraded"), F.col("name")))).alias("degraded_sources"),
    )


def write_status(report: DataFrame, path: str) -> None:
    """One JSON line; written on refusal and block too."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings by field, sorted by token inside files, so that a token's look-up skips most of them."""
    postings.repartitionByRange("field", "token", "pos").sortWithinPartitions("field", "token", "pos").write.partitionBy("field").mode("overwrite").parquet(path)


def to_published(df: DataFrame) -> DataFrame:
    """Canonical rows as they are published; tags are the whitelisted ones, and may be empty until ``with_tags``."""
    L = X.L
    filled = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    many = F.coalesce(F.size("occurrence_dates"), F.lit(0)) > 1
    dates = G.date_set("occurrence_dates")
    return df.select(
        F.concat_ws("_", "source_name", "source_id").alias("id"), X.clean_title("title").alias("title"), F.coalesce(filled("organizer"), filled("organizer_unit"), F.lit(L.DEFAULT_ORGANIZER)).alias("organizer"),
        D.local_date("start_at").alias("date"), D.display_time("start_at", "all_day").alias("time"),
        F.coalesce(F.nullif(F.concat_ws(" — ", filled("venue"), filled("building")), F.lit("")), filled("address"), F.lit(L.DEFAULT_LOCATION)).alias("location"),
        X.sanitize_plain_text(F.coalesce(filled("description"), F.col("title"))).alias("description"), G.whitelist_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        F.coalesce(filled("canonical_url"), F.col("source_url")).alias("url"), F.col("source_name").alias("source"),
        F.when(many, F.coalesce(D.local_date("end_at"), F.element_at(dates, -1))).alias("end_date"), F.when(many, dates).alias("dates"),
    )


def with_tags(published: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows without tags get the derived ones, or the default category where nothing speaks for any."""
    from ..operators.classify import derive_tags

    evidence = canonical.select(F.concat_ws("_", "source_name", "source_id").alias("id"), "title", "organizer", "description", "categories", F.size("tags").alias("_given"))
    derived = derive_tags(evidence.filter("_given = 0")).withColumnRenamed("tags", "_derived")
    joined = published.join(derived, "id", "left")
    best = F.when(F.size("tags") > 0, F.col("tags")).when(F.coalesce(F.size("_derived"), F.lit(0)) > 0, F.col("_derived")).otherwise(F.array(F.lit(X.L.DEFAULT_CATEGORY)))
    return joined.withColumn("tags", best).select(*published.columns)


def _stamp(c: Column, with_time: bool) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss" if with_time else "yyyyMMdd")


def export_ics(df: DataFrame, tz: str = X.L.TIME_ZONE) -> DataFrame:
    """``id, n, vevent``: contiguous all-day runs as one spanning entry, other runs as one per date; CRLF lines."""
    dates = F.coalesce(F.when(F.size("dates") > 0, G.date_set("dates")), F.array("date"))
    all_day = F.coalesce(F.col("time"), F.lit("")).rlike(r"(?i)all\s*day")
    span = all_day & (F.size(dates) > 1) & D.is_contiguous(dates)
    rows = df.withColumn("_d", dates).withColumn("_span", span).withColumn("_e", F.when(span, F.array(F.element_at(dates, 1))).otherwise(dates))
    rows = rows.select("id", "title", "description", "location", "url", "time", "_span", F.element_at("_d", -1).alias("_last"), F.posexplode("_e").alias("n", "_on"))
    w = D.export_window("time", "_on")
    end = F.when(F.col("_span"), F.date_add("_last", 1).cast("timestamp_ntz")).otherwise(w["end"])
    when = lambda name, c: F.when(w["all_day"], F.concat(F.lit(f"{name};VALUE=DATE:"), _stamp(c, False))).otherwise(F.concat(F.lit(f"{name};TZID={tz}:"), _stamp(c, True)))
    line = lambda name, c: F.concat(F.lit(f"{name}:"), X.ics_escape(F.coalesce(c, F.lit(""))))
    vevent = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id", F.lit("-"), F.col("n").cast("string")), when("DTSTART", w["start"]), when("DTEND", end), line("SUMMARY", F.col("title")), line("DESCRIPTION", F.col("description")), line("LOCATION", F.col("location")), F.concat(F.lit("URL:"), F.coalesce("url", F.lit(""))), F.lit("END:VEVENT"))
    return rows.select("id", "n", vevent.alias("vevent"))


def write_ics(entries: DataFrame, path: str, most: int = 1 << 22) -> None:
    """Calendars of about ``most`` characters, a file each: one frame around its entries, as text with CRLF lines.

    A calendar is read back whole, so its size is bounded whatever a task
    holds; an entry is never cut, and a longer one has a calendar of its own.
    """
    head, foot = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//events//EN\r\n", "END:VCALENDAR\r"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calendar = lambda values: pa.RecordBatch.from_arrays([pa.array([f"{head}{''.join(values)}{foot}"], pa.string())], names=["value"])
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                text = f"{value.as_py()}\r\n"
                if held and size + len(text) > most:
                    yield calendar(held)
                    held, size = [], 0
                held.append(text)
                size += len(text)
        if held:
            yield calendar(held)

    entries.select("vevent").mapInArrow(framed, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
