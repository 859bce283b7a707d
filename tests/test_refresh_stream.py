"""The whole batch, its invariants, and the stateless operators on a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from feedmart import registry
from feedmart.operators import health as H
from feedmart.operators import rows as R
from feedmart.plans import refresh as P
from feedmart.sources import snapshot as S
from feedmart.streaming.stateless import refine_stream


def canonical(spark):
    rows = [("livewhale", f"2026062{d}T070000Z-7@h", "Open lab seminar", f"2026-06-2{d}", d) for d in range(3)]
    rows += [("haas", "1", "Startup pitch", "2026-06-21T19:00:00-07:00", 9), ("haas", "2", "Old", "2026-06-01", 10), ("haas", "3", "x", "2026-06-21", 11), ("simons", "4", "Startup Pitch!", "2026-06-21T19:00:00-07:00", 12), ("luma", "5", "Cancelled: walk", "2026-06-21", 13)]
    df = spark.createDataFrame(rows, "source_name string, source_id string, title string, start_at string, ingest_seq long")
    return R.to_canonical(df.withColumns({"source_url": F.lit("https://x.org"), "canonical_url": F.lit("https://x.org/e"), "last_seen_at": F.lit("now")}))


def test_refresh(spark, tmp_path):
    prior = spark.createDataFrame([("begin_9", "Kept", "o", dt.date(2026, 6, 30), "All day", "l", "d", ["Arts"], "https://x.org", "calbears", None, None)], S.PUBLISHED_DDL)
    now = dt.datetime(2026, 6, 20, 12)
    run = P.run_refresh(canonical(spark), registry.registry_df(spark), prior, now - dt.timedelta(hours=5), "2026-06-20", now)
    got = [r.asDict() for r in run.events.collect()]
    assert {r["id"] for r in got} == {"livewhale_7@h", "haas_1", "begin_9"}
    series = next(r for r in got if r["id"] == "livewhale_7@h")
    assert series["tags"][0] == "Academic" and len(series["dates"]) == 3 and series["end_date"] == dt.date(2026, 6, 22)
    report = run.report.first()
    assert (report.total_events, report.duplicates_removed, report.past_events_filtered, report.invalid_events_filtered, report.last_good_used) == (3, 1, 1, 1, 1)
    assert "livewhale" in report.degraded_sources and report.fallback_sources == ["calbears"] and run.refused is None
    bad = H.check_invariants(run.events, run.postings, 3).filter("violations > 0").collect()
    assert bad == []
    assert P.publish_refresh(run, str(tmp_path), "r1") and S.load_snapshot(spark, str(tmp_path))["events"].count() == 3


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    canonical(spark).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = refine_stream(stream, lambda ok, bad, n: out.append((ok.count(), bad.count()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [sum(x) for x in zip(*out, strict=True)] == [6, 1]


def test_calendars_are_bounded(spark, tmp_path):
    """One task's entries become several files of bounded size, each one frame, and all entries come back."""
    from pyspark.sql import functions as F

    from feedmart.sources import ical as I
    from feedmart.sources import snapshot as S

    rows = spark.createDataFrame([(k, ("x" * 900_000 + " ") * (8 if k == 3 else 1)) for k in range(12)], "k long, text string").coalesce(1)
    entries = rows.select(F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:u"), "k"), F.lit("DTSTART:20240201T180000Z"), F.concat(F.lit("DESCRIPTION:"), "text"), F.lit("END:VEVENT")).alias("vevent"))
    S.write_ics(entries, f"{tmp_path}/ics")
    files = [r.payload for r in I.read_payloads(spark, f"{tmp_path}/ics").collect() if r.payload]
    assert len(files) >= 4 and sorted(len(f) > 4_200_000 for f in files)[:-1] == [False] * (len(files) - 1)
    assert all(f.startswith("BEGIN:VCALENDAR\r\n") and f.endswith("END:VCALENDAR\r\n") and f.count("VCALENDAR") == 2 for f in files)
    got = I.read_ics(spark, f"{tmp_path}/ics").select("uid", F.length("description").alias("n")).collect()
    assert {r.uid: r.n for r in got} == {f"u{k}": 900_000 if k != 3 else 8 * 900_001 - 1 for k in range(12)}
