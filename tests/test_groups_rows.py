"""Facts of refinement, recovery and health, and invariance to the order of input."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedmart import registry
from feedmart.operators import classify as C
from feedmart.operators import groups as G
from feedmart.operators import health as H
from feedmart.operators import rows as R
from feedmart.sources import feeds as E
from feedmart.sources import ical as I
from feedmart.sources import snapshot as S

DAY = dt.date


def canonical(spark, rows):
    """(source, id, title, start, seq) as canonical rows."""
    df = spark.createDataFrame(rows, "source_name string, source_id string, title string, start_at string, ingest_seq long")
    return R.to_canonical(df.withColumns({"source_url": F.lit("https://x.org"), "canonical_url": F.lit("https://x.org/e"), "last_seen_at": F.lit("now")}))


def test_validation(spark):
    df = canonical(spark, [("haas", "1", "Talk", "2026-06-01", 1), ("nope", "", "T", "2026", 2), ("haas", "3", None, None, 3)])
    valid, bad = R.validate(df)
    assert [r.source_id for r in valid.collect()] == ["1"]
    got = {r.ingest_seq: r.problems for r in bad.collect()}
    assert got[2] == ["source_name:unknown source", "source_id:length", "title:length", "start_at:not a date or instant"]
    assert got[3] == ["title:length", "start_at:not a date or instant"]
    assert [r[0] for r in spark.createDataFrame([("https://a.org",), ("javascript:x",), ("ftp://a.org",), (None,)], "u string").select(R.http_url("u")).collect()] == [True, False, False, False]


def test_collapse(spark):
    rows = [("livewhale", f"2026061{d}T070000Z-7@h", "Show", f"2026-06-1{d}", d) for d in range(4)] + [("livewhale", "20260620T070000Z-8@h", "One", "2026-06-20", 9)]
    for part in (1, 3):
        out, stats = G.collapse_multi_day(canonical(spark, rows[::-1]).repartition(part))
        got = {r.source_id: (r.start_at, r.end_at, r.occurrence_dates) for r in out.collect()}
        assert got["7@h"] == ("2026-06-10", "2026-06-13", [DAY(2026, 6, 10 + d) for d in range(4)])
        assert got["20260620T070000Z-8@h"] == ("2026-06-20", None, None)
        assert [*stats.first()] == [3, 1]


def test_dedupe(spark):
    rows = [("haas", "1", "The Spring Lecture", "2026-06-01", 1), ("livewhale", "2", "Spring Lecture", "2026-06-01", 2), ("haas", "3", "!!!", "2026-06-01", 3), ("haas", "4", "???", "2026-06-01", 4), ("simons", "5", "Same", "2026-06-01", 5), ("haas", "6", "Same", "2026-06-01", 6), ("haas", "7", "Same", "2026-06-02", 7)]
    for part in (1, 4):
        out, stats = G.dedupe(canonical(spark, rows).repartition(part), registry.registry_df(spark))
        assert sorted(r.source_id for r in out.collect()) == ["2", "3", "4", "6", "7"]
        assert stats.first()[0] == 2


def test_cancelled_and_future(spark):
    df = spark.createDataFrame([("Cancelled: x",), ("x cancelled",), ("POSTPONED x",), ("rescheduledx",), (None,)], "title string")
    assert sorted(str(r.title) for r in R.drop_cancelled(df).collect()) == ["None", "rescheduledx", "x cancelled"]
    d = spark.createDataFrame([(1, DAY(2026, 6, 1), None, None), (2, DAY(2026, 6, 1), DAY(2026, 6, 25), None), (3, DAY(2026, 6, 1), None, [DAY(2026, 6, 20), None]), (4, None, None, None)], "i int, date date, end_date date, dates array<date>")
    assert [r.i for r in d.filter(R.has_future("2026-06-20")).orderBy("i").collect()] == [2, 3]


def test_limits_and_bounds(spark):
    df = spark.createDataFrame([("7",), ("0",), ("99",), ("3.9",), ("x",), (None,), ("Infinity",), ("-5",)], "v string")
    assert [r[0] for r in df.select(R.clamp_limit("v")).collect()] == [7, 1, 50, 3, 10, 10, 10, 1]
    b = spark.createDataFrame([("week", None, None), (None, DAY(2026, 7, 2), DAY(2026, 7, 1))], "p string, s date, e date").select(R.bounds(F.col("p"), F.col("s"), F.col("e"), "2026-06-20").alias("b")).collect()
    assert [*b[0].b] == [DAY(2026, 6, 20), DAY(2026, 6, 26), False] and b[1].b.invalid


def test_positions_and_islands(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    got = G.with_position(df.repartition(5), ["k"]).collect()
    assert all(r.k == r.pos for r in got) and len(got) == 1000
    days = spark.createDataFrame([("a", DAY(2026, 1, d)) for d in (1, 2, 3, 7, 7, 8)], "u string, d date")
    assert sorted((r.first.day, r.last.day, r.days) for r in G.islands(days, ["u"], "d").collect()) == [(1, 3, 3), (7, 8, 2)]


def test_classification(spark):
    rows = [("1", "Resource center reuse drive", "Student Environmental Resource Center", "", []), ("2", "Circuits", "Electrical Engineering", "", []), ("3", "zzz", "", "", []), ("4", "grad student org mixer", "", "", ["Arts"])]
    got = {r.id: r.tags for r in C.derive_tags(spark.createDataFrame(rows, "id string, title string, organizer string, description string, categories array<string>")).collect()}
    assert got["1"][0] == "Student Life" and got["2"][0] == "Science & Tech" and got["3"] == [] and got["4"] == ["Arts", "Student Life"]


def status(spark, rows):
    df = spark.createDataFrame(rows, "name string, ok boolean, count long")
    return H.mark_degraded(df.withColumns({"error": F.lit(None).cast("string"), "filtered_past": F.lit(0).cast("long"), "invalid": F.lit(0).cast("long"), "duration_ms": F.lit(0).cast("long")}), registry.registry_df(spark))


def test_recovery_and_gate(spark):
    ddl = "id string, title string, source string, date date, end_date date, dates array<date>"
    last = spark.createDataFrame([("a", "x", "haas", DAY(2026, 7, 1), None, None), ("b", "Canceled: x", "haas", DAY(2026, 7, 1), None, None), ("c", "x", "haas", DAY(2026, 6, 1), None, None), ("d", "x", "luma", DAY(2026, 7, 1), None, None), ("e", "x", "haas", DAY(2026, 7, 1), None, None)], ddl)
    fresh = spark.createDataFrame([("e", "x", "haas", DAY(2026, 7, 1), None, None)], ddl)
    st = status(spark, [("haas", False, 0), ("luma", False, 0), ("livewhale", False, 0)])
    rows, after = H.recover(fresh, last, st, "2026-06-20", 10.0)
    assert sorted(r.id for r in rows.collect()) == ["a", "e"]
    assert H.quality_gate(after, strict=True).first()[0] == "critical source(s) degraded without fallback: livewhale"
    assert H.quality_gate(after).first()[0] is None
    rows, after = H.recover(fresh, last, st, "2026-06-20", 50.0)
    assert rows.count() == 1 and H.quality_gate(after).first()[0] == "critical source(s) on fallback older than 48h: livewhale"
    assert H.refuse_empty(fresh.limit(0), st) == "all sources failed"


def test_health(spark):
    ddl = "report_id string, generated_at timestamp_ntz, total_events long, data_quality_blocked boolean, degraded boolean, degraded_reason string, degraded_sources array<string>, fallback_sources array<string>, stale_fallback_sources array<string>, fallback_used boolean, fallback_age_hours double, sources array<struct<name:string,ok:boolean,count:long>>"
    now = dt.datetime(2026, 6, 20)
    rows = [
        ("ok", now, 10, False, False, None, [], [], [], False, None, [("livewhale", True, 200)]),
        ("bare", now, 10, False, True, "r", ["livewhale"], [], [], False, None, []),
        ("supp", now, 10, False, True, "r", ["haas"], [], [], False, None, [("haas", True, 2)]),
        ("old", now - dt.timedelta(hours=40), 0, False, False, None, [], ["livewhale"], None, True, 60.5, []),
    ]
    got = {}
    for r in H.evaluate_health(spark.createDataFrame(rows, ddl), registry.registry_df(spark), now).orderBy("report_id", "ord").collect():
        got.setdefault(r.report_id, []).append((r.severity, r.message))
    assert "ok" not in got
    assert got["bare"] == [("blocking", "critical source(s) degraded without fallback: livewhale")]
    assert got["supp"] == [("warning", "non-critical source(s) degraded: haas"), ("warning", "feed marked degraded: r"), ("warning", "haas returned 2 events (expected >= 5)")]
    assert got["old"] == [("blocking", "published event count is zero"), ("blocking", "critical source(s) on fallback older than 48h: livewhale"), ("blocking", "status.json is 40h old (threshold 36h)"), ("warning", "fallback data in use for: livewhale (60.5h)")]


def test_ical(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1@x\r\nDTSTART;VALUE=DATE:20260601\r\nSUMMARY:Long\r\n  title\\, part\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2@x\r\nDTSTART;TZID=America/Los_Angeles:20260308T033000\r\nSUMMARY:[W] Game\r\nLOCATION:Town\\, CA\\, Big Arena\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    got = I.athletics_rules(I.parse_ics(spark.createDataFrame([("f", text)], "file string, payload string"))).orderBy("ingest_seq").collect()
    assert [(r.uid, r.title, r.start_at, r.all_day, r.problem) for r in got] == [("1@x", "Long title, part", "2026-06-01", True, None), ("2@x", "Game", "2026-03-08T03:30:00-07:00", False, "cancelled"), ("3", "", None, False, "no start")]
    assert got[1].venue == "Big Arena" and got[1].address == "Town, CA" and got[1].completed


def test_polymorphic_json(spark):
    df = spark.createDataFrame([('{"venue":"A"}',), ('[{"venue":"B"}]',), ("false",), (None,), ("broken",)], "v string")
    assert [r[0] for r in df.select(E.first_of("v", "venue")).collect()] == ["A", "B", None, None, None]


def test_export_and_snapshot(spark, tmp_path):
    ddl = "id string, title string, organizer string, date date, time string, location string, description string, tags array<string>, url string, source string, end_date date, dates array<date>"
    run, gap = [DAY(2026, 6, d) for d in (1, 2, 3)], [DAY(2026, 6, d) for d in (1, 5)]
    base = lambda i, time, dates: (i, "T", "o", DAY(2026, 6, 1), time, "l", "d", ["Arts"], "https://x.org", "haas", None, dates)
    df = spark.createDataFrame([base("run", "All day", run), base("gap", "All day", gap), base("late", "11:30 PM", None)], ddl)
    got = {(r.id, r.n): r.vevent.split("\r\n") for r in S.export_ics(df).collect()}
    assert len(got) == 4
    assert got["run", 0][2:4] == ["DTSTART;VALUE=DATE:20260601", "DTEND;VALUE=DATE:20260604"]
    assert got["gap", 1][2:4] == ["DTSTART;VALUE=DATE:20260605", "DTEND;VALUE=DATE:20260606"]
    assert got["late", 0][3].endswith(":20260602T003000")
    path = str(tmp_path / "pub")
    assert S.read_snapshot(spark, path)[0].count() == 0
    S.publish({"events": df}, path, "r1")
    S.publish({"events": df.filter("id = 'run'")}, path, "r2")
    assert [r.id for r in S.load_snapshot(spark, path)["events"].collect()] == ["run"]
    assert S.load_snapshot(spark, path)["meta"].first()["data_age_hours"] == 0.0


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    """The newest snapshot is read; a failing one leaves the pointer alone; no other pointer file stays."""
    from feedmart.schema import PUBLISHED_DDL
    from feedmart.sources import snapshot as S

    none = spark.createDataFrame([], PUBLISHED_DDL)
    one = spark.createDataFrame([("a", "t", "o", None, "", "", "", ["Arts"], "u", "s", None, None)], PUBLISHED_DDL)
    path = str(tmp_path / "out")
    S.publish({"events": none}, path, "r1")
    S.publish({"events": one}, path, "r2")
    assert S.current(spark, path).endswith("r2") and S.read_snapshot(spark, path)[0].count() == 1
    with pytest.raises(Exception, match="no"):
        S.publish({"events": none, "bad": one.selectExpr("raise_error('no') as x")}, path, "r3")
    assert S.current(spark, path).endswith("r2") and not (tmp_path / "out" / "snapshot=r3").exists()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("CURRENT")) == ["CURRENT"]


def test_invariants_at_block_edges(spark):
    """A day that falls back exactly where a block of positions ends is seen."""
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 1), dt.date(2024, 1, 3)]
    rows = [(str(i), "title", "https://x.org/a", "s", ["Arts"], d) for i, d in enumerate(days)]
    events = spark.createDataFrame(rows, "id string, title string, url string, source string, tags array<string>, date date")
    postings = spark.createDataFrame([("t", "w", p, str(i)) for i, p in enumerate((99_999, 100_000, 100_001))], "field string, token string, pos long, id string")
    got = {r.invariant: r.violations for r in H.check_invariants(events, postings, sources=["s"]).collect()}
    assert got["chronological"] == 1 and got["unique ids"] == 0
