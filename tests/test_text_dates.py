"""Facts of text and date functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from feedmart import lexicons as L
from feedmart.functions import dates as D
from feedmart.functions import text as X
from feedmart.plans import browse as B
from feedmart.plans.search import lexicon_tokens


def one(spark, *columns):
    return [*spark.range(1).select(*columns).first()]


def test_tokens_and_stems(spark):
    got = one(spark, X.tokenize(F.lit("Müller COVID-19 research running stopped classes")), X.tokenize(F.lit("The & of!")), X.tokenize(F.lit(None).cast("string")))
    assert got == [["muller", "covid", "19", "research", "run", "stop", "class"], [], []]
    assert one(spark, X.tokenize(F.lit("ﬁlm ½"), full=True)) == [["film"]]


def test_lexicon_stems_agree(spark):
    words = sorted({w for ws in [*L.SYNONYMS.values(), *L.KEYWORDS.values()] for w in ws if w.isalpha()})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.tokenize("w").alias("t")).collect()
    assert all(r.t == lexicon_tokens(r.w) for r in got)


def test_dedupe_titles(spark):
    assert one(spark, X.normalize_for_dedupe(F.lit("The Spring Lecture of Music")), X.normalize_for_dedupe(F.lit("The & Of !!!"))) == ["spring lecture music", ""]


def test_html(spark):
    html = "<script>x<y</script><p>5 < 6 &amp; 7 > 2</p><b>ok</b>"
    assert one(spark, X.strip_html(F.lit(html)), X.clean_title(F.lit(" – <i>A &amp; B</i>: "))) == ["5 < 6 & 7 > 2 ok", "A & B"]
    assert one(spark, X.sanitize_plain_text(F.lit("caf&eacute; <b>x</b>"), full=True)) == ["café x"]
    assert one(spark, X.decode_ics(F.lit(r"a\, b\n<b>c</b>\; d"))) == ["a, b c ; d"]
    assert one(spark, X.ics_escape(F.lit("a;b,c\\d\ne"))) == ["a\\;b\\,c\\\\d\\ne"]


def test_keys_units_tags(spark):
    key = lambda s, i: X.stable_event_key(F.lit(s), F.lit(i))
    assert one(spark, key("livewhale", "20260615T070000Z-309080@h"), key("bampfa", "open-art-lab-june-2026::2026-06-04"), key("haas", "a::2026-06-04")) == ["livewhale::309080@h", "bampfa::open-art-lab", "haas::a::2026-06-04"]
    assert one(spark, X.unit_from_slug(F.lit("eecs"), {}), X.unit_from_slug(F.lit("public-health"), {}), X.unit_from_slug(F.lit("Lib"), {"lib": "Library"})) == ["EECS", "Public Health", "Library"]
    assert one(spark, X.unit_from_url(F.lit("https://x.org/live/e/1"), {})["unit"], X.canonical_tag(F.lit("Martial arts"))) == [L.DEFAULT_ORGANIZER, "Arts"]
    assert one(spark, X.categorize_theme(F.lit("Arts"), F.array(F.lit("research talk"), F.lit("zzz"))), X.categorize_theme(F.lit("x"), F.array(F.lit("zzz")))) == [["Arts", "Academic"], ["Student Life"]]


def test_template_links(spark):
    ok = "https://c.example/render?text=Film+Night&dates=20260308T013000/20260308T033000&details=see+https%3A%2F%2Fx.org%2Fa&location=Hall"
    got = one(spark, X.parse_template_link(F.lit(ok)), X.parse_template_link(F.lit("https://c.example/render?text=a&dates=2026")), X.parse_template_link(F.lit("https://c.example/render?dates=20260101/20260102")))
    assert got[0].title == "Film Night" and got[0].url == "https://x.org/a" and got[1:] == [None, None]


def test_local_dates(spark):
    assert one(spark, D.local_date(F.lit("2026-04-28T06:30:00Z")), D.local_date(F.lit("2026-04-28")), D.local_date(F.lit("2026-02-30")), D.local_date(F.lit("x"))) == [dt.date(2026, 4, 27), dt.date(2026, 4, 28), None, None]
    assert one(spark, D.display_time(F.lit("2026-06-01T19:00:00-07:00"), F.lit(False)), D.display_time(F.lit("bad"), F.lit(False)), D.display_time(F.lit("2026-06-01"), F.lit(False))) == ["7:00 PM", "TBD", "All day"]


def test_clock_changes(spark):
    tokens = ["20260308T013000", "20260308T033000", "20261101T013000", "20260308T023000", "20260301", "20260308T999999", "2026"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(D.token_to_iso("t")).collect()]
    assert got == ["2026-03-08T01:30:00-08:00", "2026-03-08T03:30:00-07:00", "2026-11-01T01:30:00-08:00", "2026-03-08T02:30:00-07:00", "2026-03-01", None, None]
    assert one(spark, D.us_datetime_to_iso(F.lit("04/17/2026 05:30 pm"))) == ["2026-04-17T17:30:00-07:00"]


def test_times(spark):
    assert one(spark, D.minute_of_day(F.lit("7:05 PM")), D.minute_of_day(F.lit("All day"), 1440), D.minute_of_day(F.lit("13:00 PM"), 0, 9999), D.parse_hour(F.lit("12 am"))) == [1145, 1440, 9999, 0]
    assert one(spark, D.weekend_days("2026-06-21"), D.recency(F.to_date(F.lit("2026-06-22")), "2026-06-20")) == [[dt.date(2026, 6, 20), dt.date(2026, 6, 21)], 14]
    w = one(spark, D.export_window(F.lit("11:30 PM"), F.to_date(F.lit("2026-01-01"))))[0]
    assert w.end == dt.datetime(2026, 1, 2, 0, 30)
    assert one(spark, D.age_hours(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2026-01-02 01:03:00").cast("timestamp_ntz")), D.with_utc_suffix(F.lit("2026-01-01 10:00:00"))) == [25.1, "2026-01-01T10:00:00Z"]


def test_url_state(spark):
    got = one(spark, B.parse_state(F.lit("https://x.org/?date=week&q=+jazz+night+&category=Nope&source=src1"), ["Arts"], ["src1"]))[0]
    assert (got.date_range, got.query, got.category, got.source, got.explicit) == ("week", "jazz night", "All", "src1", True)
    assert one(spark, B.build_state(F.lit("week"), F.lit("a b"), F.lit("All"), F.lit("src1"))) == ["date=week&q=a+b&source=src1"]


def test_stems_in_two_passes(spark):
    """Stems are those of the plain rule, and no ending is looked for more than twice in a word."""
    from feedmart.functions import text as X
    from feedmart.plans.search import _stem_word

    words = sorted({a + b for a in ("x", "ab", "run", "runn", "class", "fizz", "stor", "bus", "éclai", "speed") for b in ("", "s", "ss", "us", "sses", "ies", "ing", "ings", "ed", "eds", "nning", "tted", "inged")})
    df = spark.createDataFrame([(" ".join(words),)], "text string").select(X.tokenize("text").alias("t"))
    kept = list(dict.fromkeys(_stem_word(w) for w in words if len(w) >= 2 and w not in X.L.STOP_WORDS))
    folded = [w.replace("é", "e") for w in kept]
    assert df.first().t == list(dict.fromkeys(w for w in folded if len(w) >= 2))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("endswith(") <= 10
