"""Browsing and the tool's search: requests against events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import rows as R
from ..operators.groups import top_n, with_rank
from .grams import holding
from .intervals import runs_of_day, runs_of_range
from .lineage import cut
from .search import search

RANGES = ["today", "tomorrow", "week", "upcoming"]


def title_key(c: str = "title") -> Column:
    """Titles in the order of a reader's language instead of code points."""
    return F.collate(F.col(c), "UNICODE")


def publish_keys() -> list[Column]:
    """Day, minute with all-day first, title, id."""
    return [F.col("date"), D.minute_of_day("time", 0), title_key(), F.col("id")]


def publish_order() -> list[Column]:
    return [c.asc_nulls_last() for c in publish_keys()]


def browse_order() -> list[Column]:
    """Day, minute with all-day behind timed rows and unreadable ones last, title."""
    return [F.col("date").asc_nulls_last(), D.minute_of_day("time", 24 * 60).asc(), title_key().asc(), F.col("id").asc()]


def tool_order() -> list[Column]:
    """Day, minute with all-day first, title."""
    return [F.col("date").asc_nulls_last(), D.minute_of_day("time", 0).asc(), title_key().asc(), F.col("id").asc()]


def tool_search(requests: DataFrame, events: DataFrame, today: date | str, by_title: bool = True) -> DataFrame:
    """``request_id, rank`` and the tool's columns, up to each request's limit; requests whose days contradict each other give one row with ``error``.

    Requests have ``request_id, query, category, source, preset, start, end,
    limit``. Those of one text, category and source ask for one kind of event,
    so events meet kinds, not requests: by source, else by category, else by
    the text's grams. Of a kind only the first rows of each day go on, no more
    than the highest limit, and requests meet the runs that make up their days
    (``first_of_days``); no request is compared with every event. Without
    ``by_title`` rows of one minute come in the order of their ids, which are
    unique.
    """
    req = requests.withColumn("_b", R.bounds(F.col("preset"), F.col("start"), F.col("end"), today)).withColumn("_limit", R.clamp_limit("limit"))
    req = req.select("request_id", F.lower(F.coalesce("query", F.lit(""))).alias("q_text"), F.lower(F.coalesce("category", F.lit(""))).alias("q_category"), F.coalesce("source", F.lit("")).alias("q_source"), "_b", "_limit")
    valid, kind = req.filter("not _b.invalid"), ["q_text", "q_category", "q_source"]
    kinds = cut(valid.select(*kind).distinct())
    shown = ["id", "title", "date", "time", "location", "organizer", "tags", "source", "url"]
    rows, texts = events.select(*shown), events.select(*shown, R.haystack().alias("_text"))
    tagged = texts.withColumn("_tag", F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(t)))))
    held_text = F.col("_text").contains(F.col("q_text"))
    of_source = kinds.filter("q_source <> ''").join(texts, (F.col("source") == F.col("q_source")) & held_text & ((F.col("q_category") == "") | R.has_tag(F.col("q_category"))))
    of_category = kinds.filter("q_source = '' and q_category <> ''").join(tagged, (F.col("_tag") == F.col("q_category")) & held_text)
    others = kinds.filter("q_source = '' and q_category = ''")
    held = holding(others.select("q_text", F.col("q_text").alias("_asked_text")), events, "q_text", "_asked_text", "id", R.haystack())
    by_text = others.join(held, "q_text").join(rows, "id")
    blank = rows.crossJoin(F.broadcast(others.filter("q_text = ''")))  # one row
    members = of_source.select(*kind, *shown).unionByName(of_category.select(*kind, *shown)).unionByName(by_text.select(*kind, *shown)).unionByName(blank.select(*kind, *shown))
    order = [c for i, c in enumerate(tool_order()) if by_title or i != 2]
    found = first_of_days(valid, members, kind, order)
    matched = F.get(F.filter("tags", lambda t: F.lower(t) == F.col("q_category")), F.lit(0))
    shown = found.select("request_id", "rank", "id", "title", "date", "time", "location", "organizer", F.coalesce(matched, F.get("tags", F.lit(0))).alias("category"), matched.alias("matched_category"), "tags", "source", "url", F.lit(None).cast("string").alias("error"))
    bad = req.filter("_b.invalid").select("request_id", F.lit("startDate must be earlier than or equal to endDate").alias("error"))
    return shown.unionByName(bad, allowMissingColumns=True)


def first_of_days(requests: DataFrame, members: DataFrame, kind: list[str], order: list[Column], most: int = 50) -> DataFrame:
    """``request_id, rank`` and the columns of ``members``: the first ``_limit`` rows, ``most`` at most, of a request's kind and days ``_b.first`` to ``_b.last``.

    The first rows of a range of days are among the first of the runs of days
    that make it up, and those of a run among the first of its days. So each
    day of a kind keeps ``most`` rows, numbered in the order; requests meet
    them by run and carry numbers alone until their first rows are known: rows
    grow with requests, whatever the events of their days.
    """
    heads = top_n(members, [*kind, "date"], order, most)
    heads = cut(with_rank(heads, kind, order, "_place"))
    span = heads.agg(F.min("date").alias("_earliest"), F.max("date").alias("_latest"))  # one row
    runs = with_rank(heads.select(*kind, "_place", F.explode(runs_of_day(F.col("date"))).alias("_run")), [*kind, "_run"], ["_place"], "_n").filter(F.col("_n") <= most)
    asked = requests.crossJoin(F.broadcast(span)).select("request_id", "_limit", *kind, F.explode(runs_of_range(F.col("_b.first"), F.col("_b.last"), F.col("_earliest"), F.col("_latest"))).alias("_run"))
    met = asked.join(runs, [*kind, "_run"]).filter(F.col("_n") <= F.col("_limit")).select("request_id", "_limit", *kind, "_place")
    return with_rank(met, ["request_id"], ["_place"]).filter(F.col("rank") <= F.col("_limit")).drop("_limit").join(heads, [*kind, "_place"]).drop("_place")


def derive_range(user: str | Column, interpreted: str | Column, dismissed: str | Column, default: str = "today") -> Column:
    """A request's range: the user's own, else the query's unless dismissed, else the default."""
    gone = F.exists(F.coalesce(X.col(dismissed), F.array().cast("array<string>")), lambda k: k.startswith("dateRange:"))
    return F.coalesce(X.col(user), F.when(~gone, X.col(interpreted)), F.lit(default))


def browse(requests: DataFrame, events: DataFrame, postings: DataFrame, today: date | str, default: str = "today", week_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(``request_id, id, ord`` of the shown rows, ``request_id`` with counts of the buckets, range, and whether it fell back to the week).

    Requests have ``request_id, query, category, source, date_range, dismissed``.
    A chosen category or source that contradicts the query's dismisses the
    query's, and restricts the events before they are searched, so a query is
    relaxed where nothing of the chosen kind matches. Queries of one letter
    show the pool in order of time.
    """
    long_enough, short = R.split_short(requests)
    req = long_enough.withColumn("_q", F.col("query")).unionByName(short.withColumn("_q", F.lit("")))
    chosen = lambda c: F.when(F.lower(F.coalesce(F.col(c), F.lit("all"))) != "all", F.col(c))
    d = F.coalesce("dismissed", F.array().cast("array<string>"))
    req = req.withColumn("_cat", chosen("category")).withColumn("_src", chosen("source"))
    own_category = X.first_match("_q", [(c, p) for c, p in _categories()])
    own_source = X.first_match("_q", [(s, p) for s, p in _sources()])
    clash = lambda own, mine, name: F.when(own.isNotNull() & F.col(mine).isNotNull() & (F.lower(own) != F.lower(mine)), F.concat(F.lit(f"{name}:"), own))
    req = req.withColumn("_dismissed", F.array_union(d, F.array_compact(F.array(clash(own_category, "_cat", "category"), clash(own_source, "_src", "source")))))
    dated = events.filter("date is not null")
    asked = req.select(F.col("request_id").alias("query_id"), F.col("_q").alias("query"), F.col("_dismissed").alias("dismissed"), F.col("_cat").alias("facet_category"), F.col("_src").alias("facet_source"))
    results, info = search(asked, dated, postings, today)
    ranges = info.select(F.col("query_id").alias("request_id"), F.col("date_range").alias("_interpreted"), "relaxed", "interpretations")
    pool = results.select(F.col("query_id").alias("request_id"), "id").join(dated, "id")
    counts = pool.groupBy("request_id").agg(*[F.count_if(R.in_range(r, today, week_days=week_days)).alias(f"n_{r}") for r in RANGES])
    head = req.select("request_id", F.col("date_range").alias("_user"), "_dismissed").join(ranges, "request_id").join(counts, "request_id", "left").na.fill(0, [f"n_{r}" for r in RANGES])
    head = head.withColumn("asked", derive_range("_user", "_interpreted", "_dismissed", default))
    empty = F.when(F.col("asked") == "today", F.col("n_today") == 0).when(F.col("asked") == "tomorrow", F.col("n_tomorrow") == 0).otherwise(False)
    head = head.withColumn("fell_back", empty & (F.col("n_week") > 0)).withColumn("shown", F.when(F.col("fell_back"), "week").otherwise(F.col("asked")))
    rows = pool.join(head.select("request_id", "shown"), "request_id").filter(R.in_range(F.col("shown"), today, week_days=week_days))
    return with_rank(rows, ["request_id"], browse_order(), "ord").select("request_id", "id", "ord"), head.drop("_user", "_dismissed", "_interpreted")


def _categories() -> list[tuple[str, str]]:
    from .. import lexicons as L

    return L.CATEGORY_PATTERNS


def _sources() -> list[tuple[str, str]]:
    from .. import lexicons as L

    return [(s, p) for s, p, _ in L.SOURCE_PATTERNS]


def parse_state(url: str | Column, categories: list[str], sources: list[str]) -> Column:
    """Struct of an address's filter state: unknown values become defaults."""
    part = lambda name: F.trim(F.coalesce(F.try_url_decode(F.replace(F.try_parse_url(X.col(url), F.lit("QUERY"), F.lit(name)), F.lit("+"), F.lit("%20"))), F.lit("")))
    allowed = lambda name, values, default: F.when(part(name).isin(*values), part(name)).otherwise(default)
    return F.struct(
        allowed("date", RANGES, "today").alias("date_range"), part("date").isin(*RANGES).alias("explicit"), part("q").alias("query"),
        allowed("category", categories, "All").alias("category"), allowed("source", sources, "All").alias("source"), F.nullif(part("event"), F.lit("")).alias("event"),
    )


def build_state(date_range: Column, query: Column, category: Column, source: Column) -> Column:
    """Query string of a state, defaults left out."""
    pair = lambda name, c, default: F.when(F.coalesce(c, F.lit(default)) != default, F.concat(F.lit(f"{name}="), F.url_encode(c)))
    return F.concat_ws("&", pair("date", date_range, "today"), pair("q", F.trim(query), ""), pair("category", category, "All"), pair("source", source, "All"))
