"""Queries of index, ranking, browsing and the tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from ..operators import classify as C
from ..operators import groups as G
from ..operators import rows as R
from ..plans import blocks as K
from ..plans import browse as B
from ..plans import refresh as P
from ..plans import search as S
from ..plans.index import build_index, token_weights
from ..plans.lineage import cut, shared_folder
from .common import PUB, TODAY, published, query, sql_tokens, table
from .search_sql import browse_sql, dismissed_ctes, plan_ctes, search_sql

TITLES = sql_tokens("pub", "id", "title")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the users' first turns as searches."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and turn <= 1")
    return c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text")).select("query_id", F.substring_index("text", " ", 3).alias("query"))


LOG = "log AS (SELECT conv_id AS query_id, array_to_string(string_split(arg_min(text, turn), ' ')[1:3], ' ') AS query FROM conversations WHERE role = 'user' AND turn <= 1 GROUP BY conv_id)"


@query(f"WITH {PUB} {TITLES.replace('SELECT DISTINCT', 'SELECT DISTINCT', 1)}")
def tokenize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.token_rows(published(spark, sf_dir), ["id"], "title")


def _postings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return build_index((published(spark, sf_dir) if events is None else events).withColumn("pos", F.col("id").cast("long")), pos="pos", aliases=False)


POST = (
    f"post AS (SELECT 't' AS field, id, token FROM ({sql_tokens('pub', 'id', 'title')}) UNION ALL SELECT 'g', id, token FROM ({sql_tokens('pub', 'id', 'lang')}) "
    f"UNION ALL SELECT 'o', id, token FROM ({sql_tokens('pub', 'id', 'organizer')}) UNION ALL SELECT 'l', id, token FROM ({sql_tokens('pub', 'id', 'location')}) "
    f"UNION ALL SELECT 'd', id, token FROM ({sql_tokens('pub', 'id', 'description')}))"
)


@query(f"WITH {PUB}, {POST} SELECT field, token, count(*) AS rows, min(CAST(id AS BIGINT)) AS first_pos FROM post GROUP BY ALL")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).groupBy("field", "token").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"))


@query(
    f"WITH {PUB}, {POST}, n AS (SELECT count(*) AS n FROM pub) SELECT token, df, CASE WHEN df / n > 0.3 THEN 0.2 WHEN df / n > 0.15 THEN 0.4 WHEN df / n > 0.08 THEN 0.65 WHEN df / n < 0.01 THEN 1.15 ELSE 1.0 END::DOUBLE AS multiplier "
    "FROM (SELECT token, count(DISTINCT id) AS df FROM post GROUP BY token), n"
)
def index_token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_weights(_postings(spark, sf_dir), published(spark, sf_dir))


@query(f"WITH {PUB}, {POST} SELECT count(DISTINCT id) AS events, count(DISTINCT CASE WHEN field = 't' THEN token END) AS title_tokens FROM post")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.index import index_stats

    return index_stats(_postings(spark, sf_dir))


@query(
    f"WITH {PUB}, {POST}, {LOG}, q AS ({sql_tokens('log', 'query_id, query', 'query')}), nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), "
    "h AS (SELECT query_id, any_value(query) AS query, id, sum(CASE field WHEN 't' THEN 60 WHEN 'g' THEN 45 WHEN 'o' THEN 30 WHEN 'l' THEN 20 ELSE 10 END)::DOUBLE AS points FROM q JOIN post USING (token) GROUP BY query_id, id), "
    "s AS (SELECT h.query_id, h.id, points + CASE WHEN contains(lower(title), lower(query)) THEN 100.0 * n ELSE 0 END AS score FROM h JOIN pub USING (id) JOIN nq USING (query_id)) "
    "SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM s) WHERE rank <= 10"
)
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = published(spark, sf_dir).select("id", "title", F.col("id").cast("long").alias("pos"))
    return P.eval_golden(query_log(spark, sf_dir), _stored_blocks(spark, sf_dir), events)


def _stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as a bucketed table in the shared folder."""
    return K.stored_blocks(_postings(spark, sf_dir), K.table_name(spark, "blocks"), shared_folder(spark, "blocks"))


@query(
    f"WITH {PUB}, {POST}, one AS (SELECT token, CAST(id AS BIGINT) AS pos, sum(CASE field WHEN 't' THEN 60 WHEN 'g' THEN 45 WHEN 'o' THEN 30 WHEN 'l' THEN 20 ELSE 10 END)::DOUBLE AS impact FROM post GROUP BY token, id) "
    f"SELECT token, pos // {K.WIDTH} AS block, count(*) AS n, max(impact) AS top, string_agg(CAST(pos AS VARCHAR) || ':' || CAST(CAST(impact AS INT) AS VARCHAR), ' ' ORDER BY impact DESC, pos DESC) AS entries FROM one GROUP BY token, pos // {K.WIDTH}"
)
def index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index read back: every block with its greatest impact, and its entries in the order of impact."""
    entry = lambda e: F.concat((F.col("block") * K.WIDTH + e["at"]).cast("string"), F.lit(":"), e["impact"].cast("int").cast("string"))
    return _stored_blocks(spark, sf_dir).select("token", "block", "n", "top", F.array_join(F.transform("entries", entry), " ").alias("entries"))


#: What searches ask for before their words; the first conversation asks for nothing else.
WISHES = ["", "this weekend", "tonight", "", "film", "morning", "online", "", "tomorrow evening", "free events"]
WISH_LOG = (
    "log AS (SELECT conv_id AS query_id, CASE WHEN conv_id = 0 THEN 'tonight' ELSE trim(['" + "', '".join(WISHES) + "'][conv_id % 10 + 1] || ' ' || array_to_string(string_split(arg_min(text, turn), ' ')[1:3], ' ')) END AS query "
    "FROM conversations WHERE role = 'user' AND turn <= 1 GROUP BY conv_id)"
)


def wish_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    wish = F.element_at(F.array(*[F.lit(w) for w in WISHES]), (F.col("query_id") % 10 + 1).cast("int"))
    return query_log(spark, sf_dir).select("query_id", F.when(F.col("query_id") == 0, "tonight").otherwise(F.trim(F.concat(wish, F.lit(" "), "query"))).alias("query"))


@query(search_sql(WISH_LOG, POST, 20))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: plans, pools, index phase, loose phase, relaxation; the twenty best of each query."""
    events = published(spark, sf_dir).withColumn("pos", F.col("id").cast("long"))
    results, info = S.search(wish_log(spark, sf_dir), events, _postings(spark, sf_dir, events), TODAY, limit=20, blocks=_stored_blocks(spark, sf_dir))
    return results.join(info.select("query_id", "relaxed"), "query_id").select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score", "relaxed")


def _b(pattern: str) -> str:
    return f"regexp_matches(query, '(?i)\\b({pattern})\\b')".replace("'", "'")


_WHEN = "CASE " + " ".join(f"WHEN {_b(p)} THEN '{ {'tonight': 'today', 'weekend': 'week'}.get(n, n) }'" for n, p in L.TEMPORAL) + " END"
_TIME = "CASE " + " ".join(f"WHEN {_b(p)} THEN '{n}'" for n, p in L.TIMES_OF_DAY) + f" WHEN {_b(L.TEMPORAL[0][1])} THEN 'evening' END"
_CAT = "CASE " + " ".join(f"WHEN {_b(p)} THEN '{n}'" for n, p in L.CATEGORY_PATTERNS) + " END"
INTENT_WORDS = ["free food tonight", "talks this weekend", "online seminar", "berkeley law tomorrow", "film screening northside"]
MIXED = "mixed AS (SELECT conv_id AS query_id, ['" + "', '".join(INTENT_WORDS) + "'][conv_id % 5 + 1] || ' ' || string_split(arg_min(text, turn), ' ')[1] AS query FROM conversations WHERE role = 'user' AND turn <= 1 GROUP BY conv_id)"


def intent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that begin with a wish, then a word of the conversation."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and turn <= 1").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    wish = F.element_at(F.array(*[F.lit(w) for w in INTENT_WORDS]), (F.col("conv_id") % 5 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("query_id"), F.concat(wish, F.lit(" "), F.substring_index("text", " ", 1)).alias("query"))


@query(f"WITH {MIXED} SELECT query_id, {_WHEN} AS date_range, {_TIME} AS time_of_day, {_CAT} AS category, {_b(L.ONLINE)} AS online, {_b('this weekend|weekend')} AS weekend FROM mixed")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.parse_queries(intent_log(spark, sf_dir))
    return p.select("query_id", "date_range", "time_of_day", "category", F.coalesce(F.col("modality") == "online", F.lit(False)).alias("online"), "weekend")


@query(
    f"WITH {MIXED.replace('mixed AS', 'log AS')}, {plan_ctes('log')}, {dismissed_ctes()} SELECT query_id, cleaned, array_to_string(keywords, ' ') AS keywords, array_to_string(expanded, ' ') AS expanded, date_range, category, intent_source FROM kept"
)
def query_plans_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans whose category and source are dismissed, with keywords and expansion."""
    p = S.parse_queries(intent_log(spark, sf_dir))
    keys = F.filter(F.transform("interpretations", lambda i: i["key"]), lambda k: k.startswith("category:") | k.startswith("source:"))
    words = [F.array_join(c, " ").alias(c) for c in ("keywords", "expanded")]
    return S.dismiss(p.withColumn("dismissed", keys)).select("query_id", "cleaned", *words, "date_range", "category", "intent_source")


@query(
    f"WITH {PUB}, {LOG}, q AS ({sql_tokens('log', 'query_id', 'query')}), v AS (SELECT DISTINCT token AS term FROM ({TITLES})) "
    "SELECT query_id, token, term, levenshtein(a, b) / len(token) AS distance FROM (SELECT query_id, token, term, regexp_replace(token, '[^\\x00-\\x7F]', '~', 'g') AS a, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g') AS b FROM q JOIN v ON abs(len(token) - len(term)) <= 2) WHERE levenshtein(a, b) <= CASE WHEN len(token) < 5 THEN 1 ELSE 2 END"
)
def fuzzy_title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # SQL counts edits in bytes, so it reads letters of several bytes as one sign.
    return S.fuzzy_terms(X.token_rows(query_log(spark, sf_dir), ["query_id"], "query"), X.token_rows(published(spark, sf_dir), ["id"], "title"))


BROWSE_ORDER = "date, CASE WHEN mins = -1 THEN 1440 ELSE mins END, id"
TOOL_ORDER = "date, CASE WHEN mins = -1 THEN 0 ELSE mins END, lpad(id, 9, '0'), id"


@query(f"WITH {PUB} SELECT id, row_number() OVER (PARTITION BY date ORDER BY {BROWSE_ORDER}) AS ord FROM pub WHERE date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7 AND lower(lang) = 'en' AND source = 'src9'")
def browse_facets_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates as D

    df = R.by_range(R.by_source(R.by_category(R.require_date(published(spark, sf_dir)), "EN"), "src9"), "week", TODAY)
    return G.with_rank(df, ["date"], ["date", D.minute_of_day("time", 1440), "id"], "ord").select("id", F.col("ord").cast("long"))


@query(f"WITH {PUB} SELECT 'All' AS value, count(*) AS count FROM pub UNION ALL SELECT source, count(*) FROM pub GROUP BY source")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.facets(published(spark, sf_dir)).select("value", F.col("count").cast("long").alias("count"))


@query(
    f"WITH {PUB} SELECT source, count(*) FILTER (date = DATE '{TODAY}') AS today, count(*) FILTER (date = DATE '{TODAY}' + 1) AS tomorrow, count(*) FILTER (date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7) AS week, "
    f"count(*) FILTER (date >= DATE '{TODAY}') AS upcoming FROM pub GROUP BY source"
)
def bucket_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bucket_counts(published(spark, sf_dir), TODAY, ["source"])


@query(f"WITH {PUB} SELECT CAST(date AS VARCHAR) AS day, count(*) AS events, string_agg(id, ',' ORDER BY CASE WHEN mins = -1 THEN 1440 ELSE mins END, id) AS ids FROM pub GROUP BY date")
def day_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates as D

    g = G.day_groups(published(spark, sf_dir).withColumn("_m", D.minute_of_day("time", 1440)).select("date", "_m", "id"), ["_m", "id"], ["id"])
    return g.select(F.col("date").cast("string").alias("day"), F.size("events").cast("long").alias("events"), F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("ids"))


def tool_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per nation: a category, a source, a preset and a limit of its number."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), k % len(values) + 1)
    return n.select(
        k.alias("request_id"), pick("the", "", "de").alias("query"), pick("en", None, "FR", "de").alias("category"), F.when(k % 5 == 4, F.concat(F.lit("src"), (k % 20).cast("string"))).alias("source"),
        pick("week", "upcoming", None, "today", "tomorrow").alias("preset"), F.lit(None).cast("date").alias("start"), F.when(k % 9 == 8, F.to_date(F.lit("2023-12-01"))).alias("end"), (k - 2).cast("string").alias("limit"),
    )


REQ = (
    "req AS (SELECT n_nationkey AS k, ['the', '', 'de'][n_nationkey % 3 + 1] AS q, ['en', NULL, 'FR', 'de'][n_nationkey % 4 + 1] AS cat, CASE WHEN n_nationkey % 5 = 4 THEN 'src' || n_nationkey % 20 END AS src, "
    "['week', 'upcoming', NULL, 'today', 'tomorrow'][n_nationkey % 5 + 1] AS preset, CASE WHEN n_nationkey % 9 = 8 THEN DATE '2023-12-01' END AS e, greatest(1, least(50, n_nationkey - 2)) AS lim FROM nation), "
    f"bound AS (SELECT *, CASE WHEN preset IN ('week', 'upcoming', 'today') THEN DATE '{TODAY}' WHEN preset = 'tomorrow' THEN DATE '{TODAY}' + 1 END AS f, "
    f"coalesce(e, CASE preset WHEN 'today' THEN DATE '{TODAY}' WHEN 'tomorrow' THEN DATE '{TODAY}' + 1 WHEN 'week' THEN DATE '{TODAY}' + 6 END) AS l FROM req)"
)


@query(
    f"WITH {PUB}, {REQ}, hit AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY {TOOL_ORDER}) AS rank, lim, lang FROM bound JOIN pub ON (q = '' OR contains(lower(concat_ws(' ', lpad(id, 9, '0'), description, organizer, location, source, lang)), q)) "
    "AND (cat IS NULL OR lower(cat) = lang) AND (src IS NULL OR src = source) AND (f IS NULL OR date >= f) AND (l IS NULL OR date <= l) WHERE NOT coalesce(f > l, false)) "
    "SELECT k AS request_id, rank, id, lang AS category, NULL::VARCHAR AS error FROM hit WHERE rank <= lim UNION ALL SELECT k, NULL, NULL, NULL, 'startDate must be earlier than or equal to endDate' FROM bound WHERE f > l"
)
def tool_search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles of digits, which every language orders alike.
    out = B.tool_search(tool_requests(spark, sf_dir), published(spark, sf_dir).withColumn("title", F.lpad("id", 9, "0")), TODAY)
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "id", "category", "error")


BROWSED = ["der", "", "les morning", "que", "this weekend la"]
BROWSE_LOG = (
    "log AS (SELECT n_nationkey AS query_id, ['" + "', '".join(BROWSED) + "'][n_nationkey % 5 + 1] AS query, ['en', NULL, 'FR', 'de'][n_nationkey % 4 + 1] AS facet_category, "
    "CASE WHEN n_nationkey % 5 = 4 THEN 'src' || n_nationkey % 20 END AS facet_source FROM nation)"
)


@query(browse_sql(BROWSE_LOG, POST))
def browse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with facets over the whole table, their range and fallback."""
    text = F.element_at(F.array(*[F.lit(w) for w in BROWSED]), (F.col("request_id") % 5 + 1).cast("int"))
    req = tool_requests(spark, sf_dir).select(F.col("request_id"), text.alias("query"), "category", "source", F.lit(None).cast("string").alias("date_range"), F.array().cast("array<string>").alias("dismissed"))
    shown, head = B.browse(req, published(spark, sf_dir), cut(_postings(spark, sf_dir)), TODAY)
    return shown.join(head.select("request_id", "shown", "fell_back"), "request_id").drop("ord")


@query(f"WITH {PUB} SELECT id, contains(lower(location), 'hall') AS near FROM pub WHERE lang = 'en' OR lang = 'de'")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.by_any_tag(published(spark, sf_dir), "EN").unionByName(R.by_any_tag(published(spark, sf_dir), "de"))
    return df.filter(R.matches_text("HALL")).select("id", R.is_home_game(venues=["hall"]).alias("near"))


KEYWORD_ROWS = ", ".join(f"('{c}', '{w}')" for c, ws in L.KEYWORDS.items() for w in ws)


@query(
    f"WITH {PUB}, kw(category, word) AS (VALUES {KEYWORD_ROWS}), src AS (SELECT id, lower(title || ' ' || ['data science talk', 'grad student org mixer', 'film', 'go-to-market fit', 'plain'][doc_id % 5 + 1]) AS title, lower(description) AS description FROM pub), "
    "f AS (SELECT id, 10.0 AS points, title AS text FROM src UNION ALL SELECT id, 3.0, description FROM src) "
    "SELECT id, category, sum(points * len(regexp_extract_all(text, '\\b' || word || '\\b')))::DOUBLE AS score FROM f JOIN kw ON contains(text, word) GROUP BY id, category HAVING score > 0"
)
def category_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*[F.lit(x) for x in ("data science talk", "grad student org mixer", "film", "go-to-market fit", "plain")]), (F.col("id").cast("long") % 5 + 1).cast("int"))
    df = published(spark, sf_dir).withColumn("title", F.concat_ws(" ", "title", extra)).withColumn("organizer", F.lit("")).withColumn("categories", F.array().cast("array<string>"))
    return C.category_scores(df)


@query(
    "WITH log AS (SELECT conv_id % 50 AS user_id, string_split(text, ' ')[1] AS query, conv_id * 100 + turn AS ts FROM conversations WHERE role = 'user'), "
    "l AS (SELECT user_id, lower(query) AS low, max(ts) AS ts FROM log WHERE len(query) >= 2 GROUP BY ALL) SELECT * FROM (SELECT user_id, low, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, low) AS place FROM l) WHERE place <= 8"
)
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    log = c.select((F.col("conv_id") % 50).alias("user_id"), F.substring_index("text", " ", 1).alias("query"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"))
    return G.recent_distinct(log).select("user_id", F.lower("query").alias("low"), F.col("place").cast("long").alias("place"))


@query(
    "WITH r AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS query FROM part WHERE p_size <= 5), p AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS query FROM part WHERE p_size > 20) "
    "SELECT query, 'recent' AS kind FROM r UNION ALL SELECT query, 'popular' FROM p WHERE lower(query) NOT IN (SELECT lower(query) FROM r)"
)
def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("query", F.substring_index("p_name", " ", 1))
    return G.suggestions(p.filter("p_size <= 5").select("query").distinct(), p.filter("p_size > 20").select("query").distinct())


@query(
    "WITH l AS (SELECT page_id, url, regexp_extract(url, '[?&]date=([^&]*)', 1) AS d FROM pages) SELECT page_id, CASE WHEN d IN ('today', 'tomorrow', 'week', 'upcoming') THEN d ELSE 'today' END AS date_range, "
    "CASE WHEN page_id % 3 = 0 THEN 'q=page+' || page_id ELSE 'date=week&q=page+' || page_id END AS built FROM l"
)
def url_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    state = B.parse_state("url", ["Arts"], ["src1"])
    built = B.build_state(F.when(F.col("page_id") % 3 == 0, "today").otherwise("week"), F.concat(F.lit("page "), F.col("page_id").cast("string")), F.lit("All"), F.lit("All"))
    return p.select("page_id", state["date_range"].alias("date_range"), built.alias("built"))
