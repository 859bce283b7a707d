"""Text functions: Columns in, Columns out, evaluated inside generated code unless said otherwise."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicons as L

#: White space as a browser's patterns know it; Spark's ``\s`` lacks some of it.
SPACE = r"[\s   -     　﻿]"
#: Edges of ASCII words; Spark's own ``\b`` takes other letters into words.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "’", "&ndash;": "–", "&mdash;": "—"}
BLOCKS = "p|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(pattern: str, flags: str = "(?i)") -> str:
    """A pattern that stands between ASCII word edges."""
    return f"{flags}{LEFT}(?:{pattern}){RIGHT}"


def matches(c: str | Column, pattern: str) -> Column:
    """Whether any of the alternatives stands in the text as whole words."""
    return col(c).rlike(words(pattern))


def squeeze(c: str | Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


@cache
def _folds() -> tuple[str, str]:
    """Letters whose compatibility form is one letter and marks, and those letters; from the Unicode tables."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: str | Column) -> Column:
    """Accented letters become their base letters, loose combining marks go; stays inside the JVM. ASCII passes by untouched."""
    c = col(c)
    folded = F.regexp_replace(F.translate(c, *_folds()), "[̀-ͯ]", "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Full compatibility decomposition without marks, for text in which signs of several letters matter. Arrow."""
    return text.map(lambda t: None if t is None else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", t)))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All HTML entities. Arrow."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def decode_entities(c: str | Column) -> Column:
    """The entities that feeds hold, and the ampersand last."""
    out = col(c)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def sanitize_plain_text(c: str | Column, full: bool = False) -> Column:
    """Tags become spaces, entities characters, left-over angle brackets go, white space is squeezed."""
    bare = F.regexp_replace(col(c), "<[^>]+>", " ")
    return squeeze(F.regexp_replace(unescape_html(bare) if full else decode_entities(bare), "[<>]", ""))


def clean_title(c: str | Column, full: bool = False) -> Column:
    """Plain text without spaces, dashes and colons at its ends."""
    return F.trim(F.regexp_replace(sanitize_plain_text(c, full), r"^[\s\-–—:]+|[\s\-–—:]+$", ""))


def strip_html(c: str | Column, blocks: bool = False) -> Column:
    """Text of an HTML fragment; scripts and styles go, comparison signs stay. ``blocks``: line breaks and block ends part words."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    if blocks:
        bare = F.regexp_replace(bare, rf"(?i)<br\s*/?>|</(?:{BLOCKS})\s*>", " ")
        bare = F.regexp_replace(bare, r"</?[A-Za-z][^>]*>", "")
    else:
        bare = F.regexp_replace(bare, r"</?[A-Za-z][^>]*>", " ")
    return squeeze(decode_entities(bare))


def decode_ics(c: str | Column) -> Column:
    """Text of an iCalendar property: escapes undone, two entities decoded, tags to spaces."""
    c = F.regexp_replace(col(c), r"\\[nN]", " ")
    c = F.regexp_replace(c, r"\\([,;\\])", "$1")
    c = F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def ics_escape(c: str | Column) -> Column:
    """Text for an iCalendar property; backslash first."""
    c = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.regexp_replace(c, r"\r?\n", r"\\n")


def normalize_for_dedupe(c: str | Column) -> Column:
    """Lower case, signs to spaces, stop words out: the key under which titles are equal."""
    plain = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]+", " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(L.DEDUPE_STOP_WORDS))
    return F.array_join(kept, " ")


def _undoubled(c: Column, cut: int) -> Column:
    """Without its last letters, and without one of two equal consonants that then end it."""
    base = F.substring(c, F.lit(1), F.length(c) - cut)
    twice = (F.length(base) >= 4) & base.rlike(r"([bcdfghjklmnpqrstvwxyz])\1$")
    return F.when(F.length(base) < 3, c).when(twice, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def _singular(c: Column) -> Column:
    """A word without its plural ending."""
    n = F.length(c)
    less = lambda k: F.substring(c, F.lit(1), n - k)
    return (
        F.when((n <= 3) | ~c.endswith("s"), c)
        .when(c.endswith("sses") & (n > 6), less(2))
        .when(c.endswith("ies") & (n > 4), F.concat(less(3), F.lit("i")))
        .when(~c.endswith("ss") & ~c.endswith("us") & (n > 4), less(1))
        .otherwise(c)
    )


def _unended(c: Column) -> Column:
    """A word without -ing or -ed."""
    n = F.length(c)
    return F.when(c.endswith("ing"), F.when(n > 6, _undoubled(c, 3)).otherwise(c)).when(c.endswith("ed") & (n > 5), _undoubled(c, 2)).otherwise(c)


def stem(c: str | Column) -> Column:
    """Light stem: plural endings, then -ing or -ed with undoubling; short words stay."""
    return _unended(_singular(col(c)))


def raw_words(c: str | Column, full: bool = False) -> Column:
    """Words before stop words and stems: folded, lower-cased, split where neither letter nor digit stands."""
    folded = nfkd(col(c)) if full else fold_accents(c)
    return F.split(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", " "), " ")


def tokenize(c: str | Column, full: bool = False) -> Column:
    """Distinct stems in order of first occurrence; null gives none.

    The two steps of the stem pass over the words one after the other: in one
    pass the first would be computed anew wherever the second names it.
    """
    kept = F.filter(F.array_distinct(raw_words(c, full)), lambda w: (F.length(w) >= 2) & ~w.isin(L.STOP_WORDS))
    stems = F.filter(F.transform(F.transform(kept, _singular), _unended), lambda s: F.length(s) >= 2)
    return F.coalesce(F.array_distinct(stems), F.array().cast("array<string>"))


def token_rows(df, keys: list[str], text: str, token: str = "token"):
    """Rows of ``keys, token``: the stems of a text column, one row per distinct stem of a row.

    Stems are made distinct inside their row, so that nothing is shuffled.
    """
    return df.select(*keys, F.explode(tokenize(text)).alias(token))


def strip_first(c: str | Column, pattern: str) -> Column:
    """The first match becomes a space, white space is squeezed."""
    return squeeze(F.regexp_replace(col(c), rf"(?is)^(.*?){pattern}", "$1 "))


def first_match(c: str | Column, table: list[tuple[str, str]]) -> Column:
    """Label of the first pattern of (label, pattern) that matches as whole words; null if none does."""
    return F.coalesce(*[F.when(matches(c, pattern), F.lit(label)) for label, pattern in table])


def detect_phrases(c: str | Column, phrases: list[str] | None = None) -> Column:
    """Known phrases that are part of the lower-cased text, in list order."""
    low = F.lower(col(c))
    return F.filter(F.array(*[F.lit(p) for p in (L.KNOWN_PHRASES if phrases is None else phrases)]), lambda p: low.contains(p))


def canonical_venue(c: str | Column) -> Column:
    """A long or misspelt venue name becomes the one in use."""
    return F.when(matches(c, "berkl?ey art museum (?:and|&) pacific film archive"), "BAMPFA").otherwise(col(c))


def canonical_tag(c: str | Column) -> Column:
    """Label of the category that a tag names, by parts of it; other tags stay."""
    low = F.lower(col(c))
    return (
        F.when(low.contains("art"), "Arts")
        .when(low.contains("sport"), "Sports")
        .when(low.contains("science") | low.contains("tech"), "Science & Tech")
        .when(low.contains("student"), "Student Life")
        .when(low.contains("entrepreneur"), "Entrepreneurship")
        .when(low.contains("academic"), "Academic")
        .otherwise(col(c))
    )


def stable_event_key(source: str | Column, source_id: str | Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Identity under which the days of an event meet: source and the id without what names a day."""
    source, out = col(source), col(source_id)
    for name, patterns in (L.ID_RULES if rules is None else rules).items():
        stripped = col(source_id)
        for p in patterns:
            stripped = F.regexp_replace(stripped, p, "")
        out = F.when(source == name, stripped).otherwise(out)
    return F.concat(source, F.lit("::"), out)


def unit_from_slug(c: str | Column, units: dict[str, str] = L.UNITS) -> Column:
    """Name of an organising unit from its slug: looked up, else up to four letters as capitals, else words with capitals."""
    c = col(c)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.lower(c)) if units else F.lit(None)
    short = F.length(F.regexp_replace(c, "[^A-Za-z]", "")).between(1, 4)
    raised = F.transform(F.split(F.regexp_replace(c, "[-_]", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.coalesce(known, F.when(c == "", "").when(short, F.upper(c)).otherwise(F.array_join(raised, " ")))


def unit_from_url(c: str | Column, units: dict[str, str] = L.UNITS, generic: tuple[str, ...] = L.GENERIC_PATHS, default: str = L.DEFAULT_ORGANIZER) -> Column:
    """Struct of slug and unit: the first path segment names the unit unless it is generic."""
    path = F.coalesce(F.try_parse_url(col(c), F.lit("PATH")), F.lit(""))
    slug = F.coalesce(F.get(F.split(F.regexp_replace(path, "^/+", ""), "/"), F.lit(0)), F.lit(""))
    usable = (slug != "") & ~F.lower(slug).isin(*generic)
    return F.struct(slug.alias("slug"), F.when(usable, unit_from_slug(slug, units)).otherwise(F.lit(default)).alias("unit"))


def clean_summary(c: str | Column) -> Column:
    """A fixture's title without the bracketed letter that leads it."""
    return F.trim(F.regexp_replace(col(c), r"^\[[A-Za-z]\]\s*", ""))


def game_flags(c: str | Column) -> Column:
    """Struct from the leading letter: H is a home game, W and L are finished ones."""
    tag = F.upper(F.regexp_extract(col(c), r"^\[([A-Za-z])\]", 1))
    return F.struct((tag == "H").alias("is_home"), tag.isin("W", "L").alias("completed"), tag.isin("A", "N").alias("away_or_neutral"))


def parse_template_link(c: str | Column) -> Column:
    """Struct of a calendar-template link: title, start and end tokens, details, location, url found in the details; null if malformed."""
    part = lambda name: F.try_url_decode(F.replace(F.try_parse_url(F.replace(col(c), F.lit("&amp;"), F.lit("&")), F.lit("QUERY"), F.lit(name)), F.lit("+"), F.lit("%20")))
    dates = F.split(part("dates"), "/")
    token = r"^\d{8}(T\d{6}Z?)?$"
    start, end = F.get(dates, F.lit(0)), F.get(dates, F.lit(1))
    ok = (F.coalesce(part("text"), F.lit("")) != "") & (F.size(dates) == 2) & start.rlike(token) & end.rlike(token) & (F.length(start) == F.length(end))
    url = F.regexp_extract(F.coalesce(part("details"), F.lit("")), r"(https?://[^\s\"<>]+)", 1)
    return F.when(
        ok,
        F.struct(
            squeeze(part("text")).alias("title"), start.alias("start"), end.alias("end"),
            squeeze(F.coalesce(part("details"), F.lit(""))).alias("details"), squeeze(F.coalesce(part("location"), F.lit(""))).alias("location"), F.nullif(url, F.lit("")).alias("url"),
        ),
    )


def categorize_theme(theme: str | Column, names: str | Column, themes: dict[str, str] | None = None, groups: list[tuple[str, str]] | None = None, default: str = L.DEFAULT_CATEGORY) -> Column:
    """Ordered distinct categories of a theme and category names: the theme's own, then for each name the first group that it holds a word of."""
    themes, groups = L.THEMES if themes is None else themes, L.THEME_GROUPS if groups is None else groups
    own = F.coalesce(*[F.when(col(theme) == k, F.lit(v)) for k, v in themes.items()])
    named = F.transform(F.coalesce(col(names), F.array().cast("array<string>")), lambda n: F.coalesce(*[F.when(F.lower(n).rlike(words(p)), F.lit(v)) for p, v in groups]))
    found = F.array_compact(F.array_distinct(F.concat(F.array(own), named)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
