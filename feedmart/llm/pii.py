"""Surrogates for personal data: keyed, type-consistent and distinct, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filled

MALE = "Mr|Herr|Monsieur|Señor|Sr|господин|г-н|Κύριος|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|г-жа|Κυρία|κυρία|κα"
NEUTRAL = "Dr|Prof|Doctor|Professor"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"(?:\p{Lu}[\p{L}'’-]+|\p{IsHan}{1,4})"
#: kind -> pattern, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
    "national id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?:[tT]oken|TOKEN|[sS]ecret|SECRET|[pP]assword|PASSWORD|[aA]pi_?[kK]ey|API_?KEY) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "person": rf"(?=[MHFSDPгΚκ])(?<!\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What stands before a secret's value or a person's name in a mention, and stays.
TITLE = {"secret": r"^(.*?[=:] {0,2}[\"']?)", "person": r"^([^ ]+ )"}
#: Syllables of made-up names, by script, their least number, and endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ja jo ka ke la le li lo ma me mi mo na ne ni no".split(),
    "cyrillic": "ба бе би бо да де ди до фа ве га ге ха хе за зо ка ке ла ле ли ло ма ме ми мо на не ни но".split(),
    "greek": "βα βε βι βο δα δε δι δο φα φε γα γε χα χε ζα ζο κα κε λα λε λι λο μα με μι μο να νε νι νο".split(),
    "han": list("文平安宁和成光海山林江河天月星云春秋冬夏金玉石木水火青白红方"),
}
LEAST = {"han": 1}
ENDINGS = {
    ("latin", "male"): "nus", ("latin", "female"): "lina", ("latin", "any"): "ris", ("latin", "last"): "rel",
    ("cyrillic", "male"): "слав", ("cyrillic", "female"): "лина", ("cyrillic", "any"): "рис", ("cyrillic", "last"): "рел",
    ("greek", "male"): "νος", ("greek", "female"): "λίνα", ("greek", "any"): "ρις", ("greek", "last"): "ρελ",
    ("han", "male"): "伟", ("han", "female"): "芳", ("han", "any"): "永", ("han", "last"): "",
}
#: Characters of a random stream; positions beyond begin again.
_BLOCKS = 4


def mentions_of(text: Column) -> Column:
    """All mentions, left to right."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    return F.coalesce(*[F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in PATTERNS.items()])


def has_mention(text: Column) -> Column:
    """Whether any pattern occurs. What every mention of a kind must hold is looked for first, as that costs far less."""
    numbers = "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "national id", "ip", "card", "iban"))
    return (
        (text.contains("@") & text.rlike(PATTERNS["email"]))
        | (text.rlike("[0-9]") & text.rlike(numbers))
        | ((text.contains("=") | text.contains(":")) & text.rlike(PATTERNS["secret"]))
        | text.rlike(PATTERNS["person"])
    )


def _digit(stream: Column, k: Column, base: int) -> Column:
    """The k-th random number below ``base`` (k from 0)."""
    return F.conv(F.substring(stream, (F.pmod(k, F.lit(32 * _BLOCKS)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") % base


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{b}\x1f"), seed), 256) for b in range(_BLOCKS)])


def _each(text: Column, made) -> Column:
    """``text`` with each character c at index k (from 0) replaced by made(c, k)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, made), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""

    def add(c: Column, k: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - k) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), add), F.lit(0), lambda a, x: a + x) % 10


def _syllables(script: str, stream: Column, attempt: Column) -> Column:
    """Three syllables, or the script's least number, and one more for every further attempt."""
    pool = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    picked = F.transform(F.sequence(F.lit(0), attempt + (LEAST.get(script, 3) - 1)), lambda k: F.element_at(pool, _digit(stream, k, len(SYLLABLES[script])) + 1))
    return F.array_join(picked, "")


def _mod97(text: Column) -> Column:
    """A text of digits and capitals as a number modulo 97, letters counted from 10."""

    def add(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.pmod(F.when(digit, a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def surrogate_of(kind: Column, canonical: Column, stream: Column, attempt: Column) -> Column:
    """Canonical surrogate of the kind and form of ``canonical``."""
    hexed, hexed_up = canonical.rlike("^[0-9a-f]+$"), canonical.rlike("^[0-9A-F]+$")
    letters, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    pick = lambda pool, k, n: F.substring(pool, _digit(stream, k, n) + 1, F.lit(1))

    def alike(c: Column, k: Column) -> Column:
        return F.when(c.rlike("[0-9]"), _digit(stream, k, 10).cast("string")).when(c.rlike("[a-z]"), pick(letters, k, 26)).when(c.rlike("[A-Z]"), pick(upper, k, 26)).otherwise(c)

    digits = lambda text: _each(text, lambda c, k: F.when(k == 0, c).when(c.rlike("[0-9]"), _digit(stream, k, 10).cast("string")).otherwise(c))
    # The country code's first digit stays; what follows the plus is replaced.
    phone = F.when(canonical.startswith("+"), F.concat(F.lit("+"), digits(F.substring(canonical, 2, 40)))).otherwise(digits(canonical))
    country, account = F.substring(canonical, 1, 2), _each(F.substring(canonical, 5, 40), alike)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    body = F.concat(digits(F.substring(canonical, F.lit(1), F.length(canonical) - 1)), F.lit("0"))
    card = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.pmod(_luhn(canonical) - _luhn(body), F.lit(10)).cast("string"))
    ip = F.concat_ws(".", *[(_digit(stream, F.lit(k), 223) + 1 if k == 0 else _digit(stream, F.lit(k), 256)).cast("string") for k in range(4)])
    top = F.regexp_extract(canonical, r"(\.[a-z]+)$", 1)
    email = F.concat(_each(F.substring(canonical, F.lit(1), F.length(canonical) - F.length(top)), alike), top)
    from_pool = lambda pool: _each(canonical, lambda c, k: pick(F.lit(pool), k, 16))
    secret = F.when(hexed, from_pool("0123456789abcdef")).when(hexed_up, from_pool("0123456789ABCDEF")).otherwise(_each(canonical, alike))
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "national id", digits(canonical)).when(kind == "iban", iban).when(kind == "card", card).when(kind == "ip", ip)
    for (script, role), ending in ENDINGS.items():
        out = out.when(kind == f"{role} {script}", F.concat(_syllables(script, stream, attempt), F.lit(ending)))
    return out.otherwise(secret)


def rendered(kind: Column, original: Column, canonical_surrogate: Column) -> Column:
    """The surrogate in the form of a mention: its separators, its case."""
    before = lambda k: F.length(F.regexp_replace(F.substring(original, F.lit(1), k), "[^0-9]", ""))
    digits = F.regexp_replace(canonical_surrogate, "[^0-9]", "")
    numbers = _each(original, lambda c, k: F.when(c.rlike("[0-9]"), F.substring(digits, before(k) + 1, F.lit(1))).otherwise(c))
    inside = lambda k: k - F.length(F.replace(F.substring(original, F.lit(1), k), F.lit(" "), F.lit("")))
    spaced = _each(original, lambda c, k: F.when(c == " ", c).otherwise(F.substring(canonical_surrogate, k - inside(k) + 1, F.lit(1))))
    cased = _each(canonical_surrogate, lambda c, k: F.when(F.substring(original, k + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    shouted = (F.upper(original) == original) & (F.length(original) > 1)
    name = F.when(shouted, F.upper(canonical_surrogate)).otherwise(F.initcap(canonical_surrogate))
    return F.when(kind.isin("phone", "card", "national id"), numbers).when(kind == "iban", spaced).when(kind == "email", cased).when(kind.rlike("^(male|female|any|last) "), name).otherwise(canonical_surrogate)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` with distinct surrogates within a kind, none of which is itself an entity.

    Every round proposes surrogates for the entities that have none; of those
    that propose the same the first keeps it, unless it was given before or
    is the text of a real entity, and the others go on to the next attempt.
    """
    waiting = entities.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    real = cut(entities.select(F.col("kind"), F.col("canonical").alias("surrogate")).distinct())
    while True:
        stream = _stream(key, F.col("kind"), F.col("canonical"), F.col("attempt"))
        offered = waiting.withColumn("stream", stream).withColumn("surrogate", surrogate_of(F.col("kind"), F.col("canonical"), F.col("stream"), F.col("attempt"))).drop("stream")
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        offered = offered.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canonical"))
        offered = cut(offered.withColumn("kept", F.col("taken").isNull() & (first == 1)))
        got = offered.filter("kept").select("kind", "canonical", "surrogate")
        done = got if done is None else done.unionByName(got)
        waiting = offered.filter("not kept").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return cut(done)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text with its personal data replaced.

    Emails, phone numbers (international, and national ones of ten grouped
    digits), national ids of nine grouped digits, card and bank account
    numbers, IP addresses, secrets after their names and persons after a form
    of address are found by patterns; so is every place in the same text where
    a part of such a person's name stands alone as a word. An entity is its
    canonical form (digits of a number, lower-cased email, each part of a
    name), and gets one surrogate throughout the table, derived from ``key``:
    a number keeps its first digit, its separators and a card its Luhn
    residue, an account its country and valid check digits, hexadecimal
    secrets stay such, names keep gender (unknown after a doctor's or
    professor's title), script (Latin, Cyrillic, Greek or Han; any other
    counts as Latin) and case. Distinct entities get distinct surrogates (see
    ``assign``). Names without a form of address anywhere in their text and
    postal addresses are not found. A name under several forms of address, or
    as a first name here and a last name there, is an entity for each and so
    gets several surrogates; where a person's name is also a common word
    written with a capital (May), that word is replaced in the same text, too.

    Only rows with a mention are shuffled. Returns ``doc_id, n_mentions, kinds,
    mentions, text``, one row per input row; ``mentions`` lists kind, start
    (characters from 0, in the given text), length and surrogate. Null and
    empty texts come back empty without mentions; repeated rows give a row
    each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    held = has_mention(F.col("text"))
    row_key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary"))).cast("binary"))
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").when(c.rlike(r"\p{IsHan}"), "han").otherwise("latin")

    def parts_of(person: Column) -> Column:
        words = F.split(person, " ")
        address = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
        gender = F.when(address.rlike(f"^(?:{FEMALE})$"), "female").when(address.rlike(f"^(?:{MALE})$"), "male").otherwise("any")
        role = lambda w, k: F.concat(F.when((k == 0) & (F.size(words) > 2), gender).otherwise("last"), F.lit(" "), script(w)).alias("kind")
        return F.transform(F.slice(words, 2, 2), lambda w, k: F.struct(role(w, k), F.lower(w).alias("canonical"), w.alias("original")))

    # Names of persons in a row are looked for alone, too; rows without persons share one pattern.
    persons = F.regexp_extract_all("text", F.lit(PATTERNS["person"]), F.lit(0))
    known = F.flatten(F.transform(persons, parts_of))
    names = F.array_distinct(F.flatten(F.transform("known", lambda p: F.array(p["original"], F.upper(p["original"])))))
    longest_first = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    alone = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(longest_first, "|"), F.lit(r")(?!\p{L})"))
    found = rows.filter(held).withColumn("row_key", row_key).withColumn("known", known).withColumn("pattern", F.when(F.size("known") > 0, alone).otherwise(ANY))
    mention = found.select("row_key", "known", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("all")).dropDuplicates(["row_key"])
    mention = mention.select("row_key", "known", F.posexplode("all").alias("n", "mention")).withColumn("kind", F.coalesce(kind_of(F.col("mention")), F.lit("name")))
    same_name = F.filter("known", lambda p: p["canonical"] == F.lower("mention"))
    bare = F.array(F.struct(F.get(same_name, F.lit(0))["kind"].alias("kind"), F.lower("mention").alias("canonical"), F.col("mention").alias("original")))
    named = parts_of(F.col("mention"))
    title = F.lit("")
    for kind, pattern in TITLE.items():
        title = F.when(F.col("kind") == kind, F.regexp_extract("mention", pattern, 1)).otherwise(title)
    whole = F.col("value")
    canonical = F.when(F.col("kind") == "phone", F.concat(F.when(whole.startswith("+"), "+").otherwise(""), F.regexp_replace(whole, "[^0-9]", ""))).when(F.col("kind").isin("card", "national id"), F.regexp_replace(whole, "[^0-9]", "")).when(F.col("kind") == "iban", F.replace(whole, F.lit(" "), F.lit(""))).when(F.col("kind") == "email", F.lower(whole)).otherwise(whole)
    parts = F.when(F.col("kind") == "person", named).when(F.col("kind") == "name", bare).otherwise(F.array(F.struct(F.col("kind").alias("kind"), canonical.alias("canonical"), whole.alias("original"))))
    mention = mention.withColumn("title", title).withColumn("value", F.expr("substring(mention, length(title) + 1)"))
    pieces = cut(
        mention.select("row_key", "n", F.col("kind").alias("shown"), "title", F.length("mention").alias("length"), F.posexplode(parts).alias("part", "p"))
        .select("row_key", "n", "shown", "title", "length", "part", "p.kind", "p.canonical", "p.original")
    )
    given = assign(pieces, key)
    made = pieces.join(given, ["kind", "canonical"]).withColumn("made", rendered(F.col("kind"), F.col("original"), F.col("surrogate")))
    whole_mention = made.groupBy("row_key", "n", "shown", "title", "length").agg(F.sort_array(F.collect_list(F.struct("part", "made"))).alias("parts"))
    shown = F.concat("title", F.array_join(F.transform("parts", lambda p: p["made"]), " "))
    per_row = whole_mention.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("n", F.col("shown").alias("kind"), "length", shown.alias("surrogate")))).alias("made"))
    gaps = F.split("text", F.col("pattern"), -1)
    joined = found.join(per_row, "row_key").withColumn("gaps", gaps)
    text = F.concat(F.array_join(F.transform("made", lambda m, k: F.concat(F.get("gaps", k), m["surrogate"])), ""), F.element_at("gaps", -1))
    # A mention starts behind all gaps up to it and all mentions before it.
    upto = lambda k: F.aggregate(F.slice(F.col("gaps"), F.lit(1), k + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(F.col("made"), F.lit(1), k), F.lit(0), lambda a, m: a + m["length"])
    listed = F.transform("made", lambda m, k: F.struct(m["kind"].alias("kind"), upto(k).alias("start"), m["length"].alias("length"), m["surrogate"].alias("surrogate")))
    changed = joined.select(
        "doc_id",
        F.size("made").alias("n_mentions"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("made", lambda m: m["kind"]))), ",").alias("kinds"),
        listed.alias("mentions"),
        text.alias("text"),
    )
    kind = "array<struct<kind:string,start:int,length:int,surrogate:string>>"
    same = rows.filter(~held).select("doc_id", F.lit(0).alias("n_mentions"), F.lit("").alias("kinds"), F.array().cast(kind).alias("mentions"), "text")
    return changed.unionByName(same)
