"""Personal data replaced by surrogates, in DataFrame functions only.

One pattern finds entities in whole texts. Each entity, in canonical form (so
that spellings of one number or address agree), gets a surrogate derived from a
keyed hash: of the same type, as many digits, the same alphabet; names by the
gender of their title and by script. Distinct entities keep distinct surrogates
and no surrogate is an entity of the corpus: surrogates that collide are found by
joins, all but the smallest entity derive a new one, until none collide. The
same entity has the same surrogate in every document, and each mention takes
over the punctuation, spacing and case of what it replaces.

The table of surrogates is built from distinct entities; texts are joined by
their hash with the replacements of their own mentions, so equal texts, however
many, are worked out once, and texts without a mention are not shuffled.

Defined results: null and empty texts, and texts without a mention, are
unchanged. Other columns stay as they are. Repeated rows are replaced alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import cut, free_name

#: Titles by script and gender.
TITLES = {
    ("latin", "m"): ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don"],
    ("latin", "f"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña"],
    ("latin", "n"): ["Dr", "Prof"],
    ("cyrillic", "m"): ["господин", "г-н"],
    ("cyrillic", "f"): ["госпожа", "г-жа"],
}
_TITLE = "(?:" + "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t))) + ")"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]+"

#: Kinds in the order they are tried at one place. What stands left of a mention is checked once for all (BEHIND).
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,}",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[A-Z0-9]{16}|(?i:(?<=password=)|(?<=secret=)|(?<=token=))[^\s\"|]{8,})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?:(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}|(?<!\d[.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![.\-]))(?!\d)",
    "name": rf"{_TITLE}\.? {_NAME}(?: {_NAME})?",
}
BEHIND = r"(?<![\p{L}\p{N}])"
PATTERN = BEHIND + "(?:" + "|".join(PATTERNS.values()) + ")"
DIGIT_KINDS = ("card", "ssn")
#: Country calling codes. The code of an international number is read from here, however it is spaced.
CALLING_CODE = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-69]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])\d)"
#: A calling code stays where so many digits follow, and for so many attempts, so that enough surrogates are left.
LEAST_REST, CODED_ATTEMPTS = 6, 32
#: Syllables of made-up names by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ha he ja jo ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve",
    "cyrillic": "ба бе бо ва ве во га го да де до за зе зо ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то фа хо",
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "ra", ("latin", "n"): "s", ("cyrillic", "m"): "н", ("cyrillic", "f"): "ра", ("cyrillic", "n"): "с"}


#: What a mention without a title has at least: a digit, an at sign, the mark of a secret or a hex string of letters.
QUICK = r"[0-9@]|AKIA|(?i:password=|secret=|token=)|[a-f]{32}|[A-F]{32}"


def _may_have(text: Column) -> Column:
    """Whether a text can have a mention at all: a quick look for what PATTERN cannot do without."""
    quick = F.regexp_like(text, F.lit(QUICK))
    for titles in TITLES.values():
        for title in titles:
            quick = quick | F.contains(text, F.lit(title))
    return quick


def has_mention(text: Column) -> Column:
    return F.coalesce(F.when(_may_have(text), F.regexp_like(text, F.lit(PATTERN))), F.lit(False))


def session_key(spark: SparkSession) -> str:
    """The secret that surrogates are derived from, as the session sets it; the default is for tests only."""
    return spark.conf.get("spark.folioworks.pii.key", "folioworks-test-key")


def find(text: Column) -> Column:
    """Mentions of a text in order of appearance."""
    return F.when(_may_have(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def _kind(mention: Column) -> Column:
    found = F.lit("secret")
    for kind in reversed(PATTERNS):
        if kind != "secret":
            found = F.when(F.regexp_like(mention, F.lit(f"^(?:{PATTERNS[kind]})$")), F.lit(kind)).otherwise(found)
    return found


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _title_of(name: Column, what: int, default: str) -> Column:
    """Script (0) or gender (1) of the title a name mention begins with."""
    title, found = F.regexp_extract(name, rf"^({_TITLE})", 1), F.lit(default)
    for key, titles in TITLES.items():
        found = F.when(title.isin(*titles), F.lit(key[what])).otherwise(found)
    return found


def entities(mention: Column, kind: Column) -> Column:
    """The entities of a mention as array<struct<kind, canonical>>: one, or a given name and a surname."""
    words = F.split(F.lower(F.regexp_replace(mention, rf"^{_TITLE}\.? ", "")), " ")
    script, gender = _title_of(mention, 0, "latin"), _title_of(mention, 1, "n")
    surname = F.struct(F.concat_ws("_", F.lit("surname"), script, F.lit("n")).alias("kind"), F.element_at(words, -1).alias("canonical"))
    given = F.struct(F.concat_ws("_", F.lit("given"), script, gender).alias("kind"), F.element_at(words, 1).alias("canonical"))
    plain = F.when(kind == "email", F.lower(mention)).when(kind.isin(*DIGIT_KINDS), _digits(mention))
    plain = plain.when(kind == "phone", F.concat(F.regexp_extract(mention, r"^\+?", 0), _digits(mention)))
    plain = plain.when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "secret", F.lower(mention)).otherwise(mention)
    one = F.array(F.struct(kind.alias("kind"), plain.alias("canonical")))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(one)


def _stream(key: str, salt: str) -> Column:
    """128 hex digits of keyed hash for an entity and attempt."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(salt), F.col("kind"), F.col("attempt"), F.col("canonical")), 512)


def _decimal(key: str, n: Column) -> Column:
    """n keyed decimal digits (n up to 64)."""
    both = F.concat(_stream(key, "a"), _stream(key, "b"))
    return F.substr(F.rpad(F.translate(both, "abcdef", ""), 64, "7"), F.lit(1), n)


def _letters(key: str, salt: str, n: int) -> Column:
    """n keyed lower-case letters."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substr(_stream(key, salt), i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.array_join(F.transform(pairs, lambda x: F.char(F.lit(97) + x % 26)), "")


def _shaped(key: str, canonical: Column) -> Column:
    """Keyed characters of the same classes as the canonical form's, for secrets and account numbers.

    A hex string stays hex; elsewhere digits stay digits and letters stay letters.
    """
    hexed = F.regexp_like(canonical, F.lit("^(?=.*[a-f])[0-9a-f]+$"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.expr("char_length(canonical) div 128").cast("int")),
        lambda i: F.sha2(F.concat_ws("|", F.lit(key), i, F.col("kind"), F.col("attempt"), canonical), 512),
    )
    stream = F.array_join(blocks, "")
    pour = F.transform(
        F.split(canonical, ""),
        lambda c, i: F.when(F.regexp_like(c, F.lit(r"\d")), F.translate(F.substr(stream, i + 1, F.lit(1)), "abcdef", "012345"))
        .when(F.regexp_like(c, F.lit("[a-z]")), F.translate(F.substr(stream, i + 1, F.lit(1)), "0123456789", "ghijklmnpq"))
        .when(F.regexp_like(c, F.lit("[A-Z]")), F.upper(F.translate(F.substr(stream, i + 1, F.lit(1)), "0123456789", "ghijklmnpq")))
        .otherwise(c),
    )
    return F.when(hexed, F.substr(stream, F.lit(1), F.char_length(canonical))).otherwise(F.array_join(pour, ""))


def _with_check_digit(body: Column, original: Column) -> Column:
    """body, its last digit set so that the Luhn check holds if it holds for the original."""
    head = F.substr(body, F.lit(1), F.char_length(body) - 1)
    fits = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(head, d)))
    return F.when(F.call_function("luhn_check", original), F.concat(head, F.get(fits, F.lit(0)))).otherwise(body)


def _iban(key: str) -> Column:
    """A keyed account number of the same country and shape, with right check digits."""
    country, rest = F.substr("canonical", F.lit(1), F.lit(2)), _shaped(key, F.substr("canonical", F.lit(5)))
    # letters count as 10 to 35; the remainder is taken digit by digit
    spelled = F.array_join(F.transform(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: F.conv(c, 36, 10)), "")
    left = F.aggregate(F.split(spelled, ""), F.lit(0), lambda a, d: ((a * 10 + d.cast("int")) % 97).cast("int"))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _ip(key: str) -> Column:
    octets = [F.conv(F.substr(_stream(key, "a"), F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int") for i in range(4)]
    return F.concat_ws(".", octets[0] % 223 + 1, *[o % 256 for o in octets[1:]])


def _name(key: str) -> Column:
    out = F.lit(None).cast("string")
    for (script, gender), ending in ENDINGS.items():
        known = F.array(*[F.lit(s) for s in SYLLABLES[script].split()])
        parts = [
            F.element_at(known, (F.conv(F.substr(_stream(key, "a"), F.lit(6 * i + 1), F.lit(6)), 16, 10).cast("long") % F.size(known) + 1).cast("int"))
            for i in range(4)
        ]
        out = F.when(F.col("kind").endswith(f"_{script}_{gender}"), F.concat(*parts, F.lit(ending))).otherwise(out)
    return out


def _phone(key: str) -> Column:
    """Keyed digits; an international number keeps its plus sign and calling code."""
    full = F.col("canonical")
    plus, code, n = F.regexp_extract(full, r"^\+?", 0), F.regexp_extract(full, CALLING_CODE, 1), F.char_length(_digits(full))
    rest = n - F.char_length(code)
    coded = (rest >= LEAST_REST) & (F.col("attempt") < CODED_ATTEMPTS)
    return F.concat(plus, F.when(coded, F.concat(code, _decimal(key, rest))).otherwise(_decimal(key, n)))


def _candidate(key: str) -> Column:
    """The canonical surrogate of an entity for its attempt."""
    kind, n = F.col("kind"), F.char_length("canonical")
    return (
        F.when(kind == "email", F.concat(_letters(key, "a", 10), F.lit("@"), _letters(key, "b", 6), F.lit(".example")))
        .when(kind == "card", _with_check_digit(_decimal(key, n), F.col("canonical")))
        .when(kind == "ssn", _decimal(key, n))
        .when(kind == "phone", _phone(key))
        .when(kind == "ip", _ip(key))
        .when(kind == "iban", _iban(key))
        .when((kind == "secret") & F.col("canonical").startswith("akia"), F.concat(F.lit("akia"), _shaped(key, F.substr("canonical", F.lit(5)))))
        .when(kind == "secret", _shaped(key, F.col("canonical")))
        .otherwise(_name(key))
    )


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical).

    Within a kind no two surrogates are equal and none is an entity, for phone numbers with or without a plus sign. A round settles all but what collides, so the
    rounds needed grow with the logarithm of the number of entities.
    """

    def bare(c: str) -> Column:
        return F.when(F.col("kind") == "phone", _digits(F.col(c))).otherwise(F.col(c)).alias("bare")

    known = cut(found.select("kind", "canonical").distinct())
    settled, open_, attempt = None, known, 0
    while True:
        tried = open_.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _candidate(key))
        tried = tried.select("kind", "canonical", "surrogate", bare("surrogate"))
        taken = known.select("kind", bare("canonical"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", bare("surrogate")))
        free = tried.join(taken, ["kind", "bare"], "left_anti")
        first = F.min(F.struct("canonical", "surrogate")).alias("_f")
        won = cut(free.groupBy("kind", "bare").agg(first).select("kind", "_f.canonical", "_f.surrogate"))
        settled = won if settled is None else cut(settled.unionByName(won))
        open_ = cut(open_.join(won, ["kind", "canonical"], "left_anti"))
        attempt += 1
        if open_.isEmpty():
            return settled


def _pour(mention: Column, digits: Column) -> Column:
    """The digits put in place of the digits of a mention."""

    def put(c: Column, i: Column) -> Column:
        nth = F.char_length(_digits(F.substr(mention, F.lit(1), i + 1)))
        return F.when(F.regexp_like(c, F.lit(r"\d")), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(mention, ""), put), "")


def _written(mention: Column, kind: Column, cores: Column) -> Column:
    """A mention's replacement in its own format; cores are the surrogates of its entities."""
    core = F.get(cores, F.lit(0))
    spaced = F.regexp_like(mention, F.lit(" "))
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(core)).otherwise(core)
    iban = F.when(spaced, F.trim(F.regexp_replace(core, "(.{4})", "$1 "))).otherwise(core)
    title = F.regexp_extract(mention, rf"^({_TITLE}\.? )", 1)
    name = F.concat(title, F.array_join(F.transform(cores, F.initcap), " "))
    return (
        F.when(kind.isin("card", "ssn", "phone"), _pour(mention, _digits(core)))
        .when(kind == "iban", iban)
        .when(kind == "ip", core)
        .when(kind == "name", name)
        .otherwise(cased)
    )


def replacements(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(h1, h2, written): for each different text with mentions, what to write for each of them, in order."""
    mentions = find(F.col(text_col)).alias("mentions")
    texts = docs.select(*_hashes(F.col(text_col)), mentions).where(F.size("mentions") > 0)
    texts = cut(texts.groupBy("h1", "h2").agg(F.first("mentions").alias("mentions")))  # equal texts have equal mentions
    rows = texts.select("h1", "h2", F.posexplode("mentions").alias("i", "mention")).withColumn("what", _kind(F.col("mention")))
    rows = rows.withColumn("parts", entities(F.col("mention"), F.col("what")))
    parts = rows.select("h1", "h2", "i", "mention", "what", F.posexplode("parts").alias("j", "_p")).select(
        "h1", "h2", "i", "mention", "what", "j", "_p.kind", "_p.canonical"
    )
    parts = cut(parts)
    met = parts.join(surrogates(parts, key), ["kind", "canonical"])
    cores = F.sort_array(F.collect_list(F.struct("j", "surrogate")))["surrogate"]
    whole = met.groupBy("h1", "h2", "i", "mention", "what").agg(cores.alias("cores"))
    whole = whole.withColumn("written", _written(F.col("mention"), F.col("what"), F.col("cores")))
    return whole.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("i", "written")))["written"].alias("written"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the personal data of the text column replaced; count_col, if given, gets the number of mentions."""
    a, b, new, count = (free_name(docs, c) for c in ("_h1", "_h2", "_written", "_mentions"))
    written = cut(replacements(docs, text_col, key)).select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("written").alias(new))
    text = F.col(text_col)
    touched = has_mention(text)
    h1, h2 = _hashes(text)
    hit = docs.where(touched).withColumns({a: h1, b: h2}).join(written, [a, b])
    between = F.split(text, PATTERN, -1)
    merged = F.array_join(F.zip_with(between, F.col(new), lambda s, w: F.concat(s, F.coalesce(w, F.lit("")))), "")
    hit = hit.withColumn(count, F.size(new).cast("long")).withColumn(text_col, merged).drop(a, b, new)
    out = hit.unionByName(docs.where(~touched).withColumn(count, F.lit(0).cast("long")))
    return out.withColumnRenamed(count, count_col) if count_col else out.drop(count)
