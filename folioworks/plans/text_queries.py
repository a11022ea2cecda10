"""Search, detectors, redaction and the page-text table, over whole documents."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import fixtures as fx
from folioworks.functions.text import html_escape, pdf_escape, xml_escape
from folioworks.operators import redact, search, text_index, text_table
from folioworks.plans.duck_views import with_views
from folioworks.plans.registry import query

RECT = ["x0", "y0", "x1", "y1"]


def _flat(df: DataFrame, rect: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != rect], *[F.col(f"{rect}.{s}").alias(s) for s in RECT])


# ── literal search ──────────────────────────────────────────────────────────


def _search_sql(pattern: str, where: str = "true") -> str:
    return with_views(
        "page_text",
        rf"""
    WITH cut AS (SELECT *, string_split_regex(content, '{pattern}') AS p, regexp_extract_all(content, '{pattern}') AS m
                 FROM page_text WHERE {where}),
    hits AS (SELECT revision_id, page_index, content, p, m, unnest(range(len(m))) AS k FROM cut),
    placed AS (SELECT *, CAST(list_sum(list_transform(p[1:k+1], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) AS INTEGER) AS off,
                 length(m[k+1]) AS len FROM hits),
    lined AS (SELECT *, length(substr(content, 1, off)) - length(replace(substr(content, 1, off), chr(10), '')) AS ord
              FROM placed)
    SELECT revision_id, CAST(page_index + 1 AS INTEGER) AS page, CAST(k AS INTEGER) AS hit, off AS "offset",
        regexp_replace(replace(substr(content, greatest(off - 30, 0) + 1, off + len + 30 - greatest(off - 30, 0)),
            chr(10), ' '), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS snippet,
        72.0::DOUBLE AS x0, (710 - 12 * ord)::DOUBLE AS y0,
        (72 + 6 * length(string_split(content, chr(10))[ord + 1]))::DOUBLE AS x1, (720 - 12 * ord)::DOUBLE AS y1
    FROM lined""",
    )


@query("search_ignore_case", _search_sql("(?i)license"))
def search_ignore_case(spark, sf_dir):
    return _flat(search.search(fx.page_text(spark, sf_dir), "LICENSE"), "bounds")


@query("search_whole_word", _search_sql(r"\bthe\b"))
def search_whole_word(spark, sf_dir):
    hits = search.search(fx.page_text(spark, sf_dir), "the", match_case=True, whole_word=True)
    return _flat(hits, "bounds")


@query("search_one_page", _search_sql("(?i)tion", "page_index = 1"))
def search_one_page(spark, sf_dir):
    return _flat(search.search(fx.page_text(spark, sf_dir), "tion", page=2), "bounds")


@query(
    "search_word_spans",
    r"""WITH w AS (SELECT doc_id AS revision_id, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') AS content FROM documents),
        cut AS (SELECT *, string_split_regex(content, '(?i)the') AS p, regexp_extract_all(content, '(?i)the') AS m FROM w),
        hits AS (SELECT *, unnest(range(len(m))) AS k FROM cut),
        placed AS (SELECT *, CAST(list_sum(list_transform(p[1:k+1], lambda x: length(x))) + 3 * k AS INTEGER) AS off FROM hits)
        SELECT revision_id, CAST(k AS INTEGER) AS hit, off AS "offset",
            CAST(length(substr(content, 1, off)) - length(replace(substr(content, 1, off), ' ', '')) AS DOUBLE) AS x0 FROM placed""",
)
def search_word_spans(spark, sf_dir):
    """Every document one page, every word a span: thousands of spans and hundreds of hits in a row."""
    words = fx.texts(spark, sf_dir).withColumn("w", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    pages = words.select(
        "revision_id", F.lit(0).alias("page_index"), F.array_join("w", " ").alias("content"),
        F.expr("transform(w, (t, i) -> named_struct('text', t, 'bounds', named_struct("
               "'x0', CAST(i AS DOUBLE), 'y0', 0.0D, 'x1', i + 1.0D, 'y1', 1.0D)))").alias("spans"),
    )
    return search.search(pages, "the").select("revision_id", "hit", "offset", "bounds.x0")


#: Name, query, whole word, pattern: a word, a phrase with open ends, a phrase of whole words, a substring, two characters.
INDEXED = [
    ("word", "License", True, r"(?i)\blicense\b"),
    ("phrase", "d the", False, "(?i)d the"),
    ("words", "of the", True, r"(?i)\bof the\b"),
    ("substring", "heitung", False, "(?i)heitung"),
    ("short", "ß.", False, r"(?i)ß\."),
]


@query(
    "search_indexed",
    " UNION ALL ".join(f"SELECT '{name}' AS query, * FROM ({_search_sql(pattern)})" for name, _, _, pattern in INDEXED),
)
def search_indexed(spark, sf_dir):
    folder = f"{spark.sparkContext.getCheckpointDir()}/text-index-{uuid.uuid4().hex}"
    text_index.build(fx.page_text(spark, sf_dir), folder, buckets=8, parts=32, splits=1)
    found = [
        text_index.search_indexed(spark, folder, text, whole_word=whole).select(F.lit(name).alias("query"), "*")
        for name, text, whole, _ in INDEXED
    ]
    return _flat(reduce(DataFrame.unionByName, found), "bounds")


@query(
    "search_prefilter",
    with_views(
        "page_text",
        r"""SELECT revision_id, page_index FROM page_text WHERE content ILIKE '%und der%'
            OR list_has_all(string_split_regex(lower(content), '[^\p{L}\p{N}_]+'), ['und', 'der'])""",
    ),
)
def search_prefilter(spark, sf_dir):
    return search.search_prefilter(fx.page_text(spark, sf_dir), "und der").select("revision_id", "page_index")


@query(
    "token_table",
    with_views(
        "page_text",
        r"""SELECT token, count(*) AS pages FROM (SELECT DISTINCT revision_id, page_index,
            unnest(string_split_regex(lower(content), '[^\p{L}\p{N}_]+')) AS token FROM page_text)
            WHERE token <> '' GROUP BY token""",
    ),
)
def token_table(spark, sf_dir):
    return search.token_table(fx.page_text(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("pages"))


# ── detectors and patterns ──────────────────────────────────────────────────

JOINED = """joined AS (SELECT revision_id, page_index, string_agg(text, '' ORDER BY ord) AS joined FROM spans GROUP BY 1, 2),
    starts AS (SELECT revision_id, page_index, ord, x0, y0, x1, y1, length(text) AS len,
        coalesce(sum(length(text)) OVER (PARTITION BY revision_id, page_index ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM spans)"""

HITS = r"""
    SELECT h.revision_id, h.page_index, h.preset, 'srh-' || h.page_index || '-' || h.i AS hit_id,
        CAST(h.off AS INTEGER) AS "offset", substr(h.joined, h.off + 1, h.len) AS text,
        regexp_replace(regexp_replace(substr(h.joined, greatest(h.off - 25, 0) + 1,
            h.off + h.len + 40 - greatest(h.off - 25, 0)), '\s+', ' ', 'g'),
            '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS snippet,
        min(s.x0) AS x0, min(s.y0) AS y0, max(s.x1) AS x1, max(s.y1) AS y1
    FROM found h JOIN starts s ON s.revision_id = h.revision_id AND s.page_index = h.page_index
        AND s.start < h.off + h.len AND s.start + s.len > h.off
    GROUP BY ALL"""


def _regex_found(preset: str, pattern: str) -> str:
    """Hits of a pattern that DuckDB's engine runs as it is."""
    return rf"""SELECT revision_id, page_index, joined, '{preset}' AS preset, k AS i,
        CAST(list_sum(list_transform(p[1:k+1], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) AS BIGINT) AS off, length(m[k+1]) AS len
        FROM (SELECT *, unnest(range(len(m))) AS k FROM (SELECT *, string_split_regex(joined, '{pattern}') AS p,
            regexp_extract_all(joined, '{pattern}') AS m FROM joined))"""


def _guarded_found(preset: str, patterns: list[str], left_guard: bool) -> str:
    """Hits of a pattern with digit guards: try each start, take the first
    alternative not followed by a digit, then keep non-overlapping hits."""
    alternatives = ", ".join(f"length(regexp_extract(substr(joined, pos + 1, 40), '^{p}'))" for p in patterns)
    guard = "AND NOT regexp_matches(substr(joined, pos, 1), '^[0-9]$')" if left_guard else ""
    return rf"""SELECT revision_id, page_index, joined, '{preset}' AS preset, CAST(k AS BIGINT) AS i,
        keep[k+1].pos AS off, keep[k+1].len AS len
        FROM (SELECT *, unnest(range(len(keep))) AS k FROM (
          SELECT revision_id, page_index, joined, list_reduce(list_sort(list({{'pos': pos, 'len': len}})),
            lambda a, x: CASE WHEN x.pos >= a.e THEN {{'e': x.pos + x.len, 'keep': list_append(a.keep, x)}} ELSE a END,
            {{'e': CAST(0 AS BIGINT), 'keep': CAST([] AS STRUCT(pos BIGINT, len BIGINT)[])}}).keep AS keep
          FROM (SELECT revision_id, page_index, joined, CAST(pos AS BIGINT) AS pos,
                  CAST(list_filter([{alternatives}], lambda n: n > 0
                    AND NOT regexp_matches(substr(joined, pos + n + 1, 1), '^[0-9]$'))[1] AS BIGINT) AS len
                FROM (SELECT *, unnest(range(length(joined))) AS pos FROM joined
                      WHERE regexp_matches(joined, '{"|".join(patterns)}'))
                WHERE regexp_matches(substr(joined, pos + 1, 1), '^[0-9(+]$') {guard})
          WHERE len IS NOT NULL GROUP BY 1, 2, 3))"""


PHONE_BODY = r"\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}"
FOUND = {
    "ssn": _guarded_found("ssn", [r"\d{3}-\d{2}-\d{4}"], left_guard=True),
    "card": _guarded_found("card", [r"(?:\d{4}[-\s]?){3}\d{4}"], left_guard=True),
    "email": _regex_found("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    "phone": _guarded_found("phone", [r"\+?1[\s\-.]?" + PHONE_BODY, PHONE_BODY], left_guard=False),
    "iban": _regex_found("iban", r"\b[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]){11,30}\b"),
}
ALL_FOUND = " UNION ALL ".join(f"({sql})" for sql in FOUND.values())


@query("preset_scan", with_views("spans", f"WITH {JOINED}, found AS ({ALL_FOUND}) {HITS}"))
def preset_scan(spark, sf_dir):
    return _flat(search.preset_scan(fx.page_text(spark, sf_dir)), "rect")


@query("preset_email", with_views("spans", f"WITH {JOINED}, found AS ({FOUND['email']}) {HITS}"))
def preset_email(spark, sf_dir):
    return _flat(search.preset_scan(fx.page_text(spark, sf_dir), ["email"]), "rect")


@query(
    "pattern_regex",
    with_views("spans", f"WITH {JOINED}, found AS ({_regex_found('', '[A-Z][a-z]+tion')}) SELECT * EXCLUDE (preset) FROM ({HITS})"),
)
def pattern_regex(spark, sf_dir):
    return _flat(search.pattern_search(fx.page_text(spark, sf_dir), "[A-Z][a-z]+tion", regex=True), "rect")


@query(
    "pattern_literal",
    with_views("spans", f"WITH {JOINED}, found AS ({_regex_found('', '[.] The ')}) SELECT * EXCLUDE (preset) FROM ({HITS})"),
)
def pattern_literal(spark, sf_dir):
    return _flat(search.pattern_search(fx.page_text(spark, sf_dir), ". The "), "rect")


@query(
    "card_luhn",
    with_views(
        "spans",
        rf"""WITH {JOINED}, found AS ({FOUND['card']}),
        digits AS (SELECT revision_id, page_index, substr(joined, off + 1, len) AS text,
            regexp_replace(substr(joined, off + 1, len), '[^0-9]', '', 'g') AS d FROM found)
        SELECT revision_id, page_index, text, list_sum(list_transform(range(16), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(d[i+1] AS INT)
                 WHEN CAST(d[i+1] AS INT) > 4 THEN 2 * CAST(d[i+1] AS INT) - 9 ELSE 2 * CAST(d[i+1] AS INT) END)) % 10 = 0
            AS luhn_valid FROM digits""",
    ),
)
def card_luhn(spark, sf_dir):
    hits = search.preset_scan(fx.page_text(spark, sf_dir), ["card"])
    return hits.select("revision_id", "page_index", "text", search.luhn_valid(F.col("text")).alias("luhn_valid"))


@query(
    "hit_boxes",
    with_views(
        "spans",
        f"""WITH {JOINED}, found AS ({ALL_FOUND}), hits AS ({HITS})
        SELECT revision_id, preset, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM hits GROUP BY 1, 2""",
    ),
)
def hit_boxes(spark, sf_dir):
    hits = search.preset_scan(fx.page_text(spark, sf_dir))
    return search.bbox_union(hits, ["revision_id", "preset"])


@query(
    "search_paths_agree",
    with_views(
        "page_text",
        r"""WITH server AS (SELECT DISTINCT revision_id, page_index + 1 AS page FROM page_text WHERE content ILIKE '%repa%'),
        viewer AS (SELECT revision_id, page_index + 1 AS page FROM page_text
            WHERE contains(strip_accents(lower(content)), 'repa'))
        SELECT revision_id, CAST(page AS INTEGER) AS page, 'left' AS found_by FROM (FROM server EXCEPT FROM viewer)
        UNION ALL SELECT revision_id, CAST(page AS INTEGER), 'right' FROM (FROM viewer EXCEPT FROM server)""",
    ),
)
def search_paths_agree(spark, sf_dir):
    pages = fx.page_text(spark, sf_dir)
    server = search.search(pages, "repa").select("revision_id", "page").distinct()
    return search.hit_set_difference(server, search.viewer_pages(pages, "repa"))


# ── redaction ───────────────────────────────────────────────────────────────


def _accepted(hits: DataFrame) -> DataFrame:
    """The reviewer's choice: all hits but short phone numbers, and one unknown id."""
    chosen = hits.where(~((F.col("preset") == "phone") & (F.length("text") < 12))).select("revision_id", "preset", "hit_id")
    return chosen.unionByName(chosen.withColumn("hit_id", F.lit("srh-none")).distinct())


def _marks(spark, sf_dir) -> DataFrame:
    hits = search.preset_scan(fx.page_text(spark, sf_dir)).checkpoint()
    # hits and marks are few, and every redaction step reads them again
    return redact.marks_for_hits(hits, _accepted(hits)).checkpoint()


MARKS = f"""{JOINED}, found AS ({ALL_FOUND}), hits AS ({HITS}),
    marks AS (SELECT DISTINCT revision_id, page_index, x0, y0, x1, y1 FROM hits WHERE NOT (preset = 'phone' AND length(text) < 12))"""
COVERED = """covered AS (SELECT DISTINCT s.revision_id, s.page_index, s.ord, s.text FROM spans s JOIN marks m
    ON s.revision_id = m.revision_id AND s.page_index = m.page_index AND least(s.x1, m.x1) > greatest(s.x0, m.x0)
    AND least(s.y1, m.y1) > greatest(s.y0, m.y0))"""
REDACTED = """redacted AS (SELECT s.revision_id, s.page_index, string_agg(CASE WHEN c.ord IS NULL THEN s.text
    ELSE repeat('█', CAST(length(s.text) AS BIGINT)) END, chr(10) ORDER BY s.ord) AS content
    FROM spans s LEFT JOIN covered c USING (revision_id, page_index, ord) GROUP BY 1, 2)"""


@query("redaction_marks", with_views("spans", f"WITH {MARKS} FROM marks"))
def redaction_marks(spark, sf_dir):
    return _flat(_marks(spark, sf_dir), "rect")


@query(
    "spans_under_marks",
    with_views(
        "spans",
        f"WITH {MARKS}, {COVERED} SELECT DISTINCT revision_id, page_index, text FROM covered WHERE text <> ''",
    ),
)
def spans_under_marks(spark, sf_dir):
    return redact.spans_under_marks(fx.page_text(spark, sf_dir), _marks(spark, sf_dir))


def _with_spans(pages: DataFrame) -> DataFrame:
    return pages.select("revision_id", "page_index", "content", F.array_join(F.col("spans.text"), "|").alias("span_texts"))


@query(
    "redact_marks",
    with_views(
        "spans",
        f"""WITH {MARKS}, {COVERED}, {REDACTED} SELECT *, replace(content, chr(10), '|') AS span_texts FROM redacted""",
    ),
)
def redact_marks(spark, sf_dir):
    pages = fx.page_text(spark, sf_dir)
    return _with_spans(redact.redact_marks(pages, _marks(spark, sf_dir)))


@query(
    "redact_pattern",
    with_views(
        "page_text",
        r"""SELECT *, replace(content, chr(10), '|') AS span_texts FROM (
            SELECT revision_id, page_index, list_reduce(list_transform(range(len(p)), lambda k:
            p[k+1] || coalesce(repeat('█', CAST(length(m[k+1]) AS BIGINT)), '')), lambda a, x: a || x) AS content
        FROM (SELECT *, string_split_regex(content, '[0-9]+') AS p, regexp_extract_all(content, '[0-9]+') AS m
              FROM page_text))""",
    ),
)
def redact_pattern(spark, sf_dir):
    return _with_spans(redact.redact_pattern(fx.page_text(spark, sf_dir), "[0-9]+"))


#: Every third document is left unredacted, so that the check has something to find.
PARTLY = """partly AS (SELECT s.revision_id, s.page_index, string_agg(s.text, chr(10) ORDER BY s.ord) AS content
    FROM spans s WHERE s.revision_id % 3 = 0 GROUP BY 1, 2 UNION ALL SELECT * FROM redacted WHERE revision_id % 3 <> 0)"""


def _partly_redacted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(pages, texts under marks), with the marks applied in two of three documents."""
    pages, marks = fx.page_text(spark, sf_dir), _marks(spark, sf_dir)
    applied = redact.redact_marks(pages, marks.where(F.col("revision_id") % 3 != 0))
    return applied, redact.spans_under_marks(pages, marks)


@query(
    "redaction_survivors",
    with_views(
        "spans",
        f"""WITH {MARKS}, {COVERED}, {REDACTED}, {PARTLY}
        SELECT DISTINCT s.revision_id, s.page_index, s.text, r.page_index AS found_on, s.page_index = r.page_index AS same_page
        FROM (SELECT DISTINCT revision_id, page_index, text FROM covered WHERE text <> '') s
        JOIN partly r ON r.revision_id = s.revision_id
            AND (contains(r.content, s.text) OR contains(replace(r.content, chr(10), ''), s.text))""",
    ),
)
def redaction_survivors(spark, sf_dir):
    return redact.verify_absent(*_partly_redacted(spark, sf_dir))


@query(
    "failed_redaction_survivors",
    with_views(
        "spans page_text",
        f"""WITH {MARKS}, {COVERED}
        SELECT s.revision_id, s.page_index, s.text, r.page_index AS found_on, s.page_index = r.page_index AS same_page
        FROM (SELECT DISTINCT revision_id, page_index, text FROM covered WHERE text <> '') s
        JOIN page_text r ON r.revision_id = s.revision_id
            AND (contains(r.content, s.text) OR contains(replace(r.content, chr(10), ''), s.text))""",
    ),
)
def failed_redaction_survivors(spark, sf_dir):
    """The check on pages whose redaction was never applied: every text survives."""
    pages, marks = fx.page_text(spark, sf_dir), _marks(spark, sf_dir)
    return redact.verify_absent(pages, redact.spans_under_marks(pages, marks))


@query(
    "release_gate",
    with_views(
        "spans",
        f"""WITH {MARKS}, {COVERED}, {REDACTED}, {PARTLY}
        SELECT revision_id, count(*) AS pages FROM partly WHERE revision_id NOT IN (
            SELECT s.revision_id FROM covered s JOIN partly r ON r.revision_id = s.revision_id
            AND s.text <> '' AND (contains(r.content, s.text) OR contains(replace(r.content, chr(10), ''), s.text))) GROUP BY 1""",
    ),
)
def release_gate(spark, sf_dir):
    redacted, texts = _partly_redacted(spark, sf_dir)
    survivors = redact.verify_absent(redacted, texts)
    return redact.release_gate(redacted, survivors).groupBy("revision_id").agg(F.count("*").alias("pages"))


# ── page-text table ─────────────────────────────────────────────────────────


def _new_spans(spark, sf_dir) -> DataFrame:
    """A re-extraction: the even pages of every document again, marked, and a new page each."""
    pages = fx.page_text(spark, sf_dir)
    spans = pages.select("revision_id", "page_index", F.posexplode("spans").alias("ord", "s")).select(
        "revision_id", "page_index", "ord", F.col("s.text").alias("text"), F.col("s.bounds").alias("bounds")
    )
    again = spans.where("page_index % 2 = 0").withColumn("text", F.concat(F.lit("again: "), "text"))
    extra = spans.where("page_index = 0").withColumn("page_index", F.lit(1000))
    return again.unionByName(extra)


@query(
    "page_text_upsert",
    with_views(
        "spans page_text",
        """WITH fresh AS (SELECT revision_id, page_index, string_agg(text, chr(10) ORDER BY ord) AS content FROM (
            SELECT revision_id, page_index, ord, 'again: ' || text AS text FROM spans WHERE page_index % 2 = 0
            UNION ALL SELECT revision_id, 1000, ord, text FROM spans WHERE page_index = 0) GROUP BY 1, 2)
        SELECT revision_id, page_index, coalesce(f.content, o.content) AS content
        FROM page_text o FULL JOIN fresh f USING (revision_id, page_index)""",
    ),
)
def page_text_upsert(spark, sf_dir):
    fresh = text_table.pages_from_spans(_new_spans(spark, sf_dir))
    merged = text_table.upsert(fx.page_text(spark, sf_dir), fresh)
    return merged.select("revision_id", "page_index", "content")


@query(
    "mark_has_text",
    with_views(
        "page_text",
        """SELECT revision_id, page_index, page_index % 3 <> 0 AND content <> '' AS has_text FROM page_text""",
    ),
)
def mark_has_text(spark, sf_dir):
    pages = fx.document_pages(spark, sf_dir).drop("has_text")
    extracted = fx.page_text(spark, sf_dir).where("page_index % 3 <> 0")
    return text_table.mark_has_text(pages, extracted).select("revision_id", "page_index", "has_text")


@query(
    "reading_order_text",
    with_views("spans", "SELECT revision_id, page_index, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1, 2"),
)
def reading_order_text(spark, sf_dir):
    return text_table.reading_order_text(fx.page_text(spark, sf_dir))


@query(
    "escapes",
    r"""SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
        replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
        replace(replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(10), '\n'), chr(13), '\r') AS pdf
        FROM documents""",
)
def escapes(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", html_escape(text).alias("html"), xml_escape(text).alias("xml"), pdf_escape(text).alias("pdf")
    )


@query(
    "viewer_normalised",
    r"""SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'),
        '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS normal FROM documents""",
)
def viewer_normalised(spark, sf_dir):
    from folioworks.functions.text import normalised

    return fx.table(spark, sf_dir, "documents").select("doc_id", normalised(F.col("text")).alias("normal"))
