"""Annotations, replies, form values, files and URLs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import fixtures as fx
from folioworks.functions.text import content_preview, kind_label, short_datetime
from folioworks.operators import annotations as notes
from folioworks.plans.duck_views import with_views
from folioworks.plans.registry import query
from folioworks.sources import files, forms, urls, xfdf

NOTES_NOW = datetime.datetime(2024, 1, 3, 15)

# ── filters, threads, counts ────────────────────────────────────────────────


@query(
    "comment_filter",
    with_views(
        "annotations",
        """SELECT annotation_id FROM annotations WHERE author = 'user' AND kind NOT IN ('highlight', 'underline', 'strikethrough', 'squiggly')
            AND NOT resolved AND inserted_at >= date_trunc('week', TIMESTAMP '2024-01-03 15:00:00')""",
    ),
)
def comment_filter(spark, sf_dir):
    kept = notes.comment_filter(fx.annotations(spark, sf_dir), NOTES_NOW, "user", ["text_markup"], "open", "this_week")
    return kept.select("annotation_id")


@query(
    "comment_filter_older",
    with_views(
        "annotations",
        """SELECT annotation_id, author FROM annotations WHERE resolved AND inserted_at < TIMESTAMP '2024-02-01'""",
    ),
)
def comment_filter_older(spark, sf_dir):
    now = datetime.datetime(2024, 2, 20)
    kept = notes.comment_filter(fx.annotations(spark, sf_dir), now, status="resolved", period="older")
    return kept.select("annotation_id", "author")


@query(
    "annotation_order",
    with_views("annotations", "SELECT document_id, page_index, inserted_at, annotation_id FROM annotations ORDER BY ALL"),
)
def annotation_order(spark, sf_dir):
    ordered = notes.annotation_order(fx.annotations(spark, sf_dir))
    return ordered.select("document_id", "page_index", "inserted_at", "annotation_id")


@query(
    "reply_authors",
    with_views(
        "replies",
        """SELECT reply_id, coalesce('user' || c_custkey || '@example.com', 'Unknown') AS author_email
            FROM replies LEFT JOIN customer ON c_custkey = reply_id * 7 % 2000""",
    ),
)
def reply_authors(spark, sf_dir):
    users = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "concat('user', c_custkey, '@example.com') AS email")
    replies = fx.replies(spark, sf_dir).withColumn("user_id", F.expr("reply_id * 7 % 2000"))
    return notes.reply_authors(replies, users).select("reply_id", "author_email")


@query(
    "threads",
    with_views(
        "annotations replies",
        """SELECT annotation_id, document_id, page_index, kind, CAST(CASE WHEN reply_id IS NOT NULL THEN row_number() OVER (
            PARTITION BY annotation_id ORDER BY r.inserted_at, reply_id) END AS INTEGER) AS reply_no, reply_id, body,
            r.inserted_at AS replied_at FROM annotations a LEFT JOIN replies r USING (annotation_id)""",
    ),
)
def threads(spark, sf_dir):
    return notes.threads(fx.annotations(spark, sf_dir), fx.replies(spark, sf_dir))


@query(
    "reply_counts",
    with_views(
        "annotations replies",
        """SELECT annotation_id, (SELECT count(*) FROM replies r WHERE r.annotation_id = a.annotation_id) AS replies_count FROM annotations a""",
    ),
)
def reply_counts(spark, sf_dir):
    counted = notes.reply_counts(fx.annotations(spark, sf_dir), fx.replies(spark, sf_dir))
    return counted.select("annotation_id", "replies_count")


@query(
    "page_groups",
    with_views(
        "annotations",
        """SELECT document_id, page_index, annotation_id, CAST(row_number() OVER (PARTITION BY document_id, page_index
            ORDER BY inserted_at, annotation_id) AS INTEGER) AS position FROM annotations""",
    ),
)
def page_groups(spark, sf_dir):
    grouped = notes.page_groups(fx.annotations(spark, sf_dir))
    return grouped.select("document_id", "page_index", "annotation_id", "position")


@query(
    "distinct_authors",
    with_views(
        "annotations replies",
        "SELECT DISTINCT author FROM (SELECT author FROM annotations UNION ALL SELECT author || reply_id % 5 FROM replies) ORDER BY 1",
    ),
)
def distinct_authors(spark, sf_dir):
    people = fx.annotations(spark, sf_dir).select("author").union(
        fx.replies(spark, sf_dir).selectExpr("concat(author, reply_id % 5)")
    )
    return notes.distinct_authors(people)


@query(
    "combined_rows",
    with_views(
        "annotations replies",
        """SELECT annotation_id, NULL AS reply_id, author, contents AS text FROM annotations
            UNION SELECT annotation_id, reply_id, author, body FROM replies""",
    ),
)
def combined_rows(spark, sf_dir):
    annotations, replies = fx.annotations(spark, sf_dir), fx.replies(spark, sf_dir)
    return notes.combined_rows(annotations.unionByName(annotations), replies)


@query(
    "comment_labels",
    with_views(
        "annotations",
        """SELECT annotation_id, CASE kind WHEN 'highlight' THEN 'Highlight' WHEN 'free_text_callout' THEN 'Free Text Callout'
            WHEN 'measure_area' THEN 'Measure Area' ELSE 'Sticky Note' END AS label,
            CASE WHEN strlen(contents) > 80 THEN contents[:80] || '…' ELSE contents END AS preview,
            strftime(inserted_at, '%b %d, %H:%M') AS shown_at FROM annotations""",
    ),
)
def comment_labels(spark, sf_dir):
    return fx.annotations(spark, sf_dir).select(
        "annotation_id",
        kind_label(F.col("kind")).alias("label"),
        content_preview(F.col("contents")).alias("preview"),
        short_datetime(F.col("inserted_at")).alias("shown_at"),
    )


# ── checks ──────────────────────────────────────────────────────────────────


def _flat_reasons(rejected: DataFrame, *columns: str) -> DataFrame:
    return rejected.select(*columns, F.array_join("reasons", "; ").alias("reasons"))


@query(
    "kind_rejects",
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 6 = 0 THEN 'page_index is missing' END,
            CASE WHEN event_type = 'error' THEN 'kind is missing' END,
            CASE WHEN event_type IN ('click', 'signup') THEN 'kind is unknown' END) AS reasons
        FROM events WHERE event_id % 6 = 0 OR event_type IN ('error', 'click', 'signup')""",
)
def kind_rejects(spark, sf_dir):
    drafts = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS revision_id", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 9 END AS page_index",
        "CASE event_type WHEN 'view' THEN 'highlight' WHEN 'purchase' THEN 'ink' WHEN 'error' THEN NULL ELSE event_type END AS kind",
    )
    return _flat_reasons(notes.split_valid(drafts, notes.annotation_rules())[1], "event_id")


@query(
    "text_edits_accepted",
    "SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 11 <> 0",
)
def text_edits_accepted(spark, sf_dir):
    drafts = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS document_id",
        "CASE event_type WHEN 'view' THEN 'add_text' WHEN 'purchase' THEN 'bates' WHEN 'error' THEN NULL ELSE event_type END AS kind",
    )
    return notes.split_valid(drafts, notes.text_edit_rules())[0].select("event_id")


@query(
    "signer_rejects",
    """SELECT signer_id, reasons FROM (SELECT c_custkey AS signer_id, concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'name is missing' END,
            CASE WHEN c_custkey % 5 = 1 THEN 'name is too long' END, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN 'email is malformed' END,
            CASE WHEN c_custkey % 7 = 3 THEN 'email is too long' END) AS reasons FROM customer) WHERE reasons <> ''""",
)
def signer_rejects(spark, sf_dir):
    signers = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS signer_id", "c_custkey AS envelope_id",
        "CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN repeat(c_name, 15) ELSE c_name END AS name",
        "CASE c_custkey % 7 WHEN 0 THEN 'no at sign' WHEN 1 THEN 'a@b,c' WHEN 2 THEN 'two@at@signs' "
        "WHEN 3 THEN concat(repeat('x', 160), '@example.com') ELSE concat(c_custkey, '@example.com') END AS email",
    )
    return _flat_reasons(notes.split_valid(signers, notes.signer_rules())[1], "signer_id")


@query(
    "field_rejects",
    """SELECT o_orderkey AS field_id, concat_ws('; ', CASE WHEN o_orderkey * 3 - 100 NOT BETWEEN 0 AND 9999 THEN 'page_index is outside 0..9999' END,
            CASE WHEN o_orderkey % 4 = 0 THEN 'kind is missing' END) AS reasons FROM orders
        WHERE o_orderkey * 3 - 100 NOT BETWEEN 0 AND 9999 OR o_orderkey % 4 = 0""",
)
def field_rejects(spark, sf_dir):
    fields = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS field_id", "o_orderkey * 3 - 100 AS page_index", "CASE WHEN o_orderkey % 4 <> 0 THEN 'signature' END AS kind"
    )
    return _flat_reasons(notes.split_valid(fields, notes.field_rules())[1], "field_id")


# ── exchange formats ────────────────────────────────────────────────────────


@query(
    "annotations_csv",
    with_views(
        "annotations replies",
        """SELECT document_id, CAST(page_index + 1 AS VARCHAR) AS "Page", CASE kind WHEN 'highlight' THEN 'Highlight'
                WHEN 'free_text_callout' THEN 'Free Text Callout' WHEN 'measure_area' THEN 'Measure Area' ELSE 'Sticky Note' END AS "Type",
            author AS "Author", contents AS "Content", strftime(inserted_at, '%Y-%m-%d %H:%M:%S UTC') AS "Date",
            CASE WHEN resolved THEN 'Resolved' ELSE 'Open' END AS "Status", '' AS "Replies", CAST(annotation_id AS VARCHAR) AS "ID" FROM annotations
        UNION ALL SELECT a.document_id, '', 'Reply', '', r.body, strftime(r.inserted_at, '%Y-%m-%d %H:%M:%S UTC'), '',
            CAST(r.annotation_id AS VARCHAR), CAST(r.reply_id AS VARCHAR) FROM replies r JOIN annotations a USING (annotation_id)""",
    ),
)
def annotations_csv(spark, sf_dir):
    return notes.csv_rows(fx.annotations(spark, sf_dir), fx.replies(spark, sf_dir)).drop("ord")


def _drawn(spark, sf_dir) -> DataFrame:
    """Annotations with the columns the exchange formats need."""
    return fx.annotations(spark, sf_dir).withColumns(
        {
            "rect": F.expr("named_struct('x0', 10.0D, 'y0', 20.5D, 'x1', CAST(100 + annotation_id % 9 AS DOUBLE), 'y1', 40.0D)"),
            "color": F.expr("CASE WHEN annotation_id % 2 = 0 THEN '#ff8000' END"),
            "opacity": F.expr("CASE WHEN annotation_id % 5 = 0 THEN 0.5D ELSE 1.0D END"),
        }
    )


XML_TEXT = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""
PDF_TEXT = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '(', '\('), ')', '\)'), chr(10), '\n'), chr(13), '\r')"""


@query(
    "annotations_xfdf",
    with_views(
        "annotations replies",
        f"""WITH a AS (SELECT *, CASE kind WHEN 'highlight' THEN 'highlight' WHEN 'free_text_callout' THEN 'free-text'
            WHEN 'measure_area' THEN 'polygon' ELSE 'text' END AS tag FROM annotations)
        SELECT document_id, 0 AS section, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">'
            || chr(10) || '  <annots>' AS line FROM (SELECT DISTINCT document_id FROM a)
        UNION ALL SELECT document_id, 1, '    <' || tag || ' page="' || page_index || '" rect="10.0,20.5,' || (100 + annotation_id % 9) || '.0,40.0"'
            || CASE WHEN annotation_id % 2 = 0 THEN ' color="#ff8000"' ELSE '' END || ' date="' || strftime(inserted_at, 'D:%Y%m%d%H%M%S''00''')
            || '" title="' || author || '"' || CASE WHEN resolved THEN ' flags="print,resolved"' ELSE '' END || '>' || chr(10)
            || '      <contents>' || {XML_TEXT.format('contents')} || '</contents>' FROM a
        UNION ALL SELECT document_id, 1, '    </' || tag || '>' FROM a
        UNION ALL SELECT document_id, 1, '      <reply-to>' || chr(10) || '        <contents>' || {XML_TEXT.format('body')} || '</contents>' || chr(10)
            || '        <date>' || strftime(r.inserted_at, 'D:%Y%m%d%H%M%S''00''') || '</date>' || chr(10) || '      </reply-to>'
            FROM replies r JOIN a USING (annotation_id)
        UNION ALL SELECT DISTINCT document_id, 2, '  </annots>' || chr(10) || '</xfdf>' FROM a""",
    ),
)
def annotations_xfdf(spark, sf_dir):
    return notes.xfdf_lines(_drawn(spark, sf_dir), fx.replies(spark, sf_dir)).drop("ord")


@query(
    "annotations_fdf",
    with_views(
        "annotations replies",
        f"""WITH r AS (SELECT *, row_number() OVER w AS n, lead(reply_id) OVER w AS later FROM replies
                WINDOW w AS (PARTITION BY annotation_id ORDER BY inserted_at, reply_id)),
        body AS (SELECT document_id, 1 AS section, '<<' || chr(10) || '  /Type /Annot' || chr(10) || '  /Subtype /' || CASE kind WHEN 'highlight' THEN 'Highlight'
                WHEN 'free_text_callout' THEN 'FreeText' WHEN 'measure_area' THEN 'Polygon' ELSE 'Text' END || chr(10)
            || '  /Rect [10.0 20.5 ' || (100 + annotation_id % 9) || '.0 40.0]' || chr(10) || '  /Contents (' || {PDF_TEXT.format('contents')} || ')' || chr(10)
            || '  /P ' || page_index || chr(10) || '  /T (' || author || ')' || chr(10) || '  /CreationDate (' || strftime(inserted_at, 'D:%Y%m%d%H%M%S''00''') || ')'
            || CASE WHEN annotation_id % 2 = 0 THEN chr(10) || '  /C [1.0 0.502 0.0]' ELSE '' END
            || CASE WHEN annotation_id % 5 = 0 THEN chr(10) || '  /CA 0.5' ELSE '' END || CASE WHEN resolved THEN chr(10) || '  /F 4' ELSE '' END AS line FROM annotations
        UNION ALL SELECT document_id, 1, '>>' FROM annotations
        UNION ALL SELECT a.document_id, 1, CASE WHEN n = 1 THEN '  /Annots [' ELSE '    ' END || '<< /Type /Annot /Subtype /Text /Contents (' || {PDF_TEXT.format('body')}
            || ') /CreationDate (' || strftime(r.inserted_at, 'D:%Y%m%d%H%M%S''00''') || ') /IRT ' || r.annotation_id || ' >>' || CASE WHEN later IS NULL THEN ']' ELSE '' END
            FROM r JOIN annotations a USING (annotation_id)
        UNION ALL SELECT DISTINCT document_id, 0, '%FDF-1.2' || chr(10) || '1 0 obj' || chr(10) || '<< /FDF << /Annots [' FROM annotations
        UNION ALL SELECT DISTINCT document_id, 2, '] >> >>' || chr(10) || 'endobj' FROM annotations)
        FROM body UNION ALL SELECT document_id, 3, 'xref' || chr(10) || '0 2' || chr(10) || '0000000000 65535 f ' || chr(10) || '0000000009 00000 n ' || chr(10)
            || 'trailer' || chr(10) || '<< /Root 1 0 R /Size 2 >>' || chr(10) || 'startxref' || chr(10) || CAST(sum(strlen(line) + 1) AS BIGINT) || chr(10) || '%%EOF'
            FROM body GROUP BY document_id""",
    ),
)
def annotations_fdf(spark, sf_dir):
    return notes.fdf_lines(_drawn(spark, sf_dir), fx.replies(spark, sf_dir)).drop("ord")


@query(
    "xfdf_import",
    """SELECT event_id, CAST(event_id % 12 AS INTEGER) AS page_index, CASE event_type WHEN 'click' THEN 'strikethrough' WHEN 'view' THEN 'sticky_note'
            WHEN 'signup' THEN 'free_text' WHEN 'purchase' THEN 'oval' ELSE 'sticky_note' END AS kind, 1.5::DOUBLE AS x0,
            (event_id % 500)::DOUBLE AS x1, 'a < b & ' || props AS contents, 'user ' || user_id AS author,
            event_id % 3 = 0 AS resolved, 'first|second ' || event_id AS replies FROM events""",
)
def xfdf_import(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN 'strikeout' WHEN 'view' THEN 'text' WHEN 'signup' THEN 'free-text' "
        "WHEN 'purchase' THEN 'circle' ELSE 'caret' END AS tag",
        "user_id", "props",
    )
    element = F.expr(
        """concat('<', tag, ' page="', event_id % 12, '" rect="1.5,2,', event_id % 500, ',4" title="user ', user_id, '"',
            CASE WHEN event_id % 3 = 0 THEN ' flags="print,resolved"' ELSE '' END, '><contents>a &lt; b &amp; ', props,
            '</contents><reply-to><contents>first</contents><date>D:2024</date></reply-to><reply-to><contents>second ',
            event_id, '</contents></reply-to></', tag, '>')"""
    )
    parsed = xfdf.parse_elements(rows.select("event_id", element.alias("element")), "element")
    return parsed.select(
        "event_id", "page_index", "kind", F.col("rect.x0").alias("x0"), F.col("rect.x1").alias("x1"), "contents", "author",
        "resolved", F.array_join("replies", "|").alias("replies"),
    )


# ── form values ─────────────────────────────────────────────────────────────


def _forms(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS form_id",
        "map('name', c_name, 'segment', concat(c_mktsegment, ', \"main\" <', c_nationkey, '> & co'), "
        "'note', concat('(', c_custkey, ') ''x'''), 'empty', CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END) AS values",
    )


FORMS = """forms AS (SELECT c_custkey AS form_id, unnest(['name', 'segment', 'note', 'empty']) AS name,
    unnest([c_name, c_mktsegment || ', "main" <' || c_nationkey || '> & co', '(' || c_custkey || ') ''x''',
        CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END]) AS value FROM customer)"""


def _round_trip(spark, sf_dir, fmt: str) -> DataFrame:
    texts = forms.export_form_values(_forms(spark, sf_dir), fmt)
    read = forms.import_form_values(texts, fmt)
    return read.select("form_id", F.explode("values").alias("name", "value"))


def _odd_names(spark, sf_dir) -> DataFrame:
    """Names and values with characters that the formats have to escape, a dotted name and outer blanks."""
    return fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("form_id"),
        F.create_map(
            F.lit('a & "b" (c)'), F.concat(F.lit(" "), "c_name", F.lit(", <x> \\ ("), "c_custkey", F.lit(" ")),
            F.lit("group.part"), F.concat(F.lit('first\nsecond "'), "c_mktsegment", F.lit('"')),
            F.lit("o'k"), F.concat(F.lit("'"), "c_custkey", F.lit("' & co)")),
        ).alias("values"),
    )


ODD = r"""odd AS (SELECT c_custkey AS form_id, unnest(['a & "b" (c)', 'group.part', 'o''k']) AS name,
    unnest([' ' || c_name || ', <x> \ (' || c_custkey || ' ', 'first' || chr(10) || 'second "' || c_mktsegment || '"',
        chr(39) || c_custkey || chr(39) || ' & co)']) AS value FROM customer)"""


def _odd_trip(spark, sf_dir, fmt: str) -> DataFrame:
    read = forms.import_form_values(forms.export_form_values(_odd_names(spark, sf_dir), fmt), fmt)
    return read.select("form_id", F.explode("values").alias("name", "value"))


for _fmt, _sql in {
    "fdf": f"WITH {FORMS} FROM forms",
    "xfdf": f"WITH {FORMS} FROM forms",
    "json": f"WITH {FORMS} FROM forms",
    "csv": f"WITH {FORMS} FROM forms WHERE value <> ''",
}.items():
    query(f"form_round_trip_{_fmt}", _sql)(lambda spark, sf_dir, fmt=_fmt: _round_trip(spark, sf_dir, fmt))
    query(f"form_odd_trip_{_fmt}", f"WITH {ODD} FROM odd")(lambda spark, sf_dir, fmt=_fmt: _odd_trip(spark, sf_dir, fmt))


@query(
    "form_import_problems",
    """SELECT c_custkey AS form_id, CASE c_custkey % 4 WHEN 0 THEN 'expected_object' WHEN 1 THEN 'invalid_json'
            WHEN 2 THEN 'expected_object' END AS error, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS fields FROM customer""",
)
def form_import_problems(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS form_id",
        """CASE c_custkey % 4 WHEN 0 THEN '[1, 2]' WHEN 1 THEN concat('{"a": ', c_custkey) WHEN 2 THEN '12'
           ELSE concat('{"a": "', c_custkey, '"}') END AS text""",
    )
    read = forms.import_form_values(texts, "json")
    return read.select("form_id", "error", F.coalesce(F.size("values"), F.lit(0)).alias("fields")).withColumn(
        "fields", F.greatest("fields", F.lit(0))
    )


@query(
    "form_export_csv",
    """SELECT c_custkey AS form_id, 'empty, name, note, segment' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END || ', '
            || c_name || ', (' || c_custkey || ') ''x'', "' || c_mktsegment || ', ""main"" <' || c_nationkey || '> & co"' || chr(10) AS text FROM customer""",
)
def form_export_csv(spark, sf_dir):
    return forms.export_form_values(_forms(spark, sf_dir), "csv")


@query(
    "form_reset",
    """SELECT c_custkey AS form_id, name, value FROM (SELECT c_custkey, unnest(['a', 'b', 'c', 'd']) AS name,
            unnest([CASE WHEN c_custkey % 3 = 0 THEN 'default a' ELSE c_name END, CASE WHEN c_custkey % 3 = 1 THEN 'default b' ELSE c_mktsegment END,
                CASE WHEN c_custkey % 4 <> 0 THEN 'kept' END, CASE WHEN c_custkey % 3 = 1 THEN 'added' END]) AS value FROM customer) WHERE value IS NOT NULL""",
)
def form_reset(spark, sf_dir):
    held = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS form_id",
        "map('a', c_name, 'b', c_mktsegment, 'c', CASE WHEN c_custkey % 4 <> 0 THEN 'kept' END) AS values",
        "CASE c_custkey % 3 WHEN 0 THEN map('a', 'default a') WHEN 1 THEN map('b', 'default b', 'd', 'added') END AS defaults",
    )
    return forms.reset_forms(held).select("form_id", F.explode("values").alias("name", "value"))


# ── files, sheets and URLs ──────────────────────────────────────────────────


@query(
    "ingest_validate",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ok' WHEN doc_id % 4 = 3 THEN 'empty' ELSE 'invalid_pdf' END AS status FROM documents""",
)
def ingest_validate(spark, sf_dir):
    uploads = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "encode(CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7\\n', text) WHEN 1 THEN concat(' %PDF-', text) "
        "WHEN 2 THEN concat('%pdf-', text) ELSE '' END, 'UTF-8') AS content",
    )
    return files.ingest_validate(uploads).select("doc_id", "status")


@query(
    "sniff_image",
    """SELECT doc_id, ['png', 'jpeg', 'webp', 'invalid_image', 'invalid_image'][doc_id % 5 + 1] AS image_type FROM documents""",
)
def sniff_image(spark, sf_dir):
    uploads = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat(element_at(array(X'89504E470D0A1A0A', X'FFD8FFE0', X'524946460102030457454250', X'524946460102030441564920', "
        "X'474946383961'), CAST(doc_id % 5 + 1 AS INT)), encode(text, 'UTF-8')) AS content",
    )
    return files.sniff_image(uploads).select("doc_id", "image_type")


@query(
    "route_format",
    """SELECT page_id, ['image', 'office', 'text', 'unknown', 'unknown', 'office'][page_id % 6 + 1] AS family,
            ['unknown', 'docx', 'csv', 'unknown', 'unknown', 'ods'][page_id % 6 + 1] AS reader FROM pages""",
)
def route_format(spark, sf_dir):
    names = fx.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "concat(split(url, '[?#]')[0], '/file', element_at(array('.JPeG', '.docx', '.Csv', '.exe', '/none', '.v2.ODS'), CAST(page_id % 6 + 1 AS INT))) AS filename",
    )
    return files.route_format(names).select("page_id", "family", "reader")


@query(
    "export_images",
    """SELECT vec_id, format('page_{}_img_{}.png', vec_id // 4 + 1, vec_id % 4 + 1) AS name FROM embeddings
        WHERE vec_id % 10 = 0 OR least(vec_id * 7 % 200, vec_id * 13 % 300) >= 50""",
)
def export_images(spark, sf_dir):
    images = fx.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "vec_id div 4 AS page_index", "vec_id % 4 AS image_index",
        "CASE WHEN vec_id % 10 <> 0 THEN vec_id * 7 % 200 END AS width", "vec_id * 13 % 300 AS height",
    )
    return files.export_images(images, 50).select("vec_id", "name")


@query(
    "sheet_grid",
    """WITH w AS (SELECT doc_id, ord, unnest(w) AS word, generate_subscripts(w, 1) AS col FROM (
            SELECT doc_id, ord, string_split(line, ' ') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents))),
        kept AS (SELECT doc_id, ord, max(col) AS width FROM w WHERE length(word) > 5 GROUP BY 1, 2)
        SELECT doc_id AS sheet_id, CAST(ord AS INTEGER) AS row, ord = min(ord) OVER (PARTITION BY doc_id) AS is_header,
            CAST(width AS INTEGER) AS width, cells FROM (
                SELECT doc_id, ord, k.width, string_agg(CASE WHEN length(word) > 5 THEN trim(word) ELSE '' END, '|' ORDER BY col) AS cells
                FROM kept k JOIN w USING (doc_id, ord) WHERE w.col <= k.width GROUP BY ALL)""",
)
def sheet_grid(spark, sf_dir):
    """Words of a line as cells of a row; short words leave gaps."""
    words = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sheet_id"), F.posexplode(F.split("text", "\n")).alias("r", "line")
    ).select("sheet_id", (F.col("r") + 1).alias("row"), F.posexplode(F.split("line", " ")).alias("c", "value"))
    number = F.col("c") + 1
    letter = lambda n: F.char((n - 1) % 26 + 65)
    name = F.when(number <= 26, letter(number)).when(
        number <= 702, F.concat(letter(F.floor((number - 1) / 26)), letter(number))
    ).otherwise(
        F.concat(letter(F.floor((number - 703) / 676) + 1), letter(F.floor((number - 703) / 26) % 26 + 1), letter(number))
    )
    cells = words.where(F.length("value") > 5).select("sheet_id", "row", F.concat(name, "row").alias("ref"), "value")
    grid = files.sheet_grid(cells)
    return grid.select("sheet_id", "row", "is_header", F.size("cells").alias("width"), F.array_join("cells", "|").alias("cells"))


# what a page's URL begins with, by its id, and the guard's answer; None keeps the page's own URL
GUARDED = [
    (None, None), ("http://localhost:80", "localhost"), ("https://10.1.2.3", "10"), ("http://user@172.20.0.1:8080", "172.16"),
    ("http://172.32.0.1", None), ("http://192.168.1.1", "192.168"), ("http://127.8.0.1", "127"),
    ("http://169.254.169.254", "169.254"), ("http://[::1]:81", "localhost"), ("https://[FD00::1]", "fc00"), ("http://[fe80::2]", "fe80"),
    ("ftp://example.com", "ftp"), ("//example.com", urls.NO_SCHEME), ("http://", urls.NO_HOST), ("http://[0:0:0:0:0:0:0:1]", "::1"),
    ("http://127.1", "127"), ("http://2130706433", "127"), ("http://0x7f.0.0.1", "127"), ("http://0177.0.0.1", "127"),
    ("http://[::ffff:127.0.0.1]", "127"), ("http://[::ffff:a00:1]", "10"), ("http://[febf::1]", "fe80"), ("http://[0000:0000::1]", "::1"),
    ("http://localhost.", "localhost"), ("http://0.1.2.3", "localhost"), ("http://[fdff:1::2]:8080", "fc00"), ("http://[2001:db8::1]", None),
    ("http://172.15.255.255", None), ("http://172.1048577", "172.16"), ("http://10.example.com", None), ("http://[::]", "localhost"),
    ("http://8.8.8.8", None),
]


def _sentence(answer: str | None) -> str:
    if answer is None:
        return "NULL"
    text = "ftp".join(urls.BAD_SCHEME) if answer == "ftp" else urls.REFUSED.get(answer, answer)
    return "'" + text.replace("'", "''") + "'"


@query(
    "url_guard",
    f"""SELECT page_id, CASE page_id % {len(GUARDED)}
        {" ".join(f"WHEN {i} THEN {_sentence(answer)}" for i, (_, answer) in enumerate(GUARDED))} END AS problem FROM pages""",
)
def url_guard(spark, sf_dir):
    prefixes = [prefix for prefix, _ in GUARDED]
    table = F.array(*[F.lit(p) for p in prefixes])
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    chosen = F.element_at(table, (F.col("page_id") % len(GUARDED) + 1).cast("int"))
    url = F.when(chosen.isNull(), F.col("url")).otherwise(F.concat(chosen, path))
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.url_problem(url).alias("problem"))
