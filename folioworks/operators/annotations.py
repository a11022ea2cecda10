"""Annotations and replies: filters, threads, counts, checks and exchange formats."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import kind_label, pdf_date, pdf_escape, utc_datetime, xml_escape
from folioworks.operators.access import at
from folioworks.plans.ordered import ordered_columns

# Annotation kinds by filter category.
KIND_CATEGORIES = {
    "text_markup": ["highlight", "underline", "strikethrough", "squiggly"],
    "shape": ["line", "arrow", "double_arrow", "oval", "rectangle", "polygon", "cloud", "polyline"],
    "stamp": ["stamp"],
    "whiteout": ["whiteout"],
    "free_text": ["free_text", "free_text_callout"],
    "ink": ["ink"],
    "measurement": ["measure_distance", "measure_perimeter", "measure_area"],
    "other": ["sticky_note", "signature", "file_attachment", "dimension"],
}
ANNOTATION_KINDS = [kind for kinds in KIND_CATEGORIES.values() for kind in kinds]

# Kinds of text edits.
TEXT_EDIT_KINDS = ["add_text", "edit_text", "insert_image", "link", "page_number", "watermark", "header_footer", "bates"]

# Kind to XFDF element, kind to FDF subtype, XFDF element to kind.
XFDF_SUBTYPES = {
    "highlight": "highlight", "underline": "underline", "strikethrough": "strikeout", "squiggly": "squiggly",
    "sticky_note": "text", "free_text": "free-text", "free_text_callout": "free-text", "ink": "ink",
    "stamp": "stamp", "signature": "stamp", "line": "line", "arrow": "line", "double_arrow": "line",
    "dimension": "line", "oval": "circle", "rectangle": "square", "polygon": "polygon", "cloud": "polygon",
    "polyline": "polyline", "file_attachment": "fileattachment", "measure_distance": "line",
    "measure_perimeter": "polygon", "measure_area": "polygon", "whiteout": "square",
}
FDF_SUBTYPES = {
    "highlight": "Highlight", "underline": "Underline", "strikethrough": "StrikeOut", "squiggly": "Squiggly",
    "sticky_note": "Text", "free_text": "FreeText", "free_text_callout": "FreeText", "ink": "Ink",
    "stamp": "Stamp", "signature": "Stamp", "line": "Line", "arrow": "Line", "double_arrow": "Line",
    "dimension": "Line", "oval": "Circle", "rectangle": "Square", "polygon": "Polygon", "cloud": "Polygon",
    "polyline": "PolyLine", "file_attachment": "FileAttachment", "measure_distance": "Line",
    "measure_perimeter": "Polygon", "measure_area": "Polygon", "whiteout": "Square",
}
XFDF_KINDS = {
    "highlight": "highlight", "underline": "underline", "strikeout": "strikethrough", "squiggly": "squiggly",
    "text": "sticky_note", "free-text": "free_text", "ink": "ink", "stamp": "stamp", "line": "line",
    "circle": "oval", "square": "rectangle", "polygon": "polygon", "polyline": "polyline",
    "fileattachment": "file_attachment", "caret": "sticky_note",
}


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


# ── filters, threads and counts ─────────────────────────────────────────────


def date_cutoff(period: str, now: datetime.datetime) -> Column:
    unit = {"today": "day", "this_week": "week", "this_month": "month", "older": "month"}[period]
    return F.date_trunc(unit, at(now)).cast("timestamp_ntz")


def comment_filter(
    annotations: DataFrame,
    now: datetime.datetime,
    author: str | None = None,
    exclude_categories: list[str] | None = None,
    status: str = "all",
    period: str = "all",
) -> DataFrame:
    """Annotations passing all filters; rows without a date never pass a period."""
    if author is not None:
        annotations = annotations.where(F.col("author") == author)
    excluded = [k for c in exclude_categories or [] for k in KIND_CATEGORIES.get(c, [])]
    if excluded:
        annotations = annotations.where(~F.col("kind").isin(excluded))
    if status != "all":
        resolved = F.coalesce(F.col("resolved"), F.lit(False))
        annotations = annotations.where(resolved if status == "resolved" else ~resolved)
    if period != "all":
        cut = date_cutoff(period, now)
        inside = F.col("inserted_at") < cut if period == "older" else F.col("inserted_at") >= cut
        annotations = annotations.where(inside)
    return annotations


def annotation_order(annotations: DataFrame) -> DataFrame:
    """Page order, then time; a range-partitioned global sort."""
    return annotations.orderBy("document_id", "page_index", "inserted_at", "annotation_id")


def reply_authors(replies: DataFrame, users: DataFrame) -> DataFrame:
    """Replies with author_email, Unknown where the user is gone."""
    emails = users.select("user_id", F.col("email").alias("author_email"))
    joined = replies.join(emails, "user_id", "left")
    return joined.withColumn("author_email", F.coalesce("author_email", F.lit("Unknown")))


def threads(annotations: DataFrame, replies: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per reply in its annotation's time order, and one for each annotation
    without replies (reply columns null): (annotation_id, reply_no, reply_id, ...)."""
    numbered = ordered_columns(
        replies, ["annotation_id"], ["inserted_at", "reply_id"], row_number="reply_no", limit=limit
    ).select("annotation_id", "reply_no", "reply_id", "body", F.col("inserted_at").alias("replied_at"))
    return annotations.select("annotation_id", "document_id", "page_index", "kind").join(
        numbered, "annotation_id", "left"
    )


def reply_counts(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    counts = replies.groupBy("annotation_id").agg(F.count(F.lit(1)).alias("replies_count"))
    joined = annotations.drop("replies_count").join(counts, "annotation_id", "left")
    return joined.withColumn("replies_count", F.coalesce("replies_count", F.lit(0).cast("bigint")))


def page_groups(annotations: DataFrame, limit: int | None = None) -> DataFrame:
    """Annotations with their position on the page: groups stay rows, so a crowded
    page is never gathered into one value."""
    return ordered_columns(
        annotations,
        ["document_id", "page_index"],
        ["inserted_at", "annotation_id"],
        row_number="position",
        limit=limit,
    )


def distinct_authors(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("author").isNotNull()).select("author").distinct().orderBy("author")


def combined_rows(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    """Annotations and replies as one row set without duplicates."""
    notes = annotations.select("annotation_id", F.lit(None).cast("bigint").alias("reply_id"), "author", F.col("contents").alias("text"))
    answers = replies.select("annotation_id", "reply_id", "author", F.col("body").alias("text"))
    return notes.unionByName(answers).dropDuplicates()


# ── checks ──────────────────────────────────────────────────────────────────


def reject_reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in order."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*named), lambda r: r.isNotNull())


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reasons)"""
    judged = rows.withColumn("reasons", reject_reasons(rules))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def annotation_rules() -> dict[str, Column]:
    return {
        "revision_id is missing": F.col("revision_id").isNotNull(),
        "page_index is missing": F.col("page_index").isNotNull(),
        "kind is missing": F.col("kind").isNotNull(),
        "kind is unknown": F.col("kind").isNull() | F.col("kind").isin(ANNOTATION_KINDS),
    }


def text_edit_rules() -> dict[str, Column]:
    return {
        "document_id is missing": F.col("document_id").isNotNull(),
        "kind is missing": F.col("kind").isNotNull(),
        "kind is unknown": F.col("kind").isNull() | F.col("kind").isin(TEXT_EDIT_KINDS),
    }


def signer_rules() -> dict[str, Column]:
    return {
        "envelope_id is missing": F.col("envelope_id").isNotNull(),
        "name is missing": F.trim("name") != "",
        "name is too long": F.length("name") <= 255,
        "email is malformed": F.col("email").rlike(r"^[^@,;\s]+@[^@,;\s]+$"),
        "email is too long": F.length("email") <= 160,
    }


def field_rules() -> dict[str, Column]:
    return {
        "page_index is outside 0..9999": F.col("page_index").between(0, 9999),
        "kind is missing": F.col("kind").isNotNull(),
    }


# ── exchange formats, one row per output line or record ─────────────────────


def csv_rows(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    """The eight export columns as text, with sort columns; replies follow their parent."""
    notes = annotations.select(
        "document_id",
        F.struct("page_index", "inserted_at", "annotation_id", F.lit(0).alias("is_reply"),
                 F.lit(None).cast("timestamp_ntz").alias("replied_at"), F.lit(None).cast("bigint").alias("reply_id")).alias("ord"),
        (F.col("page_index") + 1).cast("string").alias("Page"),
        kind_label(F.col("kind")).alias("Type"),
        F.coalesce("author", F.lit("")).alias("Author"),
        F.coalesce("contents", F.lit("")).alias("Content"),
        utc_datetime(F.col("inserted_at")).alias("Date"),
        F.when(F.col("resolved"), "Resolved").otherwise("Open").alias("Status"),
        F.lit("").alias("Replies"),
        F.col("annotation_id").cast("string").alias("ID"),
    )
    parents = annotations.select("annotation_id", "document_id", "page_index", F.col("inserted_at").alias("noted_at"))
    answers = replies.join(parents, "annotation_id").select(
        "document_id",
        F.struct("page_index", F.col("noted_at").alias("inserted_at"), "annotation_id", F.lit(1).alias("is_reply"),
                 F.col("inserted_at").alias("replied_at"), "reply_id").alias("ord"),
        F.lit("").alias("Page"),
        F.lit("Reply").alias("Type"),
        F.lit("").alias("Author"),
        F.coalesce("body", F.lit("")).alias("Content"),
        utc_datetime(F.col("inserted_at")).alias("Date"),
        F.lit("").alias("Status"),
        F.col("annotation_id").cast("string").alias("Replies"),
        F.col("reply_id").cast("string").alias("ID"),
    )
    return notes.unionByName(answers)


def csv_cell(value: Column) -> Column:
    """Quoted when the value holds a comma, quote or line break."""
    doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n\r]'), doubled).otherwise(value)


CSV_COLUMNS = ["Page", "Type", "Author", "Content", "Date", "Status", "Replies", "ID"]


def csv_lines(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    """(document_id, section, ord, line): the header with its byte-order mark is
    section 0, records are section 1."""
    rows = csv_rows(annotations, replies)
    records = rows.select(
        "document_id", F.lit(1).alias("section"), "ord", F.concat_ws(",", *[csv_cell(F.col(c)) for c in CSV_COLUMNS]).alias("line")
    )
    header = annotations.select("document_id").distinct().select(
        "document_id", F.lit(0).alias("section"), F.lit(None).cast(records.schema["ord"].dataType).alias("ord"),
        F.lit("﻿" + ",".join(CSV_COLUMNS)).alias("line"),
    )
    return header.unionByName(records)


def rect_text(rect: Column, separator: str) -> Column:
    sides = [F.coalesce(rect[s].cast("string"), F.lit("0")) for s in ["x0", "y0", "x1", "y1"]]
    return F.concat_ws(separator, *sides)


def _line_keys(part: int, reply: bool) -> list[Column]:
    return [
        F.struct(
            F.col("page_index"),
            F.col("noted_at").alias("inserted_at"),
            F.col("annotation_id"),
            F.lit(part).alias("part"),
            (F.col("replied_at") if reply else F.lit(None).cast("timestamp_ntz")).alias("replied_at"),
            (F.col("reply_id") if reply else F.lit(None).cast("bigint")).alias("reply_id"),
        ).alias("ord")
    ]


def _answers(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    parents = annotations.select("annotation_id", "document_id", "page_index", "kind", F.col("inserted_at").alias("noted_at"))
    answers = replies.select("annotation_id", "reply_id", "body", F.col("inserted_at").alias("replied_at"))
    return parents.join(answers, "annotation_id")


def _framed(annotations: DataFrame, body: DataFrame, head: list[str], foot: list[str]) -> DataFrame:
    """Body lines (section 1) between the fixed first and last lines of each document."""
    kind = body.schema["ord"].dataType
    documents = annotations.select("document_id").distinct()

    def fixed(section: int, line: str) -> DataFrame:
        return documents.select(
            "document_id", F.lit(section).alias("section"), F.lit(None).cast(kind).alias("ord"), F.lit(line).alias("line")
        )

    framed = fixed(0, "\n".join(head)).unionByName(body.select("document_id", F.lit(1).alias("section"), "ord", "line"))
    return framed.unionByName(fixed(2, "\n".join(foot)))


def xfdf_lines(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    """(document_id, section, ord, line) of an XFDF file per document.

    An annotation opens its element (part 0), its replies nest inside (part 1)
    and it closes the element (part 2); the lines sort into the file, so no
    document or thread is gathered into one value. `annotations` also holds
    rect, color and resolved.
    """
    notes = annotations.withColumn("noted_at", F.col("inserted_at"))
    subtype = looked_up(F.col("kind"), XFDF_SUBTYPES, F.lit("text"))
    attributes = F.concat(
        F.format_string('    <%s page="%d" rect="%s"', subtype, "page_index", rect_text(F.col("rect"), ",")),
        F.when(F.col("color").isNotNull(), F.format_string(' color="%s"', "color")).otherwise(""),
        F.format_string(' date="%s" title="%s"', pdf_date(F.col("inserted_at")), xml_escape(F.coalesce("author", F.lit("")))),
        F.when(F.col("resolved"), ' flags="print,resolved"').otherwise(""),
        F.format_string(">\n      <contents>%s</contents>", xml_escape(F.coalesce("contents", F.lit("")))),
    )
    opened = notes.select("document_id", *_line_keys(0, False), attributes.alias("line"))
    closed = notes.select("document_id", *_line_keys(2, False), F.format_string("    </%s>", subtype).alias("line"))
    nested = _answers(annotations, replies).select(
        "document_id",
        *_line_keys(1, True),
        F.format_string(
            "      <reply-to>\n        <contents>%s</contents>\n        <date>%s</date>\n      </reply-to>",
            xml_escape(F.coalesce("body", F.lit(""))), pdf_date(F.col("replied_at")),
        ).alias("line"),
    )
    body = opened.unionByName(nested).unionByName(closed)
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">', "  <annots>"]
    return _framed(annotations, body, head, ["  </annots>", "</xfdf>"])


def fdf_lines(annotations: DataFrame, replies: DataFrame, limit: int | None = None) -> DataFrame:
    """(document_id, section, ord, line) of an FDF file per document, with its
    cross-reference table computed from the summed line lengths."""
    notes = annotations.withColumn("noted_at", F.col("inserted_at"))
    subtype = looked_up(F.col("kind"), FDF_SUBTYPES, F.regexp_replace(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), " ", ""))
    color = F.array_join(
        F.transform(
            F.array(*[F.substring("color", i, 2) for i in (2, 4, 6)]),
            lambda h: F.round(F.conv(h, 16, 10).cast("double") / 255, 4).cast("string"),
        ),
        " ",
    )
    entry = F.concat(
        F.format_string(
            "<<\n  /Type /Annot\n  /Subtype /%s\n  /Rect [%s]\n  /Contents (%s)\n  /P %d\n  /T (%s)\n  /CreationDate (%s)",
            subtype, rect_text(F.col("rect"), " "), pdf_escape(F.coalesce("contents", F.lit(""))), "page_index",
            pdf_escape(F.coalesce("author", F.lit(""))), pdf_date(F.col("inserted_at")),
        ),
        F.when(F.col("color").isNotNull(), F.concat(F.lit("\n  /C ["), color, F.lit("]"))).otherwise(""),
        F.when(F.col("opacity") < 1.0, F.concat(F.lit("\n  /CA "), F.col("opacity").cast("string"))).otherwise(""),
        F.when(F.col("resolved"), "\n  /F 4").otherwise(""),
    )
    opened = notes.select("document_id", *_line_keys(0, False), entry.alias("line"))
    closed = notes.select("document_id", *_line_keys(2, False), F.lit(">>").alias("line"))
    threaded = ordered_columns(
        _answers(annotations, replies), ["annotation_id"], ["replied_at", "reply_id"],
        row_number="_rn", leads={"_later": "reply_id"}, limit=limit,
    )
    nested = threaded.select(
        "document_id",
        *_line_keys(1, True),
        F.concat(
            F.when(F.col("_rn") == 1, "  /Annots [").otherwise("    "),
            F.format_string(
                "<< /Type /Annot /Subtype /Text /Contents (%s) /CreationDate (%s) /IRT %s >>",
                pdf_escape(F.coalesce("body", F.lit(""))), pdf_date(F.col("replied_at")), F.col("annotation_id").cast("string"),
            ),
            F.when(F.col("_later").isNull(), "]").otherwise(""),
        ).alias("line"),
    )
    body = opened.unionByName(nested).unionByName(closed)
    head = ["%FDF-1.2", "1 0 obj", "<< /FDF << /Annots ["]
    framed = _framed(annotations, body, head, ["] >> >>", "endobj"])
    sizes = framed.groupBy("document_id").agg(F.sum(F.octet_length("line") + 1).alias("_offset"))
    tail = (
        "xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<< /Root 1 0 R /Size 2 >>\nstartxref\n"
    )
    trailer = sizes.select(
        "document_id", F.lit(3).alias("section"), F.lit(None).cast(framed.schema["ord"].dataType).alias("ord"),
        F.concat(F.lit(tail), F.col("_offset").cast("string"), F.lit("\n%%EOF")).alias("line"),
    )
    return framed.unionByName(trailer)


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder per document; its part files in name order make up the file.

    The global sort cuts a very large document over several part files.
    """
    ordered = lines.orderBy("document_id", "section", "ord").select("document_id", "line")
    ordered.write.mode("error").partitionBy("document_id").option("lineSep", "\n").text(path)
