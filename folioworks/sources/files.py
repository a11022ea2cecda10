"""File intake: header checks, format routing, image lists and spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format families by file extension.
FORMATS = {
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic"],
    "office": [".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".rtf"],
    "text": [".txt", ".csv", ".md"],
}
READERS = ["xlsx", "pptx", "docx", "odt", "ods", "odp", "rtf", "csv", "txt", "md"]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of binary files below a path."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "content")
    )


def _starts(content: Column, start: int, magic_hex: str) -> Column:
    return F.hex(F.substring(content, start, len(magic_hex) // 2)) == magic_hex


def ingest_validate(files: DataFrame, content: str = "content") -> DataFrame:
    """Add status: ok for bytes that start with the PDF header, else why not."""
    c = F.col(content)
    status = (
        F.when(c.isNull() | (F.octet_length(c) == 0), "empty")
        .when(_starts(c, 1, "255044462D"), "ok")
        .otherwise("invalid_pdf")
    )
    return files.withColumn("status", status)


def sniff_image(files: DataFrame, content: str = "content") -> DataFrame:
    """Add image_type by the leading bytes: png, jpeg, webp or invalid_image."""
    c = F.col(content)
    webp = _starts(c, 1, "52494646") & _starts(c, 9, "57454250")
    kind = (
        F.when(_starts(c, 1, "89504E470D0A1A0A"), "png")
        .when(_starts(c, 1, "FFD8FF"), "jpeg")
        .when(webp, "webp")
        .otherwise("invalid_image")
    )
    return files.withColumn("image_type", kind)


def route_format(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Add the family (image, office, text, unknown) and reader of a file name."""
    base = F.regexp_extract(F.col(filename), r"([^/]*)$", 1)
    # a leading dot is part of the name, not an extension
    extension = F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))
    family = F.lit("unknown")
    for name, extensions in FORMATS.items():
        family = F.when(extension.isin(extensions), name).otherwise(family)
    suffix = F.lower(F.element_at(F.split(F.col(filename), r"\."), -1))
    return files.withColumns(
        {"family": family, "reader": F.when(suffix.isin(READERS), suffix).otherwise("unknown")}
    )


def export_images(images: DataFrame, min_dimension: int = 0) -> DataFrame:
    """Images at least this large on their short side, with an output name.

    Images whose size could not be read stay in.
    """
    if min_dimension > 0:
        short = F.least("width", "height")
        unread = F.col("width").isNull() | F.col("height").isNull()
        images = images.where(unread | (short >= min_dimension))
    name = F.format_string("page_%d_img_%d.png", F.col("page_index") + 1, F.col("image_index") + 1)
    return images.withColumn("name", name)


def column_number(reference: Column) -> Column:
    """1-based column of an A1 reference: A is 1, AA is 27."""
    letters = F.filter(F.split(F.regexp_replace(reference, r"[0-9]+$", ""), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def sheet_grid(cells: DataFrame) -> DataFrame:
    """Dense rows of sparse cells (sheet_id, row, ref, value).

    Returns (sheet_id, row, is_header, cells): gaps are "", each row ends at its
    last cell, and the first row of a sheet is its header. A row is bounded by
    the file format's 16,384 columns.
    """
    placed = cells.select(
        "sheet_id", "row", column_number(F.col("ref")).alias("col"), F.trim(F.coalesce("value", F.lit(""))).alias("value")
    )
    rows = placed.groupBy("sheet_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("col", "value"))).alias("c")
    )
    # a cell given twice keeps its last value, as in a map
    last = F.filter(
        "c", lambda x, i: (i == F.size("c") - 1) | (F.get(F.col("c"), i + 1)["col"] != x["col"])
    )
    rows = rows.select("sheet_id", "row", last.alias("x"))
    before = F.concat(F.array(F.lit(0)), F.transform("x", lambda x: x["col"]))
    # each cell brings the gap in front of it
    dense = F.flatten(
        F.transform(
            F.arrays_zip("x", F.slice(before, F.lit(1), F.size("x")).alias("p")),
            lambda z: F.concat(F.array_repeat(F.lit(""), z["x"]["col"] - z["p"] - 1), F.array(z["x"]["value"])),
        )
    )
    # joined by sheet and row, as the rows lie already: the cells cross one shuffle
    heads = cells.groupBy("sheet_id").agg(F.min("row").alias("row")).withColumn("_head", F.lit(True))
    first = F.when(F.col("row").isNotNull(), F.col("_head").isNotNull()).alias("is_header")
    return rows.where(F.col("sheet_id").isNotNull()).withColumn("cells", dense).join(heads, ["sheet_id", "row"], "left").select(
        "sheet_id", "row", first, "cells"
    )
