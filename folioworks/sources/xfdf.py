"""XFDF annotation import: elements cut out of whole files and parsed as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.operators.annotations import XFDF_KINDS, looked_up
from folioworks.plans.rows import positions

ELEMENT = T.StructType(
    [
        T.StructField("_page", T.StringType()),
        T.StructField("_rect", T.StringType()),
        T.StructField("_color", T.StringType()),
        T.StructField("_date", T.StringType()),
        T.StructField("_title", T.StringType()),
        T.StructField("_flags", T.StringType()),
        T.StructField("_opacity", T.StringType()),
        T.StructField("contents", T.StringType()),
        T.StructField(
            "reply-to",
            T.ArrayType(
                T.StructType([T.StructField("contents", T.StringType()), T.StructField("date", T.StringType())])
            ),
        ),
    ]
)


def _side(rect: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(rect, ","), F.lit(i)).try_cast("double"), F.lit(0.0))


def _imported(tag: Column, element) -> list[Column]:
    rect = element("_rect")
    return [
        F.coalesce(element("_page").try_cast("int"), F.lit(0)).alias("page_index"),
        looked_up(tag, XFDF_KINDS, F.lit("sticky_note")).alias("kind"),
        F.struct(*[_side(rect, i).alias(s) for i, s in enumerate(["x0", "y0", "x1", "y1"])]).alias("rect"),
        F.coalesce(element("contents"), F.lit("")).alias("contents"),
        F.coalesce(element("_title"), F.lit("")).alias("author"),
        element("_color").alias("color"),
        element("_opacity").try_cast("double").alias("opacity"),
        element("_date").alias("date"),
        F.contains(F.coalesce(element("_flags"), F.lit("")), F.lit("resolved")).alias("resolved"),
        F.coalesce(
            F.transform(element("`reply-to`"), lambda r: F.coalesce(r["contents"], F.lit(""))),
            F.expr("cast(array() as array<string>)"),
        ).alias("replies"),
    ]


# an element with its attributes and all it holds; attribute values may contain angle brackets
ELEMENT_TEXT = r"""(?s)<([A-Za-z][\w.-]*)(?:[^<>"']|"[^"]*"|'[^']*')*+(?:(?<=/)>|>.*?</\1\s*>)"""


def read_xfdf(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Annotations of all XFDF files under a path, with `file` and nested reply texts, in one scan.

    Every child of `annots` is an annotation; element names without a kind of their own become sticky notes. Pass
    `tags` to keep only some names. A file is one row while its elements are cut out.
    """
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    bare = F.regexp_replace("text", "(?s)<!--.*?-->", "")
    annots = F.regexp_extract(bare, r"(?s)<annots\b[^>]*(?<!/)>(.*)</annots\s*>", 1)
    elements = texts.select("file", annots.alias("annots")).select("file", F.regexp_extract_all("annots", F.lit(ELEMENT_TEXT), F.lit(0)).alias("e"))
    rows = positions(elements, ["file"], F.col("e"), "_", "element").drop("_")
    if tags is not None:
        rows = rows.where(_tag(F.col("element")).isin(*tags))
    return parse_elements(rows, "element").drop("element")


def _tag(element: Column) -> Column:
    return F.regexp_extract(element, r"^\s*<([A-Za-z][\w.-]*)", 1)


def parse_elements(rows: DataFrame, column: str) -> DataFrame:
    """Add the imported columns for a column holding one annotation element."""
    tag = _tag(F.col(column))
    parsed = rows.withColumn("_e", F.from_xml(F.col(column), ELEMENT))
    return parsed.select(*rows.columns, *_imported(tag, lambda name: F.col(f"_e.{name}")))
