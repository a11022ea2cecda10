"""Form values in and out of fdf, xfdf, json and csv texts."""

from __future__ import annotations

import csv
import io
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.text import pdf_escape, xml_escape
from folioworks.operators.annotations import csv_cell

FORMATS = ["fdf", "xfdf", "json", "csv"]
EMPTY = "cast(map() as map<string,string>)"
READ = T.StructType([T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])

# what an FDF text is made of; anything else in it is a plain word
FDF_TOKEN = re.compile(r"%[^\n\r]*|<<|>>|[\[\](]|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+")
PDF_STRING = re.compile(r"\\(\r\n|[0-7]{1,3}|.)|([()])|([^\\()]+)", re.S)
PDF_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": "", "\r\n": ""}


class Broken(ValueError):
    """A text that is not of its format."""


def _pdf_string(text: str, start: int) -> tuple[str, int]:
    """The string behind the opening parenthesis at `start` - 1, and where it ends; inner parentheses are part of it."""
    depth, out = 1, []
    for token in PDF_STRING.finditer(text, start):
        escaped, paren, plain = token.groups()
        if paren:
            depth += 1 if paren == "(" else -1
            if depth == 0:
                return "".join(out), token.end()
        if escaped is not None:
            octal = escaped[0] in "01234567"
            out.append(chr(int(escaped, 8) & 255) if octal else PDF_ESCAPES.get(escaped, escaped))
        else:
            out.append(paren or plain)
    raise Broken("string without an end")


def _hex_string(token: str) -> str:
    digits = "".join(token[1:-1].split())
    data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    return data.decode("utf-16") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("latin-1")


def fdf_pairs(text: str) -> dict[str, str]:
    """Field names and values of an FDF text.

    /T and /V belong together inside one dictionary, or one after the other where fields are listed without
    dictionaries; names of nested fields are joined by a dot. A field without /V has no value. Of a repeated name the
    last value holds.
    """
    pairs: dict[str, str] = {}
    levels: list[dict] = [{}]

    def settle() -> None:
        level = levels[-1]
        if "T" in level and "V" in level:
            name = ".".join(lv["T"] for lv in levels if "T" in lv)
            pairs.pop(name, None)
            pairs[name] = level["V"]
        level.pop("V", None)

    at, key, lists = 0, None, 0
    while match := FDF_TOKEN.search(text, at):
        token, at = match[0], match.end()
        if token[0] == "%":
            continue
        value = None
        if token == "(":
            value, at = _pdf_string(text, at)
        elif token[0] == "<" and token != "<<":
            value = _hex_string(token)
        elif token[0] == "/" and key == "V":
            value = token[1:]
        if value is not None and key:
            if key == "T" and "T" in levels[-1]:  # fields listed without dictionaries: the next one begins
                settle()
            levels[-1][key] = value
        elif token == "<<":
            levels.append({})
        elif token == ">>":
            if len(levels) == 1:
                raise Broken("dictionary without a beginning")
            settle()
            levels.pop()
        elif token in "[]":
            lists += 1 if token == "[" else -1
        key = token[1:] if value is None and token in ("/T", "/V") else None
    if len(levels) != 1 or lists:
        raise Broken("dictionary or list without an end")
    settle()
    return pairs


def xfdf_pairs(text: str) -> dict[str, str]:
    """Field names and values of an XFDF text; names of nested fields are joined by a dot, fields without value left out."""
    try:
        root = ElementTree.fromstring(text.encode())
    except ElementTree.ParseError as error:
        raise Broken(str(error)) from error
    pairs: dict[str, str] = {}
    open_ = [(root, [])]
    while open_:
        node, names = open_.pop()
        tag = node.tag.rpartition("}")[2]
        if tag == "value" and names:
            pairs.setdefault(".".join(names), node.text or "")  # read from the end, so the last one holds
        names = [*names, node.get("name", "")] if tag == "field" else names
        if tag != "annots":
            open_ += [(child, names) for child in node]
    return pairs


def csv_pairs(text: str) -> dict[str, str]:
    """Field names and values of a CSV text: a record of names, a record of values; empty values are left out.

    Quoted cells may hold commas, line breaks, doubled quotes and outer blanks.
    """
    try:
        records = [r for r in csv.reader(io.StringIO(text, newline=""), skipinitialspace=True, strict=True) if r]
    except csv.Error as error:
        raise Broken(str(error)) from error
    if len(records) < 2:
        raise Broken("fewer than two records")
    return {name.strip(): value for name, value in zip(records[0], records[1], strict=False) if value != ""}


READERS = {"fdf": (fdf_pairs, "invalid_fdf"), "xfdf": (xfdf_pairs, "invalid_xfdf"), "csv": (csv_pairs, "unexpected_format")}


def _reader(fmt: str):
    pairs_of, broken = READERS[fmt]

    def read(text):
        if text is None:
            return None, None
        try:
            return pairs_of(text), None
        except Broken:
            return None, broken

    @F.pandas_udf(READ)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [read(t) for t in texts]
        return pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=object) for i, c in enumerate(("values", "error"))})

    return run


def form_values(text: Column, fmt: str) -> Column:
    """struct<values: map<string,string>, error: string> of one file's text; a broken text has an error and no values."""
    if fmt == "json":
        # a whole valid text stays valid in front of one more member, whose name no text can contain
        mark = F.md5(text)
        framed = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":1}'))
        valid = F.coalesce(F.call_function("get_json_object", framed, F.concat(F.lit("$."), mark)) == "1", F.lit(False))
        values, is_object = F.from_json(text, "map<string,string>"), text.rlike(r"^\s*\{")
        error = F.when(~valid | (is_object & values.isNull()), "invalid_json").when(~is_object, "expected_object")
        error = F.when(text.isNotNull(), error)
        return F.struct(F.when(error.isNull(), values).alias("values"), error.alias("error"))
    if fmt in READERS:
        return _reader(fmt)(text)
    raise ValueError(f"unknown form format: {fmt}")


def import_form_values(files: DataFrame, fmt: str, text: str = "text") -> DataFrame:
    """Files with `values` and `error` in place of their text."""
    parsed = files.withColumn("_f", form_values(F.col(text), fmt))
    return parsed.select(*[c for c in files.columns if c != text], "_f.values", "_f.error")


def read_form_files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return import_form_values(texts, fmt)


def _xml_text(value: Column) -> Column:
    """Escaped, line breaks and tabs too, which an XML reader would change."""
    out = xml_escape(value)
    for char, code in [("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")]:
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def _csv_cell(value: Column) -> Column:
    """As in the other CSV files, and quoted when blanks begin or end the value."""
    return F.when(value.rlike(r"^\s|\s$") & ~value.rlike('[,"\n\r]'), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(csv_cell(value))


def form_text(values: Column, fmt: str) -> Column:
    """The text of a file with these values, names in order."""
    entries = F.array_sort(F.map_entries(values))
    value = lambda e: F.coalesce(e["value"], F.lit(""))
    if fmt == "json":
        return F.to_json(F.map_from_entries(entries))
    if fmt == "csv":
        names = F.array_join(F.transform(entries, lambda e: _csv_cell(e["key"])), ", ")
        cells = F.array_join(F.transform(entries, lambda e: _csv_cell(value(e))), ", ")
        return F.concat(names, F.lit("\n"), cells, F.lit("\n"))
    if fmt == "xfdf":
        head = (
            '<?xml version="1.0" encoding="UTF-8"?>\n'
            '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n<fields>\n'
        )
        line = lambda e: F.format_string(
            '  <field name="%s"><value>%s</value></field>\n', _xml_text(e["key"]), _xml_text(value(e))
        )
        return F.concat(F.lit(head), F.array_join(F.transform(entries, line), ""), F.lit("</fields>\n</xfdf>\n"))
    if fmt == "fdf":
        line = lambda e: F.format_string("  /T (%s) /V (%s)\n", pdf_escape(e["key"]), pdf_escape(value(e)))
        return F.concat(
            F.lit("%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n"),
            F.array_join(F.transform(entries, line), ""),
            F.lit("] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"),
        )
    raise ValueError(f"unknown form format: {fmt}")


def export_form_values(forms: DataFrame, fmt: str, values: str = "values") -> DataFrame:
    """Forms with their file `text` in place of the values."""
    return forms.select(*[c for c in forms.columns if c != values], form_text(F.col(values), fmt).alias("text"))


def reset_forms(forms: DataFrame, values: str = "values", defaults: str = "defaults") -> DataFrame:
    """Fields with a default get it back, the others keep their value; nulls drop out."""
    current = F.map_filter(values, lambda k, v: v.isNotNull())
    usual = F.map_filter(F.coalesce(F.col(defaults), F.expr(EMPTY)), lambda k, v: v.isNotNull())
    others = F.map_filter(current, lambda k, v: ~F.map_contains_key(usual, k))
    return forms.withColumn(values, F.map_concat(others, usual)).drop(defaults)
