"""Reports: recognition confidence, signatures, conformance, telemetry, translation, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.plans.ordered import null_safe, ordered_columns
from folioworks.operators.access import latest_one

# ── recognition ─────────────────────────────────────────────────────────────


def ocr_confidence(pages: DataFrame, words: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Per page: avg, min and count of word confidences and words below the threshold.

    Pages without words have null confidences and zero counts.
    """
    stats = words.groupBy("document_id", "page_index").agg(
        F.avg("conf").alias("avg_conf"),
        F.min("conf").alias("min_conf"),
        F.count("conf").alias("word_count"),
        F.count_if(F.col("conf") < threshold).alias("low_words"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        pages.select("document_id", "page_index")
        .join(stats, ["document_id", "page_index"], "left")
        .withColumns({"word_count": F.coalesce("word_count", zero), "low_words": F.coalesce("low_words", zero)})
    )


def latest_ocr(results: DataFrame) -> DataFrame:
    """The newest recognition result of each document."""
    return latest_one(results, ["document_id"], ["inserted_at", "result_id"])


def needs_ocr_prompt(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, has_any_text, show_prompt) from each document's current revision."""
    texts = pages.groupBy(F.col("revision_id").alias("current_revision_id")).agg(
        F.coalesce(F.bool_or("has_text"), F.lit(False)).alias("has_any_text")
    )
    joined = documents.select("document_id", "current_revision_id").join(texts, "current_revision_id", "left")
    known = F.col("current_revision_id").isNotNull()
    any_text = F.coalesce("has_any_text", F.lit(False))
    return joined.select("document_id", any_text.alias("has_any_text"), (known & ~any_text).alias("show_prompt"))


# ── signatures and conformance ──────────────────────────────────────────────


def signature_validity(signatures: DataFrame) -> DataFrame:
    """Add `valid` and `pades_level`; an unknown check counts as not failed."""
    failed = lambda c: F.col(c).eqNullSafe(F.lit(False))
    stamped = F.coalesce(F.col("has_timestamp"), F.lit(False))
    valid = (
        ~failed("byte_range_intact")
        & F.col("signer_cert_subject").isNotNull()
        & ~failed("message_imprint_match")
        & (~failed("timestamp_valid") | ~stamped)
    )
    level = F.when(F.col("signer_cert_subject").isNotNull(), F.when(stamped, "b_t").otherwise("b_b"))
    return signatures.withColumns({"valid": valid, "pades_level": level})


def signature_rollup(signatures: DataFrame) -> DataFrame:
    """(document_id, signatures, valid_signatures, all_valid)"""
    return signature_validity(signatures).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("signatures"),
        F.count_if("valid").alias("valid_signatures"),
        F.bool_and("valid").alias("all_valid"),
    )


FORBIDDEN = ["JavaScript", "AA", "OpenAction"]


# Names of the conformance rules.
RULE_NAMES = {
    "encryption": "No encryption",
    "intent": "ICC OutputIntent",
    "metadata": "XMP metadata",
    "marked": "MarkInfo",
    "actions": "No JS / actions",
    "tagged": "StructTreeRoot (tagged)",
}
# what a rule found, held and not held
DETAILS = {
    "encryption": ("readable without a key", "needs a key"),
    "intent": ("colour intent given", "colour intent absent"),
    "metadata": ("metadata stream given", "metadata stream absent"),
    "marked": ("declared as marked", "not declared as marked"),
}


def conformance_report(catalogues: DataFrame) -> DataFrame:
    """Six rule rows (document_id, name, status, detail) per document.

    `catalogue` maps catalogue entries to text: OutputIntents to a comma list,
    Metadata to ref for an indirect object, MarkInfo to Marked=true.
    """
    c = F.col("catalogue")
    value = lambda key: F.try_element_at(c, F.lit(key))
    present = lambda key: F.map_contains_key(c, key)

    def rule(name: str, ok: Column, good: str, bad: Column | str) -> Column:
        sure = F.coalesce(ok, F.lit(False))
        bad = F.lit(bad) if isinstance(bad, str) else bad
        return F.struct(
            F.lit(name).alias("name"),
            F.when(sure, "pass").otherwise("fail").alias("status"),
            F.when(sure, good).otherwise(bad).alias("detail"),
        )

    found = F.filter(F.array(*[F.when(present(k), F.lit("/" + k)) for k in sorted(FORBIDDEN)]), lambda k: k.isNotNull())
    held = {
        "encryption": ~present("Encrypt"),
        "intent": F.length(value("OutputIntents")) > 0,
        "metadata": value("Metadata") == "ref",
        "marked": value("MarkInfo") == "Marked=true",
        "actions": F.size(found) == 0,
    }
    rules = [rule(RULE_NAMES[k], ok, *DETAILS[k]) for k, ok in held.items() if k != "actions"]
    listed = F.concat(F.lit("active content: "), F.array_join(found, ", "))
    rules.append(rule(RULE_NAMES["actions"], held["actions"], "free of active content", listed))
    rules.append(
        F.struct(
            F.lit(RULE_NAMES["tagged"]).alias("name"), F.lit("not_verified").alias("status"), F.lit("not decided by this report").alias("detail")
        )
    )
    rules = F.array(*rules)
    return catalogues.select("document_id", F.inline(rules))


def conformance_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("name", "status").agg(F.count(F.lit(1)).alias("documents"))


# ── telemetry ───────────────────────────────────────────────────────────────


PERCENTILES = (50, 95, 99)


def telemetry_summary(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, sum, min, mean, max and exact percentiles of a measure per tag.

    Percentiles come from counts per (tag, value) and their running sum, so equal values combine before the shuffle
    and no tag's rows are gathered. Tags without a value have null percentiles.
    """
    summed = events.groupBy(*keys).agg(
        F.count(value).alias("events"),
        F.sum(value).alias("total"),
        F.min(value).alias("lowest"),
        F.avg(value).alias("mean"),
        F.max(value).alias("highest"),
    )
    counts = events.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_columns(counts, keys, [value], sums={"_upto": "_n"})
    sizes = summed.select(*[F.col(k).alias("_s_" + k) for k in keys], F.col("events").alias("_all"))
    ranked = ranked.join(sizes, null_safe(ranked, sizes, keys, "_s_"))
    # the smallest value that so many hundredths of the values do not exceed
    reached = [F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col(value))).alias(f"p{p}") for p in PERCENTILES]
    marks = ranked.groupBy(*[F.col(k).alias("_m_" + k) for k in keys]).agg(*reached)
    return summed.join(marks, null_safe(summed, marks, keys, "_m_"), "left").drop(*["_m_" + k for k in keys])


# ── translation ─────────────────────────────────────────────────────────────

Provider = Callable[[str, str, str], str]
#: Texts that are Python values at one time.
SLICE = 256
UNTRANSLATED = "This text was not translated: no provider is set."


def unchanged(text: str, source: str, target: str) -> str:
    """The default provider: no translation."""
    return text


def cache_key(text: Column, source: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("|", text, source, target), 256)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text, source_lang, target_lang) to translate, each once; blank texts need none."""
    keyed = texts.where(F.col("text") != "").select(
        cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang")).alias("key"),
        "text", "source_lang", "target_lang",
    )
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def translate(misses: DataFrame, provider: Provider = unchanged) -> DataFrame:
    """Cache rows (key, output, error) of the misses; a failing text keeps its error."""
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("output", T.StringType()), T.StructField("error", T.StringType())]
    )

    names = ["key", "text", "source_lang", "target_lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time are Python values
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            rows = []
            for key, text, source, target in zip(*[part.column(name).to_pylist() for name in names]):
                try:
                    rows.append((key, provider(text, source, target), None))
                except Exception as error:  # one bad text must not fail the job
                    rows.append((key, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()) for values in zip(*rows)], schema.names)

    return misses.mapInArrow(run, schema)


def translated_pages(texts: DataFrame, cache: DataFrame, provider: Provider = unchanged) -> DataFrame:
    """Pages with `translated`, `error` and `banner`; only texts the cache lacks are translated.

    The banner tells readers that the default provider left the text as it was; blank pages need no lookup and none.
    """
    fresh = translate(cache_misses(texts, cache), provider)
    known = cache.select("key", "output", F.lit(None).cast("string").alias("error")).unionByName(fresh)
    keyed = texts.withColumn("key", cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang")))
    blank = F.col("text") == ""
    # blank pages share one text; they stay out of the join, where they would be one hot key
    done = keyed.where(blank).select(*texts.columns, F.col("text").alias("translated"), F.lit(None).cast("string").alias("error"))
    joined = keyed.where(~blank | F.col("text").isNull()).join(known, "key", "left")
    out = done.unionByName(joined.select(*texts.columns, F.col("output").alias("translated"), "error"))
    shown = F.when((F.col("text") != "") & F.lit(provider is unchanged), F.lit(UNTRANSLATED))
    return out.withColumn("banner", shown)


def translation_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count("translated").alias("done"),
        F.count("error").alias("errors"),
    )


# ── batches ─────────────────────────────────────────────────────────────────

# Batch steps with their default options.
STEPS = {
    "compress": {"preset": "medium"},
    "pdfa": {},
    "split": {"every_n": "5"},
    "image_to_pdf": {"deskew": "true", "contrast": "auto"},
}


def batch_plan(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """One job per (file, step) of the file's recipe.

    `files` holds (file_id, filename, recipe_id), `recipes` (recipe_id, steps) with
    steps an array<struct<id, options map>>. Unknown steps become jobs with an
    error; a split size that is no positive number falls back to the default.
    """
    jobs = (
        files.join(recipes, "recipe_id")
        .select("file_id", "filename", "recipe_id", F.posexplode("steps").alias("step_no", "s"))
        .select("file_id", "filename", "recipe_id", "step_no", F.col("s.id").alias("step"), F.col("s.options").alias("given"))
    )
    empty = F.expr("cast(map() as map<string,string>)")
    defaults = F.lit(None).cast("map<string,string>")
    for name, options in STEPS.items():
        pairs = [F.lit(x) for pair in options.items() for x in pair]
        table = F.create_map(*pairs) if pairs else empty
        defaults = F.when(F.col("step") == name, table).otherwise(defaults)
    bad_size = lambda k, v: (k == "every_n") & ~v.rlike(r"^\+?0*[1-9][0-9]*$")
    given = F.map_filter(
        F.coalesce("given", empty), lambda k, v: v.isNotNull() & ~((F.col("step") == "split") & bad_size(k, v))
    )
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k))
    known = F.col("step").isin(list(STEPS))
    stem = F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return jobs.select(
        "file_id",
        "recipe_id",
        "step_no",
        "step",
        F.when(known, F.map_concat(missing, given)).alias("options"),
        F.when(known, F.concat(stem, F.lit(" — "), F.col("step"))).alias("title"),
        F.when(~known, F.concat(F.lit("unknown step: "), F.col("step"))).alias("error"),
    )
