"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows of each text. The method then hashes
the normalised lines, counts in how many distinct documents of the same host each occurs, takes lines above the limits
for boilerplate, removes them from the texts and rejects documents that are depleted without them. Exact copies of a text count as one document,
so a text that many rows repeat is not boilerplate (removing copies is another operator's work).

Window values are compared by their 64-bit hash within one text, lines by theirs within one host. Null texts have no
words and fail; a null host is a host of its own. Repeated rows get equal verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import blank_null, tag, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of a host from this many distinct documents, and this share of the host's documents, on.
MIN_LINE_DOCS = 5
MIN_LINE_PERCENT = 10
#: A document is depleted when fewer words, or a smaller share of its words, is left.
MIN_LEFT_WORDS = 20
MIN_LEFT_PERCENT = 30

_SYMBOLS = "[#*$%&|<>]"
_LINE_SPACE = r"[\x20\x09-\x0D]+"


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the named columns behind a generator of one row: what filters on them reads them, it is not put in their place."""
    held = tag("once")
    made = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in columns), F.explode(F.array(F.struct(*columns))).alias(held))
    return made.select(*(F.col(f"{held}.{c}") if c in columns else F.col(f"`{c}`") for c in rows.columns))


def base_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = blank_null(text_col)
    rows = docs.withColumns({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") > 2, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(
            F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))})
    # Only a text that has a window twice needs its windows in order, each with its place.
    rows = rows.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda j: F.get("_ordered", j)["h"]
    rows = rows.withColumn("_places", F.sort_array(F.transform(F.filter("_ordered", lambda x, j: F.coalesce(
        (j > 0) & (x["h"] == hash_at(j - 1)), F.lit(False)) | F.coalesce(x["h"] == hash_at(j + 1), F.lit(False))), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate("_places", start, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"]), F.lit(0)).cast("long"))
    rows = rows.drop("_words", "_lines", "_windows", "_ordered", "_places")
    rows = once(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def boilerplate_places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, copy, places) of the documents that hold boilerplate lines; ``copy`` is the text's hash, places count from 0."""
    text = blank_null(text_col)
    host = _host(host_col).alias("host")
    # What belongs to the text is computed before its lines are made, not again for every line.
    lines = docs.select(F.col(id_col).alias("id"), host, F.xxhash64(text).alias("copy"), F.split(text, "\n").alias("lines"))
    lines = lines.select("id", "host", "copy", F.posexplode("lines").alias("place", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.lower("line"), _LINE_SPACE, " "))).where("line <> ''")
    lines = lines.select("id", "host", "copy", "place", F.xxhash64("line").alias("mark"))
    hosts = docs.select(host, F.xxhash64(text).alias("copy")).groupBy("host").agg(F.count_distinct("copy").alias("copies"))
    often = lines.groupBy("host", "mark").agg(F.count_distinct("copy").alias("seen")).where(F.col("seen") >= MIN_LINE_DOCS)
    often = often.join(hosts, "host").where(100 * F.col("seen") >= MIN_LINE_PERCENT * F.col("copies"))
    removed = lines.join(often.select("host", "mark"), ["host", "mark"], "left_semi")
    return removed.groupBy("id", "host", "copy").agg(F.collect_set("place").alias("places"))  # repeated rows count once


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))


def _without(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places``, the others as they are and in order; the text itself where places is null."""
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    # One mark per line, in order: sorting them costs less than looking each place up in a long array.
    marks = F.sort_array(F.concat(F.transform(kept, lambda i: F.struct(i.alias("i"), F.lit(True).alias("stays"))),
                                  F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(False).alias("stays")))))
    rest = F.array_join(F.zip_with(lines, marks, lambda line, m: F.when(m["stays"], line)), "\n")
    return F.when(places.isNull(), text).otherwise(rest)


def _cleaned(rows: DataFrame, docs: DataFrame, text: Column, **names: str) -> DataFrame:
    """``rows`` (with id, host, text_hash and n_words) with clean_text, n_removed and depleted; ``text`` is their text."""
    found = boilerplate_places(docs, **names).withColumnsRenamed({"id": "_id", "host": "_host", "copy": "_copy", "places": "_places"})
    rows = rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["host"] == found["_host"]) & (rows["text_hash"] == found["_copy"]), "left")
    rows = rows.withColumn("clean_text", _without(text, F.col("_places")))
    left = F.size(words_of(F.col("clean_text"))).cast("long")
    rows = once(rows.withColumn("_left", F.when(F.col("_places").isNotNull(), left).otherwise(F.col("n_words"))), "clean_text", "_left")
    rows = rows.withColumns({
        "n_removed": F.col("n_words") - F.col("_left"),
        "depleted": F.col("_places").isNotNull() & ((F.col("_left") < MIN_LEFT_WORDS) | (100 * F.col("_left") < MIN_LEFT_PERCENT * F.col("n_words")))})
    return rows.drop("_id", "_host", "_copy", "_places", "_left")


def cleaned_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed, kept and clean_text, one row per row of ``docs``.

    clean_text is the text without its boilerplate lines, a null text stays null; n_removed counts the words it lacks.
    """
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _host(host_col).alias("host"), F.xxhash64(blank_null(text_col)).alias("text_hash"))
    rows = _cleaned(base_counts(few), docs, F.col("text"), id_col=id_col, text_col=text_col, host_col=host_col)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed",
                       (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "clean_text")


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed and kept, one row per row of ``docs``."""
    return cleaned_verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col).drop("clean_text")


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, their text without its boilerplate lines.

    The base rules are a filter on the scan; rows travel once, to meet the places of their boilerplate lines.
    """
    whole = tag("row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col(text_col).alias("text"), F.col(id_col).alias("id"),
                       _host(host_col).alias("host"), F.xxhash64(blank_null(text_col)).alias("text_hash"))
    rows = base_counts(rows).where("not base_failed")
    rows = _cleaned(rows.drop("text"), docs, F.col(f"{whole}.`{text_col}`"), id_col=id_col, text_col=text_col, host_col=host_col).where("not depleted")
    return rows.select(*(F.col("clean_text").alias(c) if c == text_col else F.col(f"{whole}.`{c}`") for c in docs.columns))
