"""Local arguments of constraints: what is missing, what was filled in, what quotes tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constraints import NEEDS_LOCALE, REGISTRY
from ..functions.text import TURNED, fold_apostrophes, py_strip, quoted_terms
from .items import squeezed_prompt

# Instruction -> its argument, and whether that is a list.
TERMS = {
    "keywords:existence": ("keywords", True),
    "keywords:frequency": ("keyword", False),
    "keywords:forbidden_words": ("forbidden_words", True),
    "length_constraints:nth_paragraph_first_word": ("first_word", False),
    "startend:end_checker": ("end_phrase", False),
    "combination:repeat_prompt": ("prompt_to_repeat", False),
    "detectable_content:postscript": ("postscript_marker", False),
    "detectable_format:multiple_sections": ("section_spliter", False),
}
# Words for a section, and stems that announce an ending.
SECTION = rf"(?iU)\b(BO[{TURNED}'‘]?LIM|PARAGRAF|QISM|BOB)\b"
ENDING = rf"(?iU)\b(yakunla|tugat|oxirgi|so[{TURNED}']nggi|bilan tuga)"


def missing(rows: DataFrame) -> DataFrame:
    """key, constraint, kwarg, index, en, uz, prompt_uz: each term that a locale still owes, in dataset order.

    rows: constraint rows (item_id, ord, prompt, at, name, kw, localised).
    """
    local = [k for k, c in REGISTRY.items() if c.disposition == NEEDS_LOCALE and k in TERMS]
    names = F.create_map(*[F.lit(x) for k in local for x in (k, TERMS[k][0])])
    open_ = rows.where(F.col("name").isin(*local) & ~F.col("localised")).withColumn("kwarg", F.try_element_at(names, F.col("name")))
    each = open_.where(F.map_contains_key("kw", F.col("kwarg"))).select("item_id", "ord", "at", "name", "kwarg", "prompt", F.posexplode(F.try_element_at("kw", F.col("kwarg"))).alias("n", "en"))
    return each.orderBy("ord", "at", "n").select(F.col("item_id").alias("key"), F.col("name").alias("constraint"), "kwarg", F.concat_ws(".", "at", "n").alias("index"), "en", F.lit("").alias("uz"), squeezed_prompt(F.col("prompt")).alias("prompt_uz"))


def merged(filled: DataFrame, expected: DataFrame) -> DataFrame:
    """key, i, kwarg, terms of a filled worklist. Blank cells are skipped, and a list is taken whole or not at all.

    filled: key, constraint, kwarg, index, uz. expected: key, i, kwarg, expected (number of terms).
    """
    place = F.split("index", r"\.")
    uz = py_strip(F.coalesce("uz", F.lit("")))
    some = filled.select("key", "constraint", "kwarg", F.get(place, F.lit(0)).cast("int").alias("i"), F.get(place, F.lit(1)).cast("int").alias("n"), uz.alias("uz")).where(F.length("uz") > 0)
    lists = [k for k, (_, many) in TERMS.items() if many]
    made = some.groupBy("key", "i", "kwarg").agg(F.array_sort(F.collect_list(F.struct("n", "uz"))).alias("x"), F.bool_or(F.col("constraint").isin(*lists)).alias("many"))
    met = made.join(expected, ["key", "i", "kwarg"], "left").where(~F.col("many") | (F.size("x") >= F.coalesce("expected", F.lit(0))))
    return met.select("key", "i", "kwarg", F.transform("x.uz", lambda t: fold_apostrophes(t)).alias("terms"))


def quote_map(prompt_en: Column, prompt_uz: Column, terms: Column) -> Column:
    """English term -> quoted Uzbek term, by order of quotes; null unless each term is quoted and the numbers are equal."""
    quotes_en, quotes_uz = F.transform(quoted_terms(prompt_en), lambda x: F.lower(x)), quoted_terms(prompt_uz)
    wanted = F.array_distinct(terms)
    placed = F.array_sort(F.transform(wanted, lambda t: F.struct(F.array_position(quotes_en, F.lower(t)).alias("at"), t.alias("t"))))
    all_quoted = F.forall(wanted, lambda t: F.array_contains(quotes_en, F.lower(t)))
    fits = (F.size(wanted) > 0) & all_quoted & (F.size(wanted) == F.size(quotes_uz))
    return F.when(fits, F.map_from_arrays(F.transform(placed, lambda x: x.t), F.transform(quotes_uz, lambda x: fold_apostrophes(x))))


def localised(rows: DataFrame) -> DataFrame:
    """item_id, at, kwarg, terms: arguments that the quotes of both prompts, or a section word or an ending, settle.

    rows: item_id, at, name, kw (English arguments), local (what is there already), prompt_en, prompt_uz.
    """
    names = ("keywords:existence", "keywords:frequency", "keywords:forbidden_words", "length_constraints:nth_paragraph_first_word")
    arg = F.try_element_at(F.create_map(*[F.lit(x) for k in names for x in (k, TERMS[k][0])]), F.col("name"))
    rows = rows.withColumn("kwarg", F.coalesce(arg, F.when(F.col("name") == "detectable_format:multiple_sections", "section_spliter").when(F.col("name") == "startend:end_checker", "end_phrase")))
    rows = rows.withColumn("en", F.when(F.col("name").isin(*names), F.coalesce(F.try_element_at("kw", F.col("kwarg")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    own = rows.groupBy("item_id").agg(F.flatten(F.collect_list("en")).alias("wanted"), F.first("prompt_en").alias("p"), F.first("prompt_uz").alias("u"))
    maps = own.select("item_id", quote_map(F.col("p"), F.col("u"), F.col("wanted")).alias("map"))
    met = rows.join(maps, "item_id").where(F.col("kwarg").isNotNull() & ~F.map_contains_key("local", F.col("kwarg")))
    low = F.lower("prompt_uz")

    def said(t: Column) -> Column:
        uz = F.try_element_at(F.col("map"), t)
        return F.when((F.lower(uz) != F.lower(t)) | low.contains(F.lower(t)), uz)

    mapped = F.transform("en", said)
    quotes = quoted_terms(F.col("prompt_uz"))
    section = F.nullif(F.regexp_extract("prompt_uz", SECTION, 1), F.lit(""))
    terms = F.when(F.col("name").isin(*names) & (F.size("en") > 0) & F.forall(mapped, lambda x: x.isNotNull()), mapped)
    terms = terms.when((F.col("name") == "detectable_format:multiple_sections") & section.isNotNull(), F.array(fold_apostrophes(section)))
    terms = terms.when((F.col("name") == "startend:end_checker") & (F.size(quotes) > 0) & F.col("prompt_uz").rlike(ENDING), F.array(fold_apostrophes(F.element_at(F.concat(F.array(F.lit("")), quotes), -1))))
    return met.select("item_id", "at", "name", "kwarg", terms.alias("terms")).where("terms is not null")


def coverage(rows: DataFrame) -> DataFrame:
    """kwarg, total, before, after: how many arguments are localised. rows: kwarg, before, after (booleans)."""
    return rows.groupBy("kwarg").agg(F.count("*").alias("total"), F.count_if("before").alias("before"), F.count_if("after").alias("after"))


def histogram(missing_: DataFrame) -> DataFrame:
    """constraint, n: how many terms a locale owes, the most first, ties by name."""
    return missing_.groupBy("constraint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "constraint")
