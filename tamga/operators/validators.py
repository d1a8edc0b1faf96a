"""Dataset validators: each gives (row_id, problem) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constraints import NEEDS_LOCALE, REGISTRY
from ..functions.score import matches, slots, yes_no
from ..functions.text import SPACE, fold_apostrophes, match_key, match_key_lower, normalize_display, py_strip, words_of
from .items import accepted_forms, constraint_rows, parse_options


def found(rows: DataFrame, row_id: Column, rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """One row per rule that a row breaks, in one pass."""
    said = F.array_compact(F.array(*[F.when(broken, F.lit(text) if isinstance(text, str) else text) for broken, text in rules]))
    return rows.select(row_id.cast("string").alias("row_id"), F.explode(said).alias("problem"))


def choice_problems(rows: DataFrame, row_id: Column, options: Column, gold: Column) -> DataFrame:
    n = F.size(options)
    some = n > 0
    return found(rows, row_id, [
        (~some, "no options"),
        (some & F.exists(options, lambda o: F.length(py_strip(o)) == 0), "empty option text"),
        (some & (F.size(F.array_distinct(options)) < n), "duplicate option text"),
        (some & gold.isNull(), "missing or invalid answer key"),
        (some & ((gold < 0) | (gold >= n)), F.concat(F.lit("answer index "), gold.cast("string"), F.lit(" out of "), n.cast("string"))),
    ])


def shown_choice_problems(rows: DataFrame, row_id: Column, options: Column, gold: Column) -> DataFrame:
    """choice_problems of options as they are shown: two that differ only in their apostrophes are one."""
    shown_ = F.split(normalize_display(F.array_join("__options", "\x1e", "")), "\x1e", -1)
    made = rows.withColumn("__options", options).withColumn("__gold", gold)
    made = made.withColumn("__shown", F.when(F.size("__options") > 0, shown_).otherwise(F.array().cast("array<string>")))
    return choice_problems(made, row_id, F.col("__shown"), F.col("__gold"))


def translated_problems(rows: DataFrame, row_id: Column) -> DataFrame:
    """Option counts and lengths of a translated multiple-choice row."""
    en, uz = parse_options(F.col("options")), parse_options(F.col("options_uzb"))
    q_en, q_uz = F.coalesce("question", F.lit("")), F.coalesce("question_uzb", F.lit(""))
    return found(rows, row_id, [
        ((F.size(en) > 0) & (F.size(uz) > 0) & (F.size(en) != F.size(uz)), "option counts differ"),
        ((F.length(q_en) > 0) & (F.length(q_uz) > 0) & (F.length(q_uz) < F.lit(0.35) * F.length(q_en)), "translation much shorter than the original"),
    ])


def reasoning_problems(rows: DataFrame, row_id: Column, key=match_key_lower) -> DataFrame:
    uz, en = (py_strip(F.coalesce(F.col(c), F.lit(""))) for c in ("ground_truth_uzbek", "ground_truth"))
    neutral = en.rlike(rf"^[0-9{SPACE},.\-/&+]+\z")
    some = F.length(uz) > 0
    return found(rows, row_id, [
        (~some, "no Uzbek ground truth"),
        (some & (uz == en) & (F.col("task") == "zebra_puzzle") & ~neutral, "ground truth not translated"),
        (some & (F.length(en) > 0) & (F.size(F.split(uz, ",", -1)) != F.size(F.split(en, ",", -1))), "slot counts differ"),
        (some & (F.col("task") == "web_of_lies_v2") & F.exists(slots(uz), lambda x: yes_no(x, key).isNull()), "slots other than yes, no, unknown"),
    ])


def translation_problems(rows: DataFrame, row_id: Column, directions: tuple[str, ...]) -> DataFrame:
    needed = sorted({f"text_{x}" for d in directions for x in d.split("_")})
    blank = lambda c: F.length(py_strip(F.coalesce(F.col(c), F.lit("")))) == 0 if c in rows.columns else F.lit(True)
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in needed]))
    plain = ~blank("source") & ~blank("reference")
    return found(rows, row_id, [((F.size(missing) > 0) & ~plain, F.concat(F.lit("missing "), F.array_join(missing, ", ")))])


def constraint_problems(rows: DataFrame) -> DataFrame:
    """Rows without a prompt, then counts of unregistered ids and of constraints that no locale covers, most frequent first."""
    blank = rows.where(F.length(F.coalesce("prompt_uz", F.lit(""))) == 0).select(F.coalesce(F.col("key").cast("string"), F.col("ord").cast("string")).alias("row_id"), F.lit("no Uzbek prompt").alias("problem"))
    each = constraint_rows(rows)
    local = [k for k, c in REGISTRY.items() if c.disposition == NEEDS_LOCALE]
    kind = F.when(~F.col("name").isin(*REGISTRY), "constraints with an unregistered id").when(F.col("name").isin(*local) & ~F.col("localised"), "constraints without local arguments")
    counts = each.select("name", kind.alias("kind")).where("kind is not null").groupBy("name", "kind").agg(F.count("*").alias("n"))
    return blank.unionByName(counts.select(F.col("name").alias("row_id"), F.concat(F.col("n").cast("string"), F.lit(" "), "kind").alias("problem")))


def riddle_problems(rows: DataFrame) -> DataFrame:
    """rows: ord, id, riddle, answer, accepted, distractors. Distractors are compared in lower case, in the JVM."""
    rows = rows.withColumn("id", F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")))
    text = F.coalesce("riddle", F.lit(""))
    base = rows.join(accepted_forms(rows), "ord", "left").withColumn("key", match_key(text)).withColumn("words", words_of(fold_apostrophes(F.lower(text))))
    none = F.array().cast("array<string>")
    keys = F.coalesce("keys", none)
    before = F.lag("id").over(Window.partitionBy("key").orderBy("ord"))
    copied = F.filter(keys, lambda k: F.array_contains(F.col("words"), k))
    base = base.withColumn("before", before)
    plain = found(base, F.col("id"), [
        (F.length(py_strip(text)) == 0, "no riddle text"),
        (F.size(keys) == 0, "no accepted answer"),
        (F.col("before").isNotNull(), F.concat(F.lit("duplicate of "), F.col("before"))),
        (F.size(copied) > 0, F.concat(F.lit("answer in the riddle: "), F.get(copied, F.lit(0)))),
    ])
    each = base.select("id", keys.alias("keys"), F.explode(F.coalesce("distractors", none)).alias("distractor"))
    wrong = each.where(matches(F.col("distractor"), F.col("keys"), match_key_lower)).select(F.col("id").alias("row_id"), F.concat(F.lit("distractor is an answer: "), "distractor").alias("problem"))
    return plain.unionByName(wrong)


def shown(problems: DataFrame, limit: int, *by: str) -> DataFrame:
    """The first problems of each group, and how many more there are."""
    order = Window.partitionBy(*by).orderBy("row_id", "problem")
    out = problems.withColumn("position", F.row_number().over(order)).withColumn("more", F.greatest(F.count("*").over(Window.partitionBy(*by)) - limit, F.lit(0)))
    return out.where(F.col("position") <= limit)
