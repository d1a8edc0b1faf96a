"""Dataset rows -> items: reshaping projections. Rows carry `ord`, their position, which defaults ids and orders results."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions.extract import LETTERS
from ..functions.text import SPACE, match_key, normalize, normalize_display, py_strip
from .metrics import placed

# Language names in Uzbek.
LANGUAGES = {"uz": "oʻzbek", "en": "ingliz", "ru": "rus", "tr": "turk", "kk": "qozoq"}


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a contiguous `ord` in file order: counts per partition, then a running number inside each."""
    marked = rows.withColumn("__m", F.monotonically_increasing_id())
    sizes = marked.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    own = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(offsets), F.shiftright("__m", 33) == F.col("__p")).withColumn("ord", own + F.col("__before")).drop("__m", "__p", "__n", "__before")


def first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def default_items(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("item_id"), "ord", F.struct(*[c for c in rows.columns if c != "ord"]).alias("payload"), F.col("answer").alias("gold"))


def letter_index(letter: Column, letters: str, strict: bool = False) -> Column:
    """Position of an answer key. Without strict a key may be any substring of the letters, an empty one included."""
    said = F.upper(py_strip(letter))
    at = F.when(F.length(said) == 0, F.lit(0)).otherwise(F.position(said, F.lit(letters)) - 1)
    return F.when((at >= 0) & ((F.length(said) == 1) if strict else F.lit(True)), at)


def choice_items(rows: DataFrame, options: Column, gold: Column, question: Column, meta: Column, display=normalize_display) -> DataFrame:
    """item_id, ord, question, options, gold_index, gold, meta. Rows without options or with a key out of range are dropped."""
    out = rows.withColumn("options", options).withColumn("gold_index", gold)
    out = out.where(F.col("gold_index").isNotNull() & (F.size("options") > 0) & (F.col("gold_index") >= 0) & (F.col("gold_index") < F.size("options")))
    # one pass of the normaliser over all options: they are joined by a character that no text has
    shown = F.split(display(F.array_join("options", "\x1e", "")), "\x1e", -1)
    return out.select(
        F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("item_id"), "ord", display(question).alias("question"), shown.alias("options"), F.col("gold_index").cast("int").alias("gold_index"),
        F.substring(F.lit(LETTERS), F.col("gold_index").cast("int") + 1, F.lit(1)).alias("gold"), meta.alias("meta"),
    )


def dtm_choice(rows: DataFrame, strict: bool = False) -> tuple[Column, Column]:
    """Options and the position of the key."""
    options = F.array(*[F.coalesce(F.col(f"option_{x}").cast("string"), F.lit("")) for x in "ABCD"])
    key = F.col("answer") if "answer" in rows.columns else F.col("correct_answer")
    return options, letter_index(key, "ABCD", strict)


def dtm_items(rows: DataFrame, strict: bool = False) -> DataFrame:
    options, gold = dtm_choice(rows, strict)
    return choice_items(rows, options, gold, F.col("question"), F.create_map(F.lit("subject"), F.coalesce("subject", F.lit("unknown"))))


def parse_options(cell: Column) -> Column:
    """An options cell: a JSON array; else quoted spans; else lines. Blank gives none."""
    text = py_strip(F.coalesce(cell.cast("string"), F.lit("")))
    parsed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    valid = F.when(F.try_parse_json(text).isNotNull(), parsed)
    spans = F.regexp_extract_all(text, F.lit(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""), F.lit(0))
    quoted = F.transform(spans, lambda x: F.replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')))
    lines = F.filter(F.transform(F.split(py_strip(text, r"\[\]"), "\n", -1), lambda x: py_strip(x)), lambda x: F.length(x) > 0)
    none = F.array().cast("array<string>")
    return F.when(F.length(text) == 0, none).when(valid.isNotNull(), valid).when(F.size(quoted) > 0, quoted).otherwise(lines)


def mmlu_choice() -> tuple[Column, Column]:
    """Options and the position of the key."""
    given = first(F.col("answer_index"))
    gold = F.when(given.isNotNull(), F.expr("try_cast(answer_index as int)")).otherwise(letter_index(F.col("answer"), LETTERS))
    return parse_options(first(F.col("options_uzb"), F.col("options"))), gold


def mmlu_items(rows: DataFrame) -> DataFrame:
    options, gold = mmlu_choice()
    rows = rows.withColumn("id", F.coalesce(F.col("question_id").cast("string"), F.col("ord").cast("string")))
    return choice_items(rows, options, gold, first(F.col("question_uzb"), F.col("question")), F.create_map(F.lit("category"), F.coalesce("category", F.lit("unknown"))))


# The kinds of reasoning puzzles.
REASONING = ("zebra_puzzle", "spatial", "web_of_lies_v2")


def reasoning_items(rows: DataFrame) -> DataFrame:
    turns = F.when(F.size("turns_in_uzbek") > 0, F.col("turns_in_uzbek")).otherwise(F.col("turns"))
    gold = py_strip(F.coalesce(first(F.col("ground_truth_uzbek"), F.col("ground_truth")), F.lit("")))
    out = rows.where(F.col("task").isin(*REASONING)).select(F.left(F.coalesce(F.col("question_id").cast("string"), F.col("ord").cast("string")), F.lit(16)).alias("item_id"), "ord", F.get(turns, F.lit(0)).alias("question"), gold.alias("gold"), F.col("task").alias("kind"))
    return out.where((F.length(F.coalesce("question", F.lit(""))) > 0) & (F.length("gold") > 0))


def translation_items(rows: DataFrame, directions=("uz_en", "en_uz", "uz_ru", "ru_uz"), splits: tuple[str, ...] = ()) -> DataFrame:
    """One item per row and direction; a blank split passes, sides may also stand in source and reference."""
    split = F.lower(py_strip(F.coalesce(F.col("split"), F.lit(""))))
    kept = rows.where((split == "") | split.isin(*splits)) if splits else rows
    have = set(rows.columns)
    made = []
    for d in directions:
        sides = []
        for lang, plain in zip(d.split("_"), ("source", "reference")):
            options = [F.col(f"text_{lang}")] if f"text_{lang}" in have else []
            if {plain, "direction"} <= have:
                options.append(F.when(F.col("direction") == d, F.col(plain)))
            sides.append(first(*options) if options else F.lit(None).cast("string"))
        made.append(F.struct(F.lit(d).alias("direction"), sides[0].alias("source"), sides[1].alias("target")))
    out = kept.select(F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("rid"), "ord", F.when(split == "", "unknown").otherwise(split).alias("split"), F.explode(F.array(*made)).alias("x"))
    out = out.where("x.source is not null and x.target is not null")
    return out.select(F.concat("rid", F.lit(":"), "x.direction").alias("item_id"), "ord", "split", "x.direction", "x.source", normalize(F.col("x.target")).alias("gold"))


ARGUMENTS = "map<string,array<string>>"


def arguments(c: Column, kind) -> Column:
    """Arguments by position as array<map<string, array<string>>>: a single value is a list of one, null arguments are dropped.

    kind: the column's type. JSON text, VARIANT, maps and structs of any types do, also where an argument is a number in one row
    and a list in the next.
    """
    if kind.simpleString() == f"array<{ARGUMENTS}>":
        return F.transform(c, lambda m: F.map_filter(F.coalesce(m, F.create_map().cast(ARGUMENTS)), lambda k, v: v.isNotNull()))
    name = kind.typeName()
    v = c if name == "variant" else F.try_parse_json(c) if name == "string" else F.to_variant_object(c)
    listed = F.try_variant_get(v, "$", "array<variant>")

    def plain(x: Column) -> Column:
        said = F.try_variant_get(x, "$", "array<string>")
        return F.when(F.is_variant_null(x), F.lit(None).cast("array<string>")).otherwise(F.coalesce(said, F.array(F.try_variant_get(x, "$", "string"))))

    def one(x: Column) -> Column:
        named = F.coalesce(F.try_variant_get(x, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        return F.map_filter(F.transform_values(named, lambda k, v: plain(v)), lambda k, v: v.isNotNull())

    return F.transform(listed, one)


def _constraints(rows: DataFrame) -> DataFrame:
    """item_id, ord, prompt, constraints: for each instruction id struct<at, name, kw, localised>, local arguments over the others."""
    empty = F.create_map().cast(ARGUMENTS)
    said = lambda c: arguments(F.col(c), rows.schema[c].dataType) if c in rows.columns else F.array().cast(f"array<{ARGUMENTS}>")
    prompt = first(*[F.col(c) for c in ("prompt_uz", "prompt") if c in rows.columns])
    made = rows.where(prompt.isNotNull()).select(
        F.coalesce(F.col("key").cast("string"), F.col("ord").cast("string")).alias("item_id"), "ord", prompt.alias("prompt"), F.coalesce("instruction_id_list", F.array().cast("array<string>")).alias("ids"),
        said("kwargs").alias("base"), said("kwargs_uz").alias("local"),
    )

    def one(name: Column, at: Column) -> Column:
        own = lambda c: F.coalesce(F.get(F.col(c), at), empty)
        over = F.map_concat(F.map_filter(own("base"), lambda k, v: ~F.map_contains_key(own("local"), k)), own("local"))
        return F.struct(at.alias("at"), name.alias("name"), over.alias("kw"), (F.size(own("local")) > 0).alias("localised"))

    return made.select("item_id", "ord", "prompt", F.transform("ids", one).alias("constraints"))


def constraint_items(rows: DataFrame) -> DataFrame:
    """One item per prompt, with its constraints; rows without a prompt are left out."""
    return _constraints(rows).select("item_id", "ord", "prompt", F.transform("constraints", lambda x: x["name"]).alias("gold"), "constraints")


def constraint_rows(rows: DataFrame) -> DataFrame:
    """item_id, ord, prompt, at, name, kw, localised: a row for each constraint."""
    return _constraints(rows).select("item_id", "ord", "prompt", F.inline("constraints"))


def accepted_forms(rows: DataFrame) -> DataFrame:
    """ord, forms, keys: accepted answers and the answer itself, first of each match key, normalised."""
    all_ = F.concat(F.coalesce("accepted", F.array().cast("array<string>")), F.when(F.length(F.coalesce("answer", F.lit(""))) > 0, F.array("answer")).otherwise(F.array().cast("array<string>")))
    each = rows.select("ord", F.posexplode(all_).alias("at", "form")).withColumn("key", match_key(F.col("form"))).where(F.length("key") > 0)
    one = each.groupBy("ord", "key").agg(F.min(F.struct("at", "form")).alias("x"))
    one = one.select("ord", "key", F.col("x.at").alias("at"), normalize(F.col("x.form")).alias("form"))
    listed = one.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("at", "form", "key"))).alias("x"))
    return listed.select("ord", F.col("x.form").alias("forms"), F.col("x.key").alias("keys"))


def riddle_items(rows: DataFrame) -> DataFrame:
    out = rows.join(accepted_forms(rows), "ord").where(F.length(py_strip(F.coalesce("riddle", F.lit("")))) > 0)
    meta = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("theme", "difficulty")]
    return out.select(F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("item_id"), "ord", normalize_display(F.col("riddle")).alias("riddle"), F.col("forms").alias("gold"), F.col("keys").alias("gold_keys"), *meta, F.get("forms", F.lit(0)).alias("canonical"))


def riddle_choice_items(rows: DataFrame) -> DataFrame:
    """The first accepted form and three distractors as options, gold first; rows without four different ones are dropped."""
    out = rows.join(accepted_forms(rows), "ord").where(F.size(F.coalesce("distractors", F.array().cast("array<string>"))) >= 3)
    joined = normalize_display(F.array_join(F.concat(F.slice("forms", 1, 1), F.slice("distractors", 1, 3)), "\x1e", ""))
    out = out.withColumn("options", F.split(joined, "\x1e", -1)).withColumn("__keys", F.split(match_key(F.replace(joined, F.lit("\x1e"), F.lit("\x01"))), "\x01", -1))
    out = out.where(F.size(F.array_distinct(F.transform("__keys", lambda x: py_strip(x)))) == 4)
    return out.select(F.coalesce(F.col("id").cast("string"), F.col("ord").cast("string")).alias("item_id"), "ord", normalize_display(F.col("riddle")).alias("riddle"), "options", F.lit(0).alias("gold_index"), "theme", "difficulty")


def permute_hashed(items: DataFrame, seed: int = 0) -> DataFrame:
    """items with options in the order of a hash of seed, id and position; gold follows its option by position."""
    keyed = F.transform("options", lambda o, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id"), i.cast("string"))).alias("h"), i.alias("i"), o.alias("o")))
    return _reordered(items.withColumn("__x", F.array_sort(keyed)))


def _reordered(items: DataFrame) -> DataFrame:
    at = (F.array_position(F.col("__x.i"), F.col("gold_index")) - 1).cast("int")
    out = items.withColumn("options", F.col("__x.o")).withColumn("gold_index", at).drop("__x")
    return out.withColumn("gold", F.substring(F.lit(LETTERS), F.col("gold_index") + 1, F.lit(1)))


#: Items of several sizes whose orders one generator makes on the driver.
MOST_SEEDED = 1_000_000


def permute_seeded(items: DataFrame, seed: int = 0) -> DataFrame:
    """items with options as one seeded generator shuffles them, item after item in `ord`.

    Items that all have as many options are shuffled in parts, in any number. Where their numbers differ nothing tells in advance
    which number of the stream an item begins with; the orders are made on the driver then, from the numbers of options alone, and
    beyond MOST_SEEDED items that is an error: use permute_hashed.
    """
    spark = items.sparkSession
    sizes = [r["n"] for r in items.select(F.size("options").alias("n")).distinct().limit(2).collect()]
    if len(sizes) < 2:
        told = placed(items.select("ord"), "ord")
        table = told.join(seeded.orders(spark, items.count(), sizes[0] if sizes else 0, seed), "pos").select("ord", F.col("order").alias("__order"))
    else:
        rows = items.select("ord", F.size("options").alias("n")).orderBy("ord").limit(MOST_SEEDED + 1).collect()
        if len(rows) > MOST_SEEDED:
            raise ValueError(f"more than {MOST_SEEDED} items of several sizes: use permute_hashed")
        rng, orders = random.Random(seed), []
        for row in rows:
            order = list(range(row["n"]))
            rng.shuffle(order)
            orders.append((row["ord"], order))
        table = spark.createDataFrame(orders, "ord bigint, __order array<int>")
    out = items.join(table, "ord").withColumn("__x", F.transform("__order", lambda i: F.struct(i.alias("i"), F.get("options", i).alias("o"))))
    return _reordered(out.drop("__order"))


def cyclic_variants(items: DataFrame) -> DataFrame:
    """Every rotation of the options; shift says by how many places."""
    out = items.withColumn("shift", F.explode(F.sequence(F.lit(0), F.size("options") - 1)))
    n = F.size("options")
    turned = F.concat(F.slice("options", F.col("shift") + 1, n), F.slice("options", F.lit(1), F.col("shift")))
    out = out.withColumn("__turned", turned).withColumn("gold_index", F.pmod(F.col("gold_index") - F.col("shift"), n).cast("int"))
    return out.withColumn("options", F.col("__turned")).drop("__turned").withColumn("gold", F.substring(F.lit(LETTERS), F.col("gold_index") + 1, F.lit(1)))


def lettered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), o)), "\n")


def choice_prompt(question: Column, options: Column, answer_only: bool = True) -> Column:
    ask = "Savolga bitta harf bilan javob bering." if answer_only else "Fikr yuriting, soʻng oxirgi qatorda harfni yozing."
    return F.concat(F.lit(ask + "\n\nSavol: "), question, F.lit("\n\n"), lettered(options), F.lit("\n\nJavob:"))


def translation_prompt(direction: Column, source: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    side = lambda i: F.coalesce(F.try_element_at(names, F.get(F.split(direction, "_"), F.lit(i))), F.get(F.split(direction, "_"), F.lit(i)))
    return F.concat(F.lit("Matnni "), side(0), F.lit(" tilidan "), side(1), F.lit(" tiliga oʻgiring, faqat tarjimani yozing.\n\nMatn: "), source, F.lit("\n\nTarjima:"))


def riddle_prompt(riddle: Column, options: Column | None = None) -> Column:
    said = F.concat(F.lit("Topishmoqning javobini toping.\n\nZarbulmasal: "), riddle)
    return F.concat(said, F.lit("\n\n"), lettered(options), F.lit("\n\nJavob:")) if options is not None else F.concat(said, F.lit("\n\nJavob:"))


def limited(items: DataFrame, n: int) -> DataFrame:
    """The first n items."""
    return items.orderBy("ord").limit(n)


def squeezed_prompt(c: Column, n: int = 300) -> Column:
    return F.left(py_strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE}]+", " ")), F.lit(n))
