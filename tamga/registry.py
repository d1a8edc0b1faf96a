"""Task definitions: how rows become items, responses become extractions, and extractions scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import extract, mt, score, stats
from .functions.constraints import evaluate, with_judged
from .functions.text import cyrillic_ratio, normalize
from .operators import items, metrics, records, validators

TASKS: dict[str, type[EvalTask]] = {}


def register_task(cls):
    """A task needs a name and a version, and a name can be taken once."""
    for need in ("name", "version"):
        if not getattr(cls, need, ""):
            raise ValueError(f"a task needs a {need}")
    if cls.name in TASKS:
        raise ValueError(f"there is a task {cls.name!r} already")
    TASKS[cls.name] = cls
    return cls


def get_task(name: str) -> type[EvalTask]:
    if name not in TASKS:
        raise KeyError(f"no task {name!r}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]


class EvalTask:
    """Methods take and give DataFrames and Columns. items() gives item_id, ord and what the others read.

    columns: what a dataset's rows may have, by Spark type; what a file lacks is null. variants: columns whose values differ in type.
    """

    name = version = ""
    chance = 0.0
    max_tokens = 1024
    breakdown: tuple[str, ...] = ()
    columns: dict[str, str] = {"id": "string", "answer": "string", "prompt": "string"}
    variants: tuple[str, ...] = ()

    def __init__(self, seed: int = 0, **options):
        self.seed, self.options = seed, options

    def shaped(self, rows: DataFrame) -> DataFrame:
        """Dataset rows with all columns that the task may read. A single value stands for a list of it."""
        for c, kind in self.columns.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
            elif kind.startswith("array") and not rows.schema[c].dataType.simpleString().startswith("array"):
                rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))))
        return rows

    def items(self, rows: DataFrame) -> DataFrame:
        return items.default_items(rows)

    def problems(self, rows: DataFrame) -> DataFrame:
        """row_id, problem of dataset rows as they are, also of those that make no item."""
        return rows.select(F.col("ord").cast("string").alias("row_id"), F.lit("").alias("problem")).limit(0)

    def prompt(self) -> Column:
        return F.col("prompt")

    def parse(self, response: Column) -> Column:
        return extract.extract_response(response)

    def score(self, extraction: Column) -> Column:
        return score.choice_score(extraction["value"], F.col("gold"))

    def results(self, items_: DataFrame, responses: DataFrame, rescoring: bool = False) -> DataFrame:
        """items with responses (item_id, text, finish_reason, error) parsed and scored. A failed request is an `error`; a run
        also marks answers that the budget cut off, rescoring doesn't."""
        # as a generated row the extraction is worked out once; as a column it is written out wherever a part of it is read
        met = items_.join(responses, "item_id").select("*", F.explode(F.array(self.parse(F.col("text")))).alias("x"))
        status = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("x.status") if rescoring else extract.truncation(F.col("x.status"), F.col("finish_reason")))
        fine = F.col("error").isNull() & extract.ok(F.col("x"))
        told = met.withColumn("status", status).withColumn("strategy", F.when(F.col("error").isNull(), F.col("x.strategy")).otherwise("")).withColumn("extracted", F.when(F.col("error").isNull(), F.col("x.value")))
        return self.scored(told.withColumn("fine", fine))

    def scored(self, told: DataFrame) -> DataFrame:
        """told with `score`, 0 where the answer isn't `fine`."""
        return told.withColumn("score", F.when(F.col("fine"), self.score(F.col("x"))).otherwise(0.0))

    def summary(self, results: DataFrame) -> DataFrame:
        """One row: primary, ci_low, ci_high, n, rates by status, and `told`: what else the task publishes."""
        both = self.measured(results).withColumn("k", F.lit(1))
        out = both.join(records.diagnostics(results).withColumn("k", F.lit(1)), "k").drop("k")
        return out.withColumn("at_or_below_chance", records.at_or_below_chance(F.col("primary"), F.lit(self.chance)))

    def measured(self, results: DataFrame) -> DataFrame:
        """One row: primary, ci_low, ci_high, n, told. By default the accuracy over scorable items, with Wilson's interval."""
        return _published(metrics.accuracy(results), "accuracy").withColumn("told", F.struct(stats.py_round(F.col("correct"), 2).alias("correct"))).select("primary", "ci_low", "ci_high", "n", "told")

    def broken_down(self, results: DataFrame) -> DataFrame | None:
        """key, value, accuracy, ci_low, ci_high, n by the task's keys, in order."""
        if not self.breakdown:
            return None
        keyed = results.select("status", "score", *[(F.col(k) if k in results.columns else F.col("meta")[k]).alias(k) for k in self.breakdown])
        return metrics.breakdown(keyed, list(self.breakdown)).orderBy("key", "value")


def _published(df: DataFrame, primary: str) -> DataFrame:
    two = {"primary": stats.py_round(F.col(primary), 2), "ci_low": stats.py_round(F.col("ci_low"), 2), "ci_high": stats.py_round(F.col("ci_high"), 2)}
    return df.withColumns(two)


def _row_id(*columns: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in (*columns, "ord")])


class _Choice(EvalTask):
    def prompt(self) -> Column:
        return items.choice_prompt(F.col("question"), F.col("options"), self.options.get("answer_only", True))

    def parse(self, response: Column) -> Column:
        return extract.extract_choice(response, F.size("options"), strict=self.options.get("strict", False))

    def permuted(self, made: DataFrame) -> DataFrame:
        """Options in another order: `shuffle` is hashed (any size) or seeded (as one generator would do it)."""
        how = self.options.get("shuffle", "")
        return items.permute_hashed(made, self.seed) if how == "hashed" else items.permute_seeded(made, self.seed) if how == "seeded" else made


@register_task
class Dtm(_Choice):
    name, version, chance, breakdown = "dtm", "2.1", 0.25, ("subject",)
    columns = dict.fromkeys(("id", "question", "option_A", "option_B", "option_C", "option_D", "subject"), "string")

    def shaped(self, rows: DataFrame) -> DataFrame:
        rows = super().shaped(rows)
        return rows if {"answer", "correct_answer"} & set(rows.columns) else rows.withColumn("answer", F.lit(None).cast("string"))

    def problems(self, rows: DataFrame) -> DataFrame:
        options, gold = items.dtm_choice(rows, self.options.get("strict", False))
        return validators.shown_choice_problems(rows, _row_id("id"), options, gold)

    def items(self, rows: DataFrame) -> DataFrame:
        return self.permuted(items.dtm_items(rows, self.options.get("strict", False)))


@register_task
class MmluPro(_Choice):
    name, version, chance, max_tokens, breakdown = "mmlu_pro_uz", "2.1", 0.1, 4096, ("category",)
    columns = dict.fromkeys(("question_id", "question", "question_uzb", "options", "options_uzb", "answer_index", "answer", "category"), "string")

    def shaped(self, rows: DataFrame) -> DataFrame:
        rows = super().shaped(rows)
        lists = {c: F.to_json(c) for c in ("options", "options_uzb") if rows.schema[c].dataType.typeName() == "array"}
        return rows.withColumns(lists)

    def problems(self, rows: DataFrame) -> DataFrame:
        options, gold = items.mmlu_choice()
        own = validators.shown_choice_problems(rows, _row_id("question_id"), options, gold)
        return own.unionByName(validators.translated_problems(rows, _row_id("question_id")))

    def items(self, rows: DataFrame) -> DataFrame:
        return self.permuted(items.mmlu_items(rows))


@register_task
class Reasoning(EvalTask):
    name, version, chance, max_tokens, breakdown = "reasoning", "2.0", 0.156, 4096, ("kind",)
    columns = dict.fromkeys(("question_id", "task", "ground_truth", "ground_truth_uzbek"), "string") | dict.fromkeys(("turns", "turns_in_uzbek"), "array<string>")

    def problems(self, rows: DataFrame) -> DataFrame:
        return validators.reasoning_problems(rows, F.left(_row_id("question_id"), F.lit(12)))

    def items(self, rows: DataFrame) -> DataFrame:
        return items.reasoning_items(rows)

    def prompt(self) -> Column:
        return F.col("question")

    def parse(self, response: Column) -> Column:
        return extract.extract_reasoning(response, F.col("kind"), F.col("gold"))

    def score(self, extraction: Column) -> Column:
        from .functions.text import match_key_lower

        return score.reasoning_score(extraction["value"], F.col("gold"), F.col("kind"), match_key_lower)


@register_task
class Translation(EvalTask):
    """Corpus chrF++ over all segments with an interval by resampling segments; by direction, and their mean."""

    name, version, breakdown = "translation", "2.0", ("direction",)
    columns = dict.fromkeys(("id", "split"), "string")
    # Words before a translation.
    PREFIXES = ("Tarjima", "Translation", "Перевод")

    def __init__(self, seed: int = 0, **options):
        super().__init__(seed, **options)
        self.directions = tuple(options.get("directions", ("uz_en", "en_uz", "uz_ru", "ru_uz")))
        self.samples = int(options.get("bootstrap_samples", 500))

    def items(self, rows: DataFrame) -> DataFrame:
        return items.translation_items(rows, self.directions, tuple(self.options.get("eval_splits", ("devtest", "test"))))

    def problems(self, rows: DataFrame) -> DataFrame:
        return validators.translation_problems(rows, _row_id("id"), self.directions)

    def prompt(self) -> Column:
        return items.translation_prompt(F.col("direction"), F.col("source"))

    def parse(self, response: Column) -> Column:
        return extract.extract_last_line(response, self.PREFIXES)

    def scored(self, told: DataFrame) -> DataFrame:
        """The statistics of each segment, counted once, as `stats`; its own chrF++, a hundredth of it, as `score`."""
        hyp, ref = F.coalesce("extracted", F.lit("")), F.coalesce(F.col("gold").cast("string"), F.lit(""))
        shown = told.withColumn("hyp", normalize(hyp)).withColumn("ref", normalize(ref))
        counted = F.concat(mt.chrf_segment(F.col("hyp"), F.col("ref")), mt.bleu_segment(F.col("hyp"), F.col("ref")))
        shown = shown.select("*", F.explode(F.array(counted)).alias("stats"))
        own = F.when(F.col("fine"), stats.py_round(mt.sentence_score(F.col("stats")) / 100.0, 4)).otherwise(0.0)
        return shown.withColumn("score", own).withColumn("cyrillic", F.when(cyrillic_ratio(F.col("hyp")) > 0.5, 1.0).otherwise(0.0)).drop("ref")

    def scores(self, results: DataFrame) -> DataFrame:
        """whole, direction, chrf, bleu, segments: one pass over the statistics of scorable rows, unrounded."""
        return mt.grouped_scores(results.where(extract.scorable(F.col("status"))).select("direction", "stats"), "direction")

    def interval(self, results: DataFrame) -> DataFrame:
        """low, high: 95 % of the resamples' scores, which are rounded before they are put in order."""
        place = F.col("ord") * len(self.directions) + F.array_position(F.array(*[F.lit(x) for x in self.directions]), F.col("direction")) - 1
        segments = results.where(extract.scorable(F.col("status"))).select(place.alias("seg"), "stats")
        return metrics.segment_interval(segments, self.samples)

    def measured(self, results: DataFrame) -> DataFrame:
        two = lambda c: stats.py_round(F.col(c), 2)
        by = self.scores(results).select("whole", "direction", two("chrf").alias("chrf2pp"), two("bleu").alias("bleu"), "segments")
        cyrillic = results.where(extract.scorable(F.col("status"))).groupBy().agg(stats.py_round(F.avg("cyrillic"), 4).alias("cyrillic_output_rate"))
        part = F.struct("direction", "chrf2pp", "bleu", "segments")
        # a row for each direction
        told = by.groupBy().agg(
            F.max(F.when(F.col("whole") == 1, F.col("chrf2pp"))).alias("primary"), F.max(F.when(F.col("whole") == 1, F.col("bleu"))).alias("bleu"), F.max(F.when(F.col("whole") == 1, F.col("segments"))).alias("n"),
            F.avg(F.when(F.col("whole") == 0, F.col("chrf2pp"))).alias("macro"), F.array_sort(F.collect_list(F.when(F.col("whole") == 0, part))).alias("by_direction"),
        )
        ends = self.interval(results) if self.samples else results.sparkSession.createDataFrame([(None, None)], "low double, high double")
        met = told.join(F.broadcast(ends)).join(F.broadcast(cyrillic))
        some = F.coalesce("n", F.lit(0))
        return met.select(
            F.coalesce("primary", F.lit(0.0)).alias("primary"), stats.py_round(F.col("low"), 2).alias("ci_low"), stats.py_round(F.col("high"), 2).alias("ci_high"), some.cast("bigint").alias("n"),
            F.struct(
                F.col("primary").alias("chrf2pp"), stats.py_round(F.col("macro"), 2).alias("chrf2pp_macro"), F.lit(mt.CHRF_SIGNATURE).alias("chrf2pp_signature"), "bleu", F.lit(mt.BLEU_SIGNATURE).alias("bleu_signature"),
                "cyrillic_output_rate", "by_direction", F.lit(f"segment bootstrap, {self.samples} resamples" if self.samples else "none").alias("ci_method"),
            ).alias("told"),
        )


RIDDLES = dict.fromkeys(("id", "riddle", "answer", "theme", "difficulty"), "string") | dict.fromkeys(("accepted", "distractors"), "array<string>")


@register_task
class Riddle(EvalTask):
    name, version, max_tokens, breakdown = "zarbulmasal", "1.0", 256, ("theme", "difficulty")
    columns = RIDDLES

    def problems(self, rows: DataFrame) -> DataFrame:
        return validators.riddle_problems(rows)

    def items(self, rows: DataFrame) -> DataFrame:
        return items.riddle_items(rows)

    def prompt(self) -> Column:
        return items.riddle_prompt(F.col("riddle"))

    def parse(self, response: Column) -> Column:
        return extract.extract_last_line(response, ("Javob", "Answer"))

    def score(self, extraction: Column) -> Column:
        return score.matches(extraction["value"], F.col("gold_keys")).cast("double")


@register_task
class RiddleChoice(_Choice):
    name, version, chance, max_tokens, breakdown = "zarbulmasal_mc", "1.0", 0.25, 256, ("theme", "difficulty")
    columns = RIDDLES

    def problems(self, rows: DataFrame) -> DataFrame:
        return validators.riddle_problems(rows)

    def items(self, rows: DataFrame) -> DataFrame:
        return items.permute_hashed(items.riddle_choice_items(rows), self.seed) if self.options.get("shuffle", "hashed") == "hashed" else items.permute_seeded(items.riddle_choice_items(rows), self.seed)

    def prompt(self) -> Column:
        return items.riddle_prompt(F.col("riddle"), F.col("options"))


@register_task
class Instructions(EvalTask):
    """Prompts with constraints that the response has to keep. A prompt counts if all its constraints that can be judged are kept."""

    name, version, max_tokens = "ifeval_uz", "2.0", 2048
    columns = dict.fromkeys(("key", "prompt", "prompt_uz"), "string") | {"instruction_id_list": "array<string>"}
    variants = ("kwargs", "kwargs_uz")
    #: Judged constraints from which an instruction's own rates are published.
    LEAST = 15

    def items(self, rows: DataFrame) -> DataFrame:
        return items.constraint_items(rows)

    def problems(self, rows: DataFrame) -> DataFrame:
        return validators.constraint_problems(rows)

    def how(self) -> tuple[bool, float]:
        return self.options.get("score_recalibrated", True), float(self.options.get("word_count_factor", 1.0))

    def judged(self, constraints: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
        """item_id, at, name, outcome, strict, loose, reason of constraints (item_id, at, name, kw, localised, response)."""
        return evaluate(constraints, *self.how(), self.options.get("detector"), names)

    def scored(self, told: DataFrame) -> DataFrame:
        """told with `judged`, an array of the constraints' outcomes, and `score`."""
        if self.options.get("detector") is None:
            # in the item's own row, and generated as in results()
            made = with_judged(told.withColumn("response", F.when(F.col("fine"), F.col("extracted"))), *self.how())
            one = F.when(F.col("fine"), F.array_sort("judged"))
            met = made.select("*", F.explode(F.array(F.struct(one.alias("judged")))).alias("j")).withColumn("judged", F.col("j.judged")).drop("j", "response")
        else:
            each = told.where("fine").select("item_id", F.col("extracted").alias("response"), "constraints")
            by_item = self.judged(each).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "outcome", "strict", "loose", "reason"))).alias("judged"))
            met = told.join(by_item, "item_id", "left")
        counted = F.filter("judged", lambda x: x["outcome"] != "excluded")
        kept = (F.size(counted) > 0) & F.forall(counted, lambda x: x["strict"])
        return met.withColumn("score", F.when(F.col("fine") & F.coalesce(kept, F.lit(False)), 1.0).otherwise(0.0))

    def constraints(self, results: DataFrame) -> DataFrame:
        """A row for each constraint of scorable responses."""
        return results.where(extract.scorable(F.col("status"))).select("item_id", F.inline("judged"))

    def measured(self, results: DataFrame) -> DataFrame:
        each = self.constraints(results)
        whole = _published(metrics.constraint_summary(each), "prompt_strict")
        types = metrics.by_instruction(each, self.LEAST).groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "n", stats.py_round(F.col("strict"), 1).alias("strict"), stats.py_round(F.col("loose"), 1).alias("loose")))).alias("by_instruction_type"))
        reasons = metrics.exclusion_reasons(each).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason"))).alias("x"))
        met = whole.join(F.broadcast(types)).join(F.broadcast(reasons))
        two = lambda c: stats.py_round(F.col(c), 2).alias(c)
        return met.select(
            "primary", "ci_low", "ci_high", "n",
            F.struct(
                two("prompt_strict"), two("prompt_loose"), two("inst_strict"), two("inst_loose"), F.coalesce("constraints_evaluated", F.lit(0)).alias("constraints_evaluated"),
                F.coalesce("constraints_excluded", F.lit(0)).alias("constraints_excluded"), stats.py_round(F.col("coverage_percent") / 100, 4).alias("constraint_coverage"),
                F.transform("x", lambda r: F.struct(r["reason"].alias("reason"), (-r["less"]).alias("n"))).alias("exclusion_reasons"), "by_instruction_type",
            ).alias("told"),
        )
