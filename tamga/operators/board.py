"""Leaderboard: cells, latest run per model, composites, ranks, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import against_chance, py_round

PUBLISH, PROVISIONAL = 0.5, 0.8
# Licences that are not open.
CLOSED = ("unknown", "proprietary", "closed", "")


def published(c: Column) -> Column:
    """A number with two digits, rounded by its binary value as Python does it."""
    return py_round(c, 2)


def latest_runs(runs: DataFrame, suite: list[str]) -> DataFrame:
    """The newest run of each model among those that measured a task of the suite; of equal times the first by path.

    runs: run_id, model, finished_at, started_at, path, tasks (array of names).
    """
    ours = runs.where(F.arrays_overlap("tasks", F.array(*[F.lit(x) for x in suite])))
    when = F.coalesce(F.nullif("finished_at", F.lit("")), F.nullif("started_at", F.lit("")), F.lit(""))
    order = Window.partitionBy("model").orderBy(F.desc("when"), "path")
    return ours.withColumn("when", when).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def cells(models: DataFrame, scores: DataFrame, suite: DataFrame) -> DataFrame:
    """One row per model and task of the suite: state missing, withheld, provisional or published.

    models: model. scores: model, task, score, ci_low, ci_high, coverage. suite: task, chance; it is small by nature. Scores and
    bounds are shown, compared and averaged with two digits, as they are published.
    """
    tasks = F.array(*[F.struct(F.lit(r["task"]).alias("task"), F.lit(float(r["chance"])).alias("chance")) for r in suite.orderBy("task").collect()])
    grid = models.select("model").distinct().withColumn("s", tasks)
    grid = grid.select("model", F.explode("s").alias("s")).select("model", "s.task", "s.chance")
    met = grid.join(scores, ["model", "task"], "left").withColumns({c: published(F.col(c)) for c in ("score", "ci_low", "ci_high")})
    state = F.when(F.col("coverage").isNull(), "missing").when(F.col("coverage") < PUBLISH, "withheld").when(F.col("coverage") < PROVISIONAL, "provisional").otherwise("published")
    return met.withColumn("state", state)


def composites(cells_: DataFrame, require_complete: bool = True) -> DataFrame:
    """model, composite, complete, missing. The composite is the mean of chance-normalised scores."""
    shown = F.col("state").isin("published", "provisional")
    value = F.when(shown, published(against_chance(F.col("score"), F.col("chance"))))
    out = cells_.groupBy("model").agg(published(F.avg(value)).alias("mean"), F.count_if(shown).alias("n"), F.count("*").alias("tasks"), F.array_sort(F.collect_list(F.when(~shown, F.col("task")))).alias("missing"))
    complete = F.col("n") == F.col("tasks")
    return out.select("model", F.when(complete | F.lit(not require_complete), F.col("mean")).alias("composite"), complete.alias("complete"), "missing")


def ranked(composites_: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """rank 1, 2, ... by composite; rows without a composite have no rank. Of equal composites the model with the newer run
    (runs as from latest_runs) goes first, without runs the first by name."""
    met, newer = composites_, []
    if runs is not None:
        met = composites_.join(runs.select("model", F.col("when").alias("__when"), F.col("path").alias("__path")), "model", "left")
        newer = [F.desc_nulls_last("__when"), F.asc_nulls_last("__path")]
    order = Window.partitionBy(F.col("composite").isNull()).orderBy(F.desc("composite"), *newer, "model")
    return met.withColumn("rank", F.when(F.col("composite").isNotNull(), F.row_number().over(order))).drop("__when", "__path")


def ties(ranked_: DataFrame, cells_: DataFrame) -> DataFrame:
    """model, tied_with: ranked models whose intervals overlap on every task that both have, in order of rank."""
    have = cells_.where(F.col("state").isin("published", "provisional")).join(ranked_.where("rank is not null").select("model", "rank"), "model").select("model", "rank", "task", "ci_low", "ci_high")
    other = have.select(*[F.col(c).alias(f"o_{c}") if c != "task" else F.col(c) for c in have.columns])
    apart = (F.col("ci_high") < F.col("o_ci_low")) | (F.col("o_ci_high") < F.col("ci_low"))
    pairs = have.join(other, "task").where("model <> o_model").groupBy("model", "o_model", "o_rank").agg(F.bool_or(F.coalesce(apart, F.lit(False))).alias("apart"))
    tied = pairs.where("not apart").groupBy("model").agg(F.array_sort(F.collect_list(F.struct(F.col("o_rank").alias("r"), F.col("o_model").alias("m")))).alias("x"))
    return ranked_.select("model", "rank").join(tied.select("model", F.col("x.m").alias("tied_with")), "model", "left").withColumn("tied_with", F.when(F.col("rank").isNotNull(), F.coalesce("tied_with", F.array().cast("array<string>"))))


def open_weights(license_: Column) -> Column:
    return ~F.lower(F.coalesce(license_, F.lit("unknown"))).isin(*CLOSED)


def reasoning_label(modes: Column) -> Column:
    """Label of the reasoning modes of a row's tasks."""
    kinds = F.array_distinct(modes)
    return F.when(F.size(kinds) == 0, "unknown").when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "off"), "no-think").when(~F.array_contains(kinds, "off"), "think").otherwise("mixed")


def run_date(finished: Column, started: Column) -> Column:
    return F.left(F.coalesce(F.nullif(finished, F.lit("")), started, F.lit("")), F.lit(10))


def search(board: DataFrame, text: str = "", only_open: bool = False) -> DataFrame:
    """Rows whose model or organisation contains a text, in either case."""
    hit = F.lower("model").contains(text.strip().lower()) | F.lower(F.coalesce("organization", F.lit(""))).contains(text.strip().lower())
    return board.where(hit & (F.col("open_weights") if only_open else F.lit(True)))


def sorted_by(board: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """By any column; missing values at the end either way; ranks stay."""
    return board.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), "model")


def tint(score: Column, chance: Column) -> Column:
    """Share of the headroom above chance, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - chance) / F.greatest(F.lit(100.0) - chance, F.lit(1e-9))))


# Names in the published document, and the columns they come from.
CELL_FIELDS = {
    "score": "score", "ci_low": "ci_low", "ci_high": "ci_high", "n": "n_scored", "n_items": "n_items", "coverage": "coverage", "unparsed_rate": "unparsed_rate",
    "task_version": "task_version", "dataset_sha256": "sha", "at_or_below_chance": "at_or_below_chance",
}
RUN_FIELDS = {
    "organization": "organization", "license": "license", "openWeights": "open_weights", "weightsUrl": "weights_url", "quantization": "quantization", "reasoning": "reasoning",
    "runId": "run_id", "runDate": "run_date", "harnessVersion": "harness_version", "harnessCommit": "harness_commit", "temperature": "temperature", "provenance": "provenance",
}


def run_details(runs: DataFrame, suite: list[str]) -> DataFrame:
    """What a board says about each model's run: one row per run with the columns of RUN_FIELDS and the model. runs as from
    readers.read_runs, one per model. A task without a reasoning mode of its own has the run's."""
    told = lambda c, other="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    own = lambda t: F.get_json_object(F.try_element_at("cells", F.lit(t)), "$.reasoning")
    modes = [F.coalesce(F.nullif(own(t), F.lit("")), told("reasoning", "default")) for t in suite]
    by_task = F.map_from_arrays(F.array(*[F.lit(t) for t in suite]), F.array(*modes))
    return runs.select(
        "model", F.coalesce("organization", F.lit("Unknown")).alias("organization"), F.coalesce("license", F.lit("unknown")).alias("license"), open_weights(F.col("license")).alias("open_weights"),
        told("weights_url").alias("weights_url"), told("quantization").alias("quantization"), F.struct(reasoning_label(F.array(*modes)).alias("label"), by_task.alias("byTask")).alias("reasoning"),
        "run_id", run_date(F.col("finished_at"), F.col("started_at")).alias("run_date"), told("harness_version").alias("harness_version"), F.left(told("harness_git_sha"), F.lit(12)).alias("harness_commit"),
        "temperature", F.lit("organiser-run").alias("provenance"),
    )


def document(ranked_: DataFrame, cells_: DataFrame, ties_: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """One row per model as JSON: its cells by task, what is withheld or missing and, with details (run_details), its run."""
    have = set(cells_.columns)
    cell = F.struct(
        *[F.col(c).alias(name) for name, c in CELL_FIELDS.items() if c in have], py_round(F.col("chance") * 100, 1).alias("chance"), (F.col("state") == "provisional").alias("provisional")
    )
    shown, held = F.col("state").isin("published", "provisional"), F.col("state") == "withheld"
    by_task = lambda use, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(use, F.struct("task", value))), lambda a, b: F.when(a["task"] < b["task"], -1).when(a["task"] > b["task"], 1).otherwise(0)))
    told = cells_.groupBy("model").agg(by_task(shown, cell.alias("cell")).alias("scores"), by_task(held, py_round(F.col("coverage"), 4).alias("coverage")).alias("withheld"))
    out = ranked_.join(told, "model", "left").join(ties_.select("model", "tied_with"), "model", "left")
    fields = []
    if details is not None:
        out = out.join(details, "model", "left")
        fields = [F.col(c).alias(name) for name, c in RUN_FIELDS.items()]
    row = F.struct("model", "rank", *fields, "composite", "complete", "missing", "withheld", "scores", F.col("tied_with").alias("tiedWith"))
    return out.select("rank", "model", F.to_json(row, {"ignoreNullFields": "false"}).alias("row")).orderBy(F.asc_nulls_last("rank"), "model")
