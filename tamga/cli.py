"""list, validate, run, rescore, report, show: thin wrappers of the DataFrame functions.

A run folder holds one folder of records per task (JSON lines) and manifest.json.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.text import slug_of
from .operators import board, records
from .registry import TASKS, get_task
from .sources import config, readers
from .sources import endpoints  # noqa: F401  registers its providers
from .sources.providers import PROVIDERS, get_provider, run_items
from .sources.schemas import RECORD


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def commit(folder: str = ".") -> str:
    """The checked-out commit, marked if files differ from it; `unknown` outside a checkout."""
    said = [subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10) for args in (["rev-parse", "HEAD"], ["status", "--porcelain"])]
    return said[0].stdout.strip() + ("-dirty" if said[1].stdout.strip() else "") if said[0].returncode == 0 else "unknown"


def _save(path: str, manifest: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=1)
    os.replace(path + ".new", path)


def _plain(x):
    """A Row and what it holds as JSON has it."""
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _told(told: dict) -> dict:
    """Lists of a name and its numbers as objects by name."""
    named = {"by_direction": "direction", "by_instruction_type": "name"}
    told = {k: {r.pop(named[k]): r for r in v} if k in named else v for k, v in told.items()}
    if "exclusion_reasons" in told:
        told["exclusion_reasons"] = {r["reason"]: r["n"] for r in told["exclusion_reasons"]}
    return told


def _entry(task, results: DataFrame, dataset: readers.Dataset, cfg: config.TaskConfig) -> dict:
    """The manifest entry of one task."""
    results = results.persist()
    s = task.summary(results).first().asDict()
    rates = {k: round(v or 0.0, 4) for k, v in s.items() if k.endswith("_rate") or k == "coverage"}
    by = task.broken_down(results)
    breakdown: dict = {}
    for r in by.collect() if by is not None else ():
        breakdown.setdefault(r["key"], {})[r["value"]] = {"accuracy": round(r["accuracy"], 2), "ci_low": round(r["ci_low"], 2), "ci_high": round(r["ci_high"], 2), "n": r["n"], "correct": round(r["correct"], 2)}
    results.unpersist()
    return {
        "task_version": task.version, "dataset": dataset.id, "dataset_sha256": dataset.sha256, "options": cfg.options, "n_items": s["n_items"], "n_scored": s["n_scored"],
        "metrics": {k: s[k] for k in ("primary", "ci_low", "ci_high", "n")} | _told(_plain(s["told"])), "diagnostics": rates | {"at_or_below_chance": bool(s["at_or_below_chance"])}, "breakdown": breakdown,
    }


def _dataset(spark: SparkSession, cfg: config.TaskConfig, task, roots: tuple[str, ...]) -> tuple[readers.Dataset, DataFrame]:
    """A task's dataset, and its rows numbered and with all columns that the task may read."""
    from .operators.items import numbered

    data = readers.load(spark, cfg.dataset, roots, cfg.dataset_revision or "", task.variants, cfg.split, cfg.dataset_config)
    return data, task.shaped(data.rows if data.placed else numbered(data.rows))


def run_task(spark: SparkSession, cfg: config.TaskConfig, model: config.ModelConfig, folder: str, roots: tuple[str, ...] = (), limit: int = 0, every: int = 1000) -> dict:
    """Ask for what has no good record yet, append the records, score the latest ones; a second call asks only for failures.

    Answers are committed for `every` items at a time, so a run that is killed loses no more than those under way.
    """
    task = get_task(cfg.task)(seed=cfg.seed, **cfg.options)
    from .operators.items import limited

    data, rows = _dataset(spark, cfg, task, roots)
    made = task.items(rows).withColumn("prompt", task.prompt())
    made = (limited(made, limit) if limit else made).cache()
    log = os.path.join(folder, cfg.task)
    old = readers.read_records(spark, log) if os.path.isdir(log) else spark.createDataFrame([], RECORD).withColumn("ord", F.lit(0).cast("bigint"))
    todo = records.pending(made, records.latest_non_error(old)).withColumn("part", F.floor(F.col("ord") / every)).cache()
    chosen = config.settings(cfg, model)
    provider = get_provider(model.provider).configured(model, chosen)
    tokens = config.budget(cfg, model, task.max_tokens)
    for part in sorted(r["part"] for r in todo.select("part").distinct().collect()):
        _asked(todo.where(F.col("part") == part), provider, tokens, chosen["concurrency"]).write.mode("append").json(log)
    todo.unpersist()
    return _entry(task, _scored(spark, task, made, log), data, cfg) | provider.described(chosen["reasoning"])


def _asked(items, provider, tokens: int, concurrency: int) -> DataFrame:
    """Records of items that were put to a model."""
    got = run_items(items, provider, tokens, concurrency)
    return got.join(items.select("item_id", "prompt"), "item_id").select("item_id", "prompt", F.col("text").alias("response"), F.when(F.col("error").isNotNull(), "error").otherwise("ok").alias("status"), "finish_reason", "prompt_tokens", "completion_tokens", "latency_s", "error")


def _manifest(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def run_model(spark: SparkSession, tasks: dict[str, config.TaskConfig], model: config.ModelConfig, folder: str, run_id: str, roots: tuple[str, ...] = (), limit: int = 0) -> dict:
    """All tasks with one model; the manifest is written anew after each of them."""
    path = f"{folder}/manifest.json"
    manifest = {
        "run_id": run_id, "model": model.name, "provider": model.provider, "license": model.license, "organization": model.organization, "weights_url": model.weights_url,
        "quantization": model.quantization, "temperature": model.temperature, "reasoning": model.reasoning, "started_at": now(), "finished_at": "", "harness_version": __version__,
        "harness_git_sha": commit(), "tasks": {},
    } | _manifest(path)
    for name, cfg in tasks.items():
        try:
            manifest["tasks"][name] = run_task(spark, cfg, model, folder, roots, limit)
        except Exception as e:  # noqa: BLE001  a task that fails leaves the others alone
            manifest["tasks"][name] = {"error": f"{type(e).__name__}: {e}"[:500]}
        _save(path, manifest | {"finished_at": now()})
    return manifest


def _scored(spark, task, made: DataFrame, log: str, rescoring: bool = False) -> DataFrame:
    last = records.latest(readers.read_records(spark, log)).select("item_id", F.col("response").alias("text"), "finish_reason", F.when(F.col("status") == "error", F.coalesce("error", F.lit("failed"))).alias("error"))
    return task.results(made.withColumn("item_id", F.col("item_id").cast("string")), last, rescoring)


def rescore_task(spark: SparkSession, cfg: config.TaskConfig, folder: str, roots: tuple[str, ...] = ()) -> dict:
    task = get_task(cfg.task)(seed=cfg.seed, **cfg.options)
    data, rows = _dataset(spark, cfg, task, roots)
    return _entry(task, _scored(spark, task, task.items(rows), os.path.join(folder, cfg.task), True), data, cfg)


def validate(spark: SparkSession, cfg: config.TaskConfig, roots: tuple[str, ...] = (), limit: int = 10) -> tuple[list[str], bool]:
    """Lines about a dataset and its first problems; whether it is clean. Rows are judged as they are, not the items made of them."""
    task = get_task(cfg.task)(seed=cfg.seed, **cfg.options)
    try:
        data, rows = _dataset(spark, cfg, task, roots)
    except Exception as e:  # noqa: BLE001  a dataset that can't be read is a problem of its own
        return [f"{cfg.task}: {type(e).__name__}: {e}"[:500]], False
    problems = task.problems(rows).persist()
    n = problems.count()
    lines = [f"{cfg.task}: {rows.count()} rows, {task.items(rows).count()} items, sha256 {data.sha256[:12]}, {n} problems"]
    lines += [f"  row {r['row_id']}: {r['problem']}" for r in problems.orderBy("row_id", "problem").limit(limit).collect()]
    problems.unpersist()
    return lines + ([f"  and {n - limit} more"] if n > limit else []), not n


def report(spark: SparkSession, folder: str, suite: config.SuiteConfig, tasks: dict[str, config.TaskConfig]) -> DataFrame:
    """rank, model and the row as JSON, from all manifests under folder."""
    runs = board.latest_runs(readers.read_runs(spark, folder), suite.tasks)
    scores = readers.run_cells(runs).where(F.col("task").isin(*suite.tasks))
    chances = spark.createDataFrame([(t, float(get_task(tasks[t].task).chance)) for t in suite.tasks], "task string, chance double")
    cells = board.cells(runs, scores, chances)
    ranked = board.ranked(board.composites(cells, suite.require_complete), runs)
    return board.document(ranked, cells, board.ties(ranked, cells), board.run_details(runs, suite.tasks))


def published(rows: list[str], suite: config.SuiteConfig, tasks: dict[str, config.TaskConfig]) -> dict:
    """The whole board: what the suite is, its tasks, how to read it, and the models' rows."""
    notes = {
        "composite": "Mean of the tasks' scores, each rescaled so that its random baseline is 0. Only models with all tasks of the suite have one.",
        "intervals": "95 % intervals. Models whose intervals overlap on every task that both have are told as tied.",
        "coverage": f"A cell of which less than {board.PROVISIONAL:.0%} could be scored is provisional, below {board.PUBLISH:.0%} it is withheld; answers that could not be read are reported apart.",
    }
    if not rows:
        notes["status"] = "No model has been run on this suite yet."
    about = [{"id": t, "chance": round(get_task(tasks[t].task).chance * 100, 1), "version": get_task(tasks[t].task).version} for t in suite.tasks]
    return {"suite": suite.name, "suiteDescription": suite.description.strip(), "generatedAt": now(), "tasks": about, "notes": notes, "models": [json.loads(x) for x in rows]}


def summary_lines(manifest: dict) -> list[str]:
    out = [f"run {manifest.get('run_id')}, model {manifest.get('model')}, started {manifest.get('started_at')}"]
    for name, e in (manifest.get("tasks") or {}).items():
        m, d = e.get("metrics", {}), e.get("diagnostics", {})
        out.append(f"  {name}: failed: {e['error']}" if "error" in e else f"  {name}: {m.get('primary')} [{m.get('ci_low')}, {m.get('ci_high')}], {e.get('n_scored')} of {e.get('n_items')} scored, coverage {d.get('coverage', 1.0):.2f}")
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tamga")
    p.add_argument("verb", choices=("list", "validate", "run", "rescore", "report", "show"))
    p.add_argument("--configs", default="configs")
    p.add_argument("--data", default="data")
    p.add_argument("--runs", default="runs")
    p.add_argument("--suite")
    p.add_argument("--model")
    p.add_argument("--run-id")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--out", help="file for the whole board as JSON")
    a = p.parse_args(args)
    if a.verb == "list":
        print("tasks:", *sorted(TASKS), "\nproviders:", *sorted(PROVIDERS), "\nsuites:", *config.listed(f"{a.configs}/suites"))
        return 0
    if a.verb == "show":
        with open(f"{a.runs}/{a.run_id}/manifest.json", encoding="utf-8") as f:
            print("\n".join(summary_lines(json.load(f))))
        return 0
    spark = SparkSession.builder.appName("tamga").getOrCreate()
    suite = config.load(config.SuiteConfig, f"{a.configs}/suites", a.suite)
    tasks = {t: config.load(config.TaskConfig, f"{a.configs}/tasks", t) for t in suite.tasks}
    if a.verb == "report":
        rows = [r["row"] for r in report(spark, a.runs, suite, tasks).collect()]  # a row for each model
        if a.out:
            _save(a.out, published(rows, suite, tasks))
        print("\n".join(rows))
        return 0
    if a.verb == "validate":
        clean = True
        for cfg in tasks.values():
            lines, fine = validate(spark, cfg, (a.data,), a.limit or 10)
            print("\n".join(lines))
            clean &= fine
        return int(not clean and a.strict)
    if a.verb == "run":
        # a batch suite lists its models in the order in which they run, the smallest first
        for name in [a.model] if a.model else suite.models:
            run_id = a.run_id if a.model else f"{a.run_id}-{slug_of(name)}"
            run_model(spark, tasks, config.load(config.ModelConfig, f"{a.configs}/models", name), f"{a.runs}/{run_id}", run_id, (a.data,), a.limit)
        return 0
    folder = f"{a.runs}/{a.run_id}"
    path = f"{folder}/manifest.json"
    manifest = _manifest(path)
    for name, cfg in tasks.items():
        if os.path.isdir(os.path.join(folder, cfg.task)):
            manifest.setdefault("tasks", {})[name] = manifest.get("tasks", {}).get(name, {}) | rescore_task(spark, cfg, folder, (a.data,)) | {"rescored_at": now()}
    _save(path, manifest)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
