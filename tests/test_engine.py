"""Items, records, boards, sources, providers, streams and the command line, end to end on small tables."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamga import cli, registry
from tamga.operators import board, items, metrics, records, worklist
from tamga.plans import queries as plans
from tamga.sources import config, providers, readers, writers
from tamga.streaming import limits
from tamga.streaming import records as stream_records

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CHECKED = [k for k in plans.ORACLE if k not in ("stream_latest",)]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    said = con.execute(plans.ORACLE[name])
    names = [c[0] for c in said.description]
    df = plans.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    plain = lambda row: tuple(round(x, 5) if isinstance(x, float) else x for x in row)
    assert sorted((plain(r) for r in df.select(*names).collect()), key=repr) == sorted((plain(r) for r in said.fetchall()), key=repr)


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, item_id string, status string, response string")


def test_records(spark):
    rows = [("a", "ok", "1"), ("b", "error", ""), ("a", "error", ""), ("c", "ok", "2"), ("b", "ok", "3"), ("c", "ok", "4")]
    for parts in (1, 4):
        df = log(spark, rows).repartition(parts)
        assert {r.item_id: (r.status, r.response) for r in records.latest(df).collect()} == {"a": ("error", ""), "b": ("ok", "3"), "c": ("ok", "4")}
        assert {r.item_id: r.response for r in records.latest_non_error(df).collect()} == {"a": "1", "b": "3", "c": "4"}
    wanted = spark.createDataFrame([("a",), ("d",)], "item_id string")
    assert [r.item_id for r in records.pending(wanted, records.latest_non_error(log(spark, rows))).collect()] == ["d"]


def test_items(spark):
    rows = spark.createDataFrame([(i, str(i), f"savol {i}", "bo'lim", "b", "c", "d", k, "fizika") for i, k in enumerate(["A", " b", None, "", "E", "BC"])], "ord bigint, id string, question string, option_A string, option_B string, option_C string, option_D string, answer string, subject string")
    got = items.dtm_items(rows)
    assert [(r.item_id, r.gold) for r in got.orderBy("ord").collect()] == [("0", "A"), ("1", "B"), ("3", "A"), ("5", "B")]
    assert [(r.item_id, r.gold) for r in items.dtm_items(rows, strict=True).orderBy("ord").collect()] == [("0", "A"), ("1", "B")]
    assert got.first().options[0] == "boʻlim"
    import random

    rng, want = random.Random(9), []
    for r in got.orderBy("ord").collect():
        order = list(range(4))
        rng.shuffle(order)
        want.append((r.item_id, [r.options[i] for i in order], "ABCD"[order.index(r.gold_index)]))
    assert [(r.item_id, r.options, r.gold) for r in items.permute_seeded(got, 9).orderBy("ord").collect()] == want
    for r in items.permute_hashed(got, 1).collect():
        assert r.gold == "ABCD"[r.gold_index] and sorted(r.options) == sorted(["boʻlim", "b", "c", "d"])
    assert items.cyclic_variants(got).count() == 16
    assert [r.ord for r in items.numbered(spark.range(100).repartition(7)).orderBy("ord").collect()] == list(range(100))


def test_board(spark):
    runs = spark.createDataFrame([("r1", "m", "2026-01-01", "", "p1", ["dtm"]), ("r2", "m", "2026-01-02", "", "p2", ["riddles"]), ("r3", "n", "", "2026-01-03", "p3", ["dtm"]), ("r4", "n", "2026-01-03", "", "p2", ["dtm"])], "run_id string, model string, finished_at string, started_at string, path string, tasks array<string>")
    assert {r.model: r.run_id for r in board.latest_runs(runs, ["dtm", "x"]).collect()} == {"m": "r1", "n": "r4"}
    scores = spark.createDataFrame([("a", "t", 80.0, 75.0, 85.0, 1.0), ("a", "u", 50.0, 45.0, 55.0, 0.7), ("b", "t", 82.0, 78.0, 86.0, 1.0), ("b", "u", 52.0, 48.0, 56.0, 1.0), ("c", "t", 99.0, 98.0, 99.5, 1.0), ("c", "u", 90.0, 60.0, 99.0, 0.1), ("d", "t", 20.0, 15.0, 25.0, 1.0), ("d", "u", 50.0, 45.0, 55.0, 1.0)], "model string, task string, score double, ci_low double, ci_high double, coverage double")
    cells = board.cells(scores, scores, spark.createDataFrame([("t", 0.25), ("u", 0.0)], "task string, chance double"))
    ranked = board.ranked(board.composites(cells))
    got = {r.model: (r.rank, r.complete, r.missing) for r in ranked.collect()}
    assert got == {"b": (1, True, []), "a": (2, True, []), "d": (3, True, []), "c": (None, False, ["u"])}
    assert {r.model: r.tied_with for r in board.ties(ranked, cells).collect()} == {"a": ["b"], "b": ["a"], "d": [], "c": None}
    doc = board.document(ranked, cells, board.ties(ranked, cells)).collect()
    assert json.loads(doc[0].row)["scores"]["t"]["score"] == 82.0 and doc[-1].model == "c"


def test_sources(spark, tmp_path):
    rows = [{"id": "1", "q": "sa\nlom", "n": "x,y"}, {"id": "2", "q": 'di"k', "n": ""}]
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("a.json", "﻿" + json.dumps({"meta": 1, "rows": rows}, indent=1))
    put("b.json", json.dumps(rows))
    put("c.json", json.dumps(rows[0]))
    put("d.jsonl", "\n\n".join(json.dumps(r) for r in rows) + "\n")
    put("e.csv", '﻿id,q,n\n1,"sa\nlom","x,y"\n2,"di""k",\n')
    put("f.tsv", 'id\tq\tn\n1\t"sa\nlom"\tx,y\n2\t"di""k"\t\n')
    for name, n in (("a.json", 2), ("b.json", 2), ("c.json", 1), ("d.jsonl", 2), ("e.csv", 2), ("f.tsv", 2)):
        got = readers.load(spark, name, (str(tmp_path),))
        assert got.rows.count() == n and len(got.sha256) == 64, name
        assert got.rows.orderBy("id").first().q == "sa\nlom", name
        assert got.rows.dtypes[got.rows.columns.index("id")][1] == "string"
    with pytest.raises(FileNotFoundError):
        readers.resolve("nowhere.json")
    assert readers.resolve("org/name") is None and readers.resolve("s3://x/y.json") is None
    put("g.jsonl", "")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "g.jsonl"))
    with pytest.raises(ValueError):
        readers.get_reader(".xls")
    put("log.jsonl", '{"item_id":"1","status":"ok","extra":1}\n\nnot json\n{"item_id":"2","status":"error"}\n')
    assert [(r.ord, r.item_id) for r in readers.read_records(spark, str(tmp_path / "log.jsonl")).orderBy("ord").collect()] == [(0, "1"), (1, "2")]
    writers.append_records(spark.createDataFrame([("1", "ok")], "item_id string, status string"), str(tmp_path / "out"), "r", "t")
    assert spark.read.json(str(tmp_path / "out")).first().asDict() == {"item_id": "1", "status": "ok", "run_id": "r", "task": "t"}


def test_providers(spark):
    calls = []

    class Flaky(providers.Provider):
        name = "flaky"

        def complete(self, prompt, max_tokens):
            calls.append(prompt)
            if len(calls) < 3:
                raise RuntimeError("429 rate limit")
            return "ha", "stop", 1, 1

    assert Flaky("m", pause=0).generate("x", 5)["text"] == "ha" and len(calls) == 3
    bad = providers.ReplayProvider("m", pause=0, answers={"a": ValueError("no such model"), "b": "ok"})
    got = {r.item_id: (r.text, r.error) for r in providers.run_items(spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "item_id string, prompt string"), bad, requests=2).collect()}
    assert got == {"1": ("", "ValueError: no such model"), "2": ("ok", None), "3": ("", None)}
    with pytest.raises(ValueError):
        providers.register_provider(providers.StubProvider)
    with pytest.raises(KeyError):
        providers.get_provider("none")
    assert providers.probe_decision([("direct", False), ("1024", True)]) == "1024" and providers.probe_decision([]) == "exclude"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 3, "ok")], "item_id string, ord bigint, status string")
    rows.where("ord < 3").write.mode("append").json(str(tmp_path / "in"))
    source = stream_records.stream_records(spark, str(tmp_path / "in"), rows.schema)
    put = stream_records.upsert(str(tmp_path / "table"))
    run = lambda: source.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    rows.where("ord = 3").unionByName(spark.createDataFrame([("a", 4, "ok")], rows.schema)).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert {r.item_id: (r.ord, r.status) for r in stream_records.read_upserted(spark, str(tmp_path / "table")).collect()} == {"a": (4, "ok"), "b": (3, "ok")}
    ts = spark.createDataFrame([("k", i, i) for i in (0, 10, 20, 30, 3601, 3700)], "key string, event_id bigint, s int").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    assert {r.event_id: r.ok for r in limits.accepted(ts, 2).collect()} == {0: True, 10: True, 20: False, 30: False, 3601: True, 3700: True}


def test_upsert_by_buckets(spark, tmp_path):
    """A batch rewrites the buckets of its keys; repeated and late batches give the same table; two slots a bucket, no more."""
    folder = str(tmp_path / "table")
    put = stream_records.upsert(folder, buckets=8)
    shape = "item_id string, ord bigint, status string"
    batches = [[(f"k{i}", i, "first") for i in range(100)], [("k1", 200, "second"), ("new", 201, "second")], [("k1", 150, "late"), ("k2", 300, "third")], [(f"k{i}", 400 + i, "fourth") for i in range(0, 100, 3)]]
    want, files = {}, lambda: {p.relative_to(folder).parent: (p.name, p.stat().st_mtime_ns) for p in (tmp_path / "table").rglob("*.parquet")}
    for epoch, rows in enumerate(batches):
        before = files() if epoch else {}
        df = spark.createDataFrame(rows, shape)
        put(df, epoch)
        for key, n, status in rows:
            if key not in want or want[key][0] < n:
                want[key] = (n, status)
        table = lambda: {r.item_id: (r.ord, r.status) for r in stream_records.read_upserted(spark, folder).collect()}
        assert table() == want
        put(df, epoch)
        assert table() == want
        if epoch == 1:
            changed = {p.parts[0] for p, x in files().items() if before.get(p) != x}
            assert len(changed) <= 2
    assert len(files()) <= 16 and stream_records.read_upserted(spark, folder).columns == ["item_id", "ord", "status"]
    put(spark.createDataFrame([], shape), 9)
    assert stream_records.read_upserted(spark, folder).count() == len(want)


def test_worklist(spark):
    rows = spark.createDataFrame([("1", 0, 0, "keywords:existence", {"keywords": ["slow", "kid"]}, False, "p"), ("1", 0, 1, "punctuation:no_comma", {}, False, "p"), ("2", 1, 0, "keywords:frequency", {"keyword": ["x"]}, True, "p")], "item_id string, ord bigint, at int, name string, kw map<string,array<string>>, localised boolean, prompt string")
    missing = worklist.missing(rows)
    assert [(r.key, r["index"], r.en) for r in missing.collect()] == [("1", "0.0", "slow"), ("1", "0.1", "kid")]
    for said, want in ((["sekin", "bola"], [["sekin", "bola"]]), (["sekin", " "], [])):
        filled = spark.createDataFrame([("1", "keywords:existence", "keywords", f"0.{i}", x) for i, x in enumerate(said)], "key string, constraint string, kwarg string, index string, uz string")
        assert [r.terms for r in worklist.merged(filled, spark.createDataFrame([("1", 0, "keywords", 2)], "key string, i int, kwarg string, expected int")).collect()] == want
    full = rows.select("item_id", "at", "name", "kw", F.create_map().cast("map<string,array<string>>").alias("local"), F.lit("like kid, don't use \"slow\", \"kid\"").alias("prompt_en"), F.lit('"sekin", "bola" bilan').alias("prompt_uz"))
    assert [r.terms for r in worklist.localised(full.where("item_id = '1'")).collect()] == [["sekin", "bola"]]


def test_bootstrap(spark):
    import random

    a, b = [1.0, 0.0, 1.0, 1.0, 0.5], [0.0, 0.0, 1.0, 0.5, 0.5]
    pairs = spark.createDataFrame(list(zip(range(5), a, b)), "ord bigint, a double, b double")
    got = metrics.paired_bootstrap(pairs, 50, 3).first()
    rng, wins = random.Random(3), 0
    for _ in range(50):
        wins += sum(a[i] - b[i] for i in [rng.randrange(5) for _ in range(5)]) > 0
    assert got.p_value == pytest.approx(1 - wins / 50) and got.delta == pytest.approx(30)
    same = metrics.paired(pairs.select(F.col("ord").alias("item_id"), F.col("a").alias("score")), pairs.limit(3).select(F.col("ord").alias("item_id"), F.col("b").alias("score")))
    with pytest.raises(Exception, match="same items"):
        same.collect()


def test_command_line(spark, tmp_path, capsys):
    for sub in ("suites", "tasks", "models"):
        (tmp_path / "configs" / sub).mkdir(parents=True)
    (tmp_path / "configs/suites/core.yaml").write_text("tasks: [dtm]\n")
    (tmp_path / "configs/tasks/dtm.yaml").write_text("dataset: dtm.json\noptions: {shuffle: seeded}\n")
    (tmp_path / "configs/models/stub.yaml").write_text("model: s\nprovider: stub\nreasoning: off\n")
    rows = [{"id": i, "question": f"q{i}", "option_A": "1", "option_B": "2", "option_C": "3", "option_D": "4", "answer": "ABCD"[i % 4], "subject": "x"} for i in range(12)]
    (tmp_path / "dtm.json").write_text(json.dumps(rows))
    base = ["--configs", str(tmp_path / "configs"), "--data", str(tmp_path), "--runs", str(tmp_path / "runs"), "--suite", "core", "--run-id", "one"]
    assert config.load(config.ModelConfig, str(tmp_path / "configs/models"), "stub").reasoning == "off"
    assert cli.main(["validate", *base, "--strict"]) == 0
    assert cli.main(["run", *base, "--model", "stub"]) == 0
    first = json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["dtm"]
    assert first["n_items"] == first["n_scored"] == 12
    assert cli.main(["run", *base, "--model", "stub"]) == 0  # all done: nothing is asked again
    assert len([x for f in (tmp_path / "runs/one/dtm").glob("*.json") for x in f.read_text().splitlines()]) == 12
    assert cli.main(["rescore", *base]) == 0
    again = json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["dtm"]
    assert again["metrics"] == first["metrics"]
    capsys.readouterr()
    assert cli.main(["report", *base]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rank"] == 1
    assert cli.main(["show", *base]) == 0 and "dtm" in capsys.readouterr().out
    assert cli.main(["list", *base]) == 0 and "zarbulmasal_mc" in capsys.readouterr().out


def test_registry():
    with pytest.raises(ValueError):
        registry.register_task(registry.Dtm)
    with pytest.raises(KeyError):
        registry.get_task("none")
    with pytest.raises(ValueError):
        registry.register_task(type("X", (registry.EvalTask,), {"name": "x"}))


def test_board_document(spark):
    runs = spark.createDataFrame(
        [("r1", "a", "2026-01-01", "", "p1", ["t", "u"], {"t": '{"reasoning": "off"}', "u": "{}"}, "Org", "MIT", "", "Q4", "on", "0.2", "abcdef0123456789", 0.0), ("r2", "b", "2026-01-02T05", "", "p2", ["t"], {"t": "{}"}, None, None, None, None, None, None, None, None)],
        "run_id string, model string, finished_at string, started_at string, path string, tasks array<string>, cells map<string,string>, organization string, license string, weights_url string, quantization string, reasoning string, harness_version string, harness_git_sha string, temperature double",
    )
    runs = board.latest_runs(runs, ["t", "u"])
    scores = spark.createDataFrame([("a", "t", 80.0, 75.0, 85.0, 1.0, 40, 40), ("a", "u", 50.0, 45.0, 55.0, 0.7, 28, 40), ("b", "t", 80.0, 75.0, 85.0, 1.0, 40, 40), ("b", "u", 50.0, 45.0, 55.0, 0.33333, 13, 40)], "model string, task string, score double, ci_low double, ci_high double, coverage double, n_scored bigint, n_items bigint")
    cells = board.cells(scores, scores, spark.createDataFrame([("t", 0.25), ("u", 0.0)], "task string, chance double"))
    told = board.composites(cells, require_complete=False)
    assert [r.model for r in board.ranked(board.composites(cells.where("task = 't'"))).orderBy("rank").collect()] == ["a", "b"]
    assert [r.model for r in board.ranked(board.composites(cells.where("task = 't'")), runs).orderBy("rank").collect()] == ["b", "a"]  # equal: the newer run
    ranked = board.ranked(told, runs)
    rows = {r.model: json.loads(r.row) for r in board.document(ranked, cells, board.ties(ranked, cells), board.run_details(runs, ["t", "u"])).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["organization"], a["license"], a["openWeights"], a["quantization"], a["runId"], a["runDate"]) == ("Org", "MIT", True, "Q4", "r1", "2026-01-01")
    assert a["reasoning"] == {"label": "mixed", "byTask": {"t": "off", "u": "on"}} and a["harnessCommit"] == "abcdef012345"
    assert a["scores"]["u"]["provisional"] and a["scores"]["u"]["n"] == 28 and a["scores"]["t"]["chance"] == 25.0 and a["withheld"] == {}
    assert (b["organization"], b["license"], b["openWeights"], b["temperature"], b["runDate"]) == ("Unknown", "unknown", False, None, "2026-01-02")
    assert b["reasoning"] == {"label": "think", "byTask": {"t": "default", "u": "default"}}
    assert b["withheld"] == {"u": 0.3333} and b["missing"] == ["u"] and list(b["scores"]) == ["t"]


def test_batch_and_resume(spark, tmp_path, monkeypatch):
    """A batch runs its models in the order listed; answers that were written before a run died are not asked for again."""
    for sub in ("suites", "tasks", "models"):
        (tmp_path / "configs" / sub).mkdir(parents=True)
    (tmp_path / "configs/suites/batch.yaml").write_text("tasks: [dtm]\nmodels: [small, Big One]\n")
    (tmp_path / "configs/tasks/dtm.yaml").write_text("dataset: dtm.json\n")
    for name in ("small", "Big One"):
        (tmp_path / f"configs/models/{name}.yaml").write_text(f"model: {name}\nprovider: stub\n")
    rows = [{"id": i, "question": f"q{i}", "option_A": "1", "option_B": "2", "option_C": "3", "option_D": "4", "answer": "A", "subject": "x"} for i in range(10)]
    (tmp_path / "dtm.json").write_text(json.dumps(rows))
    base = ["--configs", str(tmp_path / "configs"), "--data", str(tmp_path), "--runs", str(tmp_path / "runs"), "--suite", "batch", "--run-id", "b"]
    assert cli.main(["run", *base]) == 0
    assert sorted(os.listdir(tmp_path / "runs")) == ["b-big-one", "b-small"]
    told = json.loads((tmp_path / "runs/b-small/manifest.json").read_text())
    assert told["harness_version"] and told["tasks"]["dtm"]["reasoning"] == "default"

    cfg, model = config.TaskConfig("dtm", "dtm.json"), config.ModelConfig("s", "stub")
    asked, plain = [], cli._asked

    def dies(part, *more):
        if len(asked) == 2:
            raise RuntimeError("killed")
        asked.append([r.item_id for r in part.orderBy("ord").collect()])
        return plain(part, *more)

    monkeypatch.setattr(cli, "_asked", dies)
    with pytest.raises(RuntimeError):
        cli.run_task(spark, cfg, model, str(tmp_path / "runs/k"), (str(tmp_path),), every=4)
    assert asked == [["0", "1", "2", "3"], ["4", "5", "6", "7"]]
    monkeypatch.setattr(cli, "_asked", lambda part, *more: asked.append([r.item_id for r in part.orderBy("ord").collect()]) or plain(part, *more))
    assert cli.run_task(spark, cfg, model, str(tmp_path / "runs/k"), (str(tmp_path),), every=4)["n_scored"] == 10
    assert asked[2:] == [["8", "9"]]


def test_intervals(spark):
    pairs = spark.createDataFrame([(i, f"bu {i} gap bor edi", "bu gap ham bor edi" if i % 2 else f"bu {i} gap bor edi") for i in range(12)], "seg bigint, hyp string, ref string")
    from tamga.functions import mt

    low, high = metrics.bleu_interval(pairs, 60).first()
    assert 0 < low < mt.corpus_bleu(pairs).first().bleu < high <= 100
    assert metrics.bleu_interval(pairs.limit(1)).first() == (0.0, 0.0)


def test_submissions(spark, tmp_path):
    """Checks, the hourly limit over batches, a repeated batch, a notification that fails."""
    form = "id string, s int, email string, website string, consent boolean, forwarded_for string"
    shape = lambda rows: spark.createDataFrame(rows, form).select("id", F.timestamp_seconds("s").alias("created_at"), F.lit(" n ").alias("name"), "email", F.lit("m").alias("model_name"), F.lit("").alias("company"), F.lit(None).cast("string").alias("notes"), "website", "consent", "forwarded_for")
    one = shape([("a", 0, "a@b.uz", "", True, "1.1.1.1, 9.9.9.9"), ("b", 10, "a@b.uz", None, True, " 1.1.1.1"), ("c", 20, "a@b.uz", "x", True, "2"), ("d", 30, "a@b.uz", "", None, "2"), ("e", 40, "nobody", "", True, "2"), ("f", 50, "a@b.uz", "", True, None)])
    assert {r.id: r.said for r in limits.screened(one).collect()} == {"a": None, "b": None, "c": "robot", "d": "no consent", "e": "invalid address", "f": None}
    told = []

    def notify(rows):
        told.append(rows.count())
        raise RuntimeError("offline")

    folder = str(tmp_path / "submissions")
    put = limits.submission_sink(folder, 2, "salt", notify)
    with pytest.warns(UserWarning, match="offline"):
        put(one, 0)
        put(one, 0)
        put(shape([("g", 60, "a@b.uz", "", True, "1.1.1.1"), ("h", 61, "a@b.uz", "", True, None), ("i", 3605, "a@b.uz", "", True, "1.1.1.1"), ("j", 3606, "a@b.uz", "", True, "1.1.1.1")]), 1)
    stored = spark.read.parquet(folder).collect()
    # g is the third within the hour of a and b; i comes when a is older than an hour, j while b and i still count
    assert sorted(r.id for r in stored) == ["a", "b", "f", "h", "i"] and told == [3, 3, 2]
    assert all(r.name == "n" and r.company is None and len(r.ip_hash) == 64 for r in stored)


@pytest.fixture
def rocksdb(spark):
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, limits.ROCKSDB)
    yield
    spark.conf.set(kind, before)


def test_live_limit(spark, tmp_path, rocksdb):
    """Late and repeated rows over batches of a stream give what the batch form gives, also after a stop between batches."""
    import os
    import random

    rng, shape = random.Random(4), "key string, event_id bigint, us bigint"
    rows = [(rng.choice(["a", "b", "", None]), i, rng.randrange(6 * 3600) * 1_000_000 + rng.randrange(3)) for i in range(240)]
    rows.sort(key=lambda e: e[2] + rng.randrange(9 * 60) * 1_000_000)
    stamped = lambda df: df.select("key", "event_id", F.timestamp_micros("us").alias("ts"))
    want = sorted(map(repr, limits.accepted(stamped(spark.createDataFrame(rows, shape)), 3).collect()))

    def put(some, at):
        spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for p in (tmp_path / "in").glob("*.parquet"):
            if p not in seen:
                seen.add(p)
                os.utime(p, (at, at))  # files are read in order of time

    def run():
        source = stamped(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        limits.accepted_stream(source, 3).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet").awaitTermination()

    seen = set()
    for k in range(4):
        put(rows[60 * k : 60 * k + 60] + rng.sample(rows[: 60 * k + 60], 15), 1_700_000_000 + k)
        if k == 1:
            run()
    # one that comes far too late, one without a time, and the end
    put([("a", 999, 1), ("a", 998, None), ("a", 1000, 0), ("end", 10**6, 10**15)], 1_700_000_009)
    run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(repr(r) for r in got if r.event_id < 998) == want
    assert sorted((r.event_id, r.ok) for r in got if r.event_id >= 998) == [(998, False), (1000, False)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        limits.accepted_stream(spark.readStream.schema("key string, event_id bigint, ts timestamp").parquet(f"{tmp_path}/in"))


def test_live_submissions(spark, tmp_path, rocksdb):
    form = "id string, created_at timestamp, name string, email string, model_name string, company string, notes string, website string, consent boolean, forwarded_for string"
    row = lambda i, s, email="a@b.uz", web="", yes=True, ip="1": (i, s, " n ", email, "m", "", None, web, yes, ip)
    rows = [row("a", 5), row("b", 10), row("c", 20), row("a", 5), row("d", 20, ip="2"), row("e", 30, email="nobody", ip="2"), row("f", 40, web="x", ip="2"), row("g", 3608), row("end", 10**8, ip="3")]
    shape = form.replace("created_at timestamp", "created_at bigint")
    spark.createDataFrame(rows, shape).withColumn("created_at", F.timestamp_seconds("created_at")).write.parquet(f"{tmp_path}/in")
    stream = limits.submissions_stream(spark.readStream.schema(form).parquet(f"{tmp_path}/in"), 2, salt="s")
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("created_at", "id").collect()
    assert [(r.id, r.created_at.minute, r.name, r.company) for r in got] == [("a", 0, "n", None), ("b", 0, "n", None), ("d", 0, "n", None), ("g", 0, "n", None)]
    assert len({r.ip_hash for r in got}) == 2


def test_seeded_orders(spark, monkeypatch):
    """Lists of one size are shuffled in any number; of several sizes on the driver, and beyond the bound that is an error."""
    import random

    shape = "ord bigint, item_id string, options array<string>, gold_index int"
    for sizes in ([3] * 50, [2 + i % 3 for i in range(50)]):
        rows = spark.createDataFrame([(7 * i, str(i), list("abcd")[:n], 0) for i, n in enumerate(sizes)], shape).repartition(5)
        rng, want = random.Random(6), []
        for n in sizes:
            order = list(range(n))
            rng.shuffle(order)
            want.append(["abcd"[i] for i in order])
        assert [r.options for r in items.permute_seeded(rows, 6).orderBy("ord").collect()] == want
    monkeypatch.setattr(items, "MOST_SEEDED", 49)
    with pytest.raises(ValueError, match="permute_hashed"):
        items.permute_seeded(rows)


def test_positions(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i:04}",) for i in range(500)], "seg string").repartition(7)
    assert [r.pos for r in metrics.placed(rows, "seg").orderBy("seg").collect()] == list(range(500))
    numbers = spark.range(120_000).selectExpr("id * 3 AS seg").repartition(5)
    got = metrics.placed(numbers, "seg")
    assert got.where("pos <> seg / 3").count() == 0 and got.count() == 120_000


def test_hashed_sums(spark):
    """Sums by vectors equal those of rows by samples."""
    import hashlib

    rows = [(f"i{i}", f"g{i % 3}", float(i % 7), 1.0) for i in range(3000)]
    got = {(r.g, r.sample): (r.d, r.n) for r in metrics.resampled_hashed(spark.createDataFrame(rows, "item_id string, g string, d double, n double"), ["g"], ["d", "n"], 5, 9).collect()}
    want = {}
    for i, g, d, n in rows:
        for s in range(5):
            u = int(hashlib.md5(f"9|{i}|{s}".encode()).hexdigest()[:8], 16) / 2**32
            k = sum(u >= p for p in metrics.POISSON)
            a, b = want.get((g, s), (0.0, 0.0))
            want[g, s] = (a + k * d, b + k * n)
    assert got == want


def test_manifest_schema(spark):
    from tamga.sources import schemas

    text = json.dumps({"run_id": "r", "model": "m", "temperature": 0.0, "tasks": {"dtm": {"n_items": 3, "metrics": {"primary": 1.5}, "diagnostics": {"coverage": 1.0}}}})
    got = spark.range(1).select(F.from_json(F.lit(text), schemas.MANIFEST).alias("m")).first().m
    assert got.tasks["dtm"].metrics.primary == 1.5 and got.tasks["dtm"].n_items == 3 and got.run_id == "r"
