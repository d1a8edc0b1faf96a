"""Tasks with measures of their own through the command line, on files shaped like real ones."""

import json
import random

import pytest

from tamga import cli, registry
from tamga.operators import items
from tamga.sources import config, providers, readers


def folder(tmp_path, tasks, answers=None):
    """Configurations of a suite of these tasks: name -> (rows or file text, options)."""
    for sub in ("suites", "tasks", "models"):
        (tmp_path / "configs" / sub).mkdir(parents=True, exist_ok=True)
    (tmp_path / "configs/suites/core.yaml").write_text(f"tasks: [{', '.join(tasks)}]\ndescription: All of them\n")
    for name, (rows, options) in tasks.items():
        (tmp_path / f"configs/tasks/{name}.yaml").write_text(f"dataset: {name}.json\ntask: {name}\noptions: {json.dumps(options)}\n")
        (tmp_path / f"{name}.json").write_text(rows if isinstance(rows, str) else json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "configs/models/m.yaml").write_text("model: m\nprovider: replay\n" + f"extra_body: {json.dumps({'answers': answers or {}, 'default': 'none of it'}, ensure_ascii=False)}\n", encoding="utf-8")
    return ["--configs", str(tmp_path / "configs"), "--data", str(tmp_path), "--runs", str(tmp_path / "runs"), "--suite", "core", "--run-id", "one"]


def chrf(pairs):
    """Corpus chrF++ by its definition."""
    from collections import Counter

    def words(t):
        out = []
        for w in t.split():
            if len(w) > 1 and w[-1] in "!.,?:;":
                out += [w[:-1], w[-1]]
            else:
                out.append(w)
        return out

    sums = {}
    for hyp, ref in pairs:
        for kind, orders, cut in (("c", 6, lambda t: list("".join(t.split()))), ("w", 2, words)):
            h, r = cut(hyp), cut(ref)
            for n in range(1, orders + 1):
                a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
                s = sums.setdefault((kind, n), [0, 0, 0])
                s[0] += sum(a.values()) if b else 0
                s[1] += sum(b.values())
                s[2] += sum((a & b).values())
    both = [s for s in sums.values() if s[0] and s[1]]
    if not both:
        return 0.0
    p, r = sum(s[2] / s[0] for s in both) / len(both), sum(s[2] / s[1] for s in both) / len(both)
    return 500 * p * r / (4 * p + r) if p + r else 0.0


SENTENCES = [("Bugun havo yaxshi.", "The weather is good today."), ("Men kitob o'qidim.", "I read a book."), ("U maktabga bordi.", "He went to school."), ("Suv sovuq edi!", "The water was cold!"), ("Yo'l uzoq.", "The road is long.")]


def test_translation(spark, tmp_path):
    rows = [{"id": i, "split": "devtest" if i else " Test ", "text_uz": uz, "text_en": en} for i, (uz, en) in enumerate(SENTENCES)] + [{"id": 9, "split": "train", "text_uz": "x", "text_en": "y"}]
    said = {f"Matn: {uz}": en.replace("is", "was") for uz, en in SENTENCES[:4]} | {f"Matn: {en}": "Tarjima: " + uz for uz, en in SENTENCES}
    base = folder(tmp_path, {"translation": (rows, {"directions": ["uz_en", "en_uz"], "bootstrap_samples": 40})}, said)
    assert cli.main(["run", *base, "--model", "m"]) == 0
    entry = json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["translation"]
    fold = lambda t: t.replace("'", "ʻ")
    forth = [(en.replace("is", "was") if i < 4 else "none of it", fold(en)) for i, (uz, en) in enumerate(SENTENCES)]
    back = [(fold(uz), fold(uz)) for uz, _ in SENTENCES]
    pairs = [p for two in zip(forth, back) for p in two]
    rng, scores = random.Random(12345), []
    for _ in range(40):
        scores.append(round(chrf([pairs[rng.randrange(10)] for _ in range(10)]), 2))
    scores.sort()
    m = entry["metrics"]
    assert entry["n_items"] == entry["n_scored"] == m["n"] == 10
    assert m["primary"] == m["chrf2pp"] == round(chrf(pairs), 2) and m["primary"] > 40
    assert (m["ci_low"], m["ci_high"]) == (scores[1], scores[39])
    assert m["by_direction"]["uz_en"]["chrf2pp"] == round(chrf(forth), 2) and m["by_direction"]["en_uz"]["chrf2pp"] == 100.0
    assert m["chrf2pp_macro"] == round((round(chrf(forth), 2) + 100.0) / 2, 2)
    assert m["by_direction"]["en_uz"]["bleu"] > 0 and m["cyrillic_output_rate"] == 0.0 and "nw:2" in m["chrf2pp_signature"]
    own = [round(round(chrf([p]), 10) / 100, 4) for p in back]
    assert entry["breakdown"]["direction"]["en_uz"]["accuracy"] == round(sum(own) / 5 * 100, 2)
    assert cli.main(["rescore", *base]) == 0
    assert json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["translation"]["metrics"] == m


def test_translation_without_answers(spark, tmp_path):
    base = folder(tmp_path, {"translation": ([{"id": 1, "text_uz": "a", "text_en": "b"}], {"directions": ["uz_en"]})}, {"Matn": ""})
    assert cli.main(["run", *base, "--model", "m"]) == 0
    m = json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["translation"]["metrics"]
    assert (m["primary"], m["n"], m["by_direction"]) == (0.0, 0, {})


#: Arguments as files have them: all names on each constraint, most of them null; numbers as floats; a name may hold a text in one
#: row and a list in the next.
NONE = dict.fromkeys(("keywords", "num_words", "relation", "num_bullets", "end_phrase", "forbidden_words", "language"))
PROMPTS = [
    {"key": 1000, "prompt": "Write.", "prompt_uz": "Yozing bir", "instruction_id_list": ["punctuation:no_comma", "length_constraints:number_words"], "kwargs": [NONE, NONE | {"num_words": 3.0, "relation": "at least"}], "kwargs_uz": [{}, {}], "translation_meta": {"attempt": 1}},
    {"key": 1001, "prompt": "Write.", "prompt_uz": "Yozing ikki", "instruction_id_list": ["keywords:existence", "startend:end_checker"], "kwargs": [NONE | {"keywords": ["dog"]}, NONE | {"end_phrase": "bye"}], "kwargs_uz": [{"keywords": ["it", "uy"]}, {"end_phrase": "xayr"}]},
    {"key": 1002, "prompt": "Write.", "prompt_uz": "Yozing uch", "instruction_id_list": ["keywords:existence", "no:such", "punctuation:no_comma"], "kwargs": [NONE | {"keywords": "dog"}, NONE, NONE], "kwargs_uz": [{}, {}, {}]},
    {"key": 1003, "prompt": "Write.", "prompt_uz": "Yozing toʻrt", "instruction_id_list": ["keywords:letter_frequency"], "kwargs": [NONE], "kwargs_uz": None},
    {"key": 1004, "prompt": "", "prompt_uz": None, "instruction_id_list": [], "kwargs": [], "kwargs_uz": []},
    {"key": 1005, "prompt": "Write five", "prompt_uz": "", "instruction_id_list": ["keywords:existence"], "kwargs": [NONE | {"keywords": ["x"]}], "kwargs_uz": [{"keywords": "bitta"}]},
]
REPLIES = {"Yozing bir": "bu uch soʻz", "Yozing ikki": "it va uy.\nXayr", "Yozing uch": "vergul, bor", "Yozing toʻrt": "A", "Write five": "bunda bitta ham"}


def test_instructions(spark, tmp_path):
    base = folder(tmp_path, {"ifeval_uz": (PROMPTS, {})}, REPLIES)
    assert cli.main(["run", *base, "--model", "m"]) == 0
    entry = json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["ifeval_uz"]
    m = entry["metrics"]
    # one record for each prompt; the fourth has nothing that can be judged
    assert entry["n_items"] == entry["n_scored"] == 5
    assert (m["primary"], m["prompt_strict"], m["n"]) == (75.0, 75.0, 4)
    assert (m["inst_strict"], m["constraints_evaluated"], m["constraints_excluded"], m["constraint_coverage"]) == (83.33, 6, 3, 0.6667)
    assert m["exclusion_reasons"] == {"kwargs-not-localised": 1, "not-meaningful-in-uzbek": 1, "unregistered": 1}
    assert m["by_instruction_type"] == {} and m["ci_low"] < 75 < m["ci_high"]
    assert cli.main(["rescore", *base]) == 0
    assert json.loads((tmp_path / "runs/one/manifest.json").read_text())["tasks"]["ifeval_uz"]["metrics"] == m


def test_arguments_of_any_type(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PROMPTS))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in PROMPTS))
    task = registry.Instructions()
    tables = [readers.load(spark, str(tmp_path / f), variants=task.variants).rows for f in ("a.json", "b.jsonl")]
    tables.append(spark.createDataFrame([(str(r["key"]), r["prompt"], r["prompt_uz"], r["instruction_id_list"], json.dumps(r["kwargs"]), json.dumps(r["kwargs_uz"])) for r in PROMPTS], "key string, prompt string, prompt_uz string, instruction_id_list array<string>, kwargs string, kwargs_uz string"))
    want = {("1000", 0): {}, ("1000", 1): {"num_words": [3.0], "relation": ["at least"]}, ("1001", 0): {"keywords": ["it", "uy"]}, ("1001", 1): {"end_phrase": ["xayr"]}, ("1002", 0): {"keywords": ["dog"]}, ("1005", 0): {"keywords": ["bitta"]}}
    for rows in tables:
        got = {(r.item_id, r.at): {k: [float(x) if k == "num_words" else x for x in v] for k, v in r.kw.items()} for r in items.constraint_rows(task.shaped(items.numbered(rows))).collect()}
        assert {k: got[k] for k in want} == want and len(got) == 9
    # structs as Parquet has them
    tables[0].select("key", "instruction_id_list").write.parquet(str(tmp_path / "c.parquet"))
    typed = spark.createDataFrame([("1", ["length_constraints:number_words"], [(7.0, None, ["a"])])], "key string, instruction_id_list array<string>, kwargs array<struct<num_words:double,relation:string,keywords:array<string>>>")
    rows = items.constraint_rows(task.shaped(items.numbered(typed.selectExpr("*", "'p' AS prompt")))).collect()
    assert [(r.name, float(r.kw["num_words"][0]), r.kw["keywords"], len(r.kw)) for r in rows] == [("length_constraints:number_words", 7.0, ["a"], 2)]


BAD = {
    "dtm": [{"id": 1, "question": "q", "option_A": "bo'r", "option_B": "boʻr", "option_C": "c", "option_D": "", "answer": "A", "subject": "x"}, {"id": 2, "question": "q", "option_A": "a", "option_B": "b", "option_C": "c", "option_D": "d", "answer": None, "subject": "x"}],
    "mmlu_pro_uz": [{"question_id": 5, "question": "a long question in English", "question_uzb": "qisqa", "options": ["a", "b", "c"], "options_uzb": "['a' 'b']", "answer_index": 7, "answer": "H", "category": "c"}],
    "reasoning": [{"question_id": "abcdefghijklmnop", "task": "zebra_puzzle", "turns": ["t"], "turns_in_uzbek": ["t"], "ground_truth": "red", "ground_truth_uzbek": "red"}, {"question_id": "2", "task": "spatial", "turns": ["t"], "ground_truth": "x", "ground_truth_uzbek": ""}],
    "translation": [{"id": 3, "text_uz": "a", "text_en": " "}],
    "ifeval_uz": PROMPTS,
    "zarbulmasal": [{"id": "r1", "riddle": "Osmonda osmon", "answer": "osmon", "accepted": ["osmon"], "distractors": ["yer", "Osmon"]}, {"id": "r2", "riddle": " ", "answer": ""}],
}
FOUND = {
    "dtm": {("1", "duplicate option text"), ("1", "empty option text"), ("2", "missing or invalid answer key")},
    "mmlu_pro_uz": {("5", "answer index 7 out of 2"), ("5", "option counts differ"), ("5", "translation much shorter than the original")},
    "reasoning": {("abcdefghijkl", "ground truth not translated"), ("2", "no Uzbek ground truth")},
    "translation": {("3", "missing text_en, text_ru")},
    "ifeval_uz": {("1004", "no Uzbek prompt"), ("1005", "no Uzbek prompt"), ("no:such", "1 constraints with an unregistered id"), ("keywords:existence", "1 constraints without local arguments")},
    "zarbulmasal": {("r1", "answer in the riddle: osmon"), ("r1", "distractor is an answer: Osmon"), ("r2", "no riddle text"), ("r2", "no accepted answer")},
}


@pytest.mark.parametrize("name", list(BAD))
def test_validate_judges_rows(spark, tmp_path, capsys, name):
    base = folder(tmp_path, {name: (BAD[name], {})})
    task = registry.get_task(name)()
    rows = task.shaped(items.numbered(readers.load(spark, f"{name}.json", (str(tmp_path),), variants=task.variants).rows))
    assert {(r.row_id, r.problem) for r in task.problems(rows).collect()} == FOUND[name]
    assert cli.main(["validate", *base]) == 0 and f"{len(FOUND[name])} problems" in capsys.readouterr().out
    assert cli.main(["validate", *base, "--strict", "--limit", "1"]) == 1
    out = capsys.readouterr().out
    assert out.count("  row ") == 1 and (len(FOUND[name]) == 1 or f"and {len(FOUND[name]) - 1} more" in out)


def test_validate_goes_on_after_a_file_that_cannot_be_read(spark, tmp_path, capsys):
    base = folder(tmp_path, {"dtm": ("[", {}), "translation": ([{"id": 1, "text_uz": "a", "text_en": "b", "text_ru": "c"}], {})})
    assert cli.main(["validate", *base, "--strict"]) == 1
    out = capsys.readouterr().out
    assert "dtm: " in out and "translation: 1 rows, 4 items" in out and "0 problems" in out


def test_board_of_all_kinds(spark, tmp_path, capsys):
    rows = [{"id": i, "text_uz": uz, "text_en": en} for i, (uz, en) in enumerate(SENTENCES)]
    base = folder(tmp_path, {"translation": (rows, {"directions": ["en_uz"], "bootstrap_samples": 20}), "ifeval_uz": (PROMPTS, {})}, REPLIES | {f"Matn: {en}": uz for uz, en in SENTENCES})
    assert cli.main(["run", *base, "--model", "m"]) == 0
    capsys.readouterr()
    assert cli.main(["report", *base, "--out", str(tmp_path / "board.json")]) == 0
    board = json.loads((tmp_path / "board.json").read_text())
    assert [(t["id"], t["chance"], t["version"]) for t in board["tasks"]] == [("translation", 0.0, "2.0"), ("ifeval_uz", 0.0, "2.0")]
    assert board["suiteDescription"] == "All of them" and set(board["notes"]) == {"composite", "intervals", "coverage"} and board["generatedAt"]
    row = board["models"][0]
    assert row["composite"] == 87.5 and row["scores"]["translation"]["score"] == 100.0 and row["scores"]["ifeval_uz"]["score"] == 75.0
    assert cli.published([], config.SuiteConfig("s", ["dtm"]), {"dtm": config.TaskConfig("dtm", "x")})["notes"]["status"]


def test_providers_in_files():
    assert providers.get_provider("replay")("m", answers={"a": "b"}, default="c").complete("xa", 5)[0] == "b"
