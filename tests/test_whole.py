"""Registered queries over texts that go on long after any prefix, against plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tamga.operators import metrics
from tamga.plans import queries as plans

#: Nothing in it meets or breaks a constraint; over 5,000 characters.
FILL = "salom dunyo\n" * 450
TAILS = ("oxiri", "bir, ikki", "- a\n- b\n- c", "*bir* va <<nom>> [x]", "xat\n\nikki", "bir. ikki! uch? toʻrt. besh. olti.", "the of the in the the the the", "wherever", "oxiri the", "e. a. salom", "Erth 1", "so'z\noxirgi qator")


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """A folder with documents, and the rows: every tail under each kind of doc_id, long and short."""
    rows = [(6 * i + k, a + t) for i, (a, t) in enumerate((a, t) for a in (FILL, "") for t in TAILS) for k in (0, 1, 3)]
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    return d, dict(rows)


def shaped(i, text):
    return text.replace("\n", "\n\n") if i % 2 == 0 else text.replace("\n", "\n- ") if i % 3 == 0 else f'"{text}"'


def key(v):
    return " ".join(v.translate({ord(c): "ʻ" for c in "'‘’‛ʼʽ`´′"}).lower().split())


def parts(v):
    return [x.strip() for x in (v.split("***") if "***" in v else re.split(r"\n\s*\n", v)) if x.strip()]


def is_json(v):
    try:
        json.loads(v)
    except ValueError:
        return False
    return True


BRUTE = {
    "no_comma": lambda v: "," not in v,
    "number_bullet_lists": lambda v: len(re.findall(r"(?m)^\s*[*\-•]\s+\S", v)) == 3,
    "number_highlighted_sections": lambda v: bool(re.search(r"\*{1,2}[^\n*]+\*{1,2}", v)),
    "title": lambda v: bool(re.search(r"<<[^\n]+>>", v)),
    "number_placeholders": lambda v: bool(re.search(r"\[[^\[\]]*\]", v)),
    "number_paragraphs": lambda v: len(parts(v)) == 2,
    "quotation": lambda v: len(v.strip()) >= 2 and v.strip()[0] in '"«“' and v.strip()[-1] in '"»”',
    "number_words": lambda v: len(re.findall(r"[\wʻ]+", v.replace("'", "ʻ"))) < 120,
    "number_sentences": lambda v: len([x for x in re.split(r"(?<=[.!?])\s+", v.strip()) if x.strip()]) <= 5,
    "existence": lambda v: "the" in key(v) and "of" in key(v),
    "frequency": lambda v: key(v).count("the") > 4,
    "forbidden_words": lambda v: not re.search(r"\b(wher|eines)", key(v)),
    "end_checker": lambda v: key(v).rstrip(" .!?").endswith("the"),
    "repeat_prompt": lambda v: key(v).startswith("an"),
    "two_responses": lambda v: False,
    "postscript": lambda v: bool(re.search(r"(?i)\be\.\s*a\.", v)),
    "multiple_sections": lambda v: bool(re.search(r"(?i)erth\s?\d+", v)),
    "constrained_response": lambda v: "in the" in key(v) or "de la" in key(v),
    "nth_paragraph_first_word": lambda v: len(parts(v)) >= 2 and key(parts(v)[1].split()[0]).strip(".,!?;:\"'") == "the",
    "json_format": lambda v: is_json(v.strip()),
}


def test_checkers_whole(spark, long_docs):
    d, rows = long_docs
    assert {f"checker_{n}" for n in BRUTE} == {k for k in plans.QUERIES if k.startswith("checker_")}
    all_ = None
    for name in BRUTE:
        df = plans.QUERIES[f"checker_{name}"](spark, d).withColumn("name", F.lit(name))
        all_ = df if all_ is None else all_.unionByName(df)
    got = {(r.name, r.doc_id): r.fits for r in all_.collect()}
    assert got == {(n, i): f(shaped(i, t)) for n, f in BRUTE.items() for i, t in rows.items()}


def test_loose_and_grid_whole(spark, long_docs):
    d, rows = long_docs
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.no_first, r.no_last, r.plain) for r in plans.QUERIES["loose_variants"](spark, d).collect()}
    for i, t in rows.items():
        v = shaped(i, t)
        lines = v.split("\n")
        many = len(lines) > 1
        assert got[i] == (sha("\n".join(lines[1:]) if many else v), sha("\n".join(lines[:-1]) if many else v), sha(v.replace("*", "")))
    names = {0: "no_comma", 1: "number_paragraphs", 2: "quotation", 3: "existence"}
    judged = [r for r in plans.QUERIES["ifeval_evaluate"](spark, d).collect() if r.strict is not None]
    assert len(judged) == 3 * len(rows) + sum(i % 2 == 0 for i in rows)
    for r in judged:
        i = int(r.item_id)
        assert r.strict == BRUTE[names[r.at]](shaped(i, rows[i]).strip()), (r.name, i)


QUOTED = re.compile(r"""["«“„]([^"»”“„\n]{1,80})["»”]|'([^'\n]{2,80})'""")


def test_quoted_terms_whole(spark, tmp_path):
    rows = [(1, FILL + "bir, ikki. uch"), (2, "don't 'olma' va \"nok\""), (3, None), (4, "«a» " + FILL + "„b” 'cd' \"\\x\""), (5, ""), (6, FILL)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in rows:
        q = re.sub(r"([a-z]+)\. ", r"«\1» ", re.sub("([a-z]+), ", r'"\1" ', text or ""))
        terms = [(m[1] or m[2]).strip() for m in QUOTED.finditer(q)]
        want[i] = "|".join(x for x in terms if 0 < len(x) < 80 and not x.startswith("\\"))
    assert want[1] == "bir|ikki" and want[4] == "a|b|cd" and want[3] == want[6] == ""
    assert {r.doc_id: r.terms for r in plans.QUERIES["quoted_terms"](spark, str(tmp_path)).collect()} == want


def test_extract_bold_whole(spark, tmp_path):
    rows = [(1, "bir, ikki\n" + FILL + "uch, toʻrt"), (2, "bir, ikki\n" + FILL + "uch, besh, olti"), (3, FILL), (4, "bir, ikki"), (5, FILL + "bir, Bir\nuch, x\n\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.value, r.strategy) for r in plans.QUERIES["extract_bold"](spark, str(tmp_path)).collect()}
    assert got == {1: ("uch", "bold"), 2: (None, "bold-ambiguous"), 3: (None, "bold"), 4: ("bir", "bold"), 5: ("uch", "bold")}


def test_validate_lengths_whole(spark, tmp_path):
    rows = [(1, "x" * 100, "y" * 34), (2, "x" * 100, "y" * 35), (3, "x" * 20, "y" * 6), (4, "x" * 100, ""), (5, None, "y")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.row_id for r in plans.QUERIES["validate_lengths"](spark, str(tmp_path)).collect()) == ["1", "3"]


SMALL = "/root/testdata/sf0.001"


def test_resamples_whole(spark, monkeypatch):
    rows = sorted((r.ord, r.a - r.b) for r in plans._pairs(spark, SMALL).collect())
    rng, n, wins = random.Random(12345), len(rows), 0
    whole = sum(x for _, x in rows)
    for _ in range(1000):
        d = sum(rows[rng.randrange(n)][1] for _ in range(n))
        wins += d != 0 and (d > 0) == (whole > 0)
    got = plans.QUERIES["paired_bootstrap_rng"](spark, SMALL).first()
    assert got.n_samples == 1000 and got.p_value == pytest.approx(1 - wins / 1000)
    hashed = plans.QUERIES["bootstrap_hash"](spark, SMALL)
    assert sorted(r.sample for r in hashed.collect()) == list(range(200))
    drawn, made = [], metrics.draws
    monkeypatch.setattr(metrics, "draws", lambda spark, n, samples, seed: drawn.append(samples) or made(spark, n, samples, seed))
    ends = plans.QUERIES["bootstrap_ci_rng"](spark, SMALL).first()
    assert drawn == [500] and 0 <= ends.low < ends.high <= 100


def test_reference_limits(spark, tmp_path):
    from math import comb

    # model -> (b, c) discordant items, and two on which both are right
    models = {"none": (0, 0), "one": (1, 0), "edge": (10, 11), "most": (4, 20), "over": (20, 5)}
    rows = [(m, q, t) for m, (b, c) in models.items() for q, t, n in ((1, 1, b), (0, 0, c), (1, 0, 2)) for _ in range(n)]
    spark.createDataFrame([(i, "x", "en", m, 1) for i, (m, _, _) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, (_, q, t) in enumerate(rows)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    want = {m: round(min(1.0, 2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)), 6) for m, (b, c) in models.items() if b + c < 25}
    assert {r.model: r.p_value for r in plans.QUERIES["mcnemar_exact"](spark, f"{tmp_path}/a").collect()} == want

    # parts of Cyrillic letters: 0.3, exactly 0.5, 0.6
    texts = [(1, "de", "жжжzzzzzzz"), (2, "en", "жz"), (3, "fr", "жжжzz")]
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.lang: r.rate for r in plans.QUERIES["cyrillic_output_rate"](spark, f"{tmp_path}/b").collect()} == {"de": 0.0, "en": 0.0, "fr": 1.0}

    spark.range(7).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/c/events.parquet")
    assert sorted(r.event_id for r in plans.QUERIES["rate_limit_stateful"](spark, f"{tmp_path}/c").collect() if r.ok) == [0, 1, 2, 3, 4]
