"""Profiles and the detector against a plain version, odd texts, held-out accuracy, and the constraint that uses it."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamga.functions import constraints, language
from tamga.plans import queries as plans


def order(texts, ranks):
    n = Counter()
    for text in texts:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            p = f"_{w}_"
            n.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:ranks]]


def nearest(text, known, ranks):
    own = order([text], ranks)
    off = {k: sum(min(abs(p.index(g) - i), ranks) if g in p else ranks for i, g in enumerate(own)) for k, p in sorted(known.items())}
    return min(off, key=off.get) if own else None


TEXTS = [(1, "de", "Der Hund und die Katze, das schöne Wetter!"), (2, "uz", "bu kitob va oʻsha daftar"), (3, "uz", "𐐨𐐩 va kitob"), (4, None, "nothing is learnt"), (5, "en", "the dog and the cat"), (6, "en", None), (7, "xx", "123 ..."), (8, "de", "")]


@pytest.mark.parametrize("ranks", [5, 40, 300])
def test_against_plain(spark, ranks):
    rows = spark.createDataFrame(TEXTS, "id bigint, lang string, text string").repartition(3)
    known = {}
    for lang in ("de", "uz", "en"):
        known[lang] = order([t for _, k, t in TEXTS if k == lang], ranks)
    learnt = language.profiles(rows, ranks=ranks)
    got = {}
    for r in learnt.orderBy("rank").collect():
        got.setdefault(r["lang"], []).append(r["group"])
    assert got == known
    odd = ["und", "kitob", "the", "zzz qqq", "", None, "...", "ß", "x" * 5000, "der " * 20000 + "the", "A\nB\tC"]
    ask = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *(t for *_, t in TEXTS)])], "id bigint, text string")
    found = language.detector(learnt, ranks)
    assert {r.id: r.found for r in ask.select("id", found(F.col("text")).alias("found")).collect()} == {i: nearest(t, known, ranks) for i, t in enumerate([*odd, *(t for *_, t in TEXTS)])}


def test_nothing_learnt_and_too_much(spark, monkeypatch):
    none = spark.createDataFrame([], "text string, lang string")
    assert language.profiles(none).count() == 0
    found = language.detector(language.profiles(none))
    assert [r[0] for r in spark.createDataFrame([("a",), (None,)], "t string").select(found(F.col("t"))).collect()] == [None, None]
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language.detector(language.profiles(spark.createDataFrame(TEXTS, "id bigint, lang string, text string")))


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    both = plans.QUERIES["language_found"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and held_out")
    assert both.select(F.avg((F.col("found") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_constraint(spark):
    found = language.detector(language.profiles(spark.createDataFrame(TEXTS, "id bigint, lang string, text string")))
    ask = [("a", "de", "die Katze und der Hund"), ("b", "en", "die Katze und der Hund"), ("c", "uz", "kitob va daftar")]
    rows = spark.createDataFrame(ask, "item_id string, want string, response string").select("item_id", F.lit(0).alias("at"), F.lit("language:response_language").alias("name"), F.create_map(F.lit("language"), F.array("want")).alias("kw"), F.lit(True).alias("localised"), "response")
    assert {r.item_id: r.outcome for r in constraints.evaluate(rows, detector=found).collect()} == {"a": "pass", "b": "fail", "c": "pass"}
