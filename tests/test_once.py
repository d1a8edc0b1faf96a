"""What reads a text at many places works it out once a row: small plans, and odd texts against plain Python."""

import re

from pyspark.sql import functions as F

from tamga.functions import constraints as C
from tamga.functions import extract as X
from tamga.functions import text as T
from tamga.plans import queries as plans

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", None, "**a**\x1c**b** **B**", "**a** **b** x **c**\x85\n", "<think>**a**</think>**b**\r\n\r", "**q** <reasoning>**b**", "a < b **c**　", "**x** **y**\n \x1f", "**A** **a** ", "* **", "<THINK>a</think> **z**\x0b**y** **w**"]


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def bold(text):
    text = re.sub(r"(?is)<(think|thinking|reasoning)>.*?</\1>", " ", text or "")
    shown = re.split(r"(?i)<(?:think|thinking|reasoning)>", text)[0].strip()
    found = re.findall(r"\*\*([^*]+)\*\*", shown)
    line = ([x for x in shown.splitlines() if x.strip()] or [shown])[-1]
    if found and len({x.strip().lower() for x in re.findall(r"\*\*([^*]+)\*\*", line)}) > 1:
        return None, "bold-ambiguous"
    return (found[-1].strip() if found else None), "bold"


def test_bold_once(spark):
    assert planned(plans.QUERIES["extract_bold"](spark, SMALL)).count("thinking") <= 4
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", X.extract_bold(F.col("t")).alias("x"))
    assert {r.i: (r.x.value, r.x.strategy) for r in rows.collect()} == {i: bold(t) for i, t in enumerate(ODD)}


def test_strip_and_key(spark):
    odd = [*ODD[:2], *[c + "A" + c + c + "'b" + c for c in T.SPACES], "\x00 a​", "ÀΣ ʼ", "İ\t\t İ"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", T.py_strip(F.col("t")).alias("s"), T.match_key_lower(F.col("t")).alias("k")).collect()
    assert all(c.isspace() for c in T.SPACES) and len(T.SPACES) == sum(chr(i).isspace() for i in range(0x110000))
    assert [r.s for r in got] == [x.strip() for x in odd]
    assert [r.k for r in got[: 2 + len(T.SPACES)]] == ["", ""] + ["a ʻb"] * len(T.SPACES)


def test_constraints_in_place(spark):
    for name in ("ifeval_evaluate", "constraint_grid", "ifeval_task"):
        plan = planned(plans.QUERIES[name](spark, SMALL))
        assert "posexplode" not in plan and plan.count("Join") <= (name == "ifeval_task"), name
    texts = ['```json\n{"a": 1}\n```', 'so\n{"a": 1}', '**{"a": [1,\n2]}**', "x, y", "", None, "*\n*", 'x\n"b"\ny', "a,\n**b**"]
    asked = [(C.JSON, {}), ("punctuation:no_comma", {}), ("startend:quotation", {}), ("keywords:forbidden_words", {"forbidden_words": ["x", "so"]})]
    rows = [(str(i), at, n, kw, True, t) for i, t in enumerate(texts) for at, (n, kw) in enumerate(asked)]
    df = spark.createDataFrame(rows, "item_id string, at int, name string, kw map<string,array<string>>, localised boolean, response string")
    got = {(int(r.item_id), r.at): (r.strict, r.loose) for r in C.evaluate(df).collect()}
    yes, loose, no = (True, True), (False, True), (False, False)
    want = [
        [yes, yes, no, yes], [loose, yes, no, loose], [loose, loose, no, yes], [no, no, no, no], [no, yes, no, yes], [no, no, no, yes], [no, yes, no, yes],
        [loose, yes, loose, loose], [no, loose, no, yes],
    ]
    assert got == {(i, at): x for i, row in enumerate(want) for at, x in enumerate(row)}
