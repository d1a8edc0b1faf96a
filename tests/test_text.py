"""Text functions, extraction and scoring on single values, against plain Python where there is one."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamga.functions import constraints as C
from tamga.functions import extract as X
from tamga.functions import mt, score, stats
from tamga.functions import text as T


def values(spark, rows, *columns):
    """Columns over rows of strings s, t."""
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r, None) for i, r in enumerate(rows)], "i int, s string, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


SAMPLES = ["", None, "bo'lib ketdi", "Toʻgʻri sheʼr", "o‘g‘il ma’no", "é  é\t\x85x ", "ПРИВЕТ aеo", "ẞtraße İ", "a\x1cb\r\nc\n\nd", "don`t 5´ 6′", "ob-havo_1 ʻ", " 　x "]


def test_normalisers(spark):
    table = {ord(c): "ʻ" for c in T.APOSTROPHES}
    got = values(spark, SAMPLES, T.normalize(F.col("s")), T.normalize_display(F.col("s")), T.match_key(F.col("s")), T.count_words(T.normalize(F.col("s"))), T.has_cyrillic(F.col("s")), T.cyrillic_ratio(F.col("s")), T.py_strip(F.coalesce("s", F.lit(""))), T.lines_of(F.coalesce("s", F.lit(""))))
    for s, (n, shown, key, words, cyr, ratio, strip, lines) in zip(SAMPLES, got):
        s = s or ""
        want = unicodedata.normalize("NFC", s).translate(table)
        letters = [c for c in s if c.isalpha()]
        assert n == want and shown == re.sub("(?<![oOgG])ʻ", "ʼ", want)
        assert key == re.sub(r"\s+", " ", want.casefold()).strip()
        assert words == len(re.findall(r"[\wʻ]+", want)) and cyr == bool(re.search("[Ѐ-ӿ]", s))
        assert ratio == pytest.approx(sum("Ѐ" <= c <= "ӿ" for c in letters) / len(letters) if letters else 0)
        assert strip == s.strip() and lines == s.splitlines()


def test_repairs(spark):
    rows = ["fʻ(x) va ʻkitobʻ sheʻr oʻzbek", "itʻs ʻflatʻ"]
    (one,), _ = values(spark, rows, T.repair(F.col("s")))
    assert one.text == r"f^{\prime}(x) va «kitob» sheʼr oʻzbek" and (one.prime, one.quote, one.tutuq) == (1, 1, 1)
    assert values(spark, rows, T.repair_foreign(F.col("s")))[1][0].text == "it's 'flat'"
    assert values(spark, ["O'zbek ma'no", "toza"], T.canonicalise(F.col("s")))[0][0] == ("Oʻzbek maʼno", 2)
    assert values(spark, ['"bir" va «ikki» \'uch\' "\\x"', None], T.quoted_terms(F.col("s"))) == [(["bir", "ikki", "uch"],), ([],)]
    assert values(spark, ["Model X/7B!", "--", "a.b_c"], T.slug(F.col("s"))) == [("model-x-7b",), ("run",), ("a.b_c",)]


CHOICES = [
    ("B", "B", "bare-letter"), ("(c).", "C", "line-tail"), ("c).", "C", "bare-letter"), ("**D**", "D", "bare-letter"), ("Javob: B", "B", "answer-cue"), ("Javob A emas. Javob: C", "C", "answer-cue"), ("\\boxed{ D }", "D", "boxed"),
    ("Menimcha **B**.", "B", "bold"), ("Shunday\nto'g'ri (B)", "B", "line-tail"), ("izoh\nB) chunki shunday edi-ku-", "B", "option-label"), ("to'g'ri", None, "no-match"), ("", None, "empty"), (None, None, "empty"),
    ("<think>A</think>", None, "reasoning-only"), ("<think>A", None, "reasoning-only"), ("Javob: G", None, "no-match"), ("Bu yaxshi kitob", "B", "line-tail"),
]


def test_choices(spark):
    got = values(spark, [c[0] for c in CHOICES], X.extract_choice(F.col("s"), F.lit(4)))
    assert [(x.value, x.strategy) for (x,) in got] == [(v, s) for _, v, s in CHOICES]
    assert [x.status for (x,) in got][-3] == "truncated" and got[13][0].status == "unparsed"
    strict = values(spark, ["Bu yaxshi kitob", "Javob bilmayman", "**Bilmayman", "shunday (B)"], X.extract_choice(F.col("s"), F.lit(4), strict=True))
    assert [x.value for (x,) in strict] == [None, None, None, "B"]


def test_free_text(spark):
    assert values(spark, ["<solution>a</solution> <solution> b </solution>", "x <think>y"], X.extract_tagged(F.col("s"))) == [(("b", "ok", "<solution>", " b "),), ((None, "truncated", "<solution>", "x"),)]
    bold = values(spark, ["**1** keyin **2**", "bir **1**\nikki **2**", "hech"], X.extract_bold(F.col("s")))
    assert [(x.value, x.strategy) for (x,) in bold] == [(None, "bold-ambiguous"), ("2", "bold"), (None, "bold")]
    last = values(spark, ["Tarjima: salom\ndunyo", "Mana:\n\n“matn”", "Tarjima:", ""], X.extract_last_line(F.col("s"), ("Tarjima",)))
    assert [x.value for (x,) in last] == ["salom\ndunyo", "matn", None, None]
    docs = ['{"a": NaN}', "```json\n[1]\n```", "[1] so", "", '{"a":1,"a":2}']
    assert [x.status for (x,) in values(spark, docs, X.extract_json(F.col("s")))] == ["ok", "ok", "unparsed", "unparsed", "ok"]
    assert json.loads(docs[0])


def test_scores(spark):
    words = ["Ha.", "yo'q", "YOQ", "Nomaʼlum", "balki", "xa!", ""]
    assert [x for (x,) in values(spark, words, score.yes_no(F.col("s")))] == ["yes", "no", "no", "unknown", None, "yes", None]
    answers = ["Ko'zlarim", "Javob: koz", "Bu ko‘zni!", "ko'zoynak", "koʻz", "", None, "koʻzga"]
    assert [x for (x,) in values(spark, answers, score.matches(F.col("s"), F.array(F.lit("koʻz"))))] == [True, True, True, False, True, False, False, True]
    slots = [("a, b, c", "a, x, c"), ("a", "a"), ("a, b", "a"), ("", "a")]
    assert [round(x, 4) for (x,) in values(spark, slots, score.score_slots(score.slots(F.col("s")), score.slots(F.col("t"))))] == [0.3333, 1.0, 0.0, 0.0]
    said = [("tetraedrlar", "tetraedr"), ("10", "1"), ("javob 10,5", "10.5")]
    assert [x for (x,) in values(spark, said, score.reasoning_score(F.col("s"), F.col("t"), F.lit("spatial")))] == [1.0, 1.0, 1.0]
    assert [x for (x,) in values(spark, [("yoʻq, ha", "ha, yoʻq")], score.reasoning_score(F.col("s"), F.col("t"), F.lit("web_of_lies_v2")))] == [0.0]


def test_statistics(spark):
    low, high = stats.wilson(F.lit(15.0), F.lit(20))
    empty = stats.wilson(F.lit(0.0), F.lit(0))
    one = values(spark, ["x"], F.round(low, 2), F.round(high, 2), *empty, stats.minimum_n(F.lit(5.0)), stats.against_chance(F.lit(62.5), F.lit(0.25)), stats.against_chance(F.lit(10.0), F.lit(0.25)), stats.mcnemar(F.lit(3), F.lit(10)), stats.mcnemar(F.lit(10), F.lit(30)), stats.mcnemar(F.lit(0), F.lit(0)), stats.py_round(F.lit(2.675), 2))[0]
    assert one[:7] == (53.13, 88.81, 0.0, 0.0, 385, 50.0, 0.0)
    assert round(one[7].p_value, 6) == 0.092285 and one[7].test == "exact"
    assert round(one[8].p_value, 6) == 0.002663 and one[8].test == "chi2" and one[9].test == "none" and one[10] == 2.67


def test_constraints(spark):
    kw = F.create_map(F.lit("num_bullets"), F.array(F.lit("2.0")), F.lit("keyword"), F.array(F.lit("so'z")), F.lit("frequency"), F.array(F.lit("2")), F.lit("relation"), F.array(F.lit("exactly")), F.lit("postscript_marker"), F.array(F.lit("P.S.")))
    got = values(spark, ["- bir\n* ikki", "- bir"], C.check(F.lit("detectable_format:number_bullet_lists"), F.col("s"), kw))
    assert got == [(True,), (False,)]
    assert values(spark, ["soʻz va SO'Z", "soʻz"], C.check(F.lit("keywords:frequency"), F.col("s"), kw)) == [(True,), (False,)]
    assert values(spark, ["tamom. P. S. salom", "psixolog", "https"], C.check(F.lit("detectable_content:postscript"), F.col("s"), kw)) == [(True,), (False,), (False,)]
    text = "*bir*\nikki\nuch"
    lines = text.split("\n")
    variants = values(spark, [text, "yolgʻiz"], C.loose_variants(F.col("s")))
    assert variants[0][0] == [text, "bir\nikki\nuch", "\n".join(lines[1:]), "\n".join(lines[:-1]), "ikki", "ikki\nuch", "bir\nikki", "ikki"] and set(variants[1][0]) == {"yolgʻiz"}


def test_constraints_excluded(spark):
    empty = F.create_map().cast("map<string,array<string>>")
    kw = lambda **k: F.create_map(*[y for n, v in k.items() for y in (F.lit(n), F.array(F.lit(v)))]) if k else empty
    rows = [("punctuation:no_comma", kw(), False), ("keywords:existence", kw(keywords="x"), False), ("keywords:letter_frequency", kw(), True), ("no:such", kw(), True), ("length_constraints:number_words", kw(num_words="1", relation="about"), True), ("startend:end_checker", kw(), True), ("language:response_language", kw(language="ru"), True)]
    base = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("name"), k.cast("map<string,array<string>>").alias("kw"), F.lit(b).alias("localised")) for i, (n, k, b) in enumerate(rows)])).alias("x")).select(F.lit("1").alias("item_id"), "x.*", F.lit("a, b\nc").alias("response"))
    got = {r.at: r for r in C.evaluate(base).collect()}
    assert (got[0].outcome, got[0].strict, got[0].loose) == ("fail", False, True)
    assert [got[i].reason for i in range(1, 7)] == ["kwargs-not-localised", "not-meaningful-in-uzbek", "unregistered", "unhandled relation 'about'", "startend:end_checker needs an end_phrase", "language:response_language needs a detector"]


def chrf_plain(hyp, ref):
    p, r, n = 0.0, 0.0, 0
    import collections

    def words(x):
        out = []
        for w in x.split():
            if len(w) > 1 and w[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    for units, orders in ((lambda x: list("".join(x.split())), 6), (words, 2)):
        for k in range(1, orders + 1):
            h, g = (collections.Counter(tuple(u[i : i + k]) for i in range(len(u) - k + 1)) for u in (units(hyp), units(ref)))
            if h and g:
                m = sum((h & g).values())
                p, r, n = p + m / h.total(), r + m / g.total(), n + 1
    p, r = (p / n, r / n) if n else (0, 0)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def test_translation_metrics(spark):
    rnd = random.Random(0)
    make = lambda n: " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(i, make(rnd.randint(0, 9)), make(rnd.randint(1, 9))) for i in range(30)] + [(90, "salom, dunyo.", "salom, dunyo."), (91, "", "x")]
    pairs = spark.createDataFrame(rows, "seg int, hyp string, ref string")
    got = {r.seg: r.chrf for r in mt.sentence_chrf(pairs).collect()}
    for i, h, r in rows:
        assert got[i] == pytest.approx(chrf_plain(h, r))
    same = spark.createDataFrame([(1, "Bu yaxshi, juda yaxshi kitob.", "Bu yaxshi, juda yaxshi kitob.")], "seg int, hyp string, ref string")
    assert mt.corpus_bleu(same).first().bleu == pytest.approx(100) and mt.corpus_chrf(same).first().chrf == pytest.approx(100)
    # worked by hand: precisions 4/5, 2/4, smoothed 1/(2*3), 1/(4*2); equal lengths
    one = spark.createDataFrame([(1, "a b x d e", "a b c d e")], "seg int, hyp string, ref string")
    assert mt.corpus_bleu(one).first().bleu == pytest.approx(100 * (0.8 * 0.5 * (1 / 6) * (1 / 8)) ** 0.25)


def test_html_escape(spark):
    rows = spark.createDataFrame([("<a href='x'>&amp; \"q\"</a>",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.html_escape(F.col("t"))).collect()] == ["&lt;a href=&#39;x&#39;&gt;&amp;amp; &quot;q&quot;&lt;/a&gt;", "", ""]
    assert [T.slug_of(x) for x in ("Org/Model  7B", "--", "a_b.c")] == ["org-model-7b", "run", "a_b.c"]


def test_language_detector(spark):
    """With a detector response languages are judged; blank languages stay excluded, undetected texts fail."""
    rows = spark.createDataFrame([("1", 0, "privet", "RU"), ("2", 0, "hello", "ru"), ("3", 0, "", "ru"), ("4", 0, "privet", " ")], "item_id string, at int, response string, lang string")
    rows = rows.select("item_id", "at", "response", F.lit("language:response_language").alias("name"), F.create_map(F.lit("language"), F.array("lang")).alias("kw"), F.lit(False).alias("localised"))
    got = {r.item_id: r.outcome for r in C.evaluate(rows, detector=lambda c: F.when(c == "privet", "ru").when(c == "hello", "EN")).collect()}
    assert got == {"1": "pass", "2": "fail", "3": "fail", "4": "excluded"}
    assert {r.reason for r in C.evaluate(rows.where("item_id = '1'")).collect()} == {"language:response_language needs a detector"}
