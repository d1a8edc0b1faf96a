"""Scorers as Column builders. `key` is the normaliser in which texts are compared (text.match_key or match_key_lower)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, TURNED, match_key, match_key_lower, py_strip

# Words for yes, no and unknown, as match keys.
YES = ("ha", "xa", "yes", "haʻ", "ҳа")
NO = ("yoʻq", "yoq", "no", "yuq", "йўқ")
UNKNOWN = ("nomaʻlum", "nomalum", "unknown", "noaniq", "номаълум")
# Plural, possessive and case endings.
SUFFIX = "^(lar)?(imiz|ingiz|lari|im|ing|si|i)?(niki|ning|dan|day|dek|ga|ka|qa|da|ni|cha)?$"
# Words around a short answer.
LEAD = rf"(?iu)^[{SPACE}]*(javob|bu|men|menimcha|zarbulmasal(ning)?[{SPACE}]+javobi)[{SPACE}]*[:\-—]?[{SPACE}]*"


def choice_score(extracted: Column, gold: Column) -> Column:
    return F.coalesce((extracted == gold).cast("double"), F.lit(0.0))


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(TURNED), F.lit(""))


def yes_no(word: Column, key=match_key) -> Column:
    """yes, no, unknown or null."""
    w = py_strip(key(word), r".,;:!?()\[\]\"'*")
    out = F.when(F.length(w) == 0, F.lit(None).cast("string"))
    for name, vocabulary in (("yes", YES), ("no", NO), ("unknown", UNKNOWN)):
        bare = sorted({x.replace(TURNED, "") for x in vocabulary})
        out = out.when(w.isin(*vocabulary) | _bare(w).isin(*bare), name)
    return out


def slots(text: Column) -> Column:
    """Comma-separated parts, trimmed."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), lambda x: py_strip(x))


def score_slots(predicted: Column, gold: Column) -> Column:
    """Half for the share of equal slots, half for all of them; 0 if the numbers of slots differ or there is none."""
    equal = F.aggregate(F.zip_with(predicted, gold, lambda a, b: a.eqNullSafe(b).cast("int")), F.lit(0), lambda s, x: s + x)
    n = F.size(gold)
    share = equal.cast("double") / n.cast("double")
    return F.when((n > 0) & (F.size(predicted) == n), ((equal == n).cast("double") + share) / 2.0).otherwise(0.0)


def is_inflection(longer: Column, stem: Column) -> Column:
    """Whether longer is stem with endings from the closed set."""
    rest = F.substring(longer, F.length(stem) + 1, F.length(longer))
    return longer.startswith(stem) & (F.length(longer) > F.length(stem)) & rest.rlike(SUFFIX)


def matches(answer: Column, accepted: Column, key=match_key_lower) -> Column:
    """Whether a free answer is one of the accepted forms, apart from case, apostrophes, filler and endings.

    accepted: an array of match keys. Arrow UDFs don't run beside lambdas: with key=match_key, key the answer in a column of
    its own first and pass key=lambda c: c.
    """
    got = py_strip(key(F.regexp_replace(F.coalesce(answer, F.lit("")), LEAD, "")), " .!?\"'«»")
    bare = _bare(got)
    fits = F.exists(accepted, lambda want: (got == want) | (bare == _bare(want)) | is_inflection(got, want) | is_inflection(bare, _bare(want)))
    return (F.length(got) > 0) & fits


def reasoning_score(value: Column, gold: Column, kind: Column, key=match_key) -> Column:
    """By kind: yes/no slots; one short answer with up to four more letters or a last number; positional slots."""
    g, p = slots(gold), slots(value)
    if key is match_key:
        # Arrow UDFs don't run inside lambdas: the whole string is keyed, parts are trimmed afterwards
        g, p = slots(key(gold)), slots(key(value))
    inner = (lambda x: x) if key is match_key else key
    web_gold, web_pred = F.transform(g, lambda x: yes_no(x, inner)), F.transform(p, lambda x: yes_no(x, inner))
    web = F.when(F.exists(web_gold, lambda x: x.isNull()), 0.0).otherwise(score_slots(web_pred, web_gold))
    one, said = F.element_at(g, 1) if key is match_key else key(F.element_at(g, 1)), key(value)
    number = F.replace(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(said, F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0))), -1), F.lit(","), F.lit("."))
    spatial = (said == one) | ((F.length(one) > 0) & said.startswith(one) & (F.length(said) <= F.length(one) + 4)) | ((F.length(number) > 0) & (number == one))
    keyed = lambda a: a if key is match_key else F.transform(a, lambda x: key(x))
    return F.when(kind == "web_of_lies_v2", web).when(kind == "spatial", spatial.cast("double")).otherwise(score_slots(keyed(p), keyed(g)))
