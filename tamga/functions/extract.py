"""Answer extraction: rule cascades as Column builders. Each gives struct<value, status, strategy, evidence>.

The first rule that fits wins. What can't be read is `unparsed`, or `truncated` if a reasoning trace was left open; it is
never taken for a wrong answer.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, fold_apostrophes, last_line, lines_of, once, py_strip, text_udf

LETTERS = "ABCDEFGHIJ"
# Cue words before a letter, and what may follow them.
ANSWER_WORDS = ("javob", "answer", "ответ")
CUE_TAIL = r"(?:HISOBLANADI|BO\S*LARDI)?"
NON_SCORING = ("unparsed", "truncated", "error")
TRACE = "think|thinking|reasoning"
KIND = "struct<value:string,status:string,strategy:string,evidence:string>"


def extraction(value, status, strategy, evidence) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(value).alias("value"), lit(status).alias("status"), lit(strategy).alias("strategy"), lit(evidence).alias("evidence"))


def head(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.lit(n))


def tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)


def last(found: Column) -> Column:
    """Last entry of an array, null if it is empty."""
    return F.try_element_at(found, F.lit(-1))


def without_closed(c: Column) -> Column:
    """The text without its closed traces."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?is)<({TRACE})>.*?</\1>", " ")


def strip_reasoning(c: Column) -> tuple[Column, Column]:
    """Visible text, and whether a trace was left open."""
    return without_open(without_closed(c))


def without_open(text: Column) -> tuple[Column, Column]:
    left_open = text.rlike(rf"(?is)<({TRACE})>")
    return py_strip(F.when(left_open, F.regexp_replace(text, rf"(?is)<({TRACE})>.*\z", " ")).otherwise(text)), left_open


def failed(left_open: Column) -> Column:
    return F.when(left_open, "truncated").otherwise("unparsed")


def ok(c: Column) -> Column:
    return (c["status"] == "ok") & c["value"].isNotNull()


def extract_choice(response: Column, n_options: Column, words=ANSWER_WORDS, strict: bool = False, prepared: Column | None = None) -> Column:
    """The letter of a multiple-choice answer among the first n_options.

    Order: bare letter, last cue, last boxed, last bold, end of the last line, label at its start. Only the last match of a
    rule is looked at. strict asks for a boundary before the letter at the end of the line and after a cue's letter, and for
    closing stars; without it the rules are as loose as stored scores need. prepared: the visible text as normalised by the
    caller (NFC); by default apostrophes are folded, which is the same for composed text.
    """
    visible, left_open = strip_reasoning(response)
    text = py_strip(fold_apostrophes(visible)) if prepared is None else py_strip(prepared)
    upper = F.upper(text)
    shown = F.substring(F.lit(LETTERS), F.lit(1), F.greatest(F.lit(1), F.least(n_options.cast("int"), F.lit(len(LETTERS)))))
    among = lambda x: F.when((F.length(x) == 1) & (F.position(x, shown) > 0), x)
    bare = F.upper(py_strip(text, r" .)*"))
    cues = "|".join(re.escape(w.upper()) for w in words)
    gap = f"[{SPACE}]"
    cue = rf"(?iu)(?:{cues}){gap}*{CUE_TAIL}{gap}*[:\-—]?{gap}*\**\(?([A-J])\)?\**" + (r"(?![\p{L}\p{N}])" if strict else "")
    boxed = rf"(?i)\\BOXED{gap}*\{{{gap}*([A-J]){gap}*\}}"
    bold = rf"\*\*{gap}*\(?([A-J])\)?{gap}*\*" + ("{2}" if strict else "*")
    line = F.upper(py_strip(F.coalesce(last(F.filter(lines_of(text), lambda x: F.length(py_strip(x)) > 0)), F.lit(""))))
    end = (r"(?<![\p{L}\p{N}])" if strict else "") + rf"\(?([A-J])\)?{gap}*[.):]?{gap}*\z"
    label = rf"^\**\(?([A-J])\)?{gap}*[.):]{gap}+[^{SPACE}]"
    one = lambda pattern, group: last(F.regexp_extract_all(upper, F.lit(pattern), F.lit(group)))
    tail_letter, label_letter = (F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (end, label))
    return (
        F.when(F.length(py_strip(F.coalesce(response, F.lit("")))) == 0, extraction(None, "unparsed", "empty", ""))
        .when(F.length(visible) == 0, extraction(None, failed(left_open), "reasoning-only", tail(response, 160)))
        .when(among(bare).isNotNull(), extraction(bare, "ok", "bare-letter", head(text, 80)))
        .when(among(one(cue, 1)).isNotNull(), extraction(one(cue, 1), "ok", "answer-cue", head(one(cue, 0), 80)))
        .when(among(one(boxed, 1)).isNotNull(), extraction(one(boxed, 1), "ok", "boxed", one(boxed, 0)))
        .when(among(one(bold, 1)).isNotNull(), extraction(one(bold, 1), "ok", "bold", one(bold, 0)))
        .when(among(tail_letter).isNotNull(), extraction(tail_letter, "ok", "line-tail", tail(line, 60)))
        .when(among(label_letter).isNotNull(), extraction(label_letter, "ok", "option-label", head(line, 60)))
        .otherwise(extraction(None, failed(left_open), "no-match", tail(visible, 160)))
    )


def extract_tagged(response: Column, tag: str = "solution") -> Column:
    """The inside of the last <tag> block."""
    visible, left_open = strip_reasoning(response)
    found = last(F.regexp_extract_all(visible, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1)))
    return F.when(found.isNotNull(), extraction(py_strip(found), "ok", f"<{tag}>", head(found, 120))).otherwise(extraction(None, failed(left_open), f"<{tag}>", tail(visible, 160)))


def extract_bold(response: Column, reject_ambiguous: bool = True) -> Column:
    """The inside of the last bold span; several different ones on the last line are a hedge, not an answer."""
    spans = lambda c: F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))

    def answer(seen: Column, found: Column) -> Column:
        out = F.when(found.isNull(), extraction(None, failed(seen["open"]), "bold", tail(seen["text"], 160)))
        sure = extraction(py_strip(found), "ok", "bold", head(found, 120))
        if not reject_ambiguous:
            return out.otherwise(sure)
        many = lambda x: F.size(F.array_distinct(F.transform(spans(x), lambda y: F.lower(py_strip(y))))) > 1
        return out.otherwise(once(last_line(seen["text"]), lambda x: F.when(many(x), extraction(None, "unparsed", "bold-ambiguous", head(x, 160))).otherwise(sure)))

    parts = lambda visible, left_open: F.struct(visible.alias("text"), left_open.alias("open"))
    # a text without an angle bracket has no trace
    shown = lambda r: F.when(r.contains("<"), once(without_closed(r), lambda t: parts(*without_open(t)))).otherwise(parts(py_strip(r), F.lit(False)))
    seen = once(F.coalesce(response, F.lit("")), shown)
    return once(seen, lambda s: once(last(spans(s["text"])), lambda found: answer(s, found)))


def extract_last_line(response: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """All that follows lead-ins: prefixes, blank lines and lines that end in a colon at the beginning."""
    visible, left_open = strip_reasoning(response)
    text = visible
    for prefix in prefixes:
        text = F.regexp_replace(text, rf"(?iu)^[{SPACE}]*{re.escape(prefix)}[{SPACE}]*[:\-—]?[{SPACE}]*", "")
    lines = lines_of(text)
    lead = lambda x: (F.length(py_strip(x)) == 0) | F.regexp_replace(x, f"[{SPACE}]+\\z", "").endswith(":")
    # position of the first line that is no lead-in
    at = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s.n + (s.on & lead(x)).cast("int")).alias("n"), (s.on & lead(x)).alias("on")), lambda s: s.n)
    kept = py_strip(F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), "\n"))
    kept = py_strip(kept, "\"“”")
    return (
        F.when(F.length(visible) == 0, extraction(None, failed(left_open), "last-line", tail(F.coalesce(response, F.lit("")), 160)))
        .when(F.length(kept) == 0, extraction(None, "unparsed", "last-line", tail(visible, 160)))
        .otherwise(extraction(kept, "ok", "last-line", head(kept, 120)))
    )


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def without_fences(visible: Column) -> Column:
    text = F.regexp_replace(visible, rf"^```[a-zA-Z]*[{SPACE}]*\n?", "")
    return py_strip(F.regexp_replace(text, rf"\n?```[{SPACE}]*\z", ""))


def all_json(responses: Column) -> Column:
    """Of an array of responses, which ones extract_json() takes."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [t is not None and _is_json(t) for t in x] for x in column.to_pylist()], pa.list_(pa.bool_()))

    return F.arrow_udf(run, "array<boolean>")(F.transform(responses, lambda x: without_fences(strip_reasoning(x)[0])))


def extract_json(response: Column) -> Column:
    """A JSON document that is the whole response, fences aside."""
    visible, left_open = strip_reasoning(response)
    text = without_fences(visible)
    return (
        F.when(F.length(text) == 0, extraction(None, failed(left_open), "json", tail(visible, 160)))
        .when(text_udf(_is_json, "boolean")(text), extraction(text, "ok", "json", head(text, 120)))
        .otherwise(extraction(None, "unparsed", "json", head(text, 160)))
    )


def extract_reasoning(response: Column, kind: Column, gold: Column) -> Column:
    """Solution tag, then bold for kinds with one short answer, then a last line with as many commas as the key."""
    slots = F.size(F.split(gold, ",", -1))
    tagged, bold = extract_tagged(response), extract_bold(response)
    visible, left_open = strip_reasoning(response)
    line = last(F.filter(F.transform(lines_of(visible), lambda x: py_strip(x)), lambda x: F.length(x) > 0))
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return (
        F.when(ok(tagged), tagged)
        .when((kind.isin("web_of_lies_v2", "spatial") | (slots == 1)) & ok(bold), bold)
        .when(commas == slots - 1, extraction(line, "ok", "last-line", head(line, 120)))
        .otherwise(extraction(None, failed(left_open), "no-match", tail(visible, 160)))
    )


def extract_response(response: Column) -> Column:
    """The visible text as the answer."""
    visible, left_open = strip_reasoning(response)
    return F.when(F.length(visible) == 0, extraction(None, failed(left_open), "empty", tail(F.coalesce(response, F.lit("")), 160))).otherwise(extraction(visible, "ok", "response", head(visible, 120)))


def scorable(status: Column) -> Column:
    return ~status.isin(*NON_SCORING)


def truncation(status: Column, finish_reason: Column) -> Column:
    """A run turns unparsed into truncated where the budget ended the response; rescoring leaves it."""
    return F.when((status == "unparsed") & finish_reason.isin("length", "max_tokens"), "truncated").otherwise(status)

