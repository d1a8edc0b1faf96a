"""Corpus translation metrics from additive per-segment statistics.

chrF++ counts character n-grams of orders 1-6 without white space and word n-grams of orders 1-2 with end punctuation apart;
BLEU counts word n-grams of orders 1-4 after 13a tokenisation. Every statistic is a sum over segments, so an overall score,
a score per group and one per resample are sums of the same rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, py_strip

CHAR_ORDERS, WORD_ORDERS, BETA, BLEU_ORDERS = 6, 2, 2, 4
# Settings as scores are labelled with them, and the ASCII punctuation that chrF++ sets apart.
CHRF_SIGNATURE = "nrefs:1|case:mixed|eff:yes|nc:6|nw:2|space:no"
BLEU_SIGNATURE = "nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp"
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def chrf_words(c: Column) -> Column:
    """White-space words, with one punctuation mark at the end, or else at the beginning, as a word of its own."""
    parts = F.filter(F.split(py_strip(c), f"[{SPACE}]+"), lambda x: F.length(x) > 0)
    size = lambda w: F.length(w)
    pieces = F.transform(
        parts,
        lambda w: F.when((size(w) > 1) & F.right(w, F.lit(1)).rlike(f"[{PUNCTUATION}]"), F.array(F.substring(w, F.lit(1), size(w) - 1), F.right(w, F.lit(1))))
        .when((size(w) > 1) & F.left(w, F.lit(1)).rlike(f"[{PUNCTUATION}]"), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), size(w))))
        .otherwise(F.array(w)),
    )
    return F.flatten(pieces)


def words_13a(c: Column) -> Column:
    text = F.regexp_replace(c, "<skipped>|-\n", "")
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    for mark, said in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(mark), F.lit(said))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    # The splits of the 13a tokeniser.
    for pattern, to in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: F.length(x) > 0)


STATISTICS = "array<struct<kind: string, n: int, hyp: bigint, ref: bigint, match: bigint>>"


def _counted(kind: str, orders: int):
    """Two texts or token lists -> for each order that either has the n-grams of both sides and the clipped matches. Nothing leaves
    the row. Of chrF++ a hypothesis' n-grams of an order that the reference hasn't got don't count."""
    shape = pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int32()), ("hyp", pa.int64()), ("ref", pa.int64()), ("match", pa.int64())]))

    def run(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        out = []
        for one, two in zip(hyps.to_pylist(), refs.to_pylist()):
            found = []
            for n in range(1, orders + 1):
                h, r = (Counter(_grams(side, n)) for side in (one or (), two or ()))
                if not h and not r:
                    continue
                small, large = (h, r) if len(h) < len(r) else (r, h)
                match = sum(min(c, large[g]) for g, c in small.items() if g in large)
                found.append({"kind": kind, "n": n, "hyp": h.total() if r or kind == "b" else 0, "ref": r.total(), "match": match})
            out.append(found)
        return pa.array(out, shape)

    return F.arrow_udf(run, STATISTICS)


def _grams(side, n: int):
    """n-grams of a text as strings, of a list as tuples."""
    if isinstance(side, str):
        return [side[i : i + n] for i in range(len(side) - n + 1)]
    return zip(*(side[k:] for k in range(n)))


def _exploded(pairs: DataFrame, stats: Column, *keep: str) -> DataFrame:
    return pairs.select("seg", *keep, F.explode(stats).alias("x")).select("seg", *keep, "x.*")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def chrf_segment(hyp: Column, ref: Column) -> Column:
    """The statistics of one segment, as an array: kind (c or w), n, hyp, ref, match."""
    return F.concat(_counted("c", CHAR_ORDERS)(without_space(hyp), without_space(ref)), _counted("w", WORD_ORDERS)(chrf_words(hyp), chrf_words(ref)))


def bleu_segment(hyp: Column, ref: Column) -> Column:
    return _counted("b", BLEU_ORDERS)(words_13a(hyp), words_13a(ref))


def chrf_statistics(pairs: DataFrame) -> DataFrame:
    """pairs: seg, hyp, ref -> seg, kind (c or w), n, hyp, ref, match."""
    return _exploded(pairs, chrf_segment(F.col("hyp"), F.col("ref")))


def _chrf_parts() -> tuple[list[Column], Column]:
    """Aggregates of summed statistics, and the score of them."""
    both = (F.col("hyp") > 0) & (F.col("ref") > 0) & (F.col("kind") != "b")
    parts = [F.avg(F.when(both, F.col("match") / F.col("hyp"))).alias("p"), F.avg(F.when(both, F.col("match") / F.col("ref"))).alias("r")]
    f = (1 + BETA**2) * F.col("p") * F.col("r") / (BETA**2 * F.col("p") + F.col("r"))
    return parts, F.when(F.coalesce(F.col("p") + F.col("r"), F.lit(0.0)) > 0, f * 100.0).otherwise(0.0)


def chrf_score(sums: DataFrame, *by: str) -> DataFrame:
    """sums: by, kind, n, hyp, ref, match (summed) -> by, chrf in percent: precision and recall averaged over the orders that
    both sides have, then F with beta 2."""
    parts, score = _chrf_parts()
    return sums.groupBy(*by).agg(*parts).select(*by, score.alias("chrf"))


def sentence_score(stats: Column) -> Column:
    """chrF++ in percent of one segment's statistics."""
    both = F.filter(stats, lambda x: (x["hyp"] > 0) & (x["ref"] > 0) & (x["kind"] != "b"))
    mean = lambda side: F.aggregate(both, F.lit(0.0), lambda s, x: s + x["match"] / x[side]) / F.size(both)
    pair = F.struct(mean("hyp").alias("p"), mean("ref").alias("r"))
    f = lambda x: (1 + BETA**2) * x["p"] * x["r"] / (BETA**2 * x["p"] + x["r"])
    return F.get(F.transform(F.array(pair), lambda x: F.when(F.coalesce(x["p"] + x["r"], F.lit(0.0)) > 0, f(x) * 100.0).otherwise(0.0)), F.lit(0))


def grouped_scores(segments: DataFrame, group: str) -> DataFrame:
    """whole (1 for all segments), the group, chrf, bleu, segments: scores of all segments and of each group in one pass over their
    statistics (`stats`, of both metrics)."""
    each = segments.select(group, F.explode("stats").alias("x")).select(group, "x.*")
    sums = each.groupingSets([["kind", "n"], [group, "kind", "n"]], group, "kind", "n").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")], F.grouping(group).cast("int").alias("whole"))
    chrf, score = _chrf_parts()
    bleu, wide = _bleu_parts()
    scored = sums.groupBy("whole", group).agg(*chrf, *bleu).select("whole", group, score.alias("chrf"), wide.alias("bleu"))
    counts = segments.groupingSets([[], [group]], group).agg(F.count("*").alias("segments"), F.grouping(group).cast("int").alias("whole"))
    same = (F.col("c.whole") == F.col("s.whole")) & F.col(f"c.{group}").eqNullSafe(F.col(f"s.{group}"))
    met = counts.where("segments > 0").alias("c").join(scored.alias("s"), same, "left")
    return met.select("c.whole", f"c.{group}", F.coalesce("chrf", F.lit(0.0)).alias("chrf"), F.coalesce("bleu", F.lit(0.0)).alias("bleu"), "segments")


def corpus_chrf(pairs: DataFrame, *by: str) -> DataFrame:
    """Corpus chrF++ of pairs (seg, hyp, ref, by)."""
    stats = chrf_statistics(pairs)
    sums = (stats.join(pairs.select("seg", *by), "seg") if by else stats).groupBy(*by, "kind", "n").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")])
    return chrf_score(sums, *by)


def sentence_chrf(pairs: DataFrame) -> DataFrame:
    return chrf_score(chrf_statistics(pairs), "seg")


def bleu_statistics(pairs: DataFrame) -> DataFrame:
    """pairs: seg, hyp, ref -> seg, kind (b), n, hyp, ref, match."""
    return _exploded(pairs, bleu_segment(F.col("hyp"), F.col("ref")))


def corpus_bleu(pairs: DataFrame, *by: str) -> DataFrame:
    """by, bleu: clipped precisions of orders 1-4, exponential smoothing of empty ones, brevity penalty."""
    stats = bleu_statistics(pairs)
    sums = (stats.join(pairs.select("seg", *by), "seg") if by else stats).groupBy(*by, "kind", "n").agg(*[F.sum(c).alias(c) for c in ("hyp", "ref", "match")])
    return bleu_score(sums, *by)


def _bleu_parts() -> tuple[list[Column], Column]:
    at = lambda c, n: F.coalesce(F.sum(F.when((F.col("n") == n) & (F.col("kind") == "b"), F.col(c))), F.lit(0)).cast("double").alias(f"{c}{n}")
    parts = [*[at(c, n) for c in ("hyp", "match") for n in range(1, BLEU_ORDERS + 1)], at("ref", 1)]
    logs, smooth, none = F.lit(0.0), F.lit(1.0), F.lit(False)
    for n in range(1, BLEU_ORDERS + 1):
        hyp, match = F.col(f"hyp{n}"), F.col(f"match{n}")
        smooth = F.when(match == 0, smooth * 2.0).otherwise(smooth)
        logs = logs + F.ln(F.when(hyp == 0, F.lit(1.0)).when(match == 0, F.lit(1.0) / (smooth * hyp)).otherwise(match / hyp))
        none = none | (hyp == 0)
    short = F.when(F.col("hyp1") < F.col("ref1"), F.exp(F.lit(1.0) - F.col("ref1") / F.col("hyp1"))).otherwise(1.0)
    return parts, F.when((F.col("match1") == 0) | none, 0.0).otherwise(short * F.exp(logs / BLEU_ORDERS) * 100.0)


def bleu_score(sums: DataFrame, *by: str) -> DataFrame:
    """sums: by, kind, n, hyp, ref, match (summed) -> by, bleu in percent."""
    parts, score = _bleu_parts()
    return sums.groupBy(*by).agg(*parts).select(*by, score.alias("bleu"))
