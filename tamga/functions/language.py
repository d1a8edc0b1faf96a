"""Which language a text is in, by the ranks of its letter groups. A profile lists a language's most frequent groups of one to three
letters in order; a text gets the language whose order is nearest to its own. Profiles are learnt in the JVM; texts are judged by an
Arrow UDF, since counting inside a row takes nearly three times as long with the JVM's lambdas."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups in a profile, and of a text that are compared.
RANKS = 300
#: Languages that one detector tells apart: its profiles are part of the plan.
MOST_LANGUAGES = 200


def words(text) -> Column:
    """Runs of letters in lower case; null is none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def groups(word: Column) -> Column:
    """Single letters, pairs and triples of a word, for which its ends count as `_`."""
    padded, n = F.concat(F.lit("_"), word, F.lit("_")), F.length(word)
    of = lambda text, last, size: F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
    return F.concat(of(word, n, 1), of(padded, n + 1, 2), of(padded, n, 3))


def profiles(rows: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> DataFrame:
    """lang, rank (from 0), group: the most frequent groups of each language, equal counts in code-point order. Rows without a
    language teach nothing. Words are counted before they are taken apart, both counts are combined before they are shuffled."""
    counted = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    each = counted.select("lang", F.explode(groups(F.col("w"))).alias("group"), "n").groupBy("lang", "group").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "group")) - 1
    return each.withColumn("rank", place).where(F.col("rank") < ranks).select("lang", "rank", "group")


def _cut(word: str) -> list[str]:
    """The same as `groups`."""
    padded = f"_{word}_"
    return [*word, *(padded[i : i + 2] for i in range(len(word) + 1)), *(padded[i : i + 3] for i in range(len(word)))]


def _nearest(text: str | None, places: dict[str, list[tuple[int, int]]], names: list[str], ranks: int, cut) -> str | None:
    """The name of the profile nearest to words parted by blanks. places: for a group, (language, rank) pairs."""
    counts: Counter = Counter()
    for w, n in Counter((text or "").split()).items():
        for g in cut(w):
            counts[g] += n
    if not counts:
        return None
    top = nsmallest(ranks, counts.items(), key=lambda x: (-x[1], x[0]))
    off = [ranks * len(top)] * len(names)
    for i, (g, _) in enumerate(top):
        for at, place in places.get(g, ()):
            off[at] += min(abs(place - i), ranks) - ranks
    return names[off.index(min(off))]


def detector(learnt: DataFrame, ranks: int = RANKS):
    """A Column builder from a text to the nearest of the learnt languages: places by which its groups are off are summed, a group that
    a profile lacks is off by `ranks`; of equal distances the first name. Null for a text without letters, or if nothing was
    learnt. learnt: what `profiles` gave; it travels with the tasks, so more than 200 languages are an error."""
    rows = learnt.limit(MOST_LANGUAGES * ranks + 1).collect()
    names = sorted({r["lang"] for r in rows})
    if len(rows) > MOST_LANGUAGES * ranks or len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not names:
        return lambda text: F.nullif(F.left(text, F.lit(0)), F.lit(""))
    places: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        places.setdefault(r["group"], []).append((names.index(r["lang"]), r["rank"]))

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        cut = lru_cache(1 << 16)(_cut)  # most words of a batch occur again
        return pa.array([_nearest(x.as_py(), places, names, ranks, cut) for x in texts], pa.string())

    return lambda text: found(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
