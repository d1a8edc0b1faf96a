"""Secret scans with a trigram inverted index, in built-in functions only.

From each rule's pattern a Boolean trigram query is derived: an OR of ANDs of three-character strings that any match must
hold. The index has postings for every trigram that some rule asks for, in blocks of documents: (block, trigram) -> ids.
A rule's candidates in a block are the union over its ANDs of intersected postings; only candidates are searched with the
rule's pattern. A rule whose pattern has no mandatory trigram scans all texts.

The pattern parser knows what the rules use: literals, escapes, classes, groups with alternatives, ?, *, + and {m,n}. What
it can't see through weakens the query, never the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import IdFilter, documents, saved, stored_bytes

#: Text (as stored) per block of the index.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """kind; pattern as Java and RE2 both read it; ignore_case: ASCII letters in either case; group and least: a match is
    dropped if that group has fewer characters; base: counts in the base columns."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The base kinds come first, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", False, 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
)


# ---- Boolean queries -------------------------------------------------------------------------------------------------

#: What a part of a pattern can say: its whole strings if they are few, and a query that holds for all its matches.
MAX_STRINGS = 32


def _parse(pattern: str, at: int = 0, depth: int = 0):
    """Alternatives of sequences of (kind, value, least count, whether exactly that often)."""
    branches, seq = [], []
    while at < len(pattern):
        c = pattern[at]
        if c == ")" and depth:
            break
        if c == "|":
            branches.append(seq)
            seq, at = [], at + 1
            continue
        if c == "(":
            skip = 3 if pattern.startswith("(?:", at) else 1
            inner, at = _parse(pattern, at + skip, depth + 1)
            item, at = ("group", inner), at + 1
        elif c == "[":
            end = at + 1 + (pattern[at + 1] == "^")
            end += pattern[end] == "]"
            while pattern[end] != "]":
                end += 1 + (pattern[end] == "\\")
            body = pattern[at + 1 : end]
            few = len(body) <= 8 and not set("^-\\") & set(body)
            item, at = ("group", [[(("char", x), 1, True)] for x in body]) if few else ("any", None), end + 1
        elif c == "\\" and pattern[at + 1] == "x":
            item, at = ("char", chr(int(pattern[at + 2 : at + 4], 16))), at + 4
        elif c == "\\":
            item, at = (("any", None) if pattern[at + 1].isalnum() else ("char", pattern[at + 1])), at + 2
        elif c in ".^$":
            item, at = ("any", None), at + 1
        else:
            item, at = ("char", c), at + 1
        least, exact = 1, True
        if at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                least, exact, at = int(low or 0), high == "" and "," not in pattern[at:end] or high == low, end + 1
            else:
                least, exact, at = int(pattern[at] == "+"), False, at + 1
            if at < len(pattern) and pattern[at] in "?+":
                at += 1
        seq.append((item, least, exact))
    branches.append(seq)
    return branches, at


Query = frozenset  # of frozensets of trigrams: OR of ANDs; one empty AND means "any text"
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    made = {x | y for x in a for y in b}
    return frozenset(x for x in made if not any(y < x for y in made)) if len(made) <= 64 else a


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _walk(branches) -> tuple[frozenset | None, Query]:
    """The strings a part can be, None if they are many or unknown; and its query."""
    all_strings, query = set(), set()
    known = True
    for seq in branches:
        prefix, q = {""}, ANY
        whole = True  # prefix holds the sequence from its beginning

        def close(strings, q):
            said = frozenset(_grams(s) for s in strings)
            return _and(q, frozenset(x for x in said if not any(y < x for y in said)))

        for item, least, exact in seq:
            if item[0] == "char":
                strings, inner = frozenset([item[1]]), ANY
            elif item[0] == "group":
                strings, inner = _walk(item[1])
            else:
                strings, inner = None, ANY
            if least == 0:
                # there or not, and how often: the query can't see past it
                q, prefix, whole = close(prefix, q), {""}, False
                continue
            if strings is None or len(prefix) * len(strings) > MAX_STRINGS or not exact or least > 1:
                q = _and(close(prefix, q), inner)
                prefix, whole = {""}, False
                continue
            prefix = {p + s for p in prefix for s in strings}
            q = _and(q, inner) if inner != ANY else q
        q = close(prefix, q)
        query |= q
        if whole and len(all_strings | prefix) <= MAX_STRINGS:
            all_strings |= prefix
        else:
            known = False
    return (frozenset(all_strings) if known else None), frozenset(x for x in query if not any(y < x for y in query))


def trigram_query(pattern: str, ignore_case: bool = False) -> Query:
    """The query of a pattern; with ignore_case in lower case, for a lower-cased text."""
    # `x?` becomes (?:x|): at most once, told apart from `x*`
    plain, at = [], 0
    text = pattern.lower() if ignore_case else pattern
    while at < len(text):
        m = re.match(r"(\\x[0-9a-fA-F]{2}|\\.|\[(?:\\.|[^\]])*\]|[^\\\[\](){}|?*+])\?", text[at:])
        if m and not m[1].startswith("["):
            plain.append(f"(?:{m[1]}|)")
            at += m.end()
        elif m:
            plain.append(m[0])
            at += m.end()
        else:
            m = re.match(r"\\x[0-9a-fA-F]{2}|\\.|\[(?:\\.|[^\]])*\]|.", text[at:], re.S)
            plain.append(m[0])
            at += m.end()
    branches, _ = _parse("".join(plain))
    return _walk(branches)[1]


# ---- matching --------------------------------------------------------------------------------------------------------


SPANS = "array<struct<start:int,end:int,kind:int>>"


def _walked(rule: Rule, between: Column, found: Column, size: Column) -> Column:
    """Pieces between matches and the matches themselves follow one another, which gives the places of the matches."""
    kind = RULES.index(rule)
    steps = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), F.zip_with(found, size, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))),
        lambda p, s: F.struct(F.length(p).alias("p"), s.m.alias("m"), s.g.alias("g")),
    )
    span = lambda s, x: F.struct((s.at + x.p).alias("start"), (s.at + x.p + x.m).alias("end"), F.lit(kind).alias("kind"))
    return F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda s, x: F.struct((s.at + x.p + x.m).alias("at"), F.when(x.g >= rule.least, F.concat(s.out, F.array(span(s, x)))).otherwise(s.out).alias("out")),
        lambda s: s.out,
    )


def _matched(df: DataFrame, keep: list[str], rules: list[Rule], name: str) -> DataFrame:
    """keep and, as `name`, the leftmost non-overlapping matches of each rule that pass its length test. With a column
    `kinds` only the rules in it are tried. Each pattern runs in a projection of its own, so once per text and use."""
    # the length test moves into the pattern where a match can't begin inside a shorter one
    pattern = {r: {"[0-9a-f]+": "[0-9a-f]{%d,}" % r.least}.get(r.pattern, r.java) for r in rules}
    tried = {r: F.array_contains("kinds", RULES.index(r)) if "kinds" in df.columns else F.lit(True) for r in rules}
    df = df.select(*keep, "text", *[F.when(tried[r], F.regexp_extract_all("text", F.lit(pattern[r]), F.lit(0))).alias(f"f{i}") for i, r in enumerate(rules)])
    some = [F.size(f"f{i}") > 0 for i in range(len(rules))]
    more = [F.when(some[i], F.split("text", pattern[r], -1)).alias(f"b{i}") for i, r in enumerate(rules)]
    more += [(F.when(some[i], F.regexp_extract_all("text", F.lit(pattern[r]), F.lit(r.group))) if r.group else F.col(f"f{i}")).alias(f"g{i}") for i, r in enumerate(rules)]
    df = df.select(*keep, *[f"f{i}" for i in range(len(rules))], *more)
    each = [F.when(some[i], _walked(r, F.col(f"b{i}"), F.col(f"f{i}"), F.col(f"g{i}"))).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    return df.select(*keep, F.concat(F.array().cast(SPANS), *each).alias(name))


def postings(docs: DataFrame, trigrams: list[tuple[str, bool]], blocks: int) -> DataFrame:
    """block, trigram, ids: the inverted index for some trigrams (text, whether of the lower-cased text)."""
    text, low = F.col("text"), F.lower("text")
    said = F.array_compact(F.array(*[F.when((low if fold else text).contains(t), F.lit(i)) for i, (t, fold) in enumerate(trigrams)]))
    rows = docs.select("key", F.pmod(F.col("key"), F.lit(blocks)).cast("int").alias("block"), F.explode(said).alias("trigram"))
    return rows.groupBy("block", "trigram").agg(F.collect_list("key").alias("keys"))


def candidates(index: DataFrame, rules: list[Rule], trigrams: list[tuple[str, bool]]) -> DataFrame:
    """key, kinds: documents that can match, with the positions in RULES of the rules to try."""
    number = {t: i for i, t in enumerate(trigrams)}
    block = index.groupBy("block").pivot("trigram", list(range(len(trigrams)))).agg(F.first("keys"))
    nothing = F.array().cast("array<bigint>")
    made = []
    for rule in rules:
        union = nothing
        for conjunction in sorted(map(sorted, trigram_query(rule.pattern, rule.ignore_case))):
            lists = [F.coalesce(F.col(f"`{number[t, rule.ignore_case]}`"), nothing) for t in conjunction]
            both = lists[0]
            for x in lists[1:]:
                both = F.array_intersect(both, x)
            union = F.array_union(union, both)
        made.append(F.arrays_zip(union.alias("key"), F.array_repeat(F.lit(RULES.index(rule)), F.size(union)).alias("kind")))
    made = [x.cast("array<struct<key:bigint,kind:int>>") for x in made]
    rows = block.select(F.explode(F.concat(*made)).alias("c")).select("c.key", "c.kind")
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, text hash, spans: array of (start, end, kind), by start, then kind; code points, end exclusive.

    Null text is empty. Rows that share id and text share their spans; null ids are kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # postings hold the key; hits go back to their rows by id and two hashes
    rows = rows.withColumn("key", F.xxhash64("id", "text")).withColumn("second", F.xxhash64(F.lit(2), "text", "id"))
    indexed = [r for r in rules if trigram_query(r.pattern, r.ignore_case) and frozenset() not in trigram_query(r.pattern, r.ignore_case)]
    scanned = [r for r in rules if r not in indexed]
    trigrams = sorted({(t, r.ignore_case) for r in indexed for x in trigram_query(r.pattern, r.ignore_case) for t in x})
    blocks = max(16, stored_bytes(docs, text_col) // BLOCK_BYTES)
    tried = saved(candidates(postings(rows, trigrams, blocks), indexed, trigrams))
    wanted = IdFilter(tried.select("key"))
    met = rows.where(wanted.has(F.col("key"))).select("id", "key", "second", "text").dropDuplicates(["id", "key", "second"]).join(tried, "key")
    hits = _matched(met, ["id", "key", "second"], indexed, "more").where(F.size("more") > 0).withColumnRenamed("id", "hit_id")
    same = F.col("l.id").eqNullSafe(F.col("r.hit_id")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.second") == F.col("r.second"))
    out = _matched(rows, ["id", "key", "second"], scanned, "spans").alias("l").join(hits.alias("r"), same, "left").select("l.id", "l.spans", "r.more")
    empty = F.array().cast(SPANS)
    spans = F.array_sort(F.transform(F.concat("spans", F.coalesce("more", empty)), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start, x.end)), ",")


def op3(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir, "doc_id", "text"))
    base = sum(r.base for r in RULES)
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("bigint")
    counts = [count(k).alias(f"n_{RULES[k].kind}") for k in range(base)]
    said = _said(F.filter("spans", lambda x: x.kind < base))
    return found.select("doc_id", *counts, F.sha2(said, 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in DuckDB: every rule scans every text; (?i) there also folds two letters outside ASCII, which no rule needs."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.java.replace("'", "''")
        parts.append(f"""SELECT doc_id, rn, {k} AS kind, '{r.kind}' AS name, string_split_regex(text, '{p}') AS b, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS g, {r.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS text FROM documents),
r AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, rn, kind, name, least, unnest(range(1, len(m) + 1)) AS i, b, m, g FROM r),
p AS (SELECT doc_id, rn, kind, name, least, length(g[i]) AS glen,
  CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM e),
o AS (SELECT rn, kind, name || ':' || s || ':' || (s + n) AS t, s FROM p WHERE glen >= least),
a AS (SELECT rn, string_agg(t, ',' ORDER BY s, kind) AS spans, string_agg(t, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base,
  count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex FROM o GROUP BY rn)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rn)
"""


SQL3 = _sql()
