"""Queries over the test tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import registry
from ..functions import constraints as C
from ..functions import extract as X
from ..functions import mt, score, stats
from ..functions import text as T
from ..operators import board, builder, items, metrics, records, validators
from ..sources import readers
from . import tables as D

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def rounded(df, *columns, digits: int = 6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def wilson_sql(total: str, n: str) -> tuple[str, str]:
    z, z2 = stats.Z, repr(stats.Z * stats.Z)
    p = f"({total} / CAST({n} AS DOUBLE))"
    denom = f"(1.0::DOUBLE + {z2}::DOUBLE / {n})"
    centre = f"(({p} + {z2}::DOUBLE / (2.0::DOUBLE * {n})) / {denom})"
    half = f"(({z}::DOUBLE / {denom}) * sqrt({p} * (1.0::DOUBLE - {p}) / {n} + {z2}::DOUBLE / (4.0::DOUBLE * {n} * {n})))"
    low, high = f"greatest(0.0::DOUBLE, {centre} - {half}) * 100", f"least(1.0::DOUBLE, {centre} + {half}) * 100"
    return f"CASE WHEN {n} > 0 THEN round({low}, 6) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN round({high}, 6) ELSE 0.0 END"


def _accuracy_sql(by: str, rows: str = "results", extra: str = "") -> str:
    low, high = wilson_sql("correct", "n")
    by_ = f"{by}, " if by else ""
    return f"""SELECT {by_}CASE WHEN n > 0 THEN round(correct / n * 100, 6) ELSE 0.0 END AS accuracy, {low} AS ci_low, {high} AS ci_high, n, n_items, round(n / CAST(n_items AS DOUBLE), 6) AS coverage
  FROM (SELECT {by_}CAST(count(*) FILTER (WHERE {D.SCORABLE}) AS BIGINT) AS n, coalesce(sum(score) FILTER (WHERE {D.SCORABLE}), 0.0) AS correct, count(*) AS n_items FROM {rows} {f'GROUP BY {by}' if by else ''}) {extra}"""


def _accuracy(df):
    return rounded(df.drop("correct"), "accuracy", "ci_low", "ci_high", "coverage")


# ---- statistics ------------------------------------------------------------------------------------------------------


@query("wilson_by_lang", f"WITH {D.RESULTS} {_accuracy_sql('task')}")
def wilson_by_lang(spark, d):
    return _accuracy(metrics.accuracy(D.results(spark, d), "task"))


@query("accuracy_overall", f"WITH {D.RESULTS} {_accuracy_sql('')}")
def accuracy_overall(spark, d):
    return _accuracy(metrics.accuracy(D.results(spark, d)))


@query("breakdown_sets", f"""WITH {D.RESULTS}, e AS (SELECT 'model' AS key, model AS value, status, score FROM results UNION ALL SELECT 'task', task, status, score FROM results)
{_accuracy_sql('key, value', 'e')}""")
def breakdown_sets(spark, d):
    return _accuracy(metrics.breakdown(D.results(spark, d), ["model", "task"]))


@query("chance_normalised", f"""WITH {D.RESULTS}, a AS (SELECT model, avg(score) * 100 AS s FROM results WHERE {D.SCORABLE} GROUP BY model)
SELECT model, round(greatest(0.0, (s / 100.0 - 0.25) / 0.75) * 100, 6) AS normalised FROM a""")
def chance_normalised(spark, d):
    a = D.results(spark, d).where(X.scorable(F.col("status"))).groupBy("model").agg((F.avg("score") * 100).alias("s"))
    return a.select("model", F.round(stats.against_chance(F.col("s"), F.lit(0.25)), 6).alias("normalised"))


@query("minimum_n", "SELECT p_size, CAST(ceil(1.959963985::DOUBLE * 1.959963985::DOUBLE * 0.25 / ((p_size / 100.0::DOUBLE) * (p_size / 100.0::DOUBLE))) AS BIGINT) AS items FROM (SELECT DISTINCT p_size FROM part WHERE p_size > 0)")
def minimum_n(spark, d):
    return D.table(spark, d, "part").where("p_size > 0").select("p_size").distinct().select("p_size", stats.minimum_n(F.col("p_size").cast("double")).alias("items"))


@query("diagnostics", f"""WITH {D.RESULTS} SELECT model, count(*) AS n_items, CAST(count(*) FILTER (WHERE {D.SCORABLE}) AS BIGINT) AS n_scored,
{', '.join(f"round(count(*) FILTER (WHERE status = '{s}') / CAST(count(*) AS DOUBLE), 6) AS {s}_rate" for s in ('unparsed', 'truncated', 'error', 'refusal'))},
round(count(*) FILTER (WHERE {D.SCORABLE}) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM results GROUP BY model""")
def diagnostics(spark, d):
    return rounded(records.diagnostics(D.results(spark, d), "model"), *[f"{s}_rate" for s in ("unparsed", "truncated", "error", "refusal")], "coverage")


@query("strategy_histogram", f"""WITH {D.RESULTS}, c AS (SELECT task, strategy, count(*) AS n, min(ord) AS f FROM results GROUP BY task, strategy)
SELECT task, strategy, n, CAST(row_number() OVER (PARTITION BY task ORDER BY n DESC, f) AS INT) AS position FROM c""")
def strategy_histogram(spark, d):
    return records.strategies(D.results(spark, d), "task")


@query("at_or_below_chance", f"WITH {D.RESULTS} SELECT model, avg(score) * 100 <= 87.0 AS low FROM results WHERE {D.SCORABLE} GROUP BY model")
def at_or_below_chance(spark, d):
    a = D.results(spark, d).where(X.scorable(F.col("status"))).groupBy("model").agg((F.avg("score") * 100).alias("s"))
    return a.select("model", records.at_or_below_chance(F.col("s"), F.lit(0.87)).alias("low"))


_PAIRS = f"{D.RESULTS}, pairs AS (SELECT item_id, ord, model, task, score AS a, CAST(1 - toxic AS DOUBLE) AS b FROM results)"


def _pairs(spark, d):
    return D.results(spark, d).select("item_id", "ord", "model", "task", F.col("score").alias("a"), (1 - F.col("toxic")).cast("double").alias("b"))


@query("mcnemar_counts", f"WITH {_PAIRS} SELECT model, count(*) FILTER (WHERE a > 0 AND b <= 0) AS b, count(*) FILTER (WHERE b > 0 AND a <= 0) AS c FROM pairs GROUP BY model")
def mcnemar_counts(spark, d):
    return metrics.mcnemar_counts(_pairs(spark, d), "model")


@query("mcnemar_exact", f"""WITH {_PAIRS}, k AS (SELECT model, count(*) FILTER (WHERE a > 0 AND b <= 0) AS b, count(*) FILTER (WHERE b > 0 AND a <= 0) AS c FROM pairs GROUP BY model),
t AS (SELECT model, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM k WHERE b + c BETWEEN 0 AND 24),
s AS (SELECT model, b, c, sum(factorial(CAST(b + c AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST(b + c - i AS INT)))) AS tail FROM t GROUP BY model, b, c)
SELECT model, b, c, round(least(1.0::DOUBLE, 2.0 * CAST(tail AS DOUBLE) / pow(2.0, b + c)), 6) AS p_value FROM s""")
def mcnemar_exact(spark, d):
    k = metrics.mcnemar_counts(_pairs(spark, d), "model").where("b + c BETWEEN 0 AND 24")
    return k.select("model", "b", "c", F.round(stats.binomial_tail(F.col("b"), F.col("c")), 6).alias("p_value"))


# erfc by the series of erf, whose terms are all positive; beyond 6 it is 0 to six digits
_ERFC = """CASE WHEN x > 6 THEN 0.0::DOUBLE WHEN x = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 2.0::DOUBLE / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda i:
 exp(2.0::DOUBLE * i * ln(2.0::DOUBLE) + (2.0::DOUBLE * i + 1) * ln(x) + lgamma(i + 1) - lgamma(2 * i + 2) - x * x))) END"""


@query("mcnemar_chi2_p", f"""WITH {_PAIRS}, k AS (SELECT task, count(*) FILTER (WHERE a > 0 AND b <= 0) AS b, count(*) FILTER (WHERE b > 0 AND a <= 0) AS c FROM pairs GROUP BY task),
t AS (SELECT task, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM k WHERE b + c < 25),
s AS (SELECT task, least(1.0::DOUBLE, 2.0 * CAST(sum(factorial(CAST(b + c AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST(b + c - i AS INT)))) AS DOUBLE) / pow(2.0, any_value(b + c))) AS exact FROM t GROUP BY task),
x AS (SELECT task, b, c, CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1.0::DOUBLE, 2.0::DOUBLE) / (b + c) END AS chi2 FROM k), y AS (SELECT *, sqrt(chi2 / 2) AS x FROM x)
SELECT y.task, b, c, round(CASE WHEN b + c = 0 THEN 1.0 WHEN b + c < 25 THEN exact ELSE {_ERFC} END, 6) AS p_value, round(chi2, 6) AS chi2, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS test FROM y LEFT JOIN s USING (task)""")
def mcnemar_chi2_p(spark, d):
    return rounded(metrics.mcnemar_test(_pairs(spark, d), "task"), "p_value", "chi2")


@query("paired_join", f"WITH {_PAIRS} SELECT item_id, a, b FROM pairs")
def paired_join(spark, d):
    p = _pairs(spark, d)
    return metrics.paired(p.select("item_id", F.col("a").alias("score")), p.select("item_id", F.col("b").alias("score")))


@query("paired_bootstrap_rng")
def paired_bootstrap_rng(spark, d):
    return rounded(metrics.paired_bootstrap(_pairs(spark, d)), "delta", "p_value")


_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


@query("bootstrap_hash", f"""WITH {_PAIRS}, e AS (SELECT item_id, a - b AS d, s AS sample, CAST(('0x' || substring(md5('7|' || item_id || '|' || s), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pairs, range(0, 200) t(s)),
w AS (SELECT sample, d, {' + '.join(f'CAST(u >= {p!r}::DOUBLE AS INT)' for p in _POISSON)} AS k FROM e)
SELECT CAST(sample AS INT) AS sample, round(sum(d * k) / sum(k), 6) AS delta FROM w WHERE k > 0 GROUP BY sample""")
def bootstrap_hash(spark, d):
    return rounded(metrics.paired_bootstrap_hashed(_pairs(spark, d), seed=7), "delta")


@query("percentile_positions", """WITH v AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT max(v) FILTER (WHERE k = CAST(floor(0.025::DOUBLE * n) AS BIGINT)) AS low, max(v) FILTER (WHERE k = least(n - 1, CAST(floor(0.975::DOUBLE * n) AS BIGINT))) AS high FROM v""")
def percentile_positions(spark, d):
    return metrics.interval(D.table(spark, d, "orders"), "o_totalprice")


# the number written out to two digits from its binary value
PY_ROUND = lambda x: f"CAST(format('{{:.2f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


@query("py_round_ties", f"""SELECT l_orderkey, l_linenumber, {PY_ROUND('l_extendedprice / 1000 + 0.005')} AS plain, {PY_ROUND('(l_partkey * 10 + 5) / 1000.0::DOUBLE')} AS tie, {PY_ROUND('-l_discount * l_tax / l_quantity')} AS small FROM lineitem""")
def py_round_ties(spark, d):
    two = lambda c: stats.py_round(c, 2)
    price, part = F.col("l_extendedprice").cast("double"), F.col("l_partkey").cast("double")
    small = -(F.col("l_discount").cast("double") * F.col("l_tax").cast("double")) / F.col("l_quantity").cast("double")
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", two(price / 1000.0 + 0.005).alias("plain"), two((part * 10 + 5) / 1000.0).alias("tie"), two(small).alias("small"))


@query("py_round_edge", f"SELECT p_partkey, {PY_ROUND('p_retailprice / 8')} AS r FROM part")
def py_round_edge(spark, d):
    return D.table(spark, d, "part").select("p_partkey", stats.py_round(F.col("p_retailprice") / 8, 2).alias("r"))


# ---- record log ------------------------------------------------------------------------------------------------------


@query("latest_any", "SELECT user_id AS item_id, event_type AS status, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_any(spark, d):
    return records.latest(D.log(spark, d)).select("item_id", "status", "event_id", "value")


@query("latest_non_error", "SELECT user_id AS item_id, event_type AS status, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') WHERE k = 1")
def latest_non_error(spark, d):
    return records.latest_non_error(D.log(spark, d)).select("item_id", "status", "event_id", "value")


@query("resume_pending", "SELECT c_custkey AS item_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def resume_pending(spark, d):
    return records.pending(D.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), records.latest_non_error(D.log(spark, d)))


@query("resume_completed", "SELECT item_id, status FROM (SELECT user_id AS item_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') WHERE k = 1 AND item_id IN (SELECT c_custkey FROM customer)")
def resume_completed(spark, d):
    return records.completed(D.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), records.latest_non_error(D.log(spark, d))).select("item_id", "status")


@query("rescore_inner", "SELECT item_id, CASE WHEN status = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN status = 'error' THEN 0.0 WHEN status = 'view' THEN 1.0 ELSE 0.0 END AS score FROM (SELECT user_id AS item_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND item_id IN (SELECT c_custkey FROM customer)")
def rescore_inner(spark, d):
    known = D.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("view").alias("gold"))
    log = D.log(spark, d)
    out = records.rescore(log, known, lambda df: X.extraction(F.col("status"), "ok", "stored", ""), lambda df: score.choice_score(F.col("x.value"), F.col("gold")))
    return out.select("item_id", "status", "score")


@query("truncation_override", f"WITH {D.RESULTS} SELECT item_id, CASE WHEN status = 'unparsed' AND item_id % 2 = 0 THEN 'truncated' ELSE status END AS status FROM results")
def truncation_override(spark, d):
    r = D.results(spark, d)
    return r.select("item_id", X.truncation(F.col("status"), F.when(F.col("item_id") % 2 == 0, "length").otherwise("stop")).alias("status"))


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS before FROM events")
def rate_window(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    return D.table(spark, d, "events").select("event_id", (F.count("*").over(w) - 1).alias("before"))


_HELD = "CASE WHEN len({0}) < 5 THEN list_append({0}, e.ts) ELSE {0} END"
_KEPT = "list_filter(r.kept, lambda x: x >= e.ts - INTERVAL 1 HOUR)"


@query("rate_limit_stateful", f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, event_id, k, [ts] AS kept, true AS ok FROM e WHERE k = 1 UNION ALL SELECT e.key, e.event_id, e.k, {_HELD.format(_KEPT)}, len({_KEPT}) < 5 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, event_id, ok FROM r""")
def rate_limit_stateful(spark, d):
    from ..streaming.limits import accepted

    e = D.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    return accepted(e)


@query("rate_limit_live", ORACLE["rate_limit_stateful"])
def rate_limit_live(spark, d):
    """The events as a stream. A last row without an id, ages ahead, lets the watermark pass all others."""
    from ..streaming import limits

    schema = "key string, event_id bigint, ts timestamp"
    end = _put(spark, spark.sql("SELECT CAST(NULL AS STRING) AS key, CAST(NULL AS BIGINT) AS event_id, TIMESTAMP '2200-01-01' AS ts").coalesce(1), "parquet")
    e = spark.readStream.schema(D.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    e = e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind, out = "spark.sql.streaming.stateStore.providerClass", end.replace("trip-", "limit-")
    before = spark.conf.get(kind)
    spark.conf.set(kind, limits.ROCKSDB)
    try:
        said = limits.accepted_stream(e.unionByName(spark.readStream.schema(schema).parquet(end)))
        said.writeStream.option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start(out, "parquet").awaitTermination()
    finally:
        spark.conf.set(kind, before)
    return spark.read.schema("key string, event_id bigint, ok boolean").parquet(out)


# ---- text ------------------------------------------------------------------------------------------------------------

_N = f"translate(nfc_normalize(t), '{D._A}', repeat('ʻ', 9))"
_S = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("normalize_text", f"WITH {D.TEXTS} SELECT doc_id, sha256({_N}) AS sha FROM texts")
def normalize_text(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.normalize(F.col("t")), 256).alias("sha"))


@query("homoglyphs", f"WITH {D.TEXTS} SELECT doc_id, sha256(translate({_N}, '{T.CYRILLIC}', '{T.LATIN}')) AS sha FROM texts")
def homoglyphs(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.normalize(F.col("t"), True), 256).alias("sha"))


@query("display_text", f"WITH {D.TEXTS} SELECT doc_id, sha256(replace(regexp_replace(replace({_N}, 'ʻ', chr(1)), '([oOgG])' || chr(1), '\\1ʻ', 'g'), chr(1), 'ʼ')) AS sha FROM texts")
def display_text(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.normalize_display(F.col("t")), 256).alias("sha"))


_KEY = f"trim(regexp_replace(lower(translate(t, '{D._A}', repeat('ʻ', 9))), '{_S}+', ' ', 'g'))"


@query("match_key", f"WITH {D.TEXTS} SELECT doc_id, sha256({_KEY}) AS sha FROM texts")
def match_key(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.match_key_lower(F.col("t")), 256).alias("sha"))


@query("casefold_key")
def casefold_key(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.match_key(F.col("t")), 256).alias("sha"))


@query("strip_apostrophes", f"WITH {D.TEXTS} SELECT doc_id, sha256(replace({_N}, 'ʻ', '')) AS sha FROM texts")
def strip_apostrophes(spark, d):
    return D.texts(spark, d).select("doc_id", F.sha2(T.strip_apostrophes(F.col("t")), 256).alias("sha"))


@query("word_count", f"WITH {D.TEXTS} SELECT doc_id, len(regexp_extract_all({_N}, '[\\p{{L}}\\p{{N}}\\p{{M}}_ʻ]+')) AS words FROM texts")
def word_count(spark, d):
    return D.texts(spark, d).select("doc_id", T.count_words(T.normalize(F.col("t"))).alias("words"))


@query("cyrillic_ratio", f"""WITH {D.TEXTS} SELECT doc_id, regexp_matches(t, '[Ѐ-ӿ]') AS has, round(CASE WHEN len(regexp_extract_all(t, '\\p{{L}}')) = 0 THEN 0.0 ELSE
 len(regexp_extract_all(t, '[Ѐ-ҁҊ-ӿ]')) / CAST(len(regexp_extract_all(t, '\\p{{L}}')) AS DOUBLE) END, 6) AS ratio FROM texts""")
def cyrillic_ratio(spark, d):
    return D.texts(spark, d).select("doc_id", T.has_cyrillic(F.col("t")).alias("has"), F.round(T.cyrillic_ratio(F.col("t")), 6).alias("ratio"))


@query("slug", "SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '-')), ''), 'run') AS name FROM pages")
def slug(spark, d):
    return D.table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("name"))


@query("quoted_terms", f"""WITH q AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([a-z]+), ', '"\\1" ', 'g'), '([a-z]+)\\. ', '«\\1» ', 'g') AS q FROM documents),
f AS (SELECT doc_id, list_transform(regexp_extract_all(q, '["«“„][^"»”“„\n]{{1,80}}["»”]|''[^''\n]{{2,80}}'''), lambda x: regexp_replace(substring(x, 2, length(x) - 2), '^{_S}+|{_S}+$', '', 'g')) AS found FROM q)
SELECT doc_id, array_to_string(list_filter(found, lambda x: length(x) > 0 AND length(x) < 80 AND NOT starts_with(x, chr(92))), '|') AS terms FROM f""")
def quoted_terms(spark, d):
    q = F.regexp_replace(F.regexp_replace("text", "([a-z]+), ", '"$1" '), r"([a-z]+)\. ", "«$1» ")
    return D.table(spark, d, "documents").select("doc_id", F.array_join(T.quoted_terms(q), "|").alias("terms"))


@query("repair_rollup")
def repair_rollup(spark, d):
    t = F.regexp_replace(F.regexp_replace(T.fold_apostrophes(F.col("t")), "the ", "fʻ (the "), " of ", " ʻofʻ ")
    fixed = D.texts(spark, d).select("lang", T.repair(t).alias("r"))
    sums = [F.sum(f"r.{k}").alias(k) for k in ("prime", "quote", "tutuq")]
    return fixed.rollup("lang").agg(*sums)


# ---- extraction ------------------------------------------------------------------------------------------------------

_T = "(think|thinking|reasoning)"
_CLOSED = "regexp_replace(r, '(?is)<think>.*?</think>|<thinking>.*?</thinking>|<reasoning>.*?</reasoning>', ' ', 'g')"
_VISIBLE = f"""visible AS (SELECT *, trim(regexp_replace({_CLOSED}, '(?is)<{_T}>.*$', ' '), ' ' || chr(10)) AS v, regexp_matches({_CLOSED}, '(?is)<{_T}>') AS open FROM responses)"""


@query("strip_reasoning", f"WITH {D.RESPONSES}, {_VISIBLE} SELECT doc_id, v, open FROM visible")
def strip_reasoning(spark, d):
    v, left = X.strip_reasoning(F.col("r"))
    return D.responses(spark, d).select("doc_id", v.alias("v"), left.alias("open"))


_LAST = lambda p, g: f"list_last(regexp_extract_all(u, '{p}', {g}))"
_SHOWN = "substring('ABCDEFGHIJ', 1, CAST(n AS INT))"


def _choice_sql(strict: bool = False) -> str:
    edge, stars, before = (r"(?:[^\p{L}\p{N}]|$)", r"\*\*", r"(?:^|[^\p{L}\p{N}])") if strict else ("", r"\**", "")
    cue = rf"(?i)(?:JAVOB|ANSWER|ОТВЕТ)\s*(?:HISOBLANADI|BO\S*LARDI)?\s*[:\-—]?\s*\**\(?([A-J])\)?\**{edge}"
    boxed, bold = r"(?i)\\BOXED\s*\{\s*([A-J])\s*\}", rf"\*\*\s*\(?([A-J])\)?\s*{stars}"
    among = lambda e: f"CASE WHEN length({e}) = 1 AND contains({_SHOWN}, {e}) THEN {e} END"
    bare = "upper(trim(trim(v, ' ' || chr(10)), ' .)*'))"
    line = "upper(trim(list_last(list_filter(string_split(v, chr(10)), lambda x: length(trim(x)) > 0))))"
    tail = f"nullif(regexp_extract({line}, '{before}\\(?([A-J])\\)?\\s*[.):]?\\s*$', 1), '')"
    label = f"nullif(regexp_extract({line}, '^\\**\\(?([A-J])\\)?\\s*[.):]\\s+\\S', 1), '')"
    return f"""WITH {D.RESPONSES}, {_VISIBLE}, u AS (SELECT *, upper(v) AS u FROM visible),
a AS (SELECT doc_id, r, v, open, {among(bare)} AS s1, {among(_LAST(cue, 1))} AS s2, {among(_LAST(boxed, 1))} AS s3, {among(_LAST(bold, 1))} AS s4, {among(tail)} AS s5, {among(label)} AS s6 FROM u)
SELECT doc_id, CASE WHEN length(trim(r)) = 0 OR length(v) = 0 THEN NULL ELSE coalesce(s1, s2, s3, s4, s5, s6) END AS value,
CASE WHEN length(trim(r)) = 0 THEN 'unparsed' WHEN length(v) > 0 AND coalesce(s1, s2, s3, s4, s5, s6) IS NOT NULL THEN 'ok' WHEN open THEN 'truncated' ELSE 'unparsed' END AS status,
CASE WHEN length(trim(r)) = 0 THEN 'empty' WHEN length(v) = 0 THEN 'reasoning-only' WHEN s1 IS NOT NULL THEN 'bare-letter' WHEN s2 IS NOT NULL THEN 'answer-cue' WHEN s3 IS NOT NULL THEN 'boxed'
 WHEN s4 IS NOT NULL THEN 'bold' WHEN s5 IS NOT NULL THEN 'line-tail' WHEN s6 IS NOT NULL THEN 'option-label' ELSE 'no-match' END AS strategy FROM a"""


@query("extract_choice", _choice_sql())
def extract_choice(spark, d):
    x = D.responses(spark, d).select("doc_id", X.extract_choice(F.col("r"), F.col("n")).alias("x"))
    return x.select("doc_id", "x.value", "x.status", "x.strategy")


@query("extract_choice_strict", _choice_sql(True))
def extract_choice_strict(spark, d):
    x = D.responses(spark, d).select("doc_id", X.extract_choice(F.col("r"), F.col("n"), strict=True).alias("x"))
    return x.select("doc_id", "x.value", "x.status", "x.strategy")


@query("extract_tagged", "SELECT page_id, trim(list_last(regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1))) AS value, CASE WHEN len(regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1)) > 0 THEN 'ok' ELSE 'unparsed' END AS status FROM pages")
def extract_tagged(spark, d):
    x = D.table(spark, d, "pages").select("page_id", X.extract_tagged(F.col("html"), "title").alias("x"))
    return x.select("page_id", "x.value", "x.status")


_BOLDS = "SELECT doc_id, regexp_replace(text, '([a-z]+), ', '**\\1** ', 'g') AS v FROM documents"


@query("extract_bold", f"""WITH b AS ({_BOLDS}), l AS (SELECT doc_id, v, regexp_extract_all(v, '\\*\\*([^*]+)\\*\\*', 1) AS f, coalesce(list_last(list_filter(string_split(v, chr(10)), lambda x: length(trim(x)) > 0)), v) AS line FROM b),
m AS (SELECT *, len(list_distinct(list_transform(regexp_extract_all(line, '\\*\\*([^*]+)\\*\\*', 1), lambda x: lower(trim(x, ' ' || chr(10)))))) > 1 AS many FROM l)
SELECT doc_id, CASE WHEN len(f) = 0 OR many THEN NULL ELSE trim(list_last(f), ' ' || chr(10)) END AS value, CASE WHEN len(f) = 0 THEN 'bold' WHEN many THEN 'bold-ambiguous' ELSE 'bold' END AS strategy FROM m""")
def extract_bold(spark, d):
    v = F.regexp_replace("text", "([a-z]+), ", "**$1** ")
    x = D.table(spark, d, "documents").select("doc_id", X.extract_bold(v).alias("x"))
    return x.select("doc_id", "x.value", "x.strategy")


@query("extract_last_line", """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'Tarjima:' || chr(10) || text WHEN turn % 4 = 3 THEN 'Mana javob:' || chr(10) || chr(10) || text ELSE text END AS r FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, string_split(regexp_replace(trim(r, ' ' || chr(10)), '(?i)^\\s*Tarjima\\s*[:\\-—]?\\s*', ''), chr(10)) AS l FROM a),
c AS (SELECT conv_id, turn, l, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: NOT (length(trim(l[i])) = 0 OR right(rtrim(l[i]), 1) = ':'))), len(l) + 1) AS k FROM b)
SELECT conv_id, turn, nullif(trim(trim(array_to_string(l[k:], chr(10)), ' ' || chr(10)), '"“”'), '') AS value FROM c""")
def extract_last_line(spark, d):
    c = D.table(spark, d, "conversations").where("role = 'assistant'")
    r = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Tarjima:\n"), "text")).when(F.col("turn") % 4 == 3, F.concat(F.lit("Mana javob:\n\n"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.extract_last_line(r, ("Tarjima",))["value"].alias("value"))


@query("extract_response", f"WITH {D.RESPONSES}, {_VISIBLE} SELECT doc_id, CASE WHEN length(v) > 0 THEN v END AS value, CASE WHEN length(v) > 0 THEN 'ok' WHEN open THEN 'truncated' ELSE 'unparsed' END AS status FROM visible")
def extract_response(spark, d):
    x = D.responses(spark, d).select("doc_id", X.extract_response(F.col("r")).alias("x"))
    return x.select("doc_id", "x.value", "x.status")


@query("json_ok", "SELECT event_id, CASE WHEN event_id % 3 < 2 AND json_valid(props) THEN 'ok' ELSE 'unparsed' END AS status FROM events")
def json_ok(spark, d):
    e = D.table(spark, d, "events")
    r = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat("props", F.lit(" so")))
    return e.select("event_id", X.extract_json(r)["status"].alias("status"))


@query("reasoning_parse", """WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ha, yoʻq, ha' WHEN 1 THEN 'Fikr.' || chr(10) || '**ha, no, unknown**' ELSE '<solution>' || 'xa, yes, no' || '</solution>' END AS r, CASE doc_id % 2 WHEN 0 THEN 'web_of_lies_v2' ELSE 'zebra_puzzle' END AS kind FROM documents)
SELECT doc_id, CASE WHEN contains(r, '<solution>') THEN regexp_extract(r, '<solution>(.*)</solution>', 1) WHEN kind = 'web_of_lies_v2' AND contains(r, '**') THEN regexp_extract(r, '\\*\\*(.*)\\*\\*', 1) ELSE list_last(string_split(r, chr(10))) END AS value,
CASE WHEN contains(r, '<solution>') THEN '<solution>' WHEN kind = 'web_of_lies_v2' AND contains(r, '**') THEN 'bold' ELSE 'last-line' END AS strategy FROM a""")
def reasoning_parse(spark, d):
    r = F.when(F.col("doc_id") % 3 == 0, "ha, yoʻq, ha").when(F.col("doc_id") % 3 == 1, "Fikr.\n**ha, no, unknown**").otherwise("<solution>xa, yes, no</solution>")
    kind = F.when(F.col("doc_id") % 2 == 0, "web_of_lies_v2").otherwise("zebra_puzzle")
    x = D.table(spark, d, "documents").select("doc_id", X.extract_reasoning(r, kind, F.lit("ha, yoʻq, ha")).alias("x"))
    return x.select("doc_id", "x.value", "x.strategy")


# ---- scorers ---------------------------------------------------------------------------------------------------------


@query("choice_score", f"WITH {D.CHOICE} SELECT item_id, CASE WHEN gold_index = ord % 4 THEN 1.0 ELSE 0.0 END AS score FROM choice")
def choice_score(spark, d):
    c = D.multiple_choice(spark, d)
    return c.select("item_id", score.choice_score(F.col("gold_index").cast("string"), (F.col("ord") % 4).cast("string")).alias("score"))


@query("score_slots", """WITH a AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:1 + doc_id % 4], lambda x: substring(x, 1, 1)) AS p, list_transform(string_split(text, ' ')[2:2 + doc_id % 4], lambda x: substring(x, 1, 1)) AS g FROM documents),
b AS (SELECT doc_id, len(g) AS n, len(p) AS m, list_sum(list_transform(range(1, len(g) + 1), lambda i: CAST(p[i] IS NOT DISTINCT FROM g[i] AS INT))) AS k FROM a)
SELECT doc_id, CASE WHEN n > 0 AND m = n THEN round((CAST(k = n AS DOUBLE) + k / CAST(n AS DOUBLE)) / 2, 6) ELSE 0.0 END AS score FROM b""")
def score_slots(spark, d):
    w = F.split("text", " ", -1)
    n = (F.col("doc_id") % 4 + 1).cast("int")
    first = lambda a: F.transform(a, lambda x: F.substring(x, F.lit(1), F.lit(1)))
    return D.table(spark, d, "documents").select("doc_id", F.round(score.score_slots(first(F.slice(w, F.lit(1), n)), first(F.slice(w, F.lit(2), n))), 6).alias("score"))


_SAYS = ("Ha.", "yo'q", "YOQ", "Nomaʼlum", "noaniq!", "balki", "xa", "unknown", "Yo‘q")


@query("yes_no", f"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 5 THEN NULL WHEN 6 THEN 'yes' WHEN 7 THEN 'unknown' ELSE 'no' END AS said FROM documents""")
def yes_no(spark, d):
    says = F.array(*[F.lit(x) for x in _SAYS])
    return D.table(spark, d, "documents").select("doc_id", score.yes_no(F.get(says, (F.col("doc_id") % 9).cast("int")), T.match_key_lower).alias("said"))


@query("inflection_match", """WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents), s AS (SELECT w, stem FROM w, (VALUES ('the'), ('th'), ('an'), ('er'), ('le'), ('de')) t(stem))
SELECT w, stem FROM s WHERE starts_with(w, stem) AND length(w) > length(stem) AND regexp_matches(substring(w, length(stem) + 1), '^(lar)?(imiz|ingiz|lari|im|ing|si|i)?(niki|ning|dan|day|dek|ga|ka|qa|da|ni|cha)?$')""")
def inflection_match(spark, d):
    w = D.table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ", -1)).alias("w")).distinct()
    s = w.select("w", F.explode(F.array(*[F.lit(x) for x in ("the", "th", "an", "er", "le", "de")])).alias("stem"))
    return s.where(score.is_inflection(F.col("w"), F.col("stem")))


@query("answer_matches", """SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS fits FROM documents""")
def answer_matches(spark, d):
    says = F.array(*[F.lit(x) for x in ("Ko'zlarim", "Javob: koz", "Bu ko‘zni!", "ko'zoynak", "Menimcha KOʻZ", "")])
    accepted = F.array(F.lit("koʻz"))
    return D.table(spark, d, "documents").select("doc_id", score.matches(F.get(says, (F.col("doc_id") % 6).cast("int")), accepted, T.match_key_lower).alias("fits"))


@query("reasoning_score")
def reasoning_score(spark, d):
    says = F.array(*[F.lit(x) for x in ("ha, yo'q, noaniq", "tetraedrlar", "Javob 10,5", "olma,  nok , uzum")])
    gold = F.array(*[F.lit(x) for x in ("ha, yoʻq, ha", "tetraedr", "10.5", "olma, anor, uzum")])
    kind = F.array(*[F.lit(x) for x in ("web_of_lies_v2", "spatial", "spatial", "zebra_puzzle")])
    k = (F.col("doc_id") % 4).cast("int")
    return D.table(spark, d, "documents").select("doc_id", score.reasoning_score(F.get(says, k), F.get(gold, k), F.get(kind, k), T.match_key_lower).alias("score"))


# ---- constraints -----------------------------------------------------------------------------------------------------

_DOCS = "docs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || '- ') ELSE '\"' || text || '\"' END AS v FROM documents)"


def _docs(spark, d):
    t = F.col("text")
    v = F.when(F.col("doc_id") % 2 == 0, F.replace(t, F.lit("\n"), F.lit("\n\n"))).when(F.col("doc_id") % 3 == 0, F.replace(t, F.lit("\n"), F.lit("\n- "))).otherwise(F.concat(F.lit('"'), t, F.lit('"')))
    return D.table(spark, d, "documents").select("doc_id", v.alias("v"))


_LOWER = f"trim(regexp_replace(lower(translate(v, '{D._A}', repeat('ʻ', 9))), '{_S}+', ' ', 'g'))"
_PARTS = f"list_filter(list_transform(CASE WHEN contains(v, '***') THEN string_split(v, '***') ELSE string_split_regex(v, '\\n\\s*\\n') END, lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: length(x) > 0)"
_TWO = _PARTS.replace("""CASE WHEN contains(v, '***') THEN string_split(v, '***') ELSE string_split_regex(v, '\\n\\s*\\n') END""", "string_split(v, repeat('*', 6))")
_FIRST = f"string_split_regex(({_PARTS})[2], '{_S}+')[1]"
#: name -> (arguments, SQL of the test)
CHECKED = {
    "punctuation:no_comma": ({}, "NOT regexp_matches(v, '[,،、，]')"),
    "detectable_format:number_bullet_lists": ({"num_bullets": ["3.0"]}, "len(regexp_extract_all(v, '(?m)^\\s*[*\\-•]\\s+\\S')) = 3"),
    "detectable_format:number_highlighted_sections": ({"num_highlights": ["1"]}, "len(regexp_extract_all(v, '\\*{1,2}[^\\n*]+\\*{1,2}')) >= 1"),
    "detectable_format:title": ({}, "regexp_matches(v, '<<[^\\n]+>>')"),
    "detectable_content:number_placeholders": ({"num_placeholders": ["1"]}, "len(regexp_extract_all(v, '\\[[^\\[\\]]*\\]')) >= 1"),
    "length_constraints:number_paragraphs": ({"num_paragraphs": ["2"]}, f"len({_PARTS}) = 2"),
    "startend:quotation": ({}, "length(trim(v, ' ' || chr(10))) >= 2 AND left(trim(v, ' ' || chr(10)), 1) IN ('\"', '«', '“') AND right(trim(v, ' ' || chr(10)), 1) IN ('\"', '»', '”')"),
    "length_constraints:number_words": ({"num_words": ["120"], "relation": ["less than"]}, f"len(regexp_extract_all(translate(v, '{D._A}', repeat('ʻ', 9)), '[\\p{{L}}\\p{{N}}\\p{{M}}_ʻ]+')) < 120"),
    "length_constraints:number_sentences": ({"num_sentences": ["5"], "relation": ["at most"]}, "len(list_filter(string_split_regex(regexp_replace(trim(v, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ' || chr(10))) > 0)) <= 5"),
    "keywords:existence": ({"keywords": ["The", "of"]}, f"contains({_LOWER}, 'the') AND contains({_LOWER}, 'of')"),
    "keywords:frequency": ({"keyword": ["the"], "frequency": ["4"], "relation": ["more than"]}, f"(length({_LOWER}) - length(replace({_LOWER}, 'the', ''))) / 3 > 4"),
    "keywords:forbidden_words": ({"forbidden_words": ["wher", "eines"]}, f"NOT regexp_matches({_LOWER}, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(wher|eines)')"),
    "startend:end_checker": ({"end_phrase": ["The."]}, f"suffix(rtrim({_LOWER}, ' .!?'), 'the')"),
    "combination:repeat_prompt": ({"prompt_to_repeat": ["An"]}, f"starts_with({_LOWER}, 'an')"),
    "combination:two_responses": ({}, f"len({_TWO}) = 2 AND {_LOWER.replace('translate(v', f'translate(({_TWO})[1]')} <> {_LOWER.replace('translate(v', f'translate(({_TWO})[2]')}"),
    "detectable_content:postscript": ({"postscript_marker": ["e.a."]}, "regexp_matches(v, '(?i)(^|[^\\p{L}\\p{N}_])e\\.\\s*a\\.')"),
    "detectable_format:multiple_sections": ({"section_spliter": ["erth"], "num_sections": ["1"]}, "len(regexp_extract_all(v, '(?i)erth\\s?\\d+')) >= 1"),
    "detectable_format:constrained_response": ({"allowed_responses": ["in the", "de la"]}, f"contains({_LOWER}, 'in the') OR contains({_LOWER}, 'de la')"),
    "length_constraints:nth_paragraph_first_word": ({"first_word": ["the"], "nth_paragraph": ["2"]}, f"coalesce(len({_PARTS}) >= 2 AND trim({_LOWER.replace('translate(v', f'translate(({_FIRST})')}, '.,!?;:\"' || chr(39)) = 'the', false)"),
    "detectable_format:json_format": ({}, f"coalesce(json_valid(regexp_replace(v, '^{_S}+|{_S}+$', '', 'g')), false)"),
}


def kw_literal(kw: dict) -> object:
    empty = F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[y for k, v in kw.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))]) if kw else empty


def _checker_query(name: str, kw: dict, sql: str | None):
    key = "checker_" + name.split(":")[1]

    def run(spark, d):
        return _docs(spark, d).select("doc_id", C.check(F.lit(name), F.col("v"), kw_literal(kw), (name,)).alias("fits"))

    query(key, f"WITH {_DOCS} SELECT doc_id, {sql} AS fits FROM docs" if sql else None)(run)


for _name, (_kw, _sql) in CHECKED.items():
    _checker_query(_name, _kw, _sql)


@query("loose_variants", f"WITH {_DOCS}, l AS (SELECT doc_id, v, string_split(v, chr(10)) AS l FROM docs) SELECT doc_id, sha256(CASE WHEN len(l) > 1 THEN array_to_string(l[2:], chr(10)) ELSE v END) AS no_first, sha256(CASE WHEN len(l) > 1 THEN array_to_string(l[1:len(l) - 1], chr(10)) ELSE v END) AS no_last, sha256(regexp_replace(v, '\\*+', '', 'g')) AS plain FROM l")
def loose_variants(spark, d):
    v = C.loose_variants(F.col("v"))
    return _docs(spark, d).select("doc_id", *[F.sha2(F.get(v, F.lit(i)), 256).alias(n) for i, n in ((2, "no_first"), (3, "no_last"), (1, "plain"))])


_NAMES = ("punctuation:no_comma", "length_constraints:number_paragraphs", "startend:quotation", "keywords:existence", "keywords:letter_frequency", "some:unknown", "language:response_language")


def _asked(spark, d):
    """item_id, response, constraints."""
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("name"), kw_literal(CHECKED.get(n, ({"language": ["ru"]},))[0]).cast("map<string,array<string>>").alias("kw")) for i, n in enumerate(_NAMES)])
    asked = F.transform(rows, lambda c: c.withField("localised", F.col("doc_id") % 2 == 0))
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("item_id"), F.col("v").alias("response"), asked.alias("constraints"))


def _grid(spark, d):
    return _asked(spark, d).select("item_id", "response", F.inline("constraints"))


def _variants_sql() -> str:
    plain, first, end = "regexp_replace({}, '\\*+', '', 'g')", "CASE WHEN contains({0}, chr(10)) THEN substring({0}, instr({0}, chr(10)) + 1) ELSE {0} END", "regexp_replace({}, '\\n[^\\n]*\\z', '')"
    c, f, e, b = "v", first.format("v"), end.format("v"), first.format(f"({end.format('v')})")
    return ", ".join([c, c, plain.format(c), f, e, b, *(plain.format(f"({x})") for x in (f, e, b))])


def _judged_sql() -> str:
    """item_id, at, name, outcome, strict, loose, reason of the grid."""
    asked = {0: "punctuation:no_comma", 1: "length_constraints:number_paragraphs", 2: "startend:quotation", 3: "keywords:existence"}
    fits = ", ".join(f"coalesce({CHECKED[n][1]}, false) AS f{k}" for k, n in asked.items())
    both = ", ".join(f"bool_or(variant = 0 AND f{k}) AS s{k}, bool_or(f{k} AND (variant = 0 OR length(v) > 0)) AS l{k}" for k in asked)
    rows = [f"SELECT CAST(doc_id AS VARCHAR) AS item_id, {k} AS \"at\", '{n}' AS name, CASE WHEN s{k} THEN 'pass' ELSE 'fail' END AS outcome, s{k} AS strict, l{k} AS loose, CAST(NULL AS VARCHAR) AS reason FROM j{' WHERE doc_id % 2 = 0' if k == 3 else ''}" for k, n in asked.items()]
    out = ((3, asked[3], "kwargs-not-localised", " WHERE doc_id % 2 <> 0"), (4, "keywords:letter_frequency", "not-meaningful-in-uzbek", ""), (5, "some:unknown", "unregistered", ""), (6, "language:response_language", "language:response_language needs a detector", ""))
    rows += [f"SELECT CAST(doc_id AS VARCHAR), {k}, '{n}', 'excluded', NULL, NULL, '{why}' FROM j{where}" for k, n, why, where in out]
    return f"""WITH {_DOCS}, raw AS (SELECT doc_id, unnest(range(0, 9)) AS variant, unnest([{_variants_sql()}]) AS x FROM docs), texts AS (SELECT doc_id, variant, regexp_replace(x, '^{_S}+|{_S}+\\z', '', 'g') AS v FROM raw),
t AS (SELECT doc_id, variant, v, {fits} FROM texts), j AS (SELECT doc_id, {both} FROM t GROUP BY doc_id), judged AS ({' UNION ALL '.join(rows)})"""


def _grid_sql() -> str:
    low, high = wilson_sql("ps", "n")
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / CAST({b} AS DOUBLE) * 100, 6) ELSE 0.0 END"
    return f"""{_judged_sql()}, i AS (SELECT item_id, count(*) AS a, count(*) FILTER (WHERE outcome <> 'excluded') AS n, count(*) FILTER (WHERE strict) AS s, count(*) FILTER (WHERE loose) AS l FROM judged GROUP BY item_id),
w AS (SELECT count(*) FILTER (WHERE n > 0) AS n, count(*) FILTER (WHERE n > 0 AND s = n) AS ps, count(*) FILTER (WHERE n > 0 AND l = n) AS pl, CAST(sum(n) AS BIGINT) AS e, CAST(sum(a) AS BIGINT) AS a, CAST(sum(s) AS BIGINT) AS s, CAST(sum(l) AS BIGINT) AS l FROM i)
SELECT {share('ps', 'n')} AS prompt_strict, {low} AS ci_low, {high} AS ci_high, {share('pl', 'n')} AS prompt_loose, {share('s', 'e')} AS inst_strict, {share('l', 'e')} AS inst_loose, n, e AS constraints_evaluated, a - e AS constraints_excluded, {share('e', 'a')} AS coverage_percent FROM w"""


@query("ifeval_evaluate", f"{_judged_sql()} SELECT * FROM judged")
def ifeval_evaluate(spark, d):
    return C.evaluate(_asked(spark, d), names=_NAMES)


@query("constraint_grid", _grid_sql())
def constraint_grid(spark, d):
    df = metrics.constraint_summary(C.evaluate(_asked(spark, d), names=_NAMES))
    return rounded(df, "prompt_strict", "prompt_loose", "ci_low", "ci_high", "inst_strict", "inst_loose", "coverage_percent")


@query("ifeval_task", _grid_sql())
def ifeval_task(spark, d):
    """The task from dataset rows, whose arguments are JSON of mixed types, over items and responses to its rates."""
    task = registry.Instructions()
    docs = _docs(spark, d)
    names = ("punctuation:no_comma", "length_constraints:number_paragraphs", "startend:quotation", "keywords:existence", "keywords:letter_frequency", "some:unknown", "language:response_language")
    even = F.col("doc_id") % 2 == 0
    paragraphs = F.when(F.col("doc_id") % 3 == 0, '2.0').when(F.col("doc_id") % 3 == 1, '"2"').otherwise('["2"]')
    kwargs = F.concat(F.lit('[null, {"num_paragraphs": '), paragraphs, F.lit(', "keywords": null}, {}, {"keywords": "never used"}, {"letter": "a"}, {}, {"language": "uz"}]'))
    local = F.when(even, '[{}, {}, {}, {"keywords": ["The", "of"]}]')
    rows = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("key"), F.lit("p").alias("prompt_uz"), F.array(*[F.lit(x) for x in names]).alias("instruction_id_list"), kwargs.alias("kwargs"), local.alias("kwargs_uz"))
    responses = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("v").alias("text"), F.lit("stop").alias("finish_reason"), F.lit(None).cast("string").alias("error"))
    df = metrics.constraint_summary(task.constraints(task.results(task.items(task.shaped(rows)), responses)))
    return rounded(df, "prompt_strict", "prompt_loose", "ci_low", "ci_high", "inst_strict", "inst_loose", "coverage_percent")


@query("constraint_by_type", f"{_judged_sql()} SELECT name, count(*) AS n, round(count(*) FILTER (WHERE strict) / CAST(count(*) AS DOUBLE) * 100, 6) AS strict, round(count(*) FILTER (WHERE loose) / CAST(count(*) AS DOUBLE) * 100, 6) AS loose FROM judged WHERE outcome <> 'excluded' GROUP BY name HAVING count(*) >= 15")
def constraint_by_type(spark, d):
    return rounded(metrics.by_instruction(C.evaluate(_asked(spark, d), names=_NAMES)), "strict", "loose")


@query("exclusion_reasons", f"""WITH {_DOCS} SELECT reason, count(*) AS n FROM (SELECT 'not-meaningful-in-uzbek' AS reason FROM docs UNION ALL SELECT 'unregistered' FROM docs UNION ALL SELECT 'language:response_language needs a detector' FROM docs UNION ALL SELECT 'kwargs-not-localised' FROM docs WHERE doc_id % 2 <> 0) GROUP BY reason""")
def exclusion_reasons(spark, d):
    return metrics.exclusion_reasons(C.with_reasons(_grid(spark, d)))


# ---- items and validators --------------------------------------------------------------------------------------------

_ITEMS = f"{D.CHOICE}, kept AS (SELECT * FROM choice WHERE gold_index IS NOT NULL AND gold_index < len(options))"


def _kept(spark, d):
    return D.multiple_choice(spark, d).where(F.col("gold_index").isNotNull() & (F.col("gold_index") < F.size("options")))


@query("mcq_items", f"WITH {_ITEMS} SELECT item_id, question, array_to_string(options, '|') AS options, substring('ABCDEFGHIJ', gold_index + 1, 1) AS gold FROM kept")
def mcq_items(spark, d):
    c = D.multiple_choice(spark, d).withColumn("id", F.col("item_id"))
    out = items.choice_items(c, F.col("options"), F.col("gold_index"), F.col("question"), F.create_map(F.lit("brand"), F.get("options", F.lit(0))))
    return out.select("item_id", "question", F.array_join("options", "|").alias("options"), "gold")


@query("dtm_items", f"""WITH p AS (SELECT p_partkey AS ord, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS s, CASE p_partkey % 6 WHEN 0 THEN ' a' WHEN 1 THEN 'D' WHEN 2 THEN '' WHEN 3 THEN 'BC' WHEN 4 THEN 'E' ELSE NULL END AS k FROM part)
SELECT CAST(ord AS VARCHAR) AS item_id, CASE WHEN trim(k) = '' THEN 'A' ELSE substring('ABCD', instr('ABCD', upper(trim(k))), 1) END AS gold FROM p WHERE k IS NOT NULL AND (trim(k) = '' OR instr('ABCD', upper(trim(k))) > 0)""")
def dtm_items(spark, d):
    key = F.when(F.col("p_partkey") % 6 == 0, " a").when(F.col("p_partkey") % 6 == 1, "D").when(F.col("p_partkey") % 6 == 2, "").when(F.col("p_partkey") % 6 == 3, "BC").when(F.col("p_partkey") % 6 == 4, "E")
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_brand").alias("option_A"), F.col("p_type").alias("option_B"), F.col("p_size").alias("option_C"), F.lit(None).cast("string").alias("option_D"), key.alias("answer"), F.col("p_type").alias("subject"))
    return items.dtm_items(rows).select("item_id", "gold")


@query("parse_options", """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_brand || '|' || p_type || '|' || p_name END AS options FROM part""")
def parse_options(spark, d):
    k = F.col("p_partkey") % 4
    parts = F.array("p_brand", "p_type", "p_name")
    cell = F.when(k == 0, F.to_json(parts)).when(k == 1, F.concat(F.lit("['"), F.array_join(parts, "'\n '"), F.lit("']"))).when(k == 2, F.concat(F.lit("["), F.array_join(parts, "\n\n"), F.lit("]"))).otherwise(F.lit("  "))
    return D.table(spark, d, "part").select("p_partkey", F.array_join(items.parse_options(cell), "|").alias("options"))


@query("translation_fanout", """WITH t AS (SELECT doc_id, text AS uz, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS en, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS ru, CASE WHEN doc_id % 4 = 0 THEN 'train' WHEN doc_id % 4 = 1 THEN ' DevTest ' ELSE NULL END AS split FROM documents),
k AS (SELECT * FROM t WHERE coalesce(trim(split), '') = '' OR lower(trim(split)) = 'devtest'),
a AS (SELECT doc_id, 'uz_en' AS direction, uz AS s, en AS t FROM k UNION ALL SELECT doc_id, 'en_uz', en, uz FROM k UNION ALL SELECT doc_id, 'uz_ru', uz, ru FROM k UNION ALL SELECT doc_id, 'ru_uz', ru, uz FROM k)
SELECT doc_id || ':' || direction AS item_id, direction, length(s) AS source_chars FROM a WHERE coalesce(s, '') <> '' AND coalesce(t, '') <> ''""")
def translation_fanout(spark, d):
    rows = D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.col("text").alias("text_uz"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("text_en"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("text_ru"), F.when(F.col("doc_id") % 4 == 0, "train").when(F.col("doc_id") % 4 == 1, " DevTest ").alias("split"))
    return items.translation_items(rows, splits=("devtest",)).select("item_id", "direction", F.length("source").cast("bigint").alias("source_chars"))


@query("kwargs_overlay", """SELECT CAST(p_partkey AS VARCHAR) AS item_id, k AS "at", CASE WHEN k = 0 AND p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS keyword, k = 0 AND p_partkey % 2 = 0 AS localised FROM part, (VALUES (0), (1)) t(k)""")
def kwargs_overlay(spark, d):
    m = lambda c: F.create_map(F.lit("keyword"), F.array(c), F.lit("relation"), F.lit(None).cast("array<string>"))
    empty = F.create_map().cast("map<string,array<string>>")
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("key"), F.col("p_name").alias("prompt"), F.lit(None).cast("string").alias("prompt_uz"), F.array(F.lit("keywords:frequency"), F.lit("keywords:frequency")).alias("instruction_id_list"),
                                            F.array(m(F.col("p_brand")), m(F.col("p_brand"))).alias("kwargs"), F.array(F.when(F.col("p_partkey") % 2 == 0, m(F.col("p_type"))).otherwise(empty)).alias("kwargs_uz"))
    return items.constraint_rows(rows).select("item_id", "at", C.text_arg(F.col("kw"), "keyword").alias("keyword"), "localised")


@query("reasoning_items", """SELECT left(CAST(doc_id AS VARCHAR) || '-abcdefghijklmnopqrstuvwxyz', 16) AS item_id, lang AS gold FROM documents WHERE doc_id % 4 < 3 AND doc_id % 5 <> 0""")
def reasoning_items(spark, d):
    kind = F.get(F.array(*[F.lit(x) for x in (*items.REASONING, "other")]), (F.col("doc_id") % 4).cast("int"))
    rows = D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit("-abcdefghijklmnopqrstuvwxyz")).alias("question_id"), kind.alias("task"), F.array(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))).alias("turns"), F.array().cast("array<string>").alias("turns_in_uzbek"), F.lit("").alias("ground_truth_uzbek"), F.concat(F.lit(" "), "lang").alias("ground_truth"))
    return items.reasoning_items(rows).select("item_id", "gold")


@query("permute_hash", f"""WITH {_ITEMS}, e AS (SELECT item_id, gold_index, unnest(range(0, len(options))) AS i, options FROM kept), o AS (SELECT item_id, gold_index, i, options[CAST(i + 1 AS INT)] AS o, md5('3|' || item_id || '|' || i) AS h FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h, i) - 1 AS k FROM o) SELECT item_id, string_agg(o, '|' ORDER BY k) AS options, CAST(max(k) FILTER (WHERE i = gold_index) AS INT) AS gold_index FROM r GROUP BY item_id""")
def permute_hash(spark, d):
    return items.permute_hashed(_kept(spark, d), 3).select("item_id", F.array_join("options", "|").alias("options"), "gold_index")


@query("permute_rng")
def permute_rng(spark, d):
    return items.permute_seeded(_kept(spark, d), 42).select("item_id", F.array_join("options", "|").alias("options"), "gold_index", "gold")


@query("cyclic_variants", f"""WITH {_ITEMS}, e AS (SELECT item_id, gold_index, options, CAST(unnest(range(0, len(options))) AS INT) AS shift FROM kept)
SELECT item_id, shift, array_to_string(list_concat(options[shift + 1:], options[1:shift]), '|') AS options, CAST((gold_index - shift + len(options)) % len(options) AS INT) AS gold_index FROM e""")
def cyclic_variants(spark, d):
    return items.cyclic_variants(_kept(spark, d)).select("item_id", "shift", F.array_join("options", "|").alias("options"), "gold_index")


@query("mcq_prompt", f"""WITH {_ITEMS} SELECT item_id, 'Savolga bitta harf bilan javob bering.' || chr(10) || chr(10) || 'Savol: ' || question || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(options) + 1), lambda i: substring('ABCDEFGHIJ', i, 1) || ') ' || options[i]), chr(10)) || chr(10) || chr(10) || 'Javob:' AS prompt FROM kept""")
def mcq_prompt(spark, d):
    return _kept(spark, d).select("item_id", items.choice_prompt(F.col("question"), F.col("options")).alias("prompt"))


@query("accepted_forms", "SELECT p_partkey AS ord, p_name || '|' || p_type AS forms FROM part")
def accepted_forms(spark, d):
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.array("p_name", F.upper("p_name"), F.lit(" "), "p_type").alias("accepted"), F.initcap("p_name").alias("answer"))
    return items.accepted_forms(rows).select("ord", F.array_join("forms", "|").alias("forms"))


@query("riddle_choice", """WITH o AS (SELECT p_partkey, [p_name, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE CAST(p_size AS VARCHAR) END] AS o FROM part),
k AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, o FROM o WHERE len(list_distinct(list_transform(o, lambda x: trim(lower(x))))) = 4),
h AS (SELECT item_id, unnest(o) AS x, unnest([0, 1, 2, 3]) AS i FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5('1|' || item_id || '|' || i), i) AS place FROM h)
SELECT item_id, string_agg(x, '|' ORDER BY place) AS options, substring('ABCD', CAST(max(place) FILTER (WHERE i = 0) AS INT), 1) AS gold FROM r GROUP BY item_id""")
def riddle_choice(spark, d):
    rows = D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("riddle"), F.array("p_name").alias("accepted"), F.lit("").alias("answer"), F.array("p_brand", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_size").cast("string"))).alias("distractors"), F.lit("t").alias("theme"), F.lit("e").alias("difficulty"))
    return items.permute_hashed(items.riddle_choice_items(rows), 1).select("item_id", F.array_join("options", "|").alias("options"), "gold")


@query("item_limit", f"WITH {_ITEMS} SELECT item_id FROM kept ORDER BY ord LIMIT 25")
def item_limit(spark, d):
    return items.limited(_kept(spark, d), 25).select("item_id")


@query("validate_mcq", f"""WITH {D.CHOICE} SELECT item_id AS row_id, 'empty option text' AS problem FROM choice WHERE len(list_filter(options, lambda o: length(trim(o)) = 0)) > 0
UNION ALL SELECT item_id, 'duplicate option text' FROM choice WHERE len(list_distinct(options)) < len(options) UNION ALL SELECT item_id, 'missing or invalid answer key' FROM choice WHERE gold_index IS NULL
UNION ALL SELECT item_id, 'answer index ' || gold_index || ' out of ' || len(options) FROM choice WHERE gold_index >= len(options)""")
def validate_mcq(spark, d):
    c = D.multiple_choice(spark, d)
    return validators.choice_problems(c, F.col("item_id"), F.col("options"), F.col("gold_index"))


@query("validate_lengths", "SELECT CAST(doc_id AS VARCHAR) AS row_id, 'translation much shorter than the original' AS problem FROM documents WHERE length(source) > 0 AND length(source) < 0.35 * length(text)")
def validate_lengths(spark, d):
    rows = D.table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.col("source").alias("question_uzb"), F.lit("['a' 'b']").alias("options"), F.lit('["a", "b"]').alias("options_uzb"))
    return validators.translated_problems(rows, F.col("doc_id"))


@query("validate_reasoning", """SELECT CAST(doc_id AS VARCHAR) AS row_id, problem FROM (SELECT doc_id, 'no Uzbek ground truth' AS problem FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'ground truth not translated' FROM documents WHERE doc_id % 6 = 1
UNION ALL SELECT doc_id, 'slot counts differ' FROM documents WHERE doc_id % 6 = 2 UNION ALL SELECT doc_id, 'slots other than yes, no, unknown' FROM documents WHERE doc_id % 6 = 3)""")
def validate_reasoning(spark, d):
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % 6).cast("int"))
    rows = D.table(spark, d, "documents").select("doc_id", pick("zebra_puzzle", "zebra_puzzle", "spatial", "web_of_lies_v2", "web_of_lies_v2", "zebra_puzzle").alias("task"), pick("", "red, blue", "a, b", "ha, balki", "ha, yo'q", "10, 20").alias("ground_truth_uzbek"), pick("x", "red, blue", "a", "yes, no", "yes, no", "10, 20").alias("ground_truth"))
    return validators.reasoning_problems(rows, F.col("doc_id"))


@query("validate_translation", "SELECT CAST(doc_id AS VARCHAR) AS row_id, 'missing ' || CASE doc_id % 4 WHEN 1 THEN 'text_en' ELSE 'text_en, text_uz' END AS problem FROM documents WHERE doc_id % 4 IN (1, 2)")
def validate_translation(spark, d):
    k = F.col("doc_id") % 4
    rows = D.table(spark, d, "documents").select("doc_id", F.when(k < 2, F.col("text")).alias("text_uz"), F.when(k == 0, "x").otherwise(" ").alias("text_en"), F.when(k == 3, "s").alias("source"), F.when(k == 3, "r").alias("reference"))
    return validators.translation_problems(rows, F.col("doc_id"), ("uz_en",))


@query("validate_duplicates", """WITH k AS (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS b FROM part) SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'duplicate of ' || b AS problem FROM k WHERE b IS NOT NULL
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'distractor is an answer: ' || p_type FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 7 = 0 AND lower(p_type) = string_split(p_name, ' ')[1]) UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'answer in the riddle: ' || CASE WHEN p_partkey % 5 = 0 AND list_contains(string_split(p_name, ' '), lower(p_type)) THEN lower(p_type) ELSE string_split(p_name, ' ')[1] END FROM part WHERE p_partkey % 7 = 0 OR (p_partkey % 5 = 0 AND list_contains(string_split(p_name, ' '), lower(p_type)))""")
def validate_duplicates(spark, d):
    k = F.col("p_partkey")
    forms = F.array(F.when(k % 5 == 0, F.col("p_type")).otherwise(F.lit("zzz")), F.when(k % 7 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise(F.lit("yyy")))
    rows = D.table(spark, d, "part").select(k.alias("ord"), k.alias("id"), F.col("p_name").alias("riddle"), forms.alias("accepted"), F.lit("").alias("answer"), F.array("p_type").alias("distractors"))
    return validators.riddle_problems(rows)


@query("validate_constraints", "SELECT * FROM (VALUES ('keywords:existence', '200 constraints without local arguments'), ('no:such', '200 constraints with an unregistered id')) t(row_id, problem)")
def validate_constraints(spark, d):
    empty = F.array().cast("array<map<string,array<string>>>")
    rows = spark.range(200).select(F.col("id").alias("ord"), F.col("id").alias("key"), F.lit("p").alias("prompt"), F.lit("p").alias("prompt_uz"), F.array(F.lit("keywords:existence"), F.lit("no:such")).alias("instruction_id_list"), empty.alias("kwargs"), empty.alias("kwargs_uz"))
    return validators.constraint_problems(rows)


@query("problems_shown", f"""WITH {D.CHOICE}, p AS (SELECT item_id AS row_id, 'missing or invalid answer key' AS problem FROM choice WHERE gold_index IS NULL UNION ALL SELECT item_id, 'duplicate option text' FROM choice WHERE len(list_distinct(options)) < len(options)),
r AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY row_id) AS position, count(*) OVER (PARTITION BY problem) AS n FROM p) SELECT row_id, problem, CAST(position AS INT) AS position, greatest(n - 3, 0) AS more FROM r WHERE position <= 3""")
def problems_shown(spark, d):
    c = D.multiple_choice(spark, d)
    p = validators.choice_problems(c, F.col("item_id"), F.col("options"), F.col("gold_index")).where("problem IN ('missing or invalid answer key', 'duplicate option text')")
    return validators.shown(p, 3, "problem").select("row_id", "problem", "position", "more")


# ---- translation metrics ---------------------------------------------------------------------------------------------


def _chars_sql(side: str) -> str:
    return f"SELECT seg, n, substring(s, CAST(i AS INT), CAST(n AS INT)) AS g FROM (SELECT seg, n, s, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT seg, regexp_replace({side}, '\\s+', '', 'g') AS s FROM turns), range(1, 7) t(n))"


@query("chrf_stats", f"""WITH {D.TURNS}, h AS (SELECT seg, n, g, count(*) AS c FROM ({_chars_sql('hyp')}) GROUP BY seg, n, g), r AS (SELECT seg, n, g, count(*) AS c FROM ({_chars_sql('ref')}) GROUP BY seg, n, g),
m AS (SELECT coalesce(h.seg, r.seg) AS seg, coalesce(h.n, r.n) AS n, coalesce(h.c, 0) AS hc, coalesce(r.c, 0) AS rc FROM h FULL OUTER JOIN r ON h.seg = r.seg AND h.n = r.n AND h.g = r.g)
SELECT seg, CAST(n AS INT) AS n, CAST(CASE WHEN sum(rc) > 0 THEN sum(hc) ELSE 0 END AS BIGINT) AS hyp, CAST(sum(rc) AS BIGINT) AS ref, CAST(sum(least(hc, rc)) AS BIGINT) AS match FROM m GROUP BY seg, n""")
def chrf_stats(spark, d):
    return mt.chrf_statistics(D.turns(spark, d)).where("kind = 'c'").drop("kind")


_PUNCTUATED = "'[' || chr(33) || '-' || chr(47) || ':-@' || '\\[-`{-~]'"


def _words_sql(side: str) -> str:
    words = f"list_filter(string_split_regex({side}, '{_S}+'), lambda w: length(w) > 0)"
    return f"""flatten(list_transform({words}, lambda w: CASE WHEN length(w) > 1 AND regexp_matches(right(w, 1), {_PUNCTUATED}) THEN [left(w, length(w) - 1), right(w, 1)]
 WHEN length(w) > 1 AND regexp_matches(left(w, 1), {_PUNCTUATED}) THEN [left(w, 1), substring(w, 2)] ELSE [w] END))"""


def _grams_sql(side: str) -> str:
    return f"""SELECT seg, 'c' AS kind, n, g FROM ({_chars_sql(side)}) UNION ALL
 SELECT seg, 'w', n, array_to_string(t[i:i + n - 1], ' ') FROM (SELECT seg, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT seg, {_words_sql(side)} AS t FROM turns), range(1, 3) t_(n))"""


def _chrf_sql(by: str) -> str:
    """Corpus chrF++ from n-gram counts, by a column of the segments, or of all."""
    return f"""WITH {D.TURNS}, h AS (SELECT seg, kind, n, g, count(*) AS c FROM ({_grams_sql('hyp')}) GROUP BY ALL), r AS (SELECT seg, kind, n, g, count(*) AS c FROM ({_grams_sql('ref')}) GROUP BY ALL),
m AS (SELECT coalesce(h.seg, r.seg) AS seg, coalesce(h.kind, r.kind) AS kind, coalesce(h.n, r.n) AS n, coalesce(h.c, 0) AS hc, coalesce(r.c, 0) AS rc FROM h FULL OUTER JOIN r ON h.seg = r.seg AND h.kind = r.kind AND h.n = r.n AND h.g = r.g),
e AS (SELECT seg, kind, n, CASE WHEN sum(rc) > 0 THEN sum(hc) ELSE 0 END AS hyp, sum(rc) AS ref, sum(least(hc, rc)) AS match FROM m GROUP BY seg, kind, n),
s AS (SELECT {by} AS k, kind, n, CAST(sum(hyp) AS DOUBLE) AS hyp, CAST(sum(ref) AS DOUBLE) AS ref, CAST(sum(match) AS DOUBLE) AS match FROM e JOIN (SELECT seg, direction FROM turns) USING (seg) GROUP BY ALL),
p AS (SELECT k, avg(match / hyp) FILTER (WHERE hyp > 0 AND ref > 0) AS p, avg(match / ref) FILTER (WHERE hyp > 0 AND ref > 0) AS r FROM s GROUP BY k),
f AS (SELECT k, CASE WHEN coalesce(p + r, 0) > 0 THEN 5 * p * r / (4 * p + r) * 100 ELSE 0.0 END AS chrf FROM p)"""


@query("chrf_by_direction", f"{_chrf_sql('direction')} SELECT k AS direction, round(chrf, 6) AS chrf FROM f")
def chrf_by_direction(spark, d):
    return rounded(mt.corpus_chrf(D.turns(spark, d), "direction"), "chrf")


@query("chrf_overall", f"{_chrf_sql('1')} SELECT round(chrf, 6) AS chrf FROM f")
def chrf_overall(spark, d):
    return rounded(mt.corpus_chrf(D.turns(spark, d)), "chrf")


@query("sentence_chrf", f"{_chrf_sql('seg')} SELECT k AS seg, round(chrf, 6) AS chrf FROM f")
def sentence_chrf(spark, d):
    return rounded(mt.sentence_chrf(D.turns(spark, d)), "chrf")


def _tokens_sql(side: str) -> str:
    text = f"replace(regexp_replace({side}, '<skipped>|-\\n', '', 'g'), chr(10), ' ')"
    for mark, said in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{mark}', '{said}')"
    text = f"' ' || {text} || ' '"
    for pattern, to in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"list_filter(string_split_regex({text}, '{_S}+'), lambda w: length(w) > 0)"


def _bleu_sql() -> str:
    grams = lambda side: f"SELECT seg, n, g, count(*) AS c FROM (SELECT seg, n, t[i:i + n - 1] AS g FROM (SELECT seg, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT seg, {_tokens_sql(side)} AS t FROM turns), range(1, 5) o(n))) GROUP BY ALL"
    at = ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE n = {n}), 0) AS DOUBLE) AS {c}{n}" for c in ("hyp", "match") for n in range(1, 5))
    smooth = [" * ".join(f"CASE WHEN match{m} = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END" for m in range(1, n + 1)) for n in range(1, 5)]
    logs = " + ".join(f"ln(CASE WHEN hyp{n} = 0 THEN 1.0::DOUBLE WHEN match{n} = 0 THEN 1.0::DOUBLE / ({smooth[n - 1]} * hyp{n}) ELSE match{n} / hyp{n} END)" for n in range(1, 5))
    return f"""WITH {D.TURNS}, h AS ({grams('hyp')}), r AS ({grams('ref')}), m AS (SELECT coalesce(h.seg, r.seg) AS seg, coalesce(h.n, r.n) AS n, coalesce(h.c, 0) AS hyp, coalesce(r.c, 0) AS ref, least(coalesce(h.c, 0), coalesce(r.c, 0)) AS match FROM h FULL OUTER JOIN r ON h.seg = r.seg AND h.n = r.n AND h.g = r.g),
w AS (SELECT direction, {at}, CAST(coalesce(sum(ref) FILTER (WHERE n = 1), 0) AS DOUBLE) AS ref1 FROM m JOIN (SELECT seg, direction FROM turns) USING (seg) GROUP BY direction)
SELECT direction, round(CASE WHEN match1 = 0 OR hyp1 = 0 OR hyp2 = 0 OR hyp3 = 0 OR hyp4 = 0 THEN 0.0 ELSE CASE WHEN hyp1 < ref1 THEN exp(1.0::DOUBLE - ref1 / hyp1) ELSE 1.0 END * exp(({logs}) / 4) * 100 END, 6) AS bleu FROM w"""


@query("bleu_corpus", _bleu_sql())
def bleu_corpus(spark, d):
    return rounded(mt.corpus_bleu(D.turns(spark, d), "direction"), "bleu")


_BOTH_SQL = f"""SELECT CAST(1 AS INT) AS whole, CAST(NULL AS VARCHAR) AS direction, chrf FROM ({_chrf_sql('1')} SELECT chrf FROM f) UNION ALL
SELECT 0, CASE WHEN direction = 0 THEN 'uz_en' ELSE 'en_uz' END, chrf FROM ({_chrf_sql('direction')} SELECT k AS direction, chrf FROM f)"""


@query("translation_task", f"""WITH s AS ({_BOTH_SQL}), n AS (SELECT direction, count(*) AS n FROM (WITH {D.TURNS} SELECT CASE WHEN direction = 0 THEN 'uz_en' ELSE 'en_uz' END AS direction FROM turns) GROUP BY direction),
b AS (SELECT CASE WHEN direction = 0 THEN 'uz_en' ELSE 'en_uz' END AS direction, bleu FROM ({_bleu_sql()}))
SELECT whole, s.direction, round(chrf, 6) AS chrf, b.bleu, CAST(CASE WHEN whole = 1 THEN (SELECT sum(n) FROM n) ELSE n.n END AS BIGINT) AS segments FROM s LEFT JOIN n USING (direction) LEFT JOIN b USING (direction)""")
def translation_task(spark, d):
    """The task from dataset rows over items and responses to its scores; BLEU of all segments is left out, SQL has it by direction."""
    task = registry.Translation(directions=("uz_en", "en_uz"))
    turns = D.turns(spark, d).withColumn("direction", F.when(F.col("direction") == 0, "uz_en").otherwise("en_uz"))
    rows = turns.select(F.col("seg").alias("ord"), F.col("seg").alias("id"), "direction", F.lit("x").alias("source"), F.col("ref").alias("reference"))
    responses = turns.select(F.concat(F.col("seg").cast("string"), F.lit(":"), "direction").alias("item_id"), F.col("hyp").alias("text"), F.lit("stop").alias("finish_reason"), F.lit(None).cast("string").alias("error"))
    scores = task.scores(task.results(task.items(task.shaped(rows)), responses))
    return rounded(scores, "chrf", "bleu").withColumn("bleu", F.when(F.col("whole") == 0, F.col("bleu")))


@query("bootstrap_ci_rng")
def bootstrap_ci_rng(spark, d):
    return rounded(metrics.chrf_interval(D.turns(spark, d)), "low", "high")


@query("cyrillic_output_rate", f"""WITH {D.TEXTS}, r AS (SELECT lang, len(regexp_extract_all(t, '[Ѐ-ҁҊ-ӿ]')) / CAST(greatest(len(regexp_extract_all(t, '\\p{{L}}')), 1) AS DOUBLE) AS q FROM texts) SELECT lang, round(avg(CAST(q > 0.5 AS INT)), 6) AS rate FROM r GROUP BY lang""")
def cyrillic_output_rate(spark, d):
    return D.texts(spark, d).groupBy("lang").agg(F.round(metrics.share(T.cyrillic_ratio(F.col("t")) > 0.5), 6).alias("rate"))


# ---- leaderboard -----------------------------------------------------------------------------------------------------

_SUITE = (("de", 0.1), ("en", 0.25), ("es", 0.0), ("fr", 0.0))


def _cells(spark, d):
    r = D.results(spark, d).where("NOT (model = 'src3' AND task = 'fr')")
    s = metrics.accuracy(r, "model", "task").select("model", "task", F.col("accuracy").alias("score"), "ci_low", "ci_high", "coverage")
    suite = spark.createDataFrame(_SUITE, "task string, chance double")
    return board.cells(D.results(spark, d).select("model"), s, suite)


def _cells_sql() -> str:
    low, high = wilson_sql("correct", "n")
    return f"""{D.RESULTS}, s AS (SELECT model, task, {PY_ROUND('CASE WHEN n > 0 THEN correct / n * 100 ELSE 0.0 END')} AS score, {PY_ROUND(low)} AS ci_low, {PY_ROUND(high)} AS ci_high, n / CAST(n_items AS DOUBLE) AS coverage FROM
 (SELECT model, task, count(*) FILTER (WHERE {D.SCORABLE}) AS n, coalesce(sum(score) FILTER (WHERE {D.SCORABLE}), 0.0) AS correct, count(*) AS n_items FROM results WHERE NOT (model = 'src3' AND task = 'fr') GROUP BY model, task)),
suite AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {c}::DOUBLE)" for t, c in _SUITE)}) t(task, chance)),
cells AS (SELECT m.model, suite.task, chance, score, ci_low, ci_high, coverage, CASE WHEN coverage IS NULL THEN 'missing' WHEN coverage < 0.5 THEN 'withheld' WHEN coverage < 0.8 THEN 'provisional' ELSE 'published' END AS state
 FROM (SELECT DISTINCT model FROM results) m CROSS JOIN suite LEFT JOIN s ON s.model = m.model AND s.task = suite.task)"""


_NORMALISED = PY_ROUND("greatest(0.0, (score / 100 - chance) / (1 - chance)) * 100")
_COMPOSITE = f"""c AS (SELECT model, {PY_ROUND(f"avg({_NORMALISED}) FILTER (WHERE state IN ('published', 'provisional'))")} AS mean, count(*) FILTER (WHERE state IN ('published', 'provisional')) = count(*) AS complete FROM cells GROUP BY model),
ranked AS (SELECT model, CASE WHEN complete THEN mean END AS composite, complete, CASE WHEN complete THEN CAST(row_number() OVER (PARTITION BY complete ORDER BY mean DESC, model) AS INT) END AS rank FROM c)"""


@query("board_cells", f"WITH {_cells_sql()} SELECT model, task, state, round(score, 6) AS score, round(coverage, 6) AS coverage FROM cells")
def board_cells(spark, d):
    return rounded(_cells(spark, d).select("model", "task", "state", "score", "coverage"), "score", "coverage")


@query("composite_rank", f"WITH {_cells_sql()}, {_COMPOSITE} SELECT model, round(composite, 6) AS composite, complete, rank FROM ranked")
def composite_rank(spark, d):
    return rounded(board.ranked(board.composites(_cells(spark, d))).select("model", "composite", "complete", "rank"), "composite")


@query("tied_with", f"""WITH {_cells_sql()}, {_COMPOSITE}, h AS (SELECT r.model, r.rank, task, ci_low, ci_high FROM cells JOIN ranked r USING (model) WHERE rank IS NOT NULL AND state IN ('published', 'provisional')),
p AS (SELECT a.model, b.model AS o, b.rank AS r, bool_or(a.ci_high < b.ci_low OR b.ci_high < a.ci_low) AS apart FROM h a JOIN h b ON a.task = b.task AND a.model <> b.model GROUP BY 1, 2, 3)
SELECT ranked.model, ranked.rank, CASE WHEN ranked.rank IS NOT NULL THEN coalesce(t.x, '') END AS tied FROM ranked LEFT JOIN (SELECT model, string_agg(o, '|' ORDER BY r) AS x FROM p WHERE NOT apart GROUP BY model) t USING (model)""")
def tied_with(spark, d):
    cells = rounded(_cells(spark, d), "ci_low", "ci_high")
    t = board.ties(board.ranked(board.composites(cells)), cells)
    return t.select("model", "rank", F.when(F.col("tied_with").isNotNull(), F.array_join("tied_with", "|")).alias("tied"))


@query("latest_run", """WITH r AS (SELECT o_orderkey AS run_id, 'm' || (o_custkey % 20) AS model, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderdate AS VARCHAR) END AS f, CAST(o_orderdate AS VARCHAR) AS s FROM orders WHERE o_orderkey % 4 <> 1)
SELECT model, run_id, coalesce(nullif(f, ''), s) AS run_date FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(nullif(f, ''), s) DESC, lpad(CAST(run_id AS VARCHAR), 9, '0')) AS k FROM r) WHERE k = 1""")
def latest_run(spark, d):
    o = D.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("string")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 20).cast("string")).alias("model"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(day).alias("finished_at"), day.alias("started_at"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"), F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("riddles"))).otherwise(F.array(F.lit("dtm"), F.lit("riddles"))).alias("tasks"))
    best = board.latest_runs(runs, ["dtm"])
    return best.select("model", "run_id", F.coalesce(F.nullif("finished_at", F.lit("")), "started_at").alias("run_date"))


@query("replicate_mean", f"""WITH {D.RESULTS}, s AS (SELECT model, task, item_id % 3 AS run, avg(score) * 100 AS score FROM results WHERE {D.SCORABLE} GROUP BY ALL) SELECT model, task, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high, count(*) AS runs FROM s GROUP BY model, task""")
def replicate_mean(spark, d):
    s = D.results(spark, d).where(X.scorable(F.col("status"))).groupBy("model", "task", (F.col("item_id") % 3).alias("run")).agg((F.avg("score") * 100).alias("score"))
    return rounded(metrics.replicates(s), "mean", "low", "high")


@query("recall_gap", f"""WITH {_PAIRS} SELECT model, round(avg(a) * 100, 6) AS recall, round(avg(b) * 100, 6) AS choice, round((avg(b) - avg(a)) * 100, 6) AS gap, count(*) AS n FROM pairs GROUP BY model""")
def recall_gap(spark, d):
    p = _pairs(spark, d)
    both = p.select("model", "item_id", F.lit("recall").alias("task"), F.col("a").alias("score")).unionByName(p.select("model", "item_id", F.lit("choice").alias("task"), F.col("b").alias("score")))
    return rounded(metrics.recall_gap(both, "recall", "choice"), "recall", "choice", "gap")


@query("board_search", f"WITH {_cells_sql()}, {_COMPOSITE} SELECT model, round(composite, 6) AS composite FROM ranked WHERE contains(lower(model), '1') ORDER BY composite DESC NULLS LAST, model LIMIT 10")
def board_search(spark, d):
    b = board.ranked(board.composites(_cells(spark, d))).withColumn("organization", F.lit("x")).withColumn("open_weights", board.open_weights(F.lit("apache-2.0")))
    return rounded(board.sorted_by(board.search(b, "1", True), "composite").limit(10).select("model", "composite"), "composite")


@query("reasoning_labels", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no-think' WHEN 1 THEN 'think' WHEN 2 THEN 'mixed' ELSE 'unknown' END AS label, left(CASE WHEN p_partkey % 2 = 0 THEN '2026-01-02T03' ELSE '2025-12-31T23' END, 10) AS day FROM part")
def reasoning_labels(spark, d):
    k = F.col("p_partkey") % 4
    modes = F.when(k == 0, F.array(F.lit("off"), F.lit("off"))).when(k == 1, F.array(F.lit("default"), F.lit("on"))).when(k == 2, F.array(F.lit("off"), F.lit("on"))).otherwise(F.array().cast("array<string>"))
    return D.table(spark, d, "part").select("p_partkey", board.reasoning_label(modes).alias("label"), board.run_date(F.when(F.col("p_partkey") % 2 == 0, "2026-01-02T03").otherwise(""), F.lit("2025-12-31T23")).alias("day"))


@query("board_document")
def board_document(spark, d):
    cells = _cells(spark, d)
    ranked = board.ranked(board.composites(cells))
    return board.document(ranked, cells, board.ties(ranked, cells))


# ---- worklist and localisation ---------------------------------------------------------------------------------------


@query("worklist_merge", """WITH f AS (SELECT c_custkey AS key, 0 AS i, c_nationkey % 3 AS n, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 3 = 1 THEN '' ELSE c_name END AS uz FROM customer)
SELECT CAST(k AS VARCHAR) AS key, string_agg(term, '|' ORDER BY n) AS terms FROM (SELECT key // 3 AS k, key % 3 AS n, c AS term FROM (SELECT c_custkey AS key, c_name AS c FROM customer)) GROUP BY k HAVING count(*) = 3 AND k % 5 <> 0""")
def worklist_merge(spark, d):
    from ..operators.worklist import merged

    k = F.floor(F.col("c_custkey") / 3).cast("bigint")
    filled = D.table(spark, d, "customer").select(k.cast("string").alias("key"), F.lit("keywords:existence").alias("constraint"), F.lit("keywords").alias("kwarg"), F.concat(F.lit("0."), (F.col("c_custkey") % 3).cast("string")).alias("index"), F.when((k % 5 == 0) & (F.col("c_custkey") % 3 == 1), " ").otherwise(F.col("c_name")).alias("uz"))
    expected = filled.select("key", F.lit(0).alias("i"), F.lit("keywords").alias("kwarg"), F.lit(3).alias("expected")).distinct()
    return merged(filled, expected).select("key", F.array_join("terms", "|").alias("terms"))


@query("coverage_counts", f"WITH {D.RESULTS} SELECT task, count(*) AS total, count(*) FILTER (WHERE score = 1) AS before, count(*) FILTER (WHERE score = 1 OR toxic = 1) AS after FROM results GROUP BY task")
def coverage_counts(spark, d):
    from ..operators.worklist import coverage

    r = D.results(spark, d).select(F.col("task").alias("kwarg"), (F.col("score") == 1).alias("before"), ((F.col("score") == 1) | (F.col("toxic") == 1)).alias("after"))
    return coverage(r).withColumnRenamed("kwarg", "task")


# ---- sources, providers, streams -------------------------------------------------------------------------------------


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha, substring(sha256(text), 1, 12) AS short FROM documents")
def sha256_text(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.left(F.sha2("text", 256), F.lit(12)).alias("short"))


@query("stub_run", "SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 2 = 0 THEN 'Javob: A' ELSE 'Bu sinov javobi.' END AS response FROM part")
def stub_run(spark, d):
    from ..sources.providers import StubProvider, run_items

    prompts = D.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\n\nJavob:"))).otherwise(F.col("p_name")).alias("prompt"))
    return run_items(prompts, StubProvider("stub")).select("item_id", F.col("text").alias("response"))


@query("submission_checks", "SELECT c_custkey, c_custkey % 3 <> 0 AS ok FROM customer")
def submission_checks(spark, d):
    from ..streaming.limits import checked

    k = F.col("c_custkey") % 3
    rows = D.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k == 0, "not an address").otherwise(F.lit(" a@b.uz ")).alias("email"), F.lit("m").alias("model_name"), F.lit("").alias("company"), F.lit("n").alias("notes"))
    return checked(rows).select("c_custkey", "ok")


@query("stream_latest", ORACLE["latest_any"])
def stream_latest(spark, d):
    import uuid

    from ..streaming.records import latest_stream, run_to_end

    schema = D.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{d}/events*.parquet")
    stream = stream.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("status"), "ts", "event_id", "value")
    out = run_to_end(latest_stream(stream, "item_id", ["ts", "event_id"], ["status", "value"]), f"latest_{uuid.uuid4().hex}")
    return out.select("item_id", "status", "event_id", "value")


# ---- dataset building ------------------------------------------------------------------------------------------------


@query("strip_labels", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE 'AB) ' || p_name END AS option FROM part")
def strip_labels(spark, d):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit(" c) "), "p_name")).when(k == 1, F.concat(F.lit("A.  "), "p_name")).otherwise(F.concat(F.lit("AB) "), "p_name"))
    return D.table(spark, d, "part").select("p_partkey", builder.strip_label(said).alias("option"))


@query("drop_duplicates", "SELECT min(p_partkey) AS ord FROM part GROUP BY lower(p_name)")
def drop_duplicates(spark, d):
    return builder.drop_duplicates(D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("t")), "t").select("ord")


@query("drop_overlap", "SELECT p_partkey FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 20)")
def drop_overlap(spark, d):
    p = D.table(spark, d, "part")
    return builder.drop_overlap(p, p.where("p_partkey < 20"), "p_name").select("p_partkey")


@query("task_names", "SELECT DISTINCT task, CASE WHEN task IN ('src1', 'src2') THEN 'scored' ELSE 'orphan' END AS state FROM (SELECT source AS task FROM documents UNION ALL SELECT 'src2')")
def task_names(spark, d):
    recorded = D.table(spark, d, "documents").select(F.col("source").alias("task")).distinct()
    return builder.task_names(recorded, spark.createDataFrame([("src1",), ("none",)], "task string"), spark.createDataFrame([("src2",)], "task string"))


@query("quarantine", f"WITH {D.CHOICE} SELECT item_id, gold_index IS NULL AS bad FROM choice")
def quarantine(spark, d):
    c = D.multiple_choice(spark, d)
    problems = validators.choice_problems(c, F.col("item_id"), F.col("options"), F.col("gold_index")).where("problem = 'missing or invalid answer key'")
    good, bad = builder.quarantined(c, problems)
    return good.select("item_id", F.lit(False).alias("bad")).unionByName(bad.select("item_id", F.lit(True).alias("bad")))


@query("chrf_macro", f"{_chrf_sql('direction')} SELECT round(avg(chrf), 6) AS macro, count(*) AS groups FROM f")
def chrf_macro(spark, d):
    return rounded(builder.macro_mean(mt.corpus_chrf(D.turns(spark, d), "direction"), "chrf"), "macro")


@query("score_tint", "SELECT p_partkey, round(greatest(0.0, least(1.0, (p_size * 2.0 - 25.0) / 75.0)), 6) AS tint FROM part")
def score_tint(spark, d):
    return D.table(spark, d, "part").select("p_partkey", F.round(board.tint(F.col("p_size") * 2.0, F.lit(25.0)), 6).alias("tint"))


# ---- prompts, items, worklists and files -----------------------------------------------------------------------------


@query("html_escape", "SELECT doc_id, sha256(replace(replace(replace(replace(replace('<p title=\"' || coalesce(text, '') || '''\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS sha FROM documents")
def html_escape(spark, d):
    said = F.concat(F.lit('<p title="'), F.coalesce("text", F.lit("")), F.lit("'\">"))
    return D.table(spark, d, "documents").select("doc_id", F.sha2(T.html_escape(said), 256).alias("sha"))


@query("default_items", "SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey - 1 AS VARCHAR) ELSE p_name END AS item_id, p_type AS gold, p_size AS size FROM part")
def default_items(spark, d):
    rows = D.table(spark, d, "part").select((F.col("p_partkey") - 1).alias("ord"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("id"), F.col("p_type").alias("answer"), F.col("p_size").alias("size"))
    return items.default_items(rows).select("item_id", "gold", F.col("payload.size").alias("size"))


@query("mmlu_items", """WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_size % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS g FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS question, p_brand || '|' || p_type || '|' || p_name AS options, substring('ABC', g + 1, 1) AS gold FROM p WHERE g < 3""")
def mmlu_items(spark, d):
    k = F.col("p_partkey") % 4
    p = D.table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"), F.when(k == 1, F.col("p_name")).otherwise("").alias("question_uzb"),
        F.to_json(F.array("p_brand", "p_type", "p_name")).alias("options"), F.lit(None).cast("string").alias("options_uzb"), F.when(k == 0, (F.col("p_size") % 5).cast("string")).alias("answer_index"),
        F.when(k == 1, " b").when(k == 2, "C").otherwise("?").alias("answer"), F.col("p_type").alias("category"),
    )
    return items.mmlu_items(rows).select("item_id", "question", F.array_join("options", "|").alias("options"), "gold")


@query("translation_prompt", """WITH p AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN ['oʻzbek', 'ingliz'] WHEN 1 THEN ['rus', 'oʻzbek'] ELSE ['uz2', 'qozoq'] END AS l FROM documents)
SELECT doc_id, sha256('Matnni ' || l[1] || ' tilidan ' || l[2] || ' tiliga oʻgiring, faqat tarjimani yozing.' || chr(10) || chr(10) || 'Matn: ' || text || chr(10) || chr(10) || 'Tarjima:') AS sha FROM p""")
def translation_prompt(spark, d):
    direction = F.get(F.array(*[F.lit(x) for x in ("uz_en", "ru_uz", "uz2_kk")]), (F.col("doc_id") % 3).cast("int"))
    return D.table(spark, d, "documents").select("doc_id", F.sha2(items.translation_prompt(direction, F.col("text")), 256).alias("sha"))


@query("riddle_prompt", """WITH p AS (SELECT p_partkey, 'Topishmoqning javobini toping.' || chr(10) || chr(10) || 'Zarbulmasal: ' || p_name || chr(10) || chr(10) AS q, 'Javob:' AS a, p_brand, p_type FROM part)
SELECT p_partkey, q || a AS free, q || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || chr(10) || a AS choice FROM p""")
def riddle_prompt(spark, d):
    return D.table(spark, d, "part").select("p_partkey", items.riddle_prompt(F.col("p_name")).alias("free"), items.riddle_prompt(F.col("p_name"), F.array("p_brand", "p_type")).alias("choice"))


_WORDS = "w AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents)"


def _words(spark, d):
    """doc_id, source, w: the Latin words of whole texts, in lower case."""
    return D.table(spark, d, "documents").select("doc_id", "source", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))


_VOWEL = "CASE WHEN x[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'yes' WHEN x[1] < 'n' THEN 'no' ELSE 'unknown' END"


@query("reasoning_score_words", f"""WITH {_WORDS}, a AS (SELECT doc_id, w, doc_id % 3 AS k, list_transform(w[1:3], lambda x: {_VOWEL}) AS p, list_transform(w[2:4], lambda x: {_VOWEL}) AS g, list_transform(w[1:3], lambda x: left(x, 1)) AS zp, list_transform(w[2:4], lambda x: left(x, 1)) AS zg FROM w WHERE len(w) >= 4),
b AS (SELECT *, CAST(p[1] = g[1] AS INT) + CAST(p[2] = g[2] AS INT) + CAST(p[3] = g[3] AS INT) AS web, CAST(zp[1] = zg[1] AS INT) + CAST(zp[2] = zg[2] AS INT) + CAST(zp[3] = zg[3] AS INT) AS zebra FROM a)
SELECT doc_id, round(CASE k WHEN 0 THEN (CAST(web = 3 AS DOUBLE) + web / 3.0::DOUBLE) / 2 WHEN 1 THEN CAST(starts_with(w[1], left(w[2], 2)) AND length(w[1]) <= 6 AS DOUBLE) ELSE (CAST(zebra = 3 AS DOUBLE) + zebra / 3.0::DOUBLE) / 2 END, 6) AS score FROM b""")
def reasoning_score_words(spark, d):
    """The reasoning scorer over answers and keys that neighbouring words of a text make."""
    says = lambda x: F.when(F.left(x, F.lit(1)).isin(*"aeiou"), "Ha").when(F.left(x, F.lit(1)) < "n", "yo'q").otherwise("noaniq.")
    keys = lambda x: F.when(F.left(x, F.lit(1)).isin(*"aeiou"), "xa").when(F.left(x, F.lit(1)) < "n", "no").otherwise("nomaʼlum")
    first = lambda x: F.left(x, F.lit(1))
    one, two, k = F.slice("w", 1, 3), F.slice("w", 2, 3), F.col("doc_id") % 3
    value = F.when(k == 0, F.array_join(F.transform(one, says), ", ")).when(k == 1, F.upper(F.get("w", F.lit(0)))).otherwise(F.array_join(F.transform(one, first), " , "))
    gold = F.when(k == 0, F.array_join(F.transform(two, keys), ",")).when(k == 1, F.left(F.get("w", F.lit(1)), F.lit(2))).otherwise(F.array_join(F.transform(two, first), ","))
    kind = F.when(k == 0, "web_of_lies_v2").when(k == 1, "spatial").otherwise("zebra_puzzle")
    rows = _words(spark, d).where(F.size("w") >= 4).select("doc_id", value.alias("value"), gold.alias("gold"), kind.alias("kind"))
    return rows.select("doc_id", F.round(score.reasoning_score(F.col("value"), F.col("gold"), F.col("kind"), T.match_key_lower), 6).alias("score"))


@query("answer_matches_words", f"""WITH {_WORDS} SELECT doc_id, w[1] IN (w[2], w[3]) OR list_contains(list_transform([w[2], w[3]], lambda s: starts_with(w[1], s) AND length(w[1]) > length(s) AND regexp_matches(substring(w[1], length(s) + 1), '{score.SUFFIX}')), true) AS fits FROM w WHERE len(w) >= 3""")
def answer_matches_words(spark, d):
    """Whether a text's first word is its second or third, endings aside."""
    said = F.concat(F.lit("Javob: "), F.initcap(F.get("w", F.lit(0))), F.lit("!"))
    return _words(spark, d).where(F.size("w") >= 3).select("doc_id", score.matches(said, F.slice("w", 2, 2), T.match_key_lower).alias("fits"))


@query("quote_alignment", f"""WITH {_WORDS} SELECT doc_id, CASE WHEN w[1] <> w[2] THEN CASE WHEN doc_id % 2 = 0 THEN w[1] || '=u' || w[1] || '|' || w[2] || '=u' || w[2] ELSE w[2] || '=u' || w[1] || '|' || w[1] || '=u' || w[2] END END AS pairs FROM w WHERE len(w) >= 2 AND length(w[1]) < 70 AND length(w[2]) < 70""")
def quote_alignment(spark, d):
    """English terms and Uzbek quotes by the order of quotes; on odd ids the English prompt has them the other way round."""
    from ..operators.worklist import quote_map

    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    quoted = lambda x, y: F.concat(F.lit('use "'), x, F.lit('" or "'), y, F.lit('"'))
    rows = _words(spark, d).where((F.size("w") >= 2) & (F.length(a) < 70) & (F.length(b) < 70))
    en = F.when(F.col("doc_id") % 2 == 0, quoted(a, b)).otherwise(quoted(b, a))
    uz = F.concat(F.lit("«u"), a, F.lit("» yoki «u"), b, F.lit("»"))
    met = rows.select("doc_id", quote_map(en, uz, F.array(a, b)).alias("m"))
    return met.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value)), "|").alias("pairs"))


def _owed(spark, d):
    from ..operators.worklist import missing

    several = F.col("doc_id") % 2 == 0
    kw = F.when(several, F.create_map(F.lit("keywords"), F.slice("w", 1, 3))).otherwise(F.create_map(F.lit("keyword"), F.slice("w", 1, 1)))
    name = F.when(F.col("doc_id") % 7 == 0, "punctuation:no_comma").when(several, "keywords:existence").otherwise("keywords:frequency")
    return missing(_words(spark, d).select(F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("ord"), F.lit(2).alias("at"), name.alias("name"), kw.alias("kw"), (F.col("doc_id") % 5 == 0).alias("localised"), F.concat("source", F.lit("\n  x")).alias("prompt")))


_OWED = f"""{_WORDS}, owed AS (SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 2 = 0 THEN 'keywords:existence' ELSE 'keywords:frequency' END AS "constraint", CASE WHEN doc_id % 2 = 0 THEN 'keywords' ELSE 'keyword' END AS kwarg,
 '2.' || i AS "index", w[CAST(i + 1 AS INT)] AS en, source || ' x' AS prompt_uz FROM (SELECT *, unnest(range(0, least(len(w), CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END))) AS i FROM w WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0))"""


@query("worklist_missing", f"WITH {_OWED} SELECT * FROM owed")
def worklist_missing(spark, d):
    return _owed(spark, d).drop("uz")


@query("worklist_histogram", f"""WITH {_OWED} SELECT "constraint", count(*) AS n FROM owed GROUP BY 1""")
def worklist_histogram(spark, d):
    from ..operators.worklist import histogram

    return histogram(_owed(spark, d))


_LETTERS = "list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w) + 2), lambda i: substr('_' || w || '_', i, 2)), list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3)))"
_COUNTED = f"""w AS (SELECT doc_id, lang, w, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
g AS (SELECT doc_id, lang, g, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, lang, n, unnest({_LETTERS}) AS g FROM w) GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place FROM g WHERE lang IS NOT NULL AND doc_id % 3 <> 1 GROUP BY lang, g QUALIFY place < 300)"""


def _profiles(spark, d):
    from ..functions import language

    return language.profiles(D.table(spark, d, "documents").where("doc_id % 3 <> 1"))


@query("language_profiles", f'WITH {_COUNTED} SELECT lang, CAST(place AS INT) AS rank, g AS "group" FROM p')
def language_profiles(spark, d):
    """Profiles learnt from two documents of three."""
    return _profiles(spark, d).withColumn("rank", F.col("rank").cast("int"))


@query("language_found", f"""WITH {_COUNTED}, o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS place FROM g QUALIFY place < 300),
s AS (SELECT o.doc_id, l.lang, sum(coalesce(least(abs(p.place - o.place), 300), 300)) AS off FROM o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = o.g GROUP BY ALL),
f AS (SELECT doc_id, arg_min(lang, (off, lang)) AS found FROM s GROUP BY doc_id)
SELECT doc_id, doc_id % 3 = 1 AS held_out, found FROM documents LEFT JOIN f USING (doc_id)""")
def language_found(spark, d):
    """The language found in every document; of those with held_out nothing was learnt."""
    from ..functions import language

    found = language.detector(_profiles(spark, d))
    return D.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3 == 1).alias("held_out"), found(F.col("text")).alias("found"))


@query("response_language", """SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 4 = 0 THEN 'excluded' WHEN coalesce(regexp_matches(text, '(^|[^a-z])(der|die|und)([^a-z]|$)'), false) = (lang = 'de') AND text IS NOT NULL THEN 'pass' ELSE 'fail' END AS outcome FROM documents WHERE lang IS NOT NULL""")
def response_language(spark, d):
    """Responses that shall be in a language, judged by a detector of three German words."""
    found = lambda c: F.when(c.rlike("(^|[^a-z])(der|die|und)([^a-z]|$)"), "DE").when(c.isNotNull(), "xx")
    kw = F.create_map(F.lit("language"), F.array(F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("lang") == "de", "de").otherwise("xx")))
    rows = D.table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").cast("string").alias("item_id"), F.lit(0).alias("at"), F.lit("language:response_language").alias("name"), kw.alias("kw"), F.lit(False).alias("localised"), F.col("text").alias("response"))
    return C.evaluate(rows, detector=found).select("item_id", "outcome")


def _put(spark, rows, kind: str, **options) -> str:
    """The folder in shared storage to which rows were written."""
    import uuid

    path = f"{readers.shared_folder(spark)}/trip-{uuid.uuid4().hex}.{kind}"
    rows.write.format({"jsonl": "json", "tsv": "csv"}.get(kind, kind)).options(**options).save(path)
    return path


_TRIP = "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''"


def _tripped(spark, d, kind: str, read, **options):
    rows = D.table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    back = read(spark, _put(spark, rows, kind, **options))
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("sha"))


@query("read_jsonl", _TRIP)
def read_jsonl(spark, d):
    return _tripped(spark, d, "jsonl", readers.read_jsonl)


@query("read_csv", _TRIP)
def read_csv(spark, d):
    return _tripped(spark, d, "csv", readers.read_csv, header=True, escape='"', quoteAll=True)


@query("read_tsv", _TRIP)
def read_tsv(spark, d):
    return _tripped(spark, d, "tsv", readers.read_tsv, header=True, escape='"', quoteAll=True, sep="\t")


@query("read_json", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def read_json(spark, d):
    """One document that wraps its rows, as benchmark files do."""
    rows = D.table(spark, d, "nation").agg(F.to_json(F.struct(F.lit("v1").alias("meta"), F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("rows"))).alias("value"))
    return readers.read_json(spark, _put(spark, rows, "text")).select(F.col("id").cast("int").alias("id"), "name")


@query("record_log", """SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'r2' AS run_id, 'ok' AS status FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'r1', CASE WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'ok' END FROM part""")
def record_log(spark, d):
    """Two runs appended to a log, and the log read again."""
    from ..sources.writers import append_records

    part = D.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_partkey") % 3 == 0, "error").otherwise("ok").alias("status"), F.col("p_name").alias("response"))
    folder = _put(spark, part.limit(0), "jsonl")
    append_records(part, folder, "r1", "dtm")
    append_records(part.where("status = 'error'").withColumn("status", F.lit("ok")), folder, "r2", "dtm")
    return readers.read_records(spark, folder).select("item_id", "run_id", "status")


@query("board_rows", f"""WITH {_cells_sql()}, {_COMPOSITE}, r AS (SELECT DISTINCT model, CAST(substring(model, 4) AS INT) AS k FROM results),
m AS (SELECT model, string_agg(task, '|' ORDER BY task) FILTER (WHERE state NOT IN ('published', 'provisional')) AS missing, count(*) FILTER (WHERE state IN ('published', 'provisional')) AS n_scores FROM cells GROUP BY model)
SELECT ranked.model, ranked.rank, composite, CASE WHEN k % 2 = 0 THEN 'apache-2.0' ELSE 'unknown' END AS license, k % 2 = 0 AS open_weights, CASE k % 3 WHEN 0 THEN 'no-think' WHEN 1 THEN 'mixed' ELSE 'think' END AS reasoning, '2026-01-02' AS run_date, 'abcdefabcdef' AS harness_commit, coalesce(missing, '') AS missing, n_scores,
 (SELECT score FROM cells c WHERE c.model = ranked.model AND task = 'en' AND state IN ('published', 'provisional')) AS en FROM ranked JOIN r USING (model) JOIN m USING (model)""")
def board_rows(spark, d):
    """The published document, read again."""
    cells, suite = _cells(spark, d), [t for t, _ in _SUITE]
    k = F.expr("cast(substring(model, 4) as int)")
    runs = cells.select("model").distinct().select(
        "model", F.lit(None).cast("string").alias("organization"), F.when(k % 2 == 0, "apache-2.0").alias("license"), F.lit("").alias("weights_url"), F.lit(None).cast("string").alias("quantization"),
        F.when(k % 3 == 0, "off").alias("reasoning"), F.concat(F.lit("run-"), "model").alias("run_id"), F.lit("").alias("finished_at"), F.lit("2026-01-02T03:04").alias("started_at"), F.lit("1").alias("harness_version"),
        F.lit("abcdefabcdef0123").alias("harness_git_sha"), F.lit(0.0).alias("temperature"), F.create_map(F.lit("en"), F.when(k % 3 == 1, '{"reasoning": "off"}').otherwise("{}")).alias("cells"),
    )
    ranked = board.ranked(board.composites(cells))
    row = board.document(ranked, cells, board.ties(ranked, cells), board.run_details(runs, suite))
    form = "model string, rank int, composite double, license string, openWeights boolean, reasoning struct<label:string>, runDate string, harnessCommit string, missing array<string>, scores map<string,struct<score:double>>"
    x = row.select(F.from_json("row", form).alias("x"))
    return x.select(
        "x.model", "x.rank", "x.composite", "x.license", F.col("x.openWeights").alias("open_weights"), F.col("x.reasoning.label").alias("reasoning"), F.col("x.runDate").alias("run_date"),
        F.col("x.harnessCommit").alias("harness_commit"), F.array_join("x.missing", "|").alias("missing"), F.size("x.scores").cast("bigint").alias("n_scores"), F.try_element_at("x.scores", F.lit("en"))["score"].alias("en"),
    )
