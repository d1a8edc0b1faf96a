"""The test tables in the roles of evaluation data, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import APOSTROPHES


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark, d) -> DataFrame:
    """doc_id, t: documents with apostrophes of all kinds, decomposed accents and look-alike Cyrillic letters put in."""
    mark = F.substring(F.lit(APOSTROPHES), (F.col("doc_id") % 9 + 1).cast("int"), F.lit(1))
    t = F.replace(F.replace("text", F.lit("on"), F.concat(F.lit("o"), mark, F.lit("n"))), F.lit("é"), F.lit("é"))
    return table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, F.translate(t, "aeo", "аео")).otherwise(t).alias("t"))


_A = APOSTROPHES.replace("'", "''")
TEXTS = f"""texts AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN translate(t, 'aeo', 'аео') ELSE t END AS t FROM (
  SELECT doc_id, lang, replace(replace(text, 'on', 'o' || substring('{_A}', CAST(doc_id % 9 AS INT) + 1, 1) || 'n'), 'é', 'é') AS t FROM documents))"""

#: A response for each way in which an answer can be given, by doc_id % 12.
SHAPES = ("B", "(C).", "Bu savol. Javob: {x}", "**{x}** deb oʻylayman", "\\boxed{{{x}}}", "Javob {x}\nJavob: {x}", "<think>A yoki B</think>{x})", "<think>hali oʻyla", "Menimcha shunday\n{x}) chunki", "bilmayman deyman", "", "Yechim shu:\n({x})")


def responses(spark, d) -> DataFrame:
    """doc_id, n, r: model responses, and how many options there were."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.substring(F.lit("ABCDEFGHIJ"), (F.col("doc_id") % 10 + 1).cast("int"), F.lit(1)).alias("x"))
    r = None
    for k, shape in enumerate(SHAPES):
        said = F.replace(F.lit(shape.replace("{{", "{").replace("}}", "}").replace("{x}", "\x02")), F.lit("\x02"), F.col("x"))
        r = F.when(F.col("doc_id") % 12 == k, said) if r is None else r.when(F.col("doc_id") % 12 == k, said)
    return docs.select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, 10).otherwise(4).alias("n"), r.alias("r"))


def _sql_shapes() -> str:
    parts = []
    for k, shape in enumerate(SHAPES):
        said = shape.replace("{{", "{").replace("}}", "}").replace("{x}", "\x02").replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x02", "' || x || '")
        parts.append(f"WHEN {k} THEN '{said}'")
    return f"""responses AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 4 END AS n, CASE doc_id % 12 {' '.join(parts)} END AS r
  FROM (SELECT doc_id, source, substring('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1) AS x FROM documents))"""


RESPONSES = _sql_shapes()


def results(spark, d) -> DataFrame:
    """Item results: item_id, ord, model, task, status, score, strategy from labels and documents."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    met = table(spark, d, "labels").join(docs, "doc_id")
    n = F.col("n_chars")
    status = F.when(n % 17 == 0, "error").when(n % 13 == 0, "truncated").when(n % 11 == 0, "unparsed").when(n % 23 == 0, "refusal").otherwise("ok")
    return met.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), F.col("source").alias("model"), F.col("lang").alias("task"), status.alias("status"), F.col("quality").cast("double").alias("score"), "toxic", F.concat(F.lit("rule-"), (n % 5).cast("string")).alias("strategy"))


RESULTS = """results AS (SELECT doc_id AS item_id, doc_id AS ord, source AS model, lang AS task,
  CASE WHEN n_chars % 17 = 0 THEN 'error' WHEN n_chars % 13 = 0 THEN 'truncated' WHEN n_chars % 11 = 0 THEN 'unparsed' WHEN n_chars % 23 = 0 THEN 'refusal' ELSE 'ok' END AS status,
  CAST(quality AS DOUBLE) AS score, toxic, 'rule-' || (n_chars % 5) AS strategy FROM labels JOIN documents USING (doc_id))"""
SCORABLE = "status NOT IN ('unparsed', 'truncated', 'error')"


def log(spark, d) -> DataFrame:
    """The record log: item_id, status, ord, value from events."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ord"), "event_id", "value")


def multiple_choice(spark, d) -> DataFrame:
    """Dataset rows: ord, id, question, options, answer index or null."""
    p = table(spark, d, "part")
    options = F.array(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).when(F.col("p_partkey") % 11 == 0, F.lit(" ")).otherwise(F.col("p_name")))
    gold = F.when(F.col("p_partkey") % 19 == 0, F.lit(None)).otherwise(F.col("p_partkey") % 5).cast("int")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("question"), options.alias("options"), gold.alias("gold_index"))


CHOICE = """choice AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS question,
  [p_brand, p_type, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 7 = 0 THEN p_brand WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END] AS options,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS gold_index FROM part)"""


def turns(spark, d) -> DataFrame:
    """seg, hyp, ref: assistant turns and the user turns before them."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    met = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return met.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), F.col("text").alias("hyp"), "ref", (F.col("turn") % 2).alias("direction"))


TURNS = """turns AS (SELECT a.conv_id * 1000 + a.turn AS seg, a.text AS hyp, b.text AS ref, a.turn % 2 AS direction
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant')"""
