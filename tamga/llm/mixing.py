"""Mixing sources to target weights with soft membership.

A classifier learnt from a labelled table gives each document a posterior p_d over domains. Rates r_d >= 0 say how often a
document should be taken, such that the expected tokens of each domain, sum of r_d n_d p_d(domain), meet target weights.
They solve a least-squares problem by projected gradient descent over all documents: each step is one distributed sum per
domain, then every rate moves against its own gradient and is put back into its bounds. Residuals are measured in the
metric of the posteriors' second moments, in which few steps suffice.

All rates start from one value and a step moves a rate by a function of its document's posterior, so a rate follows from the
posterior and the residuals of the steps so far: nothing is written or joined between steps, and no posterior is rounded.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, documents, flat, free_name, saved, slices, tidy

#: Labelled rows that teach the classifier at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
BUCKETS, SMOOTHING = 1 << 16, 1.0
#: Of ten labelled rows so many are counted; the others tell what the counts are worth. A token's evidence above STRONG stands
#: out whatever the length of its text.
COUNTED, STRONG, FIT_STEPS, FIT_DECAY = 6, 2.0, 300, 1e-4
#: Steps at most, the largest error of a domain's share of the tokens at which they end, and the one from which mix() warns.
STEPS, ENOUGH, WARN = 400, 1e-5, 1e-3
#: Domains are the kinds of labelled documents: clean, poor, toxic; wanted shares of the tokens.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = (0.9, 0.08, 0.02)
SLICE = 1 << 18

_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def token_buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of each token (run without ASCII white space, A-Z lower-cased) of some rows."""
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    # sum of byte values weighted by the place inside the token
    place = np.arange(len(low), dtype=np.uint64)
    value = _BYTE[low]
    one = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(value * place, dtype=np.uint64)])
    code = (two[ends] - two[starts]) - (one[ends] - one[starts]) * starts.astype(np.uint64) + (one[ends] - one[starts]) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    row = np.searchsorted(at, starts, "right") - 1
    return row, (code >> np.uint64(48)).astype(np.int64) % BUCKETS


def _counts(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        raw, at = flat(batch.column(1))
        classes = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(at, SLICE):
            with np.errstate(over="ignore"):
                row, bucket = token_buckets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            for c in np.unique(classes[i:j]).tolist():
                total = sums.setdefault(c, np.zeros(BUCKETS, np.int64))
                total += np.bincount(bucket[classes[i:j][row] == c], minlength=BUCKETS)
    for c, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([c] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(total[some])], names=["domain", "bucket", "n"])


def domain_of(quality: Column, toxic: Column) -> Column:
    """Position in DOMAINS of a label; null if a label is null."""
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 0)


class Model:
    """weights: evidence of each bucket for each domain; spread, turn: how a document's features become the exponents of its
    posterior. Made of zeros it gives equal parts."""

    def __init__(self, weights: np.ndarray):
        n = 2 + 3 * len(DOMAINS)
        self.weights, self.middle, self.spread, self.turn = weights, np.zeros(n), np.ones(n), np.zeros((n, len(DOMAINS)))

    def features(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and its features: 1, log of its length, and for each domain the evidence of its tokens by their
        number, by the root of it, and the log of what is strong."""
        raw, at = flat(text)
        n, k = len(at) - 1, len(DOMAINS)
        tokens, sums, strong = np.zeros(n, np.int64), np.zeros((n, k)), np.zeros((n, k))
        for i, j in slices(at, SLICE):
            with np.errstate(over="ignore"):
                row, bucket = token_buckets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            tokens[i:j] = np.bincount(row, minlength=j - i)
            for c in range(k):
                said = self.weights[bucket, c]
                sums[i:j, c] = np.bincount(row, said, minlength=j - i)
                strong[i:j, c] = np.bincount(row, np.maximum(said - STRONG, 0), minlength=j - i)
        some = np.maximum(tokens, 1)[:, None]
        return tokens, np.concatenate([np.ones((n, 1)), np.log1p(some), sums / some, sums / np.sqrt(some), np.log1p(strong)], 1)

    def fit(self, features: np.ndarray, domain: np.ndarray) -> None:
        """A logistic regression of the domains on features, by accelerated gradient steps from zero."""
        self.middle, self.spread = features.mean(0), np.maximum(features.std(0), 1e-6)
        self.middle[0], self.spread[0] = 0.0, 1.0
        x, y = (features - self.middle) / self.spread, np.eye(len(DOMAINS))[domain]
        size = 0.5 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + FIT_DECAY
        before = now = np.zeros_like(self.turn)
        for step in range(FIT_STEPS):
            ahead = now + step / (step + 3) * (now - before)
            before, now = now, ahead - (x.T @ (_softmax(x @ ahead) - y) / len(x) + FIT_DECAY * ahead) / size
        self.turn = now

    def posteriors(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and its posterior. Null text and text without tokens: no tokens and equal parts."""
        tokens, x = self.features(text)
        p = _softmax((x - self.middle) / self.spread @ self.turn)
        p[tokens == 0] = 1 / len(DOMAINS)
        return tokens, p


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A classifier from at most TRAIN_ROWS labelled documents.

    labels: doc_id, domain (position). Of a repeated doc_id one label and one text count. Token counts of some of the rows give evidence
    per token; the rest of the rows says how evidence turns into posteriors that hold. What reaches the driver is a number per
    domain and bucket, and the features of at most TRAIN_ROWS rows. Without labelled rows all posteriors are equal.
    """
    bounded_batches(docs.sparkSession)
    k = len(DOMAINS)
    some = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    met = docs.join(F.broadcast(some), "doc_id").where("text is not null")
    # of rows that repeat an id one counts, so there are TRAIN_ROWS in any case
    met = met.groupBy("doc_id", "domain").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("x"))
    rows = met.select("domain", F.col("x.text").alias("text"), (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(10)) < COUNTED).alias("counted"))
    table = rows.where("counted").select("domain", "text").mapInArrow(_counts, "domain int, bucket int, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((k, BUCKETS))
    np.add.at(counts, (table.column("domain").to_numpy(), table.column("bucket").to_numpy()), table.column("n").to_numpy())
    # smoothing in proportion to a domain's tokens: a token that was never seen says nothing
    total = np.maximum(counts.sum(1, keepdims=True), 1.0)
    log = np.log((counts + SMOOTHING * total / total.sum()) / total)
    model = Model((log - log.mean(0)).astype(np.float32).T)

    def featured(batches):
        for batch in batches:
            x = model.features(batch.column(1))[1]
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], names=["domain", "x"])

    held = rows.where("not counted").select("domain", "text").mapInArrow(featured, "domain int, x array<double>").toArrow()
    if held.num_rows:
        x = held.column("x").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1)
        order = np.lexsort(x.T)
        model.fit(x[order], held.column("domain").to_numpy()[order])
    return model


def membership(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "member") -> DataFrame:
    """docs with a column struct<n_tokens, p>: tokens of the text and its posterior over DOMAINS."""
    bounded_batches(docs.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        tokens, p = model.posteriors(text)
        at = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(DOMAINS))
        tidy()
        return pa.StructArray.from_arrays([pa.array(tokens), pa.ListArray.from_arrays(at, pa.array(p.reshape(-1)))], ["n_tokens", "p"])

    return docs.withColumn(as_col, F.arrow_udf(run, "n_tokens bigint, p array<double>")(F.col(text_col)))


class Plan:
    """Steps of the descent: a rate starts at `start`, each of `moves` (one number per domain) takes its product with the
    posterior off it, and it stays from 0 to `most`. missed: the largest error of a domain's share, as a part of the budget."""

    def __init__(self, start: float, most: float | None):
        self.start, self.most, self.moves, self.missed = float(start), most, [], 0.0

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), self.start)
        for move in self.moves:
            r = np.clip(r - p @ move, 0.0, self.most)
        return r

    def column(self, p: Column) -> Column:
        """The rate as a column: each term is a product of two plain numbers, so that it equals rates()."""
        rate = F.lit(self.start)
        if not self.moves:
            return rate
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in self.moves])

        def step(r: Column, m: Column) -> Column:
            slope = F.aggregate(F.zip_with(p, m, lambda a, e: a * e), F.lit(0.0), lambda s, x: s + x)
            moved = F.greatest(r - slope, F.lit(0.0))
            return F.least(moved, F.lit(float(self.most))) if self.most is not None else moved

        return F.aggregate(steps, rate, step)


def _sums(plan: Plan):
    """Batches of (n_tokens, p) -> tokens; tokens by domain at the rates of the plan; second moments of p over all documents, and
    over those whose rate is inside its bounds."""
    k = len(DOMAINS)

    def run(batches):
        total = np.zeros(1 + k + 2 * k * k)
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            w, r = n[:, None] * p, plan.rates(p)
            inside = (r > 0) & (r < (np.inf if plan.most is None else plan.most))
            total += np.concatenate([[n.sum()], r @ w, (w.T @ p).reshape(-1), (w[inside].T @ p[inside]).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    return run


def _solved(sums, targets, budget: float | None, most: float | None) -> Plan:
    """The descent, given sums(plan) -> what _sums gives for all documents. A step that doesn't bring the residual down is taken
    back and tried again smaller."""
    share = np.array(targets, float) / sum(targets)
    k = len(share)
    plan = Plan(1.0 if budget is None else budget, most)
    # with a free budget the aim is sum of r n (p - share) = 0 instead of sum of r n p = budget * share
    turn = np.eye(k) - (np.outer(share, np.ones(k)) if budget is None else 0)
    goal = np.zeros(k) if budget is None else budget * share
    inverse = lambda x: np.linalg.pinv(x, rcond=1e-9, hermitian=True)

    def state():
        x = sums(plan)
        if not x[0]:
            return None
        now = x[1 : 1 + k] / x[0]
        every, inside = (turn @ m @ turn.T / x[0] for m in x[1 + k :].reshape(2, k, k))
        error, scale = turn @ now - goal, now.sum() if budget is None else budget
        # nothing taken meets any shares, but isn't meant
        size = error @ inverse(every) @ error / scale**2 if scale > 0 else np.inf
        return error, np.abs(error).max() / scale if scale > 0 else np.inf, size, every, inside

    at, part = state(), 0.05
    for _ in range(STEPS if at else 0):
        error, plan.missed, size, every, inside = at
        if plan.missed <= ENOUGH:
            break
        # the metric of the rates that can move, with a part of the safe metric of all; the gradient of a rate is (turn p) times this
        plan.moves.append(turn.T @ (inverse((1 - part) * inside + part * every) @ error))
        after = state()
        if after[2] < 0.999 * size:
            at, part = after, max(part / 3, 0.01)
            plan.missed = at[1]
        else:
            plan.moves.pop()
            if part >= 1:
                break
            part = min(1.0, 3 * part)
    return plan


def fit(members: DataFrame, targets=TARGETS, budget: float | None = 1.0, most: float | None = None) -> Plan:
    """The plan of rates. members: n_tokens, p. budget: wanted tokens as a share of all, None if only the shares of the domains
    among what is taken matter; most: upper bound of a rate. An empty table, or one without tokens, gives no steps. Targets that
    cannot be met are met as nearly as possible, and far-off ones as nearly as STEPS steps come; see Plan.missed."""
    k = len(DOMAINS)
    rows = members.select("n_tokens", "p")

    def sums(plan: Plan) -> np.ndarray:
        table = rows.mapInArrow(_sums(plan), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        x = np.zeros(1 + k + 2 * k * k)
        x[table.column("i").to_numpy()] = table.column("x").to_numpy()
        return x

    return _solved(sums, targets, budget, most)


def rates(docs: DataFrame, labels: DataFrame, targets=TARGETS, budget: float | None = 1.0, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, p_<domain> for each domain, rate, missed: the largest error of a domain's share that the
    rates leave, the same in every row (see Plan).

    labels: doc_id, quality, toxic (0 or 1). Rows repeat as they do in docs; null ids teach nothing but get a rate. With no
    labels all posteriors are equal; an empty table gives an empty result. Equal texts have equal rates. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(rows, labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")))
    members = saved(membership(rows, model).select("doc_id", "member.*"))
    plan = fit(members, targets, budget, most)
    shares = [F.col("p")[c].alias(f"p_{name}") for c, name in enumerate(DOMAINS)]
    return members.select(F.col("doc_id").alias(id_col), "n_tokens", *shares, plan.column(F.col("p")).alias("rate"), F.lit(float(plan.missed)).alias("missed"))


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS, budget: float | None = None, most: float | None = 1.0) -> DataFrame:
    """docs taken at their rates: whole parts of a rate repeat a row, the rest is drawn by a hash of doc_id. Columns as they
    were, whatever their names.

    By default no row is repeated and the budget is free: rates come down from 1 only as far as the domains' shares ask for
    it. Rows that share an id, null included, are drawn by the same number; an empty table gives an empty result. Shares that are
    missed by more than WARN are told in a warning.
    """
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")))
    plan = fit(saved(membership(docs.select("text"), model).select("member.*")), targets, budget, most)
    if plan.missed > WARN:
        warnings.warn(f"a domain's share is {plan.missed:.4f} off its target", stacklevel=2)
    name = free_name(docs, "member")
    rate = plan.column(F.col(name)["p"])
    times = (F.floor(rate) + (drawn() < rate - F.floor(rate)).cast("bigint")).cast("int")
    taken = membership(docs, model, as_col=name).withColumn(name, times).where(F.col(name) > 0)
    if most is None or most > 1:
        taken = taken.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name))))
    return taken.drop(name)


def drawn() -> Column:
    """A number from [0, 1) for a row."""
    return F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")


def op2(spark, sf_dir: str) -> DataFrame:
    got = rates(documents(spark, sf_dir, "doc_id", "text"), labels_of(spark, sf_dir))
    return got.select("doc_id", "n_tokens", *[F.round(f"p_{d}", 9).alias(f"p_{d}") for d in DOMAINS], F.round("rate", 9).alias("rate"), F.round("missed", 9).alias("missed"))
