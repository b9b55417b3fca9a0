"""Mixing to target weights with soft domain membership.

1. A classifier (multinomial logistic regression over the words and symbols that tell most) learns the domains of a
   labelled table, from at most about ``most`` labelled ids (a documented bound; a hash of the id draws them). Telling
   features are found by sums on the executors; the driver gets ``MOST_FEATURES`` of them and which each row has.
2. It gives every document a posterior p over the domains; documents are never assigned to one domain.
3. Projected gradient fits a rate r >= 0 to every document so that the expected token totals of the domains,
   m_k = sum over d of r_d t_d p_dk, are the target weights times the budget. It minimises the squared residuals, weighed
   by each domain's natural share, plus a small ridge towards r = 1. A document's rate is the projection
   max(0, 1 - p.g / ridge) of a step along the K residuals g. Steps have a variable metric: each is one distributed sum of
   the K totals and their K x K curvature over the documents whose rate isn't held at 0. They go on until the optimality
   conditions hold within ``CLOSE``; what is left of the targets is in ``Fit``.

With soft posteriors a domain of weight 0 keeps the mass that documents of other domains have of it, so that weights are
met as nearly as rates allow. ``drawn`` keeps a document with the probability of its rate, for certain from 1 on.

Tokens are white-space words unless a column of counts is given. Defined cases: null text is empty, has no tokens, and
the posterior that features of no word give; very long texts are read in whole, one at a time; labels that are null, or of
no document, are passed over; of an id's several labels, and of the texts of a repeated id, the least is learned from;
with nothing labelled all posteriors are even; a domain that no document may belong to is left out of the residuals;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm import hashing
from wayloom.llm.common import slices, small_batches, starts, whole_text, written

MOST, MOST_FEATURES, LEAST_CHI, RIDGE, CLOSE = 6000, 2000, 25.0, 1e-2, 1e-9
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOL = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
#: Domains of op9 and the pipeline: from the labels table. Target weights; the domain of the greatest sets the budget.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = (0.97, 0.03, 0.0)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that each text has, as (text, 64-bit feature) pairs, each once, and the texts' numbers of words.

    A feature is a word in lower case (runs of letters, digits and bytes beyond ASCII), or a symbol with how common it
    is: under 1, under 10, or more in a hundred words.
    """
    data, offsets = hashing.utf8(texts)
    _, spaced = hashing.words(data, offsets)
    n = np.diff(spaced)
    word, at = hashing.words(LOWER[data], offsets, SYMBOL | hashing._SPACE)
    owner = np.repeat(np.arange(len(n)), np.diff(at))
    symbols = np.flatnonzero(SYMBOL[data])
    place = np.searchsorted(offsets, symbols, "right") - 1
    both, times = np.unique(place * 256 + data[symbols], return_counts=True)
    common = np.digitize(times / np.maximum(n[both // 256], 1), (0.01, 0.1))
    symbol = hashing.mix(((both % 256) * 4 + common).astype(np.uint64))
    owner, feature = np.concatenate([owner, both // 256]), np.concatenate([word, symbol])
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    return owner[first], feature[first], n


class Classifier:
    """Linear scores of the domains over a few thousand telling features."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.ids, self.weights, self.bias = ids, weights, bias

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        who, what, n = features(texts)
        score = np.repeat(self.bias[None, :], len(n), 0)
        if len(self.ids) and len(what):
            at = np.minimum(np.searchsorted(self.ids, what), len(self.ids) - 1)
            hit = np.flatnonzero(self.ids[at] == what)
            for j in range(len(self.bias)):
                score[:, j] += np.bincount(who[hit], self.weights[at[hit], j], len(n))
        score = np.exp(score - score.max(1, keepdims=True)) if len(n) else score
        return score / score.sum(1, keepdims=True), n


def train(chosen: np.ndarray, rows: list[tuple[np.ndarray, int]], domains: int, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Classifier:
    """Multinomial logistic regression by full-batch Adam steps on the driver, over which of ``chosen`` each row has."""
    if not rows:
        return Classifier(np.zeros(0, np.uint64), np.zeros((0, domains)), np.zeros(domains))
    who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    what = np.concatenate([r[0] for r in rows])
    want = np.eye(domains)[np.array([r[1] for r in rows])]
    w, b = np.zeros((len(chosen), domains)), np.log(want.mean(0) + 1e-3)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(domains), np.zeros(domains)
    for i in range(1, steps + 1):
        score = np.stack([np.bincount(who, w[what, j], len(rows)) for j in range(domains)], 1) + b
        p = np.exp(score - score.max(1, keepdims=True))
        miss = (p / p.sum(1, keepdims=True) - want) / len(rows)
        g = np.stack([np.bincount(what, miss[who, j], len(chosen)) for j in range(domains)], 1) + decay * w
        gb = miss.sum(0)
        for x, gx, mx, vx in ((w, g, m, v), (b, gb, mb, vb)):
            mx *= 0.9
            mx += 0.1 * gx
            vx *= 0.99
            vx += 0.01 * gx * gx
            x -= rate * (mx / (1 - 0.9**i)) / (np.sqrt(vx / (1 - 0.99**i)) + 1e-8)
    return Classifier(chosen, w, b)


def learn(labelled: DataFrame, domains: Sequence[str]) -> Classifier:
    """A classifier from a bounded sample of ``doc_id, text, domain`` rows.

    Features are the ``MOST_FEATURES`` whose chi-square statistic with a domain is greatest, ``LEAST_CHI`` at least.
    """
    names = list(domains)
    known = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select(whole_text().alias("text"), "domain")
    sample = written(known, "mix-sample")
    k = len(names)

    def count(batches):
        starts("mix")
        for batch in batches:
            for part in slices(batch, "text"):
                who, what, _ = features(part.column(0))
                label = np.array([names.index(d) for d in part.column(1).to_pylist()])
                ids, place = np.unique(what, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *(pa.array(np.bincount(place, label[who] == j, len(ids)).astype(np.int64)) for j in range(k))], ["id", *(f"n{j}" for j in range(k))])

    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return train(np.zeros(0, np.uint64), [], k)
    seen = sample.mapInArrow(count, "id bigint, " + ", ".join(f"n{j} bigint" for j in range(k))).groupBy("id").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(k)])
    docs = sum((F.col(f"n{j}") for j in range(1, k)), F.col("n0"))
    stat = []
    for j, name in enumerate(names):
        prior = sizes.get(name, 0) / total
        stat.append(F.pow(F.col(f"n{j}") - docs * prior, 2) / F.greatest(docs * (prior * (1 - prior)), F.lit(1e-9)))
    chi = F.greatest(*stat) if k > 1 else stat[0]
    best = seen.where(docs >= 3).select("id", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "id").limit(MOST_FEATURES).collect()
    chosen = np.sort(np.array([r["id"] for r in best], np.int64).view(np.uint64))

    def which(batches):
        starts("mix")
        for batch in batches:
            for part in slices(batch, "text"):
                who, what, _ = features(part.column(0))
                at = np.minimum(np.searchsorted(chosen, what), max(len(chosen) - 1, 0))
                hit = chosen[at] == what if len(chosen) else np.zeros(len(what), bool)
                who, at = who[hit], at[hit].astype("<i4")
                cut = np.searchsorted(who, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([at[cut[i] : cut[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()), pa.array([names.index(d) for d in part.column(1).to_pylist()], pa.int32())], ["ids", "domain"])

    rows = sorted((bytes(r["ids"]), r["domain"]) for r in sample.mapInArrow(which, "ids binary, domain int").collect())
    return train(chosen, [(np.frombuffer(a, "<i4"), d) for a, d in rows], k)


@dataclasses.dataclass(frozen=True)
class Fit:
    """Residuals ``g`` that rates follow from, the weights that are attained, and how far optimality is missed."""

    g: np.ndarray
    ridge: float
    weights: np.ndarray
    miss: float

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - posteriors @ self.g / self.ridge)


def fit(scored: DataFrame, targets: Sequence[float], budget: float | None = None, ridge: float = RIDGE, close: float = CLOSE) -> Fit:
    """The rates of ``n_tokens, p`` rows that meet the targets best.

    They minimise sum over k of (m_k - want_k)^2 / share_k + ridge sum over d of t_d (r_d - 1)^2, in shares of all tokens.
    ``budget`` is in tokens; without one it is what uses the domain of the greatest target once.
    """
    goal = np.array(targets, float) / max(sum(targets), 1e-300)
    k = len(goal)
    flat = scored.select("n_tokens", *[F.col("p")[j].alias(f"p{j}") for j in range(k)])

    def totals(g):
        """The domains' totals at the rates of ``g``, and their curvature over the documents with a rate above 0."""

        def run(batches):
            starts("mix")
            out = np.zeros(k + k * k)
            for batch in batches:
                if batch.num_rows:
                    p = np.stack([batch.column(1 + j).to_numpy() for j in range(k)], 1)
                    t = batch.column(0).to_numpy().astype(float)
                    r = np.maximum(0.0, 1.0 - p @ g / ridge)
                    out[:k] += (t * r) @ p
                    out[k:] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["x"])

        parts = flat.mapInArrow(run, "x array<double>")
        sums = np.array(parts.agg(*[F.coalesce(F.sum(F.col("x")[j]), F.lit(0.0)) for j in range(k + k * k)]).head(), float)
        return sums[:k], sums[k:].reshape(k, k)

    g = np.zeros(k)
    natural, _ = totals(g)
    whole = natural.sum()
    if whole <= 0:
        return Fit(g, ridge, natural, 0.0)
    share = natural / whole
    if budget is None:
        budget = whole * share[goal.argmax()] / max(goal.max(), 1e-300)
    want = goal * budget / whole
    scale = np.where(share > 0, 1 / np.maximum(share, 1e-12), 0)

    def at(g):
        m, curve = totals(g)
        return m / whole, curve / whole, g - scale * (m / whole - want)

    now, curve, miss = at(g)
    step = None
    while np.abs(miss).max() > close:
        if step is None:
            step = np.linalg.solve(np.eye(k) + scale[:, None] * curve / ridge, miss)
        tried = at(g - step)
        if np.abs(tried[2]).max() < np.abs(miss).max():
            g, (now, curve, miss), step = g - step, tried, None
        elif np.abs(step).max() < 1e-15 * max(1.0, np.abs(g).max()):
            break  # as near as floating point comes
        else:
            step = step / 2
    return Fit(g, ridge, now / max(now.sum(), 1e-300), float(np.abs(miss).max()))


def posteriors(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text", tokens: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, p`` of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        starts("mix")
        for batch in batches:
            for part in slices(batch, "text"):
                p, n = classifier.posteriors(part.column(1))
                held = part.column(2).to_numpy(zero_copy_only=False) if tokens else n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    count = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)) if tokens else F.lit(0).cast("bigint")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"), count.alias("given"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, p array<double>")


def with_rates(scored: DataFrame, fitted: Fit) -> DataFrame:
    """``doc_id, n_tokens, p, rate``."""

    def run(batches):
        starts("mix")
        for batch in batches:
            p = np.array(batch.column(2).to_pylist()) if batch.num_rows else np.zeros((0, 1))
            rate = fitted.rates(p) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["doc_id", "n_tokens", "p", "rate"])

    return scored.mapInArrow(run, "doc_id bigint, n_tokens bigint, p array<double>, rate double")


def label_domains(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, text, domain`` of about ``most`` labelled ids, one row each.

    The draw is from the labels alone, so that its bound is also the bound of what is broadcast.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    named = labels.select(F.col("doc_id").cast("bigint").alias("id"), domain.alias("domain")).where("domain is not null and id is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    n = named.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = F.broadcast(named.where(draw < min(1.0, most / max(n, 1))))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).join(chosen, F.col("doc_id") == F.col("id"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, domains: Sequence[str] = DOMAINS, targets: Sequence[float] = TARGETS, budget: float | None = None) -> DataFrame:
    """``doc_id, n_tokens, p, rate`` of every row of ``docs``."""
    classifier = learn(labelled, domains)
    scored = written(posteriors(docs, classifier), "mix-posteriors")
    return with_rates(scored, fit(scored, targets, budget))


def drawn(rate: Column, key: Column) -> Column:
    """Whether a document stays: with the probability of its rate, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1_000_003)) / 1_000_003.0 < rate


RATE = "__wayloom_rate"


def mixed(docs: DataFrame, labels: DataFrame, domains: Sequence[str] = DOMAINS, targets: Sequence[float] = TARGETS) -> DataFrame:
    """The rows of ``docs`` that their rates keep, with all their columns; the second scoring saves a join of whole rows."""
    classifier = learn(label_domains(docs, labels), domains)
    fitted = fit(written(posteriors(docs, classifier), "mix-posteriors"), targets)
    at = docs.columns.index("text")

    def run(batches):
        starts("mix")
        for batch in batches:
            for part in slices(batch, "text"):
                p, _ = classifier.posteriors(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fitted.rates(p))], [*part.schema.names, RATE])

    schema = T.StructType([*docs.schema.fields, T.StructField(RATE, T.DoubleType())])
    return docs.mapInArrow(run, schema).where(drawn(F.col(RATE), F.col("doc_id"))).drop(RATE)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rates = mix(docs, label_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rates.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", drawn(F.col("rate"), F.col("doc_id")).alias("kept"))
