"""Mixing documents to target weights with soft domain membership.

A classifier fitted on labelled rows predicts each document's domain posteriors. Nonnegative document rates are then
fitted by projected-gradient least squares, so that the expected tokens of every domain match the targets. Documents
stay on the executors; a step moves a few sums to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import land, remove, text_or_empty, work_dir
from spatialcc.llm.quality import OWN, line_features, sample_features
from spatialcc.llm.token_counts import counter
from spatialcc.llm.wordhash import LOWER, SLICE, bounded_hashes, buffers, word_bounds, word_table

#: Domains: quality and toxicity as labelled.
DOMAINS = ("clean", "toxic", "junk", "junk_toxic")
#: Target share of each domain in the mixture's tokens.
TARGETS = (0.94, 0.03, 0.02, 0.01)
#: Documents that the classifier is fitted on, at most, and bytes of their features, at most: a bounded sample of the
#: labelled rows. Documents count whole.
SAMPLE, SAMPLE_BYTES = 4000, 16_000_000
#: Log2 of the number of hashed word features; bytes of a word's beginning, which is a feature, too.
BITS, STEM = 16, 6
#: Standard errors by which a word's log rates in two kinds of texts must differ.
SURE = 2.5
#: Looks at all rows that the fit takes, at most; the residual, as a share of all tokens, at which it ends; the share that
#: a step must take from the squares; the damping of its scaling, as shares of all tokens.
LOOKS, TOLERANCE, STALL, RIDGES = 30, 1e-6, 1e-2, (1e-9, 1e-7, 1e-5, 1e-3, 1e-1)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Classifier:
    """Weights of hashed words and of dense line statistics, and the class biases."""

    words: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    center: np.ndarray
    spread: np.ndarray


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (text, slot), dense features and word counts of texts.

    Word features are which runs of letters a text has, and which beginnings of them, without case.
    """
    table = word_table(data, at)
    bounds = [b[:2] for b in word_bounds(data, at, lambda piece: _LETTER[piece])]
    starts = np.concatenate([b[0] for b in bounds]) if bounds else np.zeros(0, np.int64)
    ends = np.concatenate([b[1] for b in bounds]) if bounds else np.zeros(0, np.int64)
    texts = np.searchsorted(at, starts, side="right") - 1
    slots = []
    for hashes in (bounded_hashes(data, starts, ends, LOWER), ~bounded_hashes(data, starts, np.minimum(ends, starts + STEM), LOWER)):
        slots.append((texts << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    pairs = np.unique(np.concatenate(slots))
    own, size, first = line_features(data, at, table)
    weight = size.astype(float) + 1e-3
    dense = np.add.reduceat(own * weight[:, None], first[:-1]) / np.add.reduceat(weight, first[:-1])[:, None]
    return pairs >> BITS, pairs & ((1 << BITS) - 1), dense, table[3]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_classifier(owner: np.ndarray, slot: np.ndarray, dense: np.ndarray, domains: np.ndarray, rounds: int = 120) -> Classifier:
    """Multinomial logistic regression, full gradients with momentum, a ridge on words.

    owner, slot: which text has which word feature. A feature weighs by the log of how much more often it stands in toxic
    or junk texts than in others, or the other way round; where that is below SURE standard errors it isn't used. So
    the few words that tell a domain aren't lost among the many.
    """
    k, n = len(DOMAINS), len(dense)
    center, spread = dense.mean(0), dense.std(0) + 1e-3
    z = (dense - center) / spread
    y = np.eye(k)[domains]
    used, slot = np.unique(slot, return_inverse=True)
    seen = np.column_stack([np.bincount(slot, y[owner, c], minlength=len(used)) for c in range(k)])
    sizes = np.maximum(y.sum(0), 1)
    value = np.zeros(len(used))
    for one, other in (((0, 2), (1, 3)), ((0, 1), (2, 3))):  # not toxic or toxic, good or junk
        a, b = seen[:, one].sum(1) + 0.5, seen[:, other].sum(1) + 0.5
        ratio = np.log(a / (sizes[list(one)].sum() + 1)) - np.log(b / (sizes[list(other)].sum() + 1))
        sure = np.abs(ratio) >= SURE * np.sqrt(1 / a + 1 / b)
        value = np.maximum(value, np.where(sure, np.minimum(np.abs(ratio), 3), 0))
    params = [np.zeros((len(used), k)), np.zeros((z.shape[1], k)), np.log(y.mean(0) + 1e-3)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    on = value[slot] > 0
    owner, slot = owner[on], slot[on]
    weight = value[slot]
    for step in range(1, rounds + 1):
        scores = z @ params[1] + params[2]
        for c in range(k):
            scores[:, c] += np.bincount(owner, weight * params[0][slot, c], minlength=n)
        error = (_softmax(scores) - y) / n
        grads = [np.column_stack([np.bincount(slot, weight * error[owner, c], minlength=len(used)) for c in range(k)]) + 1e-4 * params[0], z.T @ error + 1e-5 * params[1], error.sum(0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    words = np.zeros((1 << BITS, k), np.float32)
    words[used] = params[0] * value[:, None]
    return Classifier(words, params[1], params[2], center, spread)


def posteriors(model: Classifier, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Domain posteriors and word counts of texts, a few slices at a time."""
    data, at = buffers(column)
    out, sizes, lo = [np.zeros((0, len(DOMAINS)))], [np.zeros(0, np.int64)], 0
    telling = model.words.any(1)
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * SLICE))), len(at) - 1)
        owner, slot, dense, counts = _features(data, at[lo : hi + 1])
        on = telling[slot]
        owner, slot = owner[on], slot[on]
        scores = ((dense - model.center) / model.spread) @ model.dense + model.bias
        for c in range(len(DOMAINS)):
            scores[:, c] += np.bincount(owner, model.words[slot, c], minlength=hi - lo)
        out.append(_softmax(scores))
        sizes.append(counts)
        lo = hi
    return np.concatenate(out), np.concatenate(sizes)


def _word_arrays(column: pa.Array) -> list[pa.Array]:
    """Word features and dense features of each text as bytes, and how many."""
    data, at = buffers(column)
    slots, rows, lo = [], [], 0
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * SLICE))), len(at) - 1)
        owner, slot, dense, _ = _features(data, at[lo : hi + 1])
        slots += [x.astype(np.int32).tobytes() for x in np.split(slot, np.searchsorted(owner, np.arange(1, hi - lo)))]
        rows += [x.astype(np.float64).tobytes() for x in dense]
        lo = hi
    return [pa.array(slots, pa.binary()), pa.array(rows, pa.binary()), pa.array([len(a) + len(b) for a, b in zip(slots, rows, strict=True)], pa.int64())]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most `sample` labelled rows, those with the smallest hashes of their id, of SAMPLE_BYTES features at most."""
    domain = F.when(F.col("quality") == 1, 0).otherwise(2) + F.when(F.col("toxic") == 1, 1).otherwise(0)
    usable = labels.filter("quality is not null and toxic is not null").select(F.col("doc_id").alias("_id"), domain.alias("_label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = sample_features(docs, chosen, _word_arrays, "slots binary, dense binary, n bigint", SAMPLE_BYTES, "doc_id", "text")
    if not rows:
        return Classifier(np.zeros((1 << BITS, len(DOMAINS)), np.float32), np.zeros((OWN, len(DOMAINS))), np.zeros(len(DOMAINS)), np.zeros(OWN), np.ones(OWN))
    owner = np.repeat(np.arange(len(rows)), [len(r["slots"]) // 4 for r in rows])
    slot = np.frombuffer(b"".join(r["slots"] for r in rows), np.int32)
    dense = np.frombuffer(b"".join(r["dense"] for r in rows), np.float64).reshape(-1, OWN)
    return fit_classifier(owner, slot, dense, np.array([r["_label"] for r in rows]))


def domain_posteriors(docs: DataFrame, model: Classifier, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, p): tokens are the tokenizer's, or words without one; p has one posterior for each of DOMAINS."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Callable[[list[str]], list[int]] | None = counter(tokenizer) if tokenizer else None
        for batch in batches:
            texts = batch.column("text")
            p, n = posteriors(model, texts)
            if count:
                n = [x for i in range(0, len(texts), 64) for x in count(texts.slice(i, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, p array<double>")


def rate_after(steps: list[np.ndarray], start: Column | None = None) -> Column:
    """A document's rate after steps along its posteriors, each projected onto what isn't negative before the next."""
    rate = F.lit(1.0) if start is None else start
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col("p")[i] * float(x) for i, x in enumerate(step)), F.lit(0.0)))
    return rate


@dataclass
class Fit:
    """Members with their rates, the largest distance of a domain from its target as a share of all tokens, and whether that is within TOLERANCE."""

    members: DataFrame
    residual: float
    converged: bool


def fit_rates(members: DataFrame, targets: np.ndarray, looks: int = LOOKS, written: int = 8) -> Fit:
    """Projected gradient on the documents' rates, from 1, for the least squares of domain tokens against the targets.

    In the metric of a document's tokens the gradient moves its rate along its posteriors, by the same few numbers (the
    gaps of the domains) for all documents; each step is projected before the next. The gaps are scaled by the second
    moments of the posteriors of documents with a rate above zero, damped by each of RIDGES, and the step that lessens
    the squares most is taken. A look tries all of them in one pass over the rows and brings a few sums to the driver.
    Rates follow from the steps; after `written` steps they are written to the shared folder. The fit ends at TOLERANCE,
    where no step lessens the squares by STALL, or after `looks` looks; the result says how far it came.
    """
    spark, k, total = members.sparkSession, len(targets), max(float(targets.sum()), 1.0)
    upper = np.triu_indices(k)
    base, place = members.withColumn("start", F.lit(1.0)), None
    steps: list[np.ndarray] = []

    def look(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Gaps and second moments after each of the tried steps."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(tried), k + len(upper[0])))
            for batch in batches:
                n = batch.column("n_tokens").to_numpy().astype(float)
                p = batch.column("p").flatten().to_numpy().reshape(-1, k)
                rate = batch.column("start").to_numpy()
                for step in steps:
                    rate = np.maximum(0.0, rate - p @ step)
                for i, step in enumerate(tried):
                    now = np.maximum(0.0, rate - p @ step)
                    sums[i, :k] += p.T @ (n * now)
                    sums[i, k:] += (p.T @ (p * np.where(now > 0, n, 0.0)[:, None]))[upper]
            yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], ["at", "value"])

        parts = base.select("n_tokens", "p", "start").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        values = np.zeros((len(tried), k + len(upper[0])))
        for row in parts.collect():  # a number for each sum
            values.ravel()[row["at"]] = row["value"]
        out = []
        for row in values:
            second = np.zeros((k, k))
            second[upper] = row[k:]
            out.append((row[:k] - targets, second + np.triu(second, 1).T))
        return out

    [(gap, second)] = look([np.zeros(k)])
    used = 1
    while used < looks and np.abs(gap).max() > TOLERANCE * total:
        tried = [np.linalg.solve(second + ridge * total * np.eye(k), gap) for ridge in RIDGES]
        found = look(tried)
        used += 1
        best = min(range(len(tried)), key=lambda i: (found[i][0] ** 2).sum())
        if (found[best][0] ** 2).sum() >= (1 - STALL) * (gap**2).sum():
            break
        steps, (gap, second) = [*steps, tried[best]], found[best]
        if len(steps) == written:
            old, place = place, work_dir(spark, "rates")
            base, steps = land(base.withColumn("start", rate_after(steps, F.col("start"))), place), []
            if old:
                remove(spark, old)
    residual = float(np.abs(gap).max() / total)
    return Fit(base.withColumn("rate", rate_after(steps, F.col("start"))).drop("start"), residual, residual <= TOLERANCE)


def mix(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...] = TARGETS, total: float | None = None, sample: int = SAMPLE, tokenizer: str | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, domain, p_<domain>, rate, expected_tokens, residual, converged.

    rate is how often a document is expected in the mixture; the sums of expected_tokens times the posteriors match
    shares times `total` (all tokens of `docs` if not given) as closely as nonnegative rates can. residual is the largest
    distance of a domain from its target as a share of all tokens, and converged whether it is below TOLERANCE: it isn't
    where a target is out of reach, as that of a domain that no document is likely to belong to. tokenizer: the file
    whose tokens count; without one tokens are words. Null and empty texts have no tokens; repeated rows and null ids
    take part like all others; an empty table gives an empty result; extra columns are ignored, p_* among them.
    """
    spark = docs.sparkSession
    members = land(domain_posteriors(docs, train(docs, labels, sample), tokenizer), work_dir(spark, "posteriors"))
    if total is None:
        total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    wanted = np.asarray(shares, float) / sum(shares) * total
    fit = fit_rates(members, wanted) if total else Fit(members.withColumn("rate", F.lit(1.0)), 0.0, True)
    best = F.array_position("p", F.array_max("p")).cast("int")
    return fit.members.select(
        "doc_id",
        "n_tokens",
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), best).alias("domain"),
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        "rate",
        (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"),
        F.lit(fit.residual).alias("residual"),
        F.lit(fit.converged).alias("converged"),
    )
