"""Line quality by a linear-chain conditional random field.

Every line of a text is a node with two states, bad (0) and good (1). Node scores come from features of the line and of
its neighbours; edge scores tie neighbouring labels. Forward-backward gives each line's marginal, and the marginals,
weighted by line length, give the document's quality. Node and edge weights are fitted together by the chain's
regularised likelihood on a bounded sample of labelled documents. A document's lines all carry its label, so the sample's
documents are strung together for it: labels change where documents meet, which gives edges a finite optimum. A
two-number calibration maps the weighted marginal to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import land, remove, text_or_empty, work_dir
from spatialcc.llm.wordhash import BLANK, LOWER, SLICE, buffers, word_table

#: Documents that the field is fitted on, at most, and bytes of their lines' features, at most: a bounded sample, even over
#: all labelled training rows. Documents count whole.
SAMPLE, SAMPLE_BYTES = 4000, 8_000_000
#: Lines of a chain of the fit: the strung documents are cut into pieces of this length. The ridge on all weights.
PIECE, RIDGE = 64, 1e-3
#: Score from which a document is predicted good.
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord(c) for c in "!?"]] = True
_MARKUP = np.zeros(256, bool)
_MARKUP[[ord(c) for c in "<>{}[]|\\/=_"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _STOP | _SHOUT | _MARKUP)
_CLASSES = [_UPPER, _LETTER, _DIGIT, _STOP, _SHOUT, _MARKUP, _SYMBOL, BLANK]
#: Own features of a line; each line also has those of the line before and the line after, and a constant.
OWN = 14


@dataclass
class Field:
    """A fitted field: node weights, edge weights [from, to], and the calibration of the weighted marginal's log-odds."""

    node: np.ndarray
    edge: np.ndarray
    scale: float
    shift: float


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines, and for each text the index of its first line; every text has at least one."""
    lo, hi = int(at[0]), int(at[-1])
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo + 1
    # A text's own start is a line start even where the text is empty; a break at its very end opens an empty last line.
    owner = np.searchsorted(at, breaks - 1, side="right") - 1
    starts = np.concatenate([at[:-1], breaks])
    texts = np.concatenate([np.arange(len(at) - 1), owner])
    order = np.lexsort((np.concatenate([np.zeros(len(at) - 1, np.int8), np.ones(len(breaks), np.int8)]), starts, texts))
    first = np.searchsorted(texts[order], np.arange(len(at)))
    return starts[order], first


def line_features(data: np.ndarray, at: np.ndarray, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line, line lengths in bytes, and for each text the index of its first line. words: word_table(), if it is there."""
    starts, first = _lines(data, at)
    lo, hi = int(at[0]), int(at[-1])
    ends = np.append(starts[1:], hi)
    texts = np.repeat(np.arange(len(at) - 1), np.diff(first))
    ends = np.minimum(ends, at[texts + 1])
    size = ends - starts
    counts = np.zeros((len(starts), len(_CLASSES)))
    piece = data[lo:hi]
    for k, cls in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(cls[piece], dtype=np.int64)])
        counts[:, k] = sums[ends - lo] - sums[starts - lo]
    hashes, begin, stop, _ = word_table(data, at, LOWER) if words is None else words
    line = np.searchsorted(starts, begin, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.zeros(len(begin))
    if len(begin) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line, same, minlength=len(starts))
    # Distinct words of a line.
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(order))
    if len(order) > 1:
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], fresh, minlength=len(starts))
    # Words that end in a mark or are a mark alone.
    tail = data[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    odd = np.bincount(line, (_SYMBOL | _SHOUT | _MARKUP)[tail], minlength=len(starts)) if len(line) else np.zeros(len(starts))
    long = np.bincount(line, np.minimum((stop - begin) / 12.0, 5), minlength=len(starts)) if len(line) else np.zeros(len(starts))
    solid = np.maximum(size - counts[:, 7], 1)
    per = np.maximum(n_words, 1)
    own = np.column_stack(
        [
            counts[:, 0] / np.maximum(counts[:, 1], 1),
            counts[:, 1] / solid,
            counts[:, 2] / solid,
            np.minimum(counts[:, 3] / per, 2),
            np.minimum(counts[:, 4] / per, 2),
            np.minimum(counts[:, 5] / per, 2),
            np.minimum(counts[:, 6] / per, 2),
            again / per,
            distinct / per,
            odd / per,
            long / per,
            np.log1p(n_words) / 5,
            np.log1p(size) / 8,
            (n_words == 0).astype(float),
        ]
    )
    return own, size, first


def node_features(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's own features, those of the lines before and after it in its text (zero outside), and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = first[:-1]
    before[heads] = 0
    after[first[1:] - 1] = 0
    at_edge = np.zeros((n, 2), own.dtype)
    at_edge[heads, 0] = 1
    at_edge[first[1:] - 1, 1] = 1
    return np.column_stack([own, before, after, at_edge, np.ones(n, own.dtype)])


def _passes(score: np.ndarray, edge: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores of all that comes before and after each line, by its state; chains advance together, one line at a time.

    score: the good state's node score (the bad state's is 0). Chains are taken longest first, so a step costs only
    what is still running.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = first[:-1][order], sizes[order]
    fore = np.zeros((len(score), 2))
    back = np.zeros((len(score), 2))
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains with more lines than the step
    for t in range(steps):
        at = heads[: running[t]] + t
        if t == 0:
            fore[at, 1] = score[at]
            continue
        prev = fore[at - 1]
        fore[at, 0] = np.logaddexp(prev[:, 0] + edge[0, 0], prev[:, 1] + edge[1, 0])
        fore[at, 1] = np.logaddexp(prev[:, 0] + edge[0, 1], prev[:, 1] + edge[1, 1]) + score[at]
    for t in range(steps - 2, -1, -1):
        at = heads[: running[t + 1]] + t
        nxt, bonus = back[at + 1], score[at + 1]
        back[at, 0] = np.logaddexp(nxt[:, 0] + edge[0, 0], nxt[:, 1] + edge[0, 1] + bonus)
        back[at, 1] = np.logaddexp(nxt[:, 0] + edge[1, 0], nxt[:, 1] + edge[1, 1] + bonus)
    return fore, back


def _good(fore: np.ndarray, back: np.ndarray) -> np.ndarray:
    odds = fore[:, 1] + back[:, 1] - fore[:, 0] - back[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def marginals(score: np.ndarray, edge: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(good) of every line by forward-backward; score is the good state's node score, first has each chain's first line."""
    return _good(*_passes(score, edge, first))


def likelihood(score: np.ndarray, edge: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the log-likelihood of the labels y, and its gradients by node score and by edge."""
    fore, back = _passes(score, edge, first)
    last = first[1:] - 1
    total = np.logaddexp(fore[last, 0], fore[last, 1])
    inner = np.ones(len(score), bool)
    inner[last] = False
    a = np.flatnonzero(inner)
    z = np.repeat(total, np.diff(first))[a]
    by_edge, said = np.zeros((2, 2)), float(total.sum() - score[y == 1].sum())
    for i in (0, 1):
        for j in (0, 1):
            seen = int(((y[a] == i) & (y[a + 1] == j)).sum())
            by_edge[i, j] = np.exp(fore[a, i] + edge[i, j] + (score[a + 1] if j else 0.0) + back[a + 1, j] - z).sum() - seen
            said -= seen * edge[i, j]
    return said, _good(fore, back) - y, by_edge


def _weighted(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean marginal of each text, lines weighted by their length; a text without characters counts its lines evenly."""
    weight = size.astype(float)
    total = np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)
    empty = np.repeat(total == 0, np.diff(first))
    weight[empty] = 1
    return np.add.reduceat(weight * good, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def fit_field(own: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 300, joint: int = 80) -> Field:
    """Fit a field on the lines of labelled texts: own features, lengths, each text's first line, and the texts' labels.

    Node weights start from a regression of single lines, every text and class of equal weight. Then node and edge
    weights move together along the gradient of the chain's likelihood, which forward-backward gives, with a ridge.
    Last, a two-number calibration is fitted on document level, each text a chain of its own as in scoring.
    """
    z = node_features(own.astype(np.float32), first)
    want = np.asarray(labels, float)
    y = np.repeat(want, np.diff(first))
    weight = np.sqrt(np.maximum(size, 1)).astype(float)
    weight = weight / np.repeat(np.add.reduceat(weight, first[:-1]), np.diff(first))
    good = max(float(want.mean()), 1e-3)
    weight *= np.where(y == 1, 0.5 / good, 0.5 / max(1 - good, 1e-3))
    weight = (weight / weight.sum()).astype(np.float32)
    center, spread = z.mean(0, dtype=float), z.std(0, dtype=float) + 1e-6
    center[-1], spread[-1] = 0, 1
    z -= center.astype(np.float32)
    z /= spread.astype(np.float32)
    # The texts in the order of the sample are one string of lines, cut into pieces.
    cuts = np.append(np.arange(0, len(y), PIECE), len(y))
    w, edge = np.zeros(z.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)

    def move(g: np.ndarray, step: int, rate: float) -> None:
        m[:] = 0.9 * m + 0.1 * g
        v[:] = 0.99 * v + 0.01 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w[:] -= change[:-4]
        edge[:] -= change[-4:].reshape(2, 2)

    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32), -60, 60)))
        move(np.append(z.T @ (weight * (p - y).astype(np.float32)) + 1e-4 * w, np.zeros(4)), step, 0.1)
    m[:], v[:] = 0, 0
    for step in range(1, joint + 1):
        _, by_node, by_edge = likelihood((z @ w.astype(np.float32)).astype(float), edge, cuts, y)
        by_line = np.append(z.T @ by_node.astype(np.float32), by_edge.ravel()) / len(y)
        move(by_line + RIDGE * np.append(w, edge.ravel()), step, 0.05)
    node = w / spread
    node[-1] -= (w * center / spread).sum()
    field = Field(node, edge, 1.0, 0.0)
    raw = np.clip(_weighted(marginals((z @ w.astype(np.float32)).astype(float), edge, first), size, first), 1e-4, 1 - 1e-4)
    odds = np.log(raw / (1 - raw))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-(a * odds + b)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - want) * odds).sum() + 1e-2 * (a - 1), (p - want).sum()])
        hess = np.array([[(h * odds * odds).sum() + 1e-2, (h * odds).sum()], [(h * odds).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    field.scale, field.shift = float(max(a, 1e-3)), float(b)
    return field


def scores(field: Field, column: pa.Array) -> np.ndarray:
    """Quality of each text, a few megabytes of texts at a time."""
    data, at = buffers(column)
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * SLICE))), len(at) - 1)
        own, size, first = line_features(data, at[lo : hi + 1])
        raw = _weighted(marginals(node_features(own, first) @ field.node, field.edge, first), size, first)
        raw = np.clip(raw, 1e-4, 1 - 1e-4)
        out.append(1 / (1 + np.exp(-(field.scale * np.log(raw / (1 - raw)) + field.shift))))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_features(docs: DataFrame, chosen: DataFrame, features, schema: str, most: int, doc_id: str, text: str) -> list:
    """Features of the chosen labelled rows, made where the texts are; rows of a fit, in the order of a hash of their ids.

    chosen: (_id, _label), a bounded number of rows. features: a text column to arrays of `schema`, whose last column
    has the bytes of each row. Rows are taken in order as long as `most` bytes reach; only these come to the driver.
    """
    spark, place = docs.sparkSession, work_dir(docs.sparkSession, "sample")
    chosen = F.broadcast(chosen.withColumn("_hash", F.xxhash64("_id")))
    rows = docs.join(chosen, docs[doc_id] == chosen["_id"]).select("_hash", "_label", text_or_empty(text).alias("_text"))
    names = ["_hash", "_label", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column("_hash"), part.column("_label"), *features(part.column("_text"))], names)

    found = land(rows.mapInArrow(run, f"_hash bigint, _label int, {schema}"), place)
    sizes = sorted((r["_hash"], r[1]) for r in found.select("_hash", names[-1]).collect())
    sums = np.cumsum([0, *[n for _, n in sizes]])
    keep = sizes[: max(1, int((sums[1:] <= most).sum()))]
    kept = found.filter(F.col("_hash") <= keep[-1][0]).collect() if keep else []
    remove(spark, place)
    return sorted(kept, key=lambda r: tuple(r))


def _line_arrays(column: pa.Array) -> list[pa.Array]:
    """Line lengths and own features of each text as bytes, and how many."""
    data, at = buffers(column)
    sizes, owns, lo = [], [], 0
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * SLICE))), len(at) - 1)
        own, size, first = line_features(data, at[lo : hi + 1])
        sizes += [x.astype(np.int32).tobytes() for x in np.split(size, first[1:-1])]
        owns += [x.astype(np.float32).tobytes() for x in np.split(own, first[1:-1])]
        lo = hi
    return [pa.array(sizes, pa.binary()), pa.array(owns, pa.binary()), pa.array(map(len, owns), pa.int64())]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """Fit the field on at most `sample` labelled rows that are not held out, the ones with the smallest hashes of their id.

    Features of lines are made where the texts are; the driver gets SAMPLE_BYTES of them at most. Without usable
    labels, or with labels of one kind only, the field scores every document 0.5 or its class's share.
    """
    usable = labels.filter(~held_out(doc_id) & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = sample_features(docs, chosen, _line_arrays, "sizes binary, own binary, n bigint", SAMPLE_BYTES, doc_id, text)
    kinds = {r["_label"] for r in rows}
    if len(kinds) < 2:
        share = 0.5 if not rows else (0.95 if kinds == {1} else 0.05)
        return Field(np.zeros(3 * OWN + 3), np.zeros((2, 2)), 1.0, float(np.log(share / (1 - share))))
    size = np.frombuffer(b"".join(r["sizes"] for r in rows), np.int32)
    own = np.frombuffer(b"".join(r["own"] for r in rows), np.float32).reshape(-1, OWN)
    first = np.concatenate([[0], np.cumsum([len(r["sizes"]) // 4 for r in rows])])
    return fit_field(own, size, first, np.array([r["_label"] for r in rows]))


def score_documents(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows (doc_id, score) of `docs`; null, empty and very long texts are scored like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(field, batch.column("text")), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted.

    Only texts are read for a score. Repeated rows get equal scores; null ids are kept (the empty text stands for their
    id, so they count as held out); an empty table gives an empty result.
    """
    scored = score_documents(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of `docs` that the field doesn't reject, with all their columns.

    Scores are computed next to the rows, so no join is needed.
    """
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(scores(field, batch.column(fields.names.index(text))) >= THRESHOLD)
            yield batch.filter(keep)

    return docs.mapInArrow(run, fields)
