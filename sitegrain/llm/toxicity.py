"""Toxicity by a classifier chain.

Categories are predicted in order; each model is linear and sees, besides the words, the probabilities of the earlier
categories. For training these come out of folds: a row's probability is that of models that never saw it, so later
models learn from predictions as unsure as they will meet.

Features say whether a word, or a word's beginning, stands anywhere in the whole text. They are hashed; each model keeps
the ``features`` that tell its category apart best. Models are fitted on at most ``sample`` labelled rows, drawn by a
hash of doc_id; prediction is row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import extended, without
from sitegrain.llm.words import byte_hashes, runs, slices

# Categories of the labels table, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


@dataclass(frozen=True)
class ChainOptions:
    categories: Mapping[str, str] = field(default_factory=lambda: dict(CATEGORIES))  # name: condition on a label row
    sample: int = 8000  # bound of the labelled rows that models are fitted on
    bits: int = 18  # of a hashed feature
    beginnings: tuple[int, ...] = (4, 5, 6)  # bytes of a word's beginning
    features: int = 256  # of a model
    least: int = 5  # sample rows that a feature stands in
    folds: int = 5
    ridge: float = 1.0
    threshold: float = 0.3  # toxic words are sure signs, so the chance of a false alarm stays small


def features(texts: pa.Array, o: ChainOptions) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, document and feature of each pair that occurs, and the number of documents, slice by slice."""
    for s in slices(texts, lower=True):
        starts, ends, first = runs((s.data >= 128) | ((s.data >= 97) & (s.data <= 122)), s.bounds)
        doc = np.repeat(np.arange(len(s)), np.diff(first))
        found = [(doc, byte_hashes(s.data, starts, ends))]
        for size in o.beginnings:
            own = ends - starts > size
            found.append((doc[own], byte_hashes(s.data, starts[own], starts[own] + size) + np.uint64(size)))
        code = np.concatenate([d.astype(np.uint64) << np.uint64(o.bits) | (h >> np.uint64(64 - o.bits)) for d, h in found])
        code = np.unique(code)
        yield s.first, (code >> np.uint64(o.bits)).astype(np.int64), (code & np.uint64((1 << o.bits) - 1)).astype(np.int64), len(s)


@dataclass
class Link:
    """One linear model of the chain."""

    chosen: np.ndarray  # hashed features
    weights: np.ndarray  # of them, of the earlier categories' log odds, and the constant

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray, bits: int) -> np.ndarray:
        z = np.zeros(1 << bits)
        z[self.chosen] = self.weights[: len(self.chosen)]
        return _squash(np.bincount(doc, z[feature], n) + earlier @ self.weights[len(self.chosen) : -1] + self.weights[-1])


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, earlier: np.ndarray, own: np.ndarray, o: ChainOptions) -> Link:
    """Ridge logistic regression on the rows ``own``; features are chosen by how far their rate differs there."""
    use = own[doc]
    with_, of = np.bincount(feature[use], y[doc[use]], 1 << o.bits), np.bincount(feature[use], minlength=1 << o.bits)
    rate = (y[own].sum() + 1) / (own.sum() + 2)
    far = np.where(of >= o.least, np.abs(with_ - of * rate) / np.sqrt(np.maximum(of, 1) * rate * (1 - rate)), 0)
    chosen = np.sort(np.argsort(-far, kind="stable")[: o.features])
    chosen = chosen[far[chosen] > 0]
    place = np.full(1 << o.bits, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)))
    hit = place[feature] >= 0
    x[doc[hit], place[feature[hit]]] = 1
    x = np.hstack([x, earlier, np.ones((len(y), 1))])[own]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(len(w), o.ridge)
    ridge[-1] = 1e-6
    target = y[own]
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + (ridge * w * w).sum() / 2
    for _ in range(50):
        p = _squash(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        before, size = loss(w), 1.0
        while loss(w + size * step) > before and size > 1e-6:
            size /= 2
        w = w + size * step
        if before - loss(w) < 1e-9 * (1 + before):
            break
    return Link(chosen, w)


@dataclass
class Chain:
    options: ChainOptions
    links: list[Link]

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probability of every category, one column each, predicted one after the other."""
        out = np.zeros((n, 0))
        for link in self.links:
            p = link.predict(doc, feature, n, _log_odds(out), self.options.bits)
            out = np.hstack([out, p[:, None]])
        return out


def fit(docs: DataFrame, labels: DataFrame, o: ChainOptions = ChainOptions()) -> Chain:
    """Chain from ``docs(doc_id, text)`` and ``labels(doc_id, ...)``. Label rows with an unknown category are left out,
    and of repeated ones of a document the smallest stays. Without rows every probability is one half."""
    known = labels.select(F.col("doc_id").cast("bigint"), *(F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(o.categories.values())))
    known = known.dropna().groupBy("doc_id").agg(*(F.min(f"y{k}").alias(f"y{k}") for k in range(len(o.categories))))
    # Bounded by o.sample rows, so it is broadcast.
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.sample)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")
    ys = [f"y{k}" for k in range(len(o.categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc, feature, n in features(batch.column("text"), o):
                cut = np.searchsorted(doc, np.arange(n + 1))
                sets = pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(y) for y in ys), sets], names=["doc_id", *ys, "x"])

    sample = rows.mapInArrow(run, f"doc_id bigint, {', '.join(f'{y} int' for y in ys)}, x binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["x"]))
    sets = [np.frombuffer(r["x"], np.int32) for r in sample]
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    feature = np.concatenate([*sets, np.zeros(0, np.int32)]).astype(np.int64)
    # Copies of a document tend to have near ids as seldom as any; a fold is a hash of the id.
    fold = np.array([hash((r["doc_id"], 1)) % o.folds for r in sample], int)
    earlier, links = np.zeros((len(sets), 0)), []
    for y in ys:
        target = np.array([r[y] for r in sample], float)
        every = np.ones(len(sets), bool)
        links.append(_fit(doc, feature, target, earlier, every, o))
        out = np.zeros(len(sets))
        for k in range(o.folds):
            away = fold == k
            if away.any():
                out[away] = _fit(doc, feature, target, earlier, ~away, o).predict(doc, feature, len(sets), earlier, o.bits)[away]
        earlier = np.hstack([earlier, _log_odds(out)[:, None]])
    return Chain(o, links)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``p_<category>`` (0 to 1) for each category of the chain, and ``is_<category>`` (at the threshold).

    Only the text decides; a null text is an empty one. Columns of ``docs`` with one of these names are replaced;
    all others pass through unread.
    """
    o = chain.options
    names = [f"p_{c}" for c in o.categories]
    rows = without(docs, [*names, *(f"is_{c}" for c in o.categories)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(names)))
            for first, doc, feature, n in features(batch.column("text"), o):
                p[first : first + n] = shared.value.predict(doc, feature, n)
            yield batch, list(map(pa.array, p.T.copy()))

    out = extended(rows, ["text"], run, ", ".join(f"`{n}` double" for n in names))
    return out.select("*", *((F.col(f"`p_{c}`") >= o.threshold).alias(f"is_{c}") for c in o.categories))
