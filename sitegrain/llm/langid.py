"""Hierarchical language identification.

Byte n-grams of the whole text are hashed into one frequency vector. A first level tells language families
apart, a second one the languages within the family found; both are one-versus-one linear support vector
machines. They are fitted on a bounded sample: at most ``per_language`` rows of each language and ``sample`` rows
in all, drawn by a hash of doc_id. Prediction runs row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import extended, without
from sitegrain.llm.words import Slice, slices
from sitegrain.operators.ordered import top_k

UNKNOWN = "und"

# Languages by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr gu pa ne ur si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}


@dataclass(frozen=True)
class LanguageOptions:
    bits: int = 12  # of the hashed n-gram vector
    longest: int = 3  # bytes of the longest n-gram
    per_language: int = 400  # bound of the training sample of each language
    sample: int = 8000  # and of all of them
    epochs: int = 30
    cost: float = 1.0
    families: dict[str, str] = field(default_factory=lambda: {code: f for f, codes in FAMILIES.items() for code in codes.split()})


def vectors(s: Slice, first: int, stop: int, o: LanguageOptions) -> np.ndarray:
    """n-gram frequencies of documents ``first`` to ``stop`` of a slice; each length weighs the same.

    Bytes that are no letters count as one blank.
    """
    begin, end = s.bounds[first], s.bounds[stop]
    data = s.data[begin:end].astype(np.uint64)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data, np.uint64(32))
    bounds = s.bounds[first : stop + 1] - begin
    doc = np.repeat(np.arange(stop - first), np.diff(bounds))
    out = np.zeros((stop - first, 1 << o.bits), np.float32)
    code = np.zeros(len(data), np.uint64)
    for n in range(1, o.longest + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] if n == 1 else code[:-1]) * np.uint64(257) + data[n - 1 :]
        inside = doc[: len(code)] == doc[n - 1 :]
        slot = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - o.bits)
        at = doc[: len(code)][inside] * (1 << o.bits) + slot[inside].astype(np.int64)
        counts = np.bincount(at, minlength=out.size).reshape(out.shape)
        out += counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) / o.longest
    return np.sqrt(out)


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights of a linear support vector machine (labels -1, 1), by coordinate descent on its dual."""
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    square = np.array([(v * v).sum() for v in x])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            if square[i]:
                new = min(max(a[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), cost)
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


@dataclass
class Duel:
    """One-versus-one machines of some classes."""

    classes: list[str]
    weights: np.ndarray  # one column for each pair of classes, in the order of combinations()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the class with most votes (ties: larger sum of margins), and a confidence from 0.5 to 1."""
        if len(self.classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            m = margins[:, k]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            sums[:, a] += m
            sums[:, b] -= m
        best = np.argmax(votes + sums / (1 + 2 * np.abs(sums).max(axis=1, keepdims=True) * len(self.classes)), axis=1)
        mean = np.abs(sums[np.arange(len(x)), best]) / (len(self.classes) - 1)
        return best, 1 / (1 + np.exp(-2 * mean))


@dataclass
class LanguageModel:
    options: LanguageOptions
    family: Duel | None = None
    within: dict[str, Duel] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if self.family is None:
            return names, scores
        best, sure = self.family.predict(x)
        for k, family in enumerate(self.family.classes):
            own = np.flatnonzero(best == k)
            if len(own):
                duel = self.within[family]
                inner, more = duel.predict(x[own])
                names[own] = np.array(duel.classes, dtype=object)[inner]
                scores[own] = sure[own] * more
        return names, scores


def fit(rows: DataFrame, o: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Model from ``rows(doc_id, text, lang)``; rows without text or language are left out.

    No rows: a model that answers ``und``. One language: a model that always answers it. Rows that repeat a doc_id count
    once, with the smallest vector. Of more than ``sample`` languages those with most documents are learned.
    """
    usable = rows.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    ids = usable.select("doc_id", "lang").distinct()
    counts = ids.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(o.sample)
    kinds = sorted(r["lang"] for r in counts.select("lang").collect())
    if not kinds:
        return LanguageModel(o)
    per = min(o.per_language, o.sample // len(kinds))
    known = ids.join(F.broadcast(counts.select("lang")), "lang", "left_semi")
    draw = top_k(known, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per)
    # Bounded by o.sample rows, so it is broadcast.
    chosen = usable.join(F.broadcast(draw), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, first in _chunks(batch.column("text"), o):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(x)), batch.column("lang").slice(first, len(x)), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["doc_id", "lang", "x"],
                )

    sample = chosen.mapInArrow(run, "doc_id bigint, lang string, x binary").groupBy("doc_id", "lang").agg(F.min("x").alias("x"))
    families: dict[str, list[str]] = {}
    for name in kinds:
        families.setdefault(o.families.get(name, name), []).append(name)
    firsts, seconds = _duels(families), {f: _duels({name: [name] for name in names}) for f, names in families.items()}
    fitted = _fitted(sample, [*firsts, *(d for f in sorted(families) for d in seconds[f])], o)
    machines = iter(fitted)
    take = lambda classes, duels: Duel(sorted(classes), np.array([next(machines) for _ in duels]).T.reshape(1 << o.bits, len(duels)))
    return LanguageModel(o, take(families, firsts), {f: take(families[f], seconds[f]) for f in sorted(families)})


def _duels(classes: dict[str, list[str]]) -> list[tuple[list[str], list[str]]]:
    """The languages on both sides of each pair of classes, in the order of combinations()."""
    return [(classes[a], classes[b]) for a, b in combinations(sorted(classes), 2)]


def _fitted(sample: DataFrame, duels: list[tuple[list[str], list[str]]], o: LanguageOptions) -> list[np.ndarray]:
    """Weights of a machine for each duel. Every duel is fitted in a task of its own; only weights reach the driver."""
    if not duels:
        return []

    def machine(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
        x = np.empty((rows.num_rows, 1 << o.bits))
        for k, v in enumerate(rows.column("x")):
            x[k] = np.frombuffer(v.as_buffer(), np.float32)
        w = support_vectors(x, rows.column("side").to_numpy(), o.cost, o.epochs)
        return pa.table({"duel": rows.column("duel").slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})

    sides = [(k, name, side) for k, duel in enumerate(duels) for names, side in zip(duel, (1.0, -1.0)) for name in names]
    sides = sample.sparkSession.createDataFrame(sides, "duel int, lang string, side double")
    found = sample.join(F.broadcast(sides), "lang").groupBy("duel").applyInArrow(machine, "duel int, w binary")
    weights = {r["duel"]: np.frombuffer(r["w"]) for r in found.collect()}
    return [weights[k] for k in range(len(duels))]


def _chunks(texts: pa.Array, o: LanguageOptions) -> Iterator[tuple[np.ndarray, int]]:
    for s in slices(texts, lower=True):
        for first in range(0, len(s), 128):
            stop = min(first + 128, len(s))
            yield vectors(s, first, stop, o), s.first + first


def identified(docs: DataFrame, model: LanguageModel, letters: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Only the text decides. A text that is null or has no letter is ``und`` with score 0; so is any text if the model has
    no class, and ``und`` may be a class. The boolean column ``letters``, if named, tells texts with a letter. Columns of
    ``docs`` that have one of these names are replaced; all others, whatever their names, pass through unread.
    """
    flag = [letters] if letters else []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        model = shared.value
        for batch in batches:
            names, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            texts, found = batch.column("text"), np.ones(batch.num_rows, bool)
            for x, first in _chunks(texts, model.options):
                names[first : first + len(x)], scores[first : first + len(x)] = model.predict(x)
            for k, text in enumerate(texts):
                # The first letter ends the search.
                if not any(map(str.isalpha, text.as_py() or "")):
                    names[k], scores[k], found[k] = UNKNOWN, 0.0, False
            yield batch, [pa.array(names, pa.string()), pa.array(scores), *(pa.array(found) for _ in flag)]

    rows = without(docs, ["lang_pred", "score", *flag])
    return extended(rows, ["text"], run, "lang_pred string, score double" + "".join(f", `{c}` boolean" for c in flag))
