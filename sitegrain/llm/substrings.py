"""Substring dedup by recompression.

Every document is rewritten in rounds. A round first names maximal runs of one symbol, then pairs
``ab`` where a hash bit puts ``a`` on the left and ``b`` on the right. A name is a hash of what it
stands for, so all tasks give one name to equal strings without meeting. Each symbol carries its
support: the words that decided on it. Equal windows therefore hold the same symbols wherever the
support lies inside, whatever surrounds them.

Each window of ``window`` words is filed under its highest such symbol (named by the words of its
support). Neighbouring windows with the same symbol form one segment, about one for eight words:
only segments are shuffled. More rounds give longer symbols, of which fewer are certain in a window of
20 words, so neighbours agree less: two rounds move the least among those that name pairs of pairs. A name with one occurrence is unique. Where all segments of a name are
equal, all but the first are repeats. Where they differ (the edges of repeated passages), the
windows of each different segment are compared one by one. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import Scratch, beside_groups, quoted, released, widened, without
from sitegrain.llm.words import Slice, mix, signed, slices, span_hashes

WINDOW = 20
ROUNDS = 2

_FAR = np.int64(1) << 60


def symbols(s: Slice, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Name, first and end word of the support of every symbol, one round after the other."""
    name = s.hashes
    doc = np.repeat(np.arange(len(s)), np.diff(s.words))
    lo, hi = np.arange(len(name), dtype=np.int64), np.arange(1, len(name) + 1, dtype=np.int64)
    yield name, lo, hi
    for step in range(rounds):
        if not len(name):
            return
        # Runs. That a symbol stands alone, too, is known from both neighbours.
        joined = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        head = np.concatenate([[True], ~joined])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(name)))
        left, right = _beside(lo, hi, doc)
        last = first + count - 1
        lo, hi, doc = left[first], right[last], doc[first]
        name = np.where(count > 1, mix(name[first] + mix(count.astype(np.uint64))), name[first])
        # Pairs.
        side = (mix(name + np.uint64(step + 1)) & np.uint64(1)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = near & ~side[:-1] & side[1:]
        opens, closes = np.append(pair, False), np.concatenate([[False], pair])
        left, right = _beside(lo, hi, doc)
        new_lo = np.where(side & ~closes, left, lo)
        new_hi = np.where(~side & ~opens, right, hi)
        at = np.flatnonzero(opens)
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        name = name.copy()
        name[at] = mix(name[at] * np.uint64(0x9FB21C651E98DF25) + mix(name[at + 1] + np.uint64(step)))
        stay = ~closes
        name, lo, hi, doc = name[stay], new_lo[stay], new_hi[stay], doc[stay]
        yield name, lo, hi


def _beside(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Support together with that of the left and of the right neighbour; none beside the ends."""
    near = doc[1:] == doc[:-1]
    left = np.concatenate([[-_FAR], np.where(near, np.minimum(lo[1:], lo[:-1]), -_FAR)])
    right = np.append(np.where(near, np.maximum(hi[1:], hi[:-1]), _FAR), _FAR)
    return left, right


def segments(s: Slice, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, name and content hash of every segment.

    A segment in which two windows may be equal (periodic text) comes twice, with two contents, so that
    its windows are compared one by one.
    """
    n = len(s.hashes)
    sizes = np.diff(s.words)
    doc = np.repeat(np.arange(len(s)), sizes)
    begin, end = s.words[:-1][doc], s.words[1:][doc] - window  # of the windows of each word's document
    layers = [np.zeros(n, np.uint64) for _ in range(window.bit_length())]
    for level, (_, lo, hi) in enumerate(symbols(s, rounds)):
        seen = np.flatnonzero(hi - lo <= window)
        lo, hi = lo[seen], hi[seen]
        a, b = np.maximum(hi - window, begin[lo]), np.minimum(lo, end[lo])
        fits = a <= b
        lo, hi, a, b = lo[fits], hi[fits], a[fits], b[fits]
        rank = (span_hashes(s.hashes, lo, hi, 0x2127599BF4325C37) >> np.uint64(4)) | (np.uint64(level) << np.uint64(60))
        log = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in range(len(layers)):
            own = log == k
            if own.any():
                np.maximum.at(layers[k], a[own], rank[own])
                np.maximum.at(layers[k], b[own] - (1 << k) + 1, rank[own])
    for k in range(len(layers) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(layers[k - 1], layers[k], out=layers[k - 1])
        np.maximum(layers[k - 1][half:], layers[k][:-half], out=layers[k - 1][half:])
    starts = np.flatnonzero(np.arange(n) <= end) if n else np.zeros(0, np.int64)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    best = layers[0][starts]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    whole = span_hashes(s.hashes, starts, starts + window, 0xA24BAED4963EE407)
    number = np.cumsum(new) - 1
    periodic = count > window
    for d in range(1, window):
        same = np.flatnonzero((whole[d:] == whole[:-d]) & (number[d:] == number[:-d]))
        periodic[number[same]] = True
    content = span_hashes(s.hashes, at, at + count + window - 1, 0x7FB5D329728EA185)
    out = doc[at], at - s.words[:-1][doc[at]], count, best[first], content
    return tuple(np.concatenate([x, (~x if x is content else x)[periodic]]) for x in out)


def _segment_rows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for s in slices(batch.column("text"), lower=False):
                doc, pos, count, name, content = segments(s, window, rounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(name)), pa.array(signed(content)), pa.array(ids[s.first + doc]), pa.array(pos.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["name", "content", "doc_id", "pos", "n"],
                )

    return docs.mapInArrow(released(run), "name bigint, content bigint, doc_id bigint, pos int, n int")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Both hashes and place of every window that ``spans`` (pos, n) of a document name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("doc_id").to_numpy(), batch.column("spans")
            for s in slices(batch.column("text"), lower=False):
                pos, n, doc = _flat(spans.slice(s.first, len(s)))
                at = np.repeat(s.words[:-1][doc] + pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat(doc, n)
                ends = at + window
                hashes = [pa.array(signed(span_hashes(s.hashes, at, ends, base))) for base in (0x7FB5D329728EA185, 0xDB979083E96DD4DE)]
                place = (at - s.words[:-1][owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(ids[s.first + owner]), pa.array(place)], names=["h1", "h2", "doc_id", "pos"])

    return docs.mapInArrow(released(run), "h1 bigint, h2 bigint, doc_id bigint, pos int")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pos``, ``n`` and row of all elements of a column of lists; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    pos, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return pos, n, np.repeat(np.arange(len(lists)), sizes)


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the other columns, whatever their names, in one."""
    rest = [F.col(c) for c in quoted([c for c in docs.columns if c not in ("doc_id", "text")])]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *([F.struct(*rest).alias("__rest")] if rest else []))


def repeated_spans(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, spans``: word ranges (pos, n) whose windows start earlier, too, in one row per document.

    Earlier means a smaller doc_id, or a smaller start in the same document. Rows with a null
    doc_id take no part. Rows that repeat a doc_id count as one document: none is earlier than the
    other, and their spans are pooled. Null or short texts have no windows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = _texts(docs).filter("doc_id is not null")
    rows = _segment_rows(texts.select("doc_id", "text"), window, rounds)
    # Four numbers per name: what the map side sends stays as small as the segments themselves.
    names = rows.groupBy("name").agg(
        F.min("content").alias("c0"), F.max("content").alias("c1"), F.count("*").alias("k"), F.min("doc_id").alias("home")
    )
    shared = scratch.keep(names.filter("k > 1").select("name", F.expr("c0 = c1").alias("alike"), "home"), "names")
    hits = rows.join(shared, "name")
    hits = scratch.keep(hits.select("name", "content", "doc_id", "pos", "n", "alike", (F.col("doc_id") == F.col("home")).alias("home")), "hits")

    # Names of one content: every occurrence but the first repeats. Several in the first document are told apart by place.
    alike = hits.filter("alike")
    inner = alike.filter("home").groupBy("name").agg(F.min("pos").alias("p0"), F.count("*").alias("k")).filter("k > 1")
    inner = alike.filter("home").join(inner, "name").filter("pos <> p0")
    whole = alike.filter("not home").select("doc_id", "pos", "n").union(inner.select("doc_id", "pos", "n"))

    # Names of several contents: of each content only the first occurrence has windows to compare.
    unlike = scratch.keep(_marked(hits.filter("not alike").select("name", "content", "doc_id", "pos", "n"), "name", "content"), "edges")
    whole = whole.union(unlike.filter("again").select("doc_id", "pos", "n"))
    whole = whole.select("doc_id", "pos", (F.col("n") + (window - 1)).alias("n"))

    # Not cut: the join of the texts shares their exchange with the one that the caller makes.
    edges = unlike.filter("not again").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    windows = _window_rows(texts.join(edges.hint("merge"), "doc_id"), window)
    again = _marked(windows, "h1", "h2").filter("again").select("doc_id", "pos", F.lit(window).alias("n"))
    return whole.union(again).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def _marked(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``again``: whether the key also has an earlier (doc_id, pos).

    Keys of one row are left out of the join's other side.
    """
    place = F.struct("doc_id", "pos")
    met = beside_groups(rows, keys, "doc_id", [F.min(place).alias("first"), F.count("*").alias("k")], "k > 1", "left")
    return met.withColumn("again", F.coalesce(place != F.col("first"), F.lit(False))).drop("first", "k")


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, whole_texts: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by one blank.

    With ``whole_texts`` a text that loses nothing is kept as it is. Null texts have no words. Columns of ``docs``
    with one of the three names are replaced; all others pass through unread.
    """
    docs = without(docs, ["n_words", "n_removed", "kept"])
    spans = repeated_spans(docs, window, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pos, n, row = _flat(part.column(part.schema.names.index("spans")))
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                total, gone, kept = [], [], []
                for k, text in enumerate(part.column("text").cast(pa.large_binary())):
                    raw = text.as_py() or b""
                    words = raw.split()
                    total.append(len(words))
                    if edge[k] == edge[k + 1]:
                        gone.append(0)
                        kept.append(raw if whole_texts else b" ".join(words))
                        continue
                    step = np.zeros(len(words) + 1, np.int64)
                    first, size = pos[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]
                    np.add.at(step, np.minimum(first, len(words)), 1)
                    np.add.at(step, np.minimum(first + size, len(words)), -1)
                    stay = np.cumsum(step[:-1]) == 0
                    gone.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join(compress(words, stay.tolist())))
                new = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
                old = [c for c in part.schema.names if c not in ("spans", "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in old), *new], names=[*old, "n_words", "n_removed", "kept"])

    texts = _texts(docs)
    joined = texts.filter("doc_id is not null").join(spans.hint("merge"), "doc_id", "left")
    unnamed = texts.filter("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    schema = widened(texts.drop("text"), "n_words bigint, n_removed bigint, kept string")
    out = joined.unionByName(unnamed).mapInArrow(released(run), schema)
    rest = [F.col(f"__rest.{c}") for c in quoted([c for c in docs.columns if c not in ("doc_id", "text")])]
    return out.select("doc_id", *rest, "n_words", "n_removed", "kept")
