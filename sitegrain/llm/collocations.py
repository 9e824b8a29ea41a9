"""Phrase collocations by vertical partitioning of a truncated suffix tree.

Texts are cut into pieces and words per language. The suffixes of all pieces, truncated to four words, are the leaves
of a tree whose node counts are phrase counts. It is never built as a whole:

1. Prefixes of one word are counted, then prefixes of two words that are both frequent. Tasks combine before they
   shuffle. What must be frequent to go on is looked up in bitmaps of bounded size; they never miss, and what they
   let through by mistake is dropped by its exact count.
2. Prefixes are grouped by a memory budget: groups are as many as the budget needs, two-word prefixes are dealt to
   them by a hash, and a prefix over the budget is extended by its third word, so that several groups share it. Such
   prefixes are few whatever the corpus (``most_heavy`` at most).
3. Each group sorts its suffixes and builds its subtree alone: the counts of nodes are sums over runs of equal
   prefixes of the sorted leaves. Sorting spills, and only the open path is held.

Words are 64-bit hashes of language and word; a dictionary of the words that remain tells which is which, and if two
of them share a hash, all is done again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.llm.tables import Scratch
from sitegrain.llm.words import byte_hashes, folded_texts, mix, runs, signed

_BREAK, _SOLID = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SOLID[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x09]] = False
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CollocationOptions:
    least: int = 30  # occurrences of a candidate
    absorb: int = 80  # a phrase goes if a longer candidate has this percentage of its occurrences
    top: int = 2000  # phrases per language
    budget: int = 1 << 20  # suffixes of a group
    most_heavy: int = 1 << 14  # prefixes that may be extended
    bits: int = 1 << 27  # of a bitmap, at most
    held: int = 1 << 19  # words that a task counts before it lets the counts go


@dataclass
class Tokens:
    """Some words of a batch in order; ``links`` says that the next word continues the piece."""

    hashes: np.ndarray
    links: np.ndarray
    langs: np.ndarray  # number of each word's language
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _tokens(batch: pa.RecordBatch, names: list[str], seed: int) -> Iterator[Tokens]:
    """Words of a batch; ``names`` collects the languages."""
    lang = batch.column("lang").to_pylist()
    code = {name: k for k, name in enumerate(names)}
    for name in lang:
        if name not in code:
            code[name] = len(names)
            names.append(name)
    salts = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{n}".encode(), digest_size=8).digest(), "little") for n in names], dtype=np.uint64)
    langs = np.array([code[n] for n in lang], dtype=np.int32)
    for row, data, bounds in folded_texts(batch.column("text")):
        starts, ends, words = runs(_SOLID[data], bounds)
        if not len(starts):
            continue
        own = np.repeat(langs[row : row + len(bounds) - 1], np.diff(words))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts]
        links = np.zeros(len(starts), dtype=bool)
        links[:-1] = breaks[1:] == breaks[:-1]
        links[words[1:-1][(words[1:-1] > 0) & (words[1:-1] < len(starts))] - 1] = False
        hashes = mix(byte_hashes(data, starts, ends) ^ salts[own])
        yield Tokens(np.maximum(hashes, np.uint64(1)), links, own, data, starts, ends)


def _blocks(batches: Iterator[pa.RecordBatch], held: int, seed: int) -> Iterator[tuple[list[Tokens], list[str]]]:
    """Tokens of about ``held`` words."""
    names: list[str] = []
    out, n = [], 0
    for batch in batches:
        for t in _tokens(batch, names, seed):
            out.append(t)
            n += len(t.hashes)
            if n >= held:
                yield out, names
                out, n = [], 0
    if out:
        yield out, names


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_index=True, return_counts=True)


class Bitmap:
    """Set of 64-bit hashes that may hold more than was put in, never less."""

    def __init__(self, size: int, words: np.ndarray) -> None:
        self.size, self.words = size, words

    def __contains__(self, hashes: np.ndarray) -> np.ndarray:
        raise TypeError("use has()")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.size - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _PAIR + b)


def _bitmap(rows: DataFrame, columns: list[str], bits: int) -> Bitmap:
    """Bitmap of one or two columns of hashes; it has 16 bits a row, ``bits`` at most."""
    size = 64
    while size < min(16 * rows.count(), bits):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(c).to_numpy().view(np.uint64) for c in columns]
            at = (h[0] if len(h) == 1 else _pair(*h)) & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(signed(np.left_shift(np.uint64(1), at & np.uint64(63))))], names=["at", "bit"]
            )

    found = rows.select(*columns).mapInArrow(run, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return Bitmap(size, words)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


_WORDS = "lang string, h bigint, c bigint"
_PAIRS = "h1 bigint, h2 bigint, c bigint"
_SUFFIXES = "grp int, h1 bigint, h2 bigint, h3 bigint, h4 bigint, c bigint, lang string, word string"


def _word_counts(docs: DataFrame, o: CollocationOptions, seed: int) -> DataFrame:
    """Occurrences of every word, and with a null ``h`` of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names in _blocks(batches, o.held, seed):
            langs = np.concatenate([t.langs for t in block])
            h, at, c = _counts(np.concatenate([t.hashes for t in block]))
            name = np.array(names, dtype=object)
            yield _batch(_WORDS, pa.array(name[langs[at]], pa.string()), signed(h), c.astype(np.int64))
            own, total = np.unique(langs, return_counts=True)
            yield _batch(_WORDS, pa.array(name[own], pa.string()), pa.array([None] * len(own), pa.int64()), total.astype(np.int64))

    return docs.mapInArrow(run, _WORDS).groupBy("lang", "h").agg(F.sum("c").alias("f"))


def _pair_counts(docs: DataFrame, frequent: Bitmap, o: CollocationOptions, seed: int) -> DataFrame:
    """Occurrences of neighbours that are both frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches, o.held, seed):
            # Numbers of the words that are frequent (from 1; 0 for all others): pairs of numbers are exact keys.
            hashes = np.concatenate([t.hashes for t in block])
            links = np.concatenate([t.links for t in block])
            good = frequent.has(hashes)
            both = np.flatnonzero(links[:-1] & good[:-1] & good[1:])
            words, number = np.unique(np.concatenate([hashes[both], hashes[both + 1]]), return_inverse=True)
            keys, _, c = _counts(number[: len(both)].astype(np.int64) * len(words) + number[len(both) :])
            if len(keys):
                yield _batch(_PAIRS, signed(words[keys // len(words)]), signed(words[keys % len(words)]), c.astype(np.int64))

    return docs.mapInArrow(run, _PAIRS).groupBy("h1", "h2").agg(F.sum("c").alias("f"))


def _suffixes(docs: DataFrame, frequent: Bitmap, pairs: Bitmap, heavy: np.ndarray, groups: int, o: CollocationOptions, seed: int) -> DataFrame:
    """Truncated suffixes of three and four words with their group; in rows without a group, the words themselves.

    ``heavy`` holds the hashes of prefixes that are extended. A suffix of three words has a null ``h4``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for block, names in _blocks(batches, o.held, seed):
            hashes = np.concatenate([t.hashes for t in block])
            links = np.concatenate([t.links for t in block])
            good = frequent.has(hashes)
            two = np.zeros(len(hashes) + 2, dtype=bool)  # a frequent pair starts here
            two[: len(hashes) - 1] = links[:-1] & good[:-1] & good[1:]
            at = np.flatnonzero(two)
            two[at] = pairs.has(_pair(hashes[at], hashes[at + 1]))
            at = np.flatnonzero(two)
            fresh = np.unique(np.concatenate([at, at + 1])).astype(np.int64)
            new, first = np.unique(hashes[fresh], return_index=True)
            new, first = new[~np.isin(new, known)], first[~np.isin(new, known)]
            known = np.concatenate([known, new])[-o.held :]
            if len(new):
                yield _dictionary(block, names, fresh[first], new)

            at = np.flatnonzero(two[:-2] & two[1:-1])  # three words and more
            if not len(at):
                continue
            fourth = two[at + 2]
            last = np.where(fourth, hashes[np.minimum(at + 3, len(hashes) - 1)], np.uint64(0))
            words, number = np.unique(np.concatenate([hashes[at], hashes[at + 1], hashes[at + 2], last]), return_inverse=True)
            n1, n2, n3, n4 = number.reshape(4, -1).astype(np.int64)
            front, a, _ = _counts(n1 * len(words) + n2)
            back, b, _ = _counts(n3 * len(words) + n4)
            keys, first, c = _counts(np.searchsorted(front, n1 * len(words) + n2) * len(back) + np.searchsorted(back, n3 * len(words) + n4))
            h1, h2, h3, h4 = (words[n[first]] for n in (n1, n2, n3, n4))
            prefix = _pair(h1, h2)
            long = np.isin(prefix, heavy)
            grp = (np.where(long, _pair(prefix, h3), prefix) % np.uint64(groups)).astype(np.int32)
            none = pa.nulls(len(keys), pa.string())
            yield _batch(_SUFFIXES, grp, signed(h1), signed(h2), signed(h3), pa.array(signed(h4), mask=h4 == 0), c.astype(np.int64), none, none)

    return docs.mapInArrow(run, _SUFFIXES)


def _dictionary(block: list[Tokens], names: list[str], places: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Spelling and language of the words at some places of a block."""
    ends = np.cumsum([len(t.hashes) for t in block])
    owner = np.searchsorted(ends, places, side="right")
    words, langs = [], []
    for place, k in zip(places.tolist(), owner.tolist()):
        t, i = block[k], place - (ends[k - 1] if k else 0)
        words.append(t.data[t.starts[i] : t.ends[i]].tobytes().decode())
        langs.append(names[t.langs[i]])
    none = pa.nulls(len(words), pa.int64())
    return _batch(_SUFFIXES, pa.nulls(len(words), pa.int32()), signed(hashes), none, none, none, none, pa.array(langs, pa.string()), pa.array(words, pa.string()))


_NODES = "h1 bigint, h2 bigint, h3 bigint, h4 bigint, f bigint"


def _subtrees(suffixes: DataFrame, groups: int, o: CollocationOptions) -> DataFrame:
    """Nodes of three and four words (``h4`` null: three) with at least ``least`` leaves below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5  # leaves of the node of three words that is open
        for batch in batches:
            new = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "h3", "h4", "c")]
            held = [np.concatenate(x) for x in zip(held, new)]
            three = _edges(held[:3])
            if len(three) > 1:
                yield from closed([x[: three[-1]] for x in held])
                held = [x[three[-1] :] for x in held]
            if len(held[0]) > 1 << 16:
                held = merged(held)
        if len(held[0]):
            yield from closed(held)

    def merged(rows: list[np.ndarray]) -> list[np.ndarray]:
        four = _edges(rows[:4])
        return [*(x[four] for x in rows[:4]), np.add.reduceat(rows[4], four)]

    def closed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for depth in (3, 4):
            first = _edges(rows[:depth])
            total = np.add.reduceat(rows[4], first)
            keep = total >= o.least
            if depth == 4:
                keep &= rows[3][first] != 0
            at = first[keep]
            last = pa.array(rows[3][at]) if depth == 4 else pa.nulls(len(at), pa.int64())
            yield _batch(_NODES, rows[0][at], rows[1][at], rows[2][at], last, total[keep])

    order = ["h1", "h2", "h3", "h4"]
    rows = suffixes.filter("grp is not null").select("grp", *order, "c")
    return rows.repartition("grp").sortWithinPartitions("grp", *order).mapInArrow(run, _NODES)


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    """Places where a run of equal rows starts."""
    changed = np.zeros(len(columns[0]), dtype=bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def collocations(docs: DataFrame, o: CollocationOptions = CollocationOptions()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of two to four words that hold together best.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` all words of the language; the score is
    ``floor(2000000 * a / (l + r))``. Per language the first ``top`` by score, count and phrase.

    Defined cases: a null text is empty; a null language is ``und``; rows that repeat a doc_id all count; a language
    without candidates has no rows. Other columns are ignored. Empty tables give empty results.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    for seed in range(8):
        scratch = Scratch(docs.sparkSession, "collocations")
        found = _ranked(docs, o, seed, scratch)
        if found is not None:
            return found
    raise RuntimeError("words share hashes under eight seeds")


def _ranked(docs: DataFrame, o: CollocationOptions, seed: int, scratch: Scratch) -> DataFrame | None:
    words = scratch.keep(_word_counts(docs, o, seed).filter(F.col("h").isNull() | (F.col("f") >= o.least)), "words")
    single = words.filter("h is not null")
    frequent = _bitmap(single, ["h"], o.bits)
    pairs = scratch.keep(_pair_counts(docs, frequent, o, seed).filter(F.col("f") >= o.least), "pairs")
    held = _bitmap(pairs, ["h1", "h2"], o.bits)
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    groups = max(1, -(-total // o.budget))
    heavy = pairs.filter(F.col("f") > max(o.budget // 4, total // o.most_heavy)).select("h1", "h2").toArrow()
    heavy = np.sort(_pair(*(heavy.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))))
    suffixes = scratch.keep(_suffixes(docs, frequent, held, heavy, groups, o, seed), "suffixes")
    spelled = suffixes.filter("grp is null").groupBy(F.col("h1").alias("h")).agg(
        F.min(F.struct("lang", "word")).alias("w"), F.max(F.struct("lang", "word")).alias("other")
    )
    spelled = scratch.keep(spelled, "spelled")
    if not spelled.filter("w <> other").isEmpty():
        return None
    nodes = scratch.keep(_subtrees(suffixes, groups, o), "nodes")
    scratch.drop(suffixes)

    key = lambda *c: F.array(*c).alias("key")
    candidates = pairs.select(key("h1", "h2"), "f").union(
        nodes.select(F.when(F.col("h4").isNull(), F.array("h1", "h2", "h3")).otherwise(F.array("h1", "h2", "h3", "h4")).alias("key"), "f")
    )
    candidates = scratch.keep(candidates, "candidates")
    counted = candidates.union(single.select(key("h"), "f"))
    part = lambda name: counted.select(F.col("key").alias(name), F.col("f").alias(name[0]))
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(key) - 1)")))
    cuts = cuts.withColumn("left", F.expr("slice(key, 1, k)")).withColumn("right", F.expr("slice(key, k + 1, size(key))"))
    cuts = cuts.join(part("left"), "left").join(part("right"), "right")
    cuts = cuts.withColumn("score", F.expr("(cast(f as decimal(20, 0)) * 2000000) div (l + r)"))
    worst = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"))

    # The largest count of a longer candidate around each phrase.
    inner = F.expr("flatten(transform(sequence(2, size(key) - 1), n -> transform(sequence(1, size(key) - n + 1), i -> slice(key, i, n))))")
    around = candidates.filter("size(key) > 2").select(F.explode(inner).alias("key"), F.col("f").alias("longer"))
    around = around.groupBy("key").agg(F.max("longer").alias("longer"))
    left = worst.join(around, "key", "left").filter(
        F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {o.absorb}")
    )

    # Ties at the last rank are settled by spelling, so words are looked up only for what may be ranked.
    langs = spelled.select("h", F.col("w.lang").alias("lang"))
    named = left.withColumn("h", F.col("key")[0]).join(langs, "h")
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc())
    named = scratch.keep(named.withColumn("place", F.rank().over(best)).filter(F.col("place") <= o.top).drop("place", "h"), "best")
    at = named.select("lang", "key", F.posexplode("key").alias("i", "h")).join(spelled.select("h", F.col("w.word").alias("word")), "h")
    phrases = at.groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = named.join(phrases, ["lang", "key"]).join(words.filter("h is null").select("lang", F.col("f").alias("n")), "lang")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= o.top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
