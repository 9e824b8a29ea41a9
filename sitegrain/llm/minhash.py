"""MinHash near-dedup with min-max hashing.

Under each permutation both the minimum and the maximum of a shingle set are kept, so a signature
of ``2 * permutations`` values costs half the hash evaluations. Both are unbiased estimators of
the Jaccard similarity. Bands of ``rows`` values give bucket keys; two sets with similarity s
meet in no bucket with probability ``(1 - s ** rows) ** bands``: 1e-6 at s = 0.75 by default.

1. One pass over the texts writes fingerprint, set size, band keys and a sketch (four bits of each value) per document.
2. Exact copies fall together by fingerprint; only their smallest id goes on.
3. Every member of a bucket is checked against the bucket's smallest id (a star, not all pairs).
4. Members whose component is not that of a member drawn anew in each bucket are checked against that one.
5. What is still apart then is compared across components in blocks, from which only links leave.
6. All links are confirmed on the full shingle sets. Before that, sizes and sketches rule pairs out; the cut
   of the sketch lies 5.5 standard deviations below the threshold, so nothing that counts is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import Scratch, beside_groups, connected_components, quoted, released
from sitegrain.llm.words import mix, powers, shingle_set, signed, slices, span_hashes


@dataclass(frozen=True)
class MinHashOptions:
    shingle: int = 5
    numerator: int = 75  # link if 100 * intersection >= numerator * union
    bands: int = 51
    rows: int = 5
    seed: int = 20240229
    held: int = 256  # texts that a task holds while others of their bucket pass
    streamed: int = 4096  # texts that pass them
    beside: int = 256  # documents that are checked beside one copy of their bucket's first text

    @property
    def permutations(self) -> int:
        return -(-self.bands * self.rows // 2)

    @property
    def most_unlike(self) -> int:
        """Values of the sketch that differ, which a linked pair exceeds with a chance of 2e-8."""
        values, p = 2 * self.permutations, (1 - self.numerator / 100) * 15 / 16
        return int(values * p + 5.5 * (values * p * (1 - p)) ** 0.5)

    @property
    def sketch_words(self) -> int:
        return -(-2 * self.permutations // 16)


def _multipliers(o: MinHashOptions) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(o.seed)
    draw = lambda: rng.integers(0, 2**64, size=(o.permutations, 1), dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def signature(shingles: np.ndarray, o: MinHashOptions, keys=None) -> np.ndarray:
    """Minima, then maxima, of a non-empty set under each permutation ``x -> a * x + b`` of 64-bit values."""
    a, b = keys or _multipliers(o)
    low = np.full(o.permutations, 2**64 - 1, dtype=np.uint64)
    high = np.zeros(o.permutations, dtype=np.uint64)
    for at in range(0, len(shingles), 8192):
        x = mix(shingles[at : at + 8192])[None, :] * a + b
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return np.concatenate([low, high])


_SIGNED = "doc_id bigint, fp1 bigint, fp2 bigint, n_shingles bigint, keys array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, o: MinHashOptions) -> DataFrame:
    """Fingerprint of the lower-cased words, set size, band keys and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = _multipliers(o)
        bits = 2 * o.permutations
        words = o.sketch_words
        # Minimum and maximum of one permutation stand side by side.
        order = np.arange(bits).reshape(2, -1).T.ravel()[: o.bands * o.rows]
        weights = powers(0xA0761D6478BD642F | 1, o.rows + 1)[1:]
        salt = mix(np.arange(1, o.bands + 1, dtype=np.uint64))
        for batch in batches:
            n = batch.num_rows
            fp1, fp2, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys, sketch = np.zeros((n, o.bands), np.uint64), np.zeros((n, words), np.uint64)
            for s in slices(batch.column("text"), lower=True):
                rows = slice(s.first, s.first + len(s))
                fp1[rows] = signed(span_hashes(s.hashes, s.words[:-1], s.words[1:], 0xE7037ED1A0B428DB))
                fp2[rows] = signed(span_hashes(s.hashes, s.words[:-1], s.words[1:], 0x8EBC6AF09C88C6E3))
                for k in range(len(s)):
                    shingles = shingle_set(s.hashes[s.words[k] : s.words[k + 1]], o.shingle)
                    size[s.first + k] = len(shingles)
                    if len(shingles):
                        sig = mix(signature(shingles, o, perms))
                        grid = sig[order].reshape(o.bands, o.rows)
                        keys[s.first + k] = mix((grid * weights).sum(axis=1, dtype=np.uint64) ^ salt)
                        nibbles = np.zeros(words * 16, np.uint8)
                        nibbles[:bits] = sig & np.uint64(15)
                        sketch[s.first + k] = (nibbles[0::2] | (nibbles[1::2] << 4)).view(np.uint64)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(signed(x.ravel())), x.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp1), pa.array(fp2), pa.array(size), lists(keys), lists(sketch)],
                names=["doc_id", "fp1", "fp2", "n_shingles", "keys", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(released(run), _SIGNED)


def verified(docs: DataFrame, pairs: DataFrame, o: MinHashOptions) -> DataFrame:
    """``pairs(a, b)`` whose full shingle sets reach the threshold.

    The texts that ``a`` is compared with stream past ``a`` in groups of ``beside``, so a text that
    a third of all pairs share is copied to many tasks and no group is held in memory.
    """
    salted = beside_groups(pairs, ["a"], "b", [F.count("*").alias("n")]).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / o.beside)).alias("salt"))
    heads = salted.select("a", "salt").distinct()
    places = heads.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")).union(
        salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role"))
    )
    # Texts are shuffled at every size: the plan is then the same for small and large inputs.
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(places.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            ids, a, salt, role = (batch.column(c).to_numpy() for c in ("doc_id", "a", "salt", "role"))
            for s in slices(batch.column("text"), lower=True):
                for k in range(len(s)):
                    row = s.first + k
                    shingles = shingle_set(s.hashes[s.words[k] : s.words[k + 1]], o.shingle)
                    if (a[row], salt[row]) != at:
                        at, heads = (a[row], salt[row]), []
                    if role[row] == 0:
                        heads.append(shingles)
                    elif any(_linked(h, shingles, o.numerator) for h in heads):
                        found.append((int(a[row]), int(ids[row])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(released(run), "a bigint, b bigint")


def _linked(a: np.ndarray, b: np.ndarray, numerator: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < numerator * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= numerator * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, o: MinHashOptions = MinHashOptions()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Defined cases: a null or wordless text has an empty set and links with nothing; rows that
    repeat a doc_id are all returned and share its component; a null doc_id links with nothing
    (component_id null, kept). Further columns are ignored. Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed_rows = scratch.keep(signatures(docs, o), "signatures")
    small = scratch.keep(signed_rows.select("doc_id", "fp1", "fp2", "n_shingles"), "sizes")
    usable = small.filter("doc_id is not null and n_shingles > 0")
    same = ["fp1", "fp2", "n_shingles"]
    members = beside_groups(usable.select("doc_id", *same), same, "doc_id", [F.min("doc_id").alias("first")])
    copies = members.filter("doc_id <> first").select(F.col("doc_id").alias("b"), F.col("first").alias("a"))

    full = signed_rows.filter("doc_id is not null and n_shingles > 0")
    chosen = full.groupBy(*same).agg(F.min_by(F.struct("keys", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id"))
    chosen = scratch.keep(chosen.select("doc_id", "n_shingles", "s.keys", "s.sketch"), "texts")
    scratch.drop(signed_rows)
    entries = chosen.select("doc_id", F.explode("keys").alias("key"))
    ends = [F.min("doc_id").alias("head"), F.max("doc_id").alias("last")]
    hits = beside_groups(entries, ["key"], "doc_id", ends, "head <> last")
    hits = scratch.keep(hits.select("key", "doc_id", "head").distinct(), "buckets")

    # The texts that share a bucket move once; the three rounds of checks below read only these.
    ids = hits.select("doc_id").distinct()
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(ids.hint("merge"), "doc_id", "left_semi")
    docs = scratch.keep(docs, "candidates")

    facts = chosen.select("doc_id", "n_shingles", "sketch")
    named = lambda side: facts.select(*(F.col(c).alias(f"{side}_{c}") for c in facts.columns))
    star = hits.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(named("a"), F.col("a") == F.col("a_doc_id")).join(named("b"), F.col("b") == F.col("b_doc_id"))
    star = scratch.keep(star.filter(_possible(o)).select("a", "b"), "star")
    links = scratch.keep(verified(docs, star, o), "links")

    # Later rounds go on from the components found so far, not from their links.
    stars = lambda parts: parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    parts = connected_components(links, scratch)
    outside, _ = _outside(hits, facts, parts, 1, scratch)
    probes = outside.filter(_possible(o)).select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b"))
    probes = scratch.keep(probes.distinct().join(star, ["a", "b"], "left_anti"), "probes")
    parts = connected_components(stars(parts).union(verified(docs, probes, o)), scratch)

    _, mixed = _outside(hits, facts, parts, 2, scratch)
    more = scratch.keep(_apart(docs, scratch.keep(mixed, "mixed"), chosen, o), "links")

    parts = connected_components(stars(parts).union(more).union(copies.select("a", "b")), scratch)
    out = small.select("doc_id", "n_shingles").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _outside(hits: DataFrame, facts: DataFrame, parts: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members whose part is not that of a head drawn in their bucket (a_: the head, b_: the member).

    The second table holds all members ``key, doc_id, part, outside`` of the buckets that have such members.
    """
    parts = parts.withColumnRenamed("id", "doc_id")
    placed = hits.join(parts, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    placed = scratch.keep(placed, "placed")
    drawn = F.struct(F.xxhash64("key", "doc_id", F.lit(turn)), "doc_id", "part")
    ends = [F.min(drawn).alias("h"), F.min("part").alias("p"), F.max("part").alias("q")]
    mixed = beside_groups(placed, ["key"], "doc_id", ends, "p <> q").withColumns({"head": F.col("h.doc_id"), "head_part": F.col("h.part")})
    mixed = mixed.withColumn("outside", F.col("part") != F.col("head_part"))
    named = lambda side: facts.select(*(F.col(c).alias(f"{side}_{c}") for c in facts.columns))
    outside = mixed.filter("outside").select(F.col("head").alias("a_doc_id"), F.col("doc_id").alias("b_doc_id"))
    outside = outside.distinct().join(named("b"), "b_doc_id").join(named("a"), "a_doc_id")
    return outside, mixed.select("key", "doc_id", "part", "outside")


def _apart(docs: DataFrame, mixed: DataFrame, chosen: DataFrame, o: MinHashOptions) -> DataFrame:
    """Links ``a, b`` across parts in each bucket: members outside the head's part against all members.

    Blocks of ``held`` outside members meet lanes of ``streamed`` members in one task each, so no group is
    bounded by its bucket. Only links leave the task, never pairs; a pair is compared in its first bucket only.
    """
    sizes = [F.ceil(F.count_if("outside") / o.held).alias("blocks"), F.ceil(F.count("*") / o.streamed).alias("lanes")]
    rows = beside_groups(mixed, ["key"], "doc_id", sizes)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.col(n))
    held = rows.filter("outside").select("key", "doc_id", "part", "outside", F.lit(0).alias("role"), own("blocks").alias("block"), all_of("lanes").alias("lane"))
    passing = rows.select("key", "doc_id", "part", "outside", F.lit(1).alias("role"), all_of("blocks").alias("block"), own("lanes").alias("lane"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    places = held.union(passing).join(chosen, "doc_id")
    group = ("key", "block", "lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, box = None, _Box(o)
        for batch in batches:
            found: list[tuple[int, int]] = []
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*group, "doc_id", "part", "outside", "role")}
            keys = batch.column("keys").flatten().to_numpy().reshape(-1, o.bands)
            sketch = batch.column("sketch").flatten().to_numpy().view(np.uint8).reshape(-1, 8 * o.sketch_words)
            for s in slices(batch.column("text"), lower=True):
                for k in range(len(s)):
                    i = s.first + k
                    if at != (now := tuple(col[c][i] for c in group)):
                        at = now
                        box.clear()
                    shingles = shingle_set(s.hashes[s.words[k] : s.words[k + 1]], o.shingle)
                    row = (col["doc_id"][i], col["part"][i], len(shingles), keys[i], sketch[i], shingles)
                    if col["role"][i] == 0:
                        box.add(*row)
                    else:
                        found += box.links(*row, key=at[0], outside=col["outside"][i])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = texts.join(places.hint("merge"), "doc_id")
    return rows.repartition(*group).sortWithinPartitions(*group, "role").mapInArrow(released(run), "a bigint, b bigint")


class _Box:
    """Held members of one group; ``links`` compares one more with all of them."""

    def __init__(self, o: MinHashOptions) -> None:
        self.o = o
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.columns: list[np.ndarray] | None = None

    def add(self, *row) -> None:
        self.rows.append(row)
        self.columns = None

    def links(self, doc, part, size, keys, sketch, shingles, key, outside) -> list[tuple[int, int]]:
        if not self.rows:
            return []
        if self.columns is None:
            self.columns = [np.array([r[i] for r in self.rows]) for i in range(5)]
        docs, parts, sizes, their_keys, sketches = self.columns
        # Two outside members meet twice: the larger id passes the smaller.
        fits = (parts != part) & (docs < doc if outside else docs != doc)
        fits &= 100 * np.minimum(sizes, size) >= self.o.numerator * np.maximum(sizes, size)
        at = np.flatnonzero(fits)
        if not len(at):
            return []
        x = sketches[at] ^ sketch
        at = at[((x & 15) != 0).sum(axis=1) + ((x >> 4) != 0).sum(axis=1) <= self.o.most_unlike]
        here = int(np.flatnonzero(keys == key)[0])
        at = at[~(their_keys[at, :here] == keys[:here]).any(axis=1)]
        return [(int(docs[i]), int(doc)) for i in at if _linked(self.rows[i][5], shingles, self.o.numerator)]


def _possible(o: MinHashOptions):
    """Sizes allow the threshold, and the sketches do not rule it out."""
    a, b = F.col("a_n_shingles"), F.col("b_n_shingles")
    sizes = 100 * F.least(a, b) >= o.numerator * F.greatest(a, b)
    unlike = F.lit(0)
    for i in range(o.sketch_words):
        x = F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return sizes & (unlike <= o.most_unlike)


def deduplicated(docs: DataFrame, o: MinHashOptions = MinHashOptions()) -> DataFrame:
    """Rows of ``docs`` but one of every group of near duplicates: the one with the smallest doc_id stays.

    Rows that repeat the id of a kept document stay as they are.
    """
    gone = near_duplicates(docs, o).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
