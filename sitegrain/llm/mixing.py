"""Mixing sources to target weights, in DataFrame functions only.

1. Sources get weights by rank and word targets by filling up: ``target = min(repeat * size, level * weight)``.
2. The words of a source, in a fixed order of its documents, are cut into blocks of ``block`` words.
3. A source is read whole as often as its target holds it and then in part; the last draw ends at the word that meets
   the target (rounded to a word). Its draws, one per block read, are its quota.
4. The mix has ``sum of quotas`` slots, ``shard_slots`` to an output shard. A pseudorandom permutation of all slots
   decides where the draws of a source fall. Each shard's counts are thus one multinomial draw, conditioned on the
   quotas: shards vary as draws do.
5. The k-th draw of a source reads block ``permutation(k mod blocks)``; a block is read again only when all
   others were. Draws and documents meet in a join by (source, block). ``mixture`` tells for every document which
   words which slot reads; ``mixed`` gives documents as the mix reads them, ``mixed_shards`` the shards themselves.

Permutations are swap-or-not networks: exact bijections of any size, made of built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.functions.text import bind
from sitegrain.llm.tables import Scratch, quoted

WORD = r"[^\x20\x09-\x0D]+"
RUN = 4096  # draws that are made from one row


@dataclass(frozen=True)
class MixOptions:
    weights: Sequence[int] = (5, 2, 1)  # by source in code-point order, repeating; null is last
    percent: int = 150  # words of the mix, in percent of all words
    repeat: int = 2  # most times a document is read
    block: int = 128  # words of a block
    shard_slots: int = 4096  # slots of an output shard
    rounds: int = 12  # of a permutation
    lanes: int = 1024  # parts that the order of a source's documents is cut into
    seed: str = "mix"


def number(*parts: Column | str) -> Column:
    """Non-negative 60-bit hash of a text; other engines can compute it, too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("bigint")


PRIME = 2**31 - 1


def scrambled(x: Column, shift: Column) -> Column:
    """Pseudorandom value below PRIME: squares modulo a prime, which 64-bit arithmetic holds."""
    y = (x % PRIME + F.shiftright(x, 31) + shift) % PRIME
    return bind(y, lambda y: bind((y * y + 40503) % PRIME, lambda z: (z * z) % PRIME))


def steps(seed: Column, size: Column, rounds: int) -> Column:
    """What the rounds of a permutation of ``0 .. size - 1`` need: (step, coin), computed once for many images."""
    at = lambda k: scrambled(seed, k.cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(rounds - 1)),
        lambda k: F.named_struct(F.lit("step"), (at(4 * k + 1) * PRIME + at(4 * k + 2)) % size, F.lit("coin"), at(4 * k + 3)),
    )


def permuted(x: Column, size: Column, steps: Column) -> Column:
    """Image of ``x``: each round swaps it with its mirror image about the step, or not, as a coin of the two says."""
    def turn(v: Column, s: Column) -> Column:
        heads = lambda w: F.shiftright(scrambled(F.greatest(v, w), s["coin"]), 7) % 2 == 1
        return bind(F.pmod(s["step"] - v, size), lambda w: F.when(heads(w), w).otherwise(v))

    return F.aggregate(steps, x, turn)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row; null texts have no words."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), size.alias("size"))


def targets(sizes: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """``source, source_size, target, quota, blocks, passes, rest, slot0, slots`` of every source.

    One row per source goes through the windows here; documents were summed before. A source is read ``passes`` times
    whole and ``rest`` words of it once more.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("weight", F.element_at(F.array(*map(F.lit, o.weights)), ((F.row_number().over(named) - 1) % len(o.weights) + 1)).cast("bigint"))
    full = ranked.withColumn("cap", F.col("source_size") * o.repeat).withColumn("total", F.sum("source_size").over(everything) * o.percent / F.lit(100.0))
    # Sources fill up in the order of cap / weight; the level is taken behind the last one that is full.
    filling = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    full = full.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    # It rises up to the first open source and falls after it.
    full = full.withColumn("level", F.when(F.max("open").over(everything), F.max("level").over(everything)))
    target = F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap").cast("double")).otherwise(
        F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    )
    out = full.select("source", "source_size", target.alias("target"))
    blocks = F.ceil(F.col("source_size") / o.block)
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(blocks > 0, F.floor(words / F.col("source_size")).cast("bigint"))
    out = out.withColumn("blocks", blocks).withColumn("passes", whole).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    # The short last block may be among the draws of the rest; one that turns out to be too many has no words.
    short = F.col("blocks") * o.block - F.col("source_size")
    over = F.when(F.col("rest") > 0, F.least(F.ceil((F.col("rest") + short) / o.block), F.col("blocks"))).otherwise(F.lit(0))
    quota = F.col("passes") * F.col("blocks") + over
    out = out.withColumn("quota", F.when(blocks > 0, quota).otherwise(F.lit(0)))
    so_far = everything.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("slot0", F.coalesce(F.sum("quota").over(so_far), F.lit(0))).withColumn("slots", F.sum("quota").over(everything))


def drawn_blocks(plan: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """``shard, slot, source, block, copy, words``: what every slot of the mix reads, from the block's first word on.

    ``copy`` counts from 0. ``words`` may exceed what the last block of a source holds.
    """
    width = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    runs = plan.filter("quota > 0").select(
        "source", "source_size", "blocks", "quota", "passes", "rest", "slot0", "slots",
        steps(number(F.lit(o.seed), F.lit("slots")), F.col("slots"), o.rounds).alias("slot_steps"),
        steps(number(F.lit(o.seed), F.lit("source"), name), F.col("blocks"), o.rounds).alias("block_steps"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / RUN))).alias("run"),
    )
    draws = runs.repartition(width, "source", "run").select(
        "*", F.explode(F.sequence(F.col("run") * RUN, F.least("quota", (F.col("run") + 1) * RUN) - 1)).alias("k")
    )
    slot = permuted(F.col("slot0") + F.col("k"), F.col("slots"), F.col("slot_steps"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("block_steps"))
    # Rounds undo themselves, so in reverse order they tell the turn of the short last block.
    turn = permuted(F.col("blocks") - 1, F.col("blocks"), F.reverse("block_steps"))
    k = F.col("k") % F.col("blocks")
    earlier = k * o.block - F.when(turn < k, F.col("blocks") * o.block - F.col("source_size")).otherwise(F.lit(0))
    full = F.lit(o.block).cast("bigint")
    words = F.when(F.col("k") < F.col("passes") * F.col("blocks"), full).otherwise(F.least(full, F.col("rest") - earlier))
    draws = draws.select(slot.alias("slot"), "source", block.alias("block"), F.floor(F.col("k") / F.col("blocks")).alias("copy"), words.alias("words"))
    return draws.withColumn("shard", F.floor(F.col("slot") / o.shard_slots))


def placed(sizes: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """``begin``, the place of a document's first word among its source's words.

    The order is by lane (a hash of doc_id), doc_id, size. Sums go over lanes first, so a source
    with a third of all documents is sorted in ``lanes`` parts.
    """
    rows = sizes.withColumn("lane", F.pmod(number(F.lit(o.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(o.lanes)))
    lanes = rows.groupBy("source", "lane").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select(F.col("source").alias("of"), F.col("lane").alias("in"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "lane").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(lanes, F.col("source").eqNullSafe(F.col("of")) & (F.col("lane") == F.col("in"))).select(
        "doc_id", "source", "size", (F.col("base") + F.col("offset")).alias("begin")
    )


def mixture(docs: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """``doc_id, source, size, begin, source_size, target, pieces`` for every row of ``docs``.

    ``pieces`` lists what the mix takes: (copy, first word, words, slot that reads them), words counted from 0 in the
    document.
    Texts that are null or blank have size 0 and give nothing. A null source is a source of its own, last in
    order. Repeated rows each count. With no words at all every target is 0. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(sized(docs), "sizes")
    plan = scratch.keep(targets(sizes, o), "targets")
    draws = drawn_blocks(plan, o).groupBy("source", "block").agg(F.collect_set(F.struct("copy", "words", "slot")).alias("copies"))
    rows = scratch.keep(placed(sizes, o).withColumn("row", F.monotonically_increasing_id()), "places")
    parts = rows.filter("size > 0").select(
        "row", "source", "size", "begin",
        F.explode(F.sequence(F.floor(F.col("begin") / o.block), F.floor((F.col("begin") + F.col("size") - 1) / o.block))).alias("block"),
    )
    key = lambda d: d.withColumn("named", F.col("source").isNotNull()).fillna("", ["source"])
    low = F.greatest(F.col("block") * o.block - F.col("begin"), F.lit(0))
    high = F.least(F.col("block") * o.block + F.col("copy.words") - F.col("begin"), F.col("size"))
    # Spark takes the draws for as small as the targets that they are made from; they grow with the corpus.
    taken = key(parts).join(key(draws).hint("merge"), ["named", "source", "block"]).withColumn("copy", F.explode("copies")).select(
        "row", "copy.copy", low.alias("first"), (high - low).alias("words"), "copy.slot"
    ).filter("words > 0")
    taken = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("copy", "first", "words", "slot"))).alias("pieces"))
    known = plan.select(F.col("source").alias("of"), "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("of"))).join(taken, "row", "left").select(
        "doc_id", "source", "size", "begin", "source_size", "target", "pieces"
    )


def taken_words() -> Column:
    """Words that the mix takes of a row of ``mixture``, repeats counted."""
    return F.coalesce(F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"]), F.lit(0).cast("bigint"))


def shards_of(o: MixOptions = MixOptions()) -> Column:
    """Number of output shards that read a row of ``mixture``."""
    shards = F.transform("pieces", lambda p: F.floor(p["slot"] / o.shard_slots))
    return F.coalesce(F.size(F.array_distinct(shards)), F.lit(0)).cast("bigint")


def _dealt(docs: DataFrame, o: MixOptions) -> DataFrame:
    """Rows of ``docs`` that the mix reads, in one column, with their pieces.

    Among rows that share doc_id, source and size, pieces are dealt in the order of their texts.
    """
    plan = mixture(docs, o).filter("pieces is not null")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "size")]
    known = F.concat_ws("/", *key, F.col("doc_id").isNull().cast("string"), F.col("source").isNull().cast("string"))
    turn = lambda *order: F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    plan = plan.select(known.alias("__key"), "size", "begin", "pieces").withColumn("__turn", turn("begin")).withColumnsRenamed({"size": "__size", "pieces": "__pieces", "begin": "__begin"})
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("__row"))
    size = F.coalesce(F.regexp_count(F.col("__row.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = rows.withColumns({"doc_id": F.col("__row.doc_id").cast("bigint"), "source": F.col("__row.source").cast("string"), "size": size})
    rows = rows.select("__row", known.alias("__key"), F.xxhash64("__row.text").alias("__hash")).withColumn("__turn", turn("__hash")).drop("__hash")
    return rows.join(plan, ["__key", "__turn"])


def _words() -> Column:
    return F.regexp_extract_all(F.col("__row.text").cast("string"), F.lit(WORD), F.lit(0))


def mixed(docs: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """The mix by documents: columns of ``docs``, one row per document and copy that the mix reads.

    ``text`` holds the words that the copy takes, joined by one blank, or the whole text as it is where it takes all
    words. Documents that the mix does not take are gone.
    """
    copies = _dealt(docs, o).withColumn("__copy", F.explode(F.array_distinct(F.col("__pieces")["copy"])))
    own = F.filter("__pieces", lambda p: p["copy"] == F.col("__copy"))
    cut = bind(_words(), lambda w: F.array_join(F.flatten(F.transform(own, lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "))
    taken = F.aggregate(own, F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    text = F.when(taken == F.col("__size"), F.col("__row.text").cast("string")).otherwise(cut)
    return copies.select(*(text.alias("text") if c == "text" else F.col(f"__row.{q}") for c, q in zip(docs.columns, quoted(docs.columns))))


def mixed_shards(docs: DataFrame, o: MixOptions = MixOptions()) -> DataFrame:
    """The mix by output shards: ``shard, slot, source, text``, a block of at most ``block`` words per slot.

    Rows sorted by slot within a shard are the order in which the mix is to be read. A slot that nothing is left for
    has no row.
    """
    pieces = bind(_words(), lambda w: F.transform("__pieces", lambda p: F.struct(
        p["slot"].alias("slot"), (F.col("__begin") + p["first"]).alias("at"),
        F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text"),
    )))
    rows = _dealt(docs, o).select(F.col("__row.source").cast("string").alias("source"), F.explode(pieces).alias("p"))
    slots = rows.groupBy(F.col("p.slot").alias("slot"), "source").agg(F.array_sort(F.collect_list(F.struct("p.at", "p.text"))).alias("parts"))
    return slots.select(F.floor(F.col("slot") / o.shard_slots).alias("shard"), "slot", "source", F.array_join(F.col("parts")["text"], " ").alias("text"))
