"""Contextual link suggestions: best-matching site pages per page, exactly.

A target scores 2 per anchor token found in the page, 1 per product token in its
anchor and 1 more for category targets of product pages. Comparing every page
with every target is quadratic, and so is an inverted index once one token
occurs in a third of all anchors. This is a top-k search over an inverted index
with score upper bounds instead:

* A posting list belongs to a set of tokens. It holds the best ``list_size``
  distinct anchors that contain the set, ordered by the part of the score that
  is known without the page. The empty set lists the best targets of the site.
* A page reads the list of the empty set and those of its tokens, which gives
  its first picks, then lists of larger sets. What it reads is scored in full;
  no more than ``picks`` rows of a page leave a task.
* Every truncated list bounds what lies behind it: the score of its last entry,
  and 2 for every further token that both its anchors and the page have. Only
  tokens with truncated lists of their own count, since anchors with any other
  token of the page were read. A page goes on to larger sets only where that
  bound still beats its worst pick.
* Lists of larger sets are built only for sets that some page still asks for, by
  extending anchors, so sets that no anchor contains never appear.

What a page reads depends on its own words and picks, not on the size of the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import any_of, bind, hyphen_tokens
from sitegrain.operators.ordered import first_distinct, lookup, top_k, unnest
from sitegrain.session import cut_lineage
from sitegrain.vocab import Vocabulary

PICKS = 6
MINIMUM = 3
ASKED = 1 << 14  # lists that one task reads
_PAGE = ["site", "idx"]
_LIST = ["site", "for_pdp", "key"]


def _targets(site_pages: DataFrame, vocab: Vocabulary) -> DataFrame:
    anchored = site_pages.select(
        "site", "idx", "url", urls.suggestion_anchor(F.col("url")).alias("anchor")
    ).withColumn("tokens", hyphen_tokens(F.col("anchor")))
    typed = anchored.withColumns(
        {
            "terms": F.size(F.filter("tokens", lambda t: t.rlike(any_of(vocab.product_terms)))),
            "category": F.col("url").rlike(f"/{any_of(vocab.category_segments)}/"),
        }
    )
    # Equal anchors score alike within one category flag; the first may be the
    # page itself, so two are kept.
    return top_k(typed, ["site", "anchor", "category"], [F.col("idx")], 2)


def _matched(tokens: Column, wanted: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t)))


def _known() -> Column:
    return 2 * _matched(F.col("tokens"), F.split("key", " "))


def _posting_lists(members: DataFrame, size: int) -> DataFrame:
    """``site, for_pdp, key, entries, tail, last`` from ``(site, key, target…)`` rows.

    ``tail`` is null on a complete list. Else it is the known score of the last entry
    and ``last`` its idx: what lies behind comes after it in that order.
    """
    rows = members.withColumn("for_pdp", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.withColumn("value", _known() + F.col("terms") + F.when(F.col("for_pdp") & F.col("category"), 1).otherwise(0))
    once = F.array_distinct("tokens")
    # Repeated tokens are rare; they stand apart, so that the rest can be compared as a set.
    again = F.when(F.size(once) < F.size("tokens"), F.flatten(F.transform(once, lambda t: F.slice(
        F.filter("tokens", lambda x: x == t), F.lit(2), F.size("tokens")
    ))))
    entry = F.struct("idx", "url", "anchor", once.alias("tokens"), again.alias("again"), "terms", "category")
    holder = F.struct((-F.col("value")).alias("negative"), F.col("idx"), entry.alias("entry"))
    anchors = (
        top_k(rows, [*_LIST, "anchor"], [F.desc("value"), F.col("idx")], 2)
        .groupBy(*_LIST, "anchor")
        .agg(F.array_sort(F.collect_list(holder)).alias("holders"))
        .withColumn("best", F.struct(F.col("holders")[0]["negative"].alias("negative"), F.col("holders")[0]["idx"].alias("idx")))
    )
    leaders = top_k(anchors, _LIST, [F.col("best")], size + 1, "place")
    listed = F.transform("holders", lambda h: h["entry"])
    end = F.max(F.when(F.col("place") == size, F.col("best")))
    lists = leaders.groupBy(*_LIST).agg(
        F.collect_list(F.when(F.col("place") <= size, listed)).alias("entries"),
        F.when(F.max("place") > size, end).alias("end"),
    )
    return lists.select(*_LIST, "entries", (-F.col("end.negative")).alias("tail"), F.col("end.idx").alias("last"))


def _dealt(asked: DataFrame) -> DataFrame:
    """``asked`` dealt by page to as many tasks as its rows need: each becomes the entries of a list, which a task sorts.

    Its files say nothing of that, since they are many times smaller than what is read for them.
    """
    return asked.repartition(max(1, -(-asked.count() // ASKED)), *_PAGE)


def _read(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """What pages find on the lists that they ask for, scored in full."""
    rows = lookup(_dealt(asked.select(*_PAGE, "for_pdp", "pool", "key")), postings.select(*_LIST, "entries"), _LIST, "idx", "inner")
    # Of an anchor's two holders the page takes the first that is not itself.
    own = F.transform("entries", lambda h: F.when(h[0]["idx"] != F.col("idx"), h[0]).otherwise(F.get(h, F.lit(1))))
    rows = unnest(rows, [*_PAGE, "for_pdp", "pool"], own, "e").filter("e is not null")
    matched = F.size(F.array_intersect("e.tokens", "pool")) + F.when(F.col("e.again").isNull(), 0).otherwise(_matched(F.col("e.again"), F.col("pool")))
    score = 2 * matched + F.col("e.terms") + F.when(F.col("for_pdp") & F.col("e.category"), 1).otherwise(0)
    return rows.select(
        *_PAGE, (-score).alias("negative_score"), F.col("e.idx").alias("target_idx"), F.col("e.anchor").alias("anchor"), F.col("e.url").alias("target_page")
    ).filter("negative_score < 0")


def _best(found: DataFrame, picks: int) -> DataFrame:
    """Picks of all pages: no more than ``picks`` rows of a page leave a task."""
    order = [F.col("negative_score"), F.col("target_idx")]
    return top_k(top_k(found, [*_PAGE, "anchor"], order, 1), _PAGE, order, picks)


def _open(asked: DataFrame, postings: DataFrame, members: DataFrame) -> DataFrame:
    """Truncated lists that can go on and may hide what beats a page's ``worst`` pick.

    ``asked`` have ``deep``, the tokens of the page that count behind a list, and ``members`` their number
    ``weight`` in an anchor, repeats counted, which are ``most`` for one token.
    """
    behind = members.groupBy("site", "key").agg(F.max(2 * F.col("weight") - _known()).alias("further"), F.max("most").alias("most"))
    cut = postings.filter("tail is not null").select(*_LIST, "tail", "last").join(behind, ["site", "key"])
    later = F.exists("deep", lambda t: t > F.substring_index("key", " ", -1))
    rows = lookup(asked.filter(later), cut, _LIST, "idx", "inner")
    words = F.size(F.array_except("deep", F.split("key", " ")))
    bound = F.col("tail") + F.least("further", 2 * F.col("most") * words)
    hidden = F.struct((-bound).alias("negative_score"), F.col("last").alias("target_idx"))
    return cut_lineage(rows.filter(F.col("worst").isNull() | (hidden < F.col("worst"))).select(*asked.columns), "asked")


def _weighed(targets: DataFrame, heavy: DataFrame) -> DataFrame:
    """``targets`` with ``deep``, their tokens that are ``heavy(site, token)``, their ``weight`` and ``most``."""
    every = unnest(targets, ["site", "idx"], F.col("tokens"), "token").groupBy("site", "idx", "token").agg(F.count("*").alias("n"))
    every = lookup(every, heavy.withColumn("heavy", F.lit(True)), ["site", "token"], "idx", "inner")
    per = every.groupBy("site", "idx").agg(F.collect_set("token").alias("deep"), F.sum("n").alias("weight"), F.max("n").alias("most"))
    return targets.join(per, _PAGE)


def suggest_links(
    pages: DataFrame,
    site_pages: DataFrame,
    vocab: Vocabulary = Vocabulary(),
    picks: int = PICKS,
    minimum: int = MINIMUM,
    list_size: int = 8,
) -> DataFrame:
    """Suggestions for ``pages(site, idx, url, page_type, product_entity, content)``.

    A ``page_tokens`` array (distinct tokens of the content) may stand in for
    ``content``. ``site_pages`` has ``(site, idx, url)``. ``list_size`` trades list length
    against the number of combined token sets; it must exceed ``picks``.
    Result: ``site, source_idx, source_page, rank, anchor, target_page``.
    """
    if list_size <= picks:
        raise ValueError("list_size must exceed picks")
    targets = cut_lineage(_targets(site_pages, vocab), "targets")
    ready = "page_tokens" in pages.columns
    content = F.col("page_tokens") if ready else hyphen_tokens(F.col("content"))
    tokens = F.array_distinct(F.concat(content, hyphen_tokens(F.col("product_entity"))))
    for_pdp = F.coalesce(F.col("page_type") == "pdp", F.lit(False)).alias("for_pdp")
    sources = cut_lineage(_with_pools(pages.select(*_PAGE, "url", for_pdp, tokens.alias("page_tokens")), targets), "sources")

    def filled(best: DataFrame) -> DataFrame:
        return _filled(sources, best, _backfill_lists(targets, picks + minimum), minimum)

    # The empty set: the site's best targets.
    postings = cut_lineage(_posting_lists(targets.withColumn("key", F.lit("")), list_size), "postings")
    every = sources.select(*_PAGE, "for_pdp", "pool", F.lit("").alias("key"))
    found = _best(_read(every, postings), picks)
    large = postings.filter("tail is not null").select("site").distinct()
    if large.isEmpty():
        return filled(found)

    # Single tokens. Behind them only tokens count whose own lists are truncated.
    targets_ = targets.join(large, "site", "left_semi")
    postings = cut_lineage(_posting_lists(unnest(targets_, ["*"], F.array_distinct("tokens"), "key"), list_size), "postings")
    asked = unnest(every.drop("key").join(large, "site", "left_semi"), ["*"], F.col("pool"), "key")
    best = cut_lineage(_best(found.unionByName(_best(_read(asked, postings), picks)), picks), "picks")
    worst = best.groupBy(*_PAGE).agg(F.count("*").alias("n"), F.max(F.struct("negative_score", "target_idx")).alias("worst"))
    heavy = postings.filter("tail is not null")
    members = unnest(_weighed(targets_, heavy.select("site", F.col("key").alias("token")).distinct()), ["*"], F.col("deep"), "key")
    members = cut_lineage(members, "members")
    deep = lookup(asked, heavy.select(*_LIST), _LIST, "idx", "inner").groupBy(*_PAGE).agg(F.collect_set("key").alias("deep"))
    known = deep.join(worst.filter(F.col("n") >= picks).drop("n"), _PAGE, "left")
    asked = _open(asked.join(known, _PAGE), postings, members)
    found = best
    while not asked.isEmpty():
        # Anchors with a set that is still asked for, and one more of their tokens behind it in order.
        still = asked.select("site", "key").distinct().withColumn("wanted", F.lit(True))
        members = lookup(members, still, ["site", "key"], "idx", "inner").drop("wanted").withColumnRenamed("key", "prefix")
        later = F.filter("deep", lambda t: t > F.substring_index("prefix", " ", -1))
        members = cut_lineage(unnest(members, ["*"], later, "token").withColumn("key", F.concat_ws(" ", "prefix", "token")), "members")
        ways = members.select("site", "prefix", "token", "key").distinct()
        asked = asked.withColumnRenamed("key", "prefix").join(ways, ["site", "prefix"])
        asked = asked.filter(F.array_contains("deep", F.col("token"))).drop("prefix", "token")
        members = members.drop("prefix", "token")
        postings = cut_lineage(_posting_lists(members, list_size), "postings")
        found = found.unionByName(_best(_read(asked, postings), picks))
        asked = _open(asked, postings, members)
    return filled(_best(found, picks))


def _with_pools(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``pool``: the tokens of a page that anchors of its site have; a page has no use for others."""
    words = unnest(targets, ["site", "idx"], F.array_distinct("tokens"), "token").select("site", "token").distinct()
    asked = unnest(sources, _PAGE, F.col("page_tokens"), "token")
    pools = lookup(asked, words.withColumn("known", F.lit(True)), ["site", "token"], "idx", "inner").groupBy(*_PAGE).agg(F.collect_set("token").alias("pool"))
    pool = F.coalesce("pool", F.array().cast("array<string>"))
    return sources.drop("page_tokens").join(pools, _PAGE, "left").withColumn("pool", pool)


def _backfill_lists(targets: DataFrame, anchors: int) -> DataFrame:
    """First distinct anchors of each site in site order, two rows each."""
    holders = (
        top_k(targets, ["site", "anchor"], [F.col("idx")], 2)
        .groupBy("site", "anchor")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "anchor", "url"))).alias("holders"))
        .withColumn("first_idx", F.col("holders")[0]["idx"])
    )
    first = top_k(holders, ["site"], [F.col("first_idx")], anchors)
    return first.groupBy("site").agg(
        F.array_sort(F.flatten(F.collect_list("holders"))).alias("fill")
    )


def _filled(sources: DataFrame, best: DataFrame, backfill: DataFrame, minimum: int) -> DataFrame:
    """Picks in order; pages with fewer than ``minimum`` take the first pages of their site, too."""
    pick = F.struct("negative_score", "target_idx", "anchor", F.col("target_page").alias("url"))
    picked = best.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(pick)).alias("top"))
    rows = lookup(sources.join(picked, _PAGE, "left"), backfill, ["site"], "idx")

    def named(found: Column) -> Column:
        return F.transform(found, lambda r: F.struct(r["anchor"].alias("anchor"), r["url"].alias("url")))

    top = F.coalesce(named(F.col("top")), F.array().cast("array<struct<anchor:string,url:string>>"))
    fill = named(F.filter("fill", lambda r: r["idx"] != F.col("idx")))
    both = bind(top, lambda t: F.when(F.size(t) >= minimum, t).otherwise(first_distinct(F.concat(t, fill), "anchor", minimum)))
    keep = ["site", F.col("idx").alias("source_idx"), F.col("url").alias("source_page")]
    return unnest(rows.withColumn("chosen", both), keep, F.col("chosen"), "pick", "rank").select(
        "site", "source_idx", "source_page", (F.col("rank") + 1).alias("rank"), F.col("pick.anchor").alias("anchor"),
        F.col("pick.url").alias("target_page"),
    )
