"""Column helpers for plain text: blanks, tokens, slugs, ordered lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.vocab import ENTITY_NOISE_WORDS, STOPWORDS, TOPIC_STOPWORDS

# Blank characters of the source semantics; Java's \s lacks most of them. The
# range test in front settles nearly every character with one comparison.
_BLANKS = (
    r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
BLANK = r"[[^!-\x{9F}]&&[" + _BLANKS + "]]"
NON_BLANK = r"[!-\x{9F}[^" + _BLANKS + "]]"
# ASCII word edges: Java's \b follows Unicode letters, the source does not.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


ENTITY_NOISE = f"(?i){WORD_START}(?:{'|'.join(ENTITY_NOISE_WORDS)}){WORD_END}"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside lambdas.

    A lambda re-evaluates every outer expression it mentions for every element;
    a bound value is a lambda variable and is read, not recomputed.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    """null, missing and empty are the same value everywhere in this library."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squash(c: Column) -> Column:
    """Collapse blank runs to one space, then trim."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NON_BLANK}+)"), 1)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NON_BLANK}+")).cast("long")


def tags_to_space(c: Column) -> Column:
    """Tag stripper that leaves a space per tag."""
    return F.regexp_replace(c, r"<[^>]+>", " ")


def hyphen_tokens(c: Column) -> Column:
    """Lower-case runs of ``[a-z0-9-]`` longer than two characters, in order."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z0-9-]{3,})"), 1)


def content_tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(hyphen_tokens(c), lambda t: ~t.isin(list(stopwords)))


def topic_tokens(c: Column, stopwords: Sequence[str] = TOPIC_STOPWORDS) -> Column:
    """Lower-case alphanumeric runs longer than two characters; hyphens split."""
    runs = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z0-9]{3,})"), 1)
    return F.filter(runs, lambda t: ~t.isin(list(stopwords)))


def normalize_keyword(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(kept, r"[\s\x{0B}]+", " "))


def any_of(terms: Sequence[str]) -> str:
    """Regex alternation of literal terms."""
    return "(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + ")"


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    return c.rlike(any_of(terms))


def holds_any(c: Column, terms: Sequence[str]) -> Column:
    """Like ``contains_any`` by plain substring tests; for a column or bound value."""
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def text_slug(c: Column, limit: int | None = 80) -> Column:
    """Slug that keeps ``-`` and ``_``; cut at ``limit`` unless that is None."""
    dashed = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9_-]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+$", "")
    return slug if limit is None else F.substring(slug, 1, limit)


def path_slug(c: Column) -> Column:
    """Slug of letters and digits only, uncut."""
    dashed = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each space-separated word; rest untouched."""
    parts = F.transform(
        F.split(c, " ", -1),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
    )
    return F.array_join(parts, " ")


def literal_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def list_or_empty(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def listed_in(terms: Column, text: Column, present: bool = True, first: int | None = None) -> Column:
    """Terms of an array that occur (or not) in ``text``, both lower-cased; with ``first``, the first so many.

    Once those are found, the text is not searched for the other terms.
    """
    def hits(low: Column) -> Column:
        def wanted(t: Column) -> Column:
            return low.contains(F.lower(t)) if present else ~low.contains(F.lower(t))

        if first is None:
            return F.filter(terms, wanted)
        none = F.filter(terms, lambda t: F.lit(False))
        return F.aggregate(
            terms, none, lambda kept, t: F.when(F.size(kept) >= first, kept).when(wanted(t), F.concat(kept, F.array(t))).otherwise(kept)
        )

    return bind(F.lower(text), hits)


def escape_html(c: Column) -> Column:
    out = text_or_empty(c)
    # fixed values: escape table, '&' first
    for raw, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def cap_repeats(c: Column, max_run: int = 8) -> Column:
    """Keep at most ``max_run`` of consecutive equal words (case-insensitive)."""
    return cap_words(words(c), max_run)


def cap_words(items: Column, max_run: int = 8) -> Column:
    """:func:`cap_repeats` of a list of words.

    Word i is dropped when it equals each of the ``max_run`` words before it, so
    a run is measured against the words themselves and needs no running state.
    Most words differ from the last one, which settles them with one comparison.
    """
    def capped(w: Column) -> Column:
        def keep(t: Column, i: Column) -> Column:
            before = F.slice(w, F.greatest(i - max_run + 1, F.lit(1)), max_run)
            return (i < max_run) | (F.lower(F.get(w, i - 1)) != F.lower(t)) | F.exists(before, lambda p: F.lower(p) != F.lower(t))

        return F.array_join(F.filter(w, keep), " ")

    return bind(items, capped)
