"""Column helpers that pull fields out of stored HTML.

All helpers are regular expressions over one column: a page needs one scan and
no shuffle. ``dom_text`` is the optional slow path for markup too broken for
regular expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.functions import urls
from sitegrain.functions.text import (
    ENTITY_NOISE,
    bind,
    first_n,
    squash,
    strip,
    text_or_empty,
)

# fixed values: elements whose content is not text
HIDDEN_TAGS = ("script", "style", "noscript", "iframe")
BATCH_HIDDEN_TAGS = HIDDEN_TAGS + ("svg",)

# fixed values: named character references decoded in text
CHARACTER_REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "hellip": "…", "bull": "•",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "times": "×", "deg": "°", "sect": "§", "para": "¶", "iexcl": "¡", "iquest": "¿",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å",
    "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë",
    "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò",
    "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "ugrave": "ù", "uacute": "ú",
    "ucirc": "û", "uuml": "ü", "szlig": "ß",
}


def strip_hidden(
    html: Column, tags: tuple[str, ...] = HIDDEN_TAGS, keep_json_ld: bool = False
) -> Column:
    """Visible markup: comments and elements that carry no text removed.

    One pass over the page. The helpers below read this markup, so a projection
    should compute it once and hand it on as a column.
    """
    names = "|".join(tags)
    kept = r"(?!script\b[^>]*application/ld\+json)" if keep_json_ld else ""
    pattern = rf"(?is)<!--.*?-->|<{kept}({names})\b[^>]*>.*?</\1[^>]*>"
    return F.regexp_replace(text_or_empty(html), pattern, "")


def decode_references(c: Column) -> Column:
    """Decode named and numeric character references in one pass."""
    table = F.create_map(*[F.lit(x) for pair in CHARACTER_REFERENCES.items() for x in pair])

    def character(name: Column) -> Column:
        digits = (
            F.when(name.rlike(r"^#[0-9]{1,7}$"), F.conv(name.substr(2, 7), 10, 16))
            .when(name.rlike(r"^#[xX][0-9a-fA-F]{1,6}$"), name.substr(3, 6))
        )
        numeric = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.coalesce(F.element_at(table, name), numeric)

    def segment(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^([#a-zA-Z0-9]{2,9});", 1)
        decoded = F.concat(character(name), part.substr(F.length(name) + 2, F.length(part)))
        return (
            F.when(i == 0, part)
            .when(name == "", F.concat(F.lit("&"), part))
            .otherwise(F.coalesce(decoded, F.concat(F.lit("&"), part)))
        )

    def decoded(v: Column) -> Column:
        joined = F.array_join(F.transform(F.split(v, "&", -1), segment), "")
        return F.when(v.contains("&"), joined).otherwise(v)

    return bind(c, decoded)


def inner_text(markup: Column) -> Column:
    """Text of a fragment: tags vanish without a separator, references decode."""
    return squash(decode_references(F.regexp_replace(markup, r"<[^>]*>", "")))


def title(visible: Column) -> Column:
    """Text of every ``<title>``, joined, blanks collapsed."""
    found = F.regexp_extract_all(visible, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), 1)
    return squash(decode_references(F.array_join(found, "")))


def first_title(visible: Column) -> Column:
    """Text of the first ``<title>`` only, trimmed, inner blanks kept."""
    return strip(decode_references(F.regexp_extract(visible, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def void_tags(visible: Column) -> Column:
    """All ``<meta>``, ``<link>`` and ``<img>`` tags of a page, in order."""
    return F.regexp_extract_all(visible, F.lit(r"(?is)(<(?:meta|link|img)\b[^>]*>)"), 1)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, any quoting, references decoded."""
    raw = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return decode_references(F.regexp_replace(raw, r"^[\"']|[\"']$", ""))


def _value_of(tags: Column, tag: str, attribute: str, value: str, wanted: str) -> Column:
    """``wanted`` attribute of the first tag whose ``attribute`` is ``value``."""
    pattern = rf"(?is)^<{tag}\s(?:[^>]*?\s)?{attribute}\s*=\s*(?:\"{value}\"|'{value}'|{value}[\s/>])"
    first = F.try_element_at(F.filter(tags, lambda t: t.rlike(pattern)), F.lit(1))
    return F.coalesce(_attribute(first, wanted), F.lit(""))


def meta_description(tags: Column) -> Column:
    return squash(_value_of(tags, "meta", "name", "description", "content"))


def meta_description_or_og(tags: Column) -> Column:
    named = _value_of(tags, "meta", "name", "description", "content")
    og = _value_of(tags, "meta", "property", "og:description", "content")
    return strip(F.coalesce(F.nullif(named, F.lit("")), og))


def canonical_link(tags: Column) -> Column:
    return strip(_value_of(tags, "link", "rel", "canonical", "href"))


def robots_meta(tags: Column) -> Column:
    return strip(_value_of(tags, "meta", "name", "robots", "content"))


def missing_alt_images(tags: Column) -> Column:
    images = F.filter(tags, lambda t: t.rlike(r"(?i)^<img"))
    return F.size(F.filter(images, lambda t: strip(_attribute(t, "alt")) == "")).cast("long")


def h1_count(visible: Column) -> Column:
    return F.regexp_count(visible, F.lit(r"(?i)<h1[\s>]")).cast("long")


def paragraph_count(visible: Column) -> Column:
    return F.regexp_count(visible, F.lit(r"(?i)<p[\s>]")).cast("long")


def headings(visible: Column, levels: str = "1-4", drop_empty: bool = False) -> Column:
    """Ordered ``array<struct<tag,text>>`` of the headings of these levels."""
    found = F.regexp_extract_all(
        visible, F.lit(rf"(?is)(<h[{levels}](?:\s[^>]*)?>.*?)</h[{levels}]\s*>"), 1
    )
    rows = F.transform(
        found,
        lambda h: F.struct(
            F.lower(F.substring(h, 2, 2)).alias("tag"), inner_text(h).alias("text")
        ),
    )
    return F.filter(rows, lambda h: h["text"] != "") if drop_empty else rows


def body(visible: Column) -> Column:
    """Markup of the body; without a body tag, everything outside the head."""
    found = F.regexp_extract(visible, r"(?is)<body(?:\s[^>]*)?>(.*)", 1)
    no_head = F.regexp_replace(visible, r"(?is)<(head|title)(?:\s[^>]*)?>.*?</\1\s*>", "")
    return F.coalesce(F.nullif(found, F.lit("")), no_head)


def body_text(visible: Column) -> Column:
    return inner_text(body(visible))


def _element(rest: Column, tag: Column) -> Column:
    """Markup up to the end tag that closes an element, given what follows its start tag.

    Start and end tags of the same name are counted; an element that is never closed ends with the page.
    """
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s/>])")))
    state = lambda depth, kept: F.struct(depth.alias("depth"), kept.alias("kept"))

    def step(piece: Column, i: Column) -> Column:
        # All pieces but the first begin with a tag of this name; the first may be text, or another tag.
        starts = lambda mark: F.rlike(piece, F.concat(F.lit(f"^(?i){mark}"), tag, F.lit(r"[\s/>]")))
        first = F.when(starts("</"), -1).when(starts("<"), 1).otherwise(0)
        return F.when(i == 0, first).when(piece.startswith("</"), -1).otherwise(1)

    def turn(now: Column, by: Column) -> Column:
        depth = now["depth"] + by
        return F.when(now["depth"] == 0, now).otherwise(state(depth, now["kept"] + F.when(depth == 0, 0).otherwise(1)))

    def cut(parts: Column) -> Column:
        kept = F.aggregate(F.transform(parts, step), state(F.lit(1), F.lit(0)), turn, lambda s: s["kept"])
        return F.array_join(F.slice(parts, F.lit(1), kept), "")

    return bind(pieces, cut)


def main_content(visible: Column, tags: tuple[str, ...] = ("main",)) -> Column:
    """Markup of the main region: a listed tag, else role=main, else the body. Regions may hold elements of their own name."""

    def inside(start: str, tag: Column) -> Column:
        parts = F.split(visible, start, 2)
        return F.when(F.size(parts) > 1, F.nullif(_element(parts[1], tag), F.lit("")))

    start = r"(?is)<([a-z][a-z0-9]*)\s(?:[^>]*?\s)?role\s*=\s*[\"']?main(?:[\"'\s/][^>]*)?>"
    choices = [inside(rf"(?is)<{t}(?:\s[^>]*)?>", F.lit(t)) for t in tags]
    return F.coalesce(*choices, inside(start, F.regexp_extract(visible, start, 1)), body(visible))


def hrefs(visible: Column) -> Column:
    """Trimmed, non-empty ``href`` values of anchors that lead to pages."""
    pattern = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    raw = F.regexp_extract_all(visible, F.lit(pattern), 1)
    cleaned = F.transform(
        raw, lambda h: strip(decode_references(F.regexp_replace(h, r"^[\"']|[\"']$", "")))
    )
    return F.filter(cleaned, lambda h: (h != "") & ~h.rlike(r"^(?i)(?:mailto:|tel:|javascript:)"))


def internal_links(page_url: Column, href_list: Column) -> Column:
    """Distinct same-host links in page order, resolved, fragment dropped."""
    def same_host(links: Column) -> Column:
        return bind(
            urls.hostname(page_url),
            lambda host: F.filter(links, lambda u: u.isNotNull() & (urls.hostname(u) == host)),
        )

    return F.array_distinct(bind(urls.resolve_all(page_url, href_list), same_host))


def relative_link_count(href_list: Column) -> Column:
    return F.size(F.filter(href_list, lambda h: h.rlike(r"^(?:/|\./|\.\./)"))).cast("long")


def absolute_link_count(href_list: Column) -> Column:
    return F.size(F.filter(href_list, lambda h: h.rlike(r"^(?i)https?://"))).cast("long")


def product_entity(h1: Column, page_title: Column, url: Column) -> Column:
    """First three words of ``h1 title slug`` once sales words are deleted."""
    source = F.trim(
        F.concat_ws(" ", text_or_empty(h1), text_or_empty(page_title), urls.slug_words(url))
    )
    cleaned = squash(F.regexp_replace(source, ENTITY_NOISE, ""))
    tokens = F.filter(F.split(cleaned, " "), lambda t: t != "")
    return F.array_join(first_n(tokens, 3), " ")


def first_h1(heading_list: Column) -> Column:
    h1 = F.filter(heading_list, lambda h: h["tag"] == "h1")
    return F.coalesce(F.try_element_at(h1, F.lit(1))["text"], F.lit(""))


def json_ld_types(visible: Column) -> Column:
    """Distinct ``@type`` values of JSON-LD blocks; graphs are not walked.

    Takes markup that kept its JSON-LD scripts.
    """
    blocks = F.regexp_extract_all(
        visible,
        F.lit(r"(?is)<script\s(?:[^>]*?\s)?type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"),
        1,
    )

    def block_types(raw: Column) -> Column:
        def of(v: Column) -> Column:
            top = F.coalesce(
                F.try_variant_get(v, "$", "array<variant>"), F.array(v)
            )
            return F.flatten(
                F.transform(
                    top,
                    lambda node: F.coalesce(
                        F.try_variant_get(node, "$['@type']", "array<string>"),
                        F.array(F.try_variant_get(node, "$['@type']", "string")),
                    ),
                )
            )

        return bind(F.try_parse_json(raw), of)

    found = F.flatten(F.transform(F.filter(blocks, lambda b: strip(b) != ""), block_types))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull() & (t != "")))


def faq_questions(visible: Column, limit: int = 20) -> Column:
    """Question texts of headings, paragraphs and list items, first ``limit``."""
    # A paragraph or item ends at its end tag or where the next block starts.
    pattern = r"(?is)<(?:h[2-4]|p|li)(?:\s[^>]*)?>(.*?)(?=</(?:h[2-4]|p|li)\s*>|<(?:p|li|h[1-6]|ul|ol|div|section|table)[\s>]|\z)"
    texts = F.transform(
        F.regexp_extract_all(visible, F.lit(pattern), 1), lambda t: inner_text(t)
    )
    prefix = r"^(?i)(?:q:|question:)"
    asked = F.filter(
        texts,
        lambda t: F.length(t).between(12, 180) & (t.endswith("?") | t.rlike(prefix)),
    )
    cleaned = F.transform(asked, lambda t: strip(F.regexp_replace(t, prefix, "")))
    return first_n(F.array_distinct(cleaned), limit)


class _VisibleText(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN_TAGS or tag == "head"

    def handle_endtag(self, tag: str) -> None:
        if (tag in HIDDEN_TAGS or tag == "head") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def _visible_text(page: str | None) -> str:
    parser = _VisibleText()
    parser.feed(page or "")
    parser.close()
    return " ".join("".join(parser.parts).split())


@F.pandas_udf(T.StringType())
def dom_text(page: pd.Series) -> pd.Series:
    """Optional parser-based body text; Arrow batches, off by default."""
    return page.map(_visible_text)
