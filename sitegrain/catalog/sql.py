"""SQL fragments shared by the check queries (DuckDB dialect).

They restate field definitions independently of the Spark columns, in the
regular-expression dialect without look-around.
"""

from __future__ import annotations

BLANKS = (
    r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
NON_BLANKS = "[^" + BLANKS[1:]


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


def path(url: str) -> str:
    p = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def origin(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"


def no_fragment(url: str) -> str:
    return f"regexp_replace({url}, '#.*$', '')"


def last_segment(url: str, fallback: str) -> str:
    seg = f"list_filter(string_split({path(url)}, '/'), lambda s: s <> '')"
    return f"coalesce({seg}[-1], '{fallback}')"


def first_segment(url: str, fallback: str) -> str:
    seg = f"list_filter(string_split({path(url)}, '/'), lambda s: s <> '')"
    return f"coalesce({seg}[1], '{fallback}')"


def visible(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "iframe"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}[^>]*>', '', 'g')"
    return out


def decode(text: str) -> str:
    out = text
    for raw, char in (
        ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
        ("&nbsp;", " "), ("&amp;", "&"),
    ):
        out = f"replace({out}, {q(raw)}, {q(char)})"
    return out


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def squash(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANKS}+', ' ', 'g'))"


def inner_text(markup: str) -> str:
    return squash(decode(f"regexp_replace({markup}, '<[^>]*>', '', 'g')"))


def word_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{NON_BLANKS}+'))"


def hyphen_tokens(text: str) -> str:
    """Split-based statement of the first tokenizer."""
    cleaned = f"regexp_replace(lower({text}), '[^a-z0-9\\s-]', ' ', 'g')"
    return f"list_filter(string_split_regex({cleaned}, '\\s+'), lambda t: length(t) > 2)"


def percent_encode(url: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({url}, ''), "
        f"lambda c: CASE WHEN regexp_matches(c, '[^!#-;=?-_a-z|~]') THEN url_encode(c) ELSE c END), '')"
    )


def contains_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


PAGES = f"""
raw_pages AS (
  SELECT page_id AS idx, url, html, {host('url')} AS site, {path('url')} AS path,
         {visible('html')} AS vis
  FROM pages
),
page_fields AS (
  SELECT idx, site, url, path, html, vis,
         {squash(decode("array_to_string(regexp_extract_all(vis, '(?is)<title[^>]*>(.*?)</title>', 1), '')"))} AS title,
         list_transform(regexp_extract_all(vis, '(?is)<h[1-4](?:\\s[^>]*)?>(.*?)</h[1-4]\\s*>', 1),
                        lambda h: {inner_text('h')}) AS heading_texts,
         {inner_text("regexp_extract(vis, '(?is)<body(?:\\s[^>]*)?>(.*)', 1)")} AS body_text
  FROM raw_pages
),
feats AS (
  SELECT *,
         CASE WHEN body_text = '' THEN []::VARCHAR[] ELSE string_split(body_text, ' ') END AS body_words,
         array_to_string(string_split(body_text, ' ')[1:1500], ' ') AS first_1500_words
  FROM page_fields
)"""

LINKS = f"""
href_rows AS (
  SELECT idx, site, url, unnest(regexp_extract_all(vis, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(vis, '<a href="([^"]*)"', 1), 1) - 1 AS pos
  FROM raw_pages
),
resolved AS (
  SELECT idx, site, url, pos, {percent_encode(f"({origin('url')} || " + decode('href') + ")")} AS link
  FROM href_rows WHERE href LIKE '/%'
),
page_links AS (
  SELECT idx, site, url, link, min(pos) AS pos FROM resolved GROUP BY ALL
)"""


def page_type(url_path: str, text: str | None, vocab) -> str:
    """Page type by rule order, as one CASE."""
    p = f"lower({url_path})"

    def alt(words):
        return "(" + "|".join(words) + ")"

    product = [
        f"regexp_matches({p}, '/{alt(vocab.product_segments)}/')",
        f"regexp_matches({p}, '/{alt(vocab.product_terms)}(/|$)')",
        f"regexp_matches({p}, '/{alt(vocab.product_prefixes)}')",
    ]
    blog = [f"regexp_matches({p}, '/{alt(vocab.blog_segments)}/')"]
    if text:
        product.append(contains_any(text, vocab.commerce_phrases))
        blog.append(contains_any(text, vocab.blog_words))
    category = [
        f"regexp_matches({p}, '/{alt(vocab.category_segments)}/')",
        f"regexp_matches({p}, '/{alt(vocab.category_words)}(/|$)')",
    ]
    return (
        f"CASE WHEN {p} IN ('', '/') THEN 'homepage' WHEN {' OR '.join(product)} THEN 'pdp' "
        f"WHEN {' OR '.join(blog)} THEN 'blog' WHEN {' OR '.join(category)} THEN 'category' "
        "ELSE 'generic' END"
    )
