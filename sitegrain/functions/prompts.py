"""Columns that prepare untrusted text for a model and clean what comes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.text import (
    BLANK,
    WORD_END,
    WORD_START,
    cap_words,
    squash,
    strip,
    text_or_empty,
)
from sitegrain.vocab import (
    AUDIT_SECTION_MARKER,
    AUDIT_SECTION_TEXT,
    INJECTION_PATTERNS,
    SECURITY_HEADER,
    UNTRUSTED_BEGIN,
    UNTRUSTED_END,
)

MIN_CHARS = 1000
SECTION_CHARS = 12000


def injection_regexes(blank: str = BLANK, start: str = WORD_START, end: str = WORD_END) -> list[str]:
    return ["(?i)" + p.format(s=blank, b=start, e=end) for p in INJECTION_PATTERNS]


def has_injection(c: Column) -> Column:
    flag = F.lit(False)
    for pattern in injection_regexes():
        flag = flag | text_or_empty(c).rlike(pattern)
    return flag


def sanitize(c: Column, max_chars: int = SECTION_CHARS, max_run: int = 8) -> Column:
    """Delete injections, disarm fences and scripts, cap repeats, cut."""
    out = text_or_empty(c)
    for pattern in injection_regexes():
        out = F.regexp_replace(out, pattern, "")
    out = F.replace(out, F.lit("```"), F.lit("` ` `"))
    out = F.regexp_replace(out, f"(?i)<{BLANK}*script", "<blocked-script")
    out = F.regexp_replace(out, f"(?i)</{BLANK}*script{BLANK}*>", "</blocked-script>")
    # Blanks are single spaces by now, so a plain split gives the words.
    return F.substring(cap_words(F.split(squash(out), " ", -1), max_run), 1, max(MIN_CHARS, max_chars))


def fence(content: Column) -> Column:
    return F.concat(F.lit(UNTRUSTED_BEGIN + "\n"), content, F.lit("\n" + UNTRUSTED_END))


def safe_prompt(
    task: Column,
    untrusted: Sequence[tuple[str, Column]],
    trusted: Sequence[Column] = (),
    system: Column | None = None,
    max_chars: int = SECTION_CHARS,
) -> Column:
    """Prompt text: fixed header, instructions, trusted context, fenced sections."""
    blank = F.lit("")

    def optional(c: Column) -> Column:
        return F.when(text_or_empty(c) != "", F.concat(c, F.lit("\n")))

    lines: list[Column] = [F.lit(SECURITY_HEADER), blank]
    if system is not None:
        lines.append(optional(system))
    lines.append(optional(task))
    if trusted:
        lines += [F.lit("TRUSTED CONTEXT"), blank]
        lines += [optional(section) for section in trusted]
    for name, content in untrusted:
        lines += [F.lit(name or "UNTRUSTED DATA"), fence(sanitize(content, max_chars)), blank]
    return strip(F.concat_ws("\n", *lines))


# fixed values: character caps of a scraped record
FIELD_CAPS = {
    "title": 500,
    "meta_description": 800,
    "html": 20000,
    "first_1500_words": 12000,
    "visible_text": 12000,
    "product_entity": 200,
}


def clean_generated(c: Column) -> Column:
    """Remove fences, residue lines, trailing rules and blank-line runs."""
    out = strip(F.regexp_replace(text_or_empty(c), r"(?s)```.*?```", ""))
    # fixed values: residue lines
    out = F.regexp_replace(out, r"(?im)^\s*PASTE INTO:\s*$", "")
    out = F.regexp_replace(out, r"(?im)^\s*Bottom of PDP \(after FAQ\)\s*$", "")
    out = F.regexp_replace(out, r"\n\s*-{10,}\s*\z", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def append_audit_section(content: Column, product_page: Column) -> Column:
    """Append the audit section to product pages once."""
    text = text_or_empty(content)
    marked = F.lower(text).contains(AUDIT_SECTION_MARKER.lower())
    return (
        F.when(~F.coalesce(product_page, F.lit(False)) | marked, text)
        .when(strip(text) == "", F.lit(AUDIT_SECTION_TEXT))
        .otherwise(F.concat(text, F.lit("\n\n" + AUDIT_SECTION_TEXT)))
    )
