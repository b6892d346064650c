"""Text expressions: tokens, counts, fences, hashes, redaction, trimming."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sizes and patterns that decide results.
HEAD_CHARS = 250
TAIL_CHARS = 150
WORD = r"[\p{L}\p{N}_]+"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
FENCE = r"```|~~~"
URL_CREDENTIAL = r"(https?://|git://|ssh://|git@)[^/\s@]+@"
SECRET_ASSIGNMENT = r"(?i)(api[_-]?key|access[_-]?token|secret|password)(\s*[:=]\s*)([\"'])(.*?)(\3)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
FILE_MENTION = r"\b[a-zA-Z0-9_\-]+\.(?:py|js|ts|jsx|tsx|md|rst|txt|json|yaml|yml)\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Unicode word tokens of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), 0)


def strip(c) -> Column:
    """Remove every kind of whitespace at both ends, not just blanks."""
    return F.trim(col(c), F.lit(SPACE_CHARS))


def is_blank(c) -> Column:
    return ~F.coalesce(col(c).rlike(NON_SPACE), F.lit(False))


def approx_tokens(c) -> Column:
    """Four characters per token, at least one for any text, none for the empty text."""
    n = F.length(col(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def word_count(c) -> Column:
    """Whitespace-separated words (the stub tokenizer's count)."""
    body = strip(c)
    return F.when(F.length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, r"(?U)\s+")))


def has_code_fence(c) -> Column:
    return col(c).rlike(FENCE)


def content_hash(c, length: int = 64) -> Column:
    return F.left(F.sha2(col(c), 256), F.lit(length))


def head_tail(c, head: int = HEAD_CHARS, tail: int = TAIL_CHARS) -> Column:
    """Keep short texts; of longer ones the head and the tail around an ellipsis."""
    text = col(c)
    return F.when(F.length(text) <= head + tail, text).otherwise(
        F.concat(F.left(text, F.lit(head)), F.lit(" ... "), F.right(text, F.lit(tail)))
    )


def redact_url(c) -> Column:
    return F.regexp_replace(col(c), URL_CREDENTIAL, "$1")


def redact_secrets(c) -> Column:
    return F.regexp_replace(col(c), SECRET_ASSIGNMENT, "$1$2$3<redacted>$3")


def emails(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(EMAIL), 0))


def file_mentions(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(FILE_MENTION), 0))


def table_cell(c) -> Column:
    """A value as it may stand inside a Markdown table row."""
    text = F.coalesce(col(c).cast("string"), F.lit("—"))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def anchor(c) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def lines(c) -> Column:
    """Lines of a text; a trailing line break does not open another line."""
    body = F.regexp_replace(col(c), r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ])\z", "")
    return F.when(F.length(col(c)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    )


def line_count(c) -> Column:
    """How many :func:`lines` a text has, without cutting it."""
    text = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    breaks = F.length(text) - F.length(F.translate(text, LINE_BREAKS, ""))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(F.right(text, F.lit(1)).isin(*LINE_BREAKS), 0).otherwise(1))


def line_range(c, start, end, max_chars: int | None = None) -> Column:
    """One-indexed inclusive line range of a text, cut at ``max_chars`` where that is given."""
    all_lines = lines(c)
    picked = F.slice(all_lines, col(start), F.greatest(col(end) - col(start) + 1, F.lit(0)))
    whole = F.array_join(picked, "\n")
    return whole if max_chars is None else F.left(whole, F.lit(max_chars))


