"""Text helpers as ``Column -> Column`` functions.

Everything here is built from JVM-side expressions. Whitespace follows the
Unicode definition (no-break and typographic spaces count), which Java's plain
``\\s`` does not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom import constants as C

_WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + "".join(map(chr, _WIDE_SPACES))
_CLASS = r"\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[\s{_CLASS}]"
INLINE_WS = rf"[ \t\r\x0b\f{_CLASS}]"
# inline white space that is not a single plain space already
RAGGED_WS = rf" {INLINE_WS}+|[\t\r\x0b\f{_CLASS}]{INLINE_WS}*"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(SPACE_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACE_CHARS))


def plain_spaces(col: Column) -> Column:
    """Unusual whitespace as plain spaces, so that the fast ASCII ``\\s`` is enough.

    Texts without any, nearly all, are passed through after one search.
    """
    wide = SPACE_CHARS[6:]
    return let(
        col,
        lambda c: F.when(
            F.regexp_like(c, F.lit(f"[{_CLASS}]")), F.translate(c, wide, " " * len(wide))
        ).otherwise(c),
    )


def words(col: Column) -> Column:
    """Whitespace-delimited words."""
    return let(
        F.trim(plain_spaces(col), F.lit(SPACE_CHARS[:6])),
        lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(
            F.split(s, r"\s+")
        ),
    )


def word_count(col: Column) -> Column:
    return F.regexp_count(plain_spaces(col), F.lit(r"\S+")).cast("long")


def is_blank(col: Column) -> Column:
    return strip(text_or_empty(col)) == ""


def normalize_whitespace(col: Column) -> Column:
    """Single inline spaces, trimmed lines, no blank lines."""
    collapsed = F.regexp_replace(text_or_empty(col), RAGGED_WS, " ")
    lines = F.transform(F.split(collapsed, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def trim_lines(col: Column) -> Column:
    """Trimmed lines without the blank ones; inline spacing is kept."""
    lines = F.transform(F.split(text_or_empty(col), LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(col: Column, min_words: int = 3) -> Column:
    """Sentences (split after ``.``, ``!`` or ``?``) of at least ``min_words`` words."""
    parts = F.transform(F.split(text_or_empty(col), rf"(?<=[.!?]){WS}+"), strip)
    if min_words <= 1:
        return F.filter(parts, lambda s: s != "")
    # a stripped sentence has one word more than gaps; the search ends at the last gap asked for
    gaps = rf"(?:{WS}++[^\s{_CLASS}]++){{{min_words - 1}}}"
    return F.filter(parts, lambda s: F.regexp_like(s, F.lit(gaps)))


def join_first(items: Column, k: int, sep: str = " ") -> Column:
    return F.array_join(F.slice(items, 1, k), sep)


def summary_from(sents: Column, col: Column, k: int = 4) -> Column:
    """First ``k`` sentences; else the first 300 characters; else a fixed notice."""
    head = F.substring(strip(text_or_empty(col)), 1, 300)
    return F.when(F.size(sents) > 0, join_first(sents, k)).otherwise(
        F.coalesce(F.nullif(head, F.lit("")), F.lit(C.NO_CONTENT))
    )


def extractive_summary(col: Column, k: int = 4) -> Column:
    return let(sentences(col), lambda s: summary_from(s, col, k))


def contains_any(col: Column, terms: Sequence[str]) -> Column:
    """True if the text contains one of the lower-case terms as a substring."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(col, F.lit(term))
    return hit


def keyword_sentences(sents: Column, terms: Sequence[str], limit: int = 5) -> Column:
    return F.slice(F.filter(sents, lambda s: contains_any(F.lower(s), terms)), 1, limit)


def find_all(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """All whole matches with Unicode-aware classes, in order."""
    flags = "(?iU)" if ignore_case else "(?U)"
    return F.regexp_extract_all(text_or_empty(col), F.lit(flags + pattern), F.lit(0))


def metric_mentions(col: Column) -> Column:
    """Money, then percentages, then magnitudes, then basis points; each value once.

    The patterns start and end with visible characters, so matches need no trimming.
    """
    return F.array_distinct(
        F.concat(
            find_all(col, C.MONEY),
            find_all(col, C.PERCENT),
            find_all(col, C.MAGNITUDE, ignore_case=True),
            find_all(col, C.BASIS_POINTS, ignore_case=True),
        )
    )


def numeric_values(col: Column) -> Column:
    """Money, then percentages, then magnitudes, then bare numbers; each value once."""
    return F.array_distinct(
        F.concat(
            find_all(col, C.MONEY),
            find_all(col, C.PERCENT),
            find_all(col, C.MAGNITUDE, ignore_case=True),
            find_all(col, C.BARE_NUMBER),
        )
    )


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def term_count(col: Column, terms: Sequence[str]) -> Column:
    """Sum of the non-overlapping substring counts of all terms."""
    total = F.lit(0)
    for term in terms:
        gone = F.length(col) - F.length(F.replace(col, F.lit(term), F.lit("")))
        total = total + (gone / F.lit(len(term))).cast("long")
    return total.cast("long")


def json_text(col: Column) -> Column:
    """A JSON string literal for plain text (quotes, backslashes, line breaks)."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def truncate_ellipsis(col: Column, limit: int) -> Column:
    """Trimmed text; over the limit cut to ``limit - 1`` characters plus an ellipsis."""
    return F.when(col.isNull(), F.lit("N/A")).otherwise(
        let(
            strip(col),
            lambda s: F.when(F.length(s) <= limit, s).otherwise(
                F.concat(rstrip(F.substring(s, 1, limit - 1)), F.lit("…"))
            ),
        )
    )


def truncate_line(col: Column, limit: int = 200) -> Column:
    """Line breaks to spaces; over the limit cut to ``limit`` characters plus an ellipsis."""
    flat = F.replace(col, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit), F.lit("…"))
    )


def append_notice(col: Column, notice: str) -> Column:
    """Remove every copy of the notice, tidy the lines, then add it once at the end."""
    cleaned = F.replace(text_or_empty(col), F.lit(notice), F.lit(""))
    base = strip(F.array_join(F.transform(F.split(cleaned, LINE_BREAK), rstrip), "\n"))
    return let(
        base,
        lambda b: F.when(b == "", F.lit(notice)).otherwise(F.concat(b, F.lit("\n\n" + notice))),
    )
