"""HTML to plain text.

``html_to_text`` stays inside the JVM and is what the extraction job uses.
``html_to_text_parsed`` runs a tolerant parser over Arrow batches, for pages
whose markup is too broken for patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.text import LINE_BREAK, RAGGED_WS, let, strip, text_or_empty
from filingloom.session import ship_package


def _code_point(number: Column) -> Column:
    """Character for a code point number; null when it is out of range."""
    ok = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_entities(col: Column) -> Column:
    """Resolve named and numeric character references; unknown ones stay as they are."""
    names = F.create_map(
        *[F.lit(v) for kv in sorted(name2codepoint.items()) for v in (kv[0], chr(kv[1]))],
        F.lit("apos"), F.lit("'"),
    )

    def resolve(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        dec = F.regexp_extract(part, r"^#0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(part, r"^#[xX]0*([0-9A-Fa-f]{1,6});", 1)
        char = (
            F.when(name != "", F.try_element_at(names, name))
            .when(dec != "", _code_point(dec.try_cast("long")))
            .when(hexa != "", _code_point(F.conv(hexa, 16, 10).try_cast("long")))
        )
        tail = F.substring(part, F.instr(part, ";") + 1, F.length(part))
        return F.coalesce(F.concat(char, tail), F.concat(F.lit("&"), part))

    def rebuild(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), resolve)
        return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))

    return F.when(~F.contains(col, F.lit("&")), col).otherwise(let(F.split(col, "&"), rebuild))


def tidy_lines(col: Column) -> Column:
    """One trimmed line per text block, inline whitespace collapsed, no blank lines."""
    lines = F.transform(
        F.split(col, LINE_BREAK), lambda x: strip(F.regexp_replace(x, RAGGED_WS, " "))
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# an element that is never closed runs to the end of the page
_HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_COMMENT = r"(?s)<!--.*?-->"
# a quoted attribute may contain '>'; a second look takes tags with unbalanced quotes
_TAG = r"<[!/?A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_LOOSE_TAG = r"<[!/?A-Za-z][^>]*>"


def html_to_text(col: Column) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags."""
    bare = text_or_empty(col)
    for pattern in (_HIDDEN, _COMMENT, _TAG, _LOOSE_TAG):
        bare = F.regexp_replace(bare, pattern, "\n")
    return tidy_lines(decode_entities(bare))


_UNFINISHED_NAME = re.compile(r"&(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))")


class _TextCollector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.blocks.append(data)


def _page_text(html: str | None) -> str:
    collector = _TextCollector()
    # a named reference needs its semicolon, as in the column form
    collector.feed(_UNFINISHED_NAME.sub("&amp;", html or ""))
    collector.close()
    lines = (" ".join(line.split()) for line in "\n".join(collector.blocks).splitlines())
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def _parse_pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(_page_text)


def html_to_text_parsed(col: Column) -> Column:
    """Parser form of :func:`html_to_text`, over Arrow batches."""
    ship_package(SparkSession.active())
    return _parse_pages(col)
