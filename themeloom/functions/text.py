"""Column expressions that turn document text into arrays of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JVM string trim removes, U+0000 to U+0020.
CONTROL_AND_SPACE = "".join(chr(code) for code in range(0x21))


def trim_control(text: Column) -> Column:
    """Remove control characters and spaces (code points up to U+0020) at both ends.

    A trim over a set of characters is linear in the text; an anchored regular
    expression would rescan every inner run of blanks.
    """
    return F.btrim(text, F.lit(CONTROL_AND_SPACE))


def split_words(
    text: Column,
    pattern: str = r"\s+",
    min_token_length: int = 1,
    to_lowercase: bool = True,
    gaps: bool = True,
) -> Column:
    """Array of tokens: text between matches of ``pattern``, or the matches themselves."""
    source = F.lower(text) if to_lowercase else text
    if gaps:
        words = F.split(source, pattern)
    else:
        words = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    if min_token_length <= 0:
        return words
    if min_token_length == 1:
        return F.array_remove(words, "")
    # Lengths are counted in UTF-16 units, as a JVM string does.
    return F.filter(
        words,
        lambda word: F.octet_length(F.encode(word, "UTF-16BE")) >= 2 * min_token_length,
    )


def split_lines(text: Column) -> Column:
    """Array of lines: inner empty lines stay, empty lines at the end go.

    An empty text is one empty line; a text of line breaks only has no line.
    """
    body = F.rtrim(text, F.lit("\n"))
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, "\n"))
    )
