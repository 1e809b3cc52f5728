"""Analysis of text for search: lower-case words of letters and digits without stop words, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_TOKEN = r"([\p{L}\p{N}]+)"


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def tokens(text: Column) -> Column:
    """Analysed words in order; an empty array for null."""
    return F.filter(F.regexp_extract_all(folded(text), F.lit(_TOKEN), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def whole_words(words: list[str]) -> str:
    """A pattern that finds any of the analysed words as a token."""
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"


def analyse(text: str) -> list[str]:
    """The same for a query's words."""
    return [t for t in re.findall(r"[^\W_]+", text.lower()) if t not in STOP_WORDS]


def whitespace_tokens(text: Column) -> Column:
    """Plain split on blanks, tabs and line ends, case kept."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != "")


def wildcard_pattern(pattern: str) -> str:
    """``*`` and ``?`` as a regular expression for a whole token."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def highlight(text: Column, words: list[str], before: str = "<em>", after: str = "</em>", size: int = 200) -> Column:
    """A fragment of up to ``size`` characters around the first hit, hits marked; null without one."""
    if not words:
        return F.lit(None).cast("string")
    pattern = f"(?iu)({whole_words(sorted(words, key=len, reverse=True))})"
    at = F.char_length(F.split(text, pattern, 2)[0]) + 1  # counted in characters, as substring counts
    part = F.substring(text, F.greatest(F.lit(1), at - size // 4), F.lit(size))
    return F.when(text.rlike(pattern), F.regexp_replace(part, pattern, f"{before}$1{after}"))
