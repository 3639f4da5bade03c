"""Text expressions. Java's \\s, \\w and \\W are made Unicode-aware by (?U)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that end a line; a pair of \r and \n is one end.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: One class first, so that a search passes over other characters by one test.
LINE_BREAK = f"[{BREAKS}](?:(?<=\r)\n)?"
#: What (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, which alone are looked at."""
    return F.btrim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """One kind of line break, no runs of blanks or of empty lines."""
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


# Fixed values in the two keys below: the patterns that are taken out, in this order.
def dedup_key(c: Column) -> Column:
    """The hygiene key: no white space, page numbers, bullets or marks."""
    for pattern in (r"(?U)\s+", r"(?U)^\d{1,4}|\d{1,4}$", r"[■•\-①②③④⑤⑥⑦⑧⑨⑩]", r"(?U)（\d+）|\d+\.", r"[，,。；;：:！？!?.、（）()\[\]【】《》\"'“”‘’]+"):
        c = F.regexp_replace(c, pattern, "")
    return c


def context_key(c: Column) -> Column:
    """The context key: no white space, bullets or item numbers."""
    for pattern in (r"(?U)\s+", r"[■•\-①②③④⑤⑥⑦⑧⑨⑩]", r"(?U)（\d+）|\d+\."):
        c = F.regexp_replace(c, pattern, "")
    return c


def lines(c: Column) -> Column:
    """Stripped lines; a closing line break opens no line."""
    parts = held(F.split(c, LINE_BREAK, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    return F.transform(parts, strip)


def first_line(c: Column) -> Column:
    """The first line that says something, stripped; "" if none does."""
    c = F.ltrim(c, F.lit(SPACES + BREAKS))
    for end in BREAKS:  # a search for a character is much faster than a pattern's
        c = F.substring_index(c, end, 1)
    return F.rtrim(c, F.lit(SPACES))


def held(c: Column, use) -> Column:
    """use(c), with c evaluated once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


#: Terms beyond which one pattern is tried instead of each term, as generated code has a bound.
MANY_TERMS = 7


def one_of(terms: Iterable[str]) -> str:
    """A pattern for any of the terms as they are."""
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")"


def any_of(c: Column, terms: Iterable[str]) -> Column:
    """Whether c contains one of the terms."""
    terms = tuple(terms)
    if len(terms) > MANY_TERMS:
        return c.rlike(one_of(terms))
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms), F.lit(False))


def count_of(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms c contains."""
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(t)).cast("int") for t in terms), F.lit(0))


def contained(needles: Column, c: Column) -> Column:
    """The elements of an array that c contains."""
    return F.filter(needles, lambda x: (x != "") & F.contains(c, x))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def answer_key(c: Column) -> Column:
    """The form in which answers and terms are compared. Spark has no NFKC
    or case folding, so that step is an Arrow UDF."""
    c = F.regexp_replace(_folded(c), r"(?U)(\d+(?:\.\d+)?)\s*(?:厘米|cm)(?![a-z])", "$1cm")
    c = F.regexp_replace(c, r"[，,。；;：:！？!?、（）()\[\]【】“”\"'‘’]+", "")
    return compact(c)


def folded(text: str) -> str:
    """answer_key of one string."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = re.sub(r"(\d+(?:\.\d+)?)\s*(?:厘米|cm)(?![a-z])", r"\1cm", t)
    return re.sub(r"[，,。；;：:！？!?、（）()\[\]【】“”\"'‘’]+|\s+", "", t)
