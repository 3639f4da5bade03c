"""Tokenisation and lexical analysis as array expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .lexicon import LexiconProfile

WORD = "[A-Za-z0-9]+(?:[A-Za-z0-9&+/-]*[A-Za-z0-9])?"
CJK = "[一-鿿]"
COVERAGE_TERMS = 8


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def char_ngrams(joined: Column, n: int) -> Column:
    """The n-grams of a string; none if it is shorter."""
    return F.when(F.length(joined) >= n, F.transform(F.sequence(F.lit(1), F.length(joined) - n + 1), lambda i: F.substring(joined, i, F.lit(n)))).otherwise(_strings(()))


def bm25_tokens(c: Column) -> Column:
    """Lower-cased ASCII words, then CJK characters, then the 2- to 5-grams
    of the CJK characters run together (across punctuation)."""
    words = F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)
    joined = F.array_join(F.regexp_extract_all(c, F.lit(CJK), F.lit(0)), "")
    return F.concat(words, *(char_ngrams(joined, n) for n in range(1, 6)))


#: Signs within words, and the bytes of words in lower case, with a space for all others.
SIGNS = "&+/-"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b) in SIGNS or (b < 128 and chr(b).isalnum()) else 32 for b in range(256))
_CJK = re.compile(f"{CJK}+")


def bm25_words(text: str) -> list[str]:
    """bm25_tokens of one string. A word is a run of letters, digits and signs
    less the signs at its ends."""
    runs = text.encode("utf-8", "replace").translate(_LETTERS).decode("ascii")
    words = runs.split()
    if any(sign in runs for sign in SIGNS):
        words = [w for w in (r.strip(SIGNS) for r in words) if w]
    if text.isascii():
        return words
    joined = "".join(_CJK.findall(text))
    return words + [joined[i : i + n] for n in range(1, 6) for i in range(len(joined) - n + 1)]


def informative_chars(token: Column, lex: LexiconProfile) -> Column:
    weak = lex.weak_chars + lex.conservative_chars
    return F.length(F.translate(token, weak, "")) if weak else F.length(token)


def informative(token: Column, lex: LexiconProfile) -> Column:
    generic = token.isin(list(lex.generic_terms))
    return ~generic & (((F.length(token) >= 2) & token.rlike("^[A-Za-z0-9&+/-]+$")) | (informative_chars(token, lex) >= 2))


def query_tokens(tokens: Column, lex: LexiconProfile) -> Column:
    """Drop weak tokens; where fewer than two would stay, drop none."""
    signal = F.exists(tokens, lambda t: informative(t, lex))

    def stays(t: Column) -> Column:
        weak = t.isin([*lex.weak_terms, *lex.weak_chars])
        careful = t.isin([*lex.conservative_terms, *lex.conservative_chars])
        every = lex.weak_chars + lex.conservative_chars
        thin = (informative_chars(t, lex) < F.length(t)) & ~t.isin(list(lex.whitelisted)) & (informative_chars(t, lex) < 3) if every else F.lit(False)
        return ~weak & ~(signal & (careful | thin))

    kept = F.filter(tokens, stays)
    return F.when(F.size(kept) < 2, tokens).otherwise(kept)


def coverage_terms(tokens: Column, lex: LexiconProfile) -> Column:
    """Up to eight telling tokens of two to four characters, longest first,
    none inside one that is already taken."""
    weak = re.escape(lex.weak_chars + lex.conservative_chars)

    def trimmed(t: Column) -> Column:
        if not weak:
            return t
        return F.regexp_replace(F.regexp_replace(t, f"^[{weak}]+(?=.{{2}})", ""), f"(?<=.{{2}})[{weak}]+$", "")

    found = F.filter(F.transform(tokens, trimmed), lambda t: F.length(t).between(2, 4) & t.rlike("^[一-鿿A-Za-z0-9&+/-]+$") & informative(t, lex))
    ordered = F.array_sort(F.transform(F.array_distinct(found), lambda t, i: F.struct((-F.least(F.length(t), F.lit(5))).alias("a"), (-informative_chars(t, lex)).alias("b"), i.alias("i"), t.alias("t"))))

    def take(taken: Column, x: Column) -> Column:
        full = F.size(taken) >= COVERAGE_TERMS
        inside = F.exists(taken, lambda e: F.contains(e, x["t"]) & (F.length(x["t"]) < F.length(e)))
        return F.when(full | inside, taken).otherwise(F.concat(taken, F.array(x["t"])))

    return F.aggregate(ordered, _strings(()), take)


def keywords(question: Column, lex: LexiconProfile, common_first: bool = False) -> Column:
    """Words of a question without stopwords (longest first, then by code
    point, so that the result has one order), then CJK bigrams."""
    stop = sorted(lex.stopwords, key=lambda s: (-len(s), s))
    words = F.regexp_extract_all(question, F.lit("[一-鿿]{2,}|[A-Za-z0-9]{2,}"), F.lit(0))
    if common_first and stop:
        words = F.filter(words, lambda w: ~w.isin(stop))

    def reduced(w: Column) -> Column:
        for s in stop:
            w = F.replace(w, F.lit(s), F.lit(""))
        return w

    kept = F.array_distinct(F.filter(F.transform(words, reduced), lambda w: F.length(w) >= 2))
    if common_first and lex.common_terms:
        kept = F.array_union(T.contained(_strings(lex.common_terms), question), kept)
    long = F.filter(kept, lambda w: w.rlike("^[一-鿿]{4,}$"))
    pairs = F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    if stop:
        pairs = F.filter(pairs, lambda p: ~p.isin(stop))
    return F.array_union(kept, pairs)


def intents(question: Column, lex: LexiconProfile) -> dict[str, Column]:
    return {"operation": T.any_of(question, lex.operation_intent), "safety": T.any_of(question, lex.safety_intent), "fault": T.any_of(question, lex.fault_intent)}
