"""Hygiene flags: tables of contents and noise, and filters by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LexiconProfile

# What a table of contents and a figure legend look like. Two
# characters stand for two or more before dots: every match ends with its own run of
# dots, so there are as many matches as with an open run, which would be
# tried from every character of a long line.
TOC_LINE = r"(?U)[一-鿿A-Za-z0-9（）()、/\s]{2}[\.·…]{3,}\s*\d{1,4}"
PAGE_LINE = r"(?U)[一-鿿A-Za-z0-9（）()、/]{2}\s+\d{1,4}$"
DOTS = r"[\.·…]{4,}"
DOT_RUN = r"[\.·•…]{5,}"
PAGE_REF = r"(?U)[\.·•…]{5,}\s*\d{1,4}"
TOC_ENTRY = r"(?U)[一-鿿A-Za-z0-9（）()/-]{2}\s*[\.·•…]{5,}\s*\d{1,4}"
LEGEND = r"(?U)^\s*(?:\d{2}|0\d|[①②③④⑤⑥⑦⑧⑨⑩])[\s：:、-]+"

REASONS = ("toc_dotted_fragment", "toc_page_refs", "toc_dotted_lines", "toc_heading", "toc_page_number_list", "empty_text", "generic_preface_notice", "too_short_generic_notice", "figure_legend_only")


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def toc_reason(text: Column, chapter: Column, section: Column, lex: LexiconProfile) -> Column:
    """Why a chunk counts as table of contents, or null."""
    rows = T.lines(text)
    # lines are looked at one by one only where the text has a line that may count
    toc_lines = F.when(text.rlike(r"[\.·…]{3,}"), F.size(F.filter(rows, lambda x: x.rlike(TOC_LINE)))).otherwise(0)
    page_lines = F.when(text.rlike(r"(?Um)\d\s*$"), F.size(F.filter(rows, lambda x: x.rlike(PAGE_LINE)))).otherwise(0)
    bare = _none(chapter) & _none(section)
    dots = F.regexp_count(text, F.lit(DOTS))
    headed = F.contains(F.substring(T.compact(text), 1, 80), F.lit(lex.toc_heading)) | F.coalesce(chapter == lex.toc_heading, F.lit(False)) | F.coalesce(section == lex.toc_heading, F.lit(False))
    reason = (
        F.when(bare & (F.regexp_count(text, F.lit(TOC_ENTRY)) >= 2), "toc_dotted_fragment")
        .when(bare & (F.regexp_count(text, F.lit(DOT_RUN)) >= 2) & (F.regexp_count(text, F.lit(PAGE_REF)) >= 2), "toc_page_refs")
        .when((toc_lines >= 3) | (dots >= 6), "toc_dotted_lines")
        .when(headed & ((toc_lines >= 1) | (page_lines >= 5) | (dots >= 2)), "toc_heading")
        .when(bare & (page_lines >= 8), "toc_page_number_list")
    )
    return F.when(T.compact(text) != "", reason)


def noise_reason(text: Column, chapter: Column, lex: LexiconProfile) -> Column:
    """Why a chunk counts as noise, or null. Real safety advice never does."""
    body = T.compact(text)
    size = F.length(body)
    entity = T.any_of(body, lex.entity_markers)
    preface = F.coalesce(chapter == lex.preface_chapter, F.lit(False)) if lex.preface_chapter else F.lit(False)
    bare = F.regexp_replace(body, "[：:。]+$", "")
    rows = F.filter(T.lines(text), lambda x: x != "")
    legends = F.when(text.rlike("(?m)" + LEGEND), F.size(F.filter(rows, lambda x: x.rlike(LEGEND)))).otherwise(0)
    real = T.any_of(body, lex.safety_markers) | (entity & T.any_of(body, lex.action_markers))
    return F.when(body == "", "empty_text").when(
        ~real,
        F.when(preface & (body.isin(list(lex.generic_notices)) | T.any_of(body, lex.preface_phrases) | (T.any_of(body, lex.notice_words) & T.any_of(body, lex.meaning_words) & ~entity)), "generic_preface_notice")
        .when((size <= 16) & bare.isin([x.rstrip("：:。") for x in lex.generic_notices]), "too_short_generic_notice")
        .when((size <= 28) & ~entity & T.any_of(body, lex.short_notice_words), "too_short_generic_notice")
        .when((legends >= 2) & F.size(rows).between(1, 8) & (legends >= F.size(rows) - 1) & ~T.any_of(body, lex.action_markers), "figure_legend_only"),
    )


def flagged(chunks: DataFrame, lex: LexiconProfile) -> DataFrame:
    """`chunks` with is_toc, is_noise and filter_reason (contents first)."""
    toc = toc_reason(F.col("text"), F.col("chapter"), F.col("section"), lex)
    noise = noise_reason(F.col("text"), F.col("chapter"), lex)
    out = chunks.withColumns({"__toc": toc, "__noise": noise})
    return out.withColumns({"is_toc": F.col("__toc").isNotNull(), "is_noise": F.col("__noise").isNotNull(), "filter_reason": F.coalesce("__toc", "__noise", F.lit(""))}).drop("__toc", "__noise")


def kept(flags: DataFrame, remove_toc: bool = True, remove_noise: bool = True) -> DataFrame:
    out = flags.where(~F.col("is_toc")) if remove_toc else flags
    return out.where(~F.col("is_noise")) if remove_noise else out


def summary(flags: DataFrame) -> DataFrame:
    """One row for each reason (empty: kept), with its count."""
    return flags.groupBy("filter_reason").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("is_toc").cast("long")).alias("removed_toc"), F.sum((F.col("is_noise") & ~F.col("is_toc")).cast("long")).alias("removed_noise"))
