"""Recovery of a manual's structure: lines, headings, blocks, types, risk.

The reader goes through a source's lines in order. Its state is expressed by
windows over (source_file, page, line): headings carry on by the last
non-null value of their scope, a block opens at a heading and at most
markers, and the one data-dependent rule (a bare marker waits for the next
line, so every second of a run of bare markers opens a block) is the parity
of the run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import LexiconProfile

ITEM = r"(?:■|-|•|\d+\.|（\d+）|[①②③④⑤⑥⑦⑧⑨⑩])"
STEP = r"(?:\d+\.?|\d+\s|（\d+）|[①②③④⑤⑥⑦⑧⑨⑩])"
SKIP_TOC_PAGES = 12
LEAST_BLOCK = 4


def _all(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _starts(c: Column, prefixes) -> Column:
    if len(prefixes) > T.MANY_TERMS:
        return c.rlike("^" + T.one_of(prefixes))
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in prefixes), F.lit(False))


def _ends(c: Column, suffixes) -> Column:
    if len(suffixes) > T.MANY_TERMS:
        return c.rlike(T.one_of(suffixes) + "\\z")
    return reduce(lambda a, b: a | b, (F.endswith(c, F.lit(s)) for s in suffixes), F.lit(False))


def marker(c: Column, word: str) -> Column:
    """Whether a line opens a warning, caution or note."""
    if not word:
        return F.lit(False)
    return F.startswith(c, F.lit(word + "！")) | (c == word) | F.startswith(c, F.lit(word + " "))


def any_marker(c: Column, lex: LexiconProfile) -> Column:
    return marker(c, lex.warning) | marker(c, lex.caution) | marker(c, lex.note)


def list_item(c: Column) -> Column:
    """Whether a line of the text begins like an item of a list. The first
    line and those after a line feed have patterns of their own: a search for
    either is much faster than one for a choice of both."""
    return c.rlike(rf"(?U)^\s*{ITEM}") | c.rlike(rf"(?U)\n\s*{ITEM}")


def steps(c: Column) -> Column:
    """How many lines begin like a step."""
    c = F.ltrim(c, F.lit(T.SPACES))
    return c.rlike(f"(?U)^{STEP}").cast("int") + F.regexp_count(c, F.lit(rf"(?U)\n\s*{STEP}"))


def is_procedure(c: Column, lex: LexiconProfile) -> Column:
    verbs = T.count_of(c, lex.operation_verbs)
    return T.any_of(c, lex.procedure_phrases) | (verbs >= 2) | (steps(c) >= 2) | (list_item(c) & (verbs >= 1))


def content_type(c: Column, lex: LexiconProfile) -> Column:
    # a text of white space and line breaks has no marker, so that its first line may be ""
    named = T.held(T.first_line(c), lambda first: F.when(~T.any_of(first, lex.warning_light) & marker(first, lex.warning), "warning").when(marker(first, lex.caution), "caution").when(marker(first, lex.note), "note"))
    return F.coalesce(named, F.when(is_procedure(c, lex), "procedure").otherwise("normal"))


def risk_level(c: Column, kind: Column, lex: LexiconProfile) -> Column:
    medium = T.any_of(c, lex.medium_risk)
    light = T.any_of(c, lex.warning_light)
    return F.when(kind == "warning", "high").when(light & medium, "medium").when(light, "low").when(T.any_of(c, lex.high_risk), "high").when((kind == "caution") | medium, "medium").otherwise("low")


def _cjk(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[一-鿿]"))


def _body_text(c: Column, lex: LexiconProfile) -> Column:
    return c.rlike("[。；，、！？.;,]$") | (c.rlike("[：:]$") & T.any_of(c, lex.list_intro))


def _step_like(c: Column, lex: LexiconProfile) -> Column:
    return c.rlike(r"(?U)^\d{1,3}") & T.any_of(c, lex.operation_verbs)


#: White space of RE2's \\s and of DuckDB's trim, for lines that are read as plain SQL reads them.
PLAIN_SPACES = "\t\n\f\r "
PLAIN_BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plain_squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"[{PLAIN_SPACES}]+", " ")


def plain_noise_line(c: Column) -> Column:
    """noise_line of ASCII digits and white space."""
    number, contents = c.rlike(r"^[0-9]{1,4}\z"), c.rlike(r"[\.·•…]{5,}") & c.rlike(rf"[0-9]{{1,4}}[{PLAIN_SPACES}]*\z")
    # the one other letter whose lower case is a letter of these
    return number | contents | F.lower(F.translate(c, "İ", "i")).isin("copyright", "all rights reserved")


def plain_list_item(c: Column) -> Column:
    """list_item of ASCII digits and white space, of one line."""
    return c.rlike(rf"^[{PLAIN_SPACES}]*{ITEM}")


def noise_line(c: Column, lex: LexiconProfile) -> Column:
    """Whether a line is noise on every page. Its length comes first where that says it."""
    number = (F.length(c) <= 5) & c.rlike(r"(?U)^\d{1,4}$")
    contents = c.rlike(r"[\.·•…]{5,}") & c.rlike(r"(?U)\d{1,4}\s*$")
    return number | F.when(F.length(c).isin(9, 19), F.lower(c).isin("copyright", "all rights reserved")).otherwise(F.lit(False)) | contents


def subsection_heading(c: Column, following: Column, lex: LexiconProfile) -> Column:
    """Whether a line reads like a heading of the lowest level, given the next
    line that says something on its page (null at the end of the page)."""
    latin = c.rlike("[A-Za-z0-9]")
    acts, titled = _starts(c, lex.action_prefixes), _ends(c, lex.title_suffixes)
    refused = c.isin([*lex.reject_titles, *lex.chapters, *lex.sections]) | any_marker(c, lex) | list_item(c) | _step_like(c, lex)
    fragment = (latin & (_cjk(c) <= 3)) | c.rlike(r"(?U)^[\W_]+$")
    telling = ~(acts & (_cjk(c) <= 18)) & T.any_of(c, lex.reject_terms)
    shaped = ~_body_text(c, lex) & ~fragment & ~telling & ~c.rlike("[，、；。：:,;.!！]") & _cjk(c).between(2, 18)
    n = T.squeeze(following)
    led = any_marker(n, lex) | list_item(n) | _body_text(n, lex) | _step_like(n, lex) | T.any_of(n, lex.body_tone) | T.any_of(n, lex.operation_verbs) | (_cjk(n) >= 8)
    noun = ~latin & ~T.any_of(c, lex.body_tone) & ~T.any_of(c, lex.operation_verbs)
    reads = shaped & F.when(F.coalesce(following, F.lit("")) == "", ~latin & (acts | titled)).otherwise(led & (acts | titled | noun))
    # most lines are too long for a heading, and are not looked at further
    return F.when(c.isin(list(lex.subsections)), ~refused).when(F.length(c) <= 24, ~refused & reads).otherwise(F.lit(False))


def line_kind(head: Column, noise: Column, skips: Column, item: Column, subsection: Column, lex: LexiconProfile) -> Column:
    """The kind of a line, by what is known of its head."""
    open_ = ~skips
    return (
        F.when(head == "", "blank").when(noise | (skips & head.isin([*lex.chapters, *lex.toc_titles])), "noise")
        .when(open_ & head.isin(list(lex.chapters)), "chapter").when(open_ & head.isin(list(lex.sections)), "section")
        .when(marker(head, lex.warning), "warning_marker").when(marker(head, lex.caution), "caution_marker").when(marker(head, lex.note), "note_marker")
        .when(item, "list_item").when(open_ & subsection, "subsection").otherwise("body")
    )


def plain_lines(pages: DataFrame, lex: LexiconProfile, cut: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, source_file, page, n, head, kind) of every line of pages, as
    plain SQL tells them: `cut` gives the heads of a text's lines, digits and
    white space are ASCII, no page is one of contents, and of the lowest
    headings there are the listed ones."""
    rows = pages.select("doc_id", "source_file", "page", F.posexplode(cut(F.col("text"))).alias("n", "head"))
    head = F.col("head")
    return rows.withColumn("kind", line_kind(head, plain_noise_line(head), F.lit(False), plain_list_item(head), head.isin(list(lex.subsections)), lex))


def classified_lines(pages: DataFrame, lex: LexiconProfile, skip_toc_pages: int = SKIP_TOC_PAGES) -> DataFrame:
    """(doc_id, source_file, page, n, line, kind) of every line of pages
    (doc_id, source_file, page, text)."""
    # lines find the next one that says something within their page's array, so that this is a map over pages, also of a stream
    held = pages.select("doc_id", "source_file", "page", "text", F.transform(T.lines(F.col("text")), lambda x: F.struct(x.alias("line"), T.squeeze(x).alias("head"))).alias("held"))
    dotted = F.size(F.filter("held", lambda x: F.contains(x["line"], F.lit("...")) | F.contains(x["line"], F.lit("……"))))
    skips = (F.col("page") <= skip_toc_pages) & ((dotted >= 3) | (T.count_of(F.col("text"), lex.chapters) >= 4) | (F.contains(F.col("text"), F.lit(lex.toc_heading)) if lex.toc_heading else F.lit(False)))
    held = held.select("doc_id", "source_file", "page", skips.alias("skips"), F.transform("held", lambda x: F.struct(x["line"], x["head"], noise_line(x["head"], lex).alias("noise"))).alias("held"))
    says = F.transform("held", lambda x: F.when((x["head"] != "") & ~x["noise"], "1").otherwise("0"))
    held = held.withColumn("says", F.array_join(says, ""))
    nth = lambda i: F.call_function("locate", F.lit("1"), F.col("says"), i + 2)
    rows = held.select("doc_id", "source_file", "page", "skips", F.posexplode(F.transform("held", lambda x, i: F.struct(x["line"], x["head"], x["noise"], F.get(F.col("held"), nth(i) - 1)["line"].alias("following")))).alias("n", "at"))
    rows = rows.select("doc_id", "source_file", "page", "skips", "n", "at.line", "at.head", "at.noise", "at.following")
    head = F.col("head")
    kind = line_kind(head, F.col("noise"), F.col("skips"), list_item(head), subsection_heading(head, F.col("following"), lex), lex)
    return rows.withColumn("kind", kind).drop("skips", "noise", "following")


def blocks(lines: DataFrame, lex: LexiconProfile) -> DataFrame:
    """Logical blocks of classified lines, one row each."""
    order = ["page", "doc_id", "n"]
    src = Window.partitionBy("source_file").orderBy(*order)
    before = src.rowsBetween(Window.unboundedPreceding, -1)
    upto = src.rowsBetween(Window.unboundedPreceding, 0)
    x = lines.where(~F.col("kind").isin("blank", "noise"))
    chapter = F.when(F.col("kind") == "chapter", F.col("head"))
    x = x.withColumn("was", F.last(chapter, ignorenulls=True).over(before))
    # a chapter's title again is a running header
    x = x.where((F.col("kind") != "chapter") | F.col("was").isNull() | (F.col("was") != F.col("head"))).drop("was")
    x = x.withColumns({"chapter": F.last(chapter, ignorenulls=True).over(upto), "c": F.sum((F.col("kind") == "chapter").cast("int")).over(upto)})
    in_chapter = Window.partitionBy("source_file", "c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"section": F.last(F.when(F.col("kind") == "section", F.col("head")), ignorenulls=True).over(in_chapter), "s": F.sum((F.col("kind") == "section").cast("int")).over(in_chapter)})
    in_section = Window.partitionBy("source_file", "c", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"subsection": F.last(F.when(F.col("kind") == "subsection", F.col("head")), ignorenulls=True).over(in_section), "u": F.sum((F.col("kind") == "subsection").cast("int")).over(in_section)})
    x = x.where(~F.col("kind").isin("chapter", "section", "subsection"))
    marks = F.col("kind").endswith("_marker")
    said = F.when(marks, F.col("head")).otherwise(F.col("line"))
    words = [w for w in (lex.warning, lex.caution, lex.note) if w]
    bare = marks & said.isin([*words, *(w + "！" for w in words)])
    part = Window.partitionBy("source_file", "c", "s", "u").orderBy(*order)
    x = x.withColumns({"said": said, "bare": bare, "marks": marks, "at": F.row_number().over(part)})
    run = F.col("at") - 1 - F.coalesce(F.max(F.when(~F.col("bare"), F.col("at"))).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("opens", ((F.col("at") == 1) | (F.col("marks") & (run % 2 == 0))).cast("int"))
    x = x.withColumn("b", F.sum("opens").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("page", "doc_id", "n", "said")
    made = x.groupBy("source_file", "c", "s", "u", "b").agg(F.array_sort(F.collect_list(item)).alias("x"), F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.first("subsection").alias("subsection"))
    nth = Window.partitionBy("source_file").orderBy("c", "s", "u", "b")
    return finished(assembled(made).withColumn("block_index", F.row_number().over(nth) - 1).drop("c", "s", "u", "b"), lex)


def assembled(made: DataFrame) -> DataFrame:
    """Blocks with their lines `x` in order: `raw` text, pages and document; too short ones go."""
    raw = T.strip(F.array_join(F.col("x.said"), "\n"))
    made = made.withColumns({"raw": raw, "start_page": F.col("x")[0]["page"], "end_page": F.element_at("x", -1)["page"], "doc_id": F.col("x")[0]["doc_id"]})
    return made.where(F.length("raw") >= LEAST_BLOCK).drop("x")


def finished(made: DataFrame, lex: LexiconProfile) -> DataFrame:
    """Blocks with text, type, risk, flags and name."""
    text = F.when(F.col("subsection").isNotNull() & ~F.startswith("raw", "subsection"), F.concat("subsection", F.lit("\n"), "raw")).otherwise(F.col("raw"))
    made = made.withColumns({"text": text, "content_type": content_type(F.col("raw"), lex)}).withColumn("risk_level", risk_level(F.col("raw"), F.col("content_type"), lex))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("block_index").cast("string"), F.substring("text", 1, 40))
    contains = {f"has_{k}": F.contains("raw", F.lit(w)) if w else F.lit(False) for k, w in (("warning", lex.warning), ("caution", lex.caution), ("note", lex.note))}
    return made.withColumns({
        "block_id": T.uuid5(name), "heading_path": F.array_compact(F.array("chapter", "section", "subsection")), **contains, "is_procedure": is_procedure(F.col("raw"), lex),
        "source_pages": F.when(F.col("end_page") >= F.col("start_page"), F.sequence("start_page", "end_page")).otherwise(F.array("start_page")),
    }).drop("raw")
