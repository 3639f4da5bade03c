"""Answers: evidence under a budget, prompts, generators, clean-up, quotes
and citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.lexicon import LexiconProfile

MAX_CONTEXTS, MAX_CHARS = 5, 6000
TRUNCATED = "[TRUNCATED]"
# The sentence of an answer without evidence, and the forms in
# which answers refer to evidence by its internal name.
NO_ANSWER = "我没有在手册中找到可靠依据"
REFERENCE = (
    r"(?:\[\s*evidence\s+e\d+\s*\]"
    r"|(?<![A-Za-z])evidence(?:\s+id)?\s+e\d+"
    r"|(?<![A-Za-z0-9])e\d+\s+evidence"
    r"|(?<![A-Za-z0-9])e\d+\s*证据"
    r"|证据\s*e\d+"
    r"|(?:手册片段|资料|片段|上下文|context|source\s+id)\s*\d+)"
)
AROUND = (r"(?:(?:根据|参考|参见|参照)\s*)?(?:[（(]\s*)?", r"(?:\s*[）)])?(?:\s*(?:中|里|内))?(?:\s*[,，:：]\s*)?")
RULES = (
    "Answer only from the evidence below; add nothing that it does not say.",
    f"If the evidence is not enough, say so: {NO_ANSWER}.",
    "Never leave out or soften warnings, bans, duties and conditions of safety.",
    "Where evidence differs by condition, give each case; where it conflicts, say that no one conclusion can be drawn.",
    "Where the question asks for a list and the evidence has one, follow its order and be complete.",
    "Address the reader directly; never mention evidence names; do not copy long passages.",
)


def evidence(hits: DataFrame, max_contexts: int = MAX_CONTEXTS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The chunks that go into each query's prompt, numbered from 1.

    Texts are taken whole while they fit together; the first that doesn't
    ends the list, but if it is the very first, it is cut and marked."""
    if max_contexts <= 0 or max_chars <= 0:
        return hits.where(F.lit(False)).withColumns({"order": F.lit(0), "evidence_id": F.lit(""), "content": F.col("text"), "truncated": F.lit(False), "original_text_chars": F.lit(0), "prompt_text_chars": F.lit(0)})
    per = Window.partitionBy("query_id").orderBy("pos")
    h = hits.withColumns({"order": F.row_number().over(per), "content": T.strip(F.col("text"))}).where(F.col("order") <= max_contexts)
    h = h.withColumn("so_far", F.sum(F.length("content")).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("so_far") <= max_chars
    room = max_chars - len(TRUNCATED) - 1
    short = F.lit(TRUNCATED[:max_chars]) if max_chars <= len(TRUNCATED) else F.concat(F.regexp_replace(F.substring("content", 1, max(room, 0)), r"(?U)\s+$", ""), F.lit("\n" + TRUNCATED))
    h = h.where(fits | (F.col("order") == 1)).withColumns({"truncated": ~fits, "original_text_chars": F.length("content"), "content": F.when(fits, F.col("content")).otherwise(short)})
    return h.withColumns({"evidence_id": F.concat(F.lit("E"), "order"), "prompt_text_chars": F.length("content")}).drop("so_far")


def heading_path() -> Column:
    names = F.filter(F.array(*(T.strip(F.col(c)) for c in ("chapter", "section", "subsection"))), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.nullif(F.array_join(names, " > "), F.lit("")), F.lit("N/A"))


def _shown(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A"))


def prompts(questions: DataFrame, chosen: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(query_id, question, prompt, n_evidence) of every question; without
    evidence the prompt says N/A."""
    block = F.concat_ws(
        "\n", F.concat(F.lit("[EVIDENCE "), "evidence_id", F.lit("]")), F.concat(F.lit("page: "), _shown("page")), F.concat(F.lit("chapter: "), _shown("chapter")), F.concat(F.lit("section: "), _shown("section")),
        F.concat(F.lit("subsection: "), _shown("subsection")), F.concat(F.lit("heading_path: "), heading_path()), F.concat(F.lit("content_type: "), F.coalesce("content_type", F.lit("normal"))), F.lit("content:"), "content",
        F.when(F.col("truncated"), F.lit("truncated: true")), F.lit("[/EVIDENCE]"),
    )
    context = chosen.select("query_id", F.struct("order", block.alias("t")).alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("query_id", F.array_join(F.col("x.t"), "\n\n").alias("context"), F.size("x").alias("n_evidence"))
    rows = questions.select("query_id", "question").join(context, "query_id", "left")
    head = "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))
    prompt = F.concat(F.lit(f"{head}\n\nEvidence:\n"), F.coalesce("context", F.lit("N/A")), F.lit("\n\nQuestion:\n"), "question", F.lit("\n\nAnswer:"))
    return rows.select("query_id", "question", prompt.alias("prompt"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def leaks_reference(c: Column) -> Column:
    return c.rlike(f"(?iuU){REFERENCE}")


def without_references(c: Column) -> Column:
    """Take out references to evidence and what they leave behind."""
    for pattern, to in ((f"(?iuU){AROUND[0]}{REFERENCE}{AROUND[1]}", ""), (r"(?U)^[\s,，:：;；]+", ""), (r"(?U)[（(]\s*[）)]", ""), (r"(?U)\s{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return T.strip(c)


# ------------------------------------------------------------------- quotes

LIST_ITEM = r"^\s*(?:■|-|•|\d+\.|（\d+）|[①②③④⑤⑥⑦⑧⑨⑩])"
# The marks that end a sentence, and the weights and lengths of a quote.
SENTENCE_ENDS = "。；！？"
LONG_WORD, SHORT_WORD, WHOLE_QUESTION, ACTION, TOO_SHORT = 2.0, 1.0, 4.0, 0.5, 1.0
MORE_AFTER, MORE_BEFORE, THIN, AT_SENTENCE, AT_SPACE = 40, 20, 0.7, 0.55, 0.75
QUOTE_CHARS = 220


def _last(c: Column, mark: str) -> Column:
    """Characters before the last occurrence of a mark; negative if none."""
    at = F.locate(mark, F.reverse(c))
    return F.when(at == 0, -1).otherwise(F.length(c) - at)


def shortened(c: Column, longest: int) -> Column:
    """Up to `longest` characters, ended after a sentence or at a space if
    one is near enough to the end."""
    c = T.squeeze(c)
    head = F.substring(c, 1, longest)
    ends = [(_last(head, m), AT_SENTENCE, 1) for m in SENTENCE_ENDS] + [(_last(head, " "), AT_SPACE, 0)]
    out = F.when(F.length(c) <= longest, c)
    for at, share, more in ends:
        out = out.when(at >= int(longest * share), T.strip(F.substring(head, F.lit(1), at + more)))
    return out.otherwise(T.strip(head))


def quoted(rows: DataFrame, lex: LexiconProfile, longest: int = QUOTE_CHARS, name: str = "quote") -> DataFrame:
    """Add the part of `text` that answers `question`.

    Sentences are weighed by the question's words; the best one (the first
    of equals) is the heart of the quote. Following sentences are added as
    long as they are list items or carry on an action, which one fold over
    them finds out; then the sentence before, if the quote is thin. Without
    a telling sentence, the text's head is the quote."""
    if longest <= 0:
        return rows.withColumn(name, F.lit(""))
    question, text = F.coalesce("question", F.lit("")), F.coalesce("text", F.lit(""))
    stop = sorted(lex.stopwords, key=lambda w: (-len(w), w))
    core = T.compact(question)
    for w in stop:
        core = F.replace(core, F.lit(w), F.lit(""))
    q = rows.withColumns({"__words": K.keywords(question, lex, common_first=True), "__core": F.when(F.length(core) >= 4, core), "__whole": T.squeeze(text)})
    sentences = F.filter(F.transform(F.split("__whole", f"(?<=[{SENTENCE_ENDS}])"), T.squeeze), lambda p: p != "")

    def told(p: Column) -> Column:
        met = T.contained(F.col("__words"), p)
        amount = F.aggregate(met, F.lit(0.0), lambda a, w: a + F.when(F.length(w) >= 4, LONG_WORD).otherwise(SHORT_WORD))
        acts = T.any_of(p, lex.action_terms)
        score = amount + F.when(F.coalesce(F.contains(p, F.col("__core")), F.lit(False)), WHOLE_QUESTION).otherwise(0.0) + F.when(acts, ACTION).otherwise(0.0)
        score = score - F.when((F.length(p) <= 8) & (F.size(met) == 0), TOO_SHORT).otherwise(0.0)
        return F.struct(p.alias("t"), F.length(p).alias("n"), F.when(F.length(p) < 4, -1.0).otherwise(score).alias("score"), p.rlike(LIST_ITEM).alias("item"), T.any_of(p, lex.leading_terms).alias("leads"), acts.alias("acts"))

    q = q.withColumn("__parts", F.transform(sentences, told))
    q = q.withColumn("__best", F.array_position(F.transform("__parts", lambda p: p["score"]), F.array_max(F.transform("__parts", lambda p: p["score"]))).cast("int"))
    heart, before = F.get("__parts", F.col("__best") - 1), F.get("__parts", F.col("__best") - 2)

    def more(a: Column, p: Column) -> Column:
        joins = a["open"] & (p["item"] | (a["going"] & (p["acts"] | p["leads"]))) & (a["size"] + 1 + p["n"] <= longest + MORE_AFTER)
        return F.struct(joins.alias("open"), (a["going"] | (joins & p["item"])).alias("going"), (a["size"] + F.when(joins, p["n"] + 1).otherwise(0)).alias("size"), (a["parts"] + joins.cast("int")).alias("parts"))

    start = F.struct(F.lit(True).alias("open"), heart["leads"].alias("going"), heart["n"].alias("size"), F.lit(1).alias("parts"))
    after = F.slice("__parts", F.col("__best") + 1, F.size("__parts"))
    q = q.withColumn("__run", F.when(F.col("__best") > 0, F.aggregate(after, start, more)))
    room = (F.col("__run.size") < longest * THIN) & (F.col("__run.size") + 1 + before["n"] <= longest + MORE_BEFORE)
    early = F.coalesce((before["leads"] | before["acts"]) & room, F.lit(False)).cast("int")
    chosen = F.array_join(F.transform(F.slice("__parts", F.col("__best") - early, F.col("__run.parts") + early), lambda p: p["t"]), " ")
    q = q.withColumn("__pick", F.when(heart["score"] > 0, chosen).otherwise(F.col("__whole")))
    return q.withColumn(name, shortened(F.col("__pick"), longest)).drop("__words", "__core", "__whole", "__parts", "__best", "__run", "__pick")


def citations(chosen: DataFrame, lex: LexiconProfile) -> DataFrame:
    """One row for each chunk that the prompt shows, with its quote."""
    q = quoted(chosen, lex)
    return q.select("query_id", F.col("order").alias("n"), *(c for c in ("source_file", "page", "chunk_id", "quote", "score", "distance", "chapter", "section", "subsection", "content_type", "risk_level", "selection_score", "is_expanded_neighbor", "retrieval_source", "dense_rank", "bm25_rank", "dense_score", "bm25_score", "rrf_score") if c in q.columns))


def extractive(questions: DataFrame, chosen: DataFrame, lex: LexiconProfile) -> DataFrame:
    """A generator without a model: the quotes of the evidence in order."""
    q = quoted(chosen, lex).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("order", "quote"))).alias("x"))
    return questions.select("query_id").join(q.select("query_id", F.array_join(F.col("x.quote"), "\n").alias("raw_answer")), "query_id", "left")


def generated(asked: DataFrame, generate: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Call a model on prompts in Arrow batches; questions without evidence
    are never sent."""
    call = F.pandas_udf("string")(lambda s: generate(s))
    with_evidence = asked.where("n_evidence > 0").withColumn("raw_answer", call("prompt"))
    return with_evidence.unionByName(asked.where("n_evidence = 0").withColumn("raw_answer", F.lit(None).cast("string")))


def finished(asked: DataFrame) -> DataFrame:
    """final_answer: the cleaned raw answer, or the fixed sentence."""
    raw = F.nullif(without_references(F.col("raw_answer")), F.lit(""))
    return asked.withColumn("final_answer", F.when(F.col("n_evidence") == 0, F.lit(NO_ANSWER)).otherwise(F.coalesce(raw, F.lit(NO_ANSWER))))
