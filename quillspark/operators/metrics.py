"""Retrieval metrics of many cases at once, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K_VALUES = (1, 3, 5)


def evidence_hit() -> Column:
    """Whether a hit is evidence: by gold id where there are gold ids, else
    by quote, by section and term, by page and coverage, by type and term,
    or by coverage alone."""
    gold = F.filter("gold_ids", lambda g: F.coalesce(g, F.lit("")) != "")
    text = F.col("text")
    flat = T.compact(text)
    parts = F.flatten(F.transform("quotes", lambda q: F.concat(F.array(q), F.filter(F.split(q, "[。；;！!？?\n\r■□]"), lambda p: F.length(T.compact(p)) >= 8))))
    quoted = F.exists(parts, lambda p: (T.compact(p) != "") & F.contains(flat, T.compact(p)))
    found = F.size(T.contained(F.col("must_contain_terms"), text))
    share = F.when(F.size("must_contain_terms") == 0, 0.0).otherwise(found / F.size("must_contain_terms"))
    bare = (F.size("expected_pages") == 0) & (F.size("expected_sections") == 0) & (F.size("must_contain_terms") > 0)
    hit = (
        quoted
        | (section_hit(F.col("expected_sections")) & (found > 0))
        | (F.array_contains("expected_pages", F.col("page")) & (share >= 0.4))
        | (F.array_contains("expected_content_types", F.coalesce("content_type", F.lit(""))) & (found > 0))
        | (bare & (share >= 0.5))
    )
    return F.coalesce(F.when(F.size(gold) > 0, F.array_contains(gold, F.col("chunk_id"))).otherwise(hit), F.lit(False))


def section_hit(expected: Column) -> Column:
    s = F.coalesce("section", F.lit(""))
    return (s != "") & F.exists(expected, lambda e: F.contains(s, e) | F.contains(e, s))


def _crossing(pages: Column) -> Column:
    """How many rows have a text that stands on another page too."""
    return F.size(F.filter(pages, lambda x: (x["t"] != "") & F.exists(pages, lambda y: (y["t"] == x["t"]) & (y["p"] != x["p"]))))


def _met(terms: Column, found: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.array_contains(found, t)))


def by_case(hits: DataFrame, cases: DataFrame, top_k: int = 5, keys: tuple[str, ...] = ("case_id", "mode")) -> DataFrame:
    """One row of metrics for each case (and mode).

    `hits` has the keys, pos and the chunk's columns with its hygiene flags;
    `cases` has case_id and the expectations. A metric without an
    expectation is null and leaves the means."""
    rows = hits.where(F.col("pos") <= top_k).join(cases, "case_id")
    wanted = F.concat("expected_sections", "acceptable_sections")
    rows = rows.withColumns({
        "__e": evidence_hit(), "__page": F.array_contains("expected_pages", F.col("page")), "__sec": section_hit(F.col("expected_sections")), "__acc": section_hit(wanted),
        "__type": F.exists("expected_content_types", lambda t: F.lower(t) == F.lower(F.coalesce("content_type", F.lit("")))), "__bad": F.col("is_toc") | F.col("is_noise"), "__key": T.dedup_key(F.col("text")), "__terms": T.contained(F.col("must_contain_terms"), F.col("text")),
    })
    aggs: list[Column] = []
    ks = [k for k in K_VALUES if k <= top_k]
    for k in ks:
        top = F.col("pos") <= k

        def any_(c: str, expected: str | None, name: str, top=top, k=k) -> Column:
            hit = F.max(F.when(top, F.coalesce(F.col(c), F.lit(False))))
            return (hit if expected is None else F.when(F.max(F.size(expected)) > 0, hit)).alias(f"{name}@{k}")

        n = F.count(F.when(top, 1))
        terms = F.first("must_contain_terms")
        met = F.flatten(F.collect_list(F.when(top, F.col("__terms"))))
        found = F.size(F.array_intersect(terms, F.array_distinct(met)))
        unique_terms = F.size(terms)
        pages = F.collect_list(F.when(top, F.struct(F.col("__key").alias("t"), F.coalesce("page", F.lit(-1)).alias("p"))))
        crossing = _crossing(pages)
        aggs += [
            any_("__page", "expected_pages", "page_hit"), any_("__sec", "expected_sections", "expected_section_hit"),
            F.when(F.max(F.size(wanted)) > 0, F.max(F.when(top, F.col("__acc")))).alias(f"acceptable_section_hit@{k}"), any_("__type", "expected_content_types", "content_type_hit"),
            F.when(unique_terms > 0, found > 0).alias(f"any_term_hit@{k}"), F.when(unique_terms > 0, found == F.size(F.array_distinct(terms))).alias(f"all_terms_hit@{k}"),
            F.when(unique_terms > 0, _met(terms, met) / unique_terms).alias(f"term_coverage_ratio@{k}"),
            any_("__e", None, "evidence_hit"), F.coalesce(F.avg(F.when(top, F.col("__bad").cast("double"))), F.lit(0.0)).alias(f"noise_rate@{k}"),
            ((n - F.countDistinct(F.when(top, F.col("chunk_id")))) / n).alias(f"duplicate_chunk_id_rate@{k}"),
            ((n - F.countDistinct(F.when(top, F.struct("source_file", F.coalesce("page", F.lit(-1)), "__key")))) / n).alias(f"same_page_duplicate_rate@{k}"),
            (crossing / n).alias(f"cross_page_repeated_content_rate@{k}"),
        ]
    first = F.min(F.when(F.col("__e"), F.col("pos")))
    out = rows.groupBy(*keys).agg(*aggs, first.alias("first_evidence_hit_rank"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("retrieved_count"))
    k = min(top_k, 5)
    if k in ks:
        reasons = F.array_compact(F.array(F.when(~F.col(f"`evidence_hit@{k}`"), "no_evidence_hit"), F.when(F.col(f"`noise_rate@{k}`") > 0, "noise_in_top_k"), F.when(F.col(f"`duplicate_chunk_id_rate@{k}`") > 0, "duplicate_chunk_id"), F.when(F.col(f"`same_page_duplicate_rate@{k}`") > 0, "same_page_duplicate")))
    else:
        reasons = F.array().cast("array<string>")
    return out.withColumn("failure_reasons", reasons)


def aggregated(results: DataFrame, metrics: list[str], groups: tuple[str, ...] = ("mode", "category", "intent_type")) -> DataFrame:
    """Means over non-null values, for all cases and for each value of each
    group, in one pass of grouping sets."""
    named = [F.avg(F.col(f"`{m}`").cast("double")).alias(m) for m in metrics]
    sets = [[], *([F.col(g)] for g in groups)]
    out = results.groupingSets(sets, *map(F.col, groups)).agg(F.count(F.lit(1)).alias("case_count"), *named, F.grouping_id().alias("__g"))
    bit = {1 << (len(groups) - 1 - i): g for i, g in enumerate(groups)}
    everything = (1 << len(groups)) - 1
    kind, value = F.lit("overall"), F.lit(None).cast("string")
    for b, g in bit.items():
        kind = F.when(F.col("__g") == everything - b, g).otherwise(kind)
        value = F.when(F.col("__g") == everything - b, F.col(g)).otherwise(value)
    return out.select(kind.alias("group"), value.alias("value"), "case_count", *(F.col(f"`{m}`") for m in metrics))
