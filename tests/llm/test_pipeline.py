"""The stages of the pipeline against brute force."""

import random
import re

import corpus_pipeline

from quillspark.llm import decontamination, jaccard_join

rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(500)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = "other"
    return " ".join(w)


def components(rows, words, least, scale=100):
    """Component numbers by comparing all pairs; None for an empty text."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and scale * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stage_takes_five_words_and_four_fifths(spark):
    rows = []
    for n in (30, 45, 48, 49, 50, 51, 52, 60, 90):
        for places in ((), (n // 2,), (n // 3, 2 * n // 3), (n // 4, n // 2, 3 * n // 4)):
            if not places:
                base = prose(n)
            rows.append((len(rows), changed(base, *places)))
    rows += [(len(rows) + i, "one two three four" + " five" * (i % 2)) for i in range(4)]
    expected = {min(i for (i, _), c in zip(rows, components(rows, 5, 80), strict=True) if c == d) for d in components(rows, 5, 80)}
    assert len(set(components(rows, 4, 85))) != len(expected)  # the two measures differ here
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert sorted(got) == sorted(expected)


def hard_cases():
    one, two = prose(60), prose(60)
    rows = [(None, prose(40)) for _ in range(4)] + [(None, ""), (None, None), (None, " \n")]
    rows += [(None, one), (None, changed(one, 30)), (7, prose(50)), (7, prose(50)), (7, prose(50))]  # near copies; one id, three texts
    rows += [(8, two), (8, two), (8, changed(two, 30)), (9, two), (None, two)]  # one group: id 8 is left
    return rows


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rows = hard_cases()
    parts = components(rows, 5, 80)
    left = jaccard_join.one_of_each(table(spark, rows), measure=jaccard_join.PIPELINE).collect()
    got = [(r.doc_id, r.text) for r in left]
    assert len(got) == len(set(parts) - {None}) + parts.count(None)
    for part in set(parts) - {None}:
        mine = [r for r, p in zip(rows, parts, strict=True) if p == part]
        kept = [r for r in got if r in mine]
        assert len(kept) == 1 and kept[0][0] == min((i for i, _ in mine if i is not None), default=None)
    assert sum(not (t or "").strip() for _, t in got) == parts.count(None)


def test_documents_with_an_item_go_whatever_their_id(spark):
    item = prose(30)
    rows = [(None, prose(20) + " " + item), (None, prose(50)), (1, "x " + item), (1, prose(50)), (1, prose(50)), (2, None), (None, None), (None, "")]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = [(r.doc_id, r.text) for r in decontamination.clean(table(spark, rows), items).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
