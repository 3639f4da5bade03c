"""The operators on a small table of hard cases, against brute force."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import common, decontamination, graph, html_text, jaccard_join, language_id, lm_scoring, media, mixing, registry, secrets, sharding, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(7)
EN, DE = "the of and to in that with for".split(), "der die und den das mit auf ein".split()


def prose(n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "ing", "en", "a", "er"]) for _ in range(n))


BASE = prose(120, EN)
EDITED = BASE.split()
EDITED[50] = "changed"
LONG = prose(9000, EN)
ITEMS = [(0, prose(30, DE)), (1, prose(14, EN)), (2, None), (3, "too short"), (4, prose(30, DE))]


def leak(item, at):
    w = item.split()
    w[at] = "wrong"
    return prose(20, EN) + " " + " ".join(w) + " " + prose(20, EN)


ROWS = [
    (1, BASE, "en", "src1"), (2, BASE, "en", "src1"), (3, " ".join(EDITED), "en", "src2"), (3, " ".join(EDITED), "en", "src2"), (4, prose(100, DE), "de", "src3"),
    (5, None, "en", "src1"), (6, "", "en", None), (7, " \n\t ", None, "src1"), (8, "123 ... !", None, None), (9, LONG, "en", "src2"), (10, prose(60, DE), None, "src4"),
    (None, prose(50, EN), "en", "src1"), (11, "one two", "en", "src1"), (12, "one two", "en", "src5"), (13, leak(ITEMS[0][1], 5), "de", "src3"), (14, ITEMS[1][1].upper().replace(" ", " ! "), "en", "src1"),
    (15, 'x password: hunter22 Zk9qX2vTb7LmR4wYp1HsN8dCf3Gj', "en", "src1"), *((100 + i, prose(40 + i, EN if i % 2 else DE), "en" if i % 2 else "de", f"src{i % 6}") for i in range(40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'x' AS size", "1 AS shard", "2 AS score", "3 AS th", "4 AS k", "5 AS cid").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def crc(x):
    return binascii.crc32(str(x).encode())


def test_language(docs, empty):
    model = language_id.learned(docs.where(~language_id.held_out("doc_id")))
    rows = language_id.predicted(docs, model).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (5, 6, 7, 8))
    assert by[4].lang_pred == "de" and by[9].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    kept = language_id.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert language_id.predicted(empty, model).count() == 0 and language_id.learned(empty).langs == []


def test_toxicity(spark, docs, empty):
    bad = [(200 + i, prose(30, EN) + (" vile" if i % 3 == 0 else " vile rotten" if i % 3 == 1 else ""), i % 3 != 2) for i in range(150)]
    d = spark.createDataFrame([(a, b) for a, b, _ in bad], "doc_id long, text string")
    labels = spark.createDataFrame([(a, int(c)) for a, _, c in bad] + [(999, 1), (None, 1), (200, None)], "doc_id long, toxic int")
    model = toxicity.learned(d, labels)
    rows = {r.doc_id: r for r in toxicity.scored(d, model).collect()}
    assert all(rows[a].toxic == c for a, _, c in bad) and rows[201].severity > rows[202].severity
    assert toxicity.scored(docs, model).count() == len(ROWS) and toxicity.scored(empty, model).count() == 0
    none = toxicity.learned(docs, labels.where("false"))
    assert {r.severity for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>"), (None, None, None), (2, "u", ""), (2, "u", "<p>x")], "page_id long, url string, html string").selectExpr("*", "'c' AS text", "'d' AS both")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert len(got) == 4 and sum(r.n_chars for r in got) == 3 and all(r.text is not None for r in got)
    assert html_text.extract(pages.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.matches(docs, items).collect()}
    assert got[13, 0] == 1 and got[14, 1] == 0 and all(k in ((13, 0), (14, 1)) for k in got)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontamination.matches(empty, items).count() == 0 == decontamination.matches(docs, items.where("false")).count()


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "well, the Answer is forty-two they said"), (2, "the answer was forty two"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "answer is forty two"), (8, "..."), (9, "they"), (None, "answer")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance, r.n_words) for r in decontamination.matches(docs, items).collect()), key=str)
    assert got == sorted([(1, 7, 0, 4), (1, 9, 0, 1), (1, None, 0, 1), (2, None, 0, 1)], key=str)
    assert decontamination.clean(docs, items).count() == 3
    assert [r.doc_id for r in decontamination.clean(docs, items, min_words=4).collect()] == [2, 3]


def test_items_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.matches(docs, items).collect()))
    monkeypatch.setattr(decontamination, "ITEM_WORDS", 1)
    assert sorted(map(tuple, decontamination.matches(docs, items).collect())) == whole


def test_secrets_table(docs, empty):
    rows = secrets.scan_texts(docs).collect()
    assert len(rows) == len(ROWS) and secrets.scan_texts(empty).count() == 0
    r = next(r for r in rows if r.doc_id == 15)
    assert (r.n_assign, r.spans) == (1, "assign:2:20,entropy:21:49") and r.base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()


def test_media(spark):
    song = prose(90, EN)
    near = song.split()
    near[40] = "other"
    rows = [(50, song), (1, song), (2, "intro words here " + " ".join(near)), (3, prose(90, DE)), (4, None), (5, ""), (None, song), (100, "la la"), (6, "la la")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS cid", "2 AS prints")
    got = media.search(df, "id", "text").collect()
    members = [(r.id, r.class_id) for r in got if r.row == "member"]
    assert len(members) == len(rows) and (50, 1) in members and (None, 1) in members and (6, 6) in members and (4, None) in members
    match = [r for r in got if r.row == "match"]
    assert [(r.class_id, r.match_class_id, r.offset) for r in match] == [(1, 2, 3)] and 0 < match[0].error_rate < 0.1
    assert media.search(df.where("false"), "id", "text").count() == 0


def brute_mix(rows, plan):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(int)
    key = []
    for i, t, lang, source in rows:
        m = re.search(r"([0-9]+)$", source or "")
        k = (f"d{int(m[1]) % plan.domains}" if m else "d", lang or "", source or "")
        key.append(k)
        leaves[k] += words(t)
    weight = (plan.domain_weights, plan.lang_weights, plan.source_weights)

    def fill(names, w, c, budget):
        got, open_ = dict.fromkeys(names, 0), set(names)
        while True:
            left, total = budget - sum(got[n] for n in names if n not in open_), sum(w[n] for n in open_)
            full = {n for n in open_ if c[n] * total <= w[n] * left}
            if not full:
                break
            for n in full:
                got[n] = c[n]
            open_ -= full
        for n in open_:
            got[n] = w[n] * left // total
        for n in sorted(open_)[: left - sum(got[n] for n in open_)]:
            got[n] += 1
        return got

    def cap(prefix):
        return sum(t * plan.max_epochs for k, t in leaves.items() if k[: len(prefix)] == prefix)

    total = sum(leaves.values())
    level = {(): min(total * plan.max_epochs, total * plan.budget_percent // 100)}
    for depth in range(3):
        down = {}
        for parent, b in level.items():
            names = sorted({k[: depth + 1] for k in leaves if k[:depth] == parent})
            down |= fill(names, {n: weight[depth].get(n[-1], 1) for n in names}, {n: cap(n) for n in names}, b)
        level = down
    out = []
    for (i, t, *_), k in zip(rows, key, strict=True):
        n = leaves[k]
        if not n:
            out.append((i, 0))
            continue
        whole, rest = divmod(level[k], n)
        place = lambda j: int(hashlib.md5(":".join([str(plan.seed), str(whole), *([str(j)] if j is not None else [])]).encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        before = sum(words(u) for (j, u, *_), q in zip(rows, key, strict=True) if q == k and (place(j), j or -1, words(u)) <= (place(i), i or -1, words(t)))
        out.append((i, whole + (before <= rest)))
    return out, level


@pytest.mark.parametrize("plan", [mixing.MixPlan(), mixing.MixPlan(budget_percent=150), mixing.MixPlan(domain_weights={"d0": 50}, budget_percent=95, max_epochs=1), mixing.MixPlan(budget_percent=900)])
def test_mixing(docs, empty, plan):
    got = sorted(((r.doc_id, r.n) for r in mixing.mixed(docs, plan).selectExpr("row.doc_id", "copies AS n").collect()), key=str)
    assert got == sorted(brute_mix(ROWS, plan)[0], key=str)
    rows = mixing.mixed_documents(docs, plan)
    assert rows.columns == docs.columns and rows.count() == sum(n for _, n in got)
    assert mixing.mixed(empty, plan).count() == 0


def test_mixing_keeps_columns_whatever_their_names(spark):
    names = ["__domain", "__lang", "__source", "__tokens", "__epoch", "row", "copies", "budget"]
    d = spark.createDataFrame([(i, f"a b {i}", "en", "src1") for i in range(6)], "doc_id long, text string, lang string, source string")
    d = d.selectExpr("*", *[f"'mine {n}' AS `{n}`" for n in names])
    rows = mixing.mixed_documents(d, mixing.MixPlan(budget_percent=100)).collect()
    assert len(rows) == 6 and all(r[n] == f"mine {n}" for r in rows for n in names)


@pytest.mark.parametrize("capacity", [2_000, 5_000_000])
def test_fixed_capacity_is_kept(spark, capacity):
    sizes = [rng.randint(1, 1500) for _ in range(200)] if capacity == 2_000 else [rng.randint(100_000, 1_000_000) for _ in range(300)] + [6_000_000]
    groups = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "g string, n long")
    bins = defaultdict(list)
    for r in sharding.pack_groups(groups, "g", "n", capacity=capacity).collect():
        bins[r.shard].append(r.n)
    assert sorted(n for b in bins.values() for n in b) == sorted(sizes)
    assert all(sum(b) <= capacity or len(b) == 1 for b in bins.values())
    # against one-by-one packing of the exact sizes
    alone = []
    for n in sorted(sizes, reverse=True):
        fit = [b for b in alone if sum(b) + n <= capacity]
        min(fit, key=lambda b: capacity - sum(b)).append(n) if fit else alone.append([n])
    assert len(bins) <= len(alone) * 1.01 + 1


def test_shards_are_even(spark):
    rows = [(i, "x" * rng.randint(1, 4000)) for i in range(600)]
    sizes = Counter()
    for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 4000


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"bytes"}
    slots, group = defaultdict(list), defaultdict(set)
    text = {i: t for i, t, *_ in ROWS}
    for r in rows:
        slots[r.shard].append(r.slot)
        group[text[r.doc_id]].add(r.shard)
        assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == binascii.crc32((text[r.doc_id] or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in group.values()) and set(slots) <= set(range(8))
    assert sharding.shard_documents(empty).count() == 0


def brute_lm(rows):
    seqs = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for _, t, *_ in rows]
    held = [i is not None and crc(i) % 7 == 2 for i, *_ in rows]
    uni, bi, tri = Counter(), Counter(), Counter()
    for s, h in zip(seqs, held, strict=True):
        if not h:
            uni.update(s)
            bi.update(zip(s, s[1:], strict=False))
            tri.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(uni.values()), len(uni)
    z, d = n + v + 1, 0.75

    def shares(grams):
        total, kinds = Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        return lambda g, low: low if not total[g[:-1]] else max(grams[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * low

    two, three = shares(bi), shares(tri)
    out = {}
    for (i, *_), s in zip(rows, seqs, strict=True):
        base = [(uni[w] + 1) / z for w in s]
        p = list(base)
        for j in range(1, len(s)):
            p[j] = two((s[j - 1], s[j]), base[j])
            if j > 1:
                p[j] = three((s[j - 2], s[j - 1], s[j]), p[j])
        out[i] = (len(s), sum(uni[w] > 0 for w in s), n, sum(map(math.log10, base)), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("shards", [1, 12, 64])
def test_lm_scores(spark, docs, shards):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    path = f"{common.shared_dir(spark)}/lm-docs-{shards}"
    docs.select("doc_id", "text", "lang").coalesce(1).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    expected = brute_lm(ROWS)
    # with 64 shards most words are frequent enough to be dealt out, with one none is
    rows = lm_scoring.score_documents(table, held, shards=shards).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        n, known, total, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(r.score - score) < 2.5e-4 * n, (r.doc_id, r.score, score)
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 7 == 2)
    assert lm_scoring.score_documents(spark.read.parquet(path).where("doc_id = -1"), held, shards=shards).count() == 0


def test_lm_probabilities_match(monkeypatch):
    """Without spread words the trie gives the model's own probabilities."""
    import numpy as np

    from quillspark.llm.ngram_trie import NgramTrie, value_of

    w1 = np.array([5, 5, 5, 9], np.uint64)
    pair = np.array([(2 << 32) | 3, (2 << 32) | 4, (7 << 32) | 3, 1 << 32], np.uint64)
    trie = NgramTrie(w1, pair, np.array([2, 1, 1, 4]), {})
    n, left1, share2, left2, share3 = trie.query(np.array([5, 9, 11], np.uint64), np.array([0, 0, 1, 2]), np.array([2, 8, 1, 2], np.uint32), np.array([0, 0, 1, 3]), np.array([3, 9, 3, 3], np.uint32))
    assert n.tolist() == [4, 4, 0]
    assert np.allclose(value_of(left1), [0.75 * 2 / 4, 0.75 / 4, 1], rtol=1e-3)
    assert np.allclose(value_of(share2), [(3 - 0.75) / 4, 0, (4 - 0.75) / 4, 0], rtol=1e-3)
    assert np.allclose(value_of(left2), [0.75 * 2 / 3, 1, 1, 1], rtol=1e-3)
    assert np.allclose(value_of(share3), [(2 - 0.75) / 3, 0, 0, 0], rtol=1e-3)


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_join(docs, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect()), key=str)
    assert got == brute_components(ROWS)
    clash = docs.selectExpr("*", "'y' AS __text", "1 AS __k", "2 AS hashed")
    assert jaccard_join.one_of_each(clash).columns == clash.columns
    kept = jaccard_join.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(ids, key=str) == sorted({c for _, _, c in got}, key=str)
    assert jaccard_join.joined(empty).count() == 0 == jaccard_join.one_of_each(empty).count()


def test_components(spark):
    g = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 99), (7, 7)]
    links = spark.createDataFrame(g, "u long, v long")
    got = dict(map(tuple, graph.components(links).collect()))
    assert got == {**dict.fromkeys(range(1, 31), 0), 100: 99, 101: 99}
    assert graph.components(links.where("false")).count() == 0


def test_pipeline_and_registry(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in ROWS if r[0] is not None]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    rest = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    keep = {c for _, _, c in brute_components(rest)}
    seen, one = set(), []
    for r in rest:
        if r[0] in keep and r[0] not in seen and r[0] not in (13, 14):
            seen.add(r[0])
            one.append(r)
    expected = sorted(i for i, n in brute_mix(one, mixing.MixPlan())[0] for _ in range(n))
    assert got == expected and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "source_mixing", "sharding"]
    assert len(registry.QUERIES) == 13
