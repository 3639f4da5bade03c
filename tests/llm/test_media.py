"""The search of fingerprints against all offsets of all pairs."""

import random

import numpy as np
import pytest

from quillspark.llm import media, registry

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def prints(text):
    return media.fingerprints(media.chroma_of_words(text))


def brute(a, b):
    """(rate, shift, offset, overlap) of the best offset, or None."""
    found = []
    for o in range(-len(a) + 1, len(b)):
        wrong, both = media.bit_errors(a, b, o)
        if both >= max(12, -(-min(len(a), len(b)) // 2)) and wrong <= 0.2 * 32 * both:
            found.append((wrong / (32 * both), abs(o), o, both))
    return min(found, default=None)


def test_a_short_recording_within_a_long_query():
    short = prose(60)
    a, b = prints(prose(90) + " " + short + " " + prose(40)), prints(short)
    assert media.best_offset(a, b) == (-90, len(b), 27) and brute(a, b)[2:] == (-90, len(b))


def test_recall_of_near_copies():
    noise, right, all_ = np.random.default_rng(0), 0, 0
    for n in (60, 150, 300):
        for _ in range(12):
            text = prose(n)
            w = text.split()
            for at in range(4, n, 8):  # hardly a window of eight words stays whole
                w[at] = rng.choice(VOCABULARY)
            flips = noise.random((n - 7, 32)) < rng.choice((0.05, 0.1, 0.15))
            flipped = prints(text) ^ np.packbits(flips).view(np.uint32)
            for other in (prints(prose(rng.randrange(9)) + " " + " ".join(w)), flipped, prints(prose(n))):
                best, got = brute(prints(text), other), media.Queries([0], [prints(text)]).matches(other).get(0)
                assert best is not None or got is None
                all_ += best is not None
                right += got is not None and (got[0], got[2]) == (best[0], best[2])
    assert all_ >= 40 and right >= 0.9 * all_


@pytest.mark.parametrize("n", [24, 40, 63, 64, 70, 80, 100, 200])
def test_recall_at_the_limit(n):
    """A fifth of all bits wrong, at random: nine of ten are found at their offset."""
    noise, found = np.random.default_rng(n), 0
    for _ in range(60):
        a = noise.integers(0, 1 << 32, n, dtype=np.uint32)
        wrong = np.zeros(32 * n, np.uint8)
        wrong[noise.choice(32 * n, int(0.2 * 32 * n), replace=False)] = 1
        b = np.concatenate([noise.integers(0, 1 << 32, 5, dtype=np.uint32), a ^ np.packbits(wrong).view(np.uint32)])
        hit = media.Queries([0], [a]).matches(b).get(0)
        found += hit is not None and hit[2] == 5
    assert found >= 54


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    song = prose(80)
    df = spark.createDataFrame([(0, song), (50, prose(20) + " " + song), (3, song + " end"), (4, prose(70)), (5, None)], "id long, text string")
    whole = sorted(map(tuple, media.search(df, "id", "text").collect()), key=str)
    assert {(r[2], r[3]) for r in whole if r[0] == "match"} == {(0, 50), (0, 3), (50, 0), (50, 3)}
    monkeypatch.setattr(media, "PRINTS", 1)
    assert sorted(map(tuple, media.search(df, "id", "text").collect()), key=str) == whole
    a, b = prints("la " * 40 + song), prints("la " * 50 + song)
    hits = [x.tolist() for x in media.Queries([0], [a]).hits(b)]
    monkeypatch.setattr(media, "HITS", 100)
    assert [x.tolist() for x in media.Queries([0], [a]).hits(b)] == hits


def test_counters_and_sorting_find_the_same(monkeypatch):
    noise = np.random.default_rng(8)
    songs = [noise.integers(0, 1 << 32, n, dtype=np.uint32) & np.uint32(0x0F0F0F1F) for n in (0, 12, 30, 79, 80, 150, 300, 0)]
    block = media.Queries(list(range(len(songs))), songs)
    for other in [*songs, np.concatenate([songs[4][10:], songs[1]])]:
        counted, best = [x.tolist() for x in block.hits(other)], block.matches(other)
        with monkeypatch.context() as m:
            m.setattr(media, "CELLS", 0)
            m.setattr(media.Queries, "counted", None)
            assert [x.tolist() for x in block.hits(other)] == counted and block.matches(other) == best


def test_recordings_together_match_as_each_alone(monkeypatch):
    noise = np.random.default_rng(9)
    songs = [noise.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 12, 30, 79, 80, 159, 160, 330, 700, 1400, 0)]
    others = [*songs, np.concatenate([songs[6][30:], songs[4]]), np.concatenate([songs[9][300:], songs[2]]), songs[10][::-1].copy(), songs[10][500:]]
    block = media.Queries(list(range(len(songs))), songs)
    want = [{i: brute(a, b) for i, a in enumerate(songs) if brute(a, b)} for b in others]
    together = block.matches_of(others)
    assert [{i: (x[0], x[1], x[2], x[4]) for i, x in m.items()} for m in together] == want
    assert [block.matches(b) for b in others] == together
    for m, b in zip(together, others, strict=True):
        for i, x in m.items():
            q, offset, votes = media.Queries([0], [songs[i]]).hits(b)
            assert x[3] == votes[offset == x[2]].tolist()[0]
    monkeypatch.setattr(media, "HITS", 20)
    assert block.matches_of(others) == together


@pytest.mark.parametrize("n", [160, 400, 900])
def test_recall_at_the_least_overlap(n):
    """A fifth of the bits of the half that is common wrong, with fewer fingerprints taken where more are common."""
    noise, found = np.random.default_rng(n), 0
    for _ in range(60):
        a = noise.integers(0, 1 << 32, n, dtype=np.uint32)
        wrong = np.zeros(16 * n, np.uint8)
        wrong[noise.choice(16 * n, int(0.2 * 16 * n), replace=False)] = 1
        b = np.concatenate([a[n // 2 :] ^ np.packbits(wrong).view(np.uint32), noise.integers(0, 1 << 32, n // 2, dtype=np.uint32)])
        hit = media.Queries([0], [a]).matches(b).get(0)
        found += hit is not None and hit[2] == -n // 2
    assert found >= 54


def test_long_recordings_meet_with_few_of_their_fingerprints():
    """All of them were held against all of a query's."""
    noise = np.random.default_rng(10)
    a, b = noise.integers(0, 1 << 8, (2, 1300), dtype=np.uint32)
    taken, whole = sum(len(x) for x, _ in media.Queries([0], [a]).met(b[:: media.step_of(1300)])), sum(len(x) for x, _ in media.Queries([0], [a]).met(b))
    assert media.step_of(1300) == 16 and taken * 12 < whole


def test_no_fingerprint_is_left_out():
    """Sub-keys meet in all fingerprints but each sixteenth, which were the only ones held against a query's."""
    noise = np.random.default_rng(11)
    a = noise.integers(0, 1 << 32, 1300, dtype=np.uint32)
    b = a.copy()
    b[:: media.step_of(1300)] ^= np.uint32(0x01010101)
    assert media.Queries([0], [a]).matches(b)[0][:3] == brute(a, b)[:3] == (4 * 82 / (32 * 1300), 0, 0)
    # and the same where the query is the recording of which some were taken
    assert media.Queries([0], [b]).matches(a)[0][2] == 0


def test_tables_of_a_part_of_the_queries(monkeypatch):
    noise = np.random.default_rng(12)
    songs = [noise.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 13, 90, 0, 400, 700, 200, 12000)]
    others = [songs[8][5000:5600], songs[6], np.concatenate([songs[3], songs[7][40:]]), songs[2], songs[0], songs[8]]
    block = media.Queries(list(range(len(songs))), songs)
    want = block.matches_of(others)
    assert [sorted(x) for x in want] == [[8], [6], [3, 7], [2], [], [8]]
    # more votes than 16 bits hold
    assert want[5][8][3] >= 72000 and max(block.hits(songs[8])[2]) == want[5][8][3]
    for cells in (3000, 15000):
        monkeypatch.setattr(media, "CELLS", cells)
        assert len(list(block.parts(700))) > 1 and block.matches_of(others) == want


def test_no_oracle_of_its_own():
    assert "op6_media_fingerprints" not in registry.ORACLES
