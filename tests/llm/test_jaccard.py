"""The n-gram Jaccard join against all pairs of documents."""

import random
from collections import Counter

import numpy as np
import pytest

from marketgrain.llm import jaccard
from tests.llm.cases import documents, texts
from tests.llm.test_operators import words_of


def folded(text):
    return words_of((text or "").encode().lower().decode())


def shingles(text, size=5):
    w = folded(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked(x, y, percent=80):
    return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)


def plain(rows, size=5, percent=80):
    """``doc_id, n_shingles, component_id, n_links`` of every row."""
    sets, label = [shingles(x, size) for _, x in rows], list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if linked(sets[a], sets[b], percent):
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return Counter((i, len(s), least.get(g), n) for (i, _), s, g, n in zip(rows, sets, label, links))


def near_copies(seed, groups=40, longest=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstn") for _ in range(5))
    common, found = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((1, 4, 5, 6, 9, 20, 60, 150, longest)))] + common * (rng.random() < 0.5)
        found.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            copy = copy[rng.randrange(2) :] + [word()] * rng.randrange(3)
            found.append(rng.choice((" ", "  ", "\n")).join(copy).upper())
    found += ["", None, "one two", "One Two", "one two three", found[3], " \n"]
    rng.shuffle(found)
    return [(None if rng.random() < 0.05 else k, x) for k, x in enumerate(found)]


def got(docs, **options):
    found = jaccard.similar_documents(docs, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return Counter(tuple(r) for r in found.collect())


SMALL = {"shard_bytes": 3_000, "slot_bytes": 5_000, "block_sets": 3}


@pytest.mark.parametrize("options", [{}, SMALL])
def test_equals_all_pairs(spark, monkeypatch, options):
    rows = near_copies(12)
    assert got(documents(spark, rows), **options) == plain(rows)


@pytest.mark.parametrize(("size", "percent"), [(2, 50), (3, 90), (1, 100), (5, 67)])
def test_other_sizes_and_limits(spark, size, percent):
    rows = near_copies(5, groups=20, longest=90)
    assert got(documents(spark, rows), size=size, percent=percent, **SMALL) == plain(rows, size, percent)


def test_hard_documents(spark):
    assert got(documents(spark)) == plain(texts())


def test_a_large_group_of_different_copies(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = []
    for k in range(150):  # a chain: neighbours are close, the ends are not
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(base)))
    want = plain(rows)
    assert len({c for _, _, c, _ in want}) < 10 and max(n for *_, n in want) > 10
    assert got(documents(spark, rows), block_sets=16) == want


def test_all_pairs_are_listed_once(spark):
    rows = near_copies(7)
    members, links = jaccard.links(documents(spark, rows), **SMALL)
    of = {r.doc_id: r.node for r in members.collect() if r.doc_id is not None}
    sets = {of[i]: shingles(x) for i, x in rows if i is not None}
    known = {r.node for r in members.collect()} - set(sets)
    found = [(r.a, r.b, r.overlap) for r in links.collect() if r.a not in known and r.b not in known]
    assert len({frozenset(p[:2]) for p in found}) == len(found)
    want = {frozenset((a, b)): len(x & y) for a, x in sets.items() for b, y in sets.items() if a != b and linked(x, y)}
    assert {frozenset((a, b)): n for a, b, n in found} == want


def test_filters_lose_no_pair(monkeypatch):
    """Candidates of a tile, listed a few entries at a time, hold every linked pair once."""
    monkeypatch.setattr(jaccard, "_LISTED", 3)
    rng = np.random.default_rng(4)
    sets = [rng.choice(60, rng.integers(1, 50), replace=False) for _ in range(12)]
    sets += [np.unique(np.where(rng.random(len(s)) < 0.04, rng.integers(60, 90, len(s)), s)) for s in sets for _ in range(4)]
    times = Counter(int(t) for s in sets for t in s)
    sets = [
        (np.array(sorted((int(t) for t in s if times[int(t)] > 1), key=lambda t: (times[t], t)), np.int64), len(s)) for s in sets
    ]
    sets = sorted((s for s in sets if len(s[0]) >= s[1] - jaccard.missing(s[1]) and len(s[0])), key=lambda s: s[1])
    rank = {t: k for k, t in enumerate(sorted(times, key=lambda t: (times[t], t)))}
    flat = np.concatenate([[rank[int(t)] for t in s] for s, _ in sets]).astype(np.int64)
    n = np.array([k for _, k in sets])
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in sets])]).astype(np.int64)
    tile = jaccard.TileSets(np.arange(len(n)), np.arange(len(n)) % 2, n, n - np.diff(starts), np.ones(len(n), np.int64), flat, starts)
    for between in (False, True):
        pairs = [p for x, y in jaccard._candidates(tile, between, 80) for p in zip(x.tolist(), y.tolist())]
        assert len(set(pairs)) == len(pairs)
        need = set()
        for x in range(len(n)):
            for y in range(x):
                both = len(np.intersect1d(sets[x][0], sets[y][0]))
                if 180 * both >= 80 * (n[x] + n[y]) and (not between or (x - y) % 2):
                    need.add((x, y))
        assert need and need <= set(pairs)
        verified = [p for x, y in jaccard._candidates(tile, between, 80) for p in zip(*jaccard._verified(tile, x, y, 80)[:2])]
        assert {(int(a), int(b)) for a, b in verified} == need


def test_no_documents(spark):
    assert got(documents(spark, [])) == Counter()
    assert got(documents(spark, [(1, None), (None, ""), (1, " \n")])) == Counter({(1, 0, 1, 0): 2, (None, 0, None, 0): 1})
    assert got(documents(spark, [(None, "a b"), (None, "A  b")])) == Counter({(None, 1, None, 1): 2})
