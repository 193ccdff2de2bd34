"""Near copies by exact similarity against all pairs of texts."""

import random

import pytest

from marketgrain.llm import near_copies
from tests.llm.cases import documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiourstn") for _ in range(5))
    common = [word() for _ in range(30)]
    found = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((7, 20, 60, 150, 400)))] + common * (rng.random() < 0.5)
        found.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            found.append("  ".join(copy).upper())
    found += ["", None, "one two", "One Two", "one two three", found[3], " \n"]
    rng.shuffle(found)
    return list(enumerate(found))


def least_similar(given):
    sets, label = [shingles(x) for _, x in given], list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if label[a] != label[b] and similar(sets[a], sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {given[k][0] for k in range(len(given)) if label[k] == k}


@pytest.mark.parametrize("options", [{}, {"cell": 4, "sampled": 1, "common": 5}])
def test_groups_equal_all_pairs(spark, options):
    given = rows()
    docs = documents(spark, given)
    want = least_similar(given)
    got = near_copies.first_of_each_group(docs, **options)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_documents_without_id_stay(spark):
    docs = documents(spark, [(1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")])
    assert sorted(str(r.doc_id) for r in near_copies.first_of_each_group(docs).collect()) == ["1", "None"]
    assert near_copies.first_of_each_group(docs.limit(0)).count() == 0
