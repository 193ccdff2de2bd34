"""Phrase collocations against plain counting, and the summaries' guarantee."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketgrain.llm import collocations
from tests.llm.cases import SCHEMA, texts


def pieces(text):
    lowered = (text or "").encode().lower().decode()
    return [p for p in (re.findall("[^\x20\x09]+", x) for x in re.split("[.,;:!?\x0a-\x0d]", lowered)) if p]


def plain(rows, threshold, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        inside = Counter()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inside[p[k : k + size]] = max(inside[p[k : k + size]], a)
        ranked = []
        for p, a in frequent.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not 100 * inside[p] >= 80 * a:
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for place, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], start=1):
            out.append((lang, place, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def rows():
    rng = random.Random(6)
    words = ["Of", "the", "new", "york", "city", "é", "x", "A", "b's", "in"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", " \x1c "]
    made = []
    for _ in range(300):
        text = "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        made.append((rng.choice(["en", "en", "de", None, ""]), text))
    return made + [("en", x) for _, x in texts()] + [("fr", made[0][1])] * 40 + [(None, None)] * 3


def frame(spark, given):
    data = [(k, x, lang, "k", 1, "r", "s", "f", "i", "w", "t") for k, (lang, x) in enumerate(given)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.mark.parametrize(
    ("threshold", "options"),
    [(30, {}), (3, {"shard_bytes": 4_000, "slot_bytes": 9_000}), (1, {}), (7, {"top": 11, "shard_bytes": 20_000, "slot_bytes": 1 << 20})],
)
def test_equals_plain_counting(spark, threshold, options):
    given = rows() if threshold > 1 else rows()[:60]
    found = collocations.collocations(frame(spark, given), threshold, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in found.collect()) == plain(given, threshold, options.get("top", 2000))


def test_no_documents(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("en", "")])).count() == 0


def test_merged_summaries_keep_the_frequent():
    rng = np.random.default_rng(3)
    for threshold in (2, 5, 30):
        summaries, exact = [], Counter()
        for _ in range(60):
            bins, counts = np.unique(rng.zipf(1.3, 800) % 5000, return_counts=True)
            summaries.append((bins.astype(np.uint64), counts))
            exact.update(dict(zip(bins.tolist(), counts.tolist())))
        mass = sum(exact.values())
        kept = set(collocations.frequent_bins(summaries, threshold).tolist())
        assert {b for b, n in exact.items() if n >= threshold} <= kept
        assert len(kept) <= mass // threshold + 1


def test_a_full_summary_takes_off_the_next_count():
    bins, counts, cut = collocations.merged(np.array([4, 1, 4, 2, 3], np.uint64), np.array([5, 9, 2, 3, 1]), 2)
    assert (bins.tolist(), counts.tolist(), cut) == ([1, 4], [6, 4], 3)
    assert collocations.merged(bins, counts, 2)[2] == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 1 << 58
    counts = spark.createDataFrame(
        [("en", 0, "", 4 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 1)],
        "lang string, size int, phrase string, n bigint",
    )
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_, **__: counts)
    row = collocations.collocations(None).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1) and row.n == 4 * big
