"""Sorted numbers as bytes, shards of texts, words inside pieces."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketgrain.llm import common, packed


@pytest.mark.parametrize("size", [0, 1, 2, 5000])
@pytest.mark.parametrize("high", [2, 200, 1 << 20, 1 << 33, (1 << 64) - 1])
def test_round_trip(size, high):
    values = np.random.default_rng(size).integers(0, high, size, dtype=np.uint64, endpoint=True)
    assert np.array_equal(packed.unpack(packed.pack(values)), values)
    assert np.array_equal(packed.unpack_sorted(packed.pack_sorted(np.sort(values))), np.sort(values))


def test_slots_cover_all_bins():
    bins = np.sort(np.random.default_rng(1).integers(0, 1 << 12, 500, dtype=np.uint64))
    for slots in (1, 3, 7, 64):
        found = list(packed.by_slot(bins, packed.slot_edges(12, slots)))
        assert [b for _, a, e in found for b in bins[a:e]] == bins.tolist()
        assert all((int(b) * slots) >> 12 == s for s, a, e in found for b in bins[a:e])


def test_copies_are_folded(spark):
    rows = [("en", "a b")] * 40 + [("de", "a b")] * 3 + [("en", None)] * 2
    dealt = packed.dealt_texts(spark.createDataFrame(rows, "lang string, text string").coalesce(1), 5)
    found = dealt.collect()
    assert Counter({(r.lang, r.text): r.copies for r in found}) == Counter(rows)
    assert all(0 <= r.shard < 5 for r in found)


@pytest.mark.parametrize("slice_bytes", [7, 1 << 20])
def test_words_inside_pieces(monkeypatch, slice_bytes):
    monkeypatch.setattr(common, "SLICE_BYTES", slice_bytes)
    rng = random.Random(2)
    parts = ["a", "B", " ", "\t", ".", ",", "\n", "\x0b", "é", "  ", "\x1c"]
    texts = [None, "", " a", "Ab, cD.e f\tg\nh", "x"] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    w = common.piece_words(pa.array(["left out", *texts]).slice(1))
    found = {}
    for k in range(len(w.hashes)):
        found.setdefault((w.text[k], w.piece[k]), []).append(w.data[w.begins[k] : w.ends[k]].tobytes().decode())
    pieces = [(i, re.findall("[^\x20\x09]+", p)) for i, x in enumerate(texts) for p in re.split("[.,;:!?\x0a-\x0d]", x or "")]
    assert [(i, words) for (i, _), words in found.items()] == [p for p in pieces if p[1]]
    names = [x.encode().lower() for words in found.values() for x in words]
    assert len(set(zip(names, w.hashes.tolist()))) == len(set(names)) == len(set(w.hashes.tolist()))
