"""Rows without an id, repeated rows, names that clash or hold a dot, and long white space in stages and token operators."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marketgrain.llm import common, line_dedup, packing, simhash, substring, token_counts, tokens
from marketgrain.llm.queries import MERGES, RANKS
from tests.llm.cases import documents, texts
from tests.llm.test_operators import fingerprint

ODD = ["a.b", "ld_text", "ld_doc", "ld_row", "ld_gone", "key", "held", "id", "fp", "row", "lines", "gone", "root", "given"]


def with_odd_columns(docs):
    for name in ODD:
        docs = docs.withColumn(name, F.lit(f"was {name}"))
    return docs


def test_stages_pass_any_columns(spark):
    docs = with_odd_columns(documents(spark))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        given = [c for c in docs.columns if c != "ids"]  # the last stage replaces it
        assert [c for c in found.columns if c not in ("ids", "decoded")] == given
        values = found.select(*[F.col(f"`{c}`") for c in ODD]).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(f"was {c}" for c in ODD)], name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0 and empty.columns == found.columns


def test_line_dedup_with_clashing_columns(spark):
    docs = documents(spark)
    plain = line_dedup.dedup_lines(docs).select("doc_id", "n_dropped", "kept")
    odd = line_dedup.dedup_lines(with_odd_columns(docs)).select("doc_id", "n_dropped", "kept")
    assert Counter(plain.collect()) == Counter(odd.collect())


def first_rows(rows):
    """Per component the least row: known ids first, then equal rows once."""
    prints = [fingerprint(x) for _, x in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    groups = defaultdict(list)
    for k, row in zip(label, rows):
        groups[k].append(row)
    return groups.values()


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in texts() if r[0] != 14]
    kept = Counter((r.doc_id, r.text) for r in simhash.first_of_each_group(documents(spark, rows)).collect())
    groups = list(first_rows(rows))
    for group in groups:
        known = [i for i, _ in group if i is not None]
        left = [r for r in set(group) if r in kept]
        assert len(left) == 1 and left[0][0] == (min(known) if known else None)
        assert kept.pop(left[0]) == (group.count(left[0]) if known else 1)
    assert not kept


def test_copies_without_an_id(spark):
    rows = [(None, "a b c d e f g h i"), (None, "a b c d e f g h i"), (None, "other words are here now"), (5, "Other words are here now")]
    kept = simhash.first_of_each_group(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("5", "O"), ("None", "a")]


# ---- white space -------------------------------------------------------------------------------


def test_both_vocabulary_files_agree():
    assert tokens.ranks(MERGES) == tokens.ranks(RANKS)


def test_cut_at_long_white_space(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_SPACE", 3)
    tokens.encode.cache_clear()
    library, rng = Tokenizer.from_file(MERGES), random.Random(3)
    library.encode_special_tokens = True
    parts = [" ", "   ", "\n", "\t", "\x1c", "\x85", "　", "​", "a", "b1", "!", "'s", "<|endoftext|>", "é", "中"]
    try:
        for _ in range(5000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
            assert tokens.encode(MERGES)(text) == library.encode(text, add_special_tokens=False).ids
    finally:
        tokens.encode.cache_clear()


@pytest.mark.parametrize("space", [" ", "\n", " \t"])
def test_any_length_of_white_space(space):
    library = Tokenizer.from_file(MERGES)
    library.encode_special_tokens = True
    for size in (10, 1_000, 4_095, 4_096, 100_000):
        text = "a" + space * size + "b  c"
        assert tokens.encode(RANKS)(text) == library.encode(text, add_special_tokens=False).ids
    assert len(tokens.encode(RANKS)("a" + " " * 10_000_000 + "b")) == 10_000_001


def test_token_operators_on_long_white_space(spark):
    long = "a" + " " * 1_000_000 + "b"
    docs = documents(spark, [(1, long), (2, "\n" * 300_000), (3, "c d"), (None, long), (None, None)])
    rows = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(docs, RANKS).collect()}
    assert rows == {1_000_001: 2, 150_000: 1, 2: 1, 0: 1}
    found = defaultdict(dict)
    for r in packing.pack(docs, RANKS).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for s, at in zip(r.segments, r.resets):
            found[s.doc_id][s.offset] = found[s.doc_id].get(s.offset, 0) + s.length
    assert {i: sum(x.values()) for i, x in found.items()} == {1: 1_000_001, 2: 150_000, 3: 2, None: 1_000_001}


# ---- substring dedup of shared phrases and repeated rows ----------------------------------------


def test_a_phrase_that_many_passages_share_takes_linear_time():
    """Documents that begin with one line and recur elsewhere: every occurrence is looked up, none against all passages."""
    rng = random.Random(1)
    head = "licensed under the terms of this file"
    bodies = [f"{head} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(4000)]
    words = common.word_table(pa.array(bodies * 2))
    ids = np.arange(8000)
    hashes = substring._windows(words, 13, 7)[0]
    inside = words.text[: len(hashes)] == words.text[12:]
    confirmed = np.unique(hashes[inside & (words.text[: len(hashes)] < 4000)])
    owner = {h: int(t) for h, t in zip(hashes[inside][::-1].tolist(), words.text[: len(hashes)][inside][::-1].tolist())}
    table = pa.table({"window": confirmed.view(np.int64), "owner": np.array([owner[h] for h in confirmed.tolist()], np.int64)})
    started = time.perf_counter()
    covered = substring._covered(words, ids, np.ones(8000, bool), table, 13, 7)
    assert time.perf_counter() - started < 10
    assert covered[words.text >= 4000].all() and not covered[words.text < 4000].any()


def test_rows_that_repeat_an_id_spread_over_shards(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(7, f"{passage} {k}") for k in range(30)] + [(None, passage)] * 10 + [(9, passage), (9, passage), (8, "x " + passage)]
    found = substring.remove_repeats(documents(spark, rows), shard_bytes=300).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == Counter({(7, 0): 30, (None, 0): 10, (9, 40): 2, (8, 40): 1})
