"""The labelled sample of the toxicity model under long texts and rare kinds."""

import zlib

import pytest

from marketgrain.llm import toxicity


def free(n):
    return [i for i in range(4 * n) if zlib.crc32(str(i).encode()) % 5][:n]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")


def test_long_texts_do_not_empty_the_sample(spark):
    ids = free(40)
    rows = [(i, "long " * 4000 if k % 2 else f"text {i}", k % 4 // 2) for k, i in enumerate(ids)]
    sample = toxicity.labelled_sample(*frames(spark, rows), sample_bytes=10_000)
    assert sorted(sample["text"].to_pylist()) == sorted(x for _, x, _ in rows if len(x) < 100)


def test_one_text_of_each_id(spark):
    ids = free(4)
    rows = [(i, f"text {i} {k}", i == ids[0]) for i in ids for k in range(50)] + [(ids[0], "same", True)] * 30
    docs, labels = frames(spark, [(i, x, int(t)) for i, x, t in rows])
    assert toxicity.labelled_sample(docs, labels).num_rows == 4


def test_a_rare_kind_is_sampled_or_fails(spark):
    rows = [(i, f"text {i}", 0) for i in free(200)]
    for rare in (0, 99, 199):
        given = [(i, x, int(k == rare)) for k, (i, x, _) in enumerate(rows)]
        sample = toxicity.labelled_sample(*frames(spark, given), sample_docs=16)
        assert set(sample["toxic"].to_pylist()) == {0, 1} and sample.num_rows == 16
    given = [(i, "long " * 999 if not k else x, int(not k)) for k, (i, x, _) in enumerate(rows)]
    with pytest.raises(ValueError, match="longer"):
        toxicity.labelled_sample(*frames(spark, given), sample_bytes=10_000)
