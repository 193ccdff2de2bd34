"""The corpus pipeline against a plain version of its stages."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from marketgrain.llm import quality_rules
from marketgrain.llm.common import table
from marketgrain.llm.queries import MERGES
from tests.conftest import SMALL
from tests.llm.test_operators import folded, least_linked, line_key


def plain(spark, folder):
    rows = [(r.doc_id, r.text) for r in quality_rules.judge(table(spark, folder, "documents")).where("kept").collect()]
    first = {}
    for i, x in sorted(rows):
        for line in x.split("\n"):
            first.setdefault(line_key(line), i)
    rows = [(i, "\n".join(y for y in x.split("\n") if len(line_key(y)) < 10 or first[line_key(y)] == i)) for i, x in rows]
    stay = {i for i, _, low in least_linked(rows) if i == low}
    items = [folded(r.text) for r in table(spark, folder, "benchmark").collect()]
    places = {}
    for number, v in enumerate(items):
        for b in range(len(v) - 12):
            for p in range(13):
                places.setdefault((v[b + p], p), []).append((number, b))
    kept = []
    for i, x in rows:
        if i not in stay:
            continue
        w = folded(x)
        hit = any(
            max(Counter(c for p in range(13) for c in places.get((w[a + p], p), ())).values(), default=0) >= 11
            for a in range(len(w) - 12)
        )
        if not hit:
            kept.append((i, x))
    library = Tokenizer.from_file(MERGES)
    return Counter((i, x, tuple(library.encode(x, add_special_tokens=False).ids)) for i, x in kept)


def test_pipeline_equals_plain_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    rows = found.collect()
    assert found.columns == [*table(spark, SMALL, "documents").columns, "ids", "decoded"]
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in rows) == plain(spark, SMALL)
    assert all(r.decoded == r.text and r.n_chars == len(r.text) for r in rows)


def test_stage_columns(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
