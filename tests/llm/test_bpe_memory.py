"""What a BPE worker holds at once is bounded in bytes, whatever the texts."""

import random
import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from marketgrain.llm import bpe
from marketgrain.llm.queries import MERGES


def test_kept_chunks_are_bounded_in_bytes():
    model, library, rng = bpe.BytePairs(MERGES), Tokenizer.from_file(MERGES), random.Random(3)
    often = " ".join("".join(rng.choices("abcdeinst", k=5)) for _ in range(50))
    for _ in range(24):
        text = often + " " + " ".join("".join(rng.choices("abcdeinst", k=12)) for _ in range(9_000))
        ids = np.frombuffer(model.encode([text])[0], np.int32)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for kept in (model.young, model.old) for k, v in kept.items())
    assert held < 2 * (8 << 20)


def test_few_bytes_are_coded_at_once():
    texts = [f"{n} " * 4_000 for n in range(60)] + [None, "", "long " * 100_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = list(bpe._coded_rows(MERGES, 512)(iter([batch])))
    assert [t for part in found for t in part["decoded"].to_pylist()] == [t or "" for t in texts]
    assert all(part.num_rows == 1 or sum(len(t) for t in part["decoded"].to_pylist()) <= 1 << 18 for part in found)
