"""The alignment of two vocabularies against one text at a time."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from marketgrain.llm import alignment
from marketgrain.llm.queries import MERGES, PIECES
from tests.llm.cases import documents, texts

BYTE = re.compile("<0x([0-9A-F]{2})>")


def characters():
    """The byte of each character of the byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    table, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            table[chr(b)] = b
        else:
            table[chr(spare)] = b
            spare += 1
    return table


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(MERGES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        self.names, self.table = {i: t for t, i in self.a.get_vocab().items()}, characters()

    def piece(self, k):
        name = self.b.id_to_piece(k)
        found = BYTE.fullmatch(name)
        return bytes([int(found[1], 16)]) if found else name.replace("▁", " ").encode()

    def align(self, text):
        """``n_a, n_b, links, groups``"""
        if not text:
            return 0, 0, [], ""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [bytes(self.table[c] for c in self.names[k]) for k in a], [self.piece(k) for k in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return 0, 0, [], ""
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        place_a, place_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups, links, i, j = [], [], 0, 0
        for end in sorted(place_a.keys() & place_b.keys()):
            x, y = place_a[end] + 1, place_b[end] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        return len(a), len(b), links, ";".join(groups)


ODD = [None, "", "a", "▁", "a▁b", "  x  ", "<|endoftext|> <s></s><unk> <0x41>", "\x00a", "中文字 ﬁ ½", "é", "\n\n\t", "ﷺ", "\U0001f600 x"]


def rows():
    rng = random.Random(4)
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "中", "1", ".", "'s", "\U0001f600", "ﬁ"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(200)]
    return texts() + [(1000 + k, x) for k, x in enumerate(ODD + made)]


def test_equals_plain_alignment(spark):
    plain, given = Plain(), rows()
    found = alignment.align(documents(spark, given), MERGES, PIECES).collect()
    single = [(i, *plain.align(x)) for i, x in given]
    counts = Counter(pair for *_, links, _ in single for pair in links)
    best = Counter()
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter(
        (i, n_a, n_b, groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links))
        for i, n_a, n_b, links, groups in single
    )
    names = ["doc_id", "n_a", "n_b", "groups", "n_links", "n_best", "count_sum"]
    assert Counter(tuple(r[c] for c in names) for r in found) == want


def test_long_texts_and_empty_tables(spark):
    long = "word " * 40_000 + " " * 200_000 + "x" * 100_000
    docs = documents(spark, [(1, long), (2, None), (None, "a b")])
    found = {r.doc_id: r for r in alignment.align(docs, MERGES, PIECES).collect()}
    assert found[1].n_a > 200_000 and found[1].n_links == found[1].groups.count("|")
    assert (found[2].n_a, found[2].groups, found[2].count_sum) == (0, "", 0) and found[None].n_links == 2
    assert alignment.align(docs.limit(0), MERGES, PIECES).count() == 0
    assert alignment.align(documents(spark, [(1, None)]), MERGES, PIECES).first().n_b == 0


def test_pairs_follow_from_the_vocabularies():
    v = alignment.vocabularies(MERGES, PIECES)
    a, b, size = v.bytes_a.to_pylist(), v.bytes_b.to_pylist(), len(v.bytes_b)
    pairs = alignment.possible_pairs(v)
    assert len(np.unique(pairs)) == len(pairs) < 1_000_000
    for pair in pairs[::97].tolist():
        x, y = a[pair // size], b[pair % size]
        assert x and y and (x.endswith(y) or y.endswith(x))
    linked = alignment.align_texts(pa.array([x for _, x in texts() if x]), v, pairs)["links"]
    assert all(0 <= k < len(pairs) for row in linked.to_pylist() for k in row)
