"""Cross-tokenizer alignment: where two vocabularies cut the same text at the same byte.

The text is encoded with a leading space by a byte-level vocabulary (A) and, by a piece model that adds that space
itself, as pieces (B). Byte offsets at which a token of each ends cut both sequences into groups. The two tokens that
end there are linked; a pair of ids counts how often the corpus links it.

Per Arrow batch: the id lists are flattened with their parent indices; cumulative sums of the token lengths, less the
sum at the parent's start, give each token's end; an Acero hash join on (document, end) gives the links, in whose
order the groups follow. ``Table.group_by`` counts a batch's pairs and Spark adds the counts up.

Two tokens can only end together if the bytes of one end with the bytes of the other. The pairs that can occur
therefore follow from the two vocabularies alone, some hundred thousand for the given ones, and are numbered; the
counts of all of them are one array of that length, however large the corpus is, and that array is sent to the
tasks. Links are written once, so texts are encoded once.

A null or empty text, and one whose token bytes joined differ from the space and the text on either side, has no
tokens: zeros and an empty string. Strings of special tokens are plain text. Rows are judged each, so repeated rows,
rows without an id and ties give no trouble. Only ``doc_id`` and ``text`` are read. An empty table gives an empty
result. Texts may be long: a batch holds a few MB or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, stored
from marketgrain.llm.tokens import encode_array, ranks

#: Text that a batch encodes at once; a token takes some hundred bytes until its group is written.
BATCH_BYTES = 1 << 19
#: Bits of a key that hold a token's end; the document's place in the batch lies above them.
_END_BITS = 40

#: Rows of a written file; the second pass reads and writes a file's rows as one batch, some ten kB each.
ROWS_PER_FILE = 2000
#: Rows whose groups are written out at once in the second pass.
_ROWS_OUT = 256

_ROWS = "doc_id bigint, n_a bigint, n_b bigint, links array<int>, groups binary, size bigint"


class Vocabularies(NamedTuple):
    """Both vocabularies with the bytes of their tokens."""

    path_a: str
    model_b: sentencepiece.SentencePieceProcessor
    bytes_a: pa.Array
    bytes_b: pa.Array

    def ids_a(self, texts: list[str]) -> pa.ListArray:
        return _lists([encode_array(self.path_a, " " + text) for text in texts])

    def ids_b(self, texts: list[str]) -> pa.ListArray:
        return _lists([np.array(ids, np.int32) for ids in self.model_b.encode(texts, num_threads=1)])


def _piece_bytes(model: sentencepiece.SentencePieceProcessor, piece: int) -> bytes:
    name = model.id_to_piece(piece)
    return bytes([int(name[3:5], 16)]) if model.is_byte(piece) else name.replace("▁", " ").encode()


def possible_pairs(v: Vocabularies) -> np.ndarray:
    """All ``a * size of B + b`` where the bytes of one token end with those of the other, ascending."""
    a, b = v.bytes_a.to_pylist(), v.bytes_b.to_pylist()
    ids_a, ids_b = {}, {}
    for ids, tokens in ((ids_a, a), (ids_b, b)):
        for k, token in enumerate(tokens):
            if token:
                ids.setdefault(token, []).append(k)
    found = set()
    for x, here in ids_a.items():
        for k in range(len(x)):
            found.update(i * len(b) + j for i in here for j in ids_b.get(x[k:], ()))
    for y, here in ids_b.items():
        for k in range(1, len(y)):
            found.update(i * len(b) + j for i in ids_a.get(y[k:], ()) for j in here)
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    tokens = ranks(path_a)
    a = [b""] * (max(tokens.values()) + 1)
    for token, k in tokens.items():
        a[k] = token
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    b = [_piece_bytes(model, k) for k in range(model.get_piece_size())]
    return Vocabularies(path_a, model, pa.array(a, pa.binary()), pa.array(b, pa.binary()))


def _joined(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The bytes of each list's tokens, one after another."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(pc.list_flatten(ids))), b"")


def _ends(ids: pa.ListArray, pieces: pa.Array, side: str) -> pa.Table:
    """Every token's key, its parent and its end in the parent's bytes, and its place in the batch."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    sizes = pc.binary_length(pieces).cast(pa.int64()).take(flat)
    total = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    before = total.take(ids.offsets.slice(0, len(ids)))  # the sum at the parent's start
    end = pc.subtract(total.slice(1), before.take(doc))
    key = pc.bit_wise_or(pc.shift_left(doc.cast(pa.int64()), pa.scalar(_END_BITS, pa.int64())), end)
    return pa.table({"key": key, side: pa.array(np.arange(len(flat), dtype=np.int32))})


def _groups(ids_a: pa.ListArray, ids_b: pa.ListArray, last_a: np.ndarray, last_b: np.ndarray, doc: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for each document: the tokens of both sides in group order, joined with separators."""
    flat_a, flat_b = (pc.list_flatten(x).to_numpy() for x in (ids_a, ids_b))
    group_a, group_b = (_group_numbers(last, len(flat)) for last, flat in ((last_a, flat_a), (last_b, flat_b)))
    starts_b = np.concatenate([[0], last_b + 1])
    place_a = np.arange(len(flat_a)) + starts_b[group_a]
    place_b = np.arange(len(flat_b)) + (last_a + 1)[group_b]
    ids, separator = np.empty(len(flat_a) + len(flat_b), np.int32), np.zeros(len(flat_a) + len(flat_b), np.int8)
    ids[place_a], ids[place_b] = flat_a, flat_b
    separator[place_a[last_a]] = 1
    separator[place_b[last_b]] = 2 + (np.diff(doc, append=-1) != 0)
    words = pc.binary_join_element_wise(
        pa.array(ids).cast(pa.string()), pa.array([",", "|", ";", ""]).take(pa.array(separator)), ""
    )
    offsets = ids_a.offsets.to_numpy() + ids_b.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), "")


def _group_numbers(last: np.ndarray, size: int) -> np.ndarray:
    """The group of each token, counted from the groups' last tokens."""
    ended = np.zeros(size + 1, np.int32)
    ended[last + 1] = 1
    return np.cumsum(ended[:size])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def _filtered(lists: pa.ListArray, kept: pa.Array) -> pa.ListArray:
    """The kept lists, with offsets that start at zero."""
    some = lists.filter(kept)
    sizes = pc.list_value_length(some).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pc.list_flatten(some))


def align_texts(texts: pa.Array, v: Vocabularies, pairs: np.ndarray) -> dict[str, pa.Array]:
    """``n_a, n_b, links`` (places in ``pairs`` of the linked pairs in text order) and ``groups`` of each text."""
    some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    given = texts.take(pa.array(some))
    strings = given.to_pylist()
    ids_a, ids_b = v.ids_a(strings), v.ids_b(strings)
    whole = pc.binary_join_element_wise(" ", given, "").cast(pa.binary())
    same = pc.and_(pc.equal(_joined(ids_a, v.bytes_a), whole), pc.equal(_joined(ids_b, v.bytes_b), whole))
    some, ids_a, ids_b = some[same.to_numpy(zero_copy_only=False)], _filtered(ids_a, same), _filtered(ids_b, same)
    links = _ends(ids_a, v.bytes_a, "a").join(_ends(ids_b, v.bytes_b, "b"), "key", join_type="inner", use_threads=False)
    links = links.sort_by("a").combine_chunks()
    last_a, last_b = links["a"].to_numpy(), links["b"].to_numpy()
    doc = links["key"].to_numpy() >> _END_BITS
    code = pc.list_flatten(ids_a).to_numpy()[last_a].astype(np.int64) * len(v.bytes_b) + pc.list_flatten(ids_b).to_numpy()[last_b]
    n_a, n_b, n_links = (np.zeros(len(texts), np.int64) for _ in range(3))
    n_a[some], n_b[some] = (pc.list_value_length(x).to_numpy() for x in (ids_a, ids_b))
    n_links[some] = np.bincount(doc, minlength=len(some))
    offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
    groups = np.full(len(texts), "", object)
    groups[some] = _groups(ids_a, ids_b, last_a, last_b, doc).to_numpy(zero_copy_only=False)
    return {
        "n_a": pa.array(n_a),
        "n_b": pa.array(n_b),
        "links": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.searchsorted(pairs, code).astype(np.int32))),
        "groups": pa.array(groups, pa.string()),
    }


def _aligned_rows(path_a: str, path_b: str, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        for batch in (part for whole in batches for part in by_bytes(whole, "text", BATCH_BYTES)):
            found = align_texts(batch["text"], v, sent.value)
            groups = [g.encode() for g in found["groups"].to_pylist()]
            # kept compressed until they are written out: the links of a whole batch come back at once
            found["groups"] = pa.array([pa.compress(g, codec="zstd", asbytes=True) for g in groups], pa.binary())
            found["size"] = pa.array([len(g) for g in groups], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *found.values()], ["doc_id", *found])
        pa.default_memory_pool().release_unused()  # the worker lives on for the next pass

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pa.table({"pair": pc.list_flatten(batch["links"])}).group_by("pair").aggregate([([], "count_all")])
        yield from counted.rename_columns(["pair", "n"]).to_batches()


def pair_counts(aligned: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How often the corpus links each pair that can occur."""
    counted = aligned.select("links").mapInArrow(_pair_rows, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most one row per pair of the vocabularies
    counts = np.zeros(len(pairs), np.int64)
    counts[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _counted_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in (whole.slice(at, _ROWS_OUT) for whole in batches for at in range(0, whole.num_rows, _ROWS_OUT)):
            flat = pc.list_flatten(batch["links"]).to_numpy()
            sizes = pc.list_value_length(batch["links"]).to_numpy()
            sums = np.zeros((2, len(flat) + 1), np.int64)
            np.cumsum(best[flat], out=sums[0, 1:])
            np.cumsum(counts[flat], out=sums[1, 1:])
            ends = np.cumsum(sizes)
            n_best, count_sum = sums[:, ends] - sums[:, ends - sizes]
            groups = [
                pa.decompress(g.as_buffer(), decompressed_size=n.as_py(), codec="zstd", asbytes=True)
                for g, n in zip(batch["groups"], batch["size"])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_a"], batch["n_b"], pa.array(groups, pa.binary()).cast(pa.string())]
                + [pa.array(sizes.astype(np.int64)), pa.array(n_best), pa.array(count_sum)],
                ["doc_id", "n_a", "n_b", "groups", "n_links", "n_best", "count_sum"],
            )

    return run


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, groups, n_links, n_best, count_sum``.

    ``path_a`` is a byte-level vocabulary, ``path_b`` a piece model. ``groups`` holds the ids of both sides in the
    form ``a1,a2|b1;a3|b2,b3``, and every group ends in one link. ``n_best`` counts the links whose pair no other
    pair of the same B id exceeds in the corpus, ``count_sum`` adds up the counts of the links' pairs.
    """
    v = vocabularies(path_a, path_b)
    pairs, context = possible_pairs(v), docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    aligned = stored(rows.mapInArrow(_aligned_rows(path_a, path_b, context.broadcast(pairs)), _ROWS), "aligned", ROWS_PER_FILE)
    counts = pair_counts(aligned, pairs)
    most = np.zeros(len(v.bytes_b), np.int64)
    np.maximum.at(most, pairs % len(v.bytes_b), counts)
    sent = context.broadcast((counts, counts == most[pairs % len(v.bytes_b)]))
    return aligned.mapInArrow(
        _counted_rows(sent),
        "doc_id bigint, n_a bigint, n_b bigint, groups string, n_links bigint, n_best bigint, count_sum bigint",
    )
