"""Removal of passages that recur across documents, by automata over repeated phrases.

A window is 13 consecutive words of one document. A word goes if a window that covers it also starts in
a document with a smaller ``doc_id``. Nothing is judged on what is left after a removal.

1. Documents are dealt to shards of a few MB, in one shuffle that all later steps share. Rows that repeat an id, and
   copies without one, spread over shards. A partition of the shuffle holds many shards.
2. Every window is named by the least hash of its 7-word phrases, so equal windows have equal names and
   neighbours mostly share one. Names seen in two documents are *recurring*; only they are followed.
3. Each shard hashes the windows with recurring names. A window is *confirmed* for a shard when a
   document of the shard has it and a smaller ``doc_id`` anywhere holds it too.
4. Each shard takes the first occurrence of every confirmed window as a passage, cuts passages into
   phrases of 7 words, compiles them into one Aho-Corasick automaton and streams its documents through
   it. Any 13 words hold a whole phrase, so each occurrence is found; the windows around a phrase found are then
   looked up by their own hash among the confirmed ones.

Every task holds one shard. A frequent passage adds one row per shard to the counts, however many
documents have it. Null texts have no words; documents with a null ``doc_id`` neither lose words nor
make others lose any; rows that repeat a ``doc_id`` are one document for the comparison and stay
separate rows of the result. Words are compared by 64-bit hashes. Only ``doc_id`` and ``text`` are read, so other
columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, ranges, rolling, shard_count, sliding_min, word_table

WINDOW = 13
PHRASE = 7
SHARD_BYTES = 4 << 20
#: Code points that can stand for words in an automaton, without the surrogates.
_ALPHABET = 0x10FFFF - 0x800 - 1


def _windows(words, window: int, phrase: int):
    """Hash, name and text of the windows; true where a window lies in one text."""
    size = max(0, len(words.hashes) - window + 1)
    whole = words.text[:size] == words.text[window - 1 :] if size else np.zeros(0, bool)
    names = sliding_min(rolling(words.hashes, phrase), window - phrase + 1) >> np.uint64(16)
    return rolling(words.hashes, window), names[:size].astype(np.int64), words.text[:size], whole


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy().astype(np.int64), known


def _extremes(keys: np.ndarray, docs: np.ndarray):
    """Least and greatest document of each key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(keys)]])[: len(first)] - 1
    return keys[first], docs[first], docs[last]


def _name_rows(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            shards = batch["shard"].to_numpy(zero_copy_only=False)
            for shard in np.unique(shards):
                part = pa.Table.from_batches([batch.filter(pa.array(shards == shard))])
                ids, known = _ids(part["doc_id"])
                _, names, text, whole = _windows(word_table(part["text"]), window, phrase)
                use = whole & known[text]
                use[1:] &= ~(use[:-1] & (names[1:] == names[:-1]) & (text[1:] == text[:-1]))
                key, low, high = _extremes(names[use], ids[text[use]])
                yield pa.RecordBatch.from_pydict(
                    {"name": key, "seen": shard.astype(np.int64) * 2 + (low < high)},
                    schema=pa.schema([("name", pa.int64()), ("seen", pa.int64())]),
                )

    return run


def _window_rows(window: int, phrase: int):
    schema = pa.schema([("shard", pa.int32()), ("window", pa.int64()), ("low", pa.int64()), ("more", pa.int64())])

    def run(docs: pa.Table, names: pa.Table) -> pa.Table:
        if not docs.num_rows or not names.num_rows:
            return schema.empty_table()
        ids, known = _ids(docs["doc_id"])
        hashes, own, text, whole = _windows(word_table(docs["text"]), window, phrase)
        use = whole & known[text] & np.isin(own, names["name"].to_numpy())
        key, low, high = _extremes(hashes[use].view(np.int64), ids[text[use]])
        shards = np.full(len(key), docs["shard"][0].as_py(), np.int32)
        return pa.table([shards, key, low, high - low], schema=schema)

    return run


def _as_text(ranks: np.ndarray) -> str:
    """One character per word."""
    points = ranks % _ALPHABET + 1
    points = points + 0x800 * (points >= 0xD800)
    return points.astype("<u4").tobytes().decode("utf-32-le")


def _phrases(words, first: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Positions of the phrases that cut the passages covered by the windows in ``first``."""
    begins, ends = ranges(first)
    return np.concatenate([np.arange(b, e + window - phrase, phrase) for b, e in zip(begins, ends)] or [[]]).astype(np.int64)


def _occurrences(words, passages: np.ndarray, phrase: int) -> np.ndarray:
    """Positions at which a phrase of a passage occurs, ascending."""
    inside = (passages[:, None] + np.arange(phrase)).ravel()
    alphabet = np.unique(words.hashes[inside])
    rank = np.minimum(np.searchsorted(alphabet, words.hashes), len(alphabet) - 1)
    body = _as_text(np.where(alphabet[rank] == words.hashes, rank + 1, 0))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for text in {body[p : p + phrase] for p in passages.tolist()}:
        automaton.add_word(text)
    automaton.make_automaton()
    return np.fromiter((end - phrase + 1 for end, _ in automaton.iter(body)), np.int64)


def _covered(words, ids, known, confirmed: pa.Table, window: int, phrase: int) -> np.ndarray:
    """True for each word that a smaller document's window covers."""
    hashes, _, text, whole = _windows(words, window, phrase)
    covered = np.zeros(len(words.hashes), bool)
    keys = confirmed["window"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, owners = keys[order], confirmed["owner"].to_numpy()[order]
    if not len(keys) or not len(hashes):
        return covered
    rank = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    recurs = whole & (keys[rank] == hashes) & known[text]
    places = np.flatnonzero(recurs)
    first = np.zeros(len(hashes), bool)
    first[places[np.unique(rank[places], return_index=True)[1]]] = True
    passages = _phrases(words, first, window, phrase)
    if not len(passages):
        return covered
    # an occurrence names its windows itself, however many passages hold its phrase
    found = _occurrences(words, passages, phrase)
    change = np.zeros(len(words.hashes) + 1, np.int32)
    for shift in range(window - phrase + 1):
        f = found - shift
        f = f[(f >= 0) & (f < len(hashes))]
        f = f[recurs[f]]
        f = f[owners[rank[f]] < ids[text[f]]]  # ascending and distinct
        change[f] += 1
        change[f + window] -= 1
    return np.cumsum(change[:-1]) > 0


def _result_rows(window: int, phrase: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
        + [("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        words = word_table(docs["text"])
        ids, known = _ids(docs["doc_id"])
        covered = _covered(words, ids, known, confirmed, window, phrase)
        n_removed, kept, removed = [], [], []
        for k, text in enumerate(docs["text"].to_pylist()):
            gone = covered[words.starts[k] : words.starts[k + 1]]
            parts = (text or "").encode().split()
            begins, ends = ranges(gone) if gone.any() else ((), ())
            if len(begins):
                parts = [w for w, g in zip(parts, gone.tolist()) if not g]
            kept.append(b" ".join(parts).decode())
            n_removed.append(int(gone.sum()))
            removed.append([{"start": int(b), "end": int(e)} for b, e in zip(begins, ends)])
        return pa.table([docs["doc_id"], np.diff(words.starts), n_removed, kept, removed], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept, removed``.

    ``kept`` holds the words that stay, joined by one space, ``removed`` the word ranges that go.
    """
    phrase = (window + 1) // 2
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    shards = shard_count(docs, "text", shard_bytes)
    shard = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)).cast("int")
    dealt = docs.withColumn("shard", shard).repartition("shard")

    seen = dealt.mapInArrow(_name_rows(window, phrase), "name bigint, seen bigint")
    by_name = Window.partitionBy("name")
    recurring = (
        seen.withColumn("times", F.count(F.lit(1)).over(by_name))
        .withColumn("both", F.max(F.col("seen") % 2).over(by_name))
        .where((F.col("times") > 1) | (F.col("both") == 1))
        .select(F.floor(F.col("seen") / 2).cast("int").alias("shard"), "name")
    )
    windows = (
        dealt.groupBy("shard")
        .cogroup(recurring.groupBy("shard"))
        .applyInArrow(_window_rows(window, phrase), "shard int, window bigint, low bigint, more bigint")
    )
    confirmed = (
        windows.withColumn("owner", F.min("low").over(Window.partitionBy("window")))
        .where(F.col("owner") < F.col("low") + F.col("more"))
        .select("shard", "window", "owner")
    )
    return (
        dealt.groupBy("shard")
        .cogroup(confirmed.groupBy("shard"))
        .applyInArrow(
            _result_rows(window, phrase),
            "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>",
        )
    )
