"""Phrase collocations: Misra-Gries summaries per hash partition keep every frequent phrase, a second pass counts exactly.

ASCII letters fold to lower case; ``[.,;:!?\\x0A-\\x0D]`` cuts a text into pieces, space and tab cut pieces into
words. A phrase is 1 to 4 words of one piece, counted per language (null: ``und``) with overlaps, in every text.

1. Texts are dealt to shards. A shard counts its phrases by *bins* (leading bits of a 64-bit hash of language and
   words) and sends the sorted bins with their counts to hash partitions. That is a summary without error.
2. A partition merges the summaries in Misra-Gries fashion: counts are added; when more than ``capacity`` bins are
   left, the next largest count is taken off all and what is not positive goes. With a capacity above the
   partition's mass divided by the threshold, all that is taken off any bin is less than the threshold, so every
   phrase that is frequent survives. Survivors whose count plus the error reaches the threshold go back to the
   shards that hold them.
3. The second pass counts the survivors exactly, by their words: shards count them in their texts, Spark adds up.
   Bins that held several rare phrases fall out here.

Every part of a frequent phrase is at least as frequent, so the parts needed for scores and containment are among
the counted phrases. The memory of a task is bounded by a shard and its longest text, or by a partition's capacity
and its summaries. A phrase that most documents hold is one number per shard, a text that many rows hold one row per
batch.

Only ``text`` and ``lang`` are read, so rows without an id count like others and repeated rows count each. Null and
empty texts have no words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.common import mixed, piece_words, rolling, stored
from marketgrain.llm.packed import (
    among,
    bin_bits,
    by_slot,
    dealt_texts,
    pack,
    pack_sorted,
    slot_edges,
    summed,
    text_bytes,
    unpack,
    unpack_sorted,
)

THRESHOLD = 30
LONGEST = 4
TOP = 2000
#: A longer candidate with at least this share (percent) of a phrase's count drops the phrase.
CONTAINED = 80
SHARD_BYTES = 8 << 20
#: Text bytes whose phrases one hash partition summarises.
SLOT_BYTES = 8 << 20

_UNKNOWN = "und"
#: Bins laid together before a merge, in capacities.
_LAID = 8


class _Phrases:
    """The phrases of the texts of one language in a shard: positions, lengths and hashes."""

    def __init__(self, texts: pa.Array, copies: np.ndarray, lang: str, longest: int) -> None:
        words = piece_words(texts)
        self.words, self.copies = words, copies[words.text]
        salt = np.uint64(int.from_bytes(lang.encode()[:64], "little") % (1 << 61) * 2 + 1)
        salt = mixed(np.array([salt ^ np.uint64(len(lang))], np.uint64))[0]
        self.at, self.hashes = [], []
        for size in range(1, longest + 1):
            count = max(0, len(words.hashes) - size + 1)
            at = np.flatnonzero(words.piece[:count] == words.piece[size - 1 : size - 1 + count])
            self.at.append(at)
            self.hashes.append(mixed((rolling(words.hashes, size)[at] + np.uint64(size)) * (salt | np.uint64(1))))

    def phrases(self, positions: np.ndarray, size: int) -> pa.Array:
        """The words from each position on, joined by one space."""
        w = self.words
        begins, ends = w.begins[positions], w.ends[positions + size - 1]
        lengths = ends - begins
        gaps = [(w.ends[positions + k], w.begins[positions + k + 1]) for k in range(size - 1)]
        plain = np.ones(len(positions), bool)  # one space between any two words: the text itself
        for left, right in gaps:
            plain &= (right - left == 1) & (w.data[left] == 0x20)
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) + np.repeat(begins - starts, lengths)
        lower = w.data[inside]
        lower += ((lower >= 65) & (lower <= 90)).astype(np.uint8) * np.uint8(32)
        offsets = np.concatenate([starts, [len(lower)]]).astype(np.int64)
        buffers = pa.py_buffer(offsets.tobytes()), pa.py_buffer(lower.tobytes())
        whole = pa.LargeStringArray.from_buffers(len(positions), *buffers).cast(pa.string())
        if plain.all():
            return whole
        joined = pc.replace_substring_regex(whole.filter(pa.array(~plain)), "[ \t]+", " ")
        return pc.replace_with_mask(whole, pa.array(~plain), joined)


def _by_language(texts: pa.Table) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for lang in pc.unique(texts["lang"]).to_pylist():
        part = texts.filter(pc.equal(texts["lang"], lang)).combine_chunks()
        yield lang, part["text"].chunk(0) if part.num_rows else part["text"], part["copies"].to_numpy()


def _summary_rows(bits: int, slots: int, longest: int):
    schema = pa.schema([("slot", pa.int32()), ("shard", pa.int32()), ("bins", pa.binary()), ("counts", pa.binary())])
    shift, edges = np.uint64(64 - bits), slot_edges(bits, slots)

    def run(texts: pa.Table) -> pa.Table:
        bins, counts = [], []
        for lang, part, copies in _by_language(texts):
            found = _Phrases(part, copies, lang, longest)
            for at, hashes in zip(found.at, found.hashes):
                b, c = summed(hashes >> shift, found.copies[at])
                bins.append(b)
                counts.append(c)
        b, c = summed(np.concatenate(bins), np.concatenate(counts), runs=True)
        shard = texts["shard"][0].as_py()
        rows = [(s, shard, pack_sorted(b[i:j]), pack(c[i:j].astype(np.uint64))) for s, i, j in by_slot(b, edges)]
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def merged(bins: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One summary of at most ``capacity`` bins from several laid together, and what it took off every count."""
    bins, counts = summed(bins, counts, runs=True)
    if len(bins) <= capacity:
        return bins, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > cut
    return bins[left], counts[left] - cut, cut


def frequent_bins(summaries: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """All bins whose total count reaches ``threshold``, and few others."""
    mass = sum(int(counts.sum()) for _, counts in summaries)
    capacity, error = mass // threshold + 1, 0
    laid: list[tuple[np.ndarray, np.ndarray]] = []
    for k, summary in enumerate(summaries):
        laid.append(summary)
        # several are laid together before they are cut back, as long as they stay few
        if k + 1 == len(summaries) or sum(len(b) for b, _ in laid) > _LAID * capacity:
            bins, counts, cut = merged(*(np.concatenate(c) for c in zip(*laid)), capacity)
            laid = [(bins, counts)]
            error += cut
    if not laid:
        return np.zeros(0, np.uint64)
    bins, counts = laid[0]
    return bins[counts + error >= threshold]


def _survivor_rows(threshold: int):
    schema = pa.schema([("shard", pa.int32()), ("bins", pa.binary())])

    def run(sent: pa.Table) -> pa.Table:
        parts = [unpack_sorted(x) for x in sent["bins"].to_pylist()]
        counts = (unpack(x).astype(np.int64) for x in sent["counts"].to_pylist())
        survivors = frequent_bins(list(zip(parts, counts)), threshold)
        held = [part[among(part, survivors)] for part in parts]
        rows = [(shard, pack_sorted(b)) for shard, b in zip(sent["shard"].to_pylist(), held) if len(b)]
        columns = list(zip(*rows)) or [()] * 2
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_COUNTED = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _counted_rows(bits: int, longest: int):
    shift = np.uint64(64 - bits)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            survivors = [unpack_sorted(x) for x in answers["bins"].to_pylist()]
            survivors = np.sort(np.concatenate(survivors)) if survivors else np.zeros(0, np.uint64)
            for lang, part, copies in _by_language(texts):
                found = _Phrases(part, copies, lang, longest)
                out.append(pa.table([[lang], [0], [""], [int(found.copies.sum())]], schema=_COUNTED))
                for size, (at, hashes) in enumerate(zip(found.at, found.hashes), start=1):
                    use = among(hashes >> shift, survivors)
                    hashes, at = hashes[use], at[use]
                    if not len(at):
                        continue
                    order = np.argsort(hashes)
                    hashes, at = hashes[order], at[order]
                    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                    n = np.add.reduceat(found.copies[at], first)
                    names = pa.array([lang] * len(first), pa.string()), pa.array(np.full(len(first), size, np.int32))
                    out.append(pa.table([*names, found.phrases(at[first], size), n], schema=_COUNTED))
        return pa.concat_tables(out) if out else _COUNTED.empty_table()

    return run


def phrase_counts(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    shard_bytes: int = SHARD_BYTES,
    slot_bytes: int = SLOT_BYTES,
) -> DataFrame:
    """``lang, size, phrase, n``: every phrase that occurs ``threshold`` times, and per language all words (size 0)."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(_UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")
    total = text_bytes(texts)
    bits, shards, slots = bin_bits(total), max(1, -(-total // shard_bytes)), max(1, -(-total // slot_bytes))
    dealt = dealt_texts(texts, shards)
    sent = dealt.groupBy("shard").applyInArrow(
        _summary_rows(bits, slots, longest), "slot int, shard int, bins binary, counts binary"
    )
    survivors = sent.groupBy("slot").applyInArrow(_survivor_rows(threshold), "shard int, bins binary")
    counted = (
        dealt.groupBy("shard")
        .cogroup(survivors.groupBy("shard"))
        .applyInArrow(_counted_rows(bits, longest), "lang string, size int, phrase string, n bigint")
    )
    totals = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return totals.where((F.col("n") >= threshold) | (F.col("size") == 0))


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, contained: int = CONTAINED, **options: int
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the least score, ``n`` all words of the
    language; the score is floor(2000000 * a / (l + r)).
    """
    counts = stored(phrase_counts(docs, threshold, **options), "phrases")
    known = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ", -1).alias("words"))

    def part(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right")
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))

    longer = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"), "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner")
    )
    longer = longer.select(
        "lang", "longer", "words", "inner", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("first")
    )
    inside = longer.groupBy("lang", part(F.col("first"), F.col("inner")).alias("phrase")).agg(F.max("longer").alias("longer"))
    free = least.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(contained) * wide("a"))
    )
    words = counts.where("size = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("least.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", "rank", "phrase", "a", F.col("least.l").alias("l"), F.col("least.r").alias("r"), "n", F.col("least.score").alias("score")
    )
