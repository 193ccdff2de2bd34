"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Every word is tagged clean or toxic. A word's evidence is the weight of its hashed bucket, that of its first bytes,
which inflected forms share, and those of its left and right neighbours; transitions weigh neighbouring tags. The
tags learned from are the words of labelled documents: toxic where a toxic document holds a word, or a word's
beginning, that toxic documents favour, clean elsewhere.
Forward-backward gives each word's marginal; a document's score is a logistic function of the marginals'
sum, maximum and mean, and its spans are the runs of words that are toxic at one half or more.

Models are fitted on the driver from at most ``SAMPLE_DOCS`` labelled documents with together at most
``SAMPLE_BYTES`` of text, chosen by a hash of their ids; whole texts are used, one of each id, none longer than
``SAMPLE_BYTES / PARTS``. If labelled documents are of both kinds, the sample is, or fitting fails. All documents are scored, as
independent rows, nothing is shuffled. Words are compared as in decontamination.

Null and empty texts get the score of no evidence. Documents with a null id are scored and never learned
from. An id with several labels counts as toxic if one says so. Without labels of both kinds every score
is the share of toxic labels, or zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, ranges, word_table

BITS = 18
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 8 << 20
#: A text longer than this part of the bound is not learned from; a kind that the sample lacks gets this part of it.
PARTS = 16
#: Times more often in toxic documents than in clean ones, and the least log-likelihood ratio, of a toxic word. These
#: and the bytes of a stem were chosen on a quarter of the learning rows, not on held-out ones.
LEAST_RATIO = 4.0
LEAST_EVIDENCE = 25.0
ROUNDS = 60
#: Learning documents from which a word has a weight of its own.
LEAST_SEEN = 5
#: First bytes of a word that have a weight of their own, so that inflected forms share what is learned.
STEM_BYTES = 5

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class Model(NamedTuple):
    own: np.ndarray  # weight of a word's bucket on itself
    stem: np.ndarray  # weight of the bucket of the word's first bytes
    left: np.ndarray  # on the word after it
    right: np.ndarray  # on the word before it
    bias: float
    moves: np.ndarray  # log weight of neighbouring tags
    score: np.ndarray  # of a document: constant, sum, maximum, mean


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Buckets(NamedTuple):
    """The hashed buckets of each word and of its first bytes."""

    word: np.ndarray
    stem: np.ndarray

    def __len__(self) -> int:
        return len(self.word)


def _buckets(texts: pa.Array):
    words = word_table(texts, fold=True, punctuation=True)
    stems = word_table(texts, fold=True, punctuation=True, prefix=STEM_BYTES)
    return words, Buckets(*((h >> np.uint64(64 - BITS)).astype(np.int64) for h in (words.hashes, stems.hashes)))


def _evidence(model: Model, words, buckets: Buckets) -> np.ndarray:
    total = model.own[buckets.word] + model.stem[buckets.stem] + model.bias
    same = words.text[1:] == words.text[:-1]
    total[1:] += model.left[buckets.word[:-1]] * same
    total[:-1] += model.right[buckets.word[1:]] * same
    return np.clip(total, -30, 30)


def _chain(odds: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Odds of the toxic tag given all words so far, for every word.

    The odds after a word are a fractional linear function of the odds before it, and constant at the
    first word of a text. The chain is folded into rows; each row's function is composed for all rows
    together, rows are linked one after another, and a second sweep fills in the words.
    """
    length = len(odds)
    width = max(1, int(np.sqrt(length)))
    rows = -(-length // width)
    padded = np.ones(rows * width)
    padded[:length] = odds
    starts = np.ones(rows * width, bool)
    starts[:length] = first
    odds2, starts2 = padded.reshape(rows, width).T.copy(), starts.reshape(rows, width).T.copy()
    (m00, m01), (m10, m11) = np.exp(moves)
    # odds after = (a * before + b) / (c * before + d)
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(width):
        o, s = odds2[k], starts2[k]
        a2, b2 = np.where(s, 0, o * (m11 * a + m01 * c)), np.where(s, o, o * (m11 * b + m01 * d))
        c2, d2 = np.where(s, 0, m10 * a + m00 * c), np.where(s, 1, m10 * b + m00 * d)
        scale = np.maximum(np.maximum(a2, b2), np.maximum(c2, d2))
        a, b, c, d = a2 / scale, b2 / scale, c2 / scale, d2 / scale
    before, now = np.ones(rows), 1.0
    for row, (p, q, r, t) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        before[row] = now
        now = (p * now + q) / (r * now + t)
    out = np.empty((width, rows))
    for k in range(width):
        o = odds2[k]
        before = np.where(starts2[k], o, o * (m01 + m11 * before) / (m00 + m10 * before))
        out[k] = before
    return out.T.ravel()[:length]


def _sweeps(evidence: np.ndarray, text: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the toxic tag by the words up to each, and by the words after each."""
    odds = np.exp(evidence)
    edge = text[1:] != text[:-1]
    first = np.concatenate([[True], edge])
    last = np.concatenate([edge, [True]])
    forward = _chain(odds, first, moves)
    # the same recursion from the other end includes the word itself, which is divided out
    backward = _chain(odds[::-1], last[::-1], moves.T)[::-1] / odds
    return forward, backward


def marginals(model: Model, words, buckets: Buckets) -> np.ndarray:
    """Probability of the toxic tag of every word."""
    if not len(buckets.word):
        return np.zeros(0)
    forward, backward = _sweeps(_evidence(model, words, buckets), words.text, model.moves)
    both = forward * backward
    return both / (1 + both)


def _figures(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum, maximum and mean of the marginals of each text, with a constant."""
    sizes = np.diff(starts)
    total = np.diff(np.concatenate([[0.0], np.cumsum(p)])[starts])
    most = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        most[some] = np.maximum.reduceat(p, starts[:-1][some])
    return np.stack([np.ones(len(sizes)), np.log1p(np.maximum(total, 0)), most, 10 * total / np.maximum(sizes, 1)], axis=1)


def _toxic_words(words, buckets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Buckets that toxic documents favour."""
    pairs = np.unique(words.text * (1 << BITS) + buckets)
    held, by = pairs & ((1 << BITS) - 1), toxic[pairs >> BITS]
    bad = np.bincount(held[by], minlength=1 << BITS)
    good = np.bincount(held[~by], minlength=1 << BITS)
    share = toxic.mean()
    ratio = (bad / max(1, toxic.sum())) / ((good + 0.5) / max(1, (~toxic).sum()))
    total = np.maximum(bad + good, 1)
    evidence = bad * np.log(np.maximum(bad, 1) / (total * share)) + good * np.log(
        np.maximum(good, 1) / (total * (1 - share))
    )
    return (ratio >= LEAST_RATIO) & (2 * evidence >= LEAST_EVIDENCE)


def _fit_chain(words, buckets: Buckets, tags: np.ndarray, rounds: int) -> Model:
    """Weights by gradient ascent on the conditional likelihood, with adaptive steps."""
    size = 1 << BITS
    weights = np.zeros(4 * size + 1 + 4)
    weights[4 * size] = -4.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    same = words.text[1:] == words.text[:-1]
    seen_left, seen_right = buckets.word[:-1][same], buckets.word[1:][same]
    # a word seen in few documents has no weight of its own, nor on its neighbours: it would be learned by heart, and
    # the beginnings of words, which tell words not seen at all, would learn less
    often = np.bincount(np.unique(words.text * size + buckets.word) % size, minlength=size) >= LEAST_SEEN
    moved = np.bincount(2 * tags[:-1][same] + tags[1:][same], minlength=4)
    model = None
    for k in range(1, rounds + 1):
        own, stem, left, right = weights[: 4 * size].reshape(4, size)
        model = Model(own, stem, left, right, weights[4 * size], weights[-4:].reshape(2, 2), np.zeros(4))
        evidence = _evidence(model, words, buckets)
        forward, backward = _sweeps(evidence, words.text, model.moves)
        both = forward * backward
        surplus = tags - both / (1 + both)
        gradient = np.concatenate(
            [
                np.bincount(buckets.word, surplus, size) * often,
                np.bincount(buckets.stem, surplus, size),
                np.bincount(seen_left, surplus[1:][same], size) * often,
                np.bincount(seen_right, surplus[:-1][same], size) * often,
                [surplus.sum()],
                moved - _expected_moves(forward[:-1][same], backward[1:][same], evidence[1:][same], model.moves),
            ]
        )
        gradient -= 0.01 * weights
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        step = mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
        weights = weights + 0.2 * step
    return model


def _expected_moves(forward, backward, evidence, moves) -> np.ndarray:
    (m00, m01), (m10, m11) = np.exp(moves)
    after = np.exp(evidence) * backward
    weight = np.stack([np.full(len(forward), m00), m01 * after, forward * m10, forward * m11 * after])
    return (weight / weight.sum(axis=0)).sum(axis=1)


def _fit_score(figures: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(figures.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(figures @ w, -30, 30)))
        slope = figures.T @ (toxic - p) - 0.1 * w
        curve = (figures * (p * (1 - p))[:, None]).T @ figures + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of labelled texts."""
    words, buckets = _buckets(texts)
    toxic = np.asarray(toxic, bool)
    share = toxic.mean() if len(toxic) else 0.0
    if not len(buckets.word) or not 0 < share < 1:
        flat = np.zeros(1 << BITS)
        level = 30.0 if share else -30.0
        return Model(flat, flat, flat, flat, -30.0, np.zeros((2, 2)), np.array([level, 0, 0, 0]))
    favoured = [_toxic_words(words, b, toxic)[b] for b in buckets]
    tags = ((favoured[0] | favoured[1]) & toxic[words.text]).astype(np.int64)
    model = _fit_chain(words, buckets, tags, rounds)
    score = _fit_score(_figures(marginals(model, words, buckets), words.starts), toxic)
    light = {name: getattr(model, name).astype(np.float32) for name in ("own", "stem", "left", "right")}
    return model._replace(**light, score=score)


def _first(rows: DataFrame, most_docs: int, most_bytes: int) -> pa.Table:
    """The first rows by a hash of their ids, as many as fit the bounds."""
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).toArrow()
    return ordered.filter(pa.array(np.cumsum(ordered["size"].to_numpy()) <= most_bytes, pa.bool_()))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> pa.Table:
    """Texts and labels of at most so many documents and bytes, none of them held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    # chosen by sizes alone; only chosen texts are moved
    sizes = texts.select("doc_id", "row", F.octet_length("text").cast("bigint").alias("size")).join(known, "doc_id")
    fitting = sizes.where(F.col("size") <= sample_bytes // PARTS).groupBy("doc_id", "toxic")
    rows = fitting.agg(F.min(F.struct("row", "size")).alias("one")).select("doc_id", "toxic", "one.*")
    chosen = _first(rows, sample_docs, sample_bytes)
    for kind in sorted({0, 1} - set(chosen["toxic"].to_pylist())):
        more = _first(rows.where(F.col("toxic") == kind), max(1, sample_docs // PARTS), sample_bytes // PARTS)
        if more.num_rows:
            others = _first(rows.where(F.col("toxic") != kind), sample_docs - more.num_rows, sample_bytes - sample_bytes // PARTS)
            chosen = pa.concat_tables([others, more])
        elif not sizes.where(F.col("toxic") == kind).isEmpty():
            raise ValueError(f"all documents labelled toxic = {kind} are longer than {sample_bytes // PARTS} bytes")
    picked = docs.sparkSession.createDataFrame(
        list(zip(*(chosen[c].to_pylist() for c in ("doc_id", "row", "toxic")))), "doc_id bigint, row bigint, toxic int"
    )
    found = texts.join(F.broadcast(picked), ["doc_id", "row"])  # at most sample_docs rows are sent
    return found.dropDuplicates(["doc_id", "row"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toArrow()


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Code point ranges of the runs of toxic words."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [
        {"start": places[a][0], "end": places[b - 1][1], "probability": float(p[a:b].max())}
        for a, b in zip(*map(np.ndarray.tolist, ranges(p >= 0.5)))
    ]


def _score_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            words, buckets = _buckets(batch["text"])
            p = marginals(model, words, buckets)
            logits = _figures(p, words.starts) @ model.score
            texts, spans = batch["text"], []
            for k, (a, b) in enumerate(zip(words.starts.tolist(), words.starts[1:].tolist())):
                some = b > a and p[a:b].max() >= 0.5
                spans.append(_spans(texts[k].as_py(), p[a:b]) if some else [])
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores), pa.array(spans, _SPANS)], ["doc_id", "score", "spans"]
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # three weights for each of 2 ** BITS buckets
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(
        _score_rows(sent), "doc_id bigint, score double, spans array<struct<start:int,end:int,probability:double>>"
    )


def detect(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Fit on the labelled sample and score all of ``docs``."""
    sample = labelled_sample(docs, labels, **bounds)
    model = fit(sample["text"], sample["toxic"].to_numpy())
    return score(docs, model)
