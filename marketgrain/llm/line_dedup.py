"""Line dedup over batches of documents with levelled sorted runs of line keys.

The key of a line is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at
least 10 characters found in several documents stays only in the smallest ``doc_id`` that holds it, with
all its lines there; shorter lines always stay.

Batches come in ascending ``doc_id`` order. A run is a table of the keys that a batch was the first to
hold, with the smallest document of each, sorted by key. A new batch is anti-joined with the runs and adds
its own run. When a level holds ``FAN_OUT`` runs they are merged into one of the next level, so the number
of runs grows with the logarithm of the number of batches and a key is rewritten once per level.

Only DataFrame functions are used. Keys are counted before they are shuffled, so a line that most
documents hold is one row per task there. The join that marks lines keeps its sides splittable; adaptive
execution deals a frequent key to several tasks. Runs are written to the shared folder by key, so that a new batch,
dealt by key for its own counts, meets them without another shuffle.

A null or empty text is one empty line. Documents with a null ``doc_id`` keep all lines and make others
lose none. Rows that repeat a ``doc_id`` are one document. Keys are compared by 128 bits of hashes. Columns other
than ``doc_id`` and ``text`` pass through and may have any name; those named like a result column are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import SPACES, stored_by_key, text_of, whole_rows

MIN_CHARS = 10
FAN_OUT = 2
BATCHES = 4

_KEY = ["key_a", "key_b"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a long enough key: ``doc_id, row, line, key_a, key_b``."""
    folded = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    keys = F.transform(_lines(folded), lambda x: F.btrim(x, F.lit(SPACES)))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(text_of()).alias("row"), F.posexplode(keys).alias("line", "key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "line", F.xxhash64("key").alias("key_a"), F.xxhash64(F.lit(1), "key").alias("key_b"))
    )


class LineRuns:
    """The keys of all batches so far: each run dealt by key to buckets, sorted, and as plain files."""

    def __init__(self, fan_out: int = FAN_OUT, min_chars: int = MIN_CHARS) -> None:
        self.fan_out, self.min_chars = fan_out, min_chars
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = []

    @property
    def runs(self) -> list[tuple[DataFrame, DataFrame]]:
        return [run for level in self.levels for run in level]

    def _write(self, level: int, keys: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored_by_key(keys, f"line-run-{level}", _KEY))

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_out:
                merged = runs[0][1]
                for _, files in runs[1:]:
                    merged = merged.unionByName(files)
                buckets = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                self._write(level + 1, merged.repartition(buckets, *_KEY))
                runs.clear()

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch, whose ids exceed those of earlier batches, and return it with its lines judged.

        The result has the columns of ``docs`` and ``n_lines, n_dropped, kept``.
        """
        keys = line_keys(docs, self.min_chars)
        # dealt by key once for the counts; the runs lie dealt the same way, so the anti-joins move nothing
        fresh = keys.groupBy(*_KEY).agg(F.min("doc_id").alias("first"))
        for buckets, _ in self.runs:
            fresh = fresh.join(buckets.hint("merge"), _KEY, "left_anti")
        self._write(0, fresh)
        # a frequent key is many rows here, so both sides are shuffled and adaptive execution can split it
        known = self.runs[0][1]
        for _, files in self.runs[1:]:
            known = known.unionByName(files)
        marked = keys.join(known, _KEY).where(F.col("doc_id") > F.col("first")).select("doc_id", "row", "line")
        judged = _without(docs, marked)
        self._compact()
        return judged


def _without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without the marked lines."""
    gone = marked.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))
    through = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("row"), whole_rows(docs.select(*[f"`{c}`" for c in through])).alias("held"))
    joined = rows.join(gone, ["doc_id", "row"], "left")
    text = F.coalesce(F.col("held").getField("text"), F.lit(""))
    lines = joined.select("held", "gone", text.alias("text"), _lines(text).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    judged = lines.select(
        "held",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        kept.alias("kept"),
    )
    results = [F.col(c) for c in ("n_lines", "n_dropped", "kept")]
    return judged.select(*[F.col("held").getField(c).alias(c) for c in through], *results)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fan_out: int = FAN_OUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """All of ``docs`` judged in ``batches`` ranges of ``doc_id``; the cut points don't change the result."""
    runs = LineRuns(fan_out, min_chars)
    shares = [k / batches for k in range(1, batches)]
    # about as many documents in each batch, however the ids lie
    found = docs.agg(F.percentile_approx(F.col("doc_id"), shares or [0.5], 1000)).first()[0]
    if found is None:
        return runs.add(docs)
    cuts = sorted({int(c) for c in found}) if shares else []
    below = F.col("doc_id").isNull()  # documents without an id go with the first batch
    judged = None
    for cut in [*cuts, None]:
        reached = F.lit(True) if cut is None else F.col("doc_id").isNull() | (F.col("doc_id") < cut)
        batch = runs.add(docs.where(reached if judged is None else reached & ~below))
        judged = batch if judged is None else judged.unionByName(batch)
        below = reached
    return judged
