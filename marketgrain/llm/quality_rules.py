"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are runs without the six ASCII white-space characters. Every figure is a built-in expression over
the whole text; there are no user functions and no shuffle. A null text is an empty text. A figure whose
divisor is zero is null, and a null figure breaks no rule. Input columns other than ``text`` pass through;
a figure replaces an input column of the same name. Rows are judged each, so repeated rows, ties and rows without an
id give no trouble; an empty table gives an empty table.

Repeated lines weigh by their characters: a short heading that returns in a long text is no sign of a bad one. Stop
words weigh by their share of all words.

Repeated word windows are found inside a row: each three-word window becomes one number, its hash with
the low bits replaced by its position. Sorting the numbers puts equal windows side by side; neighbours
with equal hash bits are compared by their words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import SPACES, text_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in that is with for as on by this be are was from it at or an "
    "der die das und in den von zu mit ist des im für auf dem nicht ein eine als auch "
    "le la les de des et en un une du que qui dans pour par sur est au avec pas "
    "el los las que y en un una por con para del se es al lo como más su no"
).split()


_STOP_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


class Rule(NamedTuple):
    """A document breaks the rule when its figure lies outside the closed range."""

    figure: str
    low: float | None
    high: float | None


#: The base rules, whose breach is reported on its own.
BASE_RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_word_ratio", None, 0.5),
)
RULES = (
    Rule("mean_word_length", 2, 15),
    Rule("symbol_ratio", None, 0.1),
    Rule("dup_line_char_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.05, None),
)

# The figures, each a projection over the ones before it.
_STEPS: tuple[dict[str, str], ...] = (
    {
        "qr_words": "CASE WHEN qr_core = '' THEN CAST(array() AS array<string>) "
        "ELSE split(qr_core, '[\\\\x20\\\\x09-\\\\x0D]+', -1) END",
        "qr_lines": "filter(split(qr_text, '\\n', -1), x -> btrim(x, qr_spaces) != '')",
    },
    {
        "n_words": "CAST(size(qr_words) AS bigint)",
        "word_chars": "CAST(length(translate(qr_core, qr_spaces, '')) AS bigint)",
        "n_symbols": "CAST(length(qr_core) - length(translate(qr_core, qr_symbols, '')) AS bigint)",
        "n_lines": "CAST(size(qr_lines) AS bigint)",
        "n_dup_lines": "CAST(size(qr_lines) - size(array_distinct(qr_lines)) AS bigint)",
        "n_line_chars": "CAST(length(array_join(qr_lines, '')) AS bigint)",
        "n_dup_line_chars": "CAST(length(array_join(qr_lines, '')) - length(array_join(array_distinct(qr_lines), '')) AS bigint)",
        "n_stop_words": f"CAST(size(filter(qr_words, w -> w IN ({_STOP_LIST}))) AS bigint)",
        "qr_mask": "shiftleft(1L, length(bin(size(qr_words)))) - 1L",
    },
    {
        "qr_sorted": "CASE WHEN n_words < 4 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform("
        "sequence(0, size(qr_words) - 3), "
        "i -> (xxhash64(qr_words[i], qr_words[i + 1], qr_words[i + 2]) & ~qr_mask) | i)) END",
    },
    {
        "qr_equal": "CASE WHEN n_words < 4 THEN CAST(array() AS array<int>) ELSE filter("
        "sequence(0, size(qr_sorted) - 2), "
        "j -> ((qr_sorted[j] ^ qr_sorted[j + 1]) & ~qr_mask) = 0 AND "
        "slice(qr_words, CAST(qr_sorted[j] & qr_mask AS int) + 1, 3) = "
        "slice(qr_words, CAST(qr_sorted[j + 1] & qr_mask AS int) + 1, 3)) END",
    },
    {
        "qr_twice": "sort_array(array_distinct(flatten(transform(qr_equal, "
        "j -> array(qr_sorted[j] & qr_mask, qr_sorted[j + 1] & qr_mask)))))",
    },
    {
        "n_repeat_words": "CASE WHEN size(qr_twice) = 0 THEN 0L ELSE aggregate(zip_with("
        "slice(qr_twice, 1, size(qr_twice) - 1), slice(qr_twice, 2, size(qr_twice) - 1), "
        "(a, b) -> least(3L, b - a)), 3L, (s, x) -> s + x) END",
    },
    {
        "mean_word_length": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "dup_line_char_ratio": "n_dup_line_chars / nullif(n_line_chars, 0)",
        "stop_word_ratio": "n_stop_words / nullif(n_words, 0)",
        "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)",
    },
)
FIGURES = [name for step in _STEPS for name in step if not name.startswith("qr_")]


def _broken(rules: tuple[Rule, ...]) -> Column:
    breaches = [F.lit(False)]
    for rule in rules:
        figure = F.col(rule.figure)
        if rule.low is not None:
            breaches.append(F.coalesce(figure < rule.low, F.lit(False)))
        if rule.high is not None:
            breaches.append(F.coalesce(figure > rule.high, F.lit(False)))
    broken = breaches[0]
    for breach in breaches[1:]:
        broken = broken | breach
    return broken


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``docs`` with every figure, ``base_failed`` and ``kept``."""
    constants = {
        "qr_spaces": F.lit(SPACES),
        "qr_symbols": F.lit(SYMBOLS),
        "qr_text": text_of(),
        "qr_core": F.btrim(text_of(), F.lit(SPACES)),
    }
    through = [c for c in docs.columns if c not in FIGURES and c not in ("base_failed", "kept")]
    judged = docs.select(*[F.col(f"`{c}`") for c in through]).withColumns(constants)
    for step in _STEPS:
        judged = judged.withColumns({name: F.expr(text) for name, text in step.items()})
    judged = judged.withColumn("base_failed", _broken(base))
    # an expression that is not deterministic keeps filters on the verdict above the figures; pushed below them, the
    # optimizer would repeat every figure inside the condition
    verdict = ~F.col("base_failed") & ~_broken(rules) & (F.spark_partition_id() >= 0)
    judged = judged.withColumn("kept", verdict)
    return judged.select(*[F.col(f"`{c}`") for c in through], *FIGURES, "base_failed", "kept")


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with the columns of ``docs``."""
    other = [c for c in docs.columns if c != "text"]
    judged = judge(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in other]).alias("qr_other")), rules)
    given = [F.col("text") if c == "text" else F.col(f"qr_other.`{c}`").alias(c) for c in docs.columns]
    return judged.where("kept").select(*given)
