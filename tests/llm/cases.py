"""Hard documents: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, kept string, line int, row string, shard string, fp string, ids string, "
    "n_words string, n_tokens string"
)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßlmnor") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(8)
    rows: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \t\n \x0b"),
        (4, "one"),
        (5, "One two"),
        (6, "one TWO three"),
        (7, "same " * 300),
        (8, "\n".join([line, prose(20), line, "short", line.upper()])),
        (9, "\n".join(["short", "  " + line + "\t", prose(30)])),
        (10, prose(40) + " " + passage + "\n" + prose(40)),
        (11, passage),
        (12, prose(15) + "  " + passage.replace(" ", "\n\t") + " " + prose(3)),
        (13, "x" * 3000 + " " + prose(5)),
        (14, prose(20_000)),
        (15, "### $$$ %%% &&& " * 30),
        (16, "a b   c<|endoftext|>d  e\x1cf\x85g 'll don't \U0001f600́ 1²½"),
        (17, "\n\n\n"),
        (None, passage),
        (None, None),
        (-3, prose(30) + " " + passage[:200]),
    ]
    copy = prose(120)
    rows += [(100 + k, copy) for k in range(30)]
    rows += [(200 + k, copy.replace(" ", f" {k} ", 1)) for k in range(10)]
    rows += [(300, prose(50)), (300, prose(50))]  # one id, two texts
    rows += [(301, copy), (301, copy)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, x, "en", "k", 1, "r", "s", "f", "i", "w", "t") for i, x in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5)
