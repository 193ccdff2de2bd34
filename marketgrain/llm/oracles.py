"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from itertools import combinations

from marketgrain.llm.quality_rules import RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
firsts AS (SELECT passage, min(doc_id) AS owner FROM win GROUP BY passage),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (passage) WHERE owner < doc_id)),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

_BLOCKS = ((1, 2), (3, 5), (6, 7), (8, 10), (11, 13))


def _decontamination() -> str:
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({folded}, '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"

    def windows(key: str, source: str) -> str:
        return (
            f"SELECT {key}, i, n, list_slice(words, i, i + 12) AS w FROM (SELECT {key}, words, len(words) AS n, "
            f"unnest(range(1, len(words) - 11)) AS i FROM (SELECT {key}, {words} AS words FROM {source}))"
        )

    masks = []
    for kept in combinations(range(5), 3):
        key = " || ' ' || ".join(f"array_to_string(list_slice(w, {_BLOCKS[b][0]}, {_BLOCKS[b][1]}), ' ')" for b in kept)
        masks.append(
            f"SELECT d.doc_id, d.i, t.item_id, t.i AS j, t.n, d.w AS dw, t.w AS tw FROM (SELECT *, {key} AS k FROM dwin) d "
            f"JOIN (SELECT *, {key} AS k FROM twin) t USING (k)"
        )
    equal = "len(list_filter(range(1, 14), lambda p: dw[p] = tw[p]))"
    return f"""
WITH dwin AS ({windows("doc_id", "documents")}), twin AS ({windows("item_id", "benchmark")}),
hit AS (SELECT DISTINCT doc_id, i, item_id, j, n, dw, tw FROM ({" UNION ALL ".join(masks)}) WHERE {equal} >= 11),
place AS (
  SELECT DISTINCT doc_id, item_id, i + p - 1 AS place, max(dw[p] = tw[p]) AS same
  FROM (SELECT *, unnest(range(1, 14)) AS p FROM hit) GROUP BY doc_id, item_id, i + p - 1),
counted AS (
  SELECT doc_id, item_id, count(*) AS n_overlap_words, count(*) FILTER (same) AS n_equal_words
  FROM place GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(min(i) - 1 AS BIGINT) AS doc_start, CAST(max(i) + 12 AS BIGINT) AS doc_end,
  any_value(n_overlap_words) AS n_overlap_words, any_value(n_equal_words) AS n_equal_words,
  CAST(any_value(n) AS BIGINT) AS n_item_words
FROM hit JOIN counted USING (doc_id, item_id) GROUP BY doc_id, item_id
"""


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    broken = []
    for rule in RULES:
        if rule.low is not None:
            broken.append(f"coalesce({rule.figure} < {rule.low}, false)")
        if rule.high is not None:
            broken.append(f"coalesce({rule.figure} > {rule.high}, false)")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 2), ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words, length(array_to_string(lines, '')) AS n_line_chars,
    length(array_to_string(list_distinct(lines), '')) AS n_kept_line_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)),
g AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio,
    (n_line_chars - n_kept_line_chars) / nullif(n_line_chars, 0) AS dup_line_char_ratio,
    n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(broken)}) AS kept
FROM g
"""


_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
firsts AS (SELECT key, min(doc_id) AS owner FROM k GROUP BY key),
judged AS (SELECT k.*, length(key) < 10 OR owner = doc_id AS stays FROM k JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^ \t\n\v\f\r]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (
  SELECT a, b FROM shared JOIN n nx ON nx.doc_id = a JOIN n ny ON ny.doc_id = b
  WHERE 100 * n_both >= 80 * (nx.n + ny.n - n_both)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reach JOIN edge ON other = a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)
"""

_COLLOCATIONS = rf"""
WITH piece AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\n\v\f\r]')) AS piece
    FROM documents)),
words AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM piece GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS part, array_to_string(list_slice(w, j + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = part JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_size AS (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM inner_size) GROUP BY ALL),
free AS (
  SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRING,
    "op3_decontamination": _decontamination(),
    "op6_quality_rules": _quality(),
    "op7_line_dedup": _LINES,
    "op12_ngram_jaccard_join": _JACCARD,
    "op13_phrase_collocations": _COLLOCATIONS,
}
