"""Each corpus operator against a brute-force version on hard documents, and on no documents at all."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from marketgrain.llm import bpe, decontaminate, html, line_dedup, packing, quality_rules, simhash, substring
from marketgrain.llm import token_counts, tokens, toxicity
from marketgrain.llm.queries import MERGES, RANKS
from tests.llm.cases import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return documents(spark, [])


def words_of(text):
    return WORD.findall(text or "")


# ---- substring dedup ---------------------------------------------------------------------------


def without_repeats(rows, window=13):
    owner = {}
    for i, x in rows:
        w = words_of(x)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                owner[key] = min(owner.get(key, i), i)
    for i, x in rows:
        w = words_of(x)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        yield i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)


@pytest.mark.parametrize("shard_bytes", [2_000, 1 << 22])
def test_substring(docs, shard_bytes):
    found = substring.remove_repeats(docs, shard_bytes=shard_bytes).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found)
    assert got == Counter(without_repeats(texts()))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)


# ---- BPE ---------------------------------------------------------------------------------------


def test_bpe(docs):
    library = Tokenizer.from_file(MERGES)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_and_decode(docs, MERGES, rows=7).collect())
    want = Counter()
    for i, x in texts():
        ids = library.encode(x or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_fuzz():
    model, library, rng = bpe.load(MERGES), Tokenizer.from_file(MERGES), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "ing", "'s", "é", "<|endoftext|>", "1", "²", "中", "\x1c", " ", "%"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    many += ["".join(rng.choice("abcdeinst") for _ in range(rng.randint(1, 90))) for _ in range(500)]
    got = [np.frombuffer(ids, np.int32).tolist() for ids in model.encode(many)]
    assert got == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]


# ---- decontamination ---------------------------------------------------------------------------


def folded(text):
    text = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text or "").encode().lower()
    return text.split()


@pytest.mark.parametrize("slice_words", [60, 500_000])
def test_decontamination(spark, docs, slice_words):
    rng = random.Random(9)
    source = dict(r for r in texts() if r[0] is not None and r[0] < 20)
    taken = source[10].split()[45:80]
    for place in (3, 9, 20, 27):  # two substitutions in any thirteen words at most
        taken[place] = "other"
    items = [(1, " ".join(taken)), (2, " ".join(source[14].split()[500:540]).encode().upper().decode()), (3, None), (4, ""), (5, "few words")]
    items += [(6, " ".join("".join(rng.choice("xyz") for _ in range(5)) for _ in range(40))), (7, " ".join(taken))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.overlaps(docs, table, slice_words=slice_words).collect()
    want = set()
    for i, x in texts():
        w = folded(x)
        for j, y in items:
            v = folded(y)
            starts = [
                (a, b)
                for b in range(len(v) - 12)
                for a in range(len(w) - 12)
                if w[a] == v[b] or w[a + 1] == v[b + 1] or w[a + 2] == v[b + 2]
                if sum(p != q for p, q in zip(w[a : a + 13], v[b : b + 13])) <= 2
            ]
            if starts:
                inside = {a + p for a, _ in starts for p in range(13)}
                want.add((i, j, min(inside), max(inside) + 1, len(inside)))
    assert {(r.doc_id, r.item_id, r.doc_start, r.doc_end, r.n_overlap_words) for r in rows} == want
    assert {10, 14} <= {r.doc_id for r in rows}
    kept = decontaminate.without_overlaps(docs, table)
    rows = [(k, x) for k, (_, x) in enumerate(texts())]  # every row judged by its own text
    numbered = decontaminate.overlaps(documents(spark, rows), table, slice_words=slice_words)
    hit = {r.doc_id for r in numbered.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert {texts()[k][0] for k in hit} == {i for i, *_ in want}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for k, r in enumerate(texts()) if k not in hit)


# ---- pages -------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>t</title><script>var a='</p><p>x';</script></head><body class='notice'><nav><ul><li>menu</ul></nav>"
    "<div class='cookie-banner'>cookies</div><article><header><h1>Title &amp; more</h1></header><p>One<br>two &lt;3"
    "<p>Three\n four <b>five</b><!-- no --> six<aside>side</aside><form>mail</form><div id='comments'>hey</div></article>"
    "<footer>foot</footer>"
)


def test_page_with_content():
    lines, unmarked = html.main_lines(PAGE)
    assert lines == ["Title & more", "One two <3", "Three four five six"] and not unmarked


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<a b='", "&amp", "<p><p></p>a<b>c"])
def test_odd_pages(page):
    assert html.main_lines(page)[0] in ([], ["<"], ["<p"], ["<a b='"], ["&"], ["ac"])


def test_common_lines():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html.common_lines(a, b)) == best[-1][-1]


def test_pages(spark):
    plain = lambda n: f"<div>Site name</div><p>Text {n}</p><p>More {n}</p><p>End {n}</p><div>Imprint</div>"
    rows = [(k, f"https://h.example/a/{k}", plain(k), "x") for k in range(20)]
    rows += [(30, "https://h.example/a/9", plain(9), "x"), (31, "https://other.example/a", plain(31), "x")]
    rows += [(32, None, plain(32), "x"), (33, "https://h.example/b", None, "x"), (34, "https://h.example/a/3", PAGE, "x")]
    rows += [(35, "https://h.example/c", PAGE, "x"), (35, "https://h.example/c", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(4)
    found = html.extract_text(pages).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r.text for r in found}
    assert all(r.n_chars == len(r.text) for r in found)
    assert all(got[k] == f"Text {k}\nMore {k}\nEnd {k}" for k in range(20))
    assert got[31].startswith("Site name") and got[32].startswith("Site name") and got[33] == ""
    assert got[34] == got[35] == "Title & more\nOne two <3\nThree four five six"
    assert html.extract_text(pages.limit(0)).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------


def test_chain_marginals():
    rng = np.random.default_rng(1)
    evidence, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    text = np.array([0, 0, 0, 1, 1, 1, 2])
    forward, backward = toxicity._sweeps(evidence, text, moves)
    p = forward * backward / (1 + forward * backward)
    weight = np.zeros(7)
    total = 0.0
    for code in range(1 << 7):
        tags = [(code >> k) & 1 for k in range(7)]
        score = sum(e for e, t in zip(evidence, tags) if t)
        score += sum(moves[tags[k], tags[k + 1]] for k in range(6) if text[k] == text[k + 1])
        total += np.exp(score)
        weight += np.exp(score) * np.array(tags)
    assert np.allclose(p, weight / total)


def test_toxicity(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeiourstn") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Stinker,", "rotten", "vermin!"]))
        rows.append((i, " ".join(words), "src"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "rotten vermin stinker", "s"), (1002, "Rotten " * 20_000, "s")]
    labels += [(1000, 1, None), (None, 1, 1), (3, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.detect(docs, table).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    text = {i: x for i, x, _ in rows}
    spans = [text[i][s.start : s.end].lower() for i in held for s in found[i].spans]
    assert {w for s in spans for w in re.findall("[a-z]+", s)} <= {"stinker", "rotten", "vermin"} and spans
    assert found[None].score > 0.5 > found[1000].score == found[1001].score
    assert toxicity.detect(docs, table.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.detect(docs.limit(0), table).count() == 0


def test_inflected_words_share_what_is_learned(spark):
    """Held-out documents hold forms of the toxic words that no learning document has."""
    rng = random.Random(7)
    ends = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        words = ["".join(rng.choice("aeiourstn") for _ in range(7)) for _ in range(rng.randint(20, 60))]
        held = zlib.crc32(str(i).encode()) % 5 == 0
        for _ in range(4 * (i % 4 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(["réeux", "bomen"]) + rng.choice(ends[300:] if held else ends[:300]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = {r.doc_id: r.score for r in toxicity.detect(docs, table).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95


# ---- quality rules -----------------------------------------------------------------------------


def test_a_short_repeated_heading_keeps_a_long_text(spark):
    """Repeated lines weigh by their characters, stop words by their share."""
    rng = random.Random(2)
    words = [*"the of and to in".split(), *("".join(rng.choice("abcdeiou") for _ in range(6)) for _ in range(40))]
    prose = lambda n, share: " ".join(rng.choice(words[:5]) if rng.random() < share else rng.choice(words[5:]) for _ in range(n))
    line = prose(30, 0.3)
    rows = [(1, f"Part one\n{prose(80, 0.3)}\nPart one"), (2, f"{line}\n{prose(40, 0.3)}\n{line}\n{line}"), (3, prose(80, 0.0)), (4, None)]
    kept = {r.doc_id for r in quality_rules.accepted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1}


def test_quality(docs):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality_rules.judge(docs).collect()
    )
    want = Counter()
    for i, x in texts():
        w, x = words_of(x), x or ""
        times = Counter(zip(w, w[1:], w[2:]))
        repeated = [False] * len(w)
        for k, key in enumerate(zip(w, w[1:], w[2:])):
            if times[key] > 1:
                repeated[k : k + 3] = [True] * 3
        lines = [y for y in x.split("\n") if words_of(y)]
        symbols = sum(c in "#*$%&|<>" for c in x)
        failed = len(w) < 50 or 100 * sum(repeated) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), sum(repeated), failed] += 1
    assert got == want
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.judge(docs).where("kept").count()


# ---- line dedup --------------------------------------------------------------------------------


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@pytest.mark.parametrize(("batches", "fan_out"), [(1, 2), (4, 2), (7, 3)])
def test_lines(docs, batches, fan_out):
    first = {}
    for i, x in texts():
        for line in (x or "").split("\n"):
            if i is not None:
                first[line_key(line)] = min(first.get(line_key(line), i), i)
    want = Counter()
    for i, x in texts():
        lines = (x or "").split("\n")
        kept = [y for y in lines if i is None or len(line_key(y)) < 10 or first[line_key(y)] == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    found = line_dedup.dedup_lines(docs, batches, fan_out)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()) == want


def test_skewed_ids_fill_the_batches_alike(spark):
    rows = [(10**12 + k, f"a line that is long enough {k % 50}\nshort") for k in range(400)] + [(1, "a line that is long enough 7")]
    docs = documents(spark, rows)
    found = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(found.values()) == 400 - 49 and found[1] == 0 and found[10**12 + 7] == 1


def test_runs_lie_dealt_by_key(docs):
    runs = line_dedup.LineRuns()
    runs.add(docs.where("doc_id < 100"))
    fresh = line_dedup.line_keys(docs.where("doc_id >= 100")).groupBy("key_a", "key_b").count()
    joined = fresh.join(runs.runs[0][0].hint("merge"), ["key_a", "key_b"], "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key_a") == 1  # of the batch's own keys


def test_runs_are_compacted(docs):
    runs = line_dedup.LineRuns(fan_out=2)
    for k in range(4):
        runs.add(docs.where(f"doc_id div 30 = {k}"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]


# ---- near duplicates ---------------------------------------------------------------------------


def fingerprint(text):
    lowered = words_of((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    shingles = [" ".join(lowered[k : k + 3]) for k in range(max(1, len(lowered) - 2))] if lowered else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_linked(rows):
    """Smallest id reachable over links of three bits."""
    prints = [fingerprint(x) for _, x in rows]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = i if least[label[k]] is None else min(least[label[k]], i)
    return [(i, prints[k], least[label[k]]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("cell", [2, 4096])
def test_near_duplicates(docs, cell):
    rows = [r for r in texts() if r[0] != 14]
    found = simhash.near_duplicates(docs.where("doc_id IS NULL OR doc_id != 14"), cell=cell).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == Counter(least_linked(rows))


def test_links_of_a_large_group(spark):
    rng = random.Random(6)
    prints = {0}
    for _ in range(400):  # a drifting chain of close fingerprints and a cloud around it
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), cell=32)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    label = {p: p for (p,) in signed}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if ((a ^ b) % (1 << 64)).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert all(roots.get(p, p) == low for p, low in label.items())


# ---- token counts and packing ------------------------------------------------------------------


def test_token_counts(docs, no_docs):
    encode = tokens.encoding(RANKS).encode_ordinary
    lengths = np.array([len(encode(x or "")) for _, x in texts()])
    limits = token_counts.limit_table(token_counts.length_histogram(docs, RANKS), block=16)
    rows = limits.collect()
    assert [r.context_limit for r in sorted(rows)] == sorted(set(lengths.tolist()))
    for r in rows:
        kept = int(np.minimum(lengths, r.context_limit).sum())
        assert (r.tokens_kept, r.tokens_lost) == (kept, int(lengths.sum()) - kept)
        assert r.docs_over == (lengths > r.context_limit).sum() and r.n_docs == (lengths == r.context_limit).sum()
        assert r.docs_within == len(lengths) - r.docs_over and r.tokens_within == lengths[lengths <= r.context_limit].sum()
    assert token_counts.quantile(limits, 0.5).first().n_tokens == np.sort(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.limit_table(token_counts.length_histogram(no_docs, RANKS)).count() == 0


def test_best_fit():
    rng = random.Random(8)
    for _ in range(100):
        lengths, free = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))], []
        for size in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= size]
            if fits:
                free[free.index(min(fits))] -= size
            else:
                free.append(20 - size)
        rows = packing.best_fit(lengths, 20)
        assert sorted(20 - sum(lengths[p] for p in row) for row in rows) == sorted(free)
        assert sorted(p for row in rows for p in row) == list(range(len(lengths)))


def test_packing(docs, no_docs, tmp_path):
    packed = packing.pack(docs, RANKS, context=64, shard_bytes=10_000)
    encoding, pieces = tokens.encoding(RANKS), defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and (ids[r.n_tokens :] == packing.PADDING).all()
        assert r.cu_seqlens == [0, *np.cumsum([s.length for s in r.segments]).tolist()] and r.resets == r.cu_seqlens[:-1]
        for s, at in zip(r.segments, r.resets):
            pieces[s.doc_id].append((s.offset, tuple(ids[at : at + s.length].tolist())))
    rows, want = texts(), defaultdict(list)
    for i, x in rows:
        ids = encoding.encode_ordinary(x or "")
        want[i] += [(at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64)]
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items() if p}
    packing.write_matrices(packed, str(tmp_path / "packed"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "packed")).count() == packed.count()
    assert packing.pack(no_docs, RANKS).count() == 0


# ---- no documents ------------------------------------------------------------------------------


def test_empty_tables(spark, no_docs, docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert substring.remove_repeats(no_docs).count() == 0
    assert bpe.encode_and_decode(no_docs, MERGES).count() == 0
    assert decontaminate.overlaps(docs, items).count() == 0
    assert decontaminate.without_overlaps(no_docs, items).count() == 0
    assert quality_rules.judge(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.first_of_each_group(no_docs).count() == 0


def test_all_null_texts(spark):
    docs = documents(spark, [(None, None), (1, None), (1, None)])
    assert {r.kept for r in substring.remove_repeats(docs).collect()} == {""}
    assert {r.n_lines for r in line_dedup.dedup_lines(docs).collect()} == {1}
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1}
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
