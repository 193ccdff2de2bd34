"""Main text of web pages by page structure and nearest-URL page differencing.

A page is read as blocks, each with the region it stands in: boilerplate (menus, page headers and footers,
sidebars, notices, adverts, forms, comments, scripts), content (an article or main element) or unmarked.
Boilerplate goes. Content, where a page has any, is its main text. Class and id names alone never drop a main element,
nor the articles of a page that has no other content.

Of articles, those named as a teaser or an advert count only where a page has no other, reader comments never.
Elements hidden by an attribute or their own style are left out.

Every page is compared with its neighbours: pages that mark content, and the others, are sorted by host and URL path,
and their lines are aligned by longest common subsequence with those of the two adjacent pages of the host on either side.

On pages that mark no content the adjacent page whose path agrees longer decides, and shared lines go as the host's
template. A pair that shares most of its lines, also of those that a further neighbour doesn't share, holds copies
of one text; then the next neighbour decides, and if all are copies, nothing goes.

On pages that mark content, an article or main element goes as the host's template if two neighbours of
another text share all of its lines. Other elements stay whole, lines that an article has in common with another too. What
goes is less than half of the lines; where it would be more, copies of one text are nearby, and nothing goes.

Only line hashes are sorted, by range, so a host with most of the pages spreads over many tasks, and each
range learns its outer neighbours from four rows per range. The result doesn't depend on the cuts.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one
newline. A null or empty page has an empty text. Pages without a host are compared with nothing. Repeated
rows stay. Columns other than ``page_id, url, html`` pass through, except ``text`` and ``n_chars``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.llm.common import by_bytes, stored

#: Share of a page's lines in its neighbour from which the two hold copies of one text.
COPY_SHARE = 0.8
#: Pages compared with their neighbours at once.
PAIR_ROWS = 256

# Element names by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe math noembed noframes noscript object script style svg template textarea title".split())
SELF_CLOSING_TAGS = frozenset(("math", "svg"))
DROPPED_TAGS = frozenset("aside button dialog footer form head input menu nav search select".split())
CONTENT_TAGS = frozenset(("article", "main"))
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent "
    "commentform commentlist cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promoted related replies respond share sharing sidebar social "
    "sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
#: Names of what readers wrote; an article of that name is never the page's text.
READER_NAMES = frozenset("comment commentform commentlist comments disqus replies reply respond".split())

#: Words beside a dropped name that leave its sense; words before one that turn it.
LAYOUT_NAMES = frozenset(
    "area bar big block body bottom box button buttons card cards col column container desktop header holder icons info "
    "inner item items large law left link links list medium message mobile outer overlay panel posts right row section "
    "slot small sticky title top unit wide wrap wrapper zone".split()
)
TURNED_NAMES = frozenset("has no with without".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OTHER = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?/][^>]*+>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")

# NAMED is boilerplate by a class or id alone, SPARE an article inside of it.
BOILERPLATE, UNMARKED, CONTENT, NAMED, SPARE = 0, 1, 2, 3, 4


def _named_by(name: str, wanted: frozenset[str]) -> bool:
    """Whether a class or an id, by its last word or by all words, is one of ``wanted``."""
    words = _NAME.findall(name)
    if not words or words[0] in TURNED_NAMES:
        return False
    return words[-1] in wanted or (
        words[0] in wanted and all(w in wanted or w in LAYOUT_NAMES or w.isdigit() for w in words[1:])
    )


def _region(tag: str, attributes: str, outer: int) -> int:
    """The region inside an element that stands in the region ``outer``."""
    inside = outer in (CONTENT, SPARE)
    if outer == BOILERPLATE or tag in DROPPED_TAGS or tag == "header" and not inside:
        return BOILERPLATE
    given = {}
    if attributes.strip():
        given = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if tag in ("body", "html"):
        return CONTENT if given.get("role") == "main" else outer
    if given.get("role") in DROPPED_ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        return BOILERPLATE
    if "style" in given and _HIDDEN.search(given["style"]):
        return BOILERPLATE
    if tag == "main" or given.get("role") == "main":
        return CONTENT
    names = given.get("class", "").split() + given.get("id", "").split()
    dropped = any(_named_by(name, DROPPED_NAMES) for name in names)
    if tag == "article" and not inside:
        # a teaser or an advert only where the page has no other article, and never a reader's comment
        if any(_named_by(name, READER_NAMES) for name in names):
            return BOILERPLATE
        return SPARE if dropped or outer == NAMED else CONTENT
    return NAMED if dropped else outer


def blocks(html: str) -> list[tuple[int, int, str]]:
    """Region, number of the innermost content element (0 outside) and text of each block outside boilerplate, in page order."""
    found: list[tuple[int, int, str]] = []
    open_tags: list[tuple[str, int, int]] = []  # with the region and the element inside
    depth: Counter[str] = Counter()  # open elements by name
    region, element, elements, parts, at = UNMARKED, 0, 0, [], 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((region, element, text))
            parts.clear()

    def close(tag: str) -> None:
        nonlocal region, element
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] == tag:
                _, outer, outer_element = open_tags[k - 1] if k else ("", UNMARKED, 0)
                if tag in BLOCK_TAGS or outer != region:
                    flush()
                for name, _, _ in open_tags[k:]:
                    depth[name] -= 1
                del open_tags[k:]
                region, element = outer, outer_element
                return

    while at < len(html):
        mark = html.find("<", at)
        if mark != at:
            stop = mark if mark >= 0 else len(html)
            if region not in (BOILERPLATE, NAMED):
                parts.append(html[at:stop])
            at = stop
            continue
        match = _TAG.match(html, at)
        if match is None:
            other = _OTHER.match(html, at)
            if other is None and region not in (BOILERPLATE, NAMED):
                parts.append("<")
            at = other.end() if other else at + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            if tag in BLOCK_TAGS:
                flush()
            if depth[tag] and (tag in BLOCK_TAGS or open_tags[-1][0] == tag):
                close(tag)
            continue
        if tag in SELF_CLOSING_TAGS and match[3].endswith("/"):
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if depth["p"]:
                close("p")
            if tag == "body" and depth["head"]:
                close("head")
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID_TAGS and not match[3].endswith("/"):
            inner = _region(tag, match[3], region)
            if inner != region:
                flush()
            if inner in (CONTENT, SPARE) and (tag in CONTENT_TAGS or inner != region):
                elements += 1
                element = elements
            open_tags.append((tag, inner, element))
            depth[tag] += 1
            region = inner
    flush()
    return found


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """The page's lines and the content element of each: content, else articles in boilerplate by name, else unmarked with 0."""
    found = blocks(html or "")
    for wanted in (CONTENT, SPARE):
        content = [(text, element) for region, element, text in found if region == wanted]
        if content:
            return [text for text, _ in content], [element for _, element in content]
    return [text for _, _, text in found], [0] * len(found)


def main_lines(html: str | None) -> tuple[list[str], bool]:
    """The page's lines before they are compared with its neighbours'; true if they are unmarked."""
    lines, elements = page_lines(html)
    return lines, not any(elements)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends belong to one. Between them few pairs of equal lines are chained directly; where lines repeat much, the
    sequences are halved and the halves' lengths come from bit-parallel rows, with memory in proportion to the lines.
    """
    least = min(len(a), len(b))
    head = next((k for k in range(least) if a[k] != b[k]), least)
    tail = next((k for k in range(least - head) if a[-1 - k] != b[-1 - k]), least - head)
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    times = Counter(inner_b)
    few = sum(times[line] for line in inner_a) <= 16 * (len(inner_a) + len(inner_b))
    middle = _chained(inner_a, inner_b) if few else _halved(inner_a, inner_b)
    return [*range(head), *(head + k for k in middle), *range(len(a) - tail, len(a))]


def _chained(a: list[int], b: list[int]) -> list[int]:
    """By the pairs of equal lines, one after another."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    heads: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, heads[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                heads.append(link)
            else:
                ends[k], heads[k] = j, link
    chain, link = [], heads[-1] if heads else None
    while link:
        chain.append(link[0])
        link = link[1]
    return chain[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``: one bit per line of ``b``."""
    bits: dict[int, bytearray] = {}
    for j, line in enumerate(b):
        bits.setdefault(line, bytearray(len(b) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    masks = {line: int.from_bytes(where, "little") for line, where in bits.items()}
    whole = (1 << len(b)) - 1
    row = whole
    for line in a:
        met = row & masks.get(line, 0)
        row = ((row + met) | (row - met)) & whole
    steps = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - steps.astype(np.int64))])


def _halved(a: list[int], b: list[int]) -> list[int]:
    """By halves of ``a``, each with the part of ``b`` that suits it best."""
    found: list[int] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, j, k, m = parts.pop()
        x, y = a[i:j], b[k:m]
        if not x or not y:
            continue
        if len(x) == 1:
            if x[0] in y:
                found.append(i)
            continue
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        parts += [(i + half, j, k + cut, m), (i, i + half, k, k + cut)]
    return sorted(found)


def template_lines(lines: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of the lines shared with the first neighbour that is no copy.

    A neighbour that shares most lines is a copy if it shares most of those, too, that the next other neighbour
    which isn't the same page doesn't share. Where there is none to tell, it is taken for a copy.
    """
    shared = [common_lines(lines, other) for other in neighbours]
    for k, here in enumerate(shared):
        if len(here) < COPY_SHARE * len(lines):
            return here
        for other in shared[k + 1 :] + shared[:k]:
            if len(other) < len(lines):
                own = set(range(len(lines))) - set(other)
                if 2 * len(own & set(here)) < len(own):
                    return here
                break
    return []


def template_elements(lines: list[int], elements: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of the lines of elements of which two other texts share all lines; none if they are half of the lines."""
    others = [set(common_lines(lines, other)) for other in neighbours if other != lines]
    places: dict[int, list[int]] = {}
    for k, element in enumerate(elements):
        places.setdefault(element, []).append(k)
    gone = {e for e, where in places.items() if sum(other.issuperset(where) for other in others) >= 2}
    found = [k for k, element in enumerate(elements) if element in gone]
    return found if 2 * len(found) < len(lines) else []


def _line_rows(schema: T.StructType, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "html")):
            lines = [main_lines(html)[0] for html in batch["html"].to_pylist()]
            columns = [*(batch[n] for n in kept), pa.array(lines, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes(whole, "html")):
        hashes, marks = [], []
        for html in batch["html"].to_pylist():
            lines, elements = page_lines(html)
            hashes.append([xxhash.xxh64_intdigest(line.encode()) - (1 << 63) for line in lines])
            marks.append(elements)
        given = [batch["page"], batch["host"], batch["path"], pa.array(map(any, marks), pa.bool_())]
        columns = [*given, pa.array(hashes, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32()))]
        use = pa.array(map(bool, hashes), pa.bool_())
        yield pa.RecordBatch.from_arrays(columns, ["page", "host", "path", "marked", "lines", "elements"]).filter(use)


def _agreement(a: str, b: str) -> int:
    """Leading path segments that agree."""
    count = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        count += 1
    return count


def _gone(row: dict) -> list[int]:
    """Positions of a page's lines that its neighbours show to be template."""
    if not row["host"]:
        return []
    near = []
    for pair in ([row["before"], row["after"]], [row["before_2"], row["after_2"]]):
        found = [n for n in pair if n is not None and n["host"] == row["host"] and n["marked"] == row["marked"]]
        near += sorted(found, key=lambda n: -_agreement(n["path"], row["path"]))
    others = [n["lines"] for n in near]
    if row["marked"]:
        return template_elements(row["lines"], row["elements"], others)
    return template_lines(row["lines"], others)


def _template_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page", pa.int64()), ("gone", pa.list_(pa.int32()))])
    for whole in batches:
        for at in range(0, whole.num_rows, PAIR_ROWS):
            found = [(row["page"], _gone(row)) for row in whole.slice(at, PAIR_ROWS).to_pylist()]
            pages, gone = [p for p, lines in found if lines], [lines for _, lines in found if lines]
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], schema=schema)


def template_positions(pages: DataFrame) -> DataFrame:
    """``page, gone``: positions of template lines among the ``main_lines`` of pages (``page, url, html``)."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    hashed = pages.select("page", host.alias("host"), path.alias("path"), "html").mapInArrow(
        _hash_rows, "page bigint, host string, path string, marked boolean, lines array<bigint>, elements array<int>"
    )
    order = ["host", "marked", "path", "page"]
    ranged = hashed.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_pages = stored(ranged.withColumn("part", F.spark_partition_id()), "page-lines")
    page = F.struct("host", "marked", "path", "lines")
    in_part = Window.partitionBy("part").orderBy(*order)
    near = {"before": F.lag(page, 1), "before_2": F.lag(page, 2), "after": F.lead(page, 1), "after_2": F.lead(page, 2)}
    placed = (
        sorted_pages.withColumn("from_first", F.row_number().over(in_part))
        .withColumn("size", F.max("from_first").over(Window.partitionBy("part")))
        .where("from_first <= 2 OR from_first > size - 2")
    )
    own = ["page", "host", "marked", "path", "lines", "elements"]
    # the two outer pages on either side of each part know their neighbours in other parts from each other
    everywhere = Window.orderBy(*order)
    outer = placed.select(F.col("page").alias("outer"), *[n.over(everywhere).alias(f"part_{c}") for c, n in near.items()])
    within = sorted_pages.select(*own, *[n.over(in_part).alias(c) for c, n in near.items()])
    paired = within.join(outer, within.page == outer.outer, "left").select(
        *own, *[F.coalesce(c, f"part_{c}").alias(c) for c in near]
    )
    return paired.mapInArrow(_template_rows, "page bigint, gone array<int>")


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    key = F.xxhash64(F.col("page_id"), F.col("url"), F.col("html"))
    keyed = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text", "n_chars")],
        key.alias("page_key"),
        F.col("html").cast("string").alias("html"),
    )
    gone = stored(template_positions(keyed.select(F.col("page_key").alias("page"), "url", "html")), "page-templates")
    kept = [c for c in keyed.columns if c != "html"]
    schema = T.StructType([keyed.schema[c] for c in kept]).add("page_lines", T.ArrayType(T.StringType()))
    read = keyed.mapInArrow(_line_rows(schema, kept), schema)
    joined = read.join(gone.withColumnRenamed("page", "page_key"), "page_key", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("page_lines") - 1), F.col("gone"))
    lines = F.when(F.col("gone").isNull(), F.col("page_lines")).otherwise(F.transform(left, lambda i: F.get("page_lines", i)))
    text = F.array_join(lines, "\n")
    through = [F.col(f"`{c}`") for c in kept if c != "page_key"]
    return joined.select(*through, text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))
