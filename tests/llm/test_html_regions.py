"""Main text under wrappers whose names look like boilerplate, and under large templates."""

import random
import time

import pytest

from marketgrain.llm import html


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><article>Text</article></div>",
        "<main class='has-sidebar'>Text</main>",
        "<article class='post social-science'>Text</article>",
        "<div id='comment-policy'>Text</div>",
        "<div class='widget'><article>Text</article></div>",
        "<div class='sidebar'><main>Text</main></div><article>Teaser</article>",
        "<article>Text<div id='comments'><article class='comment'>Hey</article></div></article>",
        "<article>Text<article class='comment'>Hey</article></article><div class='related'><article>No</article></div>",
        "<div class='left-sidebar'>No</div><div class='ad-slot'>No</div><div class='cookie-banner'>No</div><p>Text</p>",
    ],
)
def test_names_lose_no_content(page):
    lines, _ = html.main_lines(page)
    assert lines[0] == "Text" and not {"Hey", "No"} & set(lines)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_large_templates_go(spark, parts):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(10))
    plain = lambda n: f"{menu}<p>Text {n}</p><p>More {n}</p>"
    rows = [(k, f"https://h.example/a/{k:02}", plain(k)) for k in range(20)]
    rows += [(30, "https://h.example/a/09", plain(9))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: f"Text {k % 21}\nMore {k % 21}" for k in range(20)} | {30: "Text 9\nMore 9"}


def test_copies_keep_their_text():
    assert html.template_lines([1, 2, 3, 4, 5, 6], [[1, 2, 3, 4, 5, 6], [1, 7, 8, 9, 10, 6]]) == [0, 5]
    assert html.template_lines([1, 2, 3, 4, 5, 6], [[1, 2, 3, 4, 5, 6]] * 2) == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>before</p><svg class='i'/><p>after</p></main>", ["before", "after"]),
        ("<main><p>before<math/></p><svg><text>No</text></svg><p>after</p></main>", ["before", "after"]),
        ("<article>Text</article><article class='comment'>No</article>", ["Text"]),
        ("<article>Text</article><article class='teaser card'>No</article>", ["Text"]),
        ("<article>Text</article><article class='sponsored'>No</article>", ["Text"]),
        ("<article class='teaser'>Only</article>", ["Only"]),
        ("<article class='comment'>No</article><p>Text</p>", ["Text"]),
        ("<p>Text</p><ul class='commentlist'><li>No</ul>", ["Text"]),
        ("<p>Text</p><div class='advert-large'>No</div><div class='cookie-law-info'>No</div>", ["Text"]),
        ("<p>Text</p><div style='display:none'>No</div><div style='color:red; display : none'>No</div>", ["Text"]),
        ("<article>Text<div style='border:none'>More</div></article>", ["Text", "More"]),
    ],
)
def test_what_is_not_the_article(page, want):
    assert html.main_lines(page)[0] == want


def test_nested_unclosed_blocks_take_linear_time():
    started = time.perf_counter()
    lines, _ = html.main_lines("<div>" * 60_000 + "deep" + "<p>" * 60_000 + "end")
    assert lines == ["deep", "end"] and time.perf_counter() - started < 5


def test_pages_of_repeated_lines_take_little_time():
    started = time.perf_counter()
    assert len(html.common_lines([0] * 6000, [0] * 5000)) == 5000
    rng = random.Random(2)
    a, b = ([rng.randint(0, 3) for _ in range(3000)] for _ in range(2))
    assert len(html.common_lines([7, *a], [*b, 8])) == html._lengths(a, b)[-1]
    assert time.perf_counter() - started < 10


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_both_ways_to_align_are_longest():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice((1, 3, 9))) for _ in range(rng.randint(0, 14))] for _ in range(2))
        for found in (html._chained(a, b), html._halved(a, b), html.common_lines(a, b)):
            assert len(found) == longest(a, b) and found == sorted(set(found))
            rest = iter(b)
            assert all(a[k] in rest for k in found)  # in order


def test_differencing_against_sorted_pages(spark):
    """Pages without a marked article: each against its neighbours in host and path order, one page at a time."""
    rng = random.Random(8)
    menu = [f"Menu {k}" for k in range(6)]
    rows = []
    for number in range(120):
        host = rng.choice(("a.example", "a.example", "b.example"))
        path = "/".join(rng.choice("xyz") for _ in range(rng.randint(1, 3)))
        own = [f"Line {rng.randint(0, 40)}" for _ in range(rng.randint(1, 6))]
        lines = menu[: rng.randint(0, 6)] + own + [f"Foot {host}"] * rng.randint(0, 1)
        rows.append((number, f"https://{host}/{path}/{number}", "".join(f"<p>{x}</p>" for x in lines), lines))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(5)
    ordered = sorted((url.split("/", 3)[2], "/" + url.split("/", 3)[3], number, lines) for number, url, _, lines in rows)
    want = {}
    for place, (host, path, number, lines) in enumerate(ordered):
        near = []
        for distance in (1, 2):
            sides = [ordered[p] for p in (place - distance, place + distance) if 0 <= p < len(ordered)]
            near += sorted((x for x in sides if x[0] == host), key=lambda x: -html._agreement(x[1], path))
        gone = html.template_lines(lines, [x[3] for x in near])
        want[number] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r.page_id: r.text for r in html.extract_text(pages).collect()} == want
    assert any(len(want[n].split("\n")) < len(lines) for n, _, _, lines in rows)


def test_marked_pages_are_compared_too(spark):
    """An article that the neighbours hold as well is template; an article's own lines stay, shared ones too."""
    note = "<article><p>About us</p><p>Write to us</p></article>"
    own = lambda k: f"<article><h1>Title {k}</h1><p>Same words</p><p>Text {k}</p><p>End {k}</p></article>"
    rows = [(k, f"https://h.example/a/{k:02}", f"<p>Top</p><main><p>News</p>{own(k)}{note}</main>") for k in range(9)]
    # one article that two pages list, and copies of one text
    rows += [(20 + k, f"https://l.example/{k}", own(k) + own(k + 1)) for k in range(4)]
    rows += [(30 + k, f"https://c.example/{k}", own(0) + f"<article>Beside {k}</article>") for k in range(4)]
    # unmarked pages among marked ones of their host
    rows += [(40 + k, f"https://m.example/{k}", f"<p>Top</p><p>Menu</p>{own(k) if k % 2 else f'<p>Line {k}</p>'}") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    text = lambda k: f"Title {k}\nSame words\nText {k}\nEnd {k}"
    want = {k: text(k) for k in range(9)}
    want |= {20 + k: f"{text(k)}\n{text(k + 1)}" for k in range(4)}
    want |= {30 + k: f"{text(0)}\nBeside {k}" for k in range(4)}
    want |= {40 + k: text(k) if k % 2 else f"Line {k}" for k in range(6)}
    assert got == want
