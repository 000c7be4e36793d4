from __future__ import annotations

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from tastemill.llm import html_differencing as H
from tastemill.llm.storage import table

SMALL = "/root/testdata/sf0.001"


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], max(before + (x == y), row[j + 1], row[j])
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        got = [x for x, k in zip(a, H.shared_lines(a, b), strict=True) if k]
        assert len(got) == lcs_length(a, b)
        it = iter(b)
        assert all(x in it for x in got)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>x</nav><article><h1>T&eacute;</h1><p>a\n  b<p>c<br>d <b>e</b>f</article><footer>z</footer>", "Té\na b\nc d ef"),
        ("<article><header><h1>T</h1></header><p>a</p><aside>no</aside><form>no<input></form><div class='comments'><p>no</p></div><p>b</p></article>", "T\na\nb"),
        ("<main><div id=cookie-notice>no</div><p>a<script>var x='</p>';</script>b</p><style>p{}</style></main><div class=sidebar>no</div>", "ab"),
        ("<div class='site-header'>no</div><p>a</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "a\nx\ny\n1\n2"),
        ("<article><p>a &lt;b&gt; &#233; 1 < 2</p><!-- no <p>no --><p hidden>no</p><p role=alert>no</p></article>", "a <b> é 1 < 2"),
        ("<header>no</header><article><p>x<div class='ad'>no</div>y</p></article>", "x\ny"),
        ("<article><p class='related-work'>a</p><div class='post share-price'>b</div><section id='legal'>c</section><h2 id='notice'>d</h2></article>", "a\nb\nc\nd"),
        ("<article><div class='ad-box'>no</div><div class='top-menu'>no</div><p class='notice'>no</p><p>1 + <math><mi>x</mi></math></p></article>", "1 + x"),
        ("<article><p>yes</p></article><article class='comment'><p>no</p></article>", "yes"),
        ("<article><p title='a>b' data-x=\"c>d\">x</p><p title='it's>y</p><a \"q>z</a></article>", "x\ny\nz"),
        ("<article><section class='reader-comments'><article class='comment'><p>no</p></article></section><p>yes</p></article>", "yes"),
    ],
)
def test_blocks(page, text):
    assert H.main_text(H.blocks(page), []) == text


def test_differencing_removes_shared_lines_where_markup_is_silent(spark):
    page = lambda k: f"<div>Welcome to the site</div><p>Story {k}</p><p>More {k}</p><div>All rights kept</div>"
    rows = [(k, f"http://h.test/{k}", page(k), "x") for k in range(6)] + [(9, "http://other.test/1", page(9), "x"), (None, None, None, None)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(1)).collect()}
    assert got[9] == "Welcome to the site\nStory 9\nMore 9\nAll rights kept" and got[None] == ""
    assert all(got[k] == f"Story {k}\nMore {k}" for k in range(6)) or spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_without_an_article_keep_their_text(spark):
    page = lambda k, more="": f"<div>Welcome to the site</div><p>Story {k} {'of some length ' * 9}</p>{more}<div>All rights kept</div>"
    story = lambda k: f"Story {k} {'of some length ' * 9}".strip()
    whole = lambda k: f"Welcome to the site\n{story(k)}\nAll rights kept"
    rows = [(1, "http://alone.test/a", page(1)), (2, "http://alone.test/b", page(1))]  # only copies
    rows += [(3, "http://twice.test/a", page(3))] * 2  # a row that repeats
    rows += [(10 + k, f"http://mixed.test/{k}", page(5 if k in (1, 2, 3) else 50 + k)) for k in range(6)]  # copies among pages of the template
    rows += [(20, "http://near.test/1", page(20)), (21, "http://near.test/2", page(20, "<p>May 5</p>")), (22, "http://near.test/3", page(22))]
    rows += [(30, "http://end.test/1", page(30)), (31, "http://end.test/2", page(31)), (32, "http://end.test/3", page(31))]
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect())
    assert [r[0] for r in got] == sorted(r[0] for r in rows) and all(n == len(text) for _, text, n in got)
    texts = {i: text for i, text, _ in got}
    assert texts[1] == texts[2] == whole(1) and [t for i, t, _ in got if i == 3] == [whole(3)] * 2
    one_range = sorted((i, u, u.split("/")[2], H.blocks(h)) for i, u, h in rows)
    texts = {i: text for i, _, text in H.differenced(sorted(one_range, key=lambda r: (r[2], r[1])))}
    assert texts[1] == texts[2] == whole(1) and texts[3] == whole(3)
    assert [texts[10 + k] for k in range(6)] == [story(5 if k in (1, 2, 3) else 50 + k) for k in range(6)]
    assert texts[20] == story(20) and texts[21] == story(20) + "\nMay 5" and texts[22] == story(22)
    assert [texts[k] for k in (30, 31, 32)] == [story(30), story(31), story(31)]


def test_runs_of_copies_are_held_once_and_settle_in_linear_time():
    page = H.blocks("".join(f"<p>{k} some words</p>" for k in range(60)))
    near = [[*page[:k], (1, f"line {k}"), *page[k + 1 :]] for k in range(60)]
    rows = [(k, "u", "h", page if k % 2 else near[k // 2 % 60]) for k in range(6000)]
    got = {i: text for i, _, text in H.differenced([*rows, (-1, "v", "h", H.blocks("<p>5 some words</p><p>else</p>"))])}
    assert len(got) == 6001 and got[-1] == "else"
    assert got[1] == "\n".join(s for _, s in page if s != "5 some words") and got[0].startswith("line 0\n1 some words")


def test_article_of_the_pages_table(spark):
    pages = table(spark, SMALL, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in x else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id][0] == "\n".join(x for x in parts if x), r.page_id
        assert got[r.page_id][1] == len(got[r.page_id][0])


@pytest.mark.parametrize(
    "part",
    ["<", "<p>", "<b>", "&amp;", "<a b='", "<!--", "<a x ", "<a '", "<a b='>", "<![CDATA[ >", "<div>", "<li><div>", "<a b= \"'>", "</i>", "<x y", "<p class=", "<a 'x'='", "<title>", "<table><td>"],
)
def test_time_is_linear_in_the_page(part):
    def took(n):
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            H.blocks(part * n)
            best = min(best, time.process_time() - began)
        return best

    assert took(80_000) < 0.2 + 9 * took(20_000)  # 4 where it is linear, 16 where it is quadratic


def test_long_attributes_and_deep_pages():
    began = time.process_time()
    H.blocks("<p " + "x" * 400_000 + "><p " + "' " * 200_000 + "><article>" + "<i>" * 100_000 + "</b>" * 100_000 + "deep")
    a, b = [str(k % 7000) for k in range(20_000)], [str(k % 9000) for k in range(20_000)]
    H.shared_lines(a, b)
    assert time.process_time() - began < 30
    assert H.main_text(H.blocks("<article>" + "<div>" * 2000 + "<p>a</p>" + "</div>" * 2000 + "<p>b</p></article><p>c</p>"), []) == "a\nb"


def test_of_several_articles_differencing_decides():
    page = lambda k: f"<article><h1>Guide to the site</h1><p>Same on each page</p></article><article><h1>Story {k}</h1><p>More {k}</p></article>"
    rows = [(k, f"/{k}", "h", H.blocks(page(k))) for k in range(4)]
    assert [t for _, _, t in H.differenced(rows)] == [f"Story {k}\nMore {k}" for k in range(4)]
    assert [t for _, _, t in H.differenced(rows[:1])] == ["Guide to the site\nSame on each page\nStory 0\nMore 0"]
    assert {t for _, _, t in H.differenced([rows[0], rows[0]])} == {"Guide to the site\nSame on each page\nStory 0\nMore 0"}


def test_text_is_the_same_however_ranges_are_cut(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(260):
        host = rnd.choice(["a.test", "a.test", "b.test", "c.test"])
        lines = [f"<div>Site of {host}</div>", f"<p>Story {rnd.randrange(140)}</p>", f"<p>More {k}</p>", "<div>Kept</div>" if k % 3 else ""]
        rows.append((k, f"http://{host}/{rnd.randrange(60)}", "".join(lines)))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, H.extract(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 260
    order = sorted((u.split("/")[2] + "\0" + u.split("//")[1][6:] + f"\0{i}", i, u, h) for i, u, h in rows)
    whole = sorted((i, u, t, len(t)) for i, u, t in H.differenced([(i, u, u.split("/")[2], H.blocks(h)) for _, i, u, h in order]))
    assert seen[0] == whole and all("Site of" not in t for *_, t, _ in whole)


def test_long_pages_take_linear_time():
    for page in ("<" * 200_000, "<p>" * 50_000, "<b>" * 20_000, "&amp;" * 100_000, "<a b='" * 20_000, "<!--" * 50_000):
        H.blocks(page)
    a, b = np.arange(2000).astype(str).tolist(), np.arange(1, 4001, 2).astype(str).tolist()
    assert H.shared_lines(a, b).sum() == 1000
    assert list(itertools.islice(H.blocks("<article>x</article>"), 1)) == [(2, "x")]


def test_differencing_decides_on_a_single_article_too():
    site = "<article><h1>Guide to the site</h1></article>"
    rows = [(k, f"/{k}", "h", H.blocks(f"{site}<div><p>Story {k} {'of some length ' * 9}</p><p>More {k}</p></div>")) for k in range(3)]
    assert [t for _, _, t in H.differenced(rows)] == [f"Story {k} {'of some length ' * 9}".strip() + f"\nMore {k}" for k in range(3)]
    page = lambda k: H.blocks(f"<p>By {k}</p><article><h1>Story</h1><p>The same line of each page</p><p>Own {k} {'words ' * 9}</p></article>")
    whole = [f"Story\nThe same line of each page\nOwn {k} {'words ' * 9}".strip() for k in range(3)]
    assert [t for _, _, t in H.differenced([(k, f"/{k}", "h", page(k)) for k in range(3)])] == whole
    assert [t for _, _, t in H.differenced([(k, f"/{k}", "h", page(0)) for k in range(3)])] == [whole[0]] * 3
