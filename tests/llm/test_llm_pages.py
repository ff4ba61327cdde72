"""HTML extraction against brute force, hand-written pages and the given ones."""

import os
import random
import re
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from llm_cases import clashing

from seekwell.llm.main_text import covered, gram_keys, main_text, parse, token, windows
from seekwell.llm.page_blocks import ARTICLE, AROUND, MAIN, OPEN, blocks

FOLDER = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")
COLUMNS = "page_id long, url string, html string"


def texts(html):
    return parse(html)[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>a</p><p>b</article>", ["a", "b"]),
        ("<article><p><b>one<br><p>two</b> three</p></article>tail", ["one", "two three"]),
        ("<article>x &amp; y &lt;z&gt; &nbsp; &#65;&#x42; &copy &unknown; &am</article>", ["x & y <z> AB © &unknown; &am"]),
        ("<article>a\n\t b<br>c<br/>d<wbr>e</article>", ["a b c de"]),
        ("<article><h1>T</h1><nav><p>n</p></nav><p>a</p><footer>f</footer></article><p>after</p>", ["T", "a"]),
        ("<header><h1>Site</h1></header><article><header><h2>T</h2><p>by X</p></header>a</article>", ["T", "a"]),
        ("<article>a<div class='ad box'>buy<div>now</div></div>b</article>", ["a", "b"]),
        ('<article>a <span class="ad">buy</span>b<p>c<a class="share-button" href="x">s</a></p></article>', ["a b", "c"]),
        ("<article><form><p>f<input>g</form><p>a<script>if (a</b>c) '</p>'</script>b<style>p{}</style></article>", ["ab"]),
        ("<article><!-- <p>no</p> --><p>a<!-- > -->b</p><!-- open <p>c</p></article>", ["ab"]),
        ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table></article>", ["a", "b", "c", "d", "1 2", "3"]),
        ('<article><p title="a > b" data-x=\'<p>\'>a</p><p title="open>b</p></article>', ["a", "b"]),
        ("<article>a<div hidden>h</div><div style='display: none'>i</div><div aria-hidden=true>j</div><p role=alert>k</p>b</article>", ["a", "b"]),
        ("<ARTICLE><P>A</P></ARTICLE>", ["A"]),
        ("<article>a</article><div id=comments><article>c</article></div><article class='comment x'>d</article><article>e", ["a", "e"]),
        ("<main><nav>n</nav><p>a</p></main><p>b</p>", ["a"]),
        ("<div role=main><p>a</div><aside>b</aside>", ["a"]),
        ("<main><p>m</p><div itemprop='articleBody'><p>a</p></div></main>", ["a"]),
        ("<body class=has-sidebar><main class=sidebar-left><p>a</p></main>", ["a"]),
        ("<article>a < b and c > d</article>", ["a < b and c > d"]),
        ("<article><title>t</title><noscript>n</noscript><svg><path/><text>s</text></svg>a<select><option>o</select><textarea><p>x</textarea>b</article>", ["ab"]),
        ("<article></div></p></b>a</article></article>b", ["a"]),
        ("", []),
        ("<article></article>", []),
        ("plain", []),
    ],
)
def test_article(html, want):
    assert texts(html) == want


def test_places():
    html = "<head><title>t</title></head><body>x<nav>n</nav><div class=cookie-notice>c</div><main>m<article>a</article></main><p>y"
    assert [(b.place, b.text) for b in blocks(html)] == [(OPEN, "x"), (AROUND, "n"), (AROUND, "c"), (MAIN, "m"), (ARTICLE, "a"), (OPEN, "y")]


def test_hostile_markup_ends():
    for html in ["<" * 50_000, "<p" * 50_000, "<!--" * 50_000, "<p a='" * 2_000, "</div>" * 50_000, "<div>" * 3_000 + "x", "&" * 50_000]:
        list(blocks(html))


def plain_repeats(streams, run, pages):
    """Which tokens of each stream lie in a run that enough distinct streams hold."""
    holders = defaultdict(set)
    for s in streams:
        for i in range(len(s) - run + 1):
            holders[tuple(s[i : i + run])].add(tuple(s))
    out = []
    for s in streams:
        marks = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(holders[tuple(s[i : i + run])]) >= pages:
                marks[i : i + run] = [True] * run
        out.append(marks)
    return out


def soup(seed, n):
    """Pages without any element that says what it holds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
    shared = [[" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))] for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [" ".join(word() for _ in range(rng.randint(0, 14)))] for _ in range(rng.randint(0, 6))]
        out.append("".join(f"<div>{b}</div>" if rng.random() < 0.5 else f"<p>{b}" for part in parts for b in part))
    return out


@pytest.mark.parametrize(("run", "pages", "part_tokens"), [(8, 3, 1 << 20), (4, 2, 50), (3, 2, 7), (5, 4, 400)])
def test_equals_brute_force(spark, run, pages, part_tokens):
    htmls = soup(run, 90) + [None, "", "<p>alone", "<article>kept<p>kept", "<nav>x"] * 2
    htmls += ["<p>common notice of all the pages here</p><p>more of it</p>"] * 50  # a third are one page
    hosts = ["http://a.org/x", "https://u:p@A.org:80/y?z", "http://b.org", None, "no host"]
    rng = random.Random(3)
    data = [(None if i % 17 == 0 else i // 2, rng.choice(hosts), html) for i, html in enumerate(htmls)]
    got = main_text(clashing(spark.createDataFrame(data, COLUMNS).repartition(5), "text", "host", "key", "n", "size"), run, pages, part_tokens)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_outside", "n_repeated"]
    by_host = defaultdict(list)
    for page_id, url, html in data:
        host = "a.org" if url and "org" in url and "b.org" not in url else "b.org" if url and "b.org" in url else ""
        by_host[host].append((page_id, url, html or ""))
    want = []
    for pages_of in by_host.values():
        streams = []
        for _, _, html in pages_of:
            outside = [b for b in blocks(html) if b.place != ARTICLE]
            streams.append([w for b in outside for w in (f"<{b.element}>", *b.text.split())])
        for (page_id, url, html), s, marks in zip(pages_of, streams, plain_repeats(streams, run, pages)):
            if "<article>" in html:
                text = "\n\n".join(b.text for b in blocks(html) if b.place == ARTICLE)
            else:
                lines = []
                for w, gone in zip(s, marks):
                    if w.startswith("<"):
                        lines.append([])
                    elif not gone:
                        lines[-1].append(w)
                text = "\n\n".join(" ".join(line) for line in lines if line) if not html.startswith("<nav>") else ""
            want.append((page_id, url, text, len(text), len(s), sum(marks)))
    rows = got.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert sum(r.n_repeated for r in rows) > 0 and any(r.text and r.n_repeated for r in rows)


def test_no_pages(spark):
    assert main_text(spark.createDataFrame([], COLUMNS)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, run in [(0, 3), (2, 3), (3, 3), (400, 1), (400, 2), (400, 5), (400, 8)]:
        ids = rng.integers(0, 3, n).astype(np.uint64)
        rank = windows(ids, run)
        whole = [tuple(ids[i : i + run]) for i in range(max(0, n - run + 1))]
        assert (rank[len(whole) :] == -1).all()
        order = {w: i for i, w in enumerate(sorted(set(whole)))}
        assert rank[: len(whole)].tolist() == [order[w] for w in whole]
    ids = np.array([token(w) for w in "a b c a b d".split()], np.uint64)
    keys = gram_keys(ids, 2)
    assert keys[0] == keys[3] and len(set(keys[:5].tolist())) == 4
    assert covered(ids, np.sort(keys[:1]), 2).tolist() == [True, True, False, True, True, False]


def test_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in main_text(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    assert len(got) == len(pages) > 100
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        row = got[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, want, len(want))
    assert sum(r.n_repeated for r in got.values()) > 0
