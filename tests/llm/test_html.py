"""Main text against pages whose parts are known, and templates against counts written out."""

import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA), **options).collect()}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div class="wrap has-sidebar"><article><p>story</p></article></div>', "story"),
        ('<article class="post no-comments"><p>story</p></article>', "story"),
        ('<section id="related-work"><p>story</p></section>', "story"),
        ("<article><header><h1>T</h1><p>lead</p></header><p>body</p></article>", "T\nlead\nbody"),
        ("<article><p>Energy <math><mi>E</mi></math> is.</p><xmp>a &amp; <b></xmp></article>", "Energy E is.\na &amp; <b>"),
        ("<div>" + "<p>A long story that goes on.</p>" * 5 + "</div><article><p>teaser</p></article>", "\n".join(["A long story that goes on."] * 5 + ["teaser"])),
        ("<form><article>story</article><input></form>", "story"),
        ("<header>site</header><nav>menu</nav><main>x<aside>y</aside></main><footer>f</footer>", "x"),
        ('<p>a <span class="ad">buy</span> b</p><div class="post-comments"><p>me too</p></div>', "a b"),
        ('<div class="site-footer">f</div><p>x</p>', "x"),
        ("<p>" + "long " * 200_000, ("long " * 200_000).strip()),
        ("<div>" * 3000 + "x" + "</b>" * 3000, "x"),
    ],
)
def test_shapes_of_pages(html, want):
    assert H.main_text(html, set()) == want


def made(rng, host, i, kind):
    """(html, main text) of a page whose menu, advert and notices have words of their own on every page."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    story = [words(rng.randrange(20, 40)) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in story)
    box = {"article": f"<article>{body}</article>", "div": f'<div class="story"><div class="lead">{story[0]}</div>{"".join(f"<p>{p}</p>" for p in story[1:])}</div>'}[kind]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(rng.randrange(3, 7)).split())
    html = f'<body><div class="top"><ul>{menu}</ul></div><div id="x1">{words(4)}</div>{box}<div class="extra"><p>{words(5)}</p></div><div class="legal">{words(3)}</div></body>'
    return html, "\n".join(story)


@pytest.mark.parametrize("few", [0, H.BROADCAST_HASHES])
def test_counts_decide(spark, few):
    """No tag or word tells these boxes; that their shape recurs beside the story does, on hosts with pages enough."""
    rng = random.Random(11)
    rows, want = [], {}
    for h, (n, kind) in enumerate([(40, "article"), (35, "div"), (6, "div")]):
        for i in range(n):
            html, want[h * 100 + i] = made(rng, h, i, kind)
            rows.append((h * 100 + i, f"http://h{h}.x/{i}", html))
    got = texts(spark, rows, few=few)
    assert all(got[i] == want[i] for i in want if i < 200)
    assert all(got[i].splitlines() != want[i].splitlines() and set(want[i].splitlines()) < set(got[i].splitlines()) for i in want if i >= 200)
    bare = texts(spark, rows, few=few, min_pages=10**6)
    assert all(bare[i] != want[i] for i in want)


def test_templates_by_brute_force(spark):
    rng = random.Random(12)
    pages = []
    for i in range(120):
        boxes = [f'<div class="b{rng.randrange(4)}">{rng.choice("pqrst") * rng.randrange(1, 30)}</div>' for _ in range(4)]
        pages.append((i, f"http://h{i % 3}.x/", "".join(boxes) + ("<article>s</article>" if i % 4 else "")))
    pages += pages[:20]  # equal pages count once
    outside, inside = defaultdict(Counter), defaultdict(Counter)
    for url, html in {(u, h) for _, u, h in pages}:
        a, b = H.read_page(html).counted()
        outside[url[7:11]].update(set(a))
        inside[url[7:11]].update(set(b))
    for least in (1, 5, 10):
        got = {(r.host, r.tree, r.pages) for r in H.templates(H.subtrees(spark.createDataFrame(pages, SCHEMA)), least).collect()}
        assert got == {(h, t, n) for h, c in outside.items() for t, n in c.items() if n >= least and n > inside[h][t]}


def test_main_and_counted():
    page = H.read_page('<div class="m">menu</div><div class="s">' + "<p>story story story</p>" * 3 + '<div class="i">x</div></div>')
    names = {h: (a, b) for h, a, b in page.shapes}
    out, inner = page.counted()
    assert [names[h] for h in out if h in names] == [(0, 1)] and sorted(names[h] for h in inner) == [(1, 5), (4, 5)]
    assert H.read_page("<div class='a'>x</div><div class='b'>y</div>").main() == []


def test_threshold_is_met_by_just_enough_pages(spark):
    """A box on exactly 10 different pages goes, one on 9 stays; a copy of a page adds nothing."""
    page = lambda i: f"<body>{'<div>ten</div>' if i < 10 else ''}{'<div>nine</div>' if i < 9 else ''}<p>own {i}</p></body>"
    rows = [(i, "http://h.x/", page(i)) for i in range(12)] + [(100 + i, "http://h.x/", page(0)) for i in range(5)]
    got = texts(spark, rows)
    assert got == {i: "nine\n" * (i < 9) + f"own {i}" for i in range(12)} | {100 + i: "nine\nown 0" for i in range(5)}


def test_hosts(spark):
    urls = {"//h.x/1": "h.x", "http://a@b@h.x/1": "h.x", " http://H.x:80/1": "h.x", "http://[::1]/x": "[::1]", "http://h.x?q=//k/": "h.x", None: "", "no": ""}
    rows = [(i, u, "") for i, u in enumerate(urls)]
    got = {r.page_id: r.host for r in H._with_host(spark.createDataFrame(rows, SCHEMA), "page_id", "url", "html").collect()}
    assert got == dict(enumerate(urls.values()))
